"""Exact token ids of the public tokenizers, at a fraction of the library's cost.

The library spends most of its time per call and per character; natural text
repeats its words. Texts are cut where the tokenizer is sure to cut as well, and
the ids of each distinct piece come from the library once per worker, through a
memo of bounded size. Special strings inside texts are treated as the library
treats them by default: each becomes its own id.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridweave.llm.common import Memo, words_in

#: A space before a character that is white space for no engine: byte-level BPE starts a piece there.
_PIECE = re.compile(" (?=[!-~¡-¬®-ɏ])")
_ASCII_SPACE = re.compile("[ \t-\r]+")
#: Pieces of these characters alone fall into runs of letters, of digits and of marks for either tokenizer.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:;=>?@\\[-`{-~"
_SIMPLE = re.compile(f"[{_LETTER}0-9{_MARK}]+(?:\n[{_LETTER}0-9{_MARK}]+)*\n?")
_RUN = re.compile(f"[{_LETTER}]+|[0-9]+|[{_MARK}]+|\n")
#: Longer texts are worked on in parts, so that the pieces in memory stay few.
PART = 1 << 20
#: Characters of distinct pieces that the library gets at once.
BATCH = 1 << 16


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is visible, else 256 and up."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(spare)) for b in range(256)}


def parts(text: str, boundary: re.Pattern, limit: int = PART) -> Iterator[str]:
    """Cut ``text`` after about ``limit`` characters each, only where ``boundary`` matches; a part starts with the match."""
    start = 0
    while len(text) - start > limit:
        cut = boundary.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class ByteLevelBpe:
    """Ids of a byte-level BPE with the usual splitting rule (a leading space belongs to the next word)."""

    def __init__(self, path: str, memo: int = 250_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.symbols = byte_symbols()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Memo(self._after_space, memo)
        self.runs = Memo(self._run, memo // 3)

    def _exact(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """One piece of the splitting rule: the merges alone decide."""
        return array("I", [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.symbols))]).tobytes()

    def _after_space(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self._run(" " + piece)
        if _SIMPLE.fullmatch(piece):
            first, *rest = _RUN.findall(piece)
            if not rest:
                return self._run(" " + first)
            # the first run with the space before it is a piece of its own
            return b"".join((self.pieces[first], *map(self.runs.__getitem__, rest)))
        return self._exact(" " + piece)

    def _segment(self, text: str) -> bytes:
        out = []
        for part in parts(text, _PIECE):
            first, *rest = _PIECE.split(part)
            if first:
                out.append(self._exact(first))
            out.extend(map(self.pieces.__getitem__, rest))
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.special_at is None or not any(s in text for s in self.special):
            return self._segment(text)
        return b"".join(
            np.array([self.special[x]], dtype="<u4").tobytes() if k % 2 else self._segment(x)
            for k, x in enumerate(self.special_at.split(text))
        )


class WordBpe:
    """Token counts of a BPE with word ends that lower-cases and drops white space.

    ASCII white space always separates its tokens, so texts are cut there, and the
    library encodes batches of the distinct pieces that the worker has not met lately.
    """

    def __init__(self, path: str, memo: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.memo, self.lengths = memo, {}

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces in batches of about BATCH characters, and keep the lengths."""
        start = held = 0
        for k, piece in enumerate(pieces):
            held += len(piece)
            if held >= BATCH or k + 1 == len(pieces):
                part = pieces[start : k + 1]
                self.lengths.update(zip(part, map(len, self.library.encode_batch(part, add_special_tokens=False))))
                start, held = k + 1, 0

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; long texts are worked on in parts that start at white space."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        if (sizes <= 2 * PART).all():
            return self._counts(texts)
        out = np.zeros(len(texts), dtype=np.int64)
        short = sizes <= 2 * PART
        out[short] = self._counts(texts.filter(pa.array(short)))
        for k in np.flatnonzero(~short).tolist():
            out[k] = sum(int(self._counts(pa.array([part]))[0]) for part in parts(texts[k].as_py(), _ASCII_SPACE))
        return out

    def _counts(self, texts: pa.Array) -> np.ndarray:
        owner, code, distinct = words_in(texts, pc.ascii_split_whitespace)
        if len(self.lengths) > self.memo:
            self.lengths = {}
        self.learn([p for p in distinct if p not in self.lengths])
        n = np.fromiter(map(self.lengths.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        return np.bincount(owner, n[code] if len(code) else None, len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevelBpe:
    """One per worker process and file."""
    return ByteLevelBpe(path)


@functools.lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One per worker process and file."""
    return WordBpe(path)
