"""Language identification by interpolated Kneser-Ney character models.

Words are read alone, between boundary marks, as letters in lower case. Counts,
discounts, continuation counts, back-off weights and interpolated probabilities
of all n-grams up to ORDER are DataFrames over every learnable document: nothing
is cut off. For scoring they become sorted hash arrays in shards of bounded size.
A shard holds up to SHARD_LANGUAGES languages and all n-grams whose last
character follows one of a range of characters, so each character of a text is
scored in one shard alone and the shards' sums add up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import fold, released, slices_by_bytes, sums_by_owner, words_in
from gridweave.session import discard, stored, stored_alone

ORDER = 4
#: Words counted in a task before their n-grams are sent on, and words whose n-grams are made at once.
FLUSH_WORDS, AT_ONCE = 300_000, 40_000
#: N-grams and languages of a shard. More n-grams make more shards, each a pass over the texts.
SHARD_ROWS, SHARD_LANGUAGES = 2_000_000, 8
#: Characters before the predicted one fall into so many classes, which shards have ranges of.
CLASSES = 256
#: Longer runs of letters are read as several words of this length.
WORD = 64
UNDETERMINED = "und"
#: A table of one row a language is broadcast up to so many.
BROADCAST_ROWS = 100_000

_RUN = re.compile(r"[^\W\d_]+")


def words_of(piece: str) -> list[str]:
    """Lower-case letter runs of a piece of text; very long runs as several words."""
    return [run[k : k + WORD] for run in _RUN.findall(piece.lower()) for k in range(0, len(run), WORD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def ngrams(words: list[str]):
    """(owner, place, keep, hashes, contexts, before) of the characters of words with a mark at either end.

    A character at place j of its word is predicted (keep) from up to ORDER - 1
    characters before it. hashes[k] is its n-gram of order k and contexts[k] the
    k - 1 characters before it, as an n-gram of order k - 1; 0 where fewer come
    before. before: the class of the one character before it.
    """
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    flat = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - starts[owner]
    hashes, contexts = {}, {1: np.zeros(len(flat), dtype=np.uint64)}
    rolling = np.zeros(len(flat), dtype=np.uint64)
    for k in range(1, ORDER + 1):
        shifted = np.zeros(len(flat), dtype=np.uint64)
        shifted[k - 1 :] = flat[: len(flat) - k + 1]
        rolling = _mix(rolling + (shifted + np.uint64(k << 24)) * np.uint64(0x9E3779B97F4A7C15))
        hashes[k] = np.where(place < k - 1, np.uint64(0), rolling)
        if k < ORDER:
            contexts[k + 1] = np.where(place < k, np.uint64(0), np.r_[np.uint64(0), hashes[k][:-1]])
    before = (_mix(np.r_[np.uint64(0), flat[:-1]] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(CLASSES)).astype(np.int32)
    return owner, place, place > 0, hashes, contexts, before


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, order, gram, context, suffix, start, before, n) of all documents with a language, summed over the corpus.

    start: the n-gram begins at a word's first mark, so nothing ever comes before it.
    """

    def work(batches):
        held: dict[str, Counter] = {}

        def counted(lang, items):
            owner, place, keep, hashes, contexts, before = ngrams([w for w, _ in items])
            n = np.fromiter((c for _, c in items), dtype=np.int64, count=len(items))[owner]
            for k in range(1, ORDER + 1):
                usable = keep & (place >= k - 1)
                grams, first, back = np.unique(hashes[k][usable], return_index=True, return_inverse=True)
                suffix = hashes[k - 1][usable][first] if k > 1 else np.zeros(len(grams), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(grams), pa.string()),
                        pa.array(np.full(len(grams), k, dtype=np.int32)),
                        *(pa.array(x.astype(np.int64)) for x in (grams, contexts[k][usable][first], suffix)),
                        pa.array(place[usable][first] == k - 1),
                        pa.array(before[usable][first]),
                        pa.array(np.bincount(back, n[usable]).astype(np.int64)),
                    ],
                    names=["lang", "order", "gram", "context", "suffix", "start", "before", "n"],
                )

        def flushed():
            for lang, pieces in held.items():
                words: Counter = Counter()
                for piece, n in pieces.items():
                    for w in words_of(piece):
                        words[w] += n
                items = list(words.items())
                for k in range(0, len(items), AT_ONCE):
                    yield from counted(lang, items[k : k + AT_ONCE])
            held.clear()

        for batch in slices_by_bytes(batches, "text", 4 << 20):
            owner, code, distinct = words_in(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            names, of = np.unique(langs.astype(str), return_inverse=True)
            for k, name in enumerate(names.tolist()):
                at, times = np.unique(code[of[owner] == k], return_counts=True)
                held.setdefault(name, Counter()).update(dict(zip(map(distinct.__getitem__, at.tolist()), times.tolist())))
            if sum(map(len, held.values())) > FLUSH_WORDS:
                yield from flushed()
        yield from flushed()

    found = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    found = found.mapInArrow(released(work), "lang string, order int, gram long, context long, suffix long, start boolean, before int, n long")
    return found.groupBy("lang", "order", "gram").agg(*(F.first(c).alias(c) for c in ("context", "suffix", "start", "before")), F.sum("n").alias("n"))


def smoothed(counts: DataFrame, letters: int) -> DataFrame:
    """Interpolated Kneser-Ney over :func:`ngram_counts`: (lang, order, gram, context, suffix, before, p, back).

    Below the highest order an n-gram counts the different characters that come
    before it (one that starts a word has none and keeps its count). The discount is
    ones / (ones + 2 twos) of the language and order; 1/2 where either is 0, as in
    tables too small to tell. p is what is left of the share in the context plus the
    context's back-off weight times the suffix's p, down to 1 / letters.
    """
    key = ["lang", "order", "gram"]
    above = counts.where("order > 1").groupBy("lang", (F.col("order") - 1).alias("order"), F.col("suffix").alias("gram")).agg(F.count("*").alias("_left"))
    adjusted = counts.join(above, key, "left").withColumn("n", F.when((F.col("order") == ORDER) | F.col("start"), F.col("n")).otherwise(F.coalesce("_left", F.lit(0)))).drop("_left", "start")
    ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    discounts = adjusted.groupBy("lang", "order").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("_d"))
    places = adjusted.groupBy("lang", "order", "context").agg(F.sum("n").alias("_total"), F.count_if(F.col("n") > 0).alias("_kinds"))
    places = places.join(discounts, ["lang", "order"]).withColumn("back", F.col("_d") * F.col("_kinds") / F.col("_total"))
    rows = stored(adjusted.join(places, ["lang", "order", "context"]).withColumn("own", F.greatest(F.col("n") - F.col("_d"), F.lit(0.0)) / F.col("_total")).drop("_d", "_kinds", "_total", "n"))
    columns = ("lang", "order", "gram", "context", "suffix", "before", "p", "back")
    level = rows.where("order = 1").withColumn("p", F.col("own") + F.col("back") / F.lit(float(letters))).select(*columns)
    levels = [level]
    for k in range(2, ORDER + 1):
        lower = level.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("_below"))
        level = rows.where(F.col("order") == k).join(lower, ["lang", "suffix"], "left")
        level = level.withColumn("p", F.col("own") + F.col("back") * F.coalesce("_below", F.lit(1.0 / letters))).select(*columns)
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


class Shard:
    """Sorted hash arrays with one column per language, for characters after the classes from ``low`` up to ``high``."""

    def __init__(self, rows: pd.DataFrame, languages: list[str], low: int, high: int, letters: int):
        self.languages, self.low, self.high = languages, low, high
        self.grams, self.logp, self.contexts, self.logb = {}, {}, {}, {}
        self.floor = -np.log(letters)
        width, column = len(languages), {l: k for k, l in enumerate(languages)}
        lower = None
        for k in range(1, ORDER + 1):
            part = rows[rows["order"] == k]
            lang = part["lang"].map(column).to_numpy(dtype=np.int64)
            gram, context = (part[c].to_numpy(dtype=np.int64).astype(np.uint64) for c in ("gram", "context"))
            grams, first, at = np.unique(gram, return_index=True, return_inverse=True)
            contexts, place = np.unique(context, return_inverse=True)
            back = np.ones((len(contexts), width))
            back[place, lang] = part["back"].to_numpy()
            if lower is None:
                below = np.full((len(grams), width), 1.0 / letters)
            else:
                suffix = part["suffix"].to_numpy(dtype=np.int64).astype(np.uint64)[first]
                where = np.minimum(np.searchsorted(self.grams[k - 1], suffix), len(lower) - 1)
                below = np.where((self.grams[k - 1][where] == suffix)[:, None], lower[where], 1.0 / letters)
            lower = back[place[first]] * below  # what a language has that never met the n-gram
            lower[at, lang] = part["p"].to_numpy()
            self.grams[k], self.contexts[k] = grams, contexts
            self.logp[k], self.logb[k] = np.log(lower), np.log(back)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[word, language]: the log probability of the word's letters and its end, as far as they are this shard's; and their number."""
        owner, place, keep, hashes, contexts, before = ngrams(words)
        todo = np.flatnonzero(keep & (before >= self.low) & (before < self.high))
        chars = np.bincount(owner[todo], minlength=len(words))
        out = np.zeros((len(words), len(self.languages)))
        for k in range(ORDER, 0, -1):
            able = place[todo] >= k - 1
            rows, grams = todo[able], self.grams[k]
            if not len(rows) or not len(grams):
                continue
            asked = hashes[k][rows]
            at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
            hit = grams[at] == asked
            missed = rows[~hit]
            gained = [(rows[hit], self.logp[k][at[hit]])]
            near = contexts[k][missed]
            at = np.minimum(np.searchsorted(self.contexts[k], near), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == near
            gained.append((missed[known], self.logb[k][at[known]]))
            for where, value in gained:
                for l in range(out.shape[1]):
                    out[:, l] += np.bincount(owner[where], value[:, l], len(words))
            todo = np.r_[missed, todo[~able]]
        return out + (np.bincount(owner[todo], minlength=len(words)) * self.floor)[:, None], chars


class Model:
    """Smoothed n-grams of all languages on shared storage, and how they are dealt into shards."""

    def __init__(self, table: DataFrame, letters: int, shard_rows: int = SHARD_ROWS, shard_languages: int = SHARD_LANGUAGES):
        self.table, self.letters = table, letters
        sizes: dict[str, np.ndarray] = {}
        for r in table.groupBy("lang", F.when(F.col("order") > 1, F.col("before")).alias("before")).count().collect():
            row = sizes.setdefault(r["lang"], np.zeros(CLASSES, dtype=np.int64))
            if r["before"] is not None:
                row[r["before"]] += r["count"]
        self.languages = sorted(sizes)
        self.plan: list[tuple[list[str], int, int]] = []
        for k in range(0, len(self.languages), shard_languages):
            group = self.languages[k : k + shard_languages]
            total, low, held = sum(sizes[l] for l in group), 0, 0
            for c in range(CLASSES):
                if held and held + total[c] > shard_rows:
                    self.plan.append((group, low, c))
                    low, held = c, 0
                held += total[c]
            self.plan.append((group, low, CLASSES))

    def shards(self) -> Iterator[Shard]:
        """One after the other; the driver holds one at a time."""
        for group, low, high in self.plan:
            mine = F.col("lang").isin(group) & ((F.col("order") == 1) | ((F.col("before") >= low) & (F.col("before") < high)))
            yield Shard(self.table.where(mine).toPandas(), group, low, high, self.letters)


def train(docs: DataFrame, folds: int = 3, held_out: int = 1, shard_rows: int = SHARD_ROWS, shard_languages: int = SHARD_LANGUAGES) -> Model | None:
    """Count the n-grams of every learnable document and smooth them; None if there is no language to learn."""
    counts = stored(ngram_counts(docs.where((fold("doc_id", folds) != held_out)).select("lang", "text")))
    letters = counts.where("order = 1").select("gram").distinct().count() + 1
    if letters == 1:
        return None
    table = stored_alone(lambda: smoothed(counts, letters))
    discard(counts)
    return Model(table, letters, shard_rows, shard_languages)


class Scorer:
    """Scores texts in a worker; the pieces it has met lately are kept, a bounded number of them."""

    def __init__(self, shard: Shard, memo: int = 200_000):
        self.shard, self.memo = shard, memo
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(shard.languages) + 1))

    def learn(self, pieces: list[str]) -> None:
        """Make rows for pieces of text: the sum over their words, and the number of characters scored."""
        words = [words_of(p) for p in pieces]
        flat = [w for ws in words for w in ws]
        owner = np.repeat(np.arange(len(pieces)), [len(ws) for ws in words])
        new = np.zeros((len(pieces), self.table.shape[1]))
        if flat:
            scores, chars = self.shard.word_scores(flat)
            for l in range(scores.shape[1]):
                new[:, l] = np.bincount(owner, scores[:, l], len(pieces))
            new[:, -1] = np.bincount(owner, chars, len(pieces))
        self.rows.update(zip(pieces, range(len(self.table), len(self.table) + len(pieces))))
        self.table = np.concatenate([self.table, new])

    def sums(self, texts: pa.Array) -> np.ndarray:
        """[text, language]: summed log probabilities; last column: characters."""
        owner, code, distinct = words_in(texts)
        if len(self.rows) > self.memo:
            self.rows, self.table = {}, self.table[:0]
        fresh = [p for p in distinct if p not in self.rows]
        for k in range(0, len(fresh), AT_ONCE // 2):
            self.learn(fresh[k : k + AT_ONCE // 2])
        at = np.fromiter(map(self.rows.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        return sums_by_owner(owner, at[code] if len(code) else code, self.table, len(texts))


def _verdicts(sums: np.ndarray, chars: np.ndarray, languages: list[str]) -> list[pa.Array]:
    """lang_pred, score, entropy, chars from summed log probabilities."""
    if not languages:
        names = np.full(len(chars), UNDETERMINED, dtype=object)
        return [pa.array(names, pa.string()), pa.array(np.zeros(len(chars))), pa.nulls(len(chars), pa.float64()), pa.array(chars.astype(np.int64))]
    some = chars > 0
    rates = sums / np.maximum(chars, 1)[:, None]
    best = rates.argmax(axis=1)
    top = rates[np.arange(len(rates)), best]
    shares = 1 / np.exp((rates - top[:, None]) * np.minimum(chars, 64.0)[:, None]).sum(axis=1)
    names = np.where(some, np.array(languages, dtype=object)[best], UNDETERMINED)
    return [pa.array(names.tolist(), pa.string()), pa.array(np.where(some, shares, 0.0)), pa.array(-top, mask=~some), pa.array(chars.astype(np.int64))]


def scored(docs: DataFrame, model: Model | None, folds: int = 3, held_out: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, chars of every whole text, and the columns ``keep``.

    lang_pred is the language of the least cross-entropy per character; ``und`` (score
    0) if the text is null or has no letter, or if there was no language to learn.
    score: the share of that language when the likelihoods of a text of at most 64
    characters at the same rates are weighed against each other. entropy: nats per
    character under the chosen model, null for ``und``. chars: characters scored, word
    ends included. Ties go to the language that comes first by name. Null ids and
    repeated rows are kept; an empty table gives an empty result.

    With one shard this is one narrow pass. With more, each shard is broadcast for a
    pass of its own that leaves sums by row, and the rows' sums meet at the end.
    """
    keep = list(keep)
    source = docs.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "text", *(c for c in keep if c != "text"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    fixed = f"doc_id {kinds['doc_id']}, held_out boolean, lang_pred string, score double, entropy double, chars long" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    names = ["doc_id", "held_out", "lang_pred", "score", "entropy", "chars", *keep]
    spread = docs.sparkSession.sparkContext.broadcast
    if model is None or len(model.plan) == 1:
        shared = spread(next(model.shards()) if model else None)

        def work(batches):
            shard = shared.value
            scorer = Scorer(shard) if shard else None
            for batch in slices_by_bytes(batches, "text", 2 << 20):
                sums = scorer.sums(batch.column("text")) if scorer else np.zeros((batch.num_rows, 1))
                verdicts = _verdicts(sums[:, :-1], sums[:, -1], shard.languages if shard else [])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *verdicts, *map(batch.column, keep)], names=names)

        return source.mapInArrow(released(work), fixed)

    # the numbers of the rows are written with them, as they depend on how rows are dealt
    rows = stored(source.withColumn("_row", F.monotonically_increasing_id()))
    languages, parts = model.languages, []
    for k, shard in enumerate(model.shards()):
        shared = spread(shard)

        def partial(batches, shared=shared):
            scorer = Scorer(shared.value)
            for batch in slices_by_bytes(batches, "text", 2 << 20):
                sums = scorer.sums(batch.column("text"))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), lists], names=["_row", "sums"])

        parts.append(stored(rows.select("_row", "text").mapInArrow(released(partial), "_row long, sums array<double>").withColumn("shard", F.lit(k))))
        shared.destroy()
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    first = {l: k for k, l in enumerate(languages)}
    layout = [(first[group[0]], len(group)) for group, _, _ in model.plan]

    def joined(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, len(languages)))
            chars = np.zeros(batch.num_rows)
            for r, shards in enumerate(batch.column("found").to_pylist()):
                for found in shards:
                    at, width = layout[found["shard"]]
                    out[r, at : at + width] += found["sums"][:-1]
                    chars[r] += found["sums"][-1] if at == 0 else 0
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *_verdicts(out, chars, languages)], names=["_row", *names[2:6]])

    by_row = both.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("shard", "sums"))).alias("found"))
    verdicts = by_row.mapInArrow(released(joined), "_row long, lang_pred string, score double, entropy double, chars long")
    return rows.join(verdicts, "_row").select(*names)


def with_rejection(found: DataFrame, share: float = 0.99, margin: float = 0.25) -> DataFrame:
    """Add ``rejected``: no language, or an entropy beyond what texts known to be in the language have.

    found: as from :func:`language_id`, with ``lang`` and ``chars``. Calibration: for
    each language the quantile ``share`` over the learnable documents that are known to
    be in it and were told as it, so that neither held-out rows nor what is to be
    rejected has a say. An entropy counts less twice its rough standard error, as those
    of short texts scatter. A language that was told for none of its own documents
    takes the widest limit of the others; without any limit only ``und`` is rejected.
    """
    excess = F.col("entropy") - 2 / F.sqrt("chars")
    known = found.where(~F.col("held_out") & F.col("entropy").isNotNull() & (F.col("lang") == F.col("lang_pred")))
    limits = known.groupBy(F.col("lang").alias("_lang")).agg((F.percentile_approx(excess, share, 10_000) + margin).alias("_limit"))
    widest, n = limits.agg(F.max("_limit"), F.count("*")).first()
    if n <= BROADCAST_ROWS:  # else Spark joins by language and splits what is large
        limits = F.broadcast(limits)
    return (
        found.join(limits, F.col("lang_pred") == F.col("_lang"), "left")
        .withColumn("rejected", F.col("entropy").isNull() | (excess > F.coalesce("_limit", F.lit(float("inf") if widest is None else widest))))
        .drop("_lang", "_limit")
    )


def language_id(docs: DataFrame, keep: Sequence[str] = ("lang",), **shards: int) -> DataFrame:
    """Train on the learnable documents, predict every document, and tell what to reject.

    Columns as from :func:`scored`, and ``rejected``; nulls, empty texts, ties, repeated
    rows and empty tables as told there. ``lang`` (null: nothing to learn from) is read
    for learning and calibration only. Columns of docs that are not in ``keep`` are not
    read. shards: shard_rows, shard_languages, as for :func:`train`.
    """
    asked = list(dict.fromkeys(["lang", *keep]))
    found = stored_alone(lambda: scored(docs, train(docs, **shards), keep=asked))
    names = ["doc_id", "held_out", "lang_pred", "score", "entropy", "chars", *keep, "rejected"]
    return with_rejection(found).select(*names)
