"""Kneser-Ney models against a plain version with dictionaries, shards against one shard, rejection, accuracy."""

import collections
import math
import zlib

import pytest

from gridweave.llm import language_id, queries

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
ORDER = language_id.ORDER


class Plain:
    """Interpolated Kneser-Ney of one language, from the definition."""

    def __init__(self, texts, letters):
        self.letters = letters
        raw = [collections.Counter() for _ in range(ORDER + 1)]
        for text in texts:
            for word in language_id.words_of(text):
                marked = " " + word + " "
                for end in range(1, len(marked)):
                    for k in range(1, ORDER + 1):
                        if end - k + 1 >= 0:
                            raw[k][marked[end - k + 1 : end + 1]] += 1
        self.n = [None] * (ORDER + 1)
        for k in range(1, ORDER + 1):
            # only n-grams of two or more characters can begin at the first mark: the mark alone is never predicted there
            left = collections.Counter(g[1:] for g in raw[k + 1]) if k < ORDER else None
            self.n[k] = {g: c if k == ORDER or (k > 1 and g[0] == " ") else left[g] for g, c in raw[k].items()}
        self.d = [0.0]
        for k in range(1, ORDER + 1):
            ones, twos = (sum(c == m for c in self.n[k].values()) for m in (1, 2))
            self.d.append(ones / (ones + 2 * twos) if ones and twos else 0.5)

    def p(self, context, c):
        """Of the character c after up to ORDER - 1 characters."""
        k = len(context) + 1
        below = self.p(context[1:], c) if context else 1 / self.letters
        inside = [n for g, n in self.n[k].items() if g[:-1] == context]
        if not inside:
            return below
        return max(self.n[k].get(context + c, 0) - self.d[k], 0) / sum(inside) + self.d[k] * sum(n > 0 for n in inside) / sum(inside) * below

    def word(self, word):
        marked = " " + word + " "
        return sum(math.log(self.p(marked[max(0, j - ORDER + 1) : j], marked[j])) for j in range(1, len(marked)))


TEXTS = {
    "en": ["the cat sat on the mat the cat", "a cat and a dog, The dog sat!", "then there they go; dogs dog dot"],
    "de": ["die katze saß auf der matte", "ein hund und eine katze und der hund", "Straße über Öl"],
    "zz": ["zzz zyx", "日本語 日本"],
}
WORDS = ["cat", "the", "dog", "dogmatic", "hund", "und", "straße", "qqq", "日本人", "x", "thethethe"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, lang, t) for lang, texts in TEXTS.items() for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def learned(docs, **shards):
    return language_id.train(docs, folds=7, held_out=9, **shards)


def test_models_are_kneser_ney(docs):
    model = learned(docs)
    (shard,) = model.shards()
    letters = len({c for texts in TEXTS.values() for t in texts for w in language_id.words_of(t) for c in w} | {" "}) + 1
    assert model.letters == letters and shard.languages == sorted(TEXTS)
    plain = {lang: Plain(texts, letters) for lang, texts in TEXTS.items()}
    found, chars = shard.word_scores(WORDS)
    for row, n, word in zip(found, chars, WORDS):
        assert n == len(word) + 1
        for value, lang in zip(row, shard.languages):
            assert value == pytest.approx(plain[lang].word(word), abs=1e-6)
    everything = {c for texts in TEXTS.values() for t in texts for w in language_id.words_of(t) for c in w} | {" "}
    for lang, model_ in plain.items():
        for context in ("", "t", "the", " ca", "dog", "日本"):
            seen = sum(model_.p(context, c) for c in everything)
            unseen = model_.p(context, "\0")
            assert seen + unseen * (letters - len(everything)) == pytest.approx(1, abs=1e-9)


def test_shards_add_up(spark, docs):
    texts = docs.unionByName(spark.createDataFrame([(50, None, "Der Hund und the cat"), (51, None, "123"), (None, None, None)], docs.schema))
    one, many = learned(docs), learned(docs, shard_rows=40, shard_languages=2)
    assert len(one.plan) == 1 and len(many.plan) > 4
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["lang_pred"], r["chars"])
    a, b = (sorted(language_id.scored(texts, m, keep=["text"]).collect(), key=key) for m in (one, many))
    assert len(a) == len(b) == texts.count()
    for x, y in zip(a, b):
        assert (x["doc_id"], x["lang_pred"], x["chars"], x["text"]) == (y["doc_id"], y["lang_pred"], y["chars"], y["text"])
        assert x["score"] == pytest.approx(y["score"], abs=1e-9) and (x["entropy"] or 0) == pytest.approx(y["entropy"] or 0, abs=1e-9)


def test_many_languages_are_all_learned(spark):
    """More languages than one group of columns holds, the smallest of one word."""
    rows = [(k * 3, f"l{k:03d}", f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} {chr(0x4E00 + k)}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    truth = {i: lang for i, lang, _ in rows}
    found = language_id.scored(docs, learned(docs)).collect()
    assert len(found) == 90 and all(r["lang_pred"] == truth[r["doc_id"]] for r in found)


def test_languages_are_told(spark):
    rows = queries.op9_language_id(spark, SMALL).toPandas()
    both = rows.merge(spark.read.parquet(f"{SMALL}/documents.parquet").toPandas(), on="doc_id")
    test = both[both["held_out"]]
    assert (test["lang_pred"] == test["lang"]).mean() > 0.97
    assert rows["rejected"].mean() < 0.05 and rows[rows["lang_pred"] == "und"]["rejected"].all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(rows["doc_id"], rows["held_out"]))
