"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridweave.llm import chat_format, exact_topk, fingerprints, jaccard_join, language_id, packing, quality, source_mix, token_counts, toxicity

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size long, score double, bin long, path long, id string, rate double, target double, copies long, positive boolean, block int, features string"
LONG = " ".join(random.Random(4).choice(["alpha", "beta", "gamma", "delta", "omega."]) + str(k % 97) for k in range(60_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", None),
    (4, "one two three four five six seven", "en", "b"),
    (4, "one two three four five six seven", "en", "b"),
    (None, "no id here at all today", "en", "b"),
    (5, "1234 !!! ...", None, "c"),
    (6, LONG, "en", "c"),
    (7, "kurz", "de", "c"),
    (4, "another text under an id that is taken", "de", "c"),
    (8, "  \n ", "de", "c"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *[None] * 12) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (6, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x or 0))


EXPECTED = ids([{"doc_id": r[0]} for r in ROWS])


def test_fingerprints(docs, none):
    rows = fingerprints.edited_neighbours(docs).collect()
    assert ids(rows) == EXPECTED
    by_text = {}
    hashed = {r["text"] or "": r["h"] for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(((r[0] is None, r[0] or 0, hashed[r[1] or ""], r[1] or "", r[0]) for r in ROWS))
    for k, (_, _, _, text, doc) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        q = len(text) // 4
        sha = hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()
        assert any(r["doc_id"] == doc and r["n_chars"] == len(text) and r["edited_sha256"] == sha for r in rows)
    for r in rows:
        by_text.setdefault((r["n_chars"], r["fingerprint"]), r)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.edited_neighbours(none).count() == 0


def test_token_counts(docs, none):
    rows = token_counts.token_counts(docs, WORD).collect()
    assert ids(rows) == EXPECTED
    assert all(r["n_tokens"] == 0 and not r["over_limit"] for r in rows if r["doc_id"] in (2, 3, 8))
    assert next(r for r in rows if r["doc_id"] == 6)["n_bytes"] == len(LONG)
    assert token_counts.token_counts(none, WORD).count() == 0


def test_jaccard_join(docs, none):
    rows = jaccard_join.jaccard_join(docs).collect()
    assert ids(rows) == EXPECTED
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert found[1] == [(1, 2)] and sorted(found[4]) == [(1, 2), (1, 2), (4, 0)]
    assert found[2] == found[3] == found[8] == [(2, 2)]  # blank texts are the empty set
    assert found[None] == [(None, 0)]
    assert jaccard_join.jaccard_join(none).count() == 0


def test_toxicity(docs, none, labels):
    rows = toxicity.toxicity(docs, labels).collect()
    assert ids(rows) == EXPECTED and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(ROWS)


def test_quality(docs, none, labels):
    rows = quality.quality(docs, labels).collect()
    assert ids(rows) == EXPECTED and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.quality(none, labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).count() == len(ROWS)


def test_language(docs, none):
    rows = language_id.language_id(docs).collect()
    assert ids(rows) == EXPECTED
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 5, 8))
    assert language_id.language_id(none).count() == 0
    no_lang = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.language_id(no_lang).collect()} == {"und"}


def test_mix(docs, none):
    rows = source_mix.mix(docs).collect()
    assert ids(rows) == EXPECTED
    assert all(r["size"] == len((r["text"] or "").split()) for r in rows)
    assert len({r["copies"] for r in rows if r["doc_id"] == 4 and r["source"] == "b"}) == 1
    assert source_mix.mix(none).count() == 0 and source_mix.emit(source_mix.mix(none)).count() == 0
    assert source_mix.emit(source_mix.mix(docs)).count() == sum(r["copies"] for r in rows)


def test_packing(docs, none):
    rows = packing.pack(docs, BYTE).collect()
    assert len([r for r in rows if r["piece"] == 0]) == len(ROWS)
    assert all(r["length"] == 1 for r in rows if r["doc_id"] in (2, 3))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, BYTE).count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, [0.5, 1.0]), (3, [1.0, 0.5]), (4, [1.0, 0.5]), (5, None), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (3, [1.0, 0.5])]
    table = spark.createDataFrame([(i, v, 1, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, id int, rank int, i int")
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.exact_top_k(table).orderBy("query_id", "rank").collect()]
    one, two = [64, 32], [32, 64]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert [f[2:] for f in found if f[0] == 0] == [(3, dot(one, one)), (3, dot(one, one)), (4, dot(one, one)), (9, 64 * 64), (20, dot(one, two))]
    assert [f[2] for f in found if f[0] == 20] == [0, 3, 3, 4, 9]
    assert exact_topk.exact_top_k(table.limit(0)).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "Hi?"), (1, 1, "assistant", "Hello.\nHow can I help?"), (1, 2, "user", None), (None, 0, "user", ""), (2, 0, None, "Assistant: so"), (2, 0, None, "Assistant: so"), (3, None, "system", "System: Be kind."), (3, 700, "user", "far")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, block int, role_pred string")
    found = chat_format.format_conversations(table).collect()
    assert len(found) == len(rows)
    assert sorted(r["role_pred"] for r in found if r["conv_id"] == 3 and r["turn"] is None) == ["system"]
    long = spark.createDataFrame([(1, 0, None, "a line of text\n" * 60_000)], "conv_id long, turn long, role string, text string")
    assert [len(r["rendered"]) > 800_000 for r in chat_format.format_conversations(long).collect()] == [True]
    assert chat_format.format_conversations(table.limit(0)).count() == 0
