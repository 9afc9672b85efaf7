"""The stages, one by one, against what their operators and plain code say."""

import collections
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gridweave.llm import language_id, toxicity
from gridweave.session import stored

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"  # the smallest data has too few toxic examples to learn a word from


def test_stages(spark):
    from tests.llm.test_brute import brute_classes

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, DATA))
        seen[name] = docs.toPandas()
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.toxicity(before, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
            assert set(seen[name]["doc_id"]) == {r["doc_id"] for r in before.collect()} - bad
        if name == "language_id":
            bad = {r["doc_id"] for r in language_id.language_id(before).where("rejected").collect()}
            assert set(seen[name]["doc_id"]) == {r["doc_id"] for r in before.collect()} - bad and len(bad) < 10
        if name == "ngram_jaccard_join":
            classes = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])
            assert set(seen[name]["doc_id"]) == {c for c, _ in classes.values()}
        if name == "source_mix":
            times = collections.Counter(seen[name]["doc_id"])
            assert set(times) <= {r["doc_id"] for r in before.collect()} and max(times.values()) <= 2
        if name != "best_fit_packing":
            assert list(docs.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    packed, mixed = seen["best_fit_packing"], seen["source_mix"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packed["length"].sum() == sum(len(library.encode(t, add_special_tokens=False)) + 1 for t in mixed["text"])


def test_one_row_of_repeated_ids_stays(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, "x y z u v w", "en", "s", 11), (None, "q", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, DATA).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept if r["doc_id"]) == [(False, 1), (False, 3)] and len(kept) == 3


def test_foreign_documents_go_though_they_are_many(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    foreign = [(100_000 + k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(rng.randint(10, 120))), None, "s", 0) for k in range(100)]
    both = docs.unionByName(spark.createDataFrame(foreign, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_foreign(spark, both, DATA).collect()}
    own = {r["doc_id"] for r in docs.collect()}
    assert not any(k >= 100_000 for k in kept)
    assert len(own - kept) < 10


def test_rows_are_judged_not_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    verdicts = toxicity.toxicity(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect()
    toxic = max(verdicts, key=lambda r: r["score"])["text"]
    clean = min(verdicts, key=lambda r: r["score"])["text"]
    more = spark.createDataFrame([(None, toxic, "en", "x", 0), (900_001, toxic, "en", "x", 0), (900_001, clean, "en", "x", 0), (None, clean, "en", "x", 0)], schema)
    kept = corpus_pipeline.drop_toxic(spark, docs.unionByName(more), SMALL).where("source = 'x'").collect()
    assert sorted((r["doc_id"] or 0, r["text"] == clean) for r in kept) == [(0, True), (900_001, True)]
    more = spark.createDataFrame([(None, "12 34", "en", "x", 0), (900_001, "56 78", "en", "x", 0), (900_001, clean, "en", "x", 0)], schema)
    kept = corpus_pipeline.drop_foreign(spark, docs.unionByName(more), SMALL).where("source = 'x'").collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(900_001, clean)]


def test_every_class_keeps_a_row_whatever_its_ids(spark):
    a, b, c, d = "a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"
    # 7 leads the class of a and holds a copy of 3's text; 9 leads two classes; d has no id at all
    rows = [(7, a), (8, a), (3, b), (7, b), (9, c), (9, "y z y z y y"), (None, c), (None, d), (None, d)]
    docs = spark.createDataFrame([(k, t, "en", "s", 11) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, docs, DATA).collect())
    assert kept == sorted([(7, a), (3, b), (9, c), (9, "y z y z y y"), (0, d)])


def test_stages_on_odd_tables(spark):
    """The edge fixture (nulls, empty and long texts, repeated ids) and an empty table go through every stage."""
    from tests.llm.test_edges import ROWS

    docs = spark.createDataFrame([(*r, None, "clash") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, stored(stage(spark, now, DATA))
            if name == "toxicity":
                assert now.count() == start.count()
            if name == "language_id":
                assert {r["doc_id"] for r in now.collect()} <= {1, 4, 6, 7, None}
            if name != "best_fit_packing":
                assert now.columns == corpus_pipeline.COLUMNS
        assert (now.count() > 0) == (start.count() > 0)
