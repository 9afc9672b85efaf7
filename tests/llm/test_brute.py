"""Operators against plain versions on small fixtures and on the smallest data."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridweave.llm import chat_format, exact_topk, fingerprints, jaccard_join, packing, queries, source_mix, tokenizer, toxicity

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas()


def odd_texts(n=1500):
    rng = random.Random(1)
    parts = [*"ab cd  \n\t.,'s|<>123ÀéßΣσ́　\xa0\x1c\x85漢字🙂", "<|endoftext|>", "<|startoftext|>", " 's", "'ll", "   ", "İ", "\r\n", "don't"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_tokenizers_agree_with_the_library(documents):
    byte, word = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    b, w = tokenizer.ByteLevelBpe(byte), tokenizer.WordBpe(word)
    lib_b, lib_w = Tokenizer.from_file(byte), Tokenizer.from_file(word)
    for t in [*odd_texts(), *documents["text"].tolist()[:60]]:
        assert np.frombuffer(b.ids(t), dtype="<u4").tolist() == lib_b.encode(t, add_special_tokens=False).ids
    texts = [*odd_texts(), *documents["text"].tolist()[:60], None, "", "two  words " * 400_000]
    assert w.counts(pa.array(texts)).tolist() == [len(lib_w.encode(t or "", add_special_tokens=False)) for t in texts]


def test_long_texts_are_cut_at_safe_places():
    text = ("word, " * 40 + "\n\n  <x>  ") * 30
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = lib.encode(text, add_special_tokens=False).ids
    cut = [i for p in tokenizer.parts(text, tokenizer._PIECE, 50) for i in lib.encode(p, add_special_tokens=False).ids]
    assert whole == cut and "".join(tokenizer.parts(text, tokenizer._PIECE, 50)) == text


def test_token_counts_and_packing(spark, documents):
    by_id = dict(zip(documents["doc_id"], documents["text"]))
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for r in queries.op2_token_counts(spark, DATA).collect():
        assert r["n_tokens"] == len(word.encode(by_id[r["doc_id"]], add_special_tokens=False)) and r["over_limit"] == (r["n_tokens"] > 2048)
    rows = queries.op8_packing(spark, DATA).toPandas()
    for doc, part in rows.groupby("doc_id"):
        ids = np.array([*byte.encode(by_id[doc], add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in part.sort_values("piece").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 2048 or r.piece == 0
            at += r.length
        assert at == len(ids)
    assert rows["sequence_id"].nunique() <= packing.best_fit(rows["length"].to_numpy())[0].max() + 3


def test_best_fit_merge_rounds(spark, monkeypatch):
    rng = np.random.RandomState(2)
    sizes = rng.randint(1, 2049, 3000)
    bins, offsets = packing.best_fit(sizes)
    fill = np.zeros(bins.max() + 1, dtype=int)
    for size, b, o in sorted(zip(sizes, bins, offsets), key=lambda x: (x[1], x[2])):
        assert fill[b] == o
        fill[b] += size
    assert fill.max() <= 2048


def naive_walk(text, seed=7):
    """(times, classes): one character at a time."""
    dwell, t, out = fingerprints._dwell(seed), 0, []
    for c in fingerprints._classes(text):
        out.append((t, int(c)))
        t += int(dwell[int(c) * fingerprints.PERIOD + t % fingerprints.PERIOD])
    return out, t


def test_fingerprints_follow_the_walk():
    texts = ["", "a", "hello world " * 30, "ünïcödé 🙂" * 7, "hello world " * 30]
    found = fingerprints.fingerprints(texts)
    assert found[2] == found[4]
    for text, f in zip(texts, found):
        steps, end = naive_walk(text)
        scale = int(f[:2], 16)
        asked = np.concatenate([fingerprints._times(7, o)[:n] for o, n in fingerprints._layout(scale)]) if scale else []
        for at, symbol in zip(asked, f[2:]):
            want = fingerprints.PAD if at >= end else fingerprints.ALPHABET[[c for t, c in steps if t <= at][-1] % len(fingerprints.ALPHABET)]
            assert symbol == want


def test_fingerprints_rank_edits():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = " ".join(rng.choice(words) for _ in range(300))
    other = " ".join(rng.choice(words) for _ in range(300))
    slightly = text[:500] + "XY" + text[500:]
    f = fingerprints.fingerprints([text, slightly, other])
    assert fingerprints.likeness(f[0], f[0]) == 1
    assert fingerprints.likeness(f[0], f[1]) > 0.7 > 0.4 > fingerprints.likeness(f[0], f[2])
    a, b, c = (set(fingerprints.band_keys(x)) for x in f)
    assert a & b and not a & c


def test_likenesses_are_those_of_pairs(documents):
    found = fingerprints.fingerprints(["", "a", "a", "ab", *documents["text"].tolist()[:40]])
    table = fingerprints.likenesses(found, found[::2])
    assert table == pytest.approx(np.array([[fingerprints.likeness(a, b) for b in found[::2]] for a in found]))


@pytest.mark.parametrize(("block", "small"), [(400, 256), (5, 3)])
def test_near_documents_against_all_pairs(spark, block, small):
    rng = random.Random(8)
    texts = [None, "", "", "x", "xy"]
    for g in range(8):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([120, 500, 1000, 3000])))
        texts.append(base)
        for _ in range(rng.randint(2, 9)):
            chars = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                chars[rng.randrange(len(chars))] = rng.choice(["", "zz", "q"])
            texts.append("".join(chars))
    table = spark.createDataFrame([*enumerate(texts), (None, "x"), (3, "x")], "doc_id long, text string")
    fingers = fingerprints.fingerprint_table(table)
    found = fingers.collect()
    rows = [(r["doc_id"], r["fingerprint"]) for r in found if r["doc_id"] is not None]
    alike = [[i != j and fingerprints.likeness(a, b) >= fingerprints.NEAR for j, (_, b) in enumerate(rows)] for i, (_, a) in enumerate(rows)]
    label = [i for i, _ in rows]
    while True:
        after = [min([label[k], *(label[j] for j, x in enumerate(alike[k]) if x)]) for k in range(len(rows))]
        if after == label:
            break
        label = after
    want = sorted((i, c, sum(a)) for (i, _), c, a in zip(rows, label, alike))
    got = sorted((r["doc_id"], r["class_id"], r["n_near"]) for r in fingerprints.near_classes(fingers, block=block, small=small).collect() if r["doc_id"] is not None)
    assert got == want and max(n for _, _, n in got) > 1
    assert fingerprints.near_documents(table.limit(0)).count() == 0


def brute_classes(texts, threshold=0.8):
    sets = []
    for _, t in texts:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(texts)
    links, label = [0] * n, list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            whole = len(sets[i] | sets[j])
            if sets[i] == sets[j] or common >= threshold * whole:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), 10**18), texts[i][0])
    return {texts[i][0]: (least[root(i)], links[i]) for i in range(n)}


def family(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("small", "most"), [(256, 500_000), (8, 500_000), (4, 0)])
def test_jaccard_join_against_all_pairs(spark, monkeypatch, small, most):
    """small=8 sends groups through all levels of paths; blocks of 12 sets split the clusters; most=0 deals hot paths over salts."""
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(30)]
    texts = []
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(150)]
        texts += [family(rng, base, rng.choice([0, 1, 2, 3, 5, 9])) for _ in range(14)]
    texts += [" ".join([*passage, *(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(3, 80)))]) for _ in range(25)]
    texts += ["", None, "a b", "a b", "a b c d e"]
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 12)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", most)
    monkeypatch.setattr(jaccard_join.candidate_links, "__defaults__", (0.8, 0.999, 3, small))
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_classes(rows)


def test_overlaps():
    rng = np.random.RandomState(0)
    sets = [np.unique(rng.randint(0, 60, rng.randint(1, 40)).astype(np.uint64)) for _ in range(25)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert np.array_equal(jaccard_join.overlaps(sets), want)


def test_runs_reach_the_recall():
    runs = jaccard_join.runs_for(0.999)
    assert 1 - (1 - 0.8**3) ** runs >= 0.999 > 1 - (1 - 0.8**3) ** (runs - 1)


def test_top_k_blocks(spark, monkeypatch):
    rng = np.random.RandomState(1)
    rows = [(int(k), rng.randn(24).round(2).tolist()) for k in range(300)] + [(k, [0.25] * 24) for k in range(300, 340)]
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(exact_topk, "CANDIDATE_BLOCK", 60)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in exact_topk.exact_top_k(table).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    v = np.floor(np.array([x for _, x in rows]) * 64).astype(np.int64)
    for q in range(0, 340, 20):
        scores = v @ v[q]
        assert found[q] == [(int(k), int(scores[k])) for k in sorted((k for k in range(340) if k != q), key=lambda k: (-scores[k], k))[:20]]


def reshared(sizes, weights, share=1.5, most=2.0):
    """Targets by doing what is asked: share by weight, cut at the limit, reshare the excess."""
    target, free, budget = {}, dict(weights), share * sum(sizes.values())
    while free:
        total = sum(free.values())
        over = [s for s in free if budget * free[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: budget * w / total for s, w in free.items()}
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
            del free[s]
    return target


@pytest.mark.parametrize("seed", range(6))
def test_mix_targets_against_resharing(spark, seed):
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(rng.randint(1, 9))] + [None]
    sizes = {n: rng.choice([0, 1, 5, 40, 1000, 30_000]) + rng.randrange(3) for n in names}
    table = spark.createDataFrame(list(sizes.items()), "source string, size long")
    weights = {n: (5.0, 2.0, 1.0)[k % 3] for k, n in enumerate([*sorted(n for n in names if n is not None), None])}
    want = reshared(sizes, weights)
    for r in source_mix.source_targets(table).collect():
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)


def test_mix_takes_what_the_targets_say(spark):
    rows = queries.op7_source_mix(spark, SMALL).toPandas()
    assert ((rows["taken"] >= 0) & (rows["taken"] <= 2 * rows["size"])).all()
    assert rows["taken"].sum() == pytest.approx(1.5 * rows["size"].sum(), rel=0.03)


def test_transcripts_with_markers():
    text = "System: Be brief.\nUser: What is a bus?\nAssistant: A node.\nIt joins lines.\n\nHuman: Thanks!\nAI: Sure."
    assert chat_format.parse_transcript(text) == [("system", "Be brief."), ("user", "What is a bus?"), ("assistant", "A node.\nIt joins lines."), ("user", "Thanks!"), ("assistant", "Sure.")]
    assert chat_format.parse_transcript("") == []
    assert chat_format.render("user", " a <|end|> b ").count("<|end|>") == 1


def test_viterbi_finds_the_best_of_all_paths():
    model = chat_format.Hmm()
    texts = ["Hi?", "Hello there.\n\nAnd more.\nUser: stop", "ok"]
    lines = [chat_format.lines_of(t, True) for t in texts]
    scores = np.concatenate([model.scores(own, True) for own in lines])
    n = scores.shape[1]
    value = lambda path: model.first[path[0]] + sum(scores[t, k] for t, k in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:]))
    best = max(itertools.product(range(n), repeat=len(scores)), key=value)
    found = chat_format.viterbi(scores, model.step, model.first)
    assert value(found) == pytest.approx(value(best)) and found.tolist() == list(best)
    # chunks joined by their matrices end in the same states
    cuts = [scores[:1], scores[1:4], scores[4:]]
    parts = [chat_format.through(c, model.step) for c in cuts]
    assert chat_format.ends(parts, model.step, model.first) == [(found[0], found[0]), (found[1], found[3]), (found[4], found[-1])]
    assert chat_format.chained(parts, model.step) == pytest.approx(chat_format.through(scores, model.step))


@pytest.mark.parametrize(("turns", "chars"), [(256, 1 << 25), (7, 1 << 25), (7, 300), (1, 1)])
def test_long_conversations_are_decoded_whole(spark, monkeypatch, turns, chars):
    """Small chunks and ranges; one conversation has half of the rows, and one has turns without number."""
    rng = random.Random(2)
    words = lambda: " ".join("word" for _ in range(rng.choice([3, 150])))
    rows = [(1, k, "user" if k % 2 else "assistant", words()) for k in range(60)]
    rows += [(c, k, None, words() + ("\nUser: and\nAssistant: so" if k == 2 else "")) for c in range(2, 12) for k in range(4)]
    rows += [(None, None, None, f"Assistant: {k}") for k in range(9)] + [(20, 1, None, "second"), (20, None, "system", "System: first"), (20, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat_format, "CHUNK_TURNS", turns)
    monkeypatch.setattr(chat_format, "RANGE_CHARS", chars)
    model = chat_format.train(table)
    found = collections.defaultdict(list)
    for r in chat_format.format_conversations(table, model).collect():
        found[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["part"], r["role_pred"], r["rendered"]))
    hashed = {r["text"]: r["h"] for r in table.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, hashed[r[3]]))
        lines = [chat_format.lines_of(r[3] or "", True) for r in own]
        path = chat_format.viterbi(np.concatenate([model.scores(l, True) for l in lines]), model.step, model.first)
        want = chat_format._rendered(model, [r[1] for r in own], lines, path)
        assert sorted((w["turn"] is not None, w["turn"] or 0, w["part"], w["role_pred"], w["rendered"]) for w in want) == sorted(found[conv])
    assert [t[3] for t in sorted(found[20])][0] == "system"  # a turn without number comes first
    assert [t[2:4] for t in sorted(found[5]) if t[1] == 2][1:] == [(1, "user"), (2, "assistant")]


def test_roles_are_recovered(spark):
    rows = queries.op3_chat_format(spark, SMALL).toPandas()
    truth = spark.read.parquet(f"{SMALL}/conversations.parquet").toPandas()
    both = rows.merge(truth, on=["conv_id", "turn"])
    assert len(both) == len(truth) == len(rows) and (both["role_pred"] == both["role"]).mean() > 0.85


def held_out(spark, rows, column):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    return both[both["held_out"]], column


def test_toxic_documents_are_found(spark):
    test, _ = held_out(spark, queries.op5_toxicity(spark, SMALL).toPandas(), "toxic")
    assert test[test["toxic"] == 0]["predicted"].mean() < 0.05
    assert test[test["toxic"] == 1]["score"].mean() > 2 * test[test["toxic"] == 0]["score"].mean()


def test_quality_is_ranked(spark):
    test, _ = held_out(spark, queries.op10_quality(spark, SMALL).toPandas(), "quality")
    assert (test["predicted"] == test["quality"]).mean() > 0.9


def plain_features(text):
    """The wanted features by their definition, one word at a time."""
    counts = collections.Counter(b for run in {r for p in (text or "").split() for r in toxicity._RUN.findall(p.lower())} for b in toxicity.buckets_of(run))
    further = {(b * 31 + level) % toxicity.BUCKETS for b, n in counts.items() for level in toxicity.LEVELS if n >= level}
    return sorted({*counts, *further})


def test_toxicity_features_are_as_defined(documents):
    texts = [*documents["text"].tolist()[:80], "", None, " a b ", "One, one. ONE"]
    found = toxicity.Features()(pa.array(texts)).to_pylist()
    assert found == [plain_features(t) for t in texts]
    wanted = np.unique(np.concatenate([np.array(f, dtype=np.int32) for f in found]))[::3]
    some = toxicity.Features(wanted, memo=500)
    for k in range(0, len(texts), 7):
        for row, f in zip(some(pa.array(texts[k : k + 7])).to_pylist(), found[k : k + 7]):
            assert wanted[row].tolist() == sorted(set(f) & set(wanted.tolist()))


def test_the_risk_is_the_non_negative_pu_risk():
    rng = np.random.RandomState(1)
    rows = [sorted(rng.choice(5, rng.randint(0, 4), replace=False).tolist()) for _ in range(30)]
    n = rng.randint(1, 4, 30)
    patterns = toxicity.Patterns(pa.array(rows, pa.list_(pa.int32())), n)
    theta = rng.randn(6)
    found = patterns.sums(theta)
    z = np.array([theta[r].sum() + theta[5] for r in rows])
    assert found[0] == pytest.approx((n * np.log1p(np.exp(z))).sum()) and found[1] == pytest.approx((n * np.log1p(np.exp(-z))).sum())
    for k in range(6):  # the gradients are those of the losses
        moved = theta.copy()
        moved[k] += 1e-6
        assert (patterns.sums(moved)[:2] - found[:2]) / 1e-6 == pytest.approx([found[2 + k], found[8 + k]], abs=1e-3)


def test_learning_in_tasks_equals_learning_in_the_driver(spark, monkeypatch):
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: real(*a, steps=8))
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.limit(400)
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels, in_driver=k).collect()} for k in (10**9, 0))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)
