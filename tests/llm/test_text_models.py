"""Language mixtures, toxicity and context-tree weighting."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.llm import ctw
from tabscope.llm.common import Memo, fold, table
from tabscope.llm.decontaminate import words_of
from tabscope.llm.language import fit, identify, mixtures
from tabscope.llm.queries import op5_language_mixture, op7_context_tree_weighting, op9_toxicity
from tabscope.llm.toxicity import WIDTHS, Coded, Network, labelled_sample, logits, toxicity
from tabscope.llm.toxicity import _feature as features_of
from tabscope.llm.toxicity import fit as fit_toxicity

SF = "/root/testdata/sf0.01"

ODD = [(1, None), (2, ""), (3, "12 34 ... !"), (4, "a"), (5, "É"), (6, "the and of " * 40_000), (6, "the and of " * 40_000), (None, "the")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "xx", 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double").repartition(2)


def test_language_of_held_out_rows(spark):
    found = op5_language_mixture(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_proportions(spark):
    docs = table(spark, SF, "documents")
    langs, log_p = fit(docs, F.lit(True))
    one = {r.lang: r.text for r in docs.where("n_chars between 1500 and 3000").collect()}
    text = (one["en"][:1400] + " " + one["fr"][:600]).encode()
    share, _ = mixtures([text], langs, log_p, 3.0, 20)
    found = dict(zip(langs, share[0]))
    assert 0.5 < found["en"] < 0.85 and 0.15 < found["fr"] < 0.5 and found["de"] == 0


def test_language_of_odd_rows(spark, odd):
    model = fit(table(spark, SF, "documents"), F.lit(True))
    rows = identify(odd, *model).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by_id[1].score == 0
    assert by_id[6].lang_pred == "en" and by_id[5].lang_pred != "und"
    nothing = fit(table(spark, SF, "documents").limit(0), F.lit(True))
    assert {r.lang_pred for r in identify(odd, *nothing).collect()} == {"und"}
    assert identify(odd.limit(0), *model).count() == 0


def test_toxicity_of_held_out_rows(spark):
    larger = "/root/testdata/sf0.1"
    labels = table(spark, larger, "labels").select("doc_id", "toxic")
    rows = op9_toxicity(spark, larger).join(labels, "doc_id").where("toxic is not null").collect()
    held = [r for r in rows if r.held_out]
    caught = np.mean([r.predicted for r in held if r.toxic == 1])
    wrong = np.mean([r.predicted for r in held if r.toxic == 0])
    assert caught >= 0.8 and wrong <= 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_rows(spark, odd):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    net = fit_toxicity(docs, labels, fold("doc_id", 5) != 0, sample_docs=30)
    rows = toxicity(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    assert toxicity(odd.limit(0), net).count() == 0
    for some, want in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0)):
        assert {r.score for r in toxicity(odd, fit_toxicity(docs, some, F.lit(True))).collect()} == {want}


def brute_logit(net, text, feature):
    """Forward pass of one text, window by window."""
    words = [net.table[list(feature(w))].sum(0) for w in words_of(text)]
    pooled = []
    for k, width in enumerate(WIDTHS):
        rows = words + [np.zeros(net.table.shape[1])] * (len(WIDTHS) + width - 1)
        responses = [sum(rows[i + j] @ net.filters[k][j] for j in range(width)) for i in range(len(words) + 1)]
        pooled.append(np.maximum(np.max(responses, axis=0) + net.biases[k], 0))
    return float(np.hstack(pooled) @ net.weights + net.bias)


def test_logits_of_a_batch_are_those_of_each_text():
    draw = np.random.default_rng(5)
    net = Network(
        draw.normal(size=(512, 4)), [draw.normal(size=(w, 4, 6)) for w in WIDTHS], [draw.normal(size=6) for _ in WIDTHS],
        draw.normal(size=6 * len(WIDTHS)), 0.3,
    )
    feature = features_of(512)
    raw = [b"alpha", b"beta gamma", b"", b"x y z w", b"alpha", b"one two three four five six seven", b"beta"]
    alone = [logits(net, Coded([t], Memo(feature)))[0] for t in raw]
    assert np.allclose(logits(net, Coded(raw, Memo(feature))), alone, atol=1e-12)
    assert np.allclose(alone, [brute_logit(net, t, feature) for t in raw], atol=1e-12)


def test_long_texts_do_not_end_the_sample(spark):
    long = {3, 10, 17, 24, 31, 38}
    texts = [(i, ("bad " if i % 2 else "kind ") * (2000 if i in long else 4), "en") for i in range(40)]
    docs = spark.createDataFrame([*texts, (50, None, "en"), (60, "no label", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(40), 50, 70]], "doc_id long, toxic int")
    sample = lambda d, n, size: labelled_sample(d, labels, F.lit(True), "doc_id", "text", "toxic", "lang", n, size)
    assert {r.id for r in sample(docs, 100, 700)} == set(range(40)) - long
    assert {r.id for r in sample(docs, 100, 1 << 20)} == set(range(40))
    # the bound holds per class: 20 bytes for a text of class 0, 16 for one of class 1
    found = Counter(r.y for r in sample(docs, 100, 100))
    assert found == {0: 5, 1: 6} and Counter(r.y for r in sample(docs, 3, 700)) == {0: 3, 1: 3}
    net = fit_toxicity(docs, labels, F.lit(True), sample_bytes=700)
    assert net.constant is None
    with pytest.raises(ValueError, match="class 1"):
        sample(docs.where("doc_id % 2 = 0 or doc_id in (3, 17)"), 100, 700)


def brute_tree(train: list[bytes], depth: int):
    """Direct context-tree weighting over dictionaries: log10 probability of a stream."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for s in train:
        data = b"\n" * depth + s
        for i in range(depth, len(data)):
            for j in range(8):
                prefix, bit = (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1
                for d in range(depth + 1):
                    node = data[i - d : i], prefix
                    counts[node][bit] += 1
                    if d < depth:
                        children[node].add((data[i - d - 1 : i], prefix))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    known = {}

    def weighted(node):
        if node not in known:
            own = kt(*counts[node])
            if len(node[0]) == depth:
                known[node] = own, 1.0
            else:
                below = sum(weighted(c)[0] for c in children[node])
                both = np.logaddexp(own, below) + math.log(0.5)
                known[node] = both, math.exp(own + math.log(0.5) - both)
        return known[node]

    def score(s):
        data, total = b"\n" * depth + s, 0.0
        for i in range(depth, len(data)):
            for j in range(8):
                prefix, bit = (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1
                p, seen = 0.5, False
                for d in range(depth, -1, -1):
                    node = data[i - d : i], prefix
                    if node in counts:
                        a, b = counts[node]
                        w = weighted(node)[1] if seen else 1.0
                        p, seen = w * (b + 0.5) / (a + b + 1) + (1 - w) * p, True
                total += math.log10(p if bit else 1 - p)
        return total

    return score


def test_code_lengths_equal_a_direct_tree(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").where("n_chars < 400").limit(40).collect()]
    docs += [(1001, None), (1002, ""), (1003, "Zebra\x1cxylophone \t q"), (docs[0][0], docs[0][1]), (None, "no id")]
    df = spark.createDataFrame([(d, t, 1.0, "x") for d, t in docs], "doc_id long, text string, score double, block string").repartition(3)
    rows = ctw.code_lengths(df, fold("doc_id", 7) != 2, classes=5, block_runs=700, step_bytes=600).collect()
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    streams = [(d, *ctw.stream((t or "").encode())) for d, t in docs]
    score = brute_tree([s for d, _, s in streams if not held[d]], ctw.DEPTH)
    c = Counter(w for d, ws, _ in streams if not held[d] for w in [*ws, b"\n"])
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(d), held[d], len(ws) + 1, sum(c[w] > 0 for w in [*ws, b"\n"]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, b"\n"]), 6), round(score(s), 3))
        for d, ws, s in streams
    )
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5, atol=2e-3)


@pytest.mark.parametrize("depth", [3, 6, 7])
def test_code_lengths_by_depth(spark, depth):
    texts = ["abcdefgh abcdefgh", "Xbcdefgi ybcdefgj", "the cat sat on the mat", "abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    streams = [ctw.stream(t.encode())[1] for t in texts]
    want = [brute_tree(streams[:3], depth)(s) for s in streams]
    found = ctw.code_lengths(df, F.col("doc_id") < 3, classes=5, block_runs=20, step_bytes=20, depth=depth).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in found], want, atol=2e-3)
    if depth == 6:
        default = ctw.code_lengths(df, F.col("doc_id") < 3).orderBy("doc_id").collect()
        assert np.allclose([r.score for r in default], want, atol=2e-3)


def test_a_block_goes_on_while_its_steps_repeat_their_runs(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ctw, "stored", lambda df, own=ctw.stored: kept.append(own(df)) or kept[-1])
    text = " ".join(f"word{i}" for i in range(100))
    distinct = len(set(ctw.runs(ctw.stream(text.encode())[1]).tolist()))
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").coalesce(1)
    rows = ctw.code_lengths(df, F.lit(True), block_runs=2 * distinct, step_bytes=len(text)).collect()
    assert len(rows) == 40 and len({r.score for r in rows}) == 1
    assert kept[0].where("kind = 'h'").count() == 1
    assert sum(len(ctw.unpack(r.payload)[0]) for r in kept[0].where("kind = 'g'").collect()) <= distinct + ctw.DEPTH


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 50_000])
def test_lookup_finds_each_key(n):
    keys = np.unique(np.append(np.random.default_rng(n).integers(0, 1 << 56, n).astype(np.uint64), np.arange(n, dtype=np.uint64)))
    found = ctw.Lookup(keys, keys * np.uint64(3))
    assert (found[keys[::-1]] == keys[::-1] * np.uint64(3)).all()
    assert len(found[np.array([2**64 - 1, 1 << 60, 5], np.uint64)]) == 3


@pytest.mark.parametrize("depth", [2, 5, 6, 7])
def test_packed_runs_come_back(depth):
    words = np.random.default_rng(1).choice(["the", "and", "table", "of", "window", "runs", "small"], 20_000)
    keys, n = np.unique(ctw.runs(" ".join(words).encode(), depth), return_counts=True)
    packed = ctw.pack(keys, n, runs_=True)
    for found in (ctw.unpack(packed), ctw.unpack(ctw.pack(keys, n))):
        assert (found[0] == keys).all() and (found[1] == n).all()
    assert all(len(x) == 0 for x in ctw.unpack(ctw.pack(keys[:0], n[:0], runs_=True)))


def test_code_lengths_without_training_and_empty(spark, odd):
    rows = ctw.code_lengths(odd.where("doc_id < 6"), F.lit(False)).collect()
    assert all(math.isclose(r.bits_per_byte, 8) and r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert ctw.code_lengths(odd.limit(0), F.lit(True)).count() == 0


def test_code_lengths_whole(spark):
    rows = op7_context_tree_weighting(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == table(spark, "/root/testdata/sf0.001", "documents").count()
    assert all(r.score < 0 and r.base_score < 0 for r in rows)


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 10, 1234.5, 1e7])
    assert np.allclose(ctw.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
