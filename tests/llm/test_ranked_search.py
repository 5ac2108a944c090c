"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tabscope.llm.common import table
from tabscope.llm.ranked_search import Shard, ranked_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    own = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n = sum(bool(c) for _, c in own)
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            if c:
                m = 10 + 90 * sum(c.values()) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
                if s > 0:
                    scores.append((-s, i is None, i or 0))
        out += [(str(item), r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def answers(found):
    return sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in found.collect()), key=str)


ODD = [(-1, None), (-2, ""), (-3, "!? ..."), (-4, "\u00c9t\u00e9 \u00e9t\u00e9 ABC abc 42"), (None, "abc 42"), (-6, "abc 42"), (-6, "abc 42"), (-7, "abc " * 50_000), (-8, "42")]
ITEMS = [(1, "ABC abc 42!"), (2, None), (3, "nowhere"), (None, "\u00e9t\u00e9 abc"), (5, ""), (6, "42 42 42"), (6, "the abc"), (7, "the and of en de la")]


@pytest.mark.parametrize("own", [{}, {"block_docs": 2, "k": 3}, {"query_bytes": 1}])
def test_best_documents(spark, own):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).selectExpr("*", "1 as rank", "'x' as query").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").unionByName(table(spark, "/root/testdata/sf0.001", "benchmark").select("item_id", "text"))
    found = answers(ranked_search(docs, items, **own))
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], own.get("k", 10))


def test_many_copies_tie(spark):
    docs = spark.createDataFrame([(i, "one two three" if i % 3 else f"one more {i}") for i in range(3000)], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "two"), (2, "one"), (3, "more 6 three")], "item_id long, text string")
    found = answers(ranked_search(docs, items))
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], [(1, "two"), (2, "one"), (3, "more 6 three")])
    assert [x[2] for x in sorted(found) if x[0] == "1"] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14]


def test_empty_tables(spark):
    docs, items = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark")
    for found in (ranked_search(docs.limit(0), items), ranked_search(docs, items.limit(0))):
        assert found.count() == 0 and [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint"]


def test_blocks_are_skipped_and_lose_nothing():
    draw = np.random.default_rng(2)
    topic = draw.integers(0, 12, 1500)
    weights = np.where(draw.random((1500, 120)) < 0.05, draw.integers(1, 1_000_000, (1500, 120)), 0)
    for t in range(12):
        weights[np.ix_(topic == t, range(10 * t, 10 * t + 8))] = draw.integers(100_000, 1_000_000, ((topic == t).sum(), 8))
    shard, counts = Shard(list(range(1500)), weights.astype(np.int32), np.arange(120), 32), Counter()
    for t in range(12):
        query = np.array([*range(10 * t, 10 * t + 6), (10 * t + 50) % 120])
        w = np.sort(draw.integers(1000, 9000, len(query)))[::-1]
        scores = weights[:, query] @ w
        order = np.lexsort((np.arange(1500), -scores))[:10]
        docs, found = shard.best(query, w, 10, int(scores[order[-1]]), counts)
        assert docs.tolist() == order.tolist() and found.tolist() == scores[order].tolist()
    assert counts["skipped"] > counts["blocks"] / 3 and counts["scored"] < 12 * 1500 / 3
    # a block's summary is the largest weight of its documents in every term
    docs, starts, summaries = shard.blocks(3)
    assert all((summaries[b] == weights[docs[s:e]].max(0)).all() for b, (s, e) in enumerate(zip(starts, [*starts[1:], len(docs)])))
    assert sorted(docs.tolist()) == np.flatnonzero(weights[:, 3]).tolist()


def test_terms():
    assert terms_of("Ab-c_D9 \u00c9\x7f\u00e9 {x}") == [t.encode() for t in TERM.findall("Ab-c_D9 \u00c9\x7f\u00e9 {x}".translate(LOWER))]
