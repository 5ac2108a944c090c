"""Decontamination and the Jaccard join against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tabscope.llm.components import components
from tabscope.llm.decontaminate import contamination, words_of
from tabscope.llm.jaccard import jaccard_components, must_share, prefix_size

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKENS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_hits(docs, items):
    own = {}
    for item, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        if w:
            own.setdefault(item, set()).update((min(len(w), 10), x) for x in windows(w, min(len(w), 10)))
    out = []
    for doc, text in docs:
        w = WORDS.findall((text or "").translate(LOWER))
        hit, listed = set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                for item, keys in own.items():
                    if (n, tuple(w[i : i + n])) in keys:
                        hit.update(range(i, i + n))
                        if item is not None:
                            listed.add(str(item))
        out.append((str(doc), len(w), len(hit), sorted(listed)))
    return sorted(out)


def brute_components(docs, gram=5, percent=75):
    sets = []
    for _, text in docs:
        w = TOKENS.findall((text or "").translate(LOWER))
        sets.append(windows(w, gram) if len(w) >= gram else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least.setdefault(find(i), []).append(doc)
    return sorted((str(d), len(s), str(min((x for x in least[find(i)] if x is not None), default=None))) for i, ((d, _), s) in enumerate(zip(docs, sets)))


@pytest.fixture(scope="module")
def overlaps():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    item = [(1, " ".join(r.choices(vocabulary, k=25))), (2, " ".join(r.choices(vocabulary, k=10))), (3, "only three words"), (4, None), (5, ""), (2, "Some, other text of the same item; with more than ten words here.")]
    item += [(None, " ".join(r.choices(vocabulary, k=12)))]
    docs = [(1, None), (2, ""), (3, "...!"), (4, item[0][1].upper()), (4, item[0][1].upper()), (None, item[1][1]), (5, "ONLY-three  words and only Three words")]
    for i in range(10, 40):
        w = r.choices(vocabulary, k=r.randint(1, 60))
        if i % 2:
            source = item[r.choice((0, 1, 6))][1].split()
            a = r.randint(0, 3)
            at = r.randint(0, len(w))
            w[at:at] = source[a : a + r.randint(5, 20)]
        docs.append((i, r.choice((" ", ", ", "\n")).join(w)))
    return docs, item


def test_contamination_equals_brute_force(spark, overlaps):
    docs, items = overlaps
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, items string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(df, bench, filter_bits=1 << 15).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.items)) for r in rows) == brute_hits(docs, items)
    none = contamination(df, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit for r in none)
    assert contamination(df.limit(0), bench).count() == 0


def test_very_long_document(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    text = "filler " * 300_000 + passage + " filler" * 1000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = contamination(df, spark.createDataFrame([(7, passage)], "item_id long, text string")).first()
    assert (r.n_words, r.n_hit, list(r.items)) == (301_012, 12, ["7"])


def test_words_are_those_of_the_pattern():
    text = "Ünïcode—dash 12a_b C3\x7fé x"
    assert [w.decode() for w in words_of(text.encode())] == WORDS.findall(text.translate(LOWER))


def near_copies(seed, groups=6, size=9):
    r = random.Random(seed)
    docs, k = [], 0
    shared = [f"s{i}" for i in range(12)]
    for _ in range(groups):
        base = [f"v{r.randint(0, 400)}" for _ in range(r.choice((3, 6, 9, 40, 80)))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
            if r.random() < 0.3:
                w += shared
            docs.append((k, " ".join(w)))
            k += 1
    return docs + [(k, None), (k + 1, " \n"), (k + 2, "one"), (k + 3, "One"), (k + 4, "a b"), (0, docs[0][1]), (None, docs[1][1]), (k + 5, "lone\x1cword a b c d e f")]


def test_close_copies_without_links_leave_in_blocks(spark, monkeypatch):
    from tabscope.llm import jaccard

    r = random.Random(5)
    base = [f"v{i}" for i in range(40)]
    docs = []
    for k in range(150):  # linked where the same word is another one: distances of 0.24 and 0.43, nothing between
        w = list(base)
        w[k * 7 % 40] = f"x{r.randint(0, 10**6)}"
        docs.append((k, " ".join(w)))
    splits, split = [], jaccard._Join.split
    monkeypatch.setattr(jaccard._Join, "split", lambda self, rows: splits.append(1) or split(self, rows))
    rows = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), fits=60).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == brute_components(docs)
    assert len(splits) <= 2


@pytest.mark.parametrize(("seed", "fits"), [(1, 128), (2, 2), (3, 3)])
def test_components_equal_brute_force(spark, seed, fits):
    docs = near_copies(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n long, class int").repartition(3)
    rows = jaccard_components(df, fits=fits).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == brute_components(docs)


def test_regions_split_and_stay_exact(spark):
    """A chain of texts around one shared start: larger than a region, linked only step by step."""
    r = random.Random(5)
    docs, w = [], [f"c{i}" for i in range(60)]
    for k in range(60):
        docs.append((k, " ".join(w)))
        w = list(w)
        w[r.randrange(10, 60)] = f"n{k}"
    rows = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), fits=4).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in rows) == brute_components(docs)


def test_linked_sets_share_what_sifting_asks_for(spark):
    """Sets in one order, linked at the threshold, whose own shingles all come first: the worst case."""
    need = {r.n: r.k for r in spark.range(1, 200).withColumnRenamed("id", "n").withColumn("k", must_share(F.col("n"), 75)).collect()}
    for n in range(1, 200):
        for m in range(n, 200):
            common = -(-75 * (n + m) // 175)
            if common > n:
                break
            in_both = min(prefix_size(n, 75) - (n - common), prefix_size(m, 75) - (m - common), common)
            assert in_both >= max(need[n], need[m]) >= 1


def test_empty_join(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(blank).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_queries_whole(spark):
    from tabscope.llm.queries import op4_decontamination, op8_jaccard_join

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op8_jaccard_join(spark, SF).collect()) == brute_components(docs)
    rows = op4_decontamination(spark, SF).collect()
    assert len(rows) == len(docs) and all(r.contaminated == (r.n_hit > 0) for r in rows)
    assert all(r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if not r.n_items)
    assert op4_decontamination(spark, SF).where(F.col("contaminated")).count() > 0


def test_words_of_a_step_are_hashed_together(monkeypatch):
    import numpy as np

    from tabscope.llm import jaccard

    calls, original = [], jaccard.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(jaccard.xxhash, "xxh3_64_intdigest", lambda *a: calls.append(a) or original(*a))
    rng = random.Random(5)
    made = ["".join(rng.choice("abcXYZ\u00e9\u4e2d\x00.") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 20]))) for _ in range(5000)]
    odd = ["", " ", "\t\r\n\x0b\x0c", "x" * 64, "x" * 65, "a " + "y" * 300 + " B", "a\x00", "a\x00\x00", "a"]
    texts = [*odd, " ".join(made), *odd, "  ".join(made[::-1]), ""]
    got = jaccard.words_of([t.encode() for t in texts])
    words = [TOKENS.findall(t.translate(LOWER)) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in words]
    pairs = {(w, h) for own, found in zip(words, got) for w, h in zip(own, found.tolist())}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    # only the long words, two in either list of odd texts, are hashed one by one
    assert len(calls) == 4
    assert [len(x) for x in jaccard.words_of([b""])] == [0]
    values = np.array([3, 1, 3, 2, 1], np.uint64)
    assert jaccard.distinct(values).tolist() == [1, 2, 3] and jaccard.distinct(values[:0]).tolist() == []


def test_shared_shingles_are_found_by_one_sort(spark, monkeypatch):
    from tabscope.llm import jaccard

    plans, stored = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    rows = [(s, c) for c in range(3) for s in range(4)] * 2 + [(9, 7), (9, 7), (8, 7)]
    pairs = spark.createDataFrame(rows, "shingle long, class long").repartition(4, "shingle")
    sizes = spark.createDataFrame([(0, 4), (1, 4), (2, 4), (7, 2)], "class long, n long")
    found = jaccard._sifted(pairs, sizes, 75)
    assert sorted(map(tuple, found.select("shingle", "class").collect())) == [(s, c) for s in range(4) for c in range(3)]
    assert "Join" not in plans[0] and plans[0].count("Exchange") == 1
