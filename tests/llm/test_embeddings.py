"""Links between embeddings against all cosines in double precision."""

import numpy as np
import pytest

from tabscope.llm.common import table
from tabscope.llm.embeddings import Quantised, compare, embedding_links, unit


def clusters(seed=1, rows=900, size=8):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(6, size))
    return [(i, [float(np.float32(x)) for x in base[i % 6] + draw.normal(size=size) * 0.22]) for i in range(rows)]


ROWS = clusters()
ODD = [
    (1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [None] + [1.0] * 7), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]),
    (None, [1.0, 2.0]), (1008, [3e38] * 8), (1009, [1e-38] * 8), (5, ROWS[5][1]), (5, ROWS[5][1]), (1010, [float("inf")] + [0.0] * 7),
    (1011, [-0.0] * 7 + [1.0]), (1012, [0.0] * 7 + [1.0]), (None, [5.0] * 3), (1013, [1.0]),
]


def brute(rows, least):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    root, links, least_id = list(range(len(rows))), [0] * len(rows), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for size in {len(v) for (_, v), g in zip(rows, good) if g}:
        at = [i for i, (_, v) in enumerate(rows) if good[i] and len(v) == size]
        x = unit(np.array([rows[i][1] for i in at]))
        cosines = x @ x.T
        np.fill_diagonal(cosines, 0)
        for a, b in zip(*np.nonzero(cosines >= least)):
            links[at[a]] += 1
            root[find(at[a])] = find(at[b])
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least_id[find(i)] = min(least_id.get(find(i), key), key)
    return sorted((str(k), links[i], least_id.get(find(i)), k is not None and k == least_id.get(find(i))) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("own", [{}, {"block_bytes": 2000}, {"block_bytes": 5000, "pivots_at_most": 3}, {"least": 0.8}])
def test_links_of_clusters_and_odd_rows(spark, own):
    df = spark.createDataFrame([(i, v, 7) for i, v in ROWS + ODD], "vec_id long, embedding array<float>, n_links int").repartition(3)
    found = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_links(df, **own).collect())
    assert found == brute(ROWS + ODD, own.get("least", 0.95))


def test_doubles_copies_and_empty_tables(spark):
    rows = [(i, [1.0, 1e-17 * (i % 2), 0.0]) for i in range(300)] + [(i, v) for i, v in clusters(3, 80, 3)]
    df = spark.createDataFrame([(str(i), v) for i, v in rows], "name string, vector array<double>")
    found = sorted((r.name, r.n_links, r.component_id, r.kept) for r in embedding_links(df, "name", "vector").collect())
    assert found == brute([(str(i), v) for i, v in rows], 0.95)
    assert embedding_links(df.limit(0), "name", "vector").count() == 0
    assert [tuple(r) for r in embedding_links(df.where("name = '0'").limit(1).selectExpr("name", "cast(null as array<double>) as vector"), "name", "vector").collect()] == [("0", 0, "0", True)]


@pytest.mark.parametrize("size", [3, 64, 1500])
def test_bounds_hold_and_few_pairs_are_computed_again(size):
    draw = np.random.default_rng(size)
    x = draw.normal(size=(300, size))
    x[1::2] = x[::2] + draw.normal(size=(150, size)) * draw.uniform(0.1, 0.6, size=(150, 1))
    q = Quantised(x)
    every = slice(0, 300)
    near = q.products(every, q, every) * q.scale[:, None] * q.scale
    lost = (1 + q.rest[:, None]) * (1 + q.rest) - 1
    exact = q.unit @ q.unit.T
    assert (np.abs(near - exact) <= lost).all() and lost.max() < 0.05
    i, j = q.links(every, q, every, 0.95)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(exact >= 0.95))))
    links, label = compare(x, None, np.ones(300, np.int64), None, 0.95, tile=64)
    assert (links == (exact >= 0.95).sum(1) - 1).all()
    half, label_ = compare(x[:150], x[150:], np.ones(150, np.int64), np.full(150, 3), 0.95, tile=64)
    assert (half[:150] == 3 * (exact[:150, 150:] >= 0.95).sum(1)).all() and (half[150:] == (exact[:150, 150:] >= 0.95).sum(0)).all()


def test_whole_table(spark):
    from tabscope.llm.queries import op12_embedding_links

    rows = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    found = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in op12_embedding_links(spark, "/root/testdata/sf0.1").collect())
    assert found == brute([(r.vec_id, r.embedding) for r in rows], 0.95)
