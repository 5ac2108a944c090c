import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import effects, leakage, relations
from tabscope.operators.effects import BinaryTarget

YES = BinaryTarget("y", "Yes", "No")


def test_pearson_and_rank_known_values(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 4.0, 2.0), (3, 9.0, 2.0), (4, 16.0, 2.0)], "a int, b double, c double")
    rows = {(r.feature_a, r.feature_b): r for r in relations.numeric_pairs(df, ["a", "b", "c"]).collect()}
    assert rows[("a", "b")].rank_r == pytest.approx(1.0) and rows[("a", "b")].pearson < 1.0
    assert rows[("a", "c")].pearson is None and rows[("a", "c")].rank_r is None
    assert rows[("a", "c")].interpretation == "Insufficient variation for correlation"


def test_rank_correlation_matches_pandas_with_ties_and_gaps(spark):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"a": rng.integers(0, 6, 400).astype(float), "b": rng.normal(size=400), "c": rng.exponential(size=400)})
    frame.loc[::7, "a"] = np.nan
    frame.loc[::5, "c"] = np.nan
    df = spark.createDataFrame(frame)
    for r in relations.rank_pairs(df, ["a", "b", "c"]).collect():
        both = frame[[r.feature_a, r.feature_b]].dropna()
        want = both[r.feature_a].rank().corr(both[r.feature_b].rank())
        assert r.rank_r == pytest.approx(want, abs=1e-12) and r.valid_rows == len(both)


def test_pearson_in_tiles_equals_pandas(spark):
    rng = np.random.default_rng(3)
    names = [f"c{i}" for i in range(19)]
    frame = pd.DataFrame(rng.normal(size=(120, 19)), columns=names)
    frame["c4"], frame["c18"] = 1.5, frame["c0"] * 2 + frame["c9"]
    frame.loc[::4, "c7"] = np.nan
    frame["c12"] = np.nan
    df = spark.createDataFrame(frame).repartition(3)
    rows = relations.pearson_pairs(df, names).collect()
    assert sorted((names.index(r.feature_a), names.index(r.feature_b)) for r in rows) == list(itertools.combinations(range(19), 2))
    for r in rows:
        both = frame[[r.feature_a, r.feature_b]].dropna()
        assert (r.valid_rows, r.missing_rows) == (len(both), 120 - len(both))
        if {"c4", "c12"} & {r.feature_a, r.feature_b}:
            assert r.pearson is None
        else:
            assert r.pearson == pytest.approx(both.iloc[:, 0].corr(both.iloc[:, 1]), abs=1e-12)
            assert r.abs_pearson == abs(r.pearson)
    empty = relations.pearson_pairs(df.limit(0), names).collect()
    assert len(empty) == 171 and all((r.valid_rows, r.missing_rows, r.pearson) == (0, 0, None) for r in empty)


def test_pearson_of_five_hundred_columns(spark):
    wide = spark.range(40).select(*[F.rand(i).alias(f"c{i}") for i in range(500)])
    assert relations.pearson_pairs(wide, wide.columns).where("valid_rows = 40 and pearson is not null").count() == 124_750


@pytest.mark.parametrize(
    "rows, v, u",
    [
        ([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y")], 1.0, 1.0),
        ([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], 0.0, 0.0),
        ([("a", "x"), ("a", "x"), ("a", "x")], None, None),
    ],
)
def test_cramers_v_and_uncertainty(spark, rows, v, u):
    row = relations.categorical_pairs(spark.createDataFrame(rows, "p string, q string"), ["p", "q"]).collect()[0]
    if v is None:
        assert row.cramers_v is None and row.interpretation.startswith("Insufficient")
    else:
        assert row.cramers_v == pytest.approx(v, abs=1e-9) and row.u_a_given_b == pytest.approx(u, abs=1e-9)
        assert row.redundant is (v == 1.0)


def test_blank_categories_are_missing_but_spaces_stay(spark):
    df = spark.createDataFrame([("a", "x"), (" a", "x"), ("  ", "y"), (None, "y")], "p string, q string")
    row = relations.categorical_pairs(df, ["p", "q"]).collect()[0]
    assert (row.valid_rows, row.missing_rows, row.cardinality_a) == (2, 2, 2)


def test_eta_squared_extremes(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 5.0, 1.0), ("b", 5.0, 2.0)], "c string, m double, k double")
    got = {r.numerical: r.eta_squared for r in relations.eta_squared_pairs(df, ["c"], ["m", "k"]).collect()}
    assert got == {"m": pytest.approx(1.0), "k": pytest.approx(0.0)}


def test_interaction(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0), (2.0, 3.0, 7.0), (3.0, 4.0, 0.0)], "l double, r double, z double")
    row = relations.interaction(df, "lr", "l", "r", "z").collect()[0]
    assert row.mean_abs_difference == pytest.approx(13 / 3) and row.median_abs_difference == 1.0
    assert row.mean_relative_difference == pytest.approx((0 + 1 / 7) / 2)


def test_alignment(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (1,)], "k int")
    assert relations.aligned(left, right, ["k"]).collect()[0].aligned
    assert not relations.aligned(left, right.where("k = 1"), ["k"]).collect()[0].aligned


def test_category_rates_zero_cells_and_absent(spark):
    df = spark.createDataFrame([("A", "No"), (" A ", "No"), ("B", "Yes"), ("B", "Yes")], "g string, y string")
    rows = {r.category: r for r in effects.category_rates(df, ["g"], YES, {"g": ["A", "B", "C"]}).collect()}
    assert rows["B"].odds_ratio == pytest.approx((2.5 * 2.5) / (0.5 * 0.5))
    assert rows["B"].lift == 2.0 and rows["A"].rate == 0.0 and rows["A"].wilson_lower == 0.0
    assert rows["C"].n == 0 and rows["C"].rate is None and rows["C"].wilson_lower is None
    p, n, z = 1.0, 2, 1.959963984540054
    centre, margin = (p + z * z / (2 * n)) / (1 + z * z / n), z * np.sqrt(z * z / (4 * n * n)) / (1 + z * z / n)
    assert rows["B"].wilson_lower == pytest.approx(centre - margin) and rows["B"].wilson_upper == pytest.approx(1.0)


def test_numeric_effect_known_values(spark):
    df = spark.createDataFrame([(1.0, "No"), (2.0, "No"), (8.0, "Yes"), (9.0, "Yes")], "amount double, y string")
    row = effects.numeric_effect(df, ["amount"], YES, bins=2).collect()[0]
    frame = pd.DataFrame({"v": [1, 2, 8, 9], "t": [0, 0, 1, 1]})
    assert row.point_biserial == pytest.approx(frame.v.corr(frame.t)) and row.mean_difference == 7.0
    assert row.cohens_d == pytest.approx(7 / np.sqrt(0.5)) and row.rate_spread == 1.0 and row.review
    assert row.eta_squared == pytest.approx(frame.v.corr(frame.t) ** 2)


@pytest.mark.parametrize("values", ["skewed", "few", "hot"])
def test_quantile_bins_match_qcut(spark, values):
    rng = np.random.default_rng(2)
    v = {
        "skewed": rng.lognormal(0, 3, 997),
        "few": rng.integers(0, 4, 300).astype(float),
        "hot": np.where(rng.random(900) < 0.4, 0.0, rng.normal(size=900)),
    }[values]
    frame = pd.DataFrame({"v": v, "y": np.where(rng.random(len(v)) < 0.3, "Yes", "No")})
    got = effects.quantile_bin_rates(spark.createDataFrame(frame), ["v"], YES).orderBy("bin").collect()
    cut = pd.qcut(frame.v, min(10, frame.v.nunique()), duplicates="drop")
    want = frame.groupby(cut, observed=False).y.agg(["size", lambda s: (s == "Yes").sum()])
    assert [r.n for r in got] == want["size"].tolist()
    assert [r.positives for r in got] == want.iloc[:, 1].tolist()


def test_categorical_effect_perfect_feature(spark):
    df = spark.createDataFrame([("A", "No"), ("A", "No"), ("B", "Yes"), (None, "Yes")], "g string, y string")
    row = effects.categorical_effect(df, ["g"], YES).collect()[0]
    assert row.cramers_v == pytest.approx(1.0) and row.u_target_given_feature == pytest.approx(1.0)
    assert (row.valid_rows, row.missing_rows, row.rate_spread) == (3, 1, 1.0)


def test_proxy_methods(spark):
    rows = [
        (f"id{i}", y, y.upper() + " ", 1 if y == "Yes" else 0, "s" if y == "Yes" else "t", f"{y[0]}{i % 3}", i)
        for i, y in enumerate(["Yes", "No"] * 10)
    ]
    df = spark.createDataFrame(rows, "id string, y string, folded string, code int, other string, many string, noise int")
    df = df.withColumn("copy", df.y)
    got = {r.feature: (r.method, r.severity) for r in leakage.proxy_class(df, ["id", "copy", "folded", "code", "other", "many", "noise"], "y", ["id"]).collect()}
    assert got == {
        "copy": ("Exact target copy", "Critical"),
        "folded": ("Normalized target copy", "Critical"),
        "code": ("Binary target encoding", "High"),
        "other": ("Bidirectional target mapping", "High"),
        "many": ("Deterministic target mapping", "High"),
    }


def test_split_leakage(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "train"), (2, "train")], "k int, split string")
    assert [r.k for r in leakage.split_leakage(df, ["k"], "split").collect()] == [1]


def test_rank_pairs_with_nulls_in_every_pattern(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.integers(0, 40, (3000, 4)).astype(float), columns=list("abcd"))
    frame["b"] += frame["a"]
    frame["c"] = np.where(frame["a"] > 20, 7.0, frame["c"])
    for name in "abc":
        frame.loc[rng.random(3000) < 0.3, name] = np.nan
    frame["e"] = np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double, d double, e double").repartition(3)
    for r in relations.rank_pairs(df, list("abcde")).collect():
        both = frame[[r.feature_a, r.feature_b]].dropna()
        assert r.valid_rows == len(both)
        if len(both):
            assert r.rank_r == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-12) and r.abs_rank_r == abs(r.rank_r)
        else:
            assert r.rank_r is None
