import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.functions import text
from tabscope.operators import category, numeric, scale, target
from tabscope.operators.numeric import BlankRule


def one(df):
    return df.collect()[0].asDict()


def test_text_rules(spark):
    rows = [(" 1.5 ",), ("\t\n",), (None,), ("1d",), ("NaN",), (".5",), ("-2e3",), ("1_0",), ("inf",)]
    df = spark.createDataFrame(rows, "t string")
    dtype = df.schema["t"].dataType
    got = df.select(
        text.to_number(F.col("t"), dtype).alias("n"), text.blank(F.col("t"), dtype).alias("b"), text.missing(F.col("t"), dtype).alias("m")
    ).collect()
    assert [r.n for r in got] == [1.5, None, None, None, None, 0.5, -2000.0, None, float("inf")]
    assert [r.b for r in got] == [False, True] + [False] * 7
    assert [r.m for r in got] == [False, False, True] + [False] * 6


def test_fold_handles_sharp_s_and_wide_spaces(spark):
    df = spark.createDataFrame([(chr(0xA0) + "Stra" + chr(0xDF) + "e" + chr(0x3000),)], "t string")
    assert df.select(text.fold(F.col("t"))).collect()[0][0] == "strasse"


def test_fold_case_equals_casefold(spark):
    """Every letter that case folding changes, alone and within a word, and letters beside them."""
    changed = [c for c in map(chr, range(0x110000)) if c.casefold() != c]
    words = changed + ["x" + c + "Y" for c in changed] + ["ΟΔΟΣ", "οδος", "oﬃce", "İstanbul", "", "plain TEXT", "\U00010400\U0001f600Ω", "été", None]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = {r.t: r.f for r in df.select("t", text.fold_case(F.col("t")).alias("f")).collect()}
    assert got == {w: None if w is None else w.casefold() for w in words}


def test_declared_and_observed_labels_fold_alike(spark):
    df = spark.createDataFrame([("οδος",), ("ΟΔΟΣ",), ("OFFICE",)], "place string")
    declared = {"place": ["ΟΔΟΣ", "oﬃce"]}
    assert category.domain_violations(df, declared).count() == 0
    row = category.category_summary(df, ["place"], declared).collect()[0]
    assert "expected" not in row.status and "Unexpected" not in row.status and "Inconsistent labels" in row.status


def test_stats_of_one_to_five(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 6)], "value double")
    row = one(numeric.numeric_stats(df, ["value"]))
    assert (row["q1"], row["median"], row["q3"], row["iqr"]) == (2.0, 3.0, 4.0, 2.0)
    assert row["std"] == pytest.approx(1.58113883) and row["variance"] == 2.5
    assert row["skewness"] == pytest.approx(0.0) and row["unique_values"] == 5 and row["outliers"] == 0


def test_constant_and_short_columns_have_no_skewness(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 4.0), (2.0, None)], "a double, b double")
    rows = {r.feature: r for r in numeric.numeric_stats(df, ["a", "b"]).collect()}
    assert rows["a"].skewness is None and rows["b"].skewness is None
    assert rows["b"].valid == 2 and rows["b"].missing == 1


def test_conditional_blank_projection(spark):
    df = spark.createDataFrame([(0, " "), (10, "500.00"), (20, "1200.00"), (5, "  ")], "tenure int, total string")
    rule = {"total": BlankRule("total", "tenure", 0, 0.0)}
    got = numeric.numeric_projection(df, ["total"], rule, ["tenure"]).orderBy("tenure").collect()
    assert [r.total for r in got] == [0.0, None, 500.0, 1200.0]
    assert [r.total_materialized for r in got] == [True, False, False, False]
    assert [r.total_condition_failure for r in got] == [False, True, False, False]
    issues = numeric.conversion_issues(df, ["total"], rule).collect()
    assert [(r.issue, r.n) for r in issues] == [("Materialization condition not satisfied", 1)]


def test_exact_quantiles_match_numpy_on_skewed_groups(spark):
    rng = np.random.default_rng(7)
    a = np.concatenate([np.zeros(400), rng.lognormal(0, 4, 500), -rng.lognormal(2, 3, 300)])
    b = rng.integers(-5, 6, 50).astype(float)
    frame = pd.DataFrame({"g": ["a"] * len(a) + ["b"] * len(b) + ["c"], "v": np.concatenate([a, b, [1e300]])})
    df = spark.createDataFrame(frame)
    probs = {"p0": 0.0, "p1": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in scale.exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g, part in frame.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part.v, p), rel=1e-12, abs=1e-12), (g, name)


@pytest.mark.parametrize("descending", [False, True])
def test_ordered_totals_match_cumsum(spark, descending):
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([rng.normal(0, 1e-6, 300), rng.normal(0, 1e6, 300), [0.0, -1.0, 1.0, 2.0, 4.0]]))
    frame = pd.DataFrame({"v": values, "n": rng.integers(1, 9, len(values))})
    got = scale.ordered_totals(spark.createDataFrame(frame), "v", ["n"], descending=descending).toPandas()
    want = frame.sort_values("v", ascending=not descending)
    want["cum"] = want.n.cumsum()
    got = got.sort_values("v", ascending=not descending)
    assert got.cum_n.tolist() == want.cum.tolist() and set(got.total_n) == {int(frame.n.sum())}


def test_leaf_is_monotone(spark):
    rng = np.random.default_rng(5)
    values = np.unique(np.concatenate([2.0 ** np.arange(-1070, 1023, 7), rng.normal(0, 1, 500), -(2.0 ** np.arange(-1070, 1023, 9)), [0.0]]))
    values = np.concatenate([values, [-np.inf, np.inf], 1 + np.arange(300) * 2.0**-40, -1 - np.arange(300) * 2.0**-40])
    df = scale._with_leaf(spark.createDataFrame(pd.DataFrame({"v": np.unique(values)})), "v")
    keys = [(r._octave, r._slot, r._fine) for r in df.orderBy("v").collect()]
    assert keys == sorted(keys) and len({k for k in keys if k[:2] == (1100, 65536)}) > 10


def test_average_ranks_match_pandas(spark):
    values = [3, 1, 3, 3, 2, 1, 9]
    df = spark.createDataFrame([(v,) for v in values], "v int").groupBy("v").agg(F.count("*").alias("n"))
    got = {r.v: r["rank"] for r in scale.average_ranks(df, "v", "n").collect()}
    assert [got[v] for v in values] == pd.Series(values).rank().tolist()


def test_category_ranks_and_mode(spark):
    df = spark.createDataFrame([("No",), ("No",), ("No",), ("Yes",), (None,), (" ",)], "c string")
    rows = {r.category: r for r in category.category_frequencies(df, ["c"]).collect()}
    assert (rows["No"].rank, rows["Yes"].rank) == (1, 2) and rows["No"].share == 0.75 and rows["No"].dominant
    summary = one(category.category_summary(df, ["c"], {"c": ["No", "Yes", "Maybe"]}))
    assert summary["mode"] == "No" and summary["missing"] == 1 and summary["blank"] == 1
    assert summary["missing_expected_categories"] == 1
    assert summary["status"] == "Missing values, Blank values, Missing expected categories, Rare categories"


def test_tied_categories_share_a_rank(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "c string")
    ranks = {r.category: r["rank"] for r in category.category_frequencies(df, ["c"]).collect()}
    assert ranks == {"c": 1, "a": 2, "b": 2}


def test_integer_categories_and_variants(spark):
    df = spark.createDataFrame([(0, "Yes"), (1, " yes"), (1, "YES "), (1, "No")], "s int, c string")
    variants = category.label_variants(df, ["s", "c"]).collect()
    assert {r.category for r in variants} == {"Yes", " yes", "YES "} and {r.rows for r in variants} == {3}
    issues = category.domain_violations(df, {"s": [0, 2], "c": ["yes"]}).collect()
    assert {(r.feature, r.issue, r.category) for r in issues} == {
        ("s", "Unexpected categories", "1"),
        ("s", "Missing expected categories", "2"),
        ("c", "Unexpected categories", "No"),
    }


def test_grouping_unassigned_and_issues(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "c string")
    groups = {"g1": ["a", "b"], "g2": ["b", "z"]}
    rows = {r.group: r.n for r in category.category_grouping(df, "c", groups).collect()}
    assert rows == {"g1": 1, "g2": 0, "Unassigned": 3}
    issues = {(r.issue, r.category) for r in category.grouping_issues(df, "c", groups).collect()}
    assert issues == {
        ("Unknown grouping categories", "z"),
        ("Categories assigned to multiple groups", "b"),
        ("Ungrouped categories", "c"),
    }


def test_target_roles(spark):
    df = spark.createDataFrame([("No",), ("Yes",), ("No",), ("Yes",)], "t string")
    rows = target.class_distribution(df, "t", ["No", "Yes"], "Yes").orderBy("expected_order").collect()
    assert [r.role for r in rows] == ["Tied / Negative", "Tied / Positive"]
    assert one(target.imbalance_summary(df, "t", "Yes"))["imbalance_ratio"] == 1.0
    more = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] + [("d",)] + [(None,)], "t string")
    roles = {r["class"]: r.role for r in target.class_distribution(more, "t", ["a", "e"]).collect()}
    assert roles == {"a": "Majority", "b": "Intermediate", "c": "Tied minority", "d": "Tied minority", "e": "Absent expected"}
    issues = {(r.issue, r["class"], r.n) for r in target.target_issues(more, "t", ["a", "b", "c", "e"]).collect()}
    assert issues == {
        ("Missing target values", "<missing>", 1),
        ("Missing expected classes", "e", 0),
        ("Unexpected classes", "d", 1),
    }


def largest_leaf(df, value):
    """Most rows that one task orders, as a share of all."""
    keyed = scale._with_leaf(df, value)
    leaves = scale._leaf_offsets(keyed.withColumn("n", F.lit(1)), [], ["n"], "count(*)", False)
    parts = scale._in_parts(keyed, leaves, ["_octave", "_slot"]).groupBy("_octave", "_slot", "_fine").count()
    return parts.agg(F.max("count") / F.sum("count")).first()[0]


@pytest.mark.parametrize(
    ("values", "share"),
    [
        ("id * 7 + 1700000000000000", 0.02),
        ("if(id = 0, 0, 1700000000000000 + id * 31)", 0.02),
        ("if(id = 0, 0.001D, 0.999D + id * 1e-9)", 0.02),
        ("if(id = 0, -5.0D, -1e12D - id / 64)", 0.02),
        ("if(id < 3, id, if(id < 9, 1e15D + id, 1e15D + 1e9D + id))", 0.05),  # 8,192 neighbours share 36 bits
    ],
)
def test_values_close_to_each_other_are_ordered_in_small_parts(spark, values, share):
    df = spark.range(200_000).selectExpr(f"cast({values} as double) as v", "1L as n")
    assert largest_leaf(df, "v") < share
    ranked = scale.average_ranks(df, "v", "n").select("v", "rank").toPandas().sort_values("v")
    assert ranked["rank"].tolist() == list(range(1, 200_001))
    down = scale.ordered_totals(df, "v", ["n"], descending=True).toPandas().sort_values("v")
    assert down.cum_n.tolist() == list(range(200_000, 0, -1))
    found = scale.exact_quantiles(df, "v", {"q1": 0.25, "m": 0.5, "q9": 0.99}).first()
    want = np.quantile(df.toPandas().v, [0.25, 0.5, 0.99])
    assert [found.q1, found.m, found.q9] == pytest.approx(list(want), rel=1e-15)


def test_numeric_stats_of_stamps_beside_a_zero(spark):
    df = spark.range(200_000).selectExpr("if(id = 0, 0L, 1700000000000000L + id * 13) as stamp")
    row = numeric.numeric_stats(df, ["stamp"]).first()
    q1, median, q3 = np.quantile(df.toPandas().stamp, [0.25, 0.5, 0.75])
    assert (row.q1, row.median, row.q3, row.minimum, row.unique_values, row.outliers) == (q1, median, q3, 0, 200_000, 1)
