"""Evidence linking features to a binary target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.stats import entropy, n_log_n, odds_ratio, ratio, uncertainty, wilson
from .relations import _labels, _numbers
from .scale import at, by_name, exact_quantiles, literal_table, one_row, quantile_edges, unpivot

# Default support and review limits.
MINIMUM_GROUP = 50
EFFECT_REVIEW = 0.50
ASSOCIATION_REVIEW = 0.20
RATE_REVIEW = 0.10


@dataclass(frozen=True)
class BinaryTarget:
    """A label column with its two declared classes."""

    column: str
    positive: object
    negative: object

    def labelled(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.column).isin([self.positive, self.negative]))

    def hit(self) -> Column:
        return (F.col(self.column) == F.lit(self.positive)).cast("int")


def overall_rate(df: DataFrame, target: BinaryTarget) -> Column:
    """Prevalence among labelled rows as a scalar subquery."""
    return target.labelled(df).agg(F.avg(target.hit().cast("double")).alias("rate")).scalar()


def _long(df: DataFrame, features: Sequence[str], target: BinaryTarget) -> DataFrame:
    rows = target.labelled(df).withColumn("hit", target.hit())
    return unpivot(rows, _numbers(df, features), ["hit"]).where(F.col("value").isNotNull())


# --------------------------------------------------------------------------
# F1, F2


def _class_moments(df: DataFrame, features: Sequence[str], target: BinaryTarget) -> DataFrame:
    numbers = _numbers(df, features)
    rows = target.labelled(df).select(
        target.hit().alias("hit"), *[numbers[f].alias(f"v{i}") for i, f in enumerate(features)]
    )
    measures = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "variance": F.var_samp, "minimum": F.min, "maximum": F.max}
    wide = rows.groupBy("hit").agg(
        F.count("*").alias("rows"),
        *[f(F.col(f"v{i}")).alias(f"{k}{i}") for i in range(len(features)) for k, f in measures.items()],
    )
    entries = [
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{k}{i}").alias(k) for k in measures])
        for i, f in enumerate(features)
    ]
    return wide.select("hit", "rows", F.inline(F.array(*entries)))


def numeric_by_class(df: DataFrame, features: Sequence[str], target: BinaryTarget) -> DataFrame:
    """Moments and exact quartiles per (feature, class)."""
    quart = exact_quantiles(
        _long(df, features, target), "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["feature", "hit"]
    )
    shown = F.when(F.col("hit") == 1, F.lit(str(target.positive))).otherwise(F.lit(str(target.negative)))
    return (
        _class_moments(df, features, target)
        .join(quart, ["feature", "hit"], "left")
        .select(
            "feature",
            shown.alias("target_class"),
            "rows",
            F.col("n").alias("valid"),
            "mean",
            "median",
            "std",
            "minimum",
            "maximum",
            (F.col("q3") - F.col("q1")).alias("iqr"),
        )
    )


def numeric_effect(
    df: DataFrame,
    features: Sequence[str],
    target: BinaryTarget,
    *,
    bins: int = 10,
    effect_review: float = EFFECT_REVIEW,
    rate_review: float = RATE_REVIEW,
) -> DataFrame:
    """Differences, point-biserial r, Cohen's d, eta squared and review flag."""
    shares = quantile_bin_rates(df, features, target, bins=bins)
    spread = shares.groupBy("feature").agg((F.max("rate") - F.min("rate")).alias("spread"))
    medians = exact_quantiles(_long(df, features, target), "value", {"median": 0.5}, ["feature", "hit"])
    table = _class_moments(df, features, target).join(medians, ["feature", "hit"], "left")

    def side(name: str, hit: int) -> Column:
        return F.max(F.when(F.col("hit") == hit, F.col(name)))

    wide = table.groupBy("feature").agg(
        F.sum("rows").alias("rows"),
        *[side(c, h).alias(f"{c}_{h}") for c in ("n", "mean", "median", "variance") for h in (0, 1)],
    )
    n1, n0 = F.coalesce("n_1", F.lit(0)), F.coalesce("n_0", F.lit(0))
    n = n1 + n0
    gap = F.col("mean_1") - F.col("mean_0")
    within = F.coalesce((n1 - 1) * F.col("variance_1"), F.lit(0.0)) + F.coalesce((n0 - 1) * F.col("variance_0"), F.lit(0.0))
    between = F.coalesce(F.try_divide((n1 * n0).cast("double"), n.cast("double")) * gap * gap, F.lit(0.0))
    total = within + between
    eta = F.when(total > 0, F.try_divide(between, total))
    pooled = F.try_divide(within, (n - 2).cast("double"))
    d = F.when((n1 >= 2) & (n0 >= 2) & (pooled > 0), gap / F.sqrt(F.when(pooled > 0, pooled)))
    out = wide.select(
        "feature",
        n.alias("valid_rows"),
        (F.col("rows") - n).alias("missing_rows"),
        n1.alias("positive_count"),
        n0.alias("negative_count"),
        F.col("mean_1").alias("positive_mean"),
        F.col("mean_0").alias("negative_mean"),
        gap.alias("mean_difference"),
        F.col("median_1").alias("positive_median"),
        F.col("median_0").alias("negative_median"),
        (F.col("median_1") - F.col("median_0")).alias("median_difference"),
        F.when((n1 > 0) & (n0 > 0), F.signum(gap) * F.sqrt(eta)).alias("point_biserial"),
        d.alias("cohens_d"),
        F.abs(d).alias("abs_cohens_d"),
        eta.alias("eta_squared"),
    ).withColumn("_s", at(by_name(spread, "feature", ["spread"]), F.col("feature")))
    review = F.coalesce(F.col("abs_cohens_d") >= effect_review, F.lit(False)) | F.coalesce(
        F.col("rate_spread") >= rate_review, F.lit(False)
    )
    label = (
        F.when(F.col("cohens_d").isNull(), "Insufficient variation for standardized effect")
        .when(F.col("review") & (F.col("cohens_d") > 0), "Positive class is associated with higher values; review for modeling")
        .when(F.col("review"), "Positive class is associated with lower values; review for modeling")
        .when(F.col("abs_cohens_d") >= effect_review / 2, "Limited-to-moderate numerical target separation")
        .otherwise("Limited numerical target separation")
    )
    return (
        out.withColumn("rate_spread", F.col("_s.spread"))
        .drop("_s")
        .withColumn("review", review)
        .withColumn("interpretation", label)
    )


# --------------------------------------------------------------------------
# F3


def bin_of(value: str, edges: str, bins: int) -> Column:
    """1 + number of edges after the first that lie strictly below the value."""
    above = [f"case when get({edges}, {i}) < {value} then 1 else 0 end" for i in range(1, bins)]
    return F.expr(" + ".join(["1", *above]))


def quantile_bin_rates(
    df: DataFrame,
    features: Sequence[str],
    target: BinaryTarget,
    *,
    bins: int = 10,
    minimum_group: int = MINIMUM_GROUP,
) -> DataFrame:
    """Positive rate per quantile bin (lo, hi], lowest value included.

    Edges are true quantiles; equal edges merge, so hot values widen a bin.
    """
    long = _long(df, features, target)
    lookup = by_name(quantile_edges(long, "value", bins, ["feature"]), "feature", ["edges"])
    placed = long.withColumn("_e", at(lookup, F.col("feature")))
    counts = (
        placed.select("feature", bin_of("value", "_e.edges", bins).alias("bin"), "hit")
        .groupBy("feature", "bin")
        .agg(F.count("*").alias("n"), F.sum("hit").cast("bigint").alias("positives"))
    )
    several = F.size("edges") > 1
    # The same one-row lookup, opened up: one row per feature and bin.
    edges = df.sparkSession.range(1).select(F.explode(lookup).alias("feature", "_e")).select("feature", "_e.edges")
    grid = edges.where(several).select(
        "feature",
        "edges",
        F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"),
    ).select(
        "feature",
        "bin",
        F.get("edges", F.col("bin") - 1).alias("lower_bound"),
        F.get("edges", F.col("bin")).alias("upper_bound"),
    )
    rate_all = overall_rate(df, target)
    n, pos = F.coalesce("n", F.lit(0)), F.coalesce("positives", F.lit(0))
    rate = ratio(pos, n)
    return (
        grid.join(counts, ["feature", "bin"], "left")
        .withColumn("overall_rate", rate_all)
        .select(
            "feature",
            "bin",
            "lower_bound",
            "upper_bound",
            n.alias("n"),
            pos.alias("positives"),
            (n - pos).alias("negatives"),
            rate.alias("rate"),
            "overall_rate",
            (rate - F.col("overall_rate")).alias("rate_difference"),
            ratio(rate, F.col("overall_rate")).alias("lift"),
            (n < minimum_group).alias("low_support"),
        )
    )


# --------------------------------------------------------------------------
# F4 - F8


def category_rates(
    df: DataFrame,
    features: Sequence[str],
    target: BinaryTarget,
    expected: Mapping[str, Sequence] | None = None,
    *,
    minimum_group: int = MINIMUM_GROUP,
) -> DataFrame:
    """Positive rate, lift, odds ratio and Wilson bounds per category.

    One scan and one shuffle of (feature, category) counts; declared categories
    without rows are kept with zero counts.
    """
    expected = expected or {}
    rows = target.labelled(df).withColumn("hit", target.hit())
    long = unpivot(rows, _labels(df, features, strip_text=True), ["hit"], value="category")
    counts = (
        long.where(F.col("category").isNotNull())
        .groupBy("feature", "category")
        .agg(F.count("*").alias("n"), F.sum("hit").cast("bigint").alias("positives"))
        .withColumn("expected_order", F.lit(None).cast("int"))
    )
    declared = [
        {"feature": f, "category": str(v), "n": 0, "positives": 0, "expected_order": i}
        for f, values in expected.items()
        for i, v in enumerate(values, 1)
    ]
    if declared:
        schema = pa.schema(
            [("feature", pa.string()), ("category", pa.string()), ("n", pa.int64()), ("positives", pa.int64()), ("expected_order", pa.int32())]
        )
        counts = (
            counts.unionByName(literal_table(df.sparkSession, declared, schema))
            .groupBy("feature", "category")
            .agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.min("expected_order").alias("expected_order"))
        )
    totals = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    table = counts.withColumns(
        {"_t": at(by_name(totals, "feature", ["n", "positives"]), F.col("feature")), "overall_rate": overall_rate(df, target)}
    )
    n, pos = F.col("n"), F.col("positives")
    neg, rest_pos = n - pos, F.col("_t.positives") - pos
    rest_neg = F.col("_t.n") - n - rest_pos
    rate = ratio(pos, n)
    lower, upper = wilson(pos, n)
    return table.select(
        "feature",
        "category",
        "expected_order",
        n.alias("n"),
        pos.alias("positives"),
        neg.alias("negatives"),
        rate.alias("rate"),
        "overall_rate",
        (rate - F.col("overall_rate")).alias("rate_difference"),
        ratio(rate, F.col("overall_rate")).alias("lift"),
        odds_ratio(pos, neg, rest_pos, rest_neg).alias("odds_ratio"),
        lower.alias("wilson_lower"),
        upper.alias("wilson_upper"),
        (n < minimum_group).alias("low_support"),
        F.col("expected_order").isNotNull().alias("expected"),
    )


def categorical_effect(
    df: DataFrame,
    features: Sequence[str],
    target: BinaryTarget,
    expected: Mapping[str, Sequence] | None = None,
    *,
    minimum_group: int = MINIMUM_GROUP,
    association_review: float = ASSOCIATION_REVIEW,
    rate_review: float = RATE_REVIEW,
) -> DataFrame:
    """Cramér's V, U(target | feature) and rate spread, from category counts only."""
    rates = category_rates(df, features, target, expected, minimum_group=minimum_group)
    seen = rates.where(F.col("n") > 0)
    n, pos = F.col("n").cast("double"), F.col("positives").cast("double")
    neg = n - pos
    per = seen.groupBy("feature").agg(
        F.sum("n").alias("valid_rows"),
        F.sum("positives").alias("p"),
        F.count("*").alias("categories"),
        F.sum(pos * pos / n).alias("_pp"),
        F.sum(neg * neg / n).alias("_nn"),
        F.sum(n_log_n(F.col("n"))).alias("_hx"),
        F.sum(n_log_n(F.col("positives")) + n_log_n(F.col("negatives"))).alias("_hxy"),
        F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"),
        F.sum(n * F.abs("rate_difference")).alias("_w"),
        F.count_if("low_support").alias("low_support_categories"),
    )
    total = F.col("valid_rows").cast("double")
    p1, p0 = F.col("p").cast("double"), (F.col("valid_rows") - F.col("p")).cast("double")
    both = (p1 > 0) & (p0 > 0) & (F.col("categories") > 1)
    phi = F.try_divide(F.col("_pp"), p1) + F.try_divide(F.col("_nn"), p0) - 1
    hy = entropy(n_log_n(F.col("p")) + n_log_n(F.col("valid_rows") - F.col("p")), F.col("valid_rows"))
    hx, hxy = entropy(F.col("_hx"), F.col("valid_rows")), entropy(F.col("_hxy"), F.col("valid_rows"))
    all_rows = target.labelled(df).agg(F.count("*").alias("n")).scalar()
    out = per.withColumn("_all", all_rows).select(
        "feature",
        "valid_rows",
        (F.col("_all") - F.col("valid_rows")).alias("missing_rows"),
        "categories",
        F.when(both, F.sqrt(F.greatest(phi, F.lit(0.0)))).alias("cramers_v"),
        F.when(both, uncertainty(hy, hx, hxy)).alias("u_target_given_feature"),
        "min_rate",
        "max_rate",
        (F.col("max_rate") - F.col("min_rate")).alias("rate_spread"),
        F.try_divide(F.col("_w"), total).alias("weighted_abs_difference"),
        "low_support_categories",
    )
    review = F.coalesce(F.col("cramers_v") >= association_review, F.lit(False)) | F.coalesce(
        F.col("rate_spread") >= rate_review, F.lit(False)
    )
    label = (
        F.when(F.col("cramers_v").isNull(), "Insufficient variation for categorical association")
        .when(F.col("review"), "Category rates merit modeling review")
        .when(F.col("cramers_v") >= association_review / 2, "Limited-to-moderate categorical target association")
        .otherwise("Limited categorical target association")
    )
    return out.withColumn("review", review).withColumn("interpretation", label)


# --------------------------------------------------------------------------
# F8 - F10


def review_flags(df: DataFrame, numerical: Sequence[str], categorical: Sequence[str], target: BinaryTarget) -> DataFrame:
    """Effect size, rate spread and review flag of every feature of both kinds."""
    num = numeric_effect(df, numerical, target).select(
        "feature", F.lit("numerical").alias("kind"), F.col("abs_cohens_d").alias("effect"), "rate_spread", "review"
    )
    cat = categorical_effect(df, categorical, target).select(
        "feature", F.lit("categorical").alias("kind"), F.col("cramers_v").alias("effect"), "rate_spread", "review"
    )
    return num.unionByName(cat)


def association_ranking(df: DataFrame, numerical: Sequence[str], categorical: Sequence[str], target: BinaryTarget) -> DataFrame:
    """Features of each kind ordered by effect size (name breaks ties)."""
    flags = review_flags(df, numerical, categorical, target)
    # One row per declared feature.
    order = Window.partitionBy("kind").orderBy(F.desc_nulls_last("effect"), "feature")
    return flags.select("kind", "feature", "effect", F.row_number().over(order).alias("position"))


def target_study_summary(
    df: DataFrame,
    numerical: Sequence[str],
    categorical: Sequence[str],
    target: BinaryTarget,
    *,
    minimum_group: int = MINIMUM_GROUP,
) -> DataFrame:
    """Study-level counts: rows, features, label gaps, candidates, low support."""
    have_num = [c for c in numerical if c in df.columns]
    have_cat = [c for c in categorical if c in df.columns]
    dtype = df.schema[target.column].dataType
    label = F.col(target.column)
    whole = df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(text.missing(label, dtype)).alias("missing_labels"),
        (F.max((label == F.lit(target.positive)).cast("int")) + F.max((label == F.lit(target.negative)).cast("int"))).alias("classes"),
    )
    num = one_row(numeric_effect(df, have_num, target).agg(F.count_if("review").alias("review")))
    cat = one_row(categorical_effect(df, have_cat, target).agg(F.count_if("review").alias("review")))
    low_bins = one_row(
        quantile_bin_rates(df, have_num, target, minimum_group=minimum_group).agg(F.count_if("low_support").alias("n"))
    )
    low_cats = one_row(
        category_rates(df, have_cat, target, minimum_group=minimum_group).agg(F.count_if("low_support").alias("n"))
    )
    packed = whole.withColumns({"_n": num, "_c": cat, "_b": low_bins, "_k": low_cats})

    def fixed(v: int) -> Column:
        return F.lit(v).cast("bigint")

    lines = [
        ("Total rows", F.col("total_rows")),
        ("Requested numerical features", fixed(len(numerical))),
        ("Available numerical features", fixed(len(have_num))),
        ("Requested categorical features", fixed(len(categorical))),
        ("Available categorical features", fixed(len(have_cat))),
        ("Missing target values", F.col("missing_labels")),
        ("Observed target classes", F.col("classes").cast("bigint")),
        ("Numerical review candidates", F.col("_n.review")),
        ("Categorical review candidates", F.col("_c.review")),
        ("Low-support groups", F.col("_b.n") + F.col("_k.n")),
    ]
    return packed.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in lines])))
