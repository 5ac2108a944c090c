"""Numerical projection, moments, quantiles and interquartile outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.stats import adjusted_skewness, ratio_or_zero
from .scale import at, by_name, exact_quantiles, unpivot


@dataclass(frozen=True)
class BlankRule:
    """Blank text in ``column`` means ``fill`` where ``condition_column`` equals ``condition_value``."""

    column: str
    condition_column: str
    condition_value: object
    fill: float


@dataclass(frozen=True)
class Projected:
    """Column expressions for one feature of the numeric projection."""

    value: Column
    missing: Column
    blank: Column
    materialized: Column
    condition_failure: Column
    non_numeric: Column


def project(df: DataFrame, feature: str, rule: BlankRule | None = None) -> Projected:
    dtype = df.schema[feature].dataType
    raw = F.col(f"`{feature}`")
    missing, blank = text.missing(raw, dtype), text.blank(raw, dtype)
    number = text.to_number(raw, dtype)
    filled = failed = F.lit(False)
    if rule is not None:
        holds = F.coalesce(F.col(rule.condition_column) == F.lit(rule.condition_value), F.lit(False))
        filled, failed = blank & holds, blank & ~holds
        number = F.when(filled, F.lit(float(rule.fill))).otherwise(number)
    non_numeric = ~missing & ~blank & number.isNull()
    return Projected(number, missing, blank, filled, failed, non_numeric)


def numeric_projection(
    df: DataFrame, features: Sequence[str], rules: Mapping[str, BlankRule] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Doubles per feature plus flags for filled blanks and failed conversions."""
    rules = rules or {}
    out = [F.col(c) for c in keep]
    for f in features:
        p = project(df, f, rules.get(f))
        out += [
            p.value.alias(f),
            p.materialized.alias(f"{f}_materialized"),
            p.condition_failure.alias(f"{f}_condition_failure"),
            p.non_numeric.alias(f"{f}_non_numeric"),
        ]
    return df.select(*out)


def _long(df: DataFrame, features: Sequence[str], rules: Mapping[str, BlankRule] | None, keep: Sequence[str] = ()) -> DataFrame:
    rules = rules or {}
    return unpivot(df, {f: project(df, f, rules.get(f)).value for f in features}, keep).where(F.col("value").isNotNull())


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def quartiles(df: DataFrame, features: Sequence[str], rules: Mapping[str, BlankRule] | None = None) -> DataFrame:
    return exact_quantiles(_long(df, features, rules), "value", QUARTILES, ["feature"])


def _moments(df: DataFrame, features: Sequence[str], rules: Mapping[str, BlankRule] | None) -> DataFrame:
    """Counts and moments of all features from one scan and a one-row shuffle."""
    rules = rules or {}
    parts: list[Column] = [F.count("*").alias("rows")]
    entries = []
    for i, f in enumerate(features):
        p = project(df, f, rules.get(f))
        v = p.value
        named = {
            "valid": F.count(v),
            "missing": F.count_if(p.missing),
            "blank": F.count_if(p.blank),
            "materialized": F.count_if(p.materialized),
            "non_numeric": F.count_if(p.non_numeric | p.condition_failure),
            "zero": F.count_if(v == 0),
            "negative": F.count_if(v < 0),
            "minimum": F.min(v),
            "mean": F.avg(v),
            "maximum": F.max(v),
            "std": F.stddev_samp(v),
            "variance": F.var_samp(v),
            "g1": F.skewness(v),
        }
        parts += [e.alias(f"{k}_{i}") for k, e in named.items()]
        entries.append(
            F.struct(F.lit(f).alias("feature"), F.col("rows"), *[F.col(f"{k}_{i}").alias(k) for k in named])
        )
    return df.agg(*parts).select(F.inline(F.array(*entries)))


def numeric_stats(
    df: DataFrame,
    features: Sequence[str],
    rules: Mapping[str, BlankRule] | None = None,
    *,
    k: float = 1.5,
) -> DataFrame:
    """Full profile of each feature, one row per feature.

    Moments: one scan, no row expansion.  Quartiles: two passes that shuffle only
    leaf counts.  Unique counts: the one shuffle of distinct values exactness needs.
    Outlier counts: a further scan against the fences held in a scalar map.
    """
    rules = rules or {}
    moments = _moments(df, features, rules)
    quart = by_name(quartiles(df, features, rules), "feature", list(QUARTILES))
    unique = (
        _long(df, features, rules)
        .groupBy("feature", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("feature")
        .agg(F.count("*").alias("unique_values"))
    )
    unique = by_name(unique, "feature", ["unique_values"])
    outside = by_name(_outlier_counts(df, features, rules, k), "feature", ["lower_outliers", "upper_outliers"])
    base = moments.withColumns(
        {"_q": at(quart, F.col("feature")), "_u": at(unique, F.col("feature")), "_o": at(outside, F.col("feature"))}
    )
    iqr = F.col("_q.q3") - F.col("_q.q1")
    lower, upper = F.coalesce(F.col("_o.lower_outliers"), F.lit(0)), F.coalesce(F.col("_o.upper_outliers"), F.lit(0))
    return base.select(
        "feature",
        "rows",
        "valid",
        "missing",
        "blank",
        "materialized",
        "non_numeric",
        F.coalesce(F.col("_u.unique_values"), F.lit(0)).alias("unique_values"),
        "zero",
        "negative",
        "minimum",
        F.col("_q.q1").alias("q1"),
        F.col("_q.median").alias("median"),
        "mean",
        F.col("_q.q3").alias("q3"),
        "maximum",
        (F.col("maximum") - F.col("minimum")).alias("range"),
        "std",
        "variance",
        iqr.alias("iqr"),
        adjusted_skewness(F.col("g1"), F.col("valid"), F.col("minimum"), F.col("maximum")).alias("skewness"),
        (F.col("_q.q1") - k * iqr).alias("lower_fence"),
        (F.col("_q.q3") + k * iqr).alias("upper_fence"),
        lower.alias("lower_outliers"),
        upper.alias("upper_outliers"),
        (lower + upper).alias("outliers"),
        ratio_or_zero(lower + upper, F.col("valid")).alias("outlier_share"),
        F.when(F.col("non_numeric") > 0, "Review required").otherwise("Analyzed").alias("status"),
    )


def _with_fences(long: DataFrame, quart: DataFrame, k: float) -> DataFrame:
    q = at(by_name(quart, "feature", ["q1", "q3"]), F.col("feature"))
    spread = F.col("_q.q3") - F.col("_q.q1")
    return long.withColumn("_q", q).withColumns(
        {"lower_fence": F.col("_q.q1") - k * spread, "upper_fence": F.col("_q.q3") + k * spread}
    ).drop("_q")


def _outlier_counts(df: DataFrame, features: Sequence[str], rules: Mapping[str, BlankRule] | None, k: float) -> DataFrame:
    fenced = _with_fences(_long(df, features, rules), quartiles(df, features, rules), k)
    found = fenced.groupBy("feature").agg(
        F.count("*").alias("valid"),
        F.count_if(F.col("value") < F.col("lower_fence")).alias("lower_outliers"),
        F.count_if(F.col("value") > F.col("upper_fence")).alias("upper_outliers"),
        F.max("lower_fence").alias("lower_fence"),
        F.max("upper_fence").alias("upper_fence"),
    )
    # features without a valid value keep a row
    place = F.array(*[F.lit(f) for f in features])
    declared = df.sparkSession.range(len(features)).select(place[F.col("id").cast("int")].alias("feature"))
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("valid", "lower_outliers", "upper_outliers")}
    return declared.join(found, "feature", "left").withColumns(counts)


def iqr_outlier_summary(
    df: DataFrame, features: Sequence[str], rules: Mapping[str, BlankRule] | None = None, *, k: float = 1.5
) -> DataFrame:
    """Fences and strict lower / upper outlier counts per feature."""
    counts = _outlier_counts(df, features, rules, k)
    total = F.col("lower_outliers") + F.col("upper_outliers")
    label = F.when(total > 0, "Candidate outliers require contextual review").otherwise("No IQR outlier candidates")
    return counts.select(
        "feature",
        "lower_fence",
        "upper_fence",
        "lower_outliers",
        "upper_outliers",
        total.alias("outliers"),
        ratio_or_zero(total, F.col("valid")).alias("outlier_share"),
        label.alias("interpretation"),
    )


def iqr_outliers(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    rules: Mapping[str, BlankRule] | None = None,
    *,
    k: float = 1.5,
    top: int | None = None,
) -> DataFrame:
    """Outlying cells with direction and fences; ``top`` keeps the first by key per feature."""
    fenced = _with_fences(_long(df, features, rules, key), quartiles(df, features, rules), k)
    low, high = F.col("value") < F.col("lower_fence"), F.col("value") > F.col("upper_fence")
    found = fenced.where(low | high).withColumn("direction", F.when(low, "Lower").otherwise("Upper"))
    if top is None:
        return found
    order = Window.partitionBy("feature").orderBy(*key)
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


# Labels of the two conversion issues.
CONVERSION_ISSUES = ("Non-numeric value", "Materialization condition not satisfied")


def _conversion_failures(df: DataFrame, features: Sequence[str], rules: Mapping[str, BlankRule], key: Sequence[str]) -> DataFrame:
    entries = []
    for f in features:
        p = project(df, f, rules.get(f))
        for issue, mask in zip(CONVERSION_ISSUES, (p.non_numeric, p.condition_failure)):
            raw = F.col(f"`{f}`").cast("string")
            entries.append(F.when(mask, F.struct(F.lit(f).alias("feature"), F.lit(issue).alias("issue"), raw.alias("raw_value"))))
    return df.select(*key, F.inline(F.array_compact(F.array(*entries))))


def conversion_issues(df: DataFrame, features: Sequence[str], rules: Mapping[str, BlankRule] | None = None) -> DataFrame:
    """Failed conversions counted per (feature, issue)."""
    return _conversion_failures(df, features, rules or {}, []).groupBy("feature", "issue").agg(F.count("*").alias("n"))


def conversion_issue_samples(
    df: DataFrame, features: Sequence[str], key: Sequence[str], rules: Mapping[str, BlankRule] | None = None, k: int = 10
) -> DataFrame:
    """First k failing raw values per (feature, issue) in key order."""
    failing = _conversion_failures(df, features, rules or {}, key)
    order = Window.partitionBy("feature", "issue").orderBy(*key)
    return failing.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def numeric_summary(
    df: DataFrame, features: Sequence[str], rules: Mapping[str, BlankRule] | None = None, *, k: float = 1.5
) -> DataFrame:
    """Eight study-level counts."""
    available = [f for f in features if f in df.columns]
    profile = numeric_stats(df, available, rules, k=k)
    totals = profile.agg(
        F.count_if(F.col("missing") > 0).alias("c3"),
        F.count_if(F.col("blank") > 0).alias("c4"),
        F.sum("materialized").alias("c5"),
        F.count_if(F.col("non_numeric") > 0).alias("c6"),
        F.count_if(F.col("outliers") > 0).alias("c7"),
    )
    lines = [
        ("Requested numerical features", F.lit(len(features)).cast("bigint")),
        ("Available numerical features", F.lit(len(available)).cast("bigint")),
        ("Missing numerical features", F.lit(len(features) - len(available)).cast("bigint")),
        ("Features with missing values", F.col("c3")),
        ("Features with blank values", F.col("c4")),
        ("Materialized projection values", F.col("c5")),
        ("Features with conversion issues", F.col("c6")),
        ("Features with outlier candidates", F.col("c7")),
    ]
    return totals.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in lines])))
