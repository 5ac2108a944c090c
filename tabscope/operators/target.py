"""Distribution of a label: classes, roles, imbalance, issues."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import ratio, ratio_or_zero
from .scale import literal_table, one_row


def with_domain(
    counts: DataFrame, value: str, expected: Sequence, measures: Sequence[str], *, order: str = "expected_order"
) -> DataFrame:
    """Observed counts joined outer with a declared domain, zeros kept.

    Done as union plus aggregation: no join, and unexpected values stay.
    """
    shown = [str(v) for v in expected]
    schema = pa.schema([("v", pa.string()), ("o", pa.int32())])
    domain = literal_table(
        counts.sparkSession, [{"v": v, "o": i} for i, v in enumerate(shown, 1)], schema
    ).select(F.col("v").alias(value), *[F.lit(0).cast("bigint").alias(m) for m in measures], F.col("o").alias(order))
    observed = counts.select(
        F.col(value).cast("string").alias(value), *measures, F.lit(None).cast("int").alias(order)
    )
    merged = observed.unionByName(domain).groupBy(value)
    return merged.agg(*[F.sum(m).alias(m) for m in measures], F.min(order).alias(order))


def _class_counts(df: DataFrame, target: str) -> DataFrame:
    dtype = df.schema[target].dataType
    col = F.col(target)
    return (
        df.where(~text.missing(col, dtype))
        .groupBy(col.cast("string").alias("class"))
        .agg(F.count("*").alias("n"))
    )


def class_distribution(
    df: DataFrame, target: str, expected: Sequence = (), positive: object | None = None
) -> DataFrame:
    """Count, share, expected flag and role of every declared or observed class."""
    table = with_domain(_class_counts(df, target), "class", expected, ["n"])
    seen = F.col("n") > 0
    extremes = table.agg(
        F.sum("n").alias("total"),
        F.max(F.when(seen, F.col("n"))).alias("top"),
        F.min(F.when(seen, F.col("n"))).alias("low"),
    )
    counts = table.groupBy("n").agg(F.count("*").alias("classes"))
    ties = counts.agg(F.max_by("classes", "n").alias("top_classes"), F.min_by("classes", F.when(F.col("n") > 0, F.col("n"))).alias("low_classes"))
    x, t = one_row(extremes), one_row(ties)
    n = F.col("n")
    role = (
        F.when(n == 0, "Absent expected")
        .when((n == F.col("_x.top")) & (F.col("_t.top_classes") > 1), "Tied")
        .when(n == F.col("_x.top"), "Majority")
        .when((n == F.col("_x.low")) & (F.col("_t.low_classes") > 1), "Tied minority")
        .when(n == F.col("_x.low"), "Minority")
        .otherwise("Intermediate")
    )
    if positive is not None:
        side = F.when(F.col("class") == str(positive), " / Positive").otherwise(" / Negative")
        role = F.concat(role, side)
    is_expected = F.col("expected_order").isNotNull() if expected else F.lit(True)
    return table.withColumns({"_x": x, "_t": t}).select(
        "class",
        "n",
        ratio_or_zero(n, F.col("_x.total")).alias("share"),
        is_expected.alias("expected"),
        F.col("expected_order"),
        role.alias("role"),
    )


def imbalance_summary(df: DataFrame, target: str, positive: object | None = None, expected: Sequence = ()) -> DataFrame:
    """Majority and minority share, ratio, prevalence, baseline accuracy."""
    table = with_domain(_class_counts(df, target), "class", expected, ["n"])
    n, seen = F.col("n"), F.col("n") > 0
    top, low, total = F.max(F.when(seen, n)), F.min(F.when(seen, n)), F.sum(n)
    hits = F.sum(F.when(F.col("class") == str(positive), n).otherwise(0)) if positive is not None else F.lit(None).cast("bigint")
    out = table.agg(
        F.coalesce(total, F.lit(0)).alias("non_missing"),
        F.coalesce(top, F.lit(0)).alias("majority_count"),
        F.coalesce(low, F.lit(0)).alias("minority_count"),
        hits.alias("positive_count"),
    )
    share = ratio(F.col("majority_count"), F.col("non_missing"))
    return out.select(
        "*",
        share.alias("majority_share"),
        ratio(F.col("minority_count"), F.col("non_missing")).alias("minority_share"),
        ratio(F.col("majority_count"), F.col("minority_count")).alias("imbalance_ratio"),
        ratio(F.col("positive_count"), F.col("non_missing")).alias("positive_share"),
        share.alias("majority_baseline_accuracy"),
    )


def target_issues(df: DataFrame, target: str, expected: Sequence) -> DataFrame:
    """Missing labels, absent expected classes and unexpected classes."""
    dtype = df.schema[target].dataType
    lacking = (
        df.agg(F.count_if(text.missing(F.col(target), dtype)).alias("n"))
        .where(F.col("n") > 0)
        .select(F.lit("Missing target values").alias("issue"), F.lit("<missing>").alias("class"), "n")
    )
    table = class_distribution(df, target, expected)
    absent = F.col("expected") & (F.col("n") == 0)
    label = F.when(absent, "Missing expected classes").otherwise("Unexpected classes")
    odd = table.where(absent | ~F.col("expected")).select(label.alias("issue"), "class", "n")
    return lacking.unionByName(odd)
