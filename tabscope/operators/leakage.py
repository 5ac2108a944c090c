"""Columns that copy or encode the target, and keys shared by splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.stats import ratio
from .relations import categorical_pairs
from .scale import pair_counts

# Normalised labels that make a mapping a binary encoding.
BINARY_VALUES = ("0", "1", "true", "false")


def _kind(dtype: T.DataType) -> str:
    if text.is_text(dtype):
        return "text"
    if text.is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return "number"
    return dtype.simpleString()


def _folded(df: DataFrame, column: str) -> Column:
    """Comparison text of a value: folded text, or the plain value."""
    dtype, col = df.schema[column].dataType, F.col(f"`{column}`")
    if text.is_text(dtype):
        return text.fold(col)
    if text.is_floating(dtype):
        whole = F.when(F.abs(col) < 1e15, F.when(col == F.floor(col), F.floor(col).cast("string")))
        return F.when(~text.missing(col, dtype), F.coalesce(whole, col.cast("string")))
    return col.cast("string")


def target_copy_rate(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Exact and normalised match rates against the target, one scan for all columns."""
    t_type, t = df.schema[target].dataType, F.col(f"`{target}`")
    parts, entries = [], []
    for i, c in enumerate(columns):
        dtype, col = df.schema[c].dataType, F.col(f"`{c}`")
        paired = ~text.missing(col, dtype) & ~text.missing(t, t_type)
        if _kind(dtype) != _kind(t_type):
            same = fold = F.lit(False)
        elif _kind(dtype) == "number":
            same = fold = col.cast("double") == t.cast("double")
        else:
            same, fold = col == t, _folded(df, c) == _folded(df, target)
        parts += [
            F.count_if(paired).alias(f"n_{i}"),
            F.count_if(paired & same).alias(f"e_{i}"),
            F.count_if(paired & fold).alias(f"f_{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"n_{i}").alias("paired_rows"),
                F.col(f"e_{i}").alias("exact_matches"),
                F.col(f"f_{i}").alias("normalized_matches"),
                ratio(F.col(f"e_{i}"), F.col(f"n_{i}")).alias("exact_rate"),
                ratio(F.col(f"f_{i}"), F.col(f"n_{i}")).alias("normalized_rate"),
            )
        )
    return df.agg(*parts).select(F.inline(F.array(*entries)))


def mapping_determinism(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Whether each value implies one target, and each target one value.

    Distinct (value, target) cells are reduced by counting, never gathered.
    """
    values = {c: _folded(df, c) for c in [*columns, target]}
    cells = pair_counts(df, values, [(c, target) for c in columns])
    forward = (
        cells.groupBy("feature_a", "value_a")
        .agg(
            F.count("*").alias("targets"),
            F.sum("n").alias("n"),
            F.bool_and(F.col("value_a").isin(list(BINARY_VALUES))).alias("binary"),
        )
        .groupBy("feature_a")
        .agg(
            F.sum("n").alias("paired_rows"),
            F.count("*").alias("feature_values"),
            F.max("targets").alias("max_targets_per_value"),
            F.bool_and("binary").alias("binary_values"),
        )
    )
    reverse = (
        cells.groupBy("feature_a", "value_b")
        .agg(F.count("*").alias("vals"))
        .groupBy("feature_a")
        .agg(F.count("*").alias("target_values"), F.max("vals").alias("max_values_per_target"))
    )
    deterministic = F.col("max_targets_per_value") == 1
    return forward.join(reverse, "feature_a").select(
        F.col("feature_a").alias("feature"),
        "paired_rows",
        "feature_values",
        "target_values",
        "max_targets_per_value",
        "max_values_per_target",
        deterministic.alias("deterministic"),
        (deterministic & (F.col("max_values_per_target") == 1)).alias("bidirectional"),
        "binary_values",
    )


def proxy_class(df: DataFrame, columns: Sequence[str], target: str, identifiers: Sequence[str] = ()) -> DataFrame:
    """Columns that reproduce or encode the target, with method and severity."""
    joined = target_copy_rate(df, columns, target).join(
        mapping_determinism(df, columns, target).drop("paired_rows"), "feature"
    )
    n = F.col("paired_rows")
    exact = (n > 0) & (F.col("exact_matches") == n)
    folded = (n > 0) & (F.col("normalized_matches") == n)
    square = F.col("bidirectional") & (F.col("feature_values") == F.col("target_values"))
    low = F.col("feature_values") <= F.greatest(F.lit(10), F.col("target_values") * 5)
    repeated = ratio(F.col("feature_values"), n) <= 0.5
    method = (
        F.when(exact, "Exact target copy")
        .when(folded, "Normalized target copy")
        .when(square & F.col("binary_values"), "Binary target encoding")
        .when(square, "Bidirectional target mapping")
        .when(F.col("deterministic") & low & repeated & ~F.col("feature").isin(list(identifiers)), "Deterministic target mapping")
    )
    severity = F.when(exact | folded, "Critical").otherwise("High")
    return (
        joined.withColumn("method", method)
        .where(F.col("method").isNotNull())
        .select(
            "feature",
            "method",
            "paired_rows",
            "exact_rate",
            "normalized_rate",
            (exact | folded | F.col("deterministic")).alias("deterministic"),
            (exact | folded | F.col("bidirectional")).alias("bidirectional"),
            severity.alias("severity"),
        )
    )


def near_determinism(df: DataFrame, columns: Sequence[str], target: str, *, threshold: float = 0.99) -> DataFrame:
    """Columns whose uncertainty coefficient with the target passes the threshold."""
    pairs = [(c, target) for c in columns]
    table = categorical_pairs(df, [*columns, target], pairs=pairs, deterministic=threshold)
    return table.select(
        F.col("feature_a").alias("feature"),
        F.col("u_b_given_a").alias("u_target_given_feature"),
        F.col("u_a_given_b").alias("u_feature_given_target"),
        F.col("structural").alias("near_deterministic"),
    )


def split_leakage(df: DataFrame, key: Sequence[str], split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return (
        df.groupBy(*key)
        .agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count("*").alias("rows"))
        .where(F.col("first_split") != F.col("last_split"))
    )
