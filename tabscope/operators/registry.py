"""Table-to-table integrity: references, coverage, vocabularies, priorities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .scale import unpivot


def semi(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of left whose key occurs in right."""
    keys = right.select(*[F.col(r).alias(l) for l, r in on.items()])
    return left.join(keys, list(on), "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of left whose key does not occur in right (null keys stay)."""
    keys = right.select(*[F.col(r).alias(l) for l, r in on.items()])
    return left.join(keys, list(on), "left_anti")


def overlap(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    return left.select(*columns).intersect(right.select(*columns))


def coverage_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows only on one side, with multiplicity, tagged missing or extra."""
    sides = left.select(*columns, F.lit(1).alias("_d")).unionByName(right.select(*columns, F.lit(-1).alias("_d")))
    net = sides.groupBy(*columns).agg(F.sum("_d").alias("d")).where(F.col("d") != 0)
    side = F.when(F.col("d") > 0, "missing").otherwise("extra")
    return net.select(*columns, side.alias("side"), F.abs("d").alias("n"))


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def vocabulary_check(df: DataFrame, allowed: Mapping[str, Sequence]) -> DataFrame:
    """Values outside each column's vocabulary, with counts; one shuffle of failures."""
    entries = []
    for c, values in allowed.items():
        col = F.col(f"`{c}`")
        bad = col.isNull() | ~col.isin(list(values))
        entries.append(
            F.when(
                bad,
                F.struct(F.lit(c).alias("column"), F.coalesce(col.cast("string"), F.lit("<missing>")).alias("value")),
            )
        )
    return df.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("column", "value").agg(F.count("*").alias("n"))


def reference_check(child: DataFrame, reference: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Unknown references with their number of uses; arrays of keys are exploded.

    Uses are counted before the anti join, so a hot reference is one row there.
    """
    dtype = child.schema[reference].dataType
    value = F.explode(reference) if isinstance(dtype, T.ArrayType) else F.col(reference)
    used = (
        child.select(value.alias("reference"))
        .where(F.col("reference").isNotNull())
        .groupBy("reference")
        .agg(F.count("*").alias("n"))
    )
    return used.join(parent.select(F.col(parent_key).alias("reference")), "reference", "left_anti")


def _uses(child: DataFrame, reference: str) -> DataFrame:
    dtype = child.schema[reference].dataType
    value = F.explode(reference) if isinstance(dtype, T.ArrayType) else F.col(reference)
    return child.select(value.alias("_k")).where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count("*").alias("links"))


def coverage_check(parent: DataFrame, parent_key: str, child: DataFrame, reference: str) -> DataFrame:
    """Parents that no child refers to."""
    used = _uses(child, reference).select(F.col("_k").alias(parent_key))
    return parent.join(used, parent_key, "left_anti")


def link_counts(parent: DataFrame, parent_key: str, child: DataFrame, reference: str) -> DataFrame:
    """Children per parent, zero kept; children are counted before the join."""
    used = _uses(child, reference).withColumnRenamed("_k", parent_key)
    return parent.select(parent_key).join(used, parent_key, "left").select(
        parent_key, F.coalesce("links", F.lit(0)).alias("links")
    )


def priority(column: str, levels: Sequence) -> Column:
    """1-based position of the level, unknown or missing last."""
    found = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    return F.when(found > 0, found).otherwise(F.lit(len(levels) + 1)).cast("int")


def order_by_priority(df: DataFrame, levels: Mapping[str, Sequence], key: str) -> DataFrame:
    """Rows sorted by declared level order, then key (a range-partitioned sort)."""
    ranked = df.withColumns({f"{c}_priority": priority(c, v) for c, v in levels.items()})
    return ranked.orderBy(*[f"{c}_priority" for c in levels], key)


def blockers(
    parent: DataFrame, parent_key: str, child: DataFrame, reference: str, child_key: str, is_open: Column
) -> DataFrame:
    """Open parents with every linked child, one row per link (null child if none).

    Long form on purpose: a parent with very many links stays many small rows.
    """
    links = child.select(F.col(reference).alias(parent_key), F.col(child_key).alias("linked"))
    return parent.where(is_open).join(links, parent_key, "left")


def required_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and blank cells per required column, from one scan."""
    parts, entries = [], []
    for i, c in enumerate(columns):
        col, dtype = F.col(f"`{c}`"), df.schema[c].dataType
        parts += [F.count_if(text.missing(col, dtype)).alias(f"m{i}"), F.count_if(text.blank(col, dtype)).alias(f"b{i}")]
        entries.append(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col(f"b{i}").alias("blank")))
    return df.agg(*parts).select(F.inline(F.array(*entries)))


def unknown_categories(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of ``other`` never seen in ``train``, with row counts, per column."""
    def values(df: DataFrame) -> DataFrame:
        long = unpivot(df, {c: F.col(f"`{c}`").cast("string") for c in columns}, value="category")
        return long.where(F.col("category").isNotNull()).groupBy("feature", "category").agg(F.count("*").alias("n"))

    return values(other).join(values(train).drop("n"), ["feature", "category"], "left_anti")
