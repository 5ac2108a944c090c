"""Exact duplicates, identifier conflicts and repeated feature profiles.

Rows are compared through a SHA-256 digest of length-prefixed column texts, so
wide rows and long texts shuffle as 32 bytes and counts combine map-side.  No
group is ever gathered into one task: results carry counts, and member rows are
found with a semi join that AQE can split when one group is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import one_row

#: Types of bounded width.
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def row_digest(columns: Sequence[str]) -> Column:
    """Injective digest of the listed columns; null differs from every value."""
    parts = []
    for c in columns:
        shown = F.col(f"`{c}`").cast("string")
        parts.append(F.coalesce(F.concat(F.length(shown).cast("string"), F.lit(":"), shown), F.lit("~")))
    return F.sha2(F.concat(*parts), 256)


def compact_key(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns ``_k0``... that are equal where the listed ones are, in at most about 32 bytes each.

    Up to four columns stand for themselves, but texts over 31 bytes for their 32-byte digest;
    more columns are one binary digest.  Nulls group together.  Bare numbers compare as in GROUP BY
    (-0.0 equals 0.0).
    """
    if len(columns) > 4:
        return [F.unhex(row_digest(columns)).alias("_k0")]
    out = []
    for i, c in enumerate(columns):
        key = F.col(f"`{c}`")
        if not isinstance(df.select(key).schema[0].dataType, FIXED):
            text = key.cast("string")
            key = F.when(F.octet_length(text) > 31, F.unhex(F.sha2(text, 256))).otherwise(text.cast("binary"))
        out.append(key.alias(f"_k{i}"))
    return out


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows that occur more than once, with their count."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("group_size")).where(F.col("group_size") > 1)


def exact_duplicate_rows(df: DataFrame) -> DataFrame:
    """Every row that has an identical twin, tagged with its group digest."""
    keyed = df.withColumn("group_id", row_digest(df.columns))
    return _members(keyed, "group_id", keyed.groupBy("group_id").agg(F.count("*").alias("group_size")))


def _members(keyed: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    return keyed.join(sizes.where(F.col("group_size") > 1), key)


def identifier_conflicts(df: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """Repeated identifiers, split by whether their other columns agree.

    Nulls group together.  Distinct records are counted as distinct digests; the
    counting is two-level, so one hot identifier spreads over many tasks first.
    """
    others = [c for c in df.columns if c not in identifiers]
    digest = row_digest(others) if others else F.lit("")
    per_record = (
        df.select(*identifiers, digest.alias("_record"))
        .groupBy(*identifiers, "_record")
        .agg(F.count("*").alias("n"))
    )
    groups = per_record.groupBy(*identifiers).agg(
        F.sum("n").alias("group_size"), F.count("*").alias("distinct_records")
    )
    label = F.when(F.col("distinct_records") == 1, "Repeated identical record").otherwise("Conflicting records")
    return groups.where(F.col("group_size") > 1).withColumn("classification", label)


def repeated_profiles(
    df: DataFrame, features: Sequence[str], identifiers: Sequence[str], target: str | None = None
) -> DataFrame:
    """Feature profiles shared by several identifiers, with target agreement.

    A null target counts as a value of its own.
    """
    tag = F.coalesce(F.concat(F.lit("="), F.col(target).cast("string")), F.lit("~")) if target else F.lit("~")
    cells = (
        df.select(row_digest(features).alias("profile_id"), row_digest(identifiers).alias("_id"), tag.alias("_target"))
        .groupBy("profile_id", "_id", "_target")
        .agg(F.count("*").alias("n"))
    )
    out = cells.groupBy("profile_id").agg(
        F.sum("n").alias("group_size"),
        F.count_distinct("_id").alias("distinct_identifiers"),
        F.count_distinct("_target").alias("target_values"),
    )
    out = out.where(F.col("distinct_identifiers") > 1)
    if target is None:
        return out.drop("target_values")
    label = F.when(F.col("target_values") == 1, "Same target").otherwise("Target disagreement")
    return out.withColumn("classification", label)


def profile_target_values(df: DataFrame, features: Sequence[str], identifiers: Sequence[str], target: str) -> DataFrame:
    """Target values seen in each repeated profile, one row per value."""
    profiles = repeated_profiles(df, features, identifiers).select("profile_id")
    values = (
        df.select(row_digest(features).alias("profile_id"), F.coalesce(F.col(target).cast("string"), F.lit("<missing>")).alias("target_value"))
        .groupBy("profile_id", "target_value")
        .agg(F.count("*").alias("n"))
    )
    return values.join(profiles, "profile_id", "left_semi")


def duplicate_summary(
    df: DataFrame, identifiers: Sequence[str], features: Sequence[str], target: str
) -> DataFrame:
    """Six group and row counts, one row each.

    Identical rows are identical records of one identifier, so both come from the same
    counts.  Whether a profile's targets agree is seen from the least and the greatest one.
    """
    others = [c for c in df.columns if c not in identifiers]
    record = compact_key(df, others)
    per_record = df.select(*identifiers, *record).groupBy(*identifiers, *[f"_k{i}" for i in range(len(record))]).agg(F.count("*").alias("n"))
    ids = (
        per_record.groupBy(*identifiers)
        .agg(
            F.sum("n").alias("group_size"),
            (F.count("*") > 1).alias("conflict"),
            F.count_if(F.col("n") > 1).alias("twins"),
            F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("twin_rows"),
        )
        .where(F.col("group_size") > 1)
    )
    profile = compact_key(df, features)
    owner = compact_key(df, identifiers)
    names = [f"_k{i}" for i in range(len(profile))]
    owners = [f"_o{i}" for i in range(len(owner))]
    shown = F.col(f"`{target}`").cast("string")
    shown = F.when(F.octet_length(shown) > 31, F.sha2(shown, 256)).otherwise(shown)
    tag = F.coalesce(F.concat(F.lit("="), shown), F.lit("~")).alias("_target")
    per_owner = (
        df.select(*profile, *[c.alias(o) for c, o in zip(owner, owners)], tag)
        .groupBy(*names, *owners)
        .agg(F.count("*").alias("n"), F.min("_target").alias("low"), F.max("_target").alias("high"))
    )
    profiles = (
        per_owner.groupBy(*names)
        .agg(F.sum("n").alias("group_size"), F.count("*").alias("owners"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where(F.col("owners") > 1)
    )

    def both(mask: Column, name: str) -> list[Column]:
        rows = F.coalesce(F.sum(F.when(mask, F.col("group_size"))), F.lit(0))
        return [F.count_if(mask).alias(f"{name}_groups"), rows.alias(f"{name}_rows")]

    every, same = F.lit(True), F.col("low") == F.col("high")
    zero = F.lit(0).cast("bigint")
    twins = [F.coalesce(F.sum("twins"), zero).alias("t_groups"), F.coalesce(F.sum("twin_rows"), zero).alias("t_rows")]
    i = one_row(ids.agg(*both(every, "a"), *both(F.col("conflict"), "b"), *twins))
    p = one_row(profiles.agg(*both(every, "a"), *both(same, "b"), *both(~same, "c")))
    packed = df.sparkSession.range(1).select(i.alias("i"), p.alias("p"))
    lines = [
        ("Exact duplicate records", "i.t"),
        ("Duplicate identifiers", "i.a"),
        ("Conflicting duplicate identifiers", "i.b"),
        ("Repeated feature profiles", "p.a"),
        ("Repeated profiles with the same target", "p.b"),
        ("Repeated profiles with target disagreement", "p.c"),
    ]
    entries = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(f"{path}_groups").alias("group_count"),
            F.col(f"{path}_rows").alias("row_count"),
        )
        for metric, path in lines
    ]
    return packed.select(F.inline(F.array(*entries)))


def sample_groups(df: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    """All rows of the first k repeated groups in key order.

    The k keys come from a take-ordered (k rows per task), then a semi join.
    """
    first = (
        df.groupBy(*key)
        .agg(F.count("*").alias("group_size"))
        .where(F.col("group_size") > 1)
        .orderBy(*key)
        .limit(k)
    )
    return df.join(F.broadcast(first), list(key))
