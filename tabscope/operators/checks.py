"""Check tables (check, scope, item, n_violations, passed) and gates over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK_COLUMNS = ["check", "scope", "item", "n_violations", "passed"]


class ChecksFailed(ValueError):
    """Raised by :func:`assert_checks`; the message names every failed check."""


def checks_from(summary: DataFrame, rows: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into check rows: (check, scope, item, violations)."""
    counted = summary.select(*[F.coalesce(v.cast("bigint"), F.lit(0)).alias(f"__c{i}") for i, (*_, v) in enumerate(rows)])
    entries = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(scope).alias("scope"),
            F.lit(item).alias("item"),
            F.col(f"__c{i}").alias("n_violations"),
            (F.col(f"__c{i}") == 0).alias("passed"),
        )
        for i, (check, scope, item, _) in enumerate(rows)
    ]
    return counted.select(F.inline(F.array(*entries)))


def check_rows(df: DataFrame, check: str, scope: str, item: Column, violations: Column) -> DataFrame:
    """One check row per row of a small result table."""
    n = F.coalesce(violations.cast("bigint"), F.lit(0))
    return df.select(
        F.lit(check).alias("check"),
        F.lit(scope).alias("scope"),
        item.cast("string").alias("item"),
        n.alias("n_violations"),
        (n == 0).alias("passed"),
    )


def all_checks(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def assert_checks(checks: DataFrame, require: Sequence[str] | None = None) -> None:
    """Fail with one error naming all failed (selected) checks."""
    failed = checks.where(~F.col("passed"))
    if require is not None:
        failed = failed.where(F.col("check").isin(list(require)))
    # One row per declared check and item, never data rows.
    rows = failed.orderBy("check", "scope", "item").collect()
    if rows:
        raise ChecksFailed(
            "; ".join(f"{r['check']}[{r['scope']}/{r['item']}]: {r['n_violations']}" for r in rows)
        )


def readiness(checks: DataFrame, group: str = "scope") -> DataFrame:
    """All / any rollup of checks by group."""
    return checks.groupBy(group).agg(
        F.count("*").alias("n_checks"),
        F.count_if(~F.col("passed")).alias("n_failed"),
        F.bool_and("passed").alias("all_passed"),
        F.bool_or("passed").alias("any_passed"),
    )


def status_summary(df: DataFrame, status: str, order: Sequence[str]) -> DataFrame:
    """Rows per status in a fixed status order, zero counts kept."""
    counts = df.groupBy().agg(
        *[F.count_if(F.col(status) == s).alias(f"__s{i}") for i, s in enumerate(order)]
    )
    entries = [
        F.struct(F.lit(i + 1).alias("status_order"), F.lit(s).alias("status"), F.col(f"__s{i}").alias("n"))
        for i, s in enumerate(order)
    ]
    return counts.select(F.inline(F.array(*entries)))
