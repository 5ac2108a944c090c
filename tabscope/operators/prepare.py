"""Role projection, conditional filling, preservation, splits and folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.stats import ratio
from . import checks as K
from .numeric import BlankRule, project
from .quality import key_profile
from .scale import at, by_name, one_row

SPLITS = ("train", "validation", "test")
BUCKET_DIGITS = 5  # hash prefix: 16**5 buckets per class
BUCKETS = 16**BUCKET_DIGITS


def separate_roles(df: DataFrame, identifiers: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Identifiers, features and target in declared order; nothing else."""
    return df.select(*identifiers, *features, target)


def encode_target(df: DataFrame, target: str, mapping: Mapping[str, int], output: str = "label") -> DataFrame:
    """Integer label from a total mapping onto 0..n-1; unmapped labels become null."""
    codes = sorted(mapping.values())
    if codes != list(range(len(codes))):
        raise ValueError("target codes must be contiguous integers from 0")
    out = F.lit(None).cast("int")
    for value, code in mapping.items():
        out = F.when(F.col(target) == F.lit(value), F.lit(code)).otherwise(out)
    return df.withColumn(output, out)


def target_encoding_checks(encoded: DataFrame, target: str, output: str = "label") -> DataFrame:
    missing = F.count_if(F.col(target).isNull())
    unmapped = F.count_if(F.col(target).isNotNull() & F.col(output).isNull())
    summary = encoded.agg(missing.alias("m"), unmapped.alias("u"))
    return K.checks_from(
        summary,
        [("labels_present", "target", target, F.col("m")), ("labels_mapped", "target", target, F.col("u"))],
    )


# --------------------------------------------------------------------------
# X1


def conditional_fill(df: DataFrame, rule: BlankRule) -> DataFrame:
    """Replace the text column by doubles, blanks filled where the rule allows.

    Values the rule cannot resolve become null; :func:`fill_checks` counts them.
    """
    return df.withColumn(rule.column, project(df, rule.column, rule).value)


def fill_checks(df: DataFrame, rule: BlankRule) -> DataFrame:
    """Violations that forbid the fill, from the raw table."""
    p = project(df, rule.column, rule)
    summary = df.agg(
        F.count_if(p.missing).alias("a"), F.count_if(p.condition_failure).alias("b"), F.count_if(p.non_numeric).alias("c")
    )
    return K.checks_from(
        summary,
        [
            ("no_nulls", "conditional_fill", rule.column, F.col("a")),
            ("blank_condition_holds", "conditional_fill", rule.column, F.col("b")),
            ("values_convertible", "conditional_fill", rule.column, F.col("c")),
        ],
    )


def fill_counts(df: DataFrame, rules: Sequence[BlankRule]) -> DataFrame:
    """Filled cells per rule."""
    parts = [F.count_if(project(df, r.column, r).materialized).alias(f"n{i}") for i, r in enumerate(rules)]
    entries = [
        F.struct(F.lit(r.column).alias("column"), F.col(f"n{i}").alias("materialized")) for i, r in enumerate(rules)
    ]
    return df.agg(*parts).select(F.inline(F.array(*entries)))


# --------------------------------------------------------------------------
# A6


def preservation_check(before: DataFrame, after: DataFrame, key: Sequence[str], allowed: Sequence[str] = ()) -> DataFrame:
    """Check rows proving that only authorised columns changed.

    One key join; ``key`` must be unique on both sides (also checked).
    """
    others = [c for c in before.columns if c not in key and c in after.columns]
    watched = [c for c in others if c not in allowed]
    left = before.select(*key, *[F.col(c).alias(f"b_{c}") for c in watched], F.lit(True).alias("_b"))
    right = after.select(*key, *[F.col(c).alias(f"a_{c}") for c in watched], F.lit(True).alias("_a"))
    joined = left.join(right, list(key), "full_outer")
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    summary = joined.agg(
        F.count_if(F.col("_a").isNull()).alias("lost"),
        F.count_if(F.col("_b").isNull()).alias("added"),
        *[F.count_if(both & ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))).alias(f"d_{c}") for c in watched],
    )
    scope = "preservation"
    order = 0 if before.columns == after.columns else 1
    rows = [
        ("rows_kept", scope, "*", F.col("lost")),
        ("rows_not_added", scope, "*", F.col("added")),
        ("column_order_kept", scope, "*", F.lit(order)),
    ]
    rows += [("column_unchanged", scope, c, F.col(f"d_{c}")) for c in watched]
    unique = [
        K.checks_from(key_profile(side, key), [("key_unique", scope, name, F.col("duplicated_rows") + F.col("missing"))])
        for name, side in (("before", before), ("after", after))
    ]
    return K.all_checks(K.checks_from(summary, rows), *unique)


# --------------------------------------------------------------------------
# X2 - X6


def membership_key(df: DataFrame, identifiers: Sequence[str]) -> Column:
    """Canonical JSON array of the identifier values."""
    parts = []
    for c in identifiers:
        col, dtype = F.col(c), df.schema[c].dataType
        if text.is_text(dtype):
            quoted = F.to_json(F.array(col))
            shown = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        else:
            shown = col.cast("string")
        parts.append(F.coalesce(F.when(col.isNotNull(), shown), F.lit("null")))
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _hashed(df: DataFrame, key: Sequence[str], label: str, seed: int) -> DataFrame:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), membership_key(df, key)))
    tagged = df.withColumns({"_h": digest, "_c": F.col(label).cast("string")})
    return tagged.withColumn("_b", F.conv(F.substring("_h", 1, BUCKET_DIGITS), 16, 10).cast("int"))


def _largest_remainder(table: DataFrame, size: Column, weight: Column, total: Column, out: str) -> DataFrame:
    """Integer shares of ``size`` proportional to ``weight``; one row per class."""
    exact = size.cast("double") * weight.cast("double") / total.cast("double")
    table = table.withColumns({"_f": F.floor(exact), "_r": exact - F.floor(exact), "_size": size})
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_r"), F.asc("_c")))
    left = F.col("_size") - F.sum("_f").over(every)
    return table.withColumn(out, F.col("_f") + (rank <= left).cast("int")).drop("_f", "_r", "_size")


def split_quotas(class_counts: DataFrame, fractions: tuple[float, float, float]) -> DataFrame:
    """Exact rows per class and split: held-out sizes round up, classes by largest remainder.

    ``class_counts`` is (_c, n), one row per declared class.
    """
    _, validation, test = fractions
    held = validation + test
    whole = Window.partitionBy(F.lit(0))
    table = class_counts.withColumn("_n", F.sum("n").over(whole))
    table = table.withColumn("_held", F.ceil(F.lit(held) * F.col("_n")))
    table = table.withColumn("_test", F.ceil(F.lit(test / held) * F.col("_held")))
    table = _largest_remainder(table, F.col("_n") - F.col("_held"), F.col("n"), F.col("_n"), "n_train")
    rest = F.col("n") - F.col("n_train")
    table = _largest_remainder(table, F.col("_held") - F.col("_test"), rest, F.col("_held"), "n_validation")
    return table.select("_c", "n", "n_train", "n_validation", (rest - F.col("n_validation")).alias("n_test"))


def stratified_split(
    df: DataFrame,
    key: Sequence[str],
    label: str,
    classes: Sequence,
    fractions: tuple[float, float, float] = (0.70, 0.15, 0.15),
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: exact stratified sizes, independent of row order and partitioning.

    Rows are ordered inside a class by a seeded hash of their key.  Hash-prefix
    counts (map-side combined) show in which bucket each quota ends, so all other
    rows are assigned by a comparison; only boundary buckets are ranked.  Rows
    with an undeclared label get a null split.
    """
    if abs(sum(fractions) - 1) > 1e-9 or min(fractions) <= 0:
        raise ValueError("fractions must be positive and sum to 1")
    tagged = _hashed(df, key, label, seed)
    declared = F.col("_c").isin([str(c) for c in classes])
    hist = tagged.where(declared).groupBy("_c", "_b").agg(F.count("*").alias("n"))
    quotas = split_quotas(hist.groupBy("_c").agg(F.sum("n").alias("n")), fractions)
    cut = at(by_name(quotas, "_c", ["n_train", "n_validation"]), F.col("_c"))
    upto = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hist.withColumns({"after": F.sum("n").over(upto), "_q": cut}).select(
        "_c",
        "_b",
        "after",
        (F.col("after") - F.col("n")).alias("before"),
        F.col("_q.n_train").alias("c1"),
        (F.col("_q.n_train") + F.col("_q.n_validation")).alias("c2"),
    )
    end = F.lit(BUCKETS)
    bounds = placed.groupBy("_c").agg(
        F.max("c1").alias("c1"),
        F.max("c2").alias("c2"),
        *[
            e
            for i in (1, 2)
            for e in (
                F.coalesce(F.min(F.when(F.col("after") > F.col(f"c{i}"), F.col("_b"))), end).alias(f"b{i}"),
                F.min(F.when(F.col("after") > F.col(f"c{i}"), F.col("before"))).alias(f"p{i}"),
            )
        ],
    )
    limits = at(by_name(bounds, "_c", ["c1", "c2", "b1", "b2", "p1", "p2"]), F.col("_c"))
    seen = tagged.withColumn("_l", limits)
    b, b1, b2 = F.col("_b"), F.col("_l.b1"), F.col("_l.b2")
    on_edge = F.coalesce((b == b1) | (b == b2), F.lit(False))
    plain = F.when(b < b1, SPLITS[0]).when(b < b2, SPLITS[1]).when(b > b2, SPLITS[2])
    settled = seen.where(~on_edge).select(*df.columns, plain.alias("split"))
    inside = Window.partitionBy("_c", "_b").orderBy("_h", *key)
    position = F.row_number().over(inside) + F.when(b == b1, F.col("_l.p1")).otherwise(F.col("_l.p2"))
    ranked = seen.where(on_edge).withColumn("_p", position)
    exact = (
        F.when(F.col("_p") <= F.col("_l.c1"), SPLITS[0])
        .when(F.col("_p") <= F.col("_l.c2"), SPLITS[1])
        .otherwise(SPLITS[2])
    )
    return settled.unionByName(ranked.select(*df.columns, exact.alias("split")))


def split_profile(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows, class counts and class share per split."""
    counts = df.groupBy(F.col(split).alias("split"), F.col(label).cast("string").alias("class")).agg(F.count("*").alias("n"))
    # one row per split and class; a null split (undeclared label) is a split of its own
    rows = F.sum("n").over(Window.partitionBy("split"))
    return counts.withColumn("rows", rows).select("split", "class", "n", "rows", ratio(F.col("n"), F.col("rows")).alias("share"))


def split_checks(
    source: DataFrame,
    parts: DataFrame,
    key: Sequence[str],
    label: str,
    classes: Sequence,
    *,
    split: str = "split",
    tolerance: float = 0.02,
) -> DataFrame:
    """Non-empty, all classes, prevalence, unique and disjoint keys, full coverage."""
    scope = "split"
    shown = [str(c) for c in classes]
    col = F.col(label).cast("string")
    aggregates = []
    for i, s in enumerate(SPLITS):
        inside = F.col(split) == s
        aggregates.append(F.count_if(inside).alias(f"n{i}"))
        aggregates += [F.count_if(inside & (col == c)).alias(f"n{i}_{j}") for j, c in enumerate(shown)]
    base = one_row(source.agg(F.count("*").alias("n"), *[F.count_if(col == c).alias(f"c{j}") for j, c in enumerate(shown)]))
    summary = parts.agg(F.count("*").alias("rows"), *aggregates).withColumn("_s", base)
    rows = []
    for i, s in enumerate(SPLITS):
        rows.append(("split_not_empty", scope, s, (F.col(f"n{i}") == 0).cast("int")))
        for j, c in enumerate(shown):
            here, all_ = ratio(F.col(f"n{i}_{j}"), F.col(f"n{i}")), ratio(F.col(f"_s.c{j}"), F.col("_s.n"))
            rows.append(("class_present", scope, f"{s}/{c}", (F.col(f"n{i}_{j}") == 0).cast("int")))
            far = F.coalesce(F.abs(here - all_) > tolerance, F.lit(True))
            rows.append(("prevalence_within_tolerance", scope, f"{s}/{c}", far.cast("int")))
    rows.append(("row_count_preserved", scope, "*", (F.col("rows") != F.col("_s.n")).cast("int")))
    in_split = parts.where(F.col(split).isin(list(SPLITS)))
    sides = source.select(*key, F.lit(1).alias("_a"), F.lit(None).cast("string").alias("_s")).unionByName(
        in_split.select(*key, F.lit(0).alias("_a"), F.col(split).alias("_s"))
    )
    per_key = sides.groupBy(*key).agg(
        F.sum("_a").alias("src"), F.count("_s").alias("got"), F.min("_s").alias("lo"), F.max("_s").alias("hi")
    )
    keys = per_key.agg(
        F.count_if(F.col("src") > 1).alias("source_repeats"),
        F.count_if((F.col("got") > 1) & (F.col("lo") == F.col("hi"))).alias("repeats"),
        F.count_if(F.col("lo") != F.col("hi")).alias("overlaps"),
        F.count_if((F.col("src") > 0) & (F.col("got") == 0)).alias("missing"),
        F.count_if((F.col("src") == 0) & (F.col("got") > 0)).alias("extra"),
    )
    key_rows = [
        ("source_keys_unique", scope, "*", F.col("source_repeats")),
        ("split_keys_unique", scope, "*", F.col("repeats")),
        ("splits_disjoint", scope, "*", F.col("overlaps")),
        ("coverage_missing", scope, "*", F.col("missing")),
        ("coverage_extra", scope, "*", F.col("extra")),
    ]
    return K.all_checks(K.checks_from(summary, rows), K.checks_from(keys, key_rows))


def stratified_folds(
    df: DataFrame, key: Sequence[str], label: str, classes: Sequence, k: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold`` 0..k-1: positions in (class, hash) order dealt out in turn.

    Positions come from bucket counts plus a rank inside a hash bucket, so the
    one shuffle of rows is by (class, bucket) and no class is sorted as a whole.
    Rows with an undeclared or null label keep a null fold; :func:`fold_checks`
    counts them.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    every = _hashed(df, key, label, seed)
    declared = F.coalesce(F.col("_c").isin([str(c) for c in classes]), F.lit(False))
    tagged = every.where(declared)
    hist = tagged.groupBy("_c", "_b").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = hist.select("_c", "_b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    sizes = hist.groupBy("_c").agg(F.sum("n").alias("n"))
    # One row per declared class.
    ahead = Window.partitionBy(F.lit(0)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("_c", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("_c", "_b").orderBy("_h", *key)
    ranked = tagged.withColumn("_r", F.row_number().over(inside) - 1).join(starts, ["_c", "_b"])
    ranked = ranked.withColumn("_o", at(by_name(offset, "_c", ["offset"]), F.col("_c")))
    fold = (F.col("_r") + F.col("before") + F.col("_o.offset")) % k
    left = every.where(~declared).select(*df.columns, F.lit(None).cast("int").alias("fold"))
    return ranked.select(*df.columns, fold.cast("int").alias("fold")).unionAll(left)


def fold_checks(folded: DataFrame) -> DataFrame:
    """Check row on rows without a fold."""
    summary = folded.agg(F.count_if(F.col("fold").isNull()).alias("without"))
    return K.checks_from(summary, [("folds_assigned", "fold", "*", F.col("without"))])


def fold_classes(folded: DataFrame, label: str) -> DataFrame:
    """Held-out and training rows per (fold, class)."""
    counts = folded.groupBy("fold", F.col(label).cast("string").alias("class")).agg(F.count("*").alias("validation_rows"))
    total = F.sum("validation_rows").over(Window.partitionBy("class"))
    return counts.withColumn("train_rows", total - F.col("validation_rows")).select("fold", "class", "validation_rows", "train_rows")
