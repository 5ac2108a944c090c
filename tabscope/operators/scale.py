"""Distributed helpers: ordered running totals, exact quantiles, unpivot, pairs.

Global order without a global window
------------------------------------
A number is placed in a *leaf* by (signed octave, slot inside the octave), the first
16 bits of its mantissa.  Leaves that hold more than 1,024 rows and more than one in
4,096 rows of their group are *wide* and divided again by the next 20 bits (``_fine``).
Placement is a monotone function of the value and of exact counts, so every evaluation
of a plan agrees on it, whatever executor runs it.  Running totals over leaves need
windows over the octaves, over at most 65,536 slots of an octave and over at most
1,048,576 parts of a wide leaf; rows are ordered only inside their (part of a) leaf.
A part of a wide leaf holds at most 65,536 distinct doubles, however close they lie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First division of an octave, second division of a wide leaf.
SLOTS, PARTS = 65536, 1 << 20
#: A leaf is wide above this many rows and above one in LEAVES rows of its group.
LEAST_WIDE, LEAVES = 1024, 4096


def literal_table(spark: SparkSession, rows: Sequence[Mapping], schema: pa.Schema) -> DataFrame:
    """A small table made of arguments (never of data); a LocalRelation in plans."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(r) for r in rows], schema=schema))


def one_row(df: DataFrame) -> Column:
    """The single row of a global aggregate as a struct-valued scalar subquery."""
    packed = df.groupBy().agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
    return packed.scalar()


def by_name(table: DataFrame, name: str, values: Sequence[str]) -> Column:
    """Map name -> struct(values) as a scalar subquery.

    Only for tables with one row per *declared* name (feature, class, split), so
    the map is bounded by the call's arguments and rows are looked up without a
    join or a shuffle.
    """
    entry = F.struct(F.col(name), F.struct(*values))
    return table.groupBy().agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def at(mapping: Column, key: Column) -> Column:
    return F.try_element_at(mapping, key)


# --------------------------------------------------------------------------
# unpivot and pairs


def unpivot(
    df: DataFrame,
    columns: Mapping[str, Column],
    keep: Sequence[str] = (),
    name: str = "feature",
    value: str = "value",
) -> DataFrame:
    """Wide to long: one row per (row, declared column); all values of one type."""
    shaped = df.select(*keep, *[c.alias(f"__v_{i}") for i, c in enumerate(columns.values())])
    entries = [
        F.struct(F.lit(n).alias(name), F.col(f"__v_{i}").alias(value))
        for i, n in enumerate(columns)
    ]
    return shaped.select(*keep, F.inline(F.array(*entries)))


def pair_counts(
    df: DataFrame,
    columns: Mapping[str, Column],
    pairs: Sequence[tuple[str, str]],
    *,
    numbered: bool = False,
) -> DataFrame:
    """Contingency counts of every declared column pair in one shuffle.

    Returns (feature_a, feature_b, value_a, value_b, n) over rows where both
    values are present, or (pair, value_a, value_b, n) with the position of the
    pair, a narrower key for plans that shuffle many distinct values.  Counts
    are combined map-side before the exchange.
    """
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    at_name = {n: F.col(f"__v_{i}") for i, n in enumerate(names)}
    shaped = df.select(*[columns[n].alias(f"__v_{i}") for i, n in enumerate(names)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        tag = [F.lit(i).alias("pair")] if numbered else [F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b")]
        entries.append(F.struct(*tag, at_name[a].alias("value_a"), at_name[b].alias("value_b")))
    keys = ["pair"] if numbered else ["feature_a", "feature_b"]
    return (
        shaped.select(F.inline(F.array(*entries)))
        .where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull())
        .groupBy(*keys, "value_a", "value_b")
        .agg(F.count("*").alias("n"))
    )


# --------------------------------------------------------------------------
# ordered running totals


def _with_leaf(df: DataFrame, value: str) -> DataFrame:
    """Add ``_octave``, ``_slot`` and ``_fine``, each monotone inside the one before.

    coalesce makes all non-nullable: no null filter is then inferred for the joins
    on them, so all branches keep the same input and share its exchange.
    """
    x = f"cast(`{value}` as double)"
    octave = f"least(greatest(floor(log2(abs({x}))), -1000), 1024)"
    placed = df.withColumn("_octave", F.expr(f"coalesce(cast(signum({x}) * ({octave} + 1100) as int), 0)"))
    # Mantissa times 65,536: an exact product, as is its fraction; 4 stands for infinity.
    placed = placed.withColumn("_part", F.expr(f"coalesce(least(abs({x}) * pow(2.0D, cast(1100 - abs(_octave) as double)), 4.0D) * {SLOTS}, 0.0D)"))
    slot = f"coalesce(cast(signum({x}) * floor(_part) as bigint), 0L)"
    fine = f"coalesce(cast(signum({x}) * floor((_part - floor(_part)) * {PARTS}) as bigint), 0L)"
    return placed.withColumns({"_slot": F.expr(slot), "_fine": F.expr(fine)}).drop("_part")


def _leaf_offsets(
    keyed: DataFrame, groups: Sequence[str], measures: Sequence[str], size: str, descending: bool
) -> DataFrame:
    """Leaf sums ``_leaf_m`` with ``before_m`` (sum over earlier leaves), ``total_m`` and ``_wide``.

    ``size`` is the SQL aggregate that counts a leaf's rows.
    """
    names = [f"`{c}`" for c in groups]
    way = "desc" if descending else "asc"
    earlier = "rows between unbounded preceding and 1 preceding"
    scope = ", ".join(names) or "0"
    sums = [F.expr(f"sum({m})").alias(f"_leaf_{m}") for m in measures]
    leaves = keyed.groupBy(*groups, "_octave", "_slot").agg(*sums, F.expr(size).alias("_size"))
    # One row per octave: at most a few thousand per group.
    tops = leaves.groupBy(*groups, "_octave").agg(
        *[F.sum(f"_leaf_{m}").alias(f"_top_{m}") for m in measures], F.sum("_size").alias("_rows"), F.count("*").alias("_k")
    )
    tops = tops.selectExpr(
        *names,
        "_octave",
        f"sum(_k) over (partition by {scope}) as _leaves",
        f"greatest({LEAST_WIDE}, sum(_rows) over (partition by {scope}) / {LEAVES}) as _most",
        *[f"coalesce(sum(_top_{m}) over (partition by {scope} order by _octave {way} {earlier}), 0) as _skip_{m}" for m in measures],
        *[f"sum(_top_{m}) over (partition by {scope}) as total_{m}" for m in measures],
    )
    inside = leaves.selectExpr(
        *[f"`{c}`" for c in leaves.columns],
        *[f"coalesce(sum(_leaf_{m}) over (partition by {', '.join([*names, '_octave'])} order by _slot {way} {earlier}), 0) as _in_{m}" for m in measures],
    )
    # Broadcast bound: octaves (about 4,200 at most) times declared groups.
    return inside.join(F.broadcast(tops), [*groups, "_octave"]).selectExpr(
        *names, "_octave", "_slot", "_leaves", "_size > _most as _wide",
        *[f"_leaf_{m}" for m in measures], *[f"_in_{m} + _skip_{m} as before_{m}" for m in measures], *[f"total_{m}" for m in measures],
    )


def _divided(keyed: DataFrame, leaves: DataFrame, leaf: Sequence[str], measures: Sequence[str], descending: bool) -> DataFrame:
    """``leaves`` with a row for every part (``_fine``) of a wide leaf; the others have part 0."""
    way = "desc" if descending else "asc"
    offsets = [f"{k}_{m}" for m in measures for k in ("before", "total")]
    # Broadcast bound: fewer than LEAVES wide leaves per declared group.
    wide = F.broadcast(leaves.where("_wide").select(*leaf, *offsets))
    parts = keyed.join(wide, list(leaf)).groupBy(*leaf, "_fine").agg(
        *[F.sum(m).alias(m) for m in measures], *[F.max(c).alias(c) for c in offsets]
    )
    scope = ", ".join(f"`{c}`" for c in leaf)
    earlier = f"over (partition by {scope} order by _fine {way} rows between unbounded preceding and 1 preceding)"
    parts = parts.selectExpr(
        *[f"`{c}`" for c in leaf], "_fine",
        *[f"before_{m} + coalesce(sum({m}) {earlier}, 0) as before_{m}" for m in measures], *[f"total_{m}" for m in measures],
    )
    whole = leaves.where("not _wide").withColumn("_fine", F.lit(0).cast("bigint"))
    return whole.select(*parts.columns).unionAll(parts)


def _in_parts(keyed: DataFrame, leaves: DataFrame, leaf: Sequence[str]) -> DataFrame:
    """``_fine`` only where the leaf is wide, else 0."""
    marked = keyed.join(F.broadcast(leaves.where("_wide").select(*leaf, "_wide")), list(leaf), "left")
    return marked.withColumn("_fine", F.expr("if(_wide is null, 0L, _fine)")).drop("_wide")


def ordered_totals(
    df: DataFrame,
    order: str,
    measures: Sequence[str],
    groups: Sequence[str] = (),
    *,
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sum ``cum_m`` and group sum ``total_m`` of each measure.

    ``df`` holds one row per (groups, order), i.e. it is already aggregated to
    distinct values, so a value shared by a third of all rows is one row here.
    Group keys must not be null.
    """
    way, leaf = "desc" if descending else "asc", [*groups, "_octave", "_slot"]
    keyed = _with_leaf(df, order)
    leaves = _leaf_offsets(keyed, groups, measures, "count(*)", descending)
    offsets = _divided(keyed, leaves, leaf, measures, descending)
    scope = ", ".join([*[f"`{c}`" for c in groups], "_octave", "_slot", "_fine"])
    local = f"over (partition by {scope} order by `{order}` {way} rows between unbounded preceding and current row)"
    running = _in_parts(keyed, leaves, leaf).selectExpr("*", *[f"sum({m}) {local} as _run_{m}" for m in measures])
    return running.join(offsets, [*leaf, "_fine"]).selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"before_{m} + _run_{m} as cum_{m}" for m in measures],
        *[f"total_{m}" for m in measures],
    )


def average_ranks(counts: DataFrame, value: str, n: str, groups: Sequence[str] = ()) -> DataFrame:
    """Add ``rank``: the mean 1-based position of each distinct value."""
    out = ordered_totals(counts, value, [n], groups)
    return out.withColumn("rank", F.expr(f"cum_{n} - ({n} - 1) / 2.0D"))


# --------------------------------------------------------------------------
# exact quantiles


def _holds(start: str, size: str, position: str) -> str:
    """SQL: the run [start, start + size) of a sorted group covers a 0-based position."""
    lo, hi = f"floor({position})", f"ceil({position})"
    return f"({start} <= {hi} and {lo} < {start} + {size})"


def _located_values(
    df: DataFrame, value: str, groups: Sequence[str], wanted: str, weight: str | None
) -> DataFrame:
    """Distinct values, with sorted start position, of the leaves a condition picks.

    First pass: leaf counts, combined map-side.  Second pass: only rows in the
    wanted leaves are counted per value.  The wanted leaves are broadcast: they
    are a small multiple of (probabilities x declared groups), whatever the data.
    """
    narrow = df.where(f"`{value}` is not null").selectExpr(*[f"`{c}`" for c in groups], f"`{value}` as _v", f"cast({weight or 1} as bigint) as n")
    keyed = _with_leaf(narrow, "_v")
    leaf = [*groups, "_octave", "_slot"]
    leaves = _leaf_offsets(keyed, groups, ["n"], "sum(n)", descending=False)
    targets = leaves.where(wanted).select(*leaf, "before_n", "total_n", "_leaves")
    inside = (
        keyed.join(F.broadcast(targets), leaf)
        .groupBy(*leaf, "_fine", "_v", "before_n", "total_n", "_leaves")
        .agg(F.sum("n").alias("n"))
    )
    # Many distinct values may share a wanted leaf: they are ordered part by part.
    scope = ", ".join(f"`{c}`" for c in leaf)
    earlier = "rows between unbounded preceding and 1 preceding"
    parts = inside.groupBy(*leaf, "_fine").agg(F.sum("n").alias("_part_n"))
    parts = parts.selectExpr(*[f"`{c}`" for c in leaf], "_fine", f"coalesce(sum(_part_n) over (partition by {scope} order by _fine {earlier}), 0) as _skip")
    return inside.join(parts, [*leaf, "_fine"]).selectExpr(
        *[f"`{c}`" for c in groups],
        "cast(_v as double) as _v",
        "n",
        "total_n",
        "_leaves",
        f"before_n + _skip + coalesce(sum(n) over (partition by {scope}, _fine order by _v {earlier}), 0) as _start",
    )


def _interpolated(position: str) -> str:
    """SQL aggregate: the linearly interpolated value at a 0-based position."""
    lo = f"max(case when _start <= floor({position}) and floor({position}) < _start + n then _v end)"
    hi = f"max(case when _start <= ceil({position}) and ceil({position}) < _start + n then _v end)"
    return f"{lo} + ({hi} - {lo}) * max({position} - floor({position}))"


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    groups: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group.

    ``groups`` must be declared names (features, classes, models); see
    :func:`_located_values` for what is shuffled and broadcast.
    """
    places = {name: f"((total_n - 1) * {float(p)!r}D)" for name, p in probabilities.items()}
    wanted = " or ".join(_holds("before_n", "_leaf_n", h) for h in places.values())
    located = _located_values(df, value, groups, wanted, weight)
    return located.groupBy(*groups).agg(*[F.expr(_interpolated(h)).alias(name) for name, h in places.items()])


def quantile_edges(df: DataFrame, value: str, bins: int, groups: Sequence[str]) -> DataFrame:
    """Sorted distinct edges of q = min(bins, distinct values) equal-count bins.

    A group spread over at least ``bins`` leaves has that many distinct values.  A
    group in fewer leaves is counted by value as a whole in the same second pass,
    which then yields its number of distinct values.
    """
    even = [f"((total_n - 1) * least({i} / {bins}D, 1D))" for i in range(bins + 1)]
    wanted = f"_leaves < {bins} or " + " or ".join(_holds("before_n", "_leaf_n", h) for h in even)
    located = _located_values(df, value, groups, wanted, None)
    sizes = located.groupBy(*groups).agg(
        F.expr(f"cast(least({bins}, greatest(max(_leaves), count(*))) as double)").alias("_q")
    )
    # One row per declared group.
    sized = located.join(F.broadcast(sizes), list(groups))
    own = [f"((total_n - 1) * least({i} / _q, 1D))" for i in range(bins + 1)]
    found = sized.groupBy(*groups).agg(*[F.expr(_interpolated(h)).alias(f"_e{i}") for i, h in enumerate(own)])
    points = ", ".join(f"_e{i}" for i in range(bins + 1))
    return found.select(*groups, F.expr(f"array_sort(array_distinct(array({points})))").alias("edges"))
