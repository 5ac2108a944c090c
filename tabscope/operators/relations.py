"""Associations between features: numeric, categorical and mixed pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import clamp01, entropy, n_log_n, pearson, uncertainty, weighted_pearson
from .scale import exact_quantiles, one_row, ordered_totals, pair_counts

# Default thresholds.
STRONG_NUMERICAL = 0.80
STRONG_CATEGORICAL = 0.70
STRONG_MIXED = 0.25
REDUNDANT_NUMERICAL = 0.90
REDUNDANT_CATEGORICAL = 0.90
DETERMINISTIC = 0.99

PAIR = ["feature_a", "feature_b"]

#: Columns of a block whose pairs with another block are one aggregate, and columns that need no
#: blocks: aggregates of more than about 100 buffer fields (11 a pair) leave generated code.
TILE = 2
UNTILED = 4


def _numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return {c: text.to_number(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns}


def _labels(df: DataFrame, columns: Sequence[str], strip_text: bool = False) -> dict[str, Column]:
    return {c: text.clean_category(F.col(f"`{c}`"), df.schema[c].dataType, strip_text=strip_text) for c in columns}


# --------------------------------------------------------------------------
# R0


def aligned(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Coverage of a key join of two projections; both sides must match fully."""
    sides = left.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    per_key = sides.groupBy(*key).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    out = per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("matched_keys"),
        F.count_if(F.col("r") == 0).alias("left_only_keys"),
        F.count_if(F.col("l") == 0).alias("right_only_keys"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated_keys"),
    )
    ok = (F.col("left_only_keys") == 0) & (F.col("right_only_keys") == 0) & (F.col("repeated_keys") == 0)
    return out.withColumn("aligned", ok)


# --------------------------------------------------------------------------
# R1, R2


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """r of every column pair over its complete rows, in one scan.

    Up to ``UNTILED`` columns are one aggregate with a one-row shuffle.  More are cut in blocks of
    ``TILE``: a row meets every two blocks, and all pairs of two blocks are one aggregate grouped
    by tile, so the plan does not grow with the pairs and the shuffle has one row per task and tile.
    """
    values = list(_numbers(df, columns).values())
    if len(columns) > UNTILED:
        return _tiled_pearson(df, list(columns), values)
    pairs = list(combinations(range(len(columns)), 2))
    measured = df.agg(F.count("*").alias("rows"), *_pearson_aggregates(values, values, pairs))
    names = F.array(*[F.lit(c) for c in columns])
    return measured.select(F.inline(F.array(*_pearson_entries(pairs, lambda i: names[i], lambda j: names[j]))))


def _pearson_aggregates(xs: Sequence[Column], ys: Sequence[Column], pairs: Sequence[tuple[int, int]]) -> list[Column]:
    parts = []
    for i, j in pairs:
        parts.append(F.count_if(xs[i].isNotNull() & ys[j].isNotNull()).alias(f"n_{i}_{j}"))
        parts.append(pearson(xs[i], ys[j]).alias(f"r_{i}_{j}"))
    return parts


def _pearson_entries(pairs: Sequence[tuple[int, int]], name_a, name_b) -> list[Column]:
    return [
        F.struct(
            name_a(i).alias(PAIR[0]),
            name_b(j).alias(PAIR[1]),
            F.col(f"n_{i}_{j}").alias("valid_rows"),
            (F.col("rows") - F.col(f"n_{i}_{j}")).alias("missing_rows"),
            F.col(f"r_{i}_{j}").alias("pearson"),
            F.abs(F.col(f"r_{i}_{j}")).alias("abs_pearson"),
        )
        for i, j in pairs
    ]


def _tiled_pearson(df: DataFrame, columns: list[str], values: list[Column]) -> DataFrame:
    """One group per pair of blocks; slots past the last column stay null and are left out."""
    blocks = -(-len(columns) // TILE)
    numbers = df.select(F.array(*[v.cast("double") for v in values]).alias("v"), F.lit(1).alias("real"))
    # one row of nulls for every tile, so that an empty table has its pairs too
    none = df.sparkSession.range(1).select(F.array_repeat(F.lit(None).cast("double"), len(columns)).alias("v"), F.lit(0).alias("real"))
    tiles = F.expr(
        f"flatten(transform(sequence(0, {blocks - 1}), a -> transform(sequence(a, {blocks - 1}), b -> struct(a * {TILE} as a, b * {TILE} as b))))"
    )
    met = numbers.unionAll(none).select("v", "real", F.inline(tiles))
    slots = range(TILE)
    cut = met.select(
        "a", "b", "real", *[F.get("v", F.col("a") + i).alias(f"x_{i}") for i in slots], *[F.get("v", F.col("b") + i).alias(f"y_{i}") for i in slots]
    )
    pairs = [(i, j) for i in slots for j in slots]
    xs, ys = [F.col(f"x_{i}") for i in slots], [F.col(f"y_{i}") for i in slots]
    measured = cut.groupBy("a", "b").agg(F.sum("real").alias("rows"), *_pearson_aggregates(xs, ys, pairs))
    entries = _pearson_entries(pairs, lambda i: F.col("a") + i, lambda j: F.col("b") + j)
    long = measured.select(F.inline(F.array(*entries))).where(f"{PAIR[0]} < {PAIR[1]} and {PAIR[1]} < {len(columns)}")
    names = F.array(*[F.lit(c) for c in columns])
    return long.withColumns({c: F.get(names, F.col(c)) for c in PAIR})


def rank_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of every pair, ranked inside its complete rows.

    A column is ranked once: one ordered pass over its distinct values counts, for every
    other column, the rows in which that one is present too, and so has the ranks of all
    its pairs.  They are joined back by value, one join a column; a value shared by very
    many rows is a skewed equi-join with one match per row, which AQE splits.  The rows
    shuffled grow with the columns, not with the pairs.
    """
    return _rank_correlation(df, _numbers(df, columns), list(combinations(columns, 2)))


def _ranks_of(shaped: DataFrame, i: int, partners: Sequence[int]) -> DataFrame:
    """(v_i, r_i): per distinct value, its centred rank among the rows complete with each partner."""
    measures = [f"n_{j}" for j in partners]
    counts = shaped.where(f"v_{i} is not null").groupBy(f"v_{i}").agg(
        *[F.count_if(F.col(f"v_{j}").isNotNull()).alias(n) for j, n in zip(partners, measures)]
    )
    centred = ", ".join(f"cum_{n} - ({n} + total_{n}) / 2.0D" for n in measures)
    return ordered_totals(counts, f"v_{i}", measures).selectExpr(f"v_{i}", f"array({centred}) as r_{i}")


def _rank_correlation(df: DataFrame, values: Mapping[str, Column], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    at_ = {n: i for i, n in enumerate(names)}
    partners = {i: sorted({at_[b] for p in pairs for a, b in (p, p[::-1]) if at_[a] == i}) for i in range(len(names))}
    # as a generated row: the optimiser would turn joins on a column of one literal into nested loops
    shaped = df.select(F.inline(F.array(F.struct(*[values[n].alias(f"v_{i}") for i, n in enumerate(names)]))))
    placed = shaped
    for i, own in partners.items():
        placed = placed.join(_ranks_of(shaped, i, own), f"v_{i}", "left")
    parts, entries = [], []
    for k, (a, b) in enumerate(pairs):
        i, j = at_[a], at_[b]
        x, y = F.col(f"r_{i}")[partners[i].index(j)], F.col(f"r_{j}")[partners[j].index(i)]
        both = F.col(f"v_{i}").isNotNull() & F.col(f"v_{j}").isNotNull()
        # ranks are exact halves, centred before
        parts += [F.count_if(both).alias(f"n_{k}"), weighted_pearson(x, y, F.when(both, F.lit(1))).alias(f"r_{k}")]
        r = F.col(f"r_{k}")
        entries.append(F.struct(F.lit(a).alias(PAIR[0]), F.lit(b).alias(PAIR[1]), F.col(f"n_{k}").alias("valid_rows"), r.alias("rank_r"), F.abs(r).alias("abs_rank_r")))
    return placed.agg(*parts).select(F.inline(F.array(*entries)))


def numeric_pairs(
    df: DataFrame,
    columns: Sequence[str],
    *,
    strong: float = STRONG_NUMERICAL,
    redundant: float = REDUNDANT_NUMERICAL,
) -> DataFrame:
    """Pearson and rank correlation with flags and a verbal class."""
    both = pearson_pairs(df, columns).join(rank_pairs(df, columns).drop("valid_rows"), PAIR, "left")
    top = F.greatest(F.coalesce("abs_pearson", F.lit(0.0)), F.coalesce("abs_rank_r", F.lit(0.0)))
    label = (
        F.when(F.col("pearson").isNull(), "Insufficient variation for correlation")
        .when((top >= strong) & (F.col("pearson") >= 0), "Strong positive numerical association")
        .when(top >= strong, "Strong negative numerical association")
        .when(top >= strong / 2, "Moderate numerical association")
        .otherwise("Limited numerical association")
    )
    redundancy = F.coalesce(F.col("abs_pearson") >= redundant, F.lit(False))
    return both.withColumns({"strong": top >= strong, "redundant": redundancy, "interpretation": label})


# --------------------------------------------------------------------------
# R3 - R5


def categorical_pairs(
    df: DataFrame,
    columns: Sequence[str],
    *,
    pairs: Sequence[tuple[str, str]] | None = None,
    strip_text: bool = False,
    strong: float = STRONG_CATEGORICAL,
    deterministic: float = DETERMINISTIC,
    redundant: float = REDUNDANT_CATEGORICAL,
) -> DataFrame:
    """Cramér's V, both uncertainty coefficients and dependency flags per pair."""
    pairs = list(pairs) if pairs is not None else list(combinations(columns, 2))
    cells = pair_counts(df, _labels(df, columns, strip_text), pairs)
    measured = _contingency_measures(cells)
    declared = _declared_pairs(df, pairs)
    out = declared.join(measured, PAIR, "left").withColumn("valid_rows", F.coalesce("valid_rows", F.lit(0)))
    largest = F.greatest("u_a_given_b", "u_b_given_a")
    structural = F.coalesce(largest >= deterministic, F.lit(False))
    redundancy = F.coalesce(
        (F.col("cramers_v") >= redundant) & (F.least("u_a_given_b", "u_b_given_a") >= deterministic), F.lit(False)
    )
    label = (
        F.when(F.col("cramers_v").isNull(), "Insufficient variation for categorical association")
        .when(F.col("redundant"), "Near-bidirectional categorical redundancy candidate")
        .when(F.col("structural"), "Strong directional structural dependency")
        .when(F.col("cramers_v") >= strong, "Strong categorical association")
        .when(F.col("cramers_v") >= strong / 2, "Moderate categorical association")
        .otherwise("Limited categorical association")
    )
    return (
        out.withColumns({"max_directional": largest, "structural": structural, "redundant": redundancy})
        .withColumn("interpretation", label)
        .select(
            *PAIR,
            "valid_rows",
            (F.col("rows") - F.col("valid_rows")).alias("missing_rows"),
            F.coalesce("cardinality_a", F.lit(0)).alias("cardinality_a"),
            F.coalesce("cardinality_b", F.lit(0)).alias("cardinality_b"),
            "cramers_v",
            "u_a_given_b",
            "u_b_given_a",
            "max_directional",
            "structural",
            "redundant",
            "interpretation",
        )
    )


def _declared_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    entries = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col("rows")) for a, b in pairs]
    return df.agg(F.count("*").alias("rows")).select(F.inline(F.array(*entries)))


def _contingency_measures(cells: DataFrame) -> DataFrame:
    """V and U of each pair from its cell counts.

    Entropies need only marginal counts.  Chi-squared uses
    n·(Σ o²/(row·column) − 1), so absent cells need no rows and marginals are
    looked up by equi-join.
    """
    rows = cells.groupBy(*PAIR, "value_a").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy(*PAIR, "value_b").agg(F.sum("n").alias("col_n"))
    row_stats = rows.groupBy(*PAIR).agg(
        F.count("*").alias("cardinality_a"), F.sum(n_log_n(F.col("row_n"))).alias("_a")
    )
    col_stats = cols.groupBy(*PAIR).agg(
        F.count("*").alias("cardinality_b"), F.sum(n_log_n(F.col("col_n"))).alias("_b")
    )
    share = F.col("n").cast("double") * F.col("n") / (F.col("row_n").cast("double") * F.col("col_n"))
    totals = (
        cells.join(rows, [*PAIR, "value_a"])
        .join(cols, [*PAIR, "value_b"])
        .groupBy(*PAIR)
        .agg(F.sum("n").alias("valid_rows"), F.sum(share).alias("_phi"), F.sum(n_log_n(F.col("n"))).alias("_ab"))
    )
    stats = totals.join(row_stats, PAIR).join(col_stats, PAIR)
    varied = (F.col("cardinality_a") > 1) & (F.col("cardinality_b") > 1)
    smaller = F.least("cardinality_a", "cardinality_b") - 1
    v = F.sqrt(F.greatest(F.try_divide(F.col("_phi") - 1, smaller.cast("double")), F.lit(0.0)))
    ha, hb, hab = (entropy(F.col(c), F.col("valid_rows")) for c in ("_a", "_b", "_ab"))
    return stats.select(
        *PAIR,
        "valid_rows",
        "cardinality_a",
        "cardinality_b",
        F.when(varied, clamp01(v)).alias("cramers_v"),
        F.when(varied, uncertainty(ha, hb, hab)).alias("u_a_given_b"),
        F.when(varied, uncertainty(hb, ha, hab)).alias("u_b_given_a"),
    )


# --------------------------------------------------------------------------
# R6


def eta_squared_pairs(
    df: DataFrame, categorical: Sequence[str], numerical: Sequence[str], *, strong: float = STRONG_MIXED
) -> DataFrame:
    """Share of a number's variance explained by a category, for every mixed pair."""
    labels, numbers = _labels(df, categorical), _numbers(df, numerical)
    shaped = df.select(
        *[labels[c].alias(f"c{i}") for i, c in enumerate(categorical)],
        *[numbers[m].alias(f"m{i}") for i, m in enumerate(numerical)],
    )
    entries = [
        F.struct(F.lit(c).alias("categorical"), F.col(f"c{i}").alias("category"))
        for i, c in enumerate(categorical)
    ]
    long = shaped.select(F.inline(F.array(*entries)), *[f"m{i}" for i in range(len(numerical))])
    # One group-by for all pairs: numeric moments stay side by side in each group.
    groups = long.groupBy("categorical", "category").agg(
        F.count("*").alias("rows"),
        *[f(F.col(f"m{i}")).alias(f"{k}{i}") for i in range(len(numerical)) for k, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))],
        *[F.min(f"m{i}").alias(f"lo{i}") for i in range(len(numerical))],
        *[F.max(f"m{i}").alias(f"hi{i}") for i in range(len(numerical))],
    )
    per_pair = groups.select(
        "categorical",
        "category",
        "rows",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("numerical"),
                        F.col(f"n{i}").alias("n"),
                        F.col(f"mean{i}").alias("mean"),
                        F.col(f"var{i}").alias("var"),
                        F.col(f"lo{i}").alias("lo"),
                        F.col(f"hi{i}").alias("hi"),
                    )
                    for i, m in enumerate(numerical)
                ]
            )
        ),
    )
    used = F.col("category").isNotNull() & (F.col("n") > 0)

    def over(c: Column) -> Column:
        return F.when(used, c)

    key = ["categorical", "numerical"]
    grand = per_pair.groupBy(*key).agg(
        F.try_divide(F.sum(over(F.col("n") * F.col("mean"))), F.sum(over(F.col("n"))).cast("double")).alias("grand")
    )
    offset = F.col("mean") - F.col("grand")
    out = per_pair.join(grand, key).groupBy(*key).agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(over(F.col("n"))), F.lit(0)).alias("valid_rows"),
        F.count_if(used).alias("categories"),
        F.sum(over(F.col("n") * offset * offset)).alias("_b"),
        F.sum(over(F.col("n") * F.col("var"))).alias("_w"),
        F.min(over(F.col("lo"))).alias("_lo"),
        F.max(over(F.col("hi"))).alias("_hi"),
    )
    between = F.col("_b")
    varied = (F.col("categories") > 1) & (F.col("_lo") < F.col("_hi"))
    eta = F.when(varied, clamp01(F.try_divide(between, between + F.col("_w"))))
    label = (
        F.when(F.col("eta_squared").isNull(), "Insufficient variation for mixed association")
        .when(F.col("eta_squared") >= strong, "Strong categorical-to-numerical association")
        .when(F.col("eta_squared") >= strong / 2, "Moderate categorical-to-numerical association")
        .otherwise("Limited categorical-to-numerical association")
    )
    return out.withColumn("eta_squared", eta).select(
        "categorical",
        "numerical",
        "valid_rows",
        (F.col("rows") - F.col("valid_rows")).alias("missing_rows"),
        "categories",
        "eta_squared",
        F.coalesce(F.col("eta_squared") >= strong, F.lit(False)).alias("strong"),
        label.alias("interpretation"),
    )


# --------------------------------------------------------------------------
# R7 - R9


def interaction(
    df: DataFrame,
    name: str,
    left: str,
    right: str,
    compare_to: str,
    *,
    strong: float = STRONG_NUMERICAL,
    redundant: float = REDUNDANT_NUMERICAL,
) -> DataFrame:
    """The product of two columns against a third: correlations and differences."""
    v = _numbers(df, [left, right, compare_to])
    paired = df.select((v[left] * v[right]).alias("x"), v[compare_to].alias("y"))
    gap = F.abs(F.col("x") - F.col("y"))
    whole = paired.withColumns(
        {"gap": gap, "relative": F.try_divide(gap, F.abs(F.col("y")))}
    )
    moments = whole.agg(
        F.count("*").alias("rows"),
        F.count("gap").alias("valid_rows"),
        pearson(F.col("x"), F.col("y")).alias("pearson"),
        F.avg("gap").alias("mean_abs_difference"),
        F.avg("relative").alias("mean_relative_difference"),
    )
    median = one_row(exact_quantiles(whole.where(F.col("gap").isNotNull()), "gap", {"median": 0.5}))
    ranked = _rank_correlation(paired, {"x": F.col("x"), "y": F.col("y")}, [("x", "y")])
    rank = one_row(ranked.agg(F.max("rank_r").alias("rank_r")))
    out = moments.withColumns({"_m": median, "_r": rank})
    top = F.greatest(F.coalesce(F.abs("pearson"), F.lit(0.0)), F.coalesce(F.abs(F.col("_r.rank_r")), F.lit(0.0)))
    redundancy = F.coalesce(F.abs("pearson") >= redundant, F.lit(False))
    label = (
        F.when(F.col("pearson").isNull(), "Insufficient variation for interaction comparison")
        .when(redundancy, "Strong derived-feature redundancy candidate")
        .when(top >= strong, "Strong interaction relationship")
        .otherwise("Limited interaction relationship")
    )
    return out.select(
        F.lit(name).alias("interaction"),
        "valid_rows",
        (F.col("rows") - F.col("valid_rows")).alias("missing_rows"),
        "pearson",
        F.col("_r.rank_r").alias("rank_r"),
        "mean_abs_difference",
        F.col("_m.median").alias("median_abs_difference"),
        "mean_relative_difference",
        (top >= strong).alias("strong"),
        redundancy.alias("redundant"),
        label.alias("interpretation"),
    )


def association_matrix(pairs: DataFrame, measure: str, columns: Sequence[str]) -> DataFrame:
    """Symmetric matrix with unit diagonal from a long pair table."""
    mirrored = pairs.select("feature_a", "feature_b", measure).unionAll(
        pairs.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), measure)
    )
    # The whole table has one row per declared pair.
    wide = mirrored.groupBy(F.col("feature_a").alias("feature")).pivot("feature_b", list(columns)).agg(F.max(measure))
    return wide.select("feature", *[F.when(F.col("feature") == c, F.lit(1.0)).otherwise(F.col(c)).alias(c) for c in columns])


def mixed_matrix(pairs: DataFrame, numerical: Sequence[str]) -> DataFrame:
    """Categorical rows by numerical columns of eta squared."""
    return pairs.groupBy(F.col("categorical").alias("feature")).pivot("numerical", list(numerical)).agg(F.max("eta_squared"))


def relationship_summary(
    df: DataFrame,
    numerical: Sequence[str],
    categorical: Sequence[str],
    interactions: Sequence[Mapping[str, str]] = (),
    *,
    strong_categorical: float = STRONG_CATEGORICAL,
) -> DataFrame:
    """Study-level counts of pairs and of strong, structural and redundant ones."""
    have_num = [c for c in numerical if c in df.columns]
    have_cat = [c for c in categorical if c in df.columns]
    num = one_row(
        numeric_pairs(df, have_num).agg(
            F.count("*").alias("pairs"), F.count_if("strong").alias("strong"), F.count_if("redundant").alias("redundant")
        )
    )
    cat = one_row(
        categorical_pairs(df, have_cat).agg(
            F.count("*").alias("pairs"),
            F.count_if(F.col("cramers_v") >= strong_categorical).alias("strong"),
            F.count_if("structural").alias("structural"),
            F.count_if("redundant").alias("redundant"),
        )
    )
    mixed = one_row(
        eta_squared_pairs(df, have_cat, have_num).agg(F.count("*").alias("pairs"), F.count_if("strong").alias("strong"))
    )
    extra = F.lit(0).cast("bigint")
    for spec in interactions:
        flag = interaction(df, spec["name"], spec["left"], spec["right"], spec["compare_to"])
        extra = extra + flag.agg(F.count_if("redundant").alias("r")).scalar()
    packed = df.sparkSession.range(1).select(num.alias("n"), cat.alias("c"), mixed.alias("m"), extra.alias("x"))

    def fixed(v: int) -> Column:
        return F.lit(v).cast("bigint")

    lines = [
        ("Requested numerical features", fixed(len(numerical))),
        ("Available numerical features", fixed(len(have_num))),
        ("Missing numerical features", fixed(len(numerical) - len(have_num))),
        ("Requested categorical features", fixed(len(categorical))),
        ("Available categorical features", fixed(len(have_cat))),
        ("Missing categorical features", fixed(len(categorical) - len(have_cat))),
        ("Numerical relationships", F.col("n.pairs")),
        ("Categorical relationships", F.col("c.pairs")),
        ("Categorical-numerical relationships", F.col("m.pairs")),
        ("Interaction candidates", fixed(len(interactions))),
        ("Strong numerical relationships", F.col("n.strong")),
        ("Strong categorical relationships", F.col("c.strong")),
        ("Strong mixed relationships", F.col("m.strong")),
        ("Structural categorical dependencies", F.col("c.structural")),
        ("Redundancy review candidates", F.col("n.redundant") + F.col("c.redundant") + F.col("x")),
    ]
    return packed.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in lines])))
