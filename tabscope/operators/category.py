"""Category frequencies, rarity, label variants, domains and groupings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import ratio, ratio_or_zero
from .scale import at, by_name, literal_table, ordered_totals, unpivot

# Default rarity and cardinality limits.
RARE_COUNT = 50
RARE_SHARE = 0.01
HIGH_CARDINALITY = 20


def _as_text(df: DataFrame, feature: str) -> Column:
    """Category text, null where missing or blank; label spacing is kept."""
    return text.clean_category(F.col(f"`{feature}`"), df.schema[feature].dataType, strip_text=False)


def _textual(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [f for f in features if text.is_text(df.schema[f].dataType)]


def category_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, category, n) of all features from one scan and one shuffle."""
    long = unpivot(df, {f: _as_text(df, f) for f in features}, value="category")
    return long.where(F.col("category").isNotNull()).groupBy("feature", "category").agg(F.count("*").alias("n"))


def _normalized(df: DataFrame, features: Sequence[str]) -> Column:
    """Comparison key: folded for text features, unchanged for typed ones."""
    names = _textual(df, features)
    return F.when(F.col("feature").isin(names), text.fold(F.col("category"))).otherwise(F.col("category"))


def _domain(df: DataFrame, expected: Mapping[str, Sequence]) -> DataFrame:
    rows, textual = [], set(_textual(df, [f for f in expected if f in df.columns]))
    for f, values in expected.items():
        rows += [{"feature": f, "expected_category": str(v), "position": i, "textual": f in textual} for i, v in enumerate(values, 1)]
    schema = pa.schema(
        [("feature", pa.string()), ("expected_category", pa.string()), ("position", pa.int32()), ("textual", pa.bool_())]
    )
    table = literal_table(df.sparkSession, rows, schema)
    key = F.when(F.col("textual"), text.fold(F.col("expected_category"))).otherwise(F.col("expected_category"))
    return table.select("feature", "expected_category", "position", key.alias("normalized"))


def _expected_flag(expected: Mapping[str, Sequence], df: DataFrame) -> Column:
    """True where the category is declared, or its feature declares no domain."""
    flag = F.lit(True)
    textual = set(_textual(df, [f for f in expected if f in df.columns]))
    for f, values in expected.items():
        keys = [F.lit(str(v).strip().casefold() if f in textual else str(v)) for v in values]
        flag = F.when(F.col("feature") == f, F.col("normalized").isin(keys)).otherwise(flag)
    return flag


def _triggers(n: Column, share: Column, rare_count: int, rare_share: float) -> Column:
    return F.concat_ws(
        ", ", F.when(n < rare_count, F.lit("count")), F.when(share < rare_share, F.lit("share"))
    )


def category_frequencies(
    df: DataFrame,
    features: Sequence[str],
    expected: Mapping[str, Sequence] | None = None,
    *,
    rare_count: int = RARE_COUNT,
    rare_share: float = RARE_SHARE,
) -> DataFrame:
    """Count, share, rank and flags per category.

    Rank is one plus the number of categories with a larger count, so tied
    categories share it (row order, which would break ties, does not exist in a
    distributed table).  It is read from running totals over the *distinct
    counts* of a feature, never from a window over its categories.
    """
    expected = expected or {}
    counts = category_counts(df, features)
    tiers = counts.groupBy("feature", "n").agg(
        F.count("*").alias("categories"), F.sum("n").alias("rows")
    )
    ranked = ordered_totals(tiers, "n", ["categories", "rows"], ["feature"], descending=True).select(
        "feature",
        "n",
        (F.col("cum_categories") - F.col("categories") + 1).alias("rank"),
        F.col("total_rows").alias("valid"),
    )
    share = ratio(F.col("n"), F.col("valid"))
    trigger = _triggers(F.col("n"), F.col("share"), rare_count, rare_share)
    return (
        counts.join(ranked, ["feature", "n"])
        .withColumns({"share": share, "normalized": _normalized(df, features)})
        .select(
            "feature",
            "category",
            "n",
            "share",
            "rank",
            _expected_flag(expected, df).alias("expected"),
            (trigger != "").alias("rare"),
            trigger.alias("rare_trigger"),
            (F.col("rank") == 1).alias("dominant"),
            "normalized",
        )
    )


def _with_share(df: DataFrame, features: Sequence[str]) -> DataFrame:
    counts = category_counts(df, features)
    valid = by_name(counts.groupBy("feature").agg(F.sum("n").alias("valid")), "feature", ["valid"])
    return counts.withColumn("_t", at(valid, F.col("feature"))).select(
        "feature", "category", "n", ratio(F.col("n"), F.col("_t.valid")).alias("share")
    )


def rare_categories(
    df: DataFrame, features: Sequence[str], *, rare_count: int = RARE_COUNT, rare_share: float = RARE_SHARE
) -> DataFrame:
    trigger = _triggers(F.col("n"), F.col("share"), rare_count, rare_share)
    return _with_share(df, features).withColumn("trigger", trigger).where(F.col("trigger") != "")


def label_variants(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Raw labels that differ only by case or surrounding spaces, one row per label."""
    names = _textual(df, features)
    counts = category_counts(df, names).withColumn("normalized", text.fold(F.col("category")))
    groups = counts.groupBy("feature", "normalized").agg(
        F.count("*").alias("variants"), F.sum("n").alias("rows")
    )
    return counts.join(groups.where(F.col("variants") > 1), ["feature", "normalized"])


def domain_violations(df: DataFrame, expected: Mapping[str, Sequence]) -> DataFrame:
    """Unexpected and absent categories, compared on the normalised label."""
    features = list(expected)
    counts = category_counts(df, features).withColumn("normalized", _normalized(df, features))
    domain = _domain(df, expected)
    unexpected = counts.where(~_expected_flag(expected, df)).select(
        "feature", F.lit("Unexpected categories").alias("issue"), "category", "n"
    )
    seen = counts.select("feature", "normalized").distinct()
    absent = domain.join(seen, ["feature", "normalized"], "left_anti").select(
        "feature",
        F.lit("Missing expected categories").alias("issue"),
        F.col("expected_category").alias("category"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return unexpected.unionByName(absent)


def category_grouping(df: DataFrame, feature: str, groups: Mapping[str, Sequence]) -> DataFrame:
    """Rows per declared group; unknown or multiply assigned labels are Unassigned."""
    counts = category_counts(df, [feature]).withColumn("normalized", _normalized(df, [feature]))
    rows = [{"feature": feature, "group": g, "expected_category": str(c)} for g, cs in groups.items() for c in cs]
    textual = bool(_textual(df, [feature]))
    fold = text.fold(F.col("expected_category")) if textual else F.col("expected_category")
    schema = pa.schema([("feature", pa.string()), ("group", pa.string()), ("expected_category", pa.string())])
    mapping = (
        literal_table(df.sparkSession, rows, schema)
        .select(fold.alias("normalized"), "group")
        .groupBy("normalized")
        .agg(F.count("*").alias("uses"), F.min("group").alias("group"))
        .where(F.col("uses") == 1)
        .select("normalized", "group")
    )
    assigned = counts.join(mapping, "normalized", "left").groupBy("group").agg(F.sum("n").alias("n"))
    total = assigned.agg(F.sum("n").alias("t")).scalar()
    names = literal_table(
        df.sparkSession, [{"group": g} for g in groups], pa.schema([("group", pa.string())])
    )
    merged = (
        assigned.select(F.coalesce("group", F.lit("Unassigned")).alias("group"), "n")
        .unionByName(names.withColumn("n", F.lit(0).cast("bigint")))
        .groupBy("group")
        .agg(F.sum("n").alias("n"))
    )
    coverage = F.when(F.col("group") == "Unassigned", "Requires review").otherwise("Defined")
    return merged.select(
        F.lit(feature).alias("feature"), "group", "n", ratio_or_zero(F.col("n"), total).alias("share"), coverage.alias("coverage")
    )


def grouping_issues(
    df: DataFrame, feature: str, groups: Mapping[str, Sequence], expected: Sequence = ()
) -> DataFrame:
    """Unknown, multiply assigned and ungrouped categories of a grouping.

    The reference domain is the declared one, else the observed labels.
    """
    textual = bool(_textual(df, [feature]))

    def key(c: Column) -> Column:
        return text.fold(c) if textual else c

    spark = df.sparkSession
    if expected:
        table = literal_table(spark, [{"category": str(v)} for v in expected], pa.schema([("category", pa.string())]))
    else:
        table = category_counts(df, [feature]).select("category")
    known = table.groupBy(key(F.col("category")).alias("normalized")).agg(F.min("category").alias("category"))
    rows = [{"group": g, "category": str(c)} for g, cs in groups.items() for c in cs]
    schema = pa.schema([("group", pa.string()), ("category", pa.string())])
    uses = (
        literal_table(spark, rows, schema)
        .groupBy(key(F.col("category")).alias("normalized"))
        .agg(F.count("*").alias("uses"), F.min("category").alias("declared"))
    )
    both = known.join(uses, "normalized", "full_outer")
    unknown = both.where(F.col("category").isNull())
    double = both.where(F.col("uses") > 1)
    loose = both.where(F.col("uses").isNull())
    shown = F.coalesce("category", "declared").alias("category")
    out = [
        part.select(F.lit(feature).alias("feature"), F.lit(label).alias("issue"), shown)
        for part, label in (
            (unknown, "Unknown grouping categories"),
            (double, "Categories assigned to multiple groups"),
            (loose, "Ungrouped categories"),
        )
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


def category_summary(
    df: DataFrame,
    features: Sequence[str],
    expected: Mapping[str, Sequence] | None = None,
    *,
    rare_count: int = RARE_COUNT,
    rare_share: float = RARE_SHARE,
    high_cardinality: int = HIGH_CARDINALITY,
    groupings: Mapping[str, Mapping[str, Sequence]] | None = None,
) -> DataFrame:
    """One row per feature: volumes, mode, rarity, domain and status list.

    ``mode`` is the alphabetically first of ``mode_ties`` equally frequent labels.
    """
    expected, groupings = expected or {}, groupings or {}
    parts, entries = [F.count("*").alias("rows")], []
    for i, f in enumerate(features):
        col, dtype = F.col(f"`{f}`"), df.schema[f].dataType
        parts += [F.count_if(text.missing(col, dtype)).alias(f"m_{i}"), F.count_if(text.blank(col, dtype)).alias(f"b_{i}")]
        size = F.lit(len(expected[f])) if f in expected else F.lit(None).cast("int")
        entries.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.col("rows"),
                F.col(f"m_{i}").alias("missing"),
                F.col(f"b_{i}").alias("blank"),
                size.alias("expected_cardinality"),
            )
        )
    base = df.agg(*parts).select(F.inline(F.array(*entries)))

    shares = _with_share(df, features).withColumn("normalized", _normalized(df, features))
    trigger = _triggers(F.col("n"), F.col("share"), rare_count, rare_share) != ""
    flagged = shares.withColumns({"_rare": trigger, "_expected": _expected_flag(expected, df)})
    # Level 1: per comparison key; level 2: per feature.
    keys = flagged.groupBy("feature", "normalized").agg(
        F.count("*").alias("labels"),
        F.sum("n").alias("n"),
        F.max("n").alias("top"),
        F.count_if("_rare").alias("rare"),
        F.sum(F.when(F.col("_rare"), F.col("n")).otherwise(0)).alias("rare_rows"),
        F.count_if(~F.col("_expected")).alias("unexpected"),
        F.bool_or("_expected").alias("_known"),
    )
    textual = _textual(df, features)
    stats = keys.groupBy("feature").agg(
        F.sum("labels").alias("cardinality"),
        F.sum("n").alias("valid"),
        F.max("top").alias("mode_count"),
        F.sum("rare").alias("rare_categories"),
        F.sum("rare_rows").alias("rare_rows"),
        F.sum("unexpected").alias("unexpected_categories"),
        F.count_if("_known").alias("known_keys"),
        F.count_if(F.col("feature").isin(textual) & (F.col("labels") > 1)).alias("inconsistent_labels"),
    )
    top = by_name(stats, "feature", ["mode_count"])
    modes = (
        shares.withColumn("_t", at(top, F.col("feature")))
        .where(F.col("n") == F.col("_t.mode_count"))
        .groupBy("feature")
        .agg(F.min("category").alias("mode"), F.count("*").alias("mode_ties"))
    )
    s = by_name(
        stats,
        "feature",
        ["cardinality", "valid", "mode_count", "rare_categories", "rare_rows", "unexpected_categories", "known_keys", "inconsistent_labels"],
    )
    m = by_name(modes, "feature", ["mode", "mode_ties"])
    columns = {"_s": at(s, F.col("feature")), "_m": at(m, F.col("feature"))}
    issues = None
    for f, groups in groupings.items():
        part = grouping_issues(df, f, groups, expected.get(f, ()))
        issues = part if issues is None else issues.unionByName(part)
    if issues is not None:
        per = issues.groupBy("feature").agg(F.count_distinct("issue").alias("grouping_issues"))
        columns["_g"] = at(by_name(per, "feature", ["grouping_issues"]), F.col("feature"))
    joined = base.withColumns(columns)
    zero = F.lit(0).cast("bigint")

    def got(name: str) -> Column:
        return F.coalesce(F.col(f"_s.{name}"), zero)

    grouped = F.coalesce(F.col("_g.grouping_issues"), zero) if issues is not None else zero
    # Declared keys not seen under any label of the feature.
    absent = F.when(F.col("expected_cardinality").isNotNull(), F.col("_declared_keys") - got("known_keys")).otherwise(zero)
    declared = F.lit(0).cast("bigint")
    for f, values in expected.items():
        size = len({str(v).strip().casefold() if f in textual else str(v) for v in values})
        declared = F.when(F.col("feature") == f, F.lit(size).cast("bigint")).otherwise(declared)
    joined = joined.withColumn("_declared_keys", declared)
    high = got("cardinality") > high_cardinality
    status = F.concat_ws(
        ", ",
        F.when(F.col("missing") > 0, "Missing values"),
        F.when(F.col("blank") > 0, "Blank values"),
        F.when(got("unexpected_categories") > 0, "Unexpected categories"),
        F.when(absent > 0, "Missing expected categories"),
        F.when(got("inconsistent_labels") > 0, "Inconsistent labels"),
        F.when(got("rare_categories") > 0, "Rare categories"),
        F.when(high, "High cardinality"),
        F.when(grouped > 0, "Grouping review"),
    )
    return joined.select(
        "feature",
        "rows",
        got("valid").alias("valid"),
        "missing",
        "blank",
        got("cardinality").alias("cardinality"),
        "expected_cardinality",
        F.col("_m.mode").alias("mode"),
        F.coalesce(F.col("_m.mode_ties"), zero).alias("mode_ties"),
        got("mode_count").alias("mode_count"),
        ratio(got("mode_count"), got("valid")).alias("mode_share"),
        got("rare_categories").alias("rare_categories"),
        got("rare_rows").alias("rare_rows"),
        got("unexpected_categories").alias("unexpected_categories"),
        absent.alias("missing_expected_categories"),
        got("inconsistent_labels").alias("inconsistent_labels"),
        high.alias("high_cardinality"),
        grouped.alias("grouping_issues"),
        F.when(status == "", "Analyzed").otherwise(status).alias("status"),
    )


def categorical_study_summary(
    df: DataFrame,
    features: Sequence[str],
    expected: Mapping[str, Sequence] | None = None,
    groupings: Mapping[str, Mapping[str, Sequence]] | None = None,
    **limits,
) -> DataFrame:
    """Eleven study-level counts over :func:`category_summary`."""
    available = [f for f in features if f in df.columns]
    profile = category_summary(df, available, expected, groupings=groupings, **limits)
    counted = {
        "Features with missing values": F.count_if(F.col("missing") > 0),
        "Features with blank values": F.count_if(F.col("blank") > 0),
        "Features with rare categories": F.count_if(F.col("rare_categories") > 0),
        "Features with inconsistent labels": F.count_if(F.col("inconsistent_labels") > 0),
        "Features with unexpected categories": F.count_if(F.col("unexpected_categories") > 0),
        "Features missing expected categories": F.count_if(F.col("missing_expected_categories") > 0),
        "High-cardinality features": F.count_if("high_cardinality"),
        "Candidate grouping issues": F.coalesce(F.sum("grouping_issues"), F.lit(0)),
    }
    totals = profile.agg(*[v.alias(f"c{i}") for i, v in enumerate(counted.values())])
    lines = [
        ("Requested categorical features", F.lit(len(features)).cast("bigint")),
        ("Available categorical features", F.lit(len(available)).cast("bigint")),
        ("Missing categorical features", F.lit(len(features) - len(available)).cast("bigint")),
    ] + [(m, F.col(f"c{i}")) for i, m in enumerate(counted)]
    return totals.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in lines])))
