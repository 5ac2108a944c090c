"""Keys, value rules, type contracts: what is wrong in a table, in one scan each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text
from . import checks as K
from .scale import literal_table

# Issue labels, in reporting order.
ISSUES = (
    "Inconsistent text",
    "Missing value",
    "Blank value",
    "Unexpected value",
    "Non-numeric value",
    "Non-integer value",
    "Below minimum",
    "Above maximum",
)


@dataclass(frozen=True)
class ValueRule:
    """Declared expectations for one column."""

    required: bool = False
    allow_blank: bool = False
    allowed: tuple | None = None
    numeric: bool = False
    integer: bool = False
    minimum: float | None = None
    maximum: float | None = None
    strip_strings: bool = False
    case_sensitive: bool = True

    def __post_init__(self) -> None:
        if self.allowed is not None and (isinstance(self.allowed, str) or not len(tuple(self.allowed))):
            raise ValueError("allowed must be a non-empty collection")
        if (self.minimum is not None or self.maximum is not None) and not (self.numeric or self.integer):
            raise ValueError("numeric limits need numeric=True")
        if self.minimum is not None and self.maximum is not None and self.minimum > self.maximum:
            raise ValueError("minimum is greater than maximum")


# --------------------------------------------------------------------------
# masks


def in_domain(value: Column, allowed: Sequence) -> Column:
    return value.isin(list(allowed))


def in_domain_normalized(value: Column, allowed: Sequence[str], *, strip_strings: bool, case_sensitive: bool) -> Column:
    def shape(c: Column) -> Column:
        c = text.strip(c) if strip_strings else c
        return c if case_sensitive else text.fold_case(c)

    return shape(value).isin([shape(F.lit(a)) for a in allowed])


def issue_masks(value: Column, dtype: T.DataType, rule: ValueRule) -> dict[str, Column]:
    """One never-null boolean per applicable issue."""
    missing, blank = text.missing(value, dtype), text.blank(value, dtype)
    candidate = ~(missing | blank)
    masks: dict[str, Column] = {}
    if rule.required:
        masks["Missing value"] = missing
    if not rule.allow_blank:
        masks["Blank value"] = blank
    if rule.allowed is not None:
        outside = candidate & ~in_domain(value, rule.allowed)
        variant = F.lit(False)
        if text.is_text(dtype) and all(isinstance(a, str) for a in rule.allowed):
            variant = outside & in_domain_normalized(
                value, rule.allowed, strip_strings=rule.strip_strings, case_sensitive=rule.case_sensitive
            )
        masks["Inconsistent text"] = variant
        masks["Unexpected value"] = outside & ~variant
    if rule.numeric or rule.integer:
        number = text.to_number(value, dtype)
        valid = candidate & number.isNotNull()
        masks["Non-numeric value"] = candidate & number.isNull()
        if rule.integer:
            masks["Non-integer value"] = valid & (F.abs(F.pmod(number, F.lit(1.0))) > 1e-12)
        if rule.minimum is not None:
            masks["Below minimum"] = valid & (number < F.lit(float(rule.minimum)))
        if rule.maximum is not None:
            masks["Above maximum"] = valid & (number > F.lit(float(rule.maximum)))
    return {k: F.coalesce(m, F.lit(False)) for k, m in masks.items()}


def _any(masks: Sequence[Column]) -> Column:
    out = F.lit(False)
    for m in masks:
        out = out | m
    return out


# --------------------------------------------------------------------------
# value rules


def value_quality(df: DataFrame, rules: Mapping[str, ValueRule]) -> DataFrame:
    """Issue counts per column from a single scan with map-side aggregation."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggregates, entries = [F.count("*").alias("rows")], []
    for i, (name, rule) in enumerate((n, r) for n, r in rules.items() if n in types):
        value, dtype = F.col(f"`{name}`"), types[name]
        masks = issue_masks(value, dtype, rule)
        variant = masks.get("Inconsistent text", F.lit(False))
        invalid = _any([m for k, m in masks.items() if k != "Inconsistent text"])
        counted = {
            "missing": text.missing(value, dtype),
            "blank": text.blank(value, dtype),
            "inconsistent": variant,
            "invalid": invalid,
            "affected": invalid | variant,
        }
        aggregates += [F.count_if(m).alias(f"{k}_{i}") for k, m in counted.items()]
        aggregates += [F.count_if(masks[k]).alias(f"issue_{i}_{j}") for j, k in enumerate(ISSUES) if k in masks]
        found = [
            F.when(F.col(f"issue_{i}_{j}") > 0, F.lit(k)) for j, k in enumerate(ISSUES) if k in masks
        ]
        affected = F.col(f"affected_{i}")
        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col("rows").alias("rows"),
                *[F.col(f"{k}_{i}").alias(k) for k in counted],
                F.coalesce(F.round(F.try_divide(affected * F.lit(100.0), F.col("rows")), 4), F.lit(0.0)).alias(
                    "affected_percent"
                ),
                F.concat_ws(", ", *found).alias("issue_types"),
                F.when(affected > 0, "Review required").otherwise("Valid").alias("status"),
            )
        )
    shape = "column string, rows bigint, missing bigint, blank bigint, inconsistent bigint, invalid bigint, affected bigint, affected_percent double, issue_types string, status string"
    zero = "cast(0 as bigint)"
    for name in dict.fromkeys([*types, *rules]):
        if name in types and name in rules:
            continue
        rows = F.col("rows") if name in types else F.lit(0).cast("bigint")
        status = "Not assessed" if name in types else "Missing column"
        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                rows.alias("rows"),
                *[F.expr(zero).alias(k) for k in ("missing", "blank", "inconsistent", "invalid", "affected")],
                F.lit(0.0).alias("affected_percent"),
                F.lit("").alias("issue_types"),
                F.lit(status).alias("status"),
            )
        )
    element = T._parse_datatype_string(shape)
    typed = [e.cast(element) for e in entries]
    return df.agg(*aggregates).select(F.inline(F.array(*typed)))


def value_issue_samples(df: DataFrame, rules: Mapping[str, ValueRule], k: int = 10) -> DataFrame:
    """The k most frequent raw values per (column, issue); missing is one value.

    Only failing cells are exploded.  The top-k window is pruned map-side (window
    group limit), so no task holds more than k rows per (column, issue) and task.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    entries = []
    for name, rule in rules.items():
        if name not in types:
            continue
        value = F.col(f"`{name}`")
        for issue, mask in issue_masks(value, types[name], rule).items():
            shown = F.lit("<missing>") if issue == "Missing value" else value.cast("string")
            entries.append(
                F.when(
                    mask,
                    F.struct(F.lit(name).alias("column"), F.lit(issue).alias("issue"), shown.alias("raw_value")),
                )
            )
    failing = df.select(F.inline(F.array_compact(F.array(*entries))))
    counts = failing.groupBy("column", "issue", "raw_value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column", "issue").orderBy(F.desc("n"), F.asc("raw_value"))
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


# --------------------------------------------------------------------------
# keys


def _key_present(key: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(c).isNotNull()
    return out


def key_profile(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Completeness and uniqueness of an identifier; nulls are not duplicates."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("n"))
    present = _key_present(key)
    repeated = present & (F.col("n") > 1)

    def total(mask: Column) -> Column:
        return F.coalesce(F.sum(F.when(mask, F.col("n"))), F.lit(0))

    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        total(present).alias("non_null"),
        F.count_if(present).alias("unique_values"),
        total(~present).alias("missing"),
        F.count_if(repeated).alias("duplicated_values"),
        total(repeated).alias("duplicated_rows"),
    )


def duplicated_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose non-null key repeats.

    The repeated keys are found with map-side counting and the rows are matched
    by a semi join, whose hot keys AQE splits; a window over the key would put
    all rows of a hot key into one task.
    """
    repeated = (
        df.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select(*key)
    )
    return df.join(repeated, list(key), "left_semi")


# --------------------------------------------------------------------------
# schema contracts

# Accepted names of type families.
FAMILY_NAMES = {
    "any": "any",
    "bool": "boolean",
    "boolean": "boolean",
    "category": "categorical",
    "categorical": "categorical",
    "date": "datetime",
    "datetime": "datetime",
    "float": "floating",
    "floating": "floating",
    "int": "integer",
    "integer": "integer",
    "number": "numeric",
    "numeric": "numeric",
    "str": "string",
    "string": "string",
    "text": "string",
    "timedelta": "timedelta",
}


def type_family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if text.is_floating(dtype):
        return "floating"
    if isinstance(dtype, T.DecimalType):
        return "numeric"
    if text.is_text(dtype):
        return "string"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.DayTimeIntervalType):
        return "timedelta"
    return dtype.simpleString()


def matches_family(dtype: T.DataType, expected: str) -> bool:
    try:
        family = FAMILY_NAMES[expected.strip().lower()]
    except KeyError:
        raise ValueError(f"unsupported expected type: {expected!r}") from None
    observed = type_family(dtype)
    if family == "any":
        return True
    if family == "numeric":
        return observed in ("integer", "floating", "numeric")
    if family == "categorical":
        return observed == "string"
    return observed == family


# Contract states, in reporting order.
CONTRACT_STATES = ("Match", "Mismatch", "Not declared", "Missing column")


def schema_check(df: DataFrame, expected: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Declared against observed type families; reads the schema, not the data."""
    observed = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for name in dict.fromkeys([*observed, *expected]):
        wanted = expected.get(name, ())
        wanted = (wanted,) if isinstance(wanted, str) else tuple(wanted)
        if name not in observed:
            state = CONTRACT_STATES[3]
        elif not wanted:
            state = CONTRACT_STATES[2]
        else:
            state = CONTRACT_STATES[0 if any(matches_family(observed[name], w) for w in wanted) else 1]
        rows.append(
            {
                "column": name,
                "expected_type": " | ".join(wanted),
                "observed_type": type_family(observed[name]) if name in observed else "",
                "status": state,
            }
        )
    schema = pa.schema([(c, pa.string()) for c in ("column", "expected_type", "observed_type", "status")])
    return literal_table(df.sparkSession, rows, schema)


def contract_coverage(observed: DataFrame, declared: DataFrame, name: str = "column", kind: str = "type") -> DataFrame:
    """Match / Mismatch / Not declared / Missing column between two (name, type) tables.

    Works on any catalogue of columns, so it is a union and one aggregation, not
    a join of driver lists.
    """
    sides = observed.select(name, F.col(kind).alias("observed_type"), F.lit(None).cast("string").alias("expected_type")).unionByName(
        declared.select(name, F.lit(None).cast("string").alias("observed_type"), F.col(kind).alias("expected_type"))
    )
    merged = sides.groupBy(name).agg(
        F.max("observed_type").alias("observed_type"), F.max("expected_type").alias("expected_type")
    )
    state = (
        F.when(F.col("observed_type").isNull(), "Missing column")
        .when(F.col("expected_type").isNull(), "Not declared")
        .when(F.col("observed_type") == F.col("expected_type"), "Match")
        .otherwise("Mismatch")
    )
    return merged.withColumn("status", state)


def numeric_text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether each text column parses fully as numbers (blanks ignored)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggregates, entries = [], []
    for i, c in enumerate(columns):
        filled = text.present(F.col(c), types[c])
        number = text.to_number(F.col(c), types[c])
        aggregates += [
            F.count_if(filled).alias(f"p_{i}"),
            F.count_if(filled & number.isNull()).alias(f"b_{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"p_{i}").alias("non_blank"),
                F.col(f"b_{i}").alias("non_numeric"),
                (F.col(f"b_{i}") == 0).alias("numeric_text"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


@dataclass(frozen=True)
class TableContract:
    """Declared shape of a labelled table."""

    columns: tuple[str, ...]
    types: Mapping[str, str]
    identifiers: tuple[str, ...]
    target: str
    classes: tuple
    categories: Mapping[str, tuple]
    numeric_text: tuple[str, ...] = ()
    require_all_categories: bool = True


def raw_contract(df: DataFrame, contract: TableContract) -> DataFrame:
    """Every contract violation as check rows (columns, types, keys, domains).

    One scan with a one-row aggregate covers nulls, blanks, domains and numeric
    text; key repeats need one shuffle per identifier.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    spark, scope = df.sparkSession, "contract"
    structural = [
        ("required_columns_present", c, int(c not in types)) for c in contract.columns
    ] + [
        ("no_unexpected_columns", c, 1) for c in df.columns if c not in contract.columns
    ]
    structural.append(("column_order_valid", "*", int(tuple(df.columns) != tuple(contract.columns))))
    for c, wanted in contract.types.items():
        if c not in types:
            continue
        textual = c in contract.numeric_text and text.is_text(types[c])
        structural.append(("types_valid", c, 0 if textual else int(not matches_family(types[c], wanted))))
    schema = pa.schema([("check", pa.string()), ("item", pa.string()), ("n", pa.int64())])
    fixed = literal_table(spark, [dict(zip(("check", "item", "n"), r)) for r in structural], schema)
    fixed = fixed.select("check", F.lit(scope).alias("scope"), "item", F.col("n").alias("n_violations"), (F.col("n") == 0).alias("passed"))

    aggregates: list[Column] = []
    rows: list[tuple[str, str, str, Column]] = []

    def measure(check: str, item: str, violations: Column) -> None:
        name = f"m{len(aggregates)}"
        aggregates.append(violations.alias(name))
        rows.append((check, scope, item, F.col(name)))

    for c in contract.identifiers:
        if c in types:
            measure("identifiers_complete", c, F.count_if(text.missing(F.col(c), types[c])))
            measure("identifiers_not_blank", c, F.count_if(text.blank(F.col(c), types[c])))
    domains = {contract.target: (contract.classes, True, "target_valid")}
    domains |= {c: (v, contract.require_all_categories, "categories_valid") for c, v in contract.categories.items()}
    for c, (values, every, check) in domains.items():
        if c not in types:
            continue
        col = F.col(c)
        lacking = text.missing(col, types[c])
        measure(check, f"{c}: missing", F.count_if(lacking))
        measure(check, f"{c}: unexpected", F.count_if(~lacking & ~in_domain(col, values)))
        if every:
            absent = sum((F.when(F.count_if(col == v) == 0, 1).otherwise(0) for v in values), F.lit(0))
            measure(check, f"{c}: absent", absent)
    for c in contract.numeric_text:
        if c in types:
            bad = text.present(F.col(c), types[c]) & text.to_number(F.col(c), types[c]).isNull()
            measure("types_valid", f"{c}: non-numeric text", F.count_if(bad))
    tables = [fixed]
    if aggregates:
        tables.append(K.checks_from(df.agg(*aggregates), rows))
    for c in contract.identifiers:
        if c in types:
            profile = key_profile(df, [c])
            tables.append(K.checks_from(profile, [("identifiers_unique", scope, c, F.col("duplicated_rows"))]))
    return K.all_checks(*tables)
