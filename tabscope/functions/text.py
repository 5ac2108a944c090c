"""Text and value tests shared by all operators."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points of every character that Python's str.strip() removes.
WHITESPACE = "".join(
    chr(code)
    for code in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# Fixed value: the finite numbers accepted as numeric text.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def fold_case(text: Column) -> Column:
    """Full Unicode case folding, as ``str.casefold``: every sigma is one letter, sharp s and ligatures are
    written out. ASCII text, told by its length in bytes, takes the short way."""
    single, one, several = _foldings()
    by_letter = F.translate(text, single, one)
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(by_letter, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return (
        F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
        .when(text.rlike("[" + "".join(several) + "]"), spelt)
        .otherwise(by_letter)
    )


@lru_cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one letter, those letters, and the letters that fold to several."""
    folded = {c: c.casefold() for c in map(chr, range(0x110000)) if c.casefold() != c}
    single = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folded.items() if len(f) > 1}


def fold(text: Column) -> Column:
    return fold_case(strip(text))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def missing(value: Column, dtype: T.DataType) -> Column:
    """Null, or NaN in a floating column."""
    if is_floating(dtype):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def blank(value: Column, dtype: T.DataType) -> Column:
    """Non-null text made only of whitespace; never true for other types."""
    if is_text(dtype):
        return value.isNotNull() & (strip(value) == "")
    return F.lit(False)


def present(value: Column, dtype: T.DataType) -> Column:
    """Neither missing nor blank."""
    return ~(missing(value, dtype) | blank(value, dtype))


def clean_category(value: Column, dtype: T.DataType, *, strip_text: bool) -> Column:
    """Category as text, null where missing or blank.

    ``strip_text`` is the feature-to-target rule (spaces around a label are
    dropped); without it only blanks are masked, the feature-to-feature rule.
    """
    if is_text(dtype):
        kept = strip(value) if strip_text else value
        return F.when(strip(value) != "", kept)
    if is_floating(dtype):
        return F.when(~missing(value, dtype), value.cast("string"))
    return value.cast("string")


def to_number(value: Column, dtype: T.DataType) -> Column:
    """Double, null where the value is missing or is text that is no number."""
    if is_text(dtype):
        text = strip(value)
        word = F.lower(F.ltrim(text, F.lit("+-")))
        numeric = text.rlike(NUMBER_PATTERN) | word.isin("inf", "infinity")
        return F.when(numeric, text.try_cast("double"))
    if is_floating(dtype):
        return F.when(~F.isnan(value), value.cast("double"))
    return value.cast("double")
