"""Order-independent content digests of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# Seeds of the two lanes of ``quick_fingerprint``.
LANES = (1, 2)
# Bit offsets and widths of the parts a lane is added up in: 2^41 rows fit a long.
PARTS = ((0, 22), (22, 21), (43, 21))


def _cell(df: DataFrame, column: str, decimals: int | None) -> Column:
    col, dtype = F.col(f"`{column}`"), df.schema[column].dataType
    if text.is_floating(dtype) and decimals is not None:
        shown = col.cast(f"decimal(38,{decimals})").cast("string")
    else:
        shown = col.cast("string")
    return F.coalesce(F.concat(F.length(shown).cast("string"), F.lit(":"), shown), F.lit("~"))


def row_hash(df: DataFrame, columns: Sequence[str], decimals: int | None = None) -> Column:
    """MD5 of the length-prefixed cells; null differs from every text."""
    return F.md5(F.concat(*[_cell(df, c, decimals) for c in columns]))


def content_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, decimals: int | None = None) -> DataFrame:
    """(rows, digest) that another engine can compute too: sums of both halves of each row's MD5.

    Order and partitioning do not matter; repeated rows add up, so multiplicities count.  Doubles are
    written with ``decimals`` places when given, else as their shortest exact text.
    """
    columns = list(columns or df.columns)

    def half(start: int) -> Column:
        part = F.conv(F.substring("_hash", start, 16), 16, 10)
        return F.coalesce(F.sum(part.cast("decimal(38,0)")), F.lit(0)).cast("string")

    hashed = df.select(row_hash(df, columns, decimals).alias("_hash"))
    return hashed.agg(F.count("*").alias("rows"), F.concat_ws("-", half(1), half(17)).alias("digest"))


def quick_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(rows, digest) for gates inside Spark: exact sums of two seeded 64-bit hashes of each row.

    No text is made of the cells and all of it is one aggregate in generated code.  A mask of the null
    cells is hashed with the row, as the hash passes over nulls.  Maps enter as text.
    """
    columns = list(columns or df.columns)
    cells = [F.col(f"`{c}`").cast("string") if isinstance(df.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in columns]
    masks = [
        sum((F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(cells[at : at + 62])), F.lit(0).cast("bigint"))
        for at in range(0, len(cells), 62)
    ]
    lanes = df.select(*[F.xxhash64(F.lit(seed), *masks, *cells).alias(f"_lane{seed}") for seed in LANES])
    sums = [
        F.coalesce(F.sum(F.shiftrightunsigned(f"_lane{seed}", low).bitwiseAND((1 << width) - 1)), F.lit(0))
        for seed in LANES
        for low, width in PARTS
    ]
    return lanes.agg(F.count("*").alias("rows"), F.concat_ws("-", *[F.hex(s) for s in sums]).alias("digest"))


def schema_digest(df: DataFrame) -> Column:
    """Digest of column names and types in order (metadata, a literal)."""
    shown = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return F.md5(F.lit(shown))


def source_identity(df: DataFrame, name: str, identifiers: Sequence[str] = (), target: str | None = None) -> DataFrame:
    """One record: rows, columns, roles, schema digest and content digest."""
    return content_fingerprint(df).select(
        F.lit(name).alias("source"),
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(",".join(identifiers)).alias("identifiers"),
        F.lit(target).cast("string").alias("target"),
        schema_digest(df).alias("schema_digest"),
        F.col("digest").alias("content_digest"),
    )
