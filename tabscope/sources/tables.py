"""Tables on shared storage: typed reads and split-partitioned writes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read with a declared schema; text formats require one (no inference scan).

    Malformed text rows fail the read instead of turning into nulls.
    """
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs an explicit schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header="true", mode="FAILFAST", enforceSchema="false")
    elif fmt == "json":
        reader = reader.options(mode="FAILFAST")
    return reader.options(**dict(options or {})).load(path)


def write_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet") -> None:
    """One directory per split; the commit is atomic per write, readers prune by split."""
    writer = df.write.mode("overwrite").partitionBy(split).format(fmt)
    if fmt == "csv":
        writer = writer.options(header="true", encoding="UTF-8", lineSep="\n")
    writer.save(path)
