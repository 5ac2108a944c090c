"""Content-checked writes: a version folder first, one manifest file last.

Every write has a folder of its own.  What was written is read back and compared with what was asked
for before a manifest file of the next number is created; creating never replaces a file, so of two writers
one fails.  Readers follow the newest manifest row only: a write that dies half way is never visible and is
simply repeated.  Creating without overwriting is one step on HDFS; a store without such a step
needs one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators.prepare import split_checks
from .identity import content_fingerprint, quick_fingerprint

MANIFEST = "sequence bigint, version string, rows bigint, digest string, columns string, status string, method string"
#: ``quick`` for gates inside Spark, ``portable`` where another engine computes the digest too.
DIGESTS = {"quick": quick_fingerprint, "portable": content_fingerprint}


class DivergentContent(ValueError):
    """Stored content differs and overwriting was not requested."""


class UnstableContent(ValueError):
    """What was written is not what the digest was taken of: the plan gives other rows when it runs again."""


class ConcurrentWrite(RuntimeError):
    """Another writer has committed this number."""


def _manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}/manifest"


def _place(spark: SparkSession, path: str):
    """File system and path object."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _place(spark, path)
    return files.exists(target)


def _last(spark: SparkSession, root: str) -> int:
    """Highest number of a manifest file, also of one that a dying writer left empty."""
    if not _exists(spark, _manifest_path(root)):
        return 0
    files, target = _place(spark, _manifest_path(root))
    names = [x.getPath().getName() for x in files.listStatus(target)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _commit(spark: SparkSession, root: str, row: dict) -> None:
    files, target = _place(spark, f"{_manifest_path(root)}/{row['sequence']:09d}.json")
    try:
        out = files.create(target, False)
    except Py4JJavaError as e:
        if files.exists(target):
            raise ConcurrentWrite(f"{root}: number {row['sequence']} was committed by another writer") from e
        raise
    try:
        out.write(bytearray(json.dumps(row).encode() + b"\n"))
    finally:
        out.close()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All manifest rows, one per accepted write."""
    return spark.read.schema(MANIFEST).json(_manifest_path(path))


def _current(spark: SparkSession, path: str):
    if not _exists(spark, _manifest_path(path)):
        return None
    rows = manifest(spark, path).orderBy(F.desc("sequence")).limit(1).collect()
    return rows[0] if rows else None


def read_current(spark: SparkSession, path: str) -> DataFrame:
    row = _current(spark, path)
    if row is None:
        raise FileNotFoundError(f"no manifest under {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{row['version']}")


def write_idempotent(
    df: DataFrame, path: str, *, overwrite: bool = False, partition_by: Sequence[str] = (), method: str = "quick"
) -> DataFrame:
    """Store ``df`` unless equal content is stored already; returns the status row.

    Status is created, reused_equivalent or overwritten.  The table is written by the executors and read
    back once; the driver sees digest rows.  Content stored with another ``method`` counts as different.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    digest = DIGESTS[method]
    old, last = _current(spark, root), _last(spark, root)
    new = digest(df).collect()[0]
    columns = ";".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    if old is not None and (old["digest"], old["rows"], old["columns"]) == (new["digest"], new["rows"], columns):
        row = (old["sequence"], old["version"], new["rows"], new["digest"], columns, "reused_equivalent", method)
        return spark.createDataFrame([row], MANIFEST)
    if old is not None and not overwrite:
        raise DivergentContent(f"{root}: stored digest {old['digest']}, new digest {new['digest']}")
    version = f"version={last + 1}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{root}/{version}")
    back = digest(spark.read.schema(df.schema).parquet(f"{root}/{version}").select(*[f"`{c}`" for c in df.columns])).collect()[0]
    if back != new:
        raise UnstableContent(f"{root}: digest {new['digest']} was asked for, {back['digest']} was written")
    row = (last + 1, version, new["rows"], new["digest"], columns, "created" if old is None else "overwritten", method)
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    _commit(spark, root, dict(zip(names, row)))
    return spark.createDataFrame([row], MANIFEST)


def verify_handoff(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    key: Sequence[str],
    label: str,
    classes: Sequence,
    *,
    split: str = "split",
    tolerance: float = 0.02,
) -> DataFrame:
    """Check rows: stored content against its manifest row, then the split checks."""
    row = _current(spark, path)
    if row is None:
        raise FileNotFoundError(f"no manifest under {path}")
    stored = read_current(spark, path)
    declared = [c.split(":", 1)[0] for c in row["columns"].split(";")]
    lacking = [c for c in declared if c not in stored.columns]
    kept = stored.select(*[c for c in declared if c in stored.columns])
    now = DIGESTS[row["method"] or "portable"](kept).withColumns({"_rows": F.lit(row["rows"]), "_digest": F.lit(row["digest"])})
    scope = "handoff"
    content = K.checks_from(
        now,
        [
            ("stored_columns_present", scope, "*", F.lit(len(lacking))),
            ("stored_rows_match", scope, "*", (F.col("rows") != F.col("_rows")).cast("int")),
            ("stored_digest_matches", scope, "*", (F.col("digest") != F.col("_digest")).cast("int")),
        ],
    )
    return K.all_checks(content, split_checks(source, kept, key, label, classes, split=split, tolerance=tolerance))
