"""Files under a folder with their SHA-256."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import literal_table

#: Files up to this size are hashed as one cell of Spark's reader, larger ones as a stream.
WHOLE_BYTES = 64 << 20
#: Bytes of a streamed file in memory.
READ_BYTES = 1 << 20


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each named file, one read of ``READ_BYTES`` in memory at a time."""
    for batch in batches:
        hashes = []
        for path in batch.column(0).to_pylist():
            if re.match(r"file:|/", path):
                files, name = pa.fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)
            else:
                files, name = pa.fs.FileSystem.from_uri(quote(path, safe=":/@"))
            own = hashlib.sha256()
            with files.open_input_stream(name, buffer_size=0) as stream:
                while block := stream.read(READ_BYTES):
                    own.update(block)
            hashes.append(own.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.string())], ["path", "length", "sha256"])


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    """Visible files without bytes, which Spark's readers do not list; one pass over names on the driver."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(target, True)
    found = []
    while files.hasNext():
        status = files.next()
        if not status.getLen():
            found.append(re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", status.getPath().toString()))
    base = re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", root)
    names = [f[len(base) + 1 :] for f in found]
    return [n for n in names if not any(p.startswith(".") or p.startswith("_") and "=" not in p for p in n.split("/"))]


def file_inventory(spark: SparkSession, path: str, expected: Sequence[str] = (), whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, bytes, sha256, status) of every visible file, sorted by path.

    Files up to ``whole_bytes`` are hashed by Spark's own reader, on any file system that Spark reads.
    Larger ones, of any size, go by name to tasks that stream them; pyarrow must know their file system.
    Expected files (relative names) that do not exist get the status ``missing``.
    """
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    whole = files.where(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.select("path", "length").where(F.col("length") > whole_bytes).repartition("path")
    hashed = whole.unionByName(large.mapInArrow(_streamed, "path string, length long, sha256 string"))
    full = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    base = re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", root)
    found = hashed.select(F.substring(full, F.lit(len(base) + 2), F.length(full)).alias("path"), F.col("length").alias("bytes"), "sha256")
    if empty := _empty_files(spark, root):
        none = hashlib.sha256().hexdigest()
        kinds = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])
        found = found.unionByName(literal_table(spark, [{"path": p, "bytes": 0, "sha256": none} for p in empty], kinds))
    if expected:
        wanted = literal_table(spark, [{"path": e} for e in expected], pa.schema([("path", pa.string())]))
        found = found.join(wanted.withColumn("_w", F.lit(True)), "path", "full_outer")
    status = F.when(F.col("sha256").isNull(), "missing").otherwise("available")
    return found.select("path", "bytes", "sha256", status.alias("status")).orderBy("path")
