"""Helpers that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text that one Python step holds at a time; one text may be longer.
STEP_BYTES = 4 << 20

#: Entries of a worker's memo tables; a full table is emptied, which costs time, not results.
MEMO_ENTRIES = 300_000

#: A-Z to a-z, ASCII white space to a space, all other bytes kept.
SPACED = bytes(32 if b in (32, 9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: later jobs start there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, modulus: int):
    """crc32 of the decimal text of ``column``, modulo; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes per step."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class Memo(dict):
    """``memo[key]`` computes a missing value once and keeps it, up to ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int = MEMO_ENTRIES) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def word_hashes(limit: int = MEMO_ENTRIES) -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, limit)


def hashed(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mix of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def grams(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive values (order matters)."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[i : i + n]
    return scrambled(out)


def bytes_array(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of the texts of a batch, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def row_key(identity, text: bytes) -> bytes:
    """A key of a row's id and text; equal rows share it."""
    return xxhash.xxh3_128_digest(repr(identity).encode() + b"\0" + text)


def source(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``df`` as (id, text) and the id's type; all other columns stay behind."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of ``values``, ``counts[i]`` of them in list i."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def fixed_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which values of a long column, modulo ``bits`` (a power of two), occur: one bool each.

    Built on the executors; at most ``bits`` / 32,768 rows of 4 kB come to the driver."""
    place = F.col(column).bitwiseAND(bits - 1).alias("place")
    found = np.zeros(bits, bool)
    parts = df.select(place).groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    for r in parts.collect():
        own = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little"))
        # bucket 1 holds places 1 to 32,768; place 0 alone is in bucket 0
        at = (r.b - 1) * 32768 + 1 + own if r.b else own
        found[at[at < bits]] = True
    return found
