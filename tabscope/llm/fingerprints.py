"""Fingerprints of texts by content-defined chunks.

A rolling gear hash of the last 32 bytes puts chunk ends where the content asks for them: a
strict mask before the normal chunk size, a loose one after it (normalised chunking), within a
least and a greatest size. An insertion moves only the ends near it. A fingerprint lists the
distinct chunks, sorted: eight hex digits of digest and two of length each. How much of a text
another one holds is the length of the shared chunks over the length of its own distinct chunks.

Null texts count as empty; the empty text's fingerprint is the empty string. Equal texts have
equal fingerprints. The likeness of an empty text is 1 to an empty one, else 0.

Neighbours in descending order of id need no global sort: quantiles of the id cut the rows into
many ranges, the first row of each range is also sent to the end of the one before, and ranges
are sorted by themselves. Rows with equal ids are ordered by a hash of the text, null ids come
last; the last row's neighbour is the first row, a single row is its own neighbour. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, texts

LEAST, NORMAL, GREATEST = 32, 64, 255
#: The loose mask takes one place in 32, the strict one one in 128.
LOOSE, STRICT = np.uint32(0x1F << 27), np.uint32(0x7F << 25)
GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 17) & 0xFFFFFFFF for b in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes up to each place (h = 2 h + table[byte], modulo 2^32)."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return h


def chunk_ends(raw: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text. The least size is the hash's reach, so texts can be
    hashed in one run without touching each other."""
    joined = np.frombuffer(b"".join(raw), np.uint8)
    h = gear(joined)
    loose_at = np.flatnonzero((h & LOOSE) == 0)
    strict = loose_at[(h[loose_at] & STRICT) == 0].tolist()
    loose = loose_at.tolist()
    out, base = [], 0
    n_strict, n_loose = len(strict), len(loose)
    for text in raw:
        size, ends, start = len(text), [], base
        stop = base + size
        i = j = 0
        while stop - start > LEAST:
            i = bisect_left(strict, start + LEAST - 1, i)
            end = strict[i] + 1 if i < n_strict else stop
            if end - start > NORMAL:
                j = bisect_left(loose, start + NORMAL, j)
                end = min(loose[j] + 1 if j < n_loose else stop, start + GREATEST)
            start = min(end, stop)
            ends.append(start - base)
        if start < stop:
            ends.append(size)
        out.append(ends)
        base = stop
    return out


def chunks(raw: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct chunks of each text: digest above, length in the lowest byte."""
    digest = xxhash.xxh3_64_intdigest
    out = []
    for text, ends in zip(raw, chunk_ends(raw)):
        out.append(np.unique(np.array([(digest(text[a:b]) >> 32) << 8 | (b - a) for a, b in zip([0, *ends], ends)], np.uint64)))
    return out


def as_text(found: np.ndarray) -> str:
    return found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of ``a``'s chunk length that ``b`` holds too."""
    if not len(a):
        return float(not len(b))
    own = a & np.uint64(255)
    return float(own[np.isin(a, b, assume_unique=True)].sum() / own.sum())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``fingerprint``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            found = chunks([t.encode() for t in texts(step, "text")])
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(list(map(as_text, found)), pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(scan, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _neighbours(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows with their range, sorted inside it, each range ended by a copy of what follows it."""
    probabilities = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(rows.approxQuantile("id", probabilities, 1 / (4 * ranges)))) if ranges > 1 else []
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # descending: range 0 has the largest ids; rows without an id are in a last range of their own
    place = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - F.expr("size(filter(bounds, b -> b <= id))"))
    placed = rows.withColumn("bounds", bounds).withColumn("place", place).drop("bounds").withColumn("hash", F.xxhash64("text"))
    # one row per range
    firsts = sorted(placed.groupBy("place").agg(F.max(F.struct("id", "hash")).alias("f")).collect())
    if not firsts:
        return placed.withColumn("copy", F.lit(False))
    spark = rows.sparkSession
    moves = [(f.place, f.f.id, f.f.hash, firsts[i - 1].place) for i, f in enumerate(firsts)]
    table = spark.createDataFrame(moves, "place int, first_id long, first_hash long, before int")
    copies = (
        placed.join(F.broadcast(table), "place")
        .where(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")))
        .select("id", "text", F.col("before").alias("place"), "hash", F.lit(True).alias("copy"))
    )
    return placed.withColumn("copy", F.lit(False)).select("id", "text", "place", "hash", "copy").unionAll(copies)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``, where the next row in descending order of id gives the
    last half of the edited text."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = (
        _neighbours(rows, ranges or 4 * partitions)
        .repartition(partitions, "place")
        .sortWithinPartitions("place", "copy", F.col("id").desc_nulls_last(), F.col("hash").desc())
    )

    def done(block: list[tuple]) -> pa.RecordBatch:
        """Results of all rows but the last, which only follows."""
        text = [t for _, t, _, _ in block]
        own = [i for i in range(len(block) - 1) if not block[i][3]]
        if any(block[i][2] != block[i + 1][2] for i in own):
            raise ValueError("a range came without the row that follows it")
        changed = [edited(text[i], text[i + 1]).encode() for i in own]
        plain, other = chunks([t.encode() for t in text]), chunks(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block[i][0] for i in own], pa.int64()), pa.array([len(text[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([as_text(plain[i]) for i in own], pa.string()), pa.array(list(map(as_text, other)), pa.string()),
                pa.array([likeness(plain[i], o) for i, o in zip(own, other)], pa.float64()),
                pa.array([likeness(plain[i], plain[i + 1]) for i in own], pa.float64()),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for step in steps(batches, "text"):
            block = last + list(zip(step.column(0).to_pylist(), texts(step, "text"), step.column(2).to_pylist(), step.column(3).to_pylist()))
            yield done(block)
            last = block[-1:]
        if last and not last[0][3]:
            raise ValueError("a range came without the row that follows it")

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("id", "text", "place", "copy").mapInArrow(scan, schema).withColumnRenamed("id", id_col)
