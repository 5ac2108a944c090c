"""Benchmark passages in documents, found by winnowed fingerprints.

Words are runs of characters other than ASCII punctuation, signs and white space, A-Z in lower
case. From every window of ``span`` consecutive words the smallest hash of its ``gram``-word
runs (the rightmost of equal ones) is kept, in documents and items alike. Two texts that share
``span`` words therefore keep the same fingerprint inside the shared part, whatever surrounds
it. A kept fingerprint that an item may have is extended to all windows of ``span`` words
around it, and these are joined with the items' windows by a 128-bit key: a hit is a whole
shared window, never a lone fingerprint. Items of fewer words than ``span`` are one window of
their own length; runs of those lengths (nine at most) are then fingerprints themselves.

Before the join a bitmap of fixed size, whatever the number of items, drops document
fingerprints that no item has; what it lets through wrongly falls out of the join.

Null or empty texts have no words and are never hit. Repeated rows each get their result. Items
with null or empty text match nothing; an item without an id marks words but isn't listed or
counted. An empty item table leaves every document clean. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grams, hashed, lists, raw_texts, row_key, scrambled, source, steps, stored, word_hashes

#: Bits of the bitmap of item fingerprints.
FILTER_BITS = 1 << 23

WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def winnowed(values: np.ndarray, doc: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs kept from all windows that lie in one document."""
    runs = grams(values, gram)
    width = span - gram + 1
    n = len(values) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), runs[:0]
    best, at = runs[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        lower = runs[j : j + n] <= best
        best[lower] = runs[j : j + n][lower]
        at[lower] = j
    inside = doc[:n] == doc[span - 1 :]
    kept = np.zeros(len(runs), bool)
    kept[(np.arange(n) + at)[inside]] = True
    starts = np.flatnonzero(kept)
    return starts, runs[starts]


def keys(values: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the window at each start."""
    out = []
    for salt in (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D):
        acc = np.full(len(starts), length, np.uint64)
        for i in range(length):
            acc = acc * np.uint64(0xC6A4A7935BD1E995) + scrambled(values[starts + i] ^ np.uint64(salt))
        out.append(scrambled(acc).view(np.int64))
    return out[0], out[1]


class _Reader:
    """Words of a step as hashes, with the number of the document each is in."""

    def __init__(self) -> None:
        self.memo = word_hashes()

    def __call__(self, step: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        raw = raw_texts(step, "text")
        per_doc = [hashed(words_of(t), self.memo) for t in raw]
        counts = np.fromiter(map(len, per_doc), np.int64, len(per_doc))
        return raw, counts, np.concatenate(per_doc), np.repeat(np.arange(len(raw)), counts)


def _short_prints(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return keys(values, starts, length)[0].view(np.uint64)


def item_windows(items: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """Per window of an item: item, length, k1, k2, start; fingerprints are rows of length 0."""
    rows, kind = source(items, id_col, text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for step in steps(batches, "text"):
            ids = step.column(0)
            _, counts, values, doc = reader(step)
            first = np.cumsum(counts) - counts
            found = []
            for length in range(1, span + 1):
                own = counts == length if length < span else counts >= span
                if not own.any():
                    continue
                if length < span:
                    starts = first[own]
                    prints = _short_prints(values, starts, length)
                else:
                    n = len(values) - span + 1
                    starts = np.flatnonzero(doc[:n] == doc[span - 1 :])
                    _, prints = winnowed(values, doc, span, gram)
                k1, k2 = keys(values, starts, length)
                found.append((doc[starts], np.full(len(starts), length), k1, k2))
                none = np.zeros(len(prints), np.int64)
                found.append((none, none, prints.view(np.int64), none))
            if found:
                d, length, k1, k2 = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(d)), pa.array(length, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())],
                    ["item", "length", "k1", "k2"],
                )

    return rows.mapInArrow(read, f"item {kind}, length int, k1 long, k2 long")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", span: int = 10, gram: int = 5,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit``, ``items`` (ids as sorted strings), ``spans``
    (array of (first word, words) that were hit, overlapping ones separate)."""
    spark = docs.sparkSession
    windows = stored(item_windows(items, item_id_col, item_text_col, span, gram).distinct())
    short = sorted(r.length for r in windows.where(f"length between 1 and {span - 1}").select("length").distinct().collect())
    # at most filter_bits / 32,768 rows of 4 kB
    place = (F.col("k1").bitwiseAND(filter_bits - 1)).alias("place")
    prints = windows.where("length = 0").select(place)
    bitmap = np.zeros(filter_bits, bool)
    for r in prints.groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect():
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        # bucket 1 holds places 1 to 32,768, and place 0 stands in bucket 0
        at = (r.b - 1) * 32768 + 1 + np.flatnonzero(bits)
        bitmap[at[at < filter_bits] if r.b else 0] = True
    shared = spark.sparkContext.broadcast(np.packbits(bitmap))
    rows, kind = source(docs, id_col, text_col)

    def may(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(filter_bits - 1)).astype(np.int64)
        return bits[at].astype(bool)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, bits = _Reader(), np.unpackbits(shared.value)
        for step in steps(batches, "text"):
            ids = step.column(0).to_pylist()
            raw, counts, values, doc = reader(step)
            at, runs = winnowed(values, doc, span, gram)
            at = at[may(runs, bits)]
            n = len(values) - span + 1
            starts = np.unique((at[:, None] - np.arange(span - gram + 1)).ravel())
            starts = starts[(starts >= 0) & (starts < n)]
            starts = starts[doc[starts] == doc[starts + span - 1]]
            found = [(starts, np.full(len(starts), span), *keys(values, starts, span))]
            for length in short:
                n = len(values) - length + 1
                starts = np.flatnonzero(doc[:n] == doc[length - 1 :]) if n > 0 else np.empty(0, np.int64)
                starts = starts[may(_short_prints(values, starts, length), bits)]
                found.append((starts, np.full(len(starts), length), *keys(values, starts, length)))
            starts, length, k1, k2 = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(doc[starts], kind="stable")
            starts, length, k1, k2 = starts[order], length[order], k1[order], k2[order]
            per_doc = np.bincount(doc[starts], minlength=len(ids))
            first = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [
                    step.column(0), pa.array([row_key(i, t) for i, t in zip(ids, raw)], pa.binary()), pa.array(counts),
                    lists((starts - first[doc[starts]]).astype(np.int32), per_doc, pa.int32()), lists(length.astype(np.int32), per_doc, pa.int32()),
                    lists(k1, per_doc, pa.int64()), lists(k2, per_doc, pa.int64()),
                ],
                ["id", "row", "n_words", "start", "length", "k1", "k2"],
            )

    schema = f"id {kind}, row binary, n_words long, start array<int>, length array<int>, k1 array<long>, k2 array<long>"
    scanned = stored(rows.mapInArrow(scan, schema))
    candidates = (
        scanned.where(F.size("start") > 0)
        .select("row", F.explode(F.arrays_zip("start", "length", "k1", "k2")).alias("w"))
        .select("row", "w.*")
    )
    known = windows.where("length > 0")
    spans = candidates.join(known.select("length", "k1", "k2").distinct(), ["length", "k1", "k2"], "leftsemi")
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    listed = (
        candidates.select("row", "length", "k1", "k2").distinct()
        .join(known.where("item is not null"), ["length", "k1", "k2"])
        .select("row", F.col("item").cast("string").alias("item")).distinct()
        .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    covered = F.expr(
        """aggregate(spans, named_struct('n', 0L, 'end', 0L),
             (a, s) -> named_struct('n', a.n + greatest(0L, s.start + s.length - greatest(a.end, cast(s.start as long))),
                                    'end', greatest(a.end, cast(s.start + s.length as long))), a -> a.n)"""
    )
    return (
        scanned.select("id", "row", "n_words")
        .join(spans, "row", "left").join(listed, "row", "left")
        .select(
            F.col("id").alias(id_col), "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        )
    )
