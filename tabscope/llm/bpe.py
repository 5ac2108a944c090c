"""Byte-level BPE: every distinct pre-token is encoded once, wherever it occurs.

Encoding. Each task reads its documents in blocks that end once they have ``block_words``
distinct pre-tokens. A block lists these and, as numbers by falling frequency, the pre-token at
every position. Lists are dealt out
by word (``buckets`` classes of a hash), so all blocks' copies of a word meet in one task,
which merges its bytes once; the ids return to their block and are put back by position. As a
word travels once per block, frequent words are no hot keys.

Decoding. Ids are matched with the token-byte table and the bytes put back by position.

Null texts count as empty: no ids, empty bytes. Ids of repeated rows are given per row; extra
columns are ignored; an empty table gives an empty result. A very long text is one block; its
pre-tokens are read in slices cut where white space follows something else, a place that no
pre-token spans.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, STEP_BYTES, Memo, lists, steps, texts

SAFE = re.compile(r"\S(?=[ \n\r\t])")
#: Rank no pair of a piece can have.
NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a base64 rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that no pre-token spans."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:] if start else text


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: its own rank, else merge the lowest-ranked, leftmost pair first."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(piece) <= 48:
        get = ranks.get
        pairs = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != NONE:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NONE)
        return [ranks[p] for p in parts]
    # the same order for long pieces, by a heap over linked parts
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts) and (pair := parts[i] + parts[after[i]]) in ranks:
            heapq.heappush(heap, (ranks[pair], i, pair))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        if not parts[i] or after[i] >= len(parts) or parts[i] + parts[after[i]] != pair:
            continue
        gone = after[i]
        parts[i], parts[gone], after[i] = pair, b"", after[gone]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p]


def _packed(lengths: np.ndarray, data: bytes) -> bytes:
    head = lengths.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(lengths).to_bytes(8, "little") + zstandard.compress(head + data, 3)


def _unpacked(payload: bytes) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(payload[:8], "little")
    raw = zstandard.decompress(payload[8:])
    head = np.frombuffer(raw, np.uint8, 4 * n).reshape(4, -1).T.copy().view("<u4").reshape(-1)
    return head, raw[4 * n :]


class _Block:
    """Distinct pre-tokens of some documents and their sequence."""

    def __init__(self, classes: int) -> None:
        self.classes = classes
        self.codes: defaultdict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.docs: list[pa.Array] = []
        self.counts: list[int] = []
        self.steps: list[np.ndarray] = []
        self.digest = xxhash.xxh3_128()

    def number(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, words), np.uint32, len(words))

    def add(self, docs: pa.Array, counts: list[int], sequence: np.ndarray) -> None:
        self.docs.append(docs)
        self.counts += counts
        self.steps.append(sequence)

    def rows(self, name: str) -> pa.RecordBatch:
        """A header row and a row per bucket, with its words by rank."""
        block = f"{name}-{self.digest.hexdigest()}"
        words = [w.encode() for w in self.codes]
        n = sum(np.bincount(s, minlength=len(words)) for s in self.steps)
        by_rank = np.argsort(-n, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[by_rank] = np.arange(len(words), dtype=np.uint32)
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(words[i]) % self.classes for i in by_rank), np.uint32, len(words))
        order = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[order], return_index=True)
        payloads = []
        for a, b in zip(first, [*first[1:], len(words)]):
            own = [words[i] for i in by_rank[order[a:b]]]
            payloads.append(_packed(np.fromiter(map(len, own), np.uint32, len(own)), b"".join(own)))
        docs = pa.concat_arrays(self.docs)
        nothing = [None] * len(used)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (len(used) + 1), pa.string()),
                pa.array([-1, *used.tolist()], pa.int32()),
                pa.array([f"b{block}", *map(str, used.tolist())], pa.string()),
                pa.array([len(used), *nothing], pa.int32()),
                pa.array([docs.to_pylist(), *nothing], pa.list_(docs.type)),
                pa.array([self.counts, *nothing], pa.list_(pa.int64())),
                pa.array([list(map(len, self.docs)), *nothing], pa.list_(pa.int32())),
                pa.array([[_packed(rank[s], b"") for s in self.steps], *nothing], pa.list_(pa.binary())),
                pa.array([_packed(bucket, b""), *payloads], pa.binary()),
            ],
            ["block", "bucket", "dealt", "used", "docs", "counts", "rows", "steps", "payload"],
        )


def encode_texts(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    step_bytes: int = STEP_BYTES, block_words: int = 300_000, buckets: int | None = None,
) -> DataFrame:
    """Per row: the id column and ``ids`` (array<int>)."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = buckets or max(512, 2 * partitions)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        part, number = TaskContext.get().partitionId(), 0
        block = _Block(classes)
        for step in steps(batches, "text", step_bytes):
            for_step, counts = [], []
            for text in texts(step, "text"):
                n = 0
                for cut in slices(text):
                    words = find(cut)
                    n += len(words)
                    for_step.append(block.number(words))
                counts.append(n)
                block.digest.update(text.encode())
            block.add(step.column(0), counts, np.concatenate(for_step))
            if len(block.codes) > block_words:
                number += 1
                yield block.rows(f"{part}-{number}")
                block = _Block(classes)
        if block.counts:
            yield block.rows(f"{part}-{number + 1}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        memo = Memo(lambda w: np.array(merge(w, ranks), "<u4"), MEMO_ENTRIES)
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("payload") if at is None else at
            payloads = batch.column(at).to_pylist()
            for i, bucket in enumerate(batch.column(1).to_pylist()):
                if bucket >= 0:
                    lengths, data = _unpacked(payloads[i])
                    ends = np.cumsum(lengths, dtype=np.int64).tolist()
                    ids = [memo[data[a:b]] for a, b in zip([0, *ends], ends)]
                    payloads[i] = _packed(np.fromiter(map(len, ids), np.uint32, len(ids)), np.concatenate(ids).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
            yield batch.set_column(at, "payload", pa.array(payloads, pa.binary())) if batch.num_rows else batch

    def assemble(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket")
        header = group.slice(0, 1).to_pylist()[0]
        if header["bucket"] != -1 or header["used"] != group.num_rows - 1:
            raise ValueError("a block came together incomplete; its input gave other rows on a retry")
        lengths, ids = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
        for payload in group.column("payload")[1:].to_pylist():
            n, data = _unpacked(payload)
            lengths.append(n)
            ids.append(np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1))
        listed, flat = np.concatenate(lengths).astype(np.int64), np.concatenate(ids).astype(np.int32)
        # lists stand in the order of buckets, words in each by rank
        order = np.argsort(_unpacked(header["payload"])[0], kind="stable")
        width, start = np.empty_like(listed), np.empty_like(listed)
        width[order], start[order] = listed, np.cumsum(listed) - listed
        picked, sizes, at = [np.empty(0, np.int32)], [], 0
        for n_docs, payload in zip(header["rows"], header["steps"]):
            codes, _ = _unpacked(payload)
            n = width[codes]
            ends = np.cumsum(n)
            picked.append(flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[codes] - ends + n, n)])
            words_before = np.concatenate([[0], np.cumsum(header["counts"][at : at + n_docs], dtype=np.int64)])
            sizes.append(np.diff(np.concatenate([[0], ends])[words_before]))
            at += n_docs
        docs = pa.array(header["docs"], group.schema.field("docs").type.value_type)
        return pa.table({"id": docs, "ids": lists(np.concatenate(picked), np.concatenate(sizes), pa.int32())})

    schema = f"block string, bucket int, dealt string, used int, docs array<{kind}>, counts array<long>, rows array<int>, steps array<binary>, payload binary"
    dealt = source.mapInArrow(split, schema).repartition(partitions, "dealt")
    encoded = dealt.mapInArrow(encode, schema)
    whole = encoded.groupBy("block").applyInArrow(assemble, f"id {kind}, ids array<int>")
    return whole.select(F.col("id").alias(id_col), "ids")


def decode_ids(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids (null ids: empty; an id outside the table is an error)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        size = np.full(max(ranks.values()) + 1, -1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        table = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            out: list[bytes] = []
            for row in batch.column(at):
                ids = row.values.to_numpy() if row.is_valid else np.empty(0, np.int32)
                n = size[ids]
                if (n < 0).any():
                    raise ValueError("an id is not in the token table")
                ends = np.cumsum(n)
                out.append(table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[ids] - ends + n, n)].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, out_col])

    rows = df.drop(out_col)
    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(decode, f"{inner}, `{out_col}` binary")
