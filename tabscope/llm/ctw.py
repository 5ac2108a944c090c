"""Code lengths of texts by context-tree weighting.

A text is its words (runs without ASCII white space, A-Z in lower case) joined by one space and
ended by a line feed. Each byte is eight binary decisions, and each decision has a context tree:
the node of depth d is the last d bytes (0 to ``depth``) with the bits already known. A node
estimates its next bit by Krichevsky and Trofimov's rule and mixes this with what the node one
byte deeper says; the mixing weight is the node's share in the weighted probability of all
training decisions, ``P_w = (KT + prod P_w(children)) / 2``. Where no deeper node was seen, the
deepest seen one decides.

Training counts every run of ``depth`` + 1 bytes of all training texts. Each task reads its
documents in blocks and lists a block's distinct runs, with their training counts, by class of
the last two context bytes. Lists of a class are summed, salted groups first, so that a class
holds a run once however many blocks have it; subtrees below two bytes are complete in their
class, and what is above (256 + 1 contexts of 255 nodes, a fixed bound) is combined on the
driver and sent to all tasks. The classes give each block its lists back
with their runs' probabilities, and a block adds them up along its texts. Token counts for the base score go the same way.

Null texts count as empty: the end alone. Rows are scored one by one; repeated rows get equal
scores. With nothing to learn from, every bit has probability 1/2. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, hashed, raw_texts, scrambled, source, steps, stored, word_hashes

#: Context bytes unless ``depth`` says otherwise; a run of depth + 1 bytes is a 64-bit number.
DEPTH = 6
END_KEY = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
LN_HALF = np.log(0.5)


def stream(text: bytes) -> tuple[list[bytes], bytes]:
    words = text.translate(SPACED).split()
    return words, b" ".join(words) + b"\n"


def runs(joined: bytes, depth: int = DEPTH) -> np.ndarray:
    """Each run of ``depth`` + 1 bytes as a number, oldest byte highest."""
    data = np.frombuffer(joined, np.uint8).astype(np.uint64)
    n = len(data) - depth
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(depth + 1):
        out = (out << np.uint64(8)) | data[i : i + n]
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1/2."""
    low = np.ones_like(x)
    for i in range(7):
        low *= x + i
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - np.log(low)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT block probability."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - np.log(np.pi) - lgamma(zeros + ones + 1)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the counts of equal keys, sorted; a stable sort merges lists that are sorted already."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first, dtype=np.float64) if len(first) else np.empty(0)


class Nodes:
    """Nodes of one depth: sorted key (context << 8 | 1 and the known bits), KT of a one, weight."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.one = (ones + 0.5) / (zeros + ones + 1)
        own = kt(zeros, ones)
        if below is None:
            self.weight, self.log = np.ones(len(keys)), own
        else:
            self.log = LN_HALF + np.logaddexp(own, below)
            self.weight = np.exp(LN_HALF + own - self.log)

    def mixed(self, keys: np.ndarray, p: np.ndarray, seen: np.ndarray) -> None:
        """Mix this depth into ``p`` (where ``seen``: there is a deeper estimate)."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[at] == keys
        one, w = self.one[at], np.where(seen, self.weight[at], 1.0)
        np.copyto(p, w * one + (1 - w) * p, where=here)
        seen |= here


def counted(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node keys of a depth and how often a zero and a one followed."""
    short, n = added(keys & np.uint64((1 << (8 * depth + 8)) - 1), counts)
    context, byte = (short >> np.uint64(8)) << np.uint64(8), (short & np.uint64(255)).astype(np.int64)
    node = [context | ((1 << j) | (byte >> (8 - j))).astype(np.uint64) for j in range(8)]
    bit = [(byte >> (7 - j)) & 1 for j in range(8)]
    unique, inverse = np.unique(np.concatenate(node), return_inverse=True)
    ones = np.bincount(inverse, np.concatenate(bit) * np.tile(n, 8), len(unique))
    return unique, np.bincount(inverse, np.tile(n, 8), len(unique)) - ones, ones


def above(keys: np.ndarray, depth: int) -> np.ndarray:
    """Key of the node one byte shallower."""
    return keys & np.uint64((1 << (8 * depth)) - 1)


def subtrees(keys: np.ndarray, counts: np.ndarray, least: int = 2, deepest: int = DEPTH) -> dict[int, Nodes]:
    """Nodes of depth ``deepest`` down to ``least`` for all runs of whole classes."""
    out: dict[int, Nodes] = {}
    for depth in range(deepest, least - 1, -1):
        node, zeros, ones = counted(keys, counts, depth)
        below = None
        if depth < deepest:
            child = out[depth + 1]
            below = np.bincount(np.searchsorted(node, above(child.keys, depth + 1)), child.log, len(node))
        out[depth] = Nodes(node, zeros, ones, below)
    return out


def top(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> dict[int, Nodes]:
    """Depths 1 and 0 from the sums that the subtrees of depth 2 give."""
    order = np.argsort(node)
    first = Nodes(node[order], zeros[order], ones[order], below[order])
    root, inverse = np.unique(above(first.keys, 1), return_inverse=True)
    sums = [np.bincount(inverse, x, len(root)) for x in (first.zeros, first.ones, first.log)]
    return {1: first, 0: Nodes(root, *sums)}


def log10_p(keys: np.ndarray, tree: dict[int, Nodes]) -> np.ndarray:
    """log10 probability of the last byte of each run after the ones before it."""
    byte = (keys & np.uint64(255)).astype(np.int64)
    total = np.zeros(len(keys))
    for j in range(8):
        prefix = ((1 << j) | (byte >> (8 - j))).astype(np.uint64)
        p, seen = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        for depth in range(max(tree), -1, -1):
            context = (keys >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
            tree[depth].mixed((context << np.uint64(8)) | prefix, p, seen)
        total += np.log10(np.where((byte >> (7 - j)) & 1 == 1, p, 1 - p))
    return total


def _planes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T.tobytes()


def _from_planes(raw: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(kind).reshape(n)


def _nearest_first(keys: np.ndarray) -> np.ndarray:
    """Runs with the context's bytes from the nearest to the oldest, then the last byte."""
    x = keys.byteswap()
    return (x << np.uint64(8)) | (x >> np.uint64(56))


def _as_runs(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(8)) | (x << np.uint64(56))).byteswap()


def pack(keys: np.ndarray, values: np.ndarray, kind: str = "<u4", runs_: bool = False) -> bytes:
    """Sorted keys and a value each: runs sorted from the nearest byte, others as differences."""
    if runs_:
        keys = _nearest_first(keys)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
    else:
        keys = np.diff(keys, prepend=np.uint64(0))
    return bytes([runs_]) + len(keys).to_bytes(8, "little") + zstandard.compress(_planes(keys, ">u8") + _planes(values, kind), 3)


def unpack(payload: bytes, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(payload[1:9], "little")
    raw = zstandard.decompress(payload[9:])
    keys, values = _from_planes(raw[: 8 * n], n, ">u8").astype(np.uint64), _from_planes(raw[8 * n :], n, kind)
    if not payload[0]:
        return np.cumsum(keys, dtype=np.uint64), values
    keys = _as_runs(keys)
    order = np.argsort(keys)
    return keys[order], values[order]


GRAM, WORD = "g", "w"
#: A class answers whole numbers: counts of words, and of runs -log10 of the probability in these parts.
PARTS = 1 << 30


def class_of(kind: str, keys: np.ndarray, classes: int) -> np.ndarray:
    """Runs by their last two context bytes, words by their hash."""
    return (scrambled((keys >> np.uint64(8)) & np.uint64(0xFFFF) if kind == GRAM else keys) >> np.uint64(20)).astype(np.int64) % classes


def inside(length: np.ndarray, depth: int) -> np.ndarray:
    """Which runs of texts joined with ``depth`` bytes before each lie in one text; ``length`` counts both."""
    starts = np.cumsum(length) - length
    return np.arange(length.sum()) - np.repeat(starts, length) < np.repeat(length - depth, length)


class Lookup:
    """Values of keys, found by the first bits of a bijective mix of the key; a key that is not there gets any value."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = len(keys).bit_length() + 1  # two to four places a key
        self.shift = np.uint64(64 - bits)
        mixed = scrambled(keys)
        order = np.argsort(mixed)
        self.mixed = np.append(mixed[order], np.uint64(2**64 - 1))
        self.values = np.append(values[order], np.zeros(1, values.dtype))
        self.first = np.searchsorted(mixed[order], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        mixed = scrambled(keys)
        at = self.first[mixed >> self.shift]
        early = np.flatnonzero(self.mixed[at] < mixed)
        while len(early):
            at[early] += 1
            early = early[self.mixed[at[early]] < mixed[early]]
        return self.values[at]


class _Block:
    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.docs: list[dict] = []
        self.streams: list[bytes] = []
        self.lists: dict[str, list] = {GRAM: [], WORD: []}
        self.distinct = self.listed = self.size = 0
        self.digest = xxhash.xxh3_128()

    def add(self, ids: list, training: list[bool], raw: list[bytes], memo) -> None:
        parts = [stream(t) for t in raw]
        start = b"\n" * self.depth
        joined = start + start.join(s for _, s in parts)
        self.digest.update(joined)
        self.streams.append(zstandard.compress(joined, 3))
        self.docs += [{"id": i, "held": not t, "length": len(s), "words": len(w)} for i, t, (w, s) in zip(ids, training, parts)]
        self.size += len(joined)
        keys = runs(joined, self.depth)
        length = np.array([len(s) for _, s in parts]) + self.depth
        own = inside(length, self.depth)[: len(keys)]
        teaches = np.repeat(np.array(training, bool), length)[: len(keys)]
        words = [np.append(hashed(w, memo), END_KEY) for w, _ in parts]
        word_teaches = np.repeat(np.array(training, bool), list(map(len, words)))
        for kind, all_keys, learn, rest in ((GRAM, keys, own & teaches, own & ~teaches), (WORD, np.concatenate(words), word_teaches, ~word_teaches)):
            seen, n = np.unique(all_keys[learn], return_counts=True)
            other = np.unique(all_keys[rest])
            keys, counts = added(np.concatenate([seen, other]), np.concatenate([n, np.zeros(len(other), n.dtype)]))
            self.lists[kind].append((keys, counts.astype(np.uint32)))
        self.listed += len(self.lists[GRAM][-1][0])

    def full(self, runs_: int, bytes_: int) -> bool:
        """Whether the block has more than ``runs_`` distinct runs or ``bytes_`` bytes. Runs that several
        steps have count once: lists are merged before the sum of their lengths decides."""
        if len(self.lists[GRAM]) >= 8 or self.listed > 2 * runs_:
            self.merge()
        return self.distinct > runs_ or self.size > bytes_

    def merge(self) -> None:
        for kind, parts in self.lists.items():
            keys, counts = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            keys, counts = added(keys, counts)
            parts.append((keys, counts.astype(np.uint32)))
        self.distinct = self.listed = len(self.lists[GRAM][0][0])

    def rows(self, name: str, classes: int, salts: int) -> pa.RecordBatch:
        self.merge()
        block = f"{name}-{self.digest.hexdigest()}"
        kinds, class_, payloads = ["h"], [-1], [None]
        for kind, parts in self.lists.items():
            keys, counts = parts[0]
            own = class_of(kind, keys, classes)
            order = np.argsort(own, kind="stable")
            used, first = np.unique(own[order], return_index=True)
            for c, a, b in zip(used.tolist(), first, [*first[1:], len(keys)]):
                kinds.append(kind)
                class_.append(c)
                payloads.append(pack(keys[order[a:b]], counts[order[a:b]], runs_=kind == GRAM))
        n = len(kinds)
        nothing = [None] * (n - 1)
        docs = pa.list_(pa.struct([("id", self.kind), ("held", pa.bool_()), ("length", pa.int64()), ("words", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * n, pa.string()), pa.array(kinds, pa.string()), pa.array(class_, pa.int32()),
                pa.array([self.digest.intdigest() % salts] * n, pa.int32()), pa.array([n - 1, *nothing], pa.int32()),
                pa.array([self.docs, *nothing], docs), pa.array([self.rows_of, *nothing], pa.list_(pa.int32())),
                pa.array([self.streams, *nothing], pa.list_(pa.binary())), pa.array(payloads, pa.binary()),
            ],
            ["block", "kind", "class", "salt", "used", "docs", "rows", "streams", "payload"],
        )


def _summed(group: pa.Table) -> pa.Table:
    parts = [unpack(x, "<u8") if wide else unpack(x) for x, wide in zip(group.column("payload").to_pylist(), group.column("wide").to_pylist())]
    keys, counts = added(*(np.concatenate(x) for x in zip(*parts)))
    keys, counts = keys[counts > 0], counts[counts > 0].astype(np.uint64)
    return pa.table(
        {
            "kind": group.column("kind")[:1], "class": group.column("class")[:1], "wide": pa.array([True]),
            "keys": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()),
            "payload": pa.array([pack(keys, counts, "<u8", group.column("kind")[0].as_py() == GRAM)], pa.binary()),
        }
    )


def code_lengths(
    df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", classes: int | None = None,
    block_runs: int = 2_500_000, block_bytes: int = 32 << 20, step_bytes: int = 512 << 10, depth: int = DEPTH,
) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score`` (log10 probability) and ``bits_per_byte``; ``training`` selects rows to learn from, ``depth``
    (2 to 7) is the number of context bytes."""
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7")
    spark = df.sparkSession
    n_classes = classes or max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    _, kind = source(df, id_col, text_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a salted group gathers the lists of about 64 blocks
    salts = max(1, size // (64 * block_bytes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, number = word_hashes(), TaskContext.get().partitionId(), 0
        block, rows_of = _Block(depth), []
        for step in steps(batches, "text", step_bytes):
            block.kind = step.column(0).type
            learn = step.column(2).to_pylist()
            ids = step.column(0).to_pylist()
            block.add(ids, learn, raw_texts(step, "text"), memo)
            rows_of.append(step.num_rows)
            if block.full(block_runs, block_bytes):
                number += 1
                block.rows_of = rows_of
                yield block.rows(f"{part}-{number}", n_classes, salts)
                block, rows_of = _Block(depth), []
        if block.docs:
            block.rows_of = rows_of
            yield block.rows(f"{part}-{number + 1}", n_classes, salts)

    doc = f"array<struct<id:{kind},held:boolean,length:long,words:long>>"
    schema = f"block string, kind string, class int, salt int, used int, docs {doc}, rows array<int>, streams array<binary>, payload binary"
    scanned = stored(rows.mapInArrow(scan, schema))
    summed = "kind string, class int, wide boolean, keys long, total long, payload binary"
    counts = (
        scanned.where("kind <> 'h'").select("kind", "class", "salt", F.lit(False).alias("wide"), "payload")
        .groupBy("kind", "class", "salt").applyInArrow(_summed, summed)
        .groupBy("kind", "class").applyInArrow(_summed, summed)
    )
    learned = stored(counts)
    of_words = learned.where(F.col("kind") == WORD).agg(F.sum("total").alias("n"), F.sum("keys").alias("v")).first()
    n_train, n_distinct = of_words.n or 0, of_words.v or 0

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                keys, n = unpack(payload, "<u8")
                if len(keys):
                    found = subtrees(keys, n, deepest=depth)[2]
                    node, inverse = np.unique(above(found.keys, 2), return_inverse=True)
                    sums = [np.bincount(inverse, x, len(node)) for x in (found.zeros, found.ones, found.log)]
                    yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), *map(pa.array, sums)], ["node", "zeros", "ones", "below"])

    first = (
        learned.where(F.col("kind") == GRAM).select("payload").mapInArrow(lower, "node long, zeros double, ones double, below double")
        .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
        .orderBy("node").collect()  # at most 256 contexts of 255 nodes
    )
    columns = [np.array([r[i] for r in first], np.float64) for i in range(1, 4)]
    shared = spark.sparkContext.broadcast(top(np.array([r[0] for r in first], np.uint64), *columns))

    def answer(group: pa.Table) -> pa.Table:
        group = group.sort_by("order")
        model = group.column("order")[0].as_py() == 0
        known, n = unpack(group.column("payload")[0].as_py(), "<u8") if model else (np.empty(0, np.uint64), np.empty(0, np.uint64))
        asked = group.slice(1) if model else group
        lists_ = [unpack(x)[0] for x in asked.column("payload").to_pylist()]
        every = np.unique(np.concatenate([np.empty(0, np.uint64), *lists_]))
        if group.column("kind")[0].as_py() == GRAM:
            found = np.rint(-PARTS * log10_p(every, {**subtrees(known, n.astype(np.float64), deepest=depth), **shared.value})).astype(np.uint64)
        else:
            at = np.minimum(np.searchsorted(known, every), max(0, len(known) - 1))
            found = np.where(known[at] == every, n[at], 0) if len(known) else np.zeros(len(every), np.uint64)
        # values in the order of the list's keys; the list goes with them
        out = [zstandard.compress(_planes(found[np.searchsorted(every, x)], "<u8"), 3) for x in lists_]
        return pa.table({"block": asked.column("block"), "kind": asked.column("kind"), "asked": asked.column("payload"), "payload": pa.array(out, pa.binary())})

    asked = scanned.where("kind <> 'h'").select("kind", "class", "salt", F.lit(1).alias("order"), "block", "payload")
    models = learned.select("kind", "class", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("order"), F.lit(None).cast("string").alias("block"), "payload")
    answers = asked.unionAll(models).groupBy("kind", "class", "salt").applyInArrow(answer, "block string, kind string, asked binary, payload binary")

    def score(group: pa.Table) -> pa.Table:
        heads = group.filter(pa.compute.equal(group.column("kind"), "h"))
        header = heads.slice(0, 1).to_pylist()[0]
        if header["used"] != group.num_rows - 1:
            raise ValueError("a block came together incomplete; its input gave other rows on a retry")
        memo, docs = word_hashes(), header["docs"]
        table = {}
        for name in (GRAM, WORD):
            part = group.filter(pa.compute.equal(group.column("kind"), name))
            keys = [unpack(x)[0] for x in part.column("asked").to_pylist()]
            values = np.concatenate([_from_planes(zstandard.decompress(x), len(k), "<u8") for k, x in zip(keys, part.column("payload").to_pylist())])
            table[name] = Lookup(np.concatenate(keys), values)

        def read() -> Iterator[tuple]:
            at = 0
            for n_docs, packed in zip(header["rows"], header["streams"]):
                joined = zstandard.decompress(packed)
                length = np.array([d["length"] for d in docs[at : at + n_docs]]) + depth
                at += n_docs
                starts = np.cumsum(length) - length
                words = [np.append(hashed(joined[s + depth : s + n].split(), memo), END_KEY) for s, n in zip(starts, length)]
                yield runs(joined, depth), inside(length, depth), starts, words

        score_, base, known = [], [], []
        for found, own, starts, words in read():
            logs = np.append(table[GRAM][found] / -PARTS, np.zeros(depth))
            score_.append(np.add.reduceat(np.where(own, logs, 0.0).astype(np.float64), starts))
            sizes = np.array(list(map(len, words)))
            c = table[WORD][np.concatenate(words)].astype(np.float64)
            first_ = np.cumsum(sizes) - sizes
            base.append(np.add.reduceat(np.log10((c + 1) / (n_train + n_distinct + 1)), first_))
            known.append(np.add.reduceat((c > 0).astype(np.int64), first_))
        total, sizes = np.concatenate(score_), np.array([d["length"] for d in docs])
        id_type = group.schema.field("docs").type.value_type.field("id").type
        return pa.table(
            {
                "id": pa.array([d["id"] for d in docs], id_type), "held_out": pa.array([d["held"] for d in docs], pa.bool_()),
                "n_tokens": pa.array([d["words"] + 1 for d in docs], pa.int64()), "n_known": pa.array(np.concatenate(known), pa.int64()),
                "train_tokens": pa.array([n_train] * len(docs), pa.int64()), "base_score": pa.array(np.concatenate(base)),
                "score": pa.array(total), "bits_per_byte": pa.array(-total / np.log10(2) / sizes),
            }
        )

    heads = scanned.where("kind = 'h'").select("block", "kind", F.lit(None).cast("binary").alias("asked"), "payload", "used", "docs", "rows", "streams")
    back = answers.select("block", "kind", "asked", "payload", *[F.lit(None).cast(t).alias(n) for n, t in (("used", "int"), ("docs", doc), ("rows", "array<int>"), ("streams", "array<binary>"))])
    out = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return heads.unionAll(back).groupBy("block").applyInArrow(score, out).withColumnRenamed("id", id_col)
