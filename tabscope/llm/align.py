"""Alignment of two tokenizers by the byte ranges of their tokens.

``a`` is a byte-level BPE, ``b`` a sentence-piece BPE; both encode a space and the text. Where
tokens of both end, a group ends. Tokens whose byte ranges overlap are linked.

*Groups.* Every task reads documents in blocks. A text is cut before a space that follows
something else, which no token of either vocabulary spans (else texts stay whole); the distinct
chunks of a block are encoded once and aligned together: the ends of both tokenizers are sorted
into one line of bytes, the ends they have in common close groups, and each stretch between two
neighbouring ends is one link. Documents are sums over their chunks.

*Identity map.* A table gives for each ``a`` id the ``b`` id of the same bytes. Links of such
pairs, above all the groups of one token each, are counted in a vector of the length of the
vocabulary; only all other pairs are shuffled, once per block and pair. Counts, and the highest
one per ``b`` id, return to the blocks, which sum them by chunk and document.

Texts that are null or empty, or whose tokens do not join to the text (a normaliser changed it), have
no tokens. Rows are independent: ids may be null or repeat; extra columns are ignored; an empty
table gives an empty result. Very long texts are read in slices and encoded chunk by chunk.
What is broadcast has the length of a vocabulary.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import source, steps, stored, texts

CUT = re.compile(r"(?<=\S) ")
SPACE = "▁"
WHOLE = "whole "
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """Letter to byte of byte-level vocabularies: visible Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: encodes texts to flat ids, knows the bytes of each id."""

    def __init__(self, encode, token_bytes: list[bytes]) -> None:
        self.encode, self.bytes = encode, token_bytes
        self.lengths = np.array(list(map(len, token_bytes)), np.int64)
        self.table = np.array(token_bytes, object)

    def flat(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each chunk has."""
        ids, counts, start, size = [], [], 0, 0
        for i, chunk in enumerate(chunks):
            size += len(chunk) + 8
            if size >= 1 << 18 or i + 1 == len(chunks):
                found = self.encode(chunks[start : i + 1])
                counts.append(np.fromiter(map(len, found), np.int64, len(found)))
                ids.append(np.fromiter(chain.from_iterable(found), np.int64))
                start, size = i + 1, 0
        return np.concatenate([np.empty(0, np.int64), *ids]), np.concatenate([np.empty(0, np.int64), *counts])


def byte_side(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    letters = byte_letters()
    size = tokenizer.get_vocab_size()
    own = [tokenizer.id_to_token(i) or "" for i in range(size)]
    token_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in own]

    def encode(chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]

    return Side(encode, token_bytes)


def piece_side(path: str) -> tuple[Side, bool]:
    """The sentence-piece tokenizer; whether no piece holds a space after something else."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    token_bytes = [bytes([int(m[1], 16)]) if model.is_byte(i) and (m := BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    cuttable = not any(SPACE in p.lstrip(SPACE) for p in pieces)
    return Side(lambda chunks: model.encode(chunks, num_threads=1), token_bytes), cuttable


def identity(a: Side, b: Side) -> np.ndarray:
    """For each id of ``a`` the last id of ``b`` with the same bytes, -1 without one."""
    of = {t: i for i, t in enumerate(b.bytes)}
    return np.array([of.get(t, -1) for t in a.bytes], np.int64)


def numerals(side: Side, inner: str, last: str) -> np.ndarray:
    """Decimal ids with the mark that follows: ``inner``, then ``last``."""
    return np.array([f"{i}{mark}".encode() for mark in (inner, last) for i in range(len(side.bytes))], object)


def slices(text: str, cuttable: bool, size: int = 1 << 20) -> Iterator[list[str]]:
    """Chunks of a text, some at a time."""
    if not cuttable:
        yield [text]
        return
    start = 0
    while len(text) - start > size and (cut := CUT.search(text, start + size)):
        yield CUT.split(text[start : cut.start()])
        start = cut.end()
    yield CUT.split(text[start:])


class Aligned:
    """Alignment of distinct chunks, all as one line of bytes."""

    def __init__(self, chunks: list[str], a: Side, b: Side, marks: tuple[np.ndarray, np.ndarray]) -> None:
        ids_a, n_a = a.flat(chunks)
        ids_b, n_b = b.flat(chunks)
        raw = [b" " + c.encode() for c in chunks]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = b"".join(raw)
        self.bad = np.zeros(len(chunks), bool)
        for side, ids, n in ((a, ids_a, n_a), (b, ids_b, n_b)):
            if b"".join(side.table[ids]) != whole or (np.bincount(np.repeat(np.arange(len(n)), n), side.lengths[ids], len(n)) != size).any():
                ends = np.cumsum(n)
                self.bad |= np.array([b"".join(side.table[ids[e - k : e]]) != r for e, k, r in zip(ends, n, raw)], bool)
        if self.bad.any():  # chunks that do not come back hold no tokens here
            ids_a, ids_b = ids_a[~np.repeat(self.bad, n_a)], ids_b[~np.repeat(self.bad, n_b)]
            n_a, n_b, size = np.where(self.bad, 0, n_a), np.where(self.bad, 0, n_b), np.where(self.bad, 0, size)
        self.n_a, self.n_b = n_a, n_b
        ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
        chunk_ends = np.cumsum(size)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        every = np.union1d(ends_a, ends_b)
        self.n_groups = np.diff(np.searchsorted(shared, chunk_ends, "right"), prepend=0)
        self.n_links = np.diff(np.searchsorted(every, chunk_ends, "right"), prepend=0)
        self.link_a, self.link_b = ids_a[np.searchsorted(ends_a, every)], ids_b[np.searchsorted(ends_b, every)]
        # decimal ids in the order of groups, a before b
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        first_a, first_b = np.searchsorted(group_a, np.arange(len(shared) + 1)), np.searchsorted(group_b, np.arange(len(shared) + 1))
        parts = np.empty(len(ids_a) + len(ids_b), object)
        closes_a, closes_b = np.isin(ends_a, shared, assume_unique=True), np.isin(ends_b, shared, assume_unique=True)
        parts[np.arange(len(ids_a)) + first_b[group_a]] = marks[0][ids_a + closes_a * len(a.bytes)]
        parts[np.arange(len(ids_b)) + first_a[group_b + 1]] = marks[1][ids_b + closes_b * len(b.bytes)]
        parts = parts.tolist()
        text = b"".join(parts)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])[np.cumsum(n_a + n_b)]
        self.strings = [text[s:e] for s, e in zip([0, *at[:-1].tolist()], at.tolist())]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, ``counts[i]`` of them in run i."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def packed(*arrays: np.ndarray) -> bytes:
    """Numbers of 0 to 2^32 - 1, byte by byte place."""
    head = np.array([len(arrays), *map(len, arrays)], "<u8").tobytes()
    return head + zstandard.compress(b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays), 3)


def unpacked(payload: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(payload, "<u8", 1)[0])
    sizes, raw, at, out = np.frombuffer(payload, "<u8", k, 8).astype(int), zstandard.decompress(payload[8 + 8 * k :]), 0, []
    for n in sizes:
        out.append(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").reshape(-1).astype(np.int64))
        at += 4 * n
    return out


class _Block:
    def __init__(self) -> None:
        self.code: defaultdict[str, int] = defaultdict()
        self.code.default_factory = self.code.__len__
        self.ids: list[pa.Array] = []
        self.docs: list[list[np.ndarray]] = []
        self.raw: list[str] = []
        self.size = 0

    def add(self, ids: pa.Array, rows: list[str], cuttable: bool) -> None:
        self.ids.append(ids)
        for text in rows:
            parts = []
            for chunks in slices(text, cuttable) if text else ():
                parts.append(np.fromiter(map(self.code.__getitem__, chunks), np.int32, len(chunks)))
            self.docs.append(parts)
            self.raw.append(text)
            self.size += len(text)


_DOCS = "array<struct<id:{}, n_a:long, n_b:long, n_groups:long, n_links:long, sha:string>>"


def _scan(a_path: str, b_path: str, kind: str, block_chars: int, block_chunks: int):
    """Arrow function: documents to blocks, the pairs of each block, and identity counts of the task."""

    def flush(block: _Block, name: str, a: Side, b: Side, cuttable: bool, same: np.ndarray, marks, id_type, total: np.ndarray) -> pa.RecordBatch:
        chunks = list(block.code)
        found = Aligned(chunks, a, b, marks)
        codes = [np.concatenate([np.empty(0, np.int32), *p]) for p in block.docs]
        if found.bad.any() and cuttable:  # a text with such a chunk is encoded whole; no chunk begins with WHOLE
            odd = [i for i, c in enumerate(codes) if found.bad[c].any()]
            for i in odd:
                codes[i] = np.array([block.code[WHOLE + block.raw[i]]], np.int32)
            extra = list(block.code)[len(chunks) :]
            more = Aligned([c[len(WHOLE) :] for c in extra], a, b, marks)
            for x in ("bad", "n_a", "n_b", "n_groups", "n_links", "link_a", "link_b"):
                setattr(found, x, np.concatenate([getattr(found, x), getattr(more, x)]))
            found.strings += more.strings
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.concatenate([np.empty(0, np.int32), *codes])
        times = np.bincount(flat, minlength=len(found.n_a))
        weight = np.repeat(times, found.n_links)
        fits = same[found.link_a] == found.link_b
        total += np.bincount(found.link_a[fits], weight[fits], len(total)).astype(np.int64)
        pairs, inverse = np.unique(found.link_a[~fits] << 32 | found.link_b[~fits], return_inverse=True)
        n = np.bincount(inverse, weight[~fits], len(pairs)).astype(np.int64)
        # a link is an id of ``a``, or beyond these the place of its pair
        links = np.empty(len(fits), np.int64)
        links[fits], links[~fits] = found.link_a[fits], len(same) + inverse
        docs = [sums(x[flat], sizes) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        digests, start = [], 0
        for k, tokens in zip(sizes.tolist(), docs[0].tolist()):
            own = b"".join(map(found.strings.__getitem__, flat[start : start + k].tolist()))
            digests.append(hashlib.sha256(own[:-1]).hexdigest() if tokens else "")
            start += k
        header = pa.StructArray.from_arrays(
            [pa.concat_arrays(block.ids).cast(id_type), *[pa.array(x, pa.int64()) for x in docs], pa.array(digests, pa.string())],
            ["id", "n_a", "n_b", "n_groups", "n_links", "sha"],
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(header)], pa.int32()), header),
                pa.array([packed(sizes, flat, found.n_links, links)], pa.binary()),
                pa.array([(pairs >> 32).tolist()], pa.list_(pa.int32())), pa.array([(pairs & 0xFFFFFFFF).tolist()], pa.list_(pa.int32())),
                pa.array([n.tolist()], pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64())),
            ],
            ["block", "docs", "payload", "a", "b", "n", "identity"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, (b, cuttable) = byte_side(a_path), piece_side(b_path)
        same, marks = identity(a, b), (numerals(a, ",", "|"), numerals(b, ",", ";"))
        total, block, k, id_type = np.zeros(len(same), np.int64), _Block(), 0, None
        part = TaskContext.get().partitionId()
        for step in steps(batches, "text"):
            id_type = step.column(0).type
            rows = texts(step, "text")
            for i, text in enumerate(rows):
                block.add(step.column(0).slice(i, 1), [text], cuttable)
                if block.size >= block_chars or len(block.code) >= block_chunks:
                    yield flush(block, f"{part}-{k}", a, b, cuttable, same, marks, id_type, total)
                    block, k = _Block(), k + 1
        if block.docs:
            yield flush(block, f"{part}-{k}", a, b, cuttable, same, marks, id_type, total)
        if id_type is not None:
            docs = pa.list_(pa.struct([("id", id_type), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")], ("sha", pa.string())]))
            none = pa.nulls(1, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.nulls(1, docs), pa.nulls(1, pa.binary()), none, none, pa.nulls(1, pa.list_(pa.int64())), pa.array([total.tolist()], pa.list_(pa.int64()))],
                ["block", "docs", "payload", "a", "b", "n", "identity"],
            )

    return scan, f"block string, docs {_DOCS.format(kind)}, payload binary, a array<int>, b array<int>, n array<long>, identity array<long>"


def align(
    df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8 << 20, block_chunks: int = 200_000,
) -> DataFrame:
    """Per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the most
    counted one of its ``b`` id), ``count_sum`` (counts of the links' pairs) and ``groups_sha256``."""
    rows, kind = source(df, id_col, text_col)
    spark = df.sparkSession
    scan, form = _scan(a_path, b_path, kind, block_chars, block_chunks)
    scanned = stored(rows.mapInArrow(scan, form))
    blocks = scanned.where("block is not null")
    pairs = blocks.select("block", F.inline(F.arrays_zip("a", "b", "n")))
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")))

    a, (b, _) = byte_side(a_path), piece_side(b_path)
    same = identity(a, b)
    of_identity, best = np.zeros(len(same), np.int64), np.zeros(len(b.bytes), np.int64)
    vectors = scanned.where("identity is not null").select(F.posexplode("identity").alias("a", "n")).where("n > 0")
    for r in vectors.groupBy("a").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary of a
        of_identity[r.a] = r.n
    for r in counts.groupBy("b").agg(F.max("n").alias("n")).collect():  # at most the vocabulary of b
        best[r.b] = r.n
    known = same >= 0
    np.maximum.at(best, same[known], of_identity[known])
    shared = spark.sparkContext.broadcast((of_identity, np.where(known, of_identity == best[same], False), best))

    def score(group: pa.Table) -> pa.Table:
        head = group.filter(pa.compute.is_valid(group.column("payload")))
        answers = group.filter(pa.compute.is_null(group.column("payload")))
        sizes, flat, n_links, links = unpacked(head.column("payload")[0].as_py())
        docs = head.column("docs").combine_chunks().flatten()
        id_counts, id_best, top = shared.value
        a_, b_, n = (answers.column(c).to_numpy() for c in ("a", "b", "n"))
        order = np.argsort(a_.astype(np.int64) << 32 | b_.astype(np.int64))
        counted = np.concatenate([id_counts, n[order]])
        is_best = np.concatenate([id_best, n[order] == top[b_[order]]])
        if len(links) and links.max() >= len(counted):
            raise ValueError("a block came together incomplete")
        by_chunk = [sums(x[links].astype(np.int64), n_links) for x in (is_best, counted)]
        by_doc = [pa.array(sums(x[flat], sizes), pa.int64()) for x in by_chunk]
        field = {x: docs.field(i) for i, x in enumerate(("id", "n_a", "n_b", "n_groups", "n_links", "sha"))}
        return pa.table({**{x: field[x] for x in ("id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": by_doc[0], "count_sum": by_doc[1], "groups_sha256": field["sha"]})

    none = [F.lit(None).cast(t).alias(c) for c, t in (("docs", _DOCS.format(kind)), ("payload", "binary"))]
    answers = pairs.select("block", "a", "b").join(counts, ["a", "b"]).select("block", *none, "a", "b", "n")
    heads = blocks.select("block", "docs", "payload", *[F.lit(None).cast(t).alias(c) for c, t in (("a", "int"), ("b", "int"), ("n", "long"))])
    out = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return heads.unionAll(answers).groupBy("block").applyInArrow(score, out).withColumnRenamed("id", id_col)
