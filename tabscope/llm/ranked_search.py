"""Exact ranked search with posting lists in blocks of similar documents.

*Index.* Tasks read documents and keep, shard by shard, the counts of the terms that the queries ask
for (all others add nothing to a score). Numbers of documents, terms and document frequencies are
summed over all of them; a shard then has the whole-number weight of each of its terms in each of
its documents. A term's posting list is cut into blocks of similar documents: the documents of
the list that are pivots of the shard draw the others to the one with the largest cosine. A
block's summary is the coordinatewise maximum of its documents' weights.

*Search.* A query's lists are taken rare terms first. A block of the j-th list cannot score more than
the product of its summary and the query over the terms from j on: its documents that hold an
earlier term were met in that list. Blocks whose bound is below the k-th best score so far are skipped,
all others are scored exactly. Blocks of a list are made when a query first needs them, that is, when the
list as one block could reach that score. Each task keeps the best of its shards; ranks are made of these.

Scores are 64-bit whole numbers; ties go to the smaller id, rows without an id last. Null texts have no
terms; a row of ``queries`` is a query of its own, whatever its id. Repeated rows are rows. Extra columns
are ignored; empty tables give an empty result. Very long texts are shards of their own. Queries
run in blocks of a bounded number of bytes, so what is broadcast is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import source, steps, stored, texts

#: Separators become a space, A-Z become a-z, all other bytes stay.
TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
#: Documents and cells (documents x terms) of a shard at most; documents of a list per block on average.
SHARD_DOCS, SHARD_CELLS, BLOCK_DOCS = 2048, 8 << 20, 64


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERMS).split()


def queries_of(queries: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and distinct terms of the queries, in blocks of about ``block_bytes``."""
    rows, kind = source(queries, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            own = [sorted(set(terms_of(t))) for t in texts(step, "text")]
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(own, pa.list_(pa.binary()))], ["id", "terms"])

    ids, terms, size = [], [], 0
    for r in rows.mapInArrow(scan, f"id {kind}, terms array<binary>").where("size(terms) > 0").toLocalIterator():
        ids.append(r.id)
        terms.append([bytes(t) for t in r.terms])
        size += sum(map(len, terms[-1])) + 64 * len(terms[-1])
        if size >= block_bytes:
            yield ids, terms
            ids, terms, size = [], [], 0
    if ids:
        yield ids, terms


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *map(len, arrays)], "<u8").tobytes()
    return head + zstandard.compress(b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays), 3)


def _unpacked(payload: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(payload, "<u8", 1)[0])
    sizes, raw, at, out = np.frombuffer(payload, "<u8", k, 8).astype(int), zstandard.decompress(payload[8 + 8 * k :]), 0, []
    for n in sizes:
        out.append(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").reshape(-1).astype(np.int64))
        at += 4 * n
    return out


def _index(rows: DataFrame, kind: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards (ids, lengths, and packed: terms per document, terms, counts) and, per task, N, L and df."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, id_type = shared.value, None
        df, n_docs, n_terms = np.zeros(len(known), np.int64), 0, 0
        names = ["ids", "lengths", "payload", "docs", "terms", "df_terms", "df"]
        for step in steps(batches, "text"):
            id_type, lengths, sizes, found, counts, keep = step.column(0).type, [], [], [], [], []
            for i, text in enumerate(texts(step, "text")):
                words = terms_of(text)
                n_docs, n_terms = n_docs + bool(words), n_terms + len(words)
                own = Counter(filter(known.__contains__, words))
                if own:
                    keep.append(i)
                    lengths.append(len(words))
                    sizes.append(len(own))
                    found += map(known.__getitem__, own)
                    counts += own.values()
            terms = np.array(found, np.int64)
            df += np.bincount(terms, minlength=len(df))
            if keep:
                payload = _packed(np.array(sizes, np.int64), terms, np.array(counts, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([step.column(0).take(pa.array(keep)).to_pylist()], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                        pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())),
                    ],
                    names,
                )
        if id_type is not None:
            own = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, pa.list_(id_type)), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([n_docs]), pa.array([n_terms]),
                    pa.array([own.tolist()], pa.list_(pa.int32())), pa.array([df[own].tolist()], pa.list_(pa.int64())),
                ],
                names,
            )

    return rows.mapInArrow(scan, f"ids array<{kind}>, lengths array<long>, payload binary, docs long, terms long, df_terms array<int>, df array<long>")


class Shard:
    """Documents and the weights of their terms, with lists of blocks made on demand."""

    def __init__(self, ids: list, weights: np.ndarray, terms: np.ndarray, block_docs: int) -> None:
        self.ids, self.weights, self.terms, self.block_docs = ids, weights, terms, block_docs
        self.place = {t: i for i, t in enumerate(terms.tolist())}
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        self.rank = np.empty(len(ids), np.int64)
        self.rank[order] = np.arange(len(ids))
        self.most = weights.max(0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.likeness = None

    def near(self) -> np.ndarray:
        """Cosine of every document to the pivots: documents at even distances, one for each block."""
        if self.likeness is None:
            unit = self.weights.astype(np.float32)
            unit /= np.maximum(np.sqrt((unit * unit).sum(1, keepdims=True)), 1e-9)
            self.pivots = np.linspace(0, len(unit) - 1, max(1, len(unit) // self.block_docs)).astype(int)
            self.likeness = unit @ unit[self.pivots].T
        return self.likeness

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a term by block, where the blocks begin, and their summaries."""
        if term not in self.lists:
            docs = np.flatnonzero(self.weights[:, term])
            starts = np.zeros(1, np.int64)
            if len(docs) > self.block_docs:
                near = self.near()
                own = np.flatnonzero(self.weights[self.pivots, term])
                if len(own):
                    block = near[docs][:, own].argmax(1)
                    docs = docs[np.argsort(block, kind="stable")]
                    starts = np.flatnonzero(np.diff(np.sort(block), prepend=-1))
            self.lists[term] = docs, starts, np.maximum.reduceat(self.weights[docs], starts, axis=0)
        return self.lists[term]

    def best(self, query: np.ndarray, weights: np.ndarray, k: int, floor: int | None, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of documents that may be among the ``k`` best; all with a score of ``floor`` or more
        are met. ``query``: terms, rare first, with their ``weights``."""
        here = [(self.place[t], w) for t, w in zip(query.tolist(), weights.tolist()) if t in self.place]
        if not here:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        columns, w = np.array([c for c, _ in here]), np.array([x for _, x in here], np.int64)
        least = max(floor or 0, 1)
        reach = np.cumsum((self.most[columns] * w)[::-1])[::-1]  # of each list as one block
        met = np.zeros(len(self.ids), bool)
        for j in range(len(columns)):
            if reach[j] < least:
                counts["lists skipped"] += len(columns) - j
                break
            docs, starts, summaries = self.blocks(int(columns[j]))
            bound = summaries[:, columns[j:]].astype(np.int64) @ w[j:]
            open_ = bound >= least
            counts["blocks"] += len(starts)
            counts["skipped"] += int((~open_).sum())
            if open_.all():
                met[docs] = True
            elif open_.any():
                met[docs[np.repeat(open_, np.diff(starts, append=len(docs)))]] = True
        docs = np.flatnonzero(met)
        scores = self.weights[np.ix_(docs, columns)].astype(np.int64) @ w
        counts["scored"] += len(docs)
        keep = scores >= least
        docs, scores = docs[keep], scores[keep]
        first = np.lexsort((self.rank[docs], -scores))[:k]
        return docs[first], scores[first]


def shards(ids: list, lengths: np.ndarray, payload: bytes, n_docs: int, n_terms: int, block_docs: int, shard_docs: int = SHARD_DOCS, cells: int = SHARD_CELLS) -> Iterator[Shard]:
    sizes, terms, counts = _unpacked(payload)
    ends = np.cumsum(sizes)
    m = 10 + 90 * lengths * n_docs // n_terms
    weights = 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, sizes))
    start = 0
    while start < len(ids):
        stop = min(len(ids), start + shard_docs)
        while True:
            a, b = ends[start] - sizes[start], ends[stop - 1]
            own, column = np.unique(terms[a:b], return_inverse=True)
            if stop == start + 1 or (stop - start) * len(own) <= cells:
                break
            stop = start + max(1, (stop - start) // 2)
        table = np.zeros((stop - start, len(own)), np.int32)  # a weight is below 1,000,000
        table[np.repeat(np.arange(stop - start), sizes[start:stop]), column] = weights[a:b]
        yield Shard(ids[start:stop], table, own, block_docs)
        start = stop


def _smaller(entry: tuple) -> tuple:
    return -entry[0], entry[1] is None, entry[1] if entry[1] is not None else 0


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    query_id_col: str = "item_id", query_text_col: str = "text", block_docs: int = BLOCK_DOCS, query_bytes: int = 16 << 20,
) -> DataFrame:
    """Per query the ``k`` documents of highest score above 0: query id, ``rank``, document id, ``score``."""
    rows, kind = source(docs, id_col, text_col)
    spark = docs.sparkSession
    query_kind = queries.schema[query_id_col].dataType
    out = None
    for ids, terms in queries_of(queries, query_id_col, query_text_col, query_bytes):
        found = _searched(rows, kind, terms, k, block_docs)
        # the ids of a block's queries by their number; the block is bounded
        names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("query", LongType()), StructField("query_id", query_kind)]))
        own = found.join(F.broadcast(names), "query").select(F.col("query_id").alias(query_id_col), "rank", F.col("id").alias(id_col), "score")
        out = own if out is None else out.unionAll(own)
    if out is None:
        fields = [(query_id_col, query_kind), ("rank", IntegerType()), (id_col, docs.schema[id_col].dataType), ("score", LongType())]
        return spark.createDataFrame([], StructType([StructField(*f) for f in fields]))
    return out


def _searched(rows: DataFrame, kind: str, queries: list[list[bytes]], k: int, block_docs: int) -> DataFrame:
    """Rows of query (its number), rank, id and score."""
    spark = rows.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for q in queries for t in q}))}
    index = stored(_index(rows, kind, vocabulary))
    total = index.where("docs is not null")
    sums = total.agg(F.sum("docs").alias("n"), F.sum("terms").alias("l")).first()
    n_docs, n_terms = sums.n or 0, sums.l or 0
    df = np.zeros(len(vocabulary), np.int64)
    for r in total.select(F.inline(F.arrays_zip("df_terms", "df"))).groupBy("df_terms").agg(F.sum("df").alias("df")).collect():  # the queries' terms
        df[r.df_terms] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    asked = []
    for q in queries:
        own = np.array([vocabulary[t] for t in q], np.int64)
        own = own[np.argsort(-weight[own], kind="stable")]
        asked.append((own, weight[own]))
    shared = spark.sparkContext.broadcast(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in shared.value]
        counts, id_type = Counter(), None
        for batch in batches:
            for row in range(batch.num_rows):
                id_type = batch.column(0).type.value_type
                for shard in shards(batch.column(0)[row].as_py(), batch.column(1)[row].values.to_numpy(), batch.column(2)[row].as_py(), n_docs, n_terms, block_docs):
                    for kept, (own, weights) in zip(best, shared.value):
                        places, scores = shard.best(own, weights, k, kept[-1][0] if len(kept) == k else None, counts)
                        if len(places):
                            kept[:] = sorted([*kept, *((s, shard.ids[p]) for p, s in zip(places.tolist(), scores.tolist()))], key=_smaller)[:k]
        if id_type is not None:
            numbers = np.repeat(np.arange(len(best)), list(map(len, best)))
            entries = [x for kept in best for x in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array([i for _, i in entries], id_type), pa.array([s for s, _ in entries], pa.int64())], ["query", "id", "score"]
            )

    found = index.where("payload is not null").select("ids", "lengths", "payload").mapInArrow(search, f"query long, id {kind}, score long")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    # the best of some tasks first, then of all; both windows hold back what is beyond rank k
    part = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "rank", "id", "score")
