"""Exact links between embeddings by cosine, from quantised tile products with error bounds.

Equal vectors are one class (they are linked); only classes are compared.

*Quantisation.* A unit vector ``x`` is ``s q + e``: whole numbers ``q`` from -127 to 127, a scale and
a rest whose length ``|e|`` is measured, not estimated. The cosine of two vectors then differs from
``s s' q.q'`` by ``|e| + |e'| + |e||e'|`` at most. Products of tiles of ``q`` are exact: sums of up to
1,024 products of such numbers fit the 24 bits of a 32-bit float, longer vectors are summed in
parts. Pairs whose bound lies above the threshold are links, pairs below are none, and only
those between are computed again from the vectors in double precision.

*Blocks.* Classes go to the nearest of some pivots (a bounded sample of the classes) and, by hash,
to blocks of one region. Every two blocks that may hold a link meet in one task; a vector is sent to
a region only if its angle to the pivot exceeds the widest one there by the link angle at most, and
it is not nearer to its own pivot by more than twice the link angle, both by the triangle
inequality. Vectors without near neighbours in other regions hence stay home; for vectors without any
such order (all angles about 90 degrees) nothing can be left out and the work is the
square of the number of classes, as for any exact method.

Tasks return, for their classes, the number of linked rows and an edge to the smallest class of
their component inside the task, never the pairs. Counts are summed, components joined.

Vectors that are null, zero, empty or hold null or non-finite numbers are linked with nothing, vectors of
different length not with each other. Repeated rows are rows of their own. Rows without an id
take part and are linked, but give no component its name. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import stored
from .components import components

#: Rows of a tile, bytes of vectors in a block, pivots at most, terms of one exact product sum.
TILE, BLOCK_BYTES, PIVOTS, EXACT = 1024, 8 << 20, 1024, 1024
ROOM = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; the largest component first becomes 1."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Quantised:
    """Rows as whole numbers, their scale and the length of what is lost."""

    def __init__(self, x: np.ndarray) -> None:
        self.unit = unit(x)
        self.scale = np.abs(self.unit).max(1) / 127
        q = np.rint(self.unit / self.scale[:, None])
        self.rest = np.sqrt(((self.unit - q * self.scale[:, None]) ** 2).sum(1)) + ROOM
        self.q = q.astype(np.float32)

    def products(self, rows: slice, other: Quantised, columns: slice) -> np.ndarray:
        """Products of the whole numbers, exact."""
        a, b = self.q[rows], other.q[columns]
        if a.shape[1] <= EXACT:
            return a @ b.T
        return sum((a[:, i : i + EXACT] @ b[:, i : i + EXACT].T).astype(np.float64) for i in range(0, a.shape[1], EXACT))

    def links(self, rows: slice, other: Quantised, columns: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of two tiles with cosine ``least`` or more."""
        product = self.products(rows, other, columns)
        s, e = self.scale[rows], self.rest[rows]
        t, f = other.scale[columns], other.rest[columns]
        # one pass with the tile's largest rest and float rounding allowed for, then the pairs' own bounds
        product *= s[:, None].astype(product.dtype)
        widest = (1 + e.max()) * (1 + f) - 1
        i, j = np.nonzero(product >= ((least - widest - 1e-5) / t).astype(product.dtype))
        i, j = i + (rows.start or 0), j + (columns.start or 0)
        linked = np.zeros(len(i), bool)
        for start in range(0, len(i), 1 << 16):
            a, b = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
            near = np.einsum("ij,ij->i", self.q[a].astype(np.float64), other.q[b]) * self.scale[a] * other.scale[b]
            lost = (1 + self.rest[a]) * (1 + other.rest[b]) - 1
            linked[start : start + len(a)] = sure = near - lost >= least
            again = np.flatnonzero(~sure & (near + lost >= least))
            linked[start + again] = np.einsum("ij,ij->i", self.unit[a[again]], other.unit[b[again]]) >= least
        return i[linked], j[linked]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the place of a smaller or the same node) after joining the pairs."""
    while True:
        x, y = label[a], label[b]
        differs = x != y
        if not differs.any():
            return label
        a, b, x, y = a[differs], b[differs], x[differs], y[differs]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def compare(x: np.ndarray, y: np.ndarray | None, n_x: np.ndarray, n_y: np.ndarray | None, least: float, tile: int = TILE):
    """Linked rows of each class and its root's place, among ``x`` (``y`` None) or between ``x`` and ``y``."""
    one = Quantised(x)
    other, sizes = (one, n_x) if y is None else (Quantised(y), n_y)
    m, n = len(x), len(sizes)
    first = 0 if y is None else m
    links, label = np.zeros(first + n, np.int64), np.arange(first + n)
    for p in range(0, m, tile):
        for q in range(p if y is None else 0, n, tile):
            i, j = one.links(slice(p, min(p + tile, m)), other, slice(q, min(q + tile, n)), least)
            if y is None and p == q:
                i, j = i[i < j], j[i < j]
            if len(i):
                links += np.bincount(i, sizes[j], len(links)).astype(np.int64)
                links += np.bincount(first + j, n_x[i], len(links)).astype(np.int64)
                label = joined(label, i, first + j)
    return links, label


def _usable(vectors: pa.Array, kind: str) -> list[bytes | None]:
    """Bytes of each vector; None if it links with nothing."""
    out = []
    flat, offsets = vectors.values, vectors.offsets.to_numpy()
    gaps = flat.is_null().to_numpy(zero_copy_only=False)
    numbers = pa.compute.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # -0 becomes 0
    good = np.concatenate([[0], np.cumsum(~gaps & np.isfinite(numbers))])
    some = np.concatenate([[0], np.cumsum(~gaps & (numbers != 0))])
    for i, valid in enumerate(vectors.is_valid().to_pylist()):
        s, e = offsets[i], offsets[i + 1]
        out.append(numbers[s:e].tobytes() if valid and e > s and good[e] - good[s] == e - s and some[e] > some[s] else None)
    return out


def _classes(rows: DataFrame, id_type: str, kind: str) -> DataFrame:
    """Per row: id, class (a digest, null if it links with nothing) and the vector's bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _usable(batch.column(1), kind)
            digests = [None if v is None else xxhash.xxh3_128_digest(v) for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(found, pa.binary())], ["id", "class", "vector"])

    return rows.mapInArrow(scan, f"id {id_type}, class binary, vector binary")


def _assigned(classes: DataFrame, pivots: dict[int, np.ndarray], subs: int, kind: str) -> DataFrame:
    """Add region (number of the nearest pivot of the same length, -1 without one), sub-block and angle."""
    shared, width = classes.sparkSession.sparkContext.broadcast(pivots), np.dtype(kind).itemsize

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            digests = batch.column(batch.schema.get_field_index("class")).to_pylist()
            size = np.array([len(v) // width for v in vectors], np.int64)
            region, angle = np.full(len(size), -1, np.int64), np.full(len(size), np.pi)
            for d in np.unique(size).tolist():
                if d in shared.value:
                    for at in np.array_split(np.flatnonzero(size == d), 1 + len(size) // TILE):
                        if len(at):
                            cosines = unit(np.frombuffer(b"".join(vectors[i] for i in at), kind).reshape(-1, d)) @ shared.value[d].T
                            region[at] = cosines.argmax(1)
                            angle[at] = np.arccos(np.clip(cosines.max(1), -1, 1))
            sub = np.array([int.from_bytes(k[:4], "little") % subs for k in digests], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in ("class", "n", "vector")], *map(pa.array, (size, region, sub, angle))],
                ["class", "n", "vector", "size", "region", "sub", "angle"],
            )

    return classes.select("class", "n", "vector").mapInArrow(scan, "class binary, n long, vector binary, size long, region long, sub long, angle double")


def embedding_links(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, block_bytes: int = BLOCK_BYTES, pivots_at_most: int = PIVOTS,
) -> DataFrame:
    """Per row: id, ``n_links`` (other rows with cosine ``least`` or more), ``component_id`` (smallest id
    reachable by links) and ``kept`` (the row has that id)."""
    spark = df.sparkSession
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    narrow = isinstance(df.schema[vector_col].dataType, ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, FloatType)
    kind = "<f4" if narrow else "<f8"
    given = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("vector"))
    id_type = given.schema["id"].dataType.simpleString()
    link = np.arccos(least)

    rows = _classes(given, id_type, kind)
    classes = stored(
        rows.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("least_id"), F.first("vector").alias("vector"))
    )
    size = classes.agg(F.count("*").alias("n"), F.sum(F.octet_length("vector")).alias("bytes")).first()
    width = np.dtype(kind).itemsize

    # Regions: the pivots are the classes of lowest digest, as many as there are blocks at most.
    blocks = max(1, -(-(size.bytes or 0) // block_bytes))
    chosen = classes.select("class", "vector").orderBy("class").limit(int(min(pivots_at_most, blocks))).collect()
    by_size: dict[int, list[bytes]] = {}
    for r in chosen:
        by_size.setdefault(len(r.vector) // width, []).append(bytes(r.vector))
    pivots = {d: unit(np.frombuffer(b"".join(v), kind).reshape(-1, d)) for d, v in by_size.items()}
    n_regions = max(1, len(chosen))
    # Enough blocks for all tasks; a region's blocks hold block_bytes each on average.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(_assigned(classes, pivots, 1 << 20, kind))
    spread = dealt.groupBy("size", "region").agg(F.count("*").alias("n"), F.sum(F.octet_length("vector")).alias("bytes"), F.max("angle").alias("far"))
    regions = {}
    for r in spread.collect():  # one row per pivot, and one per other vector length
        parallel = -(-int(np.sqrt(2 * tasks)) // n_regions) if r.n > 2 * TILE else 1
        regions[r["size"], r.region] = (max(parallel, -(-r.bytes // block_bytes)), r.far)
    shared = spark.sparkContext.broadcast((pivots, regions))

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("size", "region", "sub")])
            at = batch.schema.get_field_index("sub")
            yield batch.set_column(at, "sub", pa.array([sub % shared.value[1][d, region][0] for d, region, sub in keys], pa.int64()))

    def pack(group: pa.Table) -> pa.Table:
        one = {c: group.column(c)[:1] for c in ("size", "region", "sub")}
        columns = [pa.array([group.column(c).to_pylist()], t) for c, t in (("class", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())), ("angle", pa.list_(pa.float64())))]
        vectors = pa.array([b"".join(group.column("vector").to_pylist())], pa.binary())
        return pa.table({**one, "classes": columns[0], "counts": columns[1], "angles": columns[2], "vectors": vectors})

    packed_as = "size long, region long, sub long, classes array<binary>, counts array<long>, angles array<double>, vectors binary"
    packed = dealt.mapInArrow(block_of, dealt.schema).groupBy("size", "region", "sub").applyInArrow(pack, packed_as)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block, with what can have partners there, to every pair of blocks it is in."""
        pivots_, regions_ = shared.value
        names = ["pair", "second", "size", "classes", "counts", "vectors"]
        for batch in batches:
            for row in range(batch.num_rows):
                d, region, sub = (batch.column(i)[row].as_py() for i in range(3))
                classes_, counts = batch.column(3)[row].values, batch.column(4)[row].values
                vectors, angles = np.frombuffer(batch.column(6)[row].as_buffer(), kind).reshape(-1, d), batch.column(5)[row].values.to_numpy()
                to = np.arccos(np.clip(unit(vectors) @ pivots_[d].T, -1, 1)) if d in pivots_ and region >= 0 else None
                for (size_, other), (subs, far) in regions_.items():
                    if size_ != d:
                        continue
                    keep = slice(None)
                    if other != region and to is not None and other >= 0:
                        keep = np.flatnonzero((to[:, other] <= far + link + 1e-6) & (to[:, other] - angles <= 2 * link + 1e-6))
                        if not len(keep):
                            continue
                    own = pa.array(np.arange(len(classes_))[keep])
                    for k in range(subs):
                        here, there = (region, sub), (other, k)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([f"{d}/{min(here, there)}/{max(here, there)}"]), pa.array([here > there]), pa.array([d], pa.int64()),
                                pa.array([classes_.take(own).to_pylist()], pa.list_(pa.binary())), pa.array([counts.take(own).to_pylist()], pa.list_(pa.int64())),
                                pa.array([vectors[keep].tobytes()], pa.binary()),
                            ],
                            names,
                        )

    def match(group: pa.Table) -> pa.Table:
        d, sides = group.column("size")[0].as_py(), {}
        for k in range(group.num_rows):
            sides[group.column("second")[k].as_py()] = (
                np.frombuffer(group.column("vectors")[k].as_py(), kind).reshape(-1, d), np.array(group.column("counts")[k].as_py(), np.int64), group.column("classes")[k].as_py(),
            )
        _, low, high = group.column("pair")[0].as_py().split("/")
        names, links, label = [], np.empty(0, np.int64), np.empty(0, np.int64)
        if low == high:
            x, n, names = sides[False]
            links, label = compare(x, None, n, None, least)
        elif len(sides) == 2:
            (x, n, names), (y, m, more) = sides[False], sides[True]
            names = names + more
            links, label = compare(x, y, n, m, least)
        found = np.flatnonzero(links)
        return pa.table(
            {
                "class": pa.array([names[i] for i in found], pa.binary()), "links": pa.array(links[found], pa.int64()),
                "root": pa.array([names[label[i]] for i in found], pa.binary()),
            }
        )

    pairs = packed.mapInArrow(meet, "pair string, second boolean, size long, classes array<binary>, counts array<long>, vectors binary")
    found = stored(pairs.groupBy("pair").applyInArrow(match, "class binary, links long, root binary"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "n", "least_id").join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = stored(named.select("class", "n", "least_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("root")))
    least_ids = named.groupBy("root").agg(F.min("least_id").alias("component"))
    answer = named.join(least_ids, "root").select("class", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component")
    with_class = rows.select("id", "class").join(answer, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component"))
    return with_class.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
