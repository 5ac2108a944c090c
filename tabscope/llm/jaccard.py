"""Exact Jaccard join of word n-gram sets in metric space.

Jaccard distance is a metric, and documents within ``1 - threshold`` of each other are linked.
Equal sets are one class; only classes are joined.

*Regions.* Nearly all documents are at distance 1 from any given pivot, where distances say
nothing, so first pivots are elected where documents meet. Each set is ordered by fixed-size
sketches of shingle and word frequencies, rare ones first; two linked sets must share ``k`` shingles
within their first ``n - ceil(threshold n) + k`` ones (``k`` up to ``SHARED``, fewer for small sets). So
a class with fewer shingles than that in common with all others together has no link, and leaves
before any text is read again: one common shingle is chance, many are not. The classes left that
share a shingle elect the one with the smallest key as pivot and enter its region: every link is
between a pivot and a member, or inside a region.

*Recursion.* Members' distances to the pivot are measured. If all are linked to it the region is
done, as they are one component. Else by the triangle inequality linked members closer to the
pivot than the nearest unlinked one by more than the link distance have no partner to find and
leave; the others are joined on, for links between different components. A region that fits a
task is finished there, pivot after pivot. A larger one draws about the square root of its size
as pivots, from outside its largest component; each member goes to the Voronoi region of its
nearest pivot (distance under ``1 - d``, ``d`` the link distance) and is replicated to all
pivots at most ``2 d`` further away; members at ``1 - 2 d`` or more from all pivots are a region
of their own. Two linked documents always meet: see ``split``. Pivots have been compared with
everything in their region and leave it, and a region that has become one component is done.
Where members lie too close together for regions to part them, as near copies of one text that are
not linked do, the region is dealt to blocks, and every two blocks are a region that fits a task.

Results are links between classes (a star or path per component, not all pairs) and, by
connected components, a component for each document.

Sets: words are runs without ASCII white space, A-Z in lower case; fewer words than ``gram`` are
one shingle; null or blank texts have the empty set and are linked with nothing. Repeated rows
are equal sets. Rows without an id take part, but give no component its name. Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACED, fixed_bitmap, grams, raw_texts, row_key, scrambled, source, steps, stored
from .components import components

#: Counters of the frequency sketch, of shingles and of words, and bits of the bitmap of texts to fetch.
SKETCH, WORD_SKETCH = 1 << 22, 1 << 20
SLOTS = 320
#: Bytes of text that a task reads at a time.
STEP = 1 << 20
#: Bytes up to which words are hashed together, eight bytes of each at a time; longer ones are hashed one by one.
LONG_WORD = 64
#: Shingles that prefixes of linked sets must share, where the sets are large enough.
SHARED = 16
FETCH_BITS = 1 << 23
#: Members, shingles and comparisons (members outside the largest component times shingles) of a region that one task finishes.
FITS, FITS_SHINGLES, FITS_WORK = 20_000, 2_000_000, 1_000_000_000
#: Members and shingles of a part that is measured against a region's pivots.
PART, PART_SHINGLES = 128, 1_000_000
ROOM = 1e-9


def words_of(raw: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text, in order; those of all texts are computed together."""
    sizes = np.array([len(t) + 1 for t in raw])
    joined = b" ".join([t.translate(SPACED) for t in raw]) + b" " * 8
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    # a word stands before each space that does not follow another
    before = np.concatenate([[-1], spaces[:-1]])
    own = spaces - before > 1
    starts, lengths = before[own] + 1, (spaces - before)[own] - 1
    lanes = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    found, at, done = scrambled(lengths), np.flatnonzero(lengths <= LONG_WORD), 0
    while len(at):
        lane, rest = lanes[starts[at] + done], lengths[at] - done
        short = rest < 8
        lane[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
        found[at] = scrambled(found[at] ^ lane)
        at, done = at[rest > 8], done + 8
    for i in np.flatnonzero(lengths > LONG_WORD):
        found[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : starts[i] + lengths[i]])
    ends = np.searchsorted(starts, np.cumsum(sizes))
    return np.split(found, ends[:-1])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    found = np.sort(values)
    return found[_first(found)]


def _first(ordered: np.ndarray) -> np.ndarray:
    """Whether a sorted value differs from the one before."""
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return first


def sets(raw: list[bytes], gram: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [distinct(x) for x in shingles(words_of(raw), gram)]


def shingles(words: list[np.ndarray], gram: int) -> list[np.ndarray]:
    """Shingle hashes of each text in order."""
    sizes = np.array(list(map(len, words)))
    joined = grams(np.concatenate(words), gram)
    out = []
    for first, n, own in zip(np.cumsum(sizes) - sizes, sizes, words):
        if n >= gram:
            out.append(joined[first : first + n - gram + 1])
        else:
            out.append(grams(own, n) + np.uint64(n) if n else own)
    return out


def ordered(own: np.ndarray, words: np.ndarray, gram: int, power: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's sorted distinct shingles, and these with rare ones first.

    The order is one for all texts: by the power of two of a shingle's counter (passages that
    many texts share stand out in it), then by how frequent its words are (few common words in
    a row may meet anywhere), then by hash."""
    at = np.argsort(own)
    found = own[at]
    first = _first(found)
    found, at = found[first], at[first]
    total = np.concatenate([[0], np.cumsum(rarity[(words & np.uint64(WORD_SKETCH - 1)).astype(np.int64)], dtype=np.int64)])
    width = min(gram, len(words))
    common = np.minimum(total[at + width] - total[at], 0xFFFFF)
    # the place in the order of hashes is the lower half of a number
    keys = power[(found & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.int64) << 52 | common << 32 | np.arange(len(found))
    keys.sort()
    return found, found[keys & 0xFFFFFFFF]


def class_key(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes()))))


def prefix_size(n: int, percent: int) -> int:
    """n - c + k shingles, c = ceil(percent n / 100), k = min(SHARED, c).

    Linked sets have at least c in common; the j-th of these in the order has c - j behind it, so it
    is among the first n - c + j. The first k are in the prefix."""
    least = -(-percent * n // 100)
    return n - least + min(SHARED, least)


def must_share(n: Column, percent: int) -> Column:
    """Prefix shingles that a set of ``n`` has in common with any set linked to it, which has ceil(percent n / 100) or more."""
    least = F.ceil(n * percent / 100)
    return F.least(F.lit(SHARED), F.ceil(least * percent / 100))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _profile(docs: DataFrame, kind: str, gram: int) -> DataFrame:
    """Per row: id, n, class, row key; and, as rows of slots, the counters of a task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, id_type = np.zeros(SKETCH + WORD_SKETCH, np.uint32), None
        names = ["id", "n", "class", "check", "row", "slot", "counters"]
        for step in steps(batches, "text", STEP):
            raw, ids = raw_texts(step, "text"), step.column(0).to_pylist()
            id_type = step.column(0).type
            words = words_of(raw)
            found = [distinct(x) for x in shingles(words, gram)]
            for part, x, size in ((counters[:SKETCH], found, SKETCH), (counters[SKETCH:], words, WORD_SKETCH)):
                np.add.at(part, (np.concatenate(x) & np.uint64(size - 1)).astype(np.int64), np.uint32(1))
            n = len(raw)
            yield pa.RecordBatch.from_arrays(
                [
                    step.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array([class_key(x) if len(x) else None for x in found], pa.int64()),
                    pa.array([xxhash.xxh3_64_intdigest(x.tobytes(), 1) >> 1 for x in found], pa.int64()),
                    pa.array([int.from_bytes(row_key(i, t)[:8], "big") >> 1 for i, t in zip(ids, raw)], pa.int64()),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ],
                names,
            )
        if id_type is not None:
            parts = counters.reshape(SLOTS, -1)
            none = pa.nulls(SLOTS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLOTS, id_type), none, none, none, none, pa.array(range(SLOTS), pa.int32()), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())], names
            )

    return docs.mapInArrow(scan, f"id {kind}, n long, class long, check long, row long, slot int, counters binary")


def _sketch(profile: DataFrame) -> np.ndarray:
    """Sum of the tasks' counters: SKETCH + WORD_SKETCH numbers, whatever the input."""

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(c), np.uint32).astype(np.uint64) for c in group.column("counters").to_pylist())
        return pa.table({"slot": group.column("slot")[:1], "part": pa.array([0]), "counters": pa.array([zstandard.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes())], pa.binary())})

    rows = profile.where("slot is not null").select("slot", (F.rand(1) * 64).cast("int").cast("long").alias("part"), "counters")
    # tasks' counters are added in 64 parts first
    once = rows.groupBy("slot", "part").applyInArrow(added, "slot int, part long, counters binary")
    out = np.zeros((SLOTS, (SKETCH + WORD_SKETCH) // SLOTS), np.uint32)
    for r in once.groupBy("slot").applyInArrow(added, "slot int, part long, counters binary").collect():
        out[r.slot] = np.frombuffer(zstandard.decompress(bytes(r.counters)), np.uint32)
    return out.ravel()


def _prefixes(docs: DataFrame, sketch: np.ndarray, gram: int, percent: int) -> DataFrame:
    """(shingle, class) for the prefix of each class, once per task and class."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counters = set(), shared.value
        rarity = (8 * np.log2(np.maximum(counters[SKETCH:], 1))).astype(np.int32)
        power = np.log2(np.maximum(counters[:SKETCH], 1)).astype(np.uint8)
        for step in steps(batches, "text", STEP):
            found, classes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            words = words_of(raw_texts(step, "text"))
            for own, text in zip(shingles(words, gram), words):
                if not len(own):
                    continue
                own_set, in_order = ordered(own, text, gram, power, rarity)
                if (key := class_key(own_set)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                first = in_order[: prefix_size(len(in_order), percent)]
                found.append(first)
                classes.append(np.full(len(first), key))
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(found)), _long(np.concatenate(classes))], ["shingle", "class"])

    return docs.mapInArrow(scan, "shingle long, class long")


def _sifted(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(shingle, class) of shingles that several classes have, without classes that share too few to be linked."""
    # rows are sorted once, by shingle; a class may come from several tasks
    own = Window.partitionBy("shingle")
    several = pairs.withColumns({"least": F.min("class").over(own), "most": F.max("class").over(own)}).where("least < most")
    rows = stored(several.select("shingle", "class").distinct())
    found = rows.groupBy("class").agg(F.count("*").alias("k")).join(sizes, "class").where(F.col("k") >= must_share(F.col("n"), percent))
    return stored(rows.join(found.select("class"), "class", "leftsemi"))


def _fetch(docs: DataFrame, rows: DataFrame, gram: int) -> DataFrame:
    """Compressed text and set size of the classes in ``rows`` (class, row key of one document)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(fixed_bitmap(rows, "row", FETCH_BITS)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value)
        for step in steps(batches, "text", STEP):
            raw, ids = raw_texts(step, "text"), step.column(0).to_pylist()
            key = np.array([int.from_bytes(row_key(i, t)[:8], "big") >> 1 for i, t in zip(ids, raw)], np.int64)
            own = np.flatnonzero(bits[key & (FETCH_BITS - 1)])
            if len(own):
                found = sets([raw[i] for i in own], gram)
                keep = [(i, x) for i, x in zip(own, found) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([class_key(x) for _, x in keep], pa.int64()), pa.array([len(x) for _, x in keep], pa.int64()),
                        pa.array([zstandard.compress(raw[i], 1) for i, _ in keep], pa.binary()),
                    ],
                    ["class", "n", "packed"],
                )

    return docs.mapInArrow(scan, "class long, n long, packed binary").join(rows.select("class"), "class", "leftsemi").dropDuplicates(["class"])


def _linked(common: np.ndarray, n: np.ndarray, m, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], gram: int) -> Iterator[tuple[list[dict], list[np.ndarray], bool]]:
    """Consecutive rows with equal ``keys`` and their sets; the flag marks the last group that
    a step completes. Sets of a step are built together, whatever the groups' sizes."""
    rows, found, at = [], [], None
    for step in steps(batches, "packed", 1 << 20):
        names = [n for n in step.schema.names if n != "packed"]
        done = []
        packed = step.column(step.schema.get_field_index("packed")).to_pylist()
        for row, own in zip(step.select(names).to_pylist(), sets([zstandard.decompress(x) for x in packed], gram)):
            key = [row[k] for k in keys]
            if key != at and rows:
                done.append((rows, found))
                rows, found = [], []
            at = key
            rows.append(row)
            found.append(own)
        for i, group in enumerate(done):
            yield *group, i + 1 == len(done)
    if rows:
        yield rows, found, True


def _finish(found: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between different components of a region, pivot after pivot, within windows.

    A pivot comes from outside the largest component left, is compared with all of other
    components that the triangle inequality leaves, and is done."""
    limit = 1 - percent / 100
    n = np.array(list(map(len, found)))
    left, links = np.ones(len(found), bool), []
    component = np.unique(component, return_inverse=True)[1]
    index, owner = np.concatenate(found), np.repeat(np.arange(len(found)), n)
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    known: list[np.ndarray] = []
    while True:
        names, size = np.unique(component[left], return_counts=True)
        if len(names) < 2:
            return links
        pivot = np.flatnonzero(left & (component != names[size.argmax()]))[0]
        left[pivot] = False
        others = left & (component != component[pivot])
        for distance in known:
            others &= ~(np.abs(distance - distance[pivot]) > limit + ROOM)
        others = np.flatnonzero(others)
        if not len(others):
            continue
        low, high = np.searchsorted(index, found[pivot], "left"), np.searchsorted(index, found[pivot], "right")
        at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
        common = np.bincount(owner[at], minlength=len(found))[others]
        if len(known) < 8:
            known.append(np.full(len(found), np.nan))
            known[-1][others] = 1 - common / (n[others] + n[pivot] - common)
            known[-1][pivot] = 0
        for i in others[_linked(common, n[others], n[pivot], percent)]:
            links.append((pivot, i))
            component[component == component[i]] = component[pivot]


class _Join:
    def __init__(self, packed: DataFrame, gram: int, percent: int, fits: int, fits_shingles: int) -> None:
        self.packed, self.gram, self.percent, self.fits, self.fits_shingles = packed, gram, percent, fits, fits_shingles
        self.limit = 1 - percent / 100
        self.partitions = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sized(self, regions: DataFrame) -> DataFrame:
        """Members and shingles of each region (region, class, n), beside its rows."""
        size = regions.groupBy("region").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
        return regions.join(size.where("members > 1"), "region")

    def open(self, regions: DataFrame, roots: DataFrame) -> DataFrame:
        """Regions of more than one component, with each member's component, ``minor`` for
        those outside the largest one, and the region's members, shingles and minor members."""
        rows = regions.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        rows = stored(rows.select("region", "class", "n", "root"))
        parts = rows.groupBy("region", "root").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        size = parts.groupBy("region").agg(
            F.sum("k").alias("members"), F.sum("n").alias("shingles"), F.max("k").alias("largest"), F.max(F.struct("k", "root"))["root"].alias("major")
        )
        size = size.withColumn("minors", F.col("members") - F.col("largest")).where("minors > 0").drop("largest")
        return stored(rows.join(size, "region").withColumn("minor", F.col("root") != F.col("major")).drop("major"))

    def measured(self, members: DataFrame, pivots: DataFrame) -> DataFrame:
        """(region, class, n, pivot, common, size) for members and pivots that share a shingle.

        ``members``: region, class, n, parts; ``pivots``: region, class, parts. A region's members
        are dealt to parts, its pivots go to each part."""
        gram, names = self.gram, ["region", "class", "n", "pivot", "common", "size"]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[list[int]] = [[] for _ in names]
            for rows, found, last in _groups(batches, ["region", "part"], gram):
                k = sum(r["pivot"] for r in rows)  # pivots come first
                if k:
                    index, owner = np.concatenate(found[:k]), np.repeat(np.arange(k), list(map(len, found[:k])))
                    order = np.argsort(index, kind="stable")
                    index, owner = index[order], owner[order]
                    for row, own in zip(rows[k:], found[k:]):
                        low, high = np.searchsorted(index, own, "left"), np.searchsorted(index, own, "right")
                        at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
                        common = np.bincount(owner[at], minlength=k)
                        for p in np.flatnonzero(common):
                            if rows[p]["class"] != row["class"]:
                                for column, value in zip(out, (row["region"], row["class"], len(own), rows[p]["class"], int(common[p]), len(found[p]))):
                                    column.append(value)
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)
                    out = [[] for _ in names]

        parts = members.select("region", "class", F.pmod(F.xxhash64("class"), F.col("parts")).alias("part"), F.lit(False).alias("pivot"))
        copies = pivots.select("region", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("pivot"))
        rows = parts.unionAll(copies).join(self.packed.select("class", "packed"), "class")
        schema = "region long, class long, n long, pivot long, common long, size long"
        dealt = rows.repartition(self.partitions, "region", "part").sortWithinPartitions("region", "part", F.col("pivot").desc(), "class")
        found = dealt.mapInArrow(measure, schema)
        return found.withColumn("near", F.expr(f"100 * common >= {self.percent} * (n + size - common)")).withColumn("distance", F.expr("1 - common / (n + size - common)"))

    def parts(self):
        return F.greatest(F.lit(1), F.ceil(F.col("members") / PART), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("long")

    def windows(self, measured: DataFrame) -> DataFrame:
        """Members of each pivot's region that may have links yet to be found."""
        nearest = measured.groupBy("region").agg(F.min(F.when(~F.col("near"), F.col("distance"))).alias("least")).where("least is not null")
        kept = measured.join(nearest, "region").where(~F.col("near") | (F.col("distance") >= F.col("least") - self.limit - ROOM))
        return kept.select("region", "class", "n")

    def finished(self, regions: DataFrame) -> DataFrame:
        """Links inside regions that fit a task."""
        gram, percent = self.gram, self.percent

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            for rows, found, last in _groups(batches, ["region"], gram):
                for i, j in _finish(found, np.array([r["root"] for r in rows]), percent):
                    a.append(rows[i]["class"])
                    b.append(rows[j]["class"])
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                    a, b = [], []

        rows = regions.select("region", "class", "root").join(self.packed.select("class", "packed"), "class")
        return rows.repartition(self.partitions, "region").sortWithinPartitions("region", "class").mapInArrow(finish, "a long, b long")

    def split(self, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links with, and regions of, pivots drawn from larger regions.

        Pivots are minor members. Let x, y be linked (at most d apart), h(.) the distance to the
        nearest pivot. If h(x) is 1 - d or more, h(y) is 1 - 2 d or more: both are in the far
        region. Else the pivot p nearest to x is at most h(x) + d < 1 from y, hence measured, and
        at most h(y) + 2 d: y is sent to p's region too. A region whose members lie so close
        that this would more than double it leaves in blocks, without its pivots: more pivots would
        not part it either."""
        d = self.limit
        every = F.greatest(F.lit(1), F.ceil(F.col("minors") / F.ceil(F.sqrt("members")))).cast("long")
        first = regions.where("minor").groupBy("region").agg(F.min("class").alias("first"))
        drawn = (F.pmod(F.xxhash64("class", "region"), every) == 0) | (F.col("class") == F.col("first"))
        marked = regions.join(first, "region").withColumn("parts", self.parts()).withColumn("is_pivot", F.col("minor") & drawn)
        marked = stored(marked.withColumn("blocks", self.blocks()).select("region", "class", "n", "members", "parts", "blocks", "is_pivot"))
        pivots = marked.where("is_pivot").select("region", "class", "parts")
        # pivots are measured against each other as well
        measured = stored(self.measured(marked.select("region", "class", "n", "parts"), pivots))
        links = measured.where("near").select(F.col("pivot").alias("a"), F.col("class").alias("b"))
        rest = marked.where("not is_pivot").select("region", "class", "n", "members", "blocks")
        nearest = measured.groupBy("region", "class").agg(F.min("distance").alias("h"))
        far = rest.join(nearest, ["region", "class"], "left").where(F.coalesce("h", F.lit(1.0)) >= 1 - 2 * d - ROOM)
        close = (
            measured.join(rest.select("region", "class"), ["region", "class"])
            .join(nearest.where(F.col("h") < 1 - d), ["region", "class"]).where(F.col("distance") <= F.col("h") + 2 * d + ROOM)
        )
        copies = far.select("region").unionAll(close.select("region")).groupBy("region").agg(F.count("*").alias("copies"))
        whole = stored(rest.groupBy("region").agg(F.first("members").alias("members")).join(copies, "region", "left").where("coalesce(copies, 0) > 2 * members").select("region"))
        far = far.join(whole, "region", "leftanti").select(F.xxhash64("region", F.lit("far")).alias("region"), "class", "n")
        close = close.join(whole, "region", "leftanti").withColumn("region", F.xxhash64("region", "pivot"))
        return links, self.windows(close).unionAll(far).unionAll(self.in_blocks(rest.join(whole, "region", "leftsemi")))

    def blocks(self) -> Column:
        """Blocks of which two fit a task, with room for uneven ones."""
        work = F.sqrt(F.col("minors") * F.col("shingles") / FITS_WORK)
        return F.ceil(3 * F.greatest(F.col("members") / self.fits, F.col("shingles") / self.fits_shingles, work)).cast("long")

    def in_blocks(self, rows: DataFrame) -> DataFrame:
        """A region for every two blocks: any two members are together in one."""
        own = rows.withColumn("block", F.pmod(F.xxhash64("class", "region"), F.col("blocks")))
        both = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block or blocks = 1")
        pair = F.xxhash64("region", F.lit("blocks"), F.least("block", "other"), F.greatest("block", "other"))
        return both.select(pair.alias("region"), "class", "n")


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = 5, percent: int = 75,
    fits: int = FITS, fits_shingles: int = FITS_SHINGLES,
) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id linked to it, directly or not)."""
    docs, kind = source(df, id_col, text_col)
    profile = stored(_profile(docs, kind, gram))
    rows = profile.where("slot is null")
    classes = rows.where("n > 0").groupBy("class").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.min("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    if classes.where("low <> high").limit(1).count():
        raise ValueError("two different sets have the same 64-bit key")
    pairs = _prefixes(docs, _sketch(profile), gram, percent)
    met = _sifted(pairs, classes.select("class", "n"), percent)
    elected = met.groupBy("shingle").agg(F.min("class").alias("pivot"), F.count("*").alias("k")).where("k > 1")
    # one row per member and pivot, however many shingles they share
    star = met.join(elected, "shingle").where("class <> pivot").groupBy("class", F.col("pivot").alias("region")).agg((F.max("k") > 2).alias("meets"))
    # where no third class has the shingle only the two can be linked, if their sizes allow it
    sizes = classes.select("class", "n")
    star = star.join(sizes, "class").join(sizes.select(F.col("class").alias("region"), F.col("n").alias("m")), "region")
    star = stored(star.where(F.col("meets") | (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))).select("class", "region", "meets"))
    wanted = star.select("class").unionAll(star.select("region")).distinct().join(classes.select("class", "row"), "class")
    packed = stored(_fetch(docs, wanted, gram))
    join = _Join(packed, gram, percent, fits, fits_shingles)

    members = join.sized(star.select("class", "region").join(packed.select("class", "n"), "class").unionByName(star.select("region").distinct().select("region", F.col("region").alias("class")).join(packed.select("class", "n"), "class")))
    members = stored(members.withColumn("parts", join.parts()).select("region", "class", "n", "parts"))
    measured = stored(join.measured(members.where("class <> region"), members.where("class = region").select("region", "class", "parts")))
    edges = measured.where("near").select(F.col("pivot").alias("a"), F.col("class").alias("b"))
    inside = measured.join(star.where("meets").select("class", "region"), ["class", "region"], "leftsemi")
    roots = components(edges)
    regions = join.open(join.windows(inside), roots)
    small = (F.col("members") <= fits) & (F.col("shingles") <= fits_shingles) & (F.col("minors") * F.col("shingles") <= FITS_WORK)
    fit = small | (F.col("members") <= 2)
    while regions.limit(1).count():
        links, rest = join.finished(regions.where(fit)), None
        large = regions.where(~fit)
        if large.limit(1).count():
            more, rest = join.split(large)
            links = links.unionAll(more)
        # components found so far are stars
        roots = components(links.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if rest is None:
            break
        regions = join.open(rest.distinct(), roots)
    named = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "root").select("class", "component_id")
    linked = rows.where("n > 0").select("id", "n", "class").join(by_class, "class").select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
