"""N-gram Jaccard join by vertical partitioning.

A text is the set of its n-grams; equal sets are one node. All n-grams have one
global order, rare ones first, which is cut into fragments of equal mass. Nodes
meet on n-grams at the front of their own order (two similar sets must share
one there), in groups of nodes of about equal size. For a pair that met, every
fragment counts the overlap of the two sets' segments there, and the counts are
summed per pair; the sum decides.

Only pairs that can still join two classes are counted: members of a group meet
a few hubs, whose number doubles twice from round to round until the group is
one class or each of its members was a hub. So a group of copies costs about
one pair a member, and no link between different classes is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.collocations import Bitmap, _packs, _planes, _slot, _values
from tidegrid.llm.common import Rolling, bounded_batches, components, materialise, mix, release, slices, text_bytes, word_spans

SHINGLE = 3
SIMILAR = 90
FRAGMENTS = 4
#: Cells of a node's shape: the sizes of its shares of the hash range, which bound an overlap before it is counted.
SHAPE = 128
HUBS = 1
PAIRS_A_NODE = 16
#: Members that one run of a hub is counted with.
RUN = 64
SEGMENT = 1 << 16
#: The frequency table has a cell for 256 bytes of text, between these sizes (one byte a cell when it is sent).
LEAST_CELLS, MOST_CELLS = SEGMENT, 1 << 26
#: Slots of the bitmaps of shared n-grams and of nodes that met (16 MB).
SLOTS = 1 << 27
PART_KEYS = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- sets -----------------------------------------------------------------------


def _sets(column: pa.Array, shingle: int, rolling: Rolling) -> Iterator[list[np.ndarray]]:
    """The sorted distinct n-gram hashes of each text, for a slice of texts at a time."""
    data, at = text_bytes(column)
    for a, b in slices(at):
        part, own = _LOWER[data[at[a] : at[b]]], at[a : b + 1] - at[a]
        start, end, first = word_spans(part, own)
        words = rolling.words(part, start, end)
        place, h = rolling.windows(words, first, shingle)
        cut = np.searchsorted(place, first)
        n = np.diff(first)
        short = np.where((n > 0) & (n < shingle))[0]
        whole = dict(zip(short.tolist(), rolling.spans(words, first[short], first[short] + n[short]) if len(short) else [], strict=True))
        yield [np.array([whole[k]], np.uint64) if k in whole else np.unique(h[cut[k] : cut[k + 1]]) for k in range(b - a)]


def _digest(own: np.ndarray) -> tuple[int, int]:
    """Names a set; zero for the empty one."""
    if not len(own):
        return 0, 0
    x = xxhash.xxh3_128_intdigest(own.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _marked(docs: DataFrame, shingle: int, cells: int) -> DataFrame:
    """For each document doc_id, hi, lo (the set's name) and n (its size); and each task's counts by cell of the frequency table, as rows
    with a segment."""
    shift = np.uint64(64 - int(math.log2(cells)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "hi", "lo", "n", "segment", "many", "steps", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, table, doc_type = Rolling(21), np.zeros(cells, np.uint32), None
        for batch in batches:
            doc_type, ids, k = batch.column("doc_id").type, batch.column("doc_id"), 0
            for sets in _sets(batch.column("text"), shingle, rolling):
                for own in sets:
                    np.add.at(table, (own >> shift).astype(np.int64), 1)
                hi, lo = zip(*map(_digest, sets), strict=True)
                m = len(sets)
                columns = [ids.slice(k, m), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array([len(own) for own in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())]], names)
                k += m
        if doc_type is None:
            return
        full = np.flatnonzero(table)
        cut = np.searchsorted(full, np.arange(0, cells + 1, SEGMENT))
        for segment in np.flatnonzero(np.diff(cut)):
            at = full[cut[segment] : cut[segment + 1]]
            columns = [pa.array([int(segment)], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([_planes(np.diff(at, prepend=segment * SEGMENT))], pa.binary()), pa.array([_planes(table[at])], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, doc_type), *[pa.nulls(1, pa.int64())] * 3, *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, hi long, lo long, n long, segment int, many long, steps binary, counts binary")


class Order:
    """The global order of n-grams: by frequency class, then by hash; and the fragments it is cut into."""

    def __init__(self, classes: np.ndarray, mass: np.ndarray, fragments: int):
        self.classes, self.fragments = classes, fragments
        self.shift = np.uint64(64 - int(math.log2(len(classes))))
        self.before = np.concatenate([[0.0], np.cumsum(mass)]) / max(float(mass.sum()), 1.0)

    def of(self, own: np.ndarray) -> np.ndarray:
        return self.classes[(own >> self.shift).astype(np.int64)]

    def sorted(self, own: np.ndarray) -> np.ndarray:
        return own[np.lexsort((own, self.of(own)))]

    def fragment(self, own: np.ndarray) -> np.ndarray:
        """Rises along the order."""
        kind = self.of(own)
        at = self.before[kind] + (self.before[kind + 1] - self.before[kind]) * (own.astype(np.float64) / 2.0**64)
        return np.minimum((at * self.fragments).astype(np.int64), self.fragments - 1)


def _order(marks: DataFrame, cells: int, fragments: int) -> Order:
    """Frequency classes (powers of two) by cell, over all documents."""

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(SEGMENT, np.int64)
        for row in table.select(["many", "steps", "counts"]).to_pylist():
            total[np.cumsum(_values(row["steps"], row["many"]))] += _values(row["counts"], row["many"])
        kind = np.zeros(SEGMENT, np.uint8)
        kind[total > 0] = np.floor(np.log2(total[total > 0])).astype(np.uint8)
        return pa.table({"segment": table.column("segment").slice(0, 1), "kinds": pa.array([kind.tobytes()], pa.binary()), "mass": pa.array([np.bincount(kind, weights=total, minlength=64).tolist()], pa.list_(pa.float64()))})

    found = marks.filter("segment IS NOT NULL").select("segment", "many", "steps", "counts").groupBy("segment").applyInArrow(merge, "segment int, kinds binary, mass array<double>")
    classes, mass = np.zeros(cells, np.uint8), np.zeros(64)
    for row in found.toLocalIterator():
        classes[row["segment"] * SEGMENT :][:SEGMENT] = np.frombuffer(row["kinds"], np.uint8)
        mass += row["mass"]
    release()
    return Order(classes, mass, fragments)


def needed(n: int, similar: int) -> int:
    """Least overlap with any set that is similar to one of ``n``."""
    return -(-similar * n // 100)


def _nodes(docs: DataFrame, shingle: int, similar: int, order) -> DataFrame:
    """node, hi, lo, n, front and shape: the n-grams at the front of the node's order, of which a similar set has one in its own front;
    the number of n-grams in each of ``SHAPE`` equal parts of the hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, seen = Rolling(21), set()
        for batch in batches:
            for sets in _sets(batch.column("text"), shingle, rolling):
                rows = []
                for own in sets:
                    name = _digest(own)
                    if len(own) and name not in seen:
                        seen.add(name)
                        shape = np.bincount((own >> np.uint64(32)).astype(np.int64) * SHAPE >> 32, minlength=SHAPE)
                        rows.append((*name, len(own), order.value.sorted(own)[: len(own) - needed(len(own), similar) + 1].view(np.int64), shape))
                if rows:
                    hi, lo, n, front, shape = zip(*rows, strict=True)
                    shapes = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * SHAPE, pa.int32()), pa.array(np.concatenate(shape).astype(np.int32)))
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in front])])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(front)))
                    yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), lists, shapes], ["hi", "lo", "n", "front", "shape"])

    found = docs.select("text").mapInArrow(run, "hi long, lo long, n long, front array<long>, shape array<int>")
    return materialise(found.dropDuplicates(["hi", "lo"]).withColumn("node", F.monotonically_increasing_id()), "nodes")


# --- meeting ----------------------------------------------------------------------


def _keys(batch: pa.RecordBatch, similar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, row and position of every meeting of a node: with its front among nodes of its own class of sizes, and with a shorter front
    (what a larger partner's share asks of the smaller set) among those of the next one."""
    n = batch.column("n").to_numpy()
    lists = batch.column("front")
    ends = np.asarray(lists.offsets)
    token = np.asarray(lists.values)[ends[0] : ends[-1]].view(np.uint64)
    many = np.diff(ends)
    row = np.repeat(np.arange(len(n)), many)
    place = np.arange(len(token)) - np.repeat(ends[:-1] - ends[0], many)
    # slightly wider classes than the ratio asks for, so that rounding never parts similar sizes by two
    size = np.floor(np.log(n) / (math.log(100 / similar) + 1e-6)).astype(np.uint64)
    small = n - -(-2 * similar * n // (100 + similar)) + 1
    both = np.concatenate([np.arange(len(token)), np.flatnonzero(place < small[row])])
    up = np.concatenate([np.zeros(len(token), np.uint64), np.ones(len(both) - len(token), np.uint64)])
    return mix(token[both] ^ mix(size[row[both]] + up + np.uint64(1))), row[both], place[both]


def _bitmap(rows: DataFrame, parts: int, at_least: int, keys: int) -> Bitmap:
    """Slots of keys with ``at_least`` entries; ``rows`` are packed keys. There are 32 slots a key, up to ``SLOTS``."""
    slots = max(min(SLOTS, 32 * keys) // parts // 64 * 64, 64)

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(slots, np.uint16)
        for row in table.select(["size", "keys", "counts"]).to_pylist():
            at = _slot(np.cumsum(_values(row["keys"], row["size"])).astype(np.uint64), slots)
            np.add.at(total, at, np.minimum(_values(row["counts"], row["size"]), at_least).astype(np.uint16))
            np.minimum(total, at_least, out=total)
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(total >= at_least, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros((parts, slots // 8), np.uint8)
    for row in rows.groupBy("part").applyInArrow(merge, "part int, bits binary").toLocalIterator():
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    release()
    return Bitmap(parts, slots, bits.reshape(-1))


_PACKED = "part int, mass long, size long, keys binary, counts binary"


def _met(nodes: DataFrame, similar: int) -> DataFrame:
    """key, node, n, pos: the meetings of nodes with others."""
    spark = nodes.sparkSession
    keys = nodes.agg(F.sum(F.size("front"))).first()[0] or 0
    parts = min(max(8, -(-2 * keys // PART_KEYS)), SLOTS // 64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(_keys(batch, similar)[0], return_counts=True)
            if len(found):
                yield _packs(found, n, parts)

    shared = spark.sparkContext.broadcast(_bitmap(nodes.select("n", "front").mapInArrow(pack, _PACKED), parts, 2, 2 * keys))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row, place = _keys(batch, similar)
            stay = shared.value.has(key)
            key, row, place = key[stay], row[stay], place[stay]
            node, n = batch.column("node").to_numpy()[row], batch.column("n").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(n), pa.array(place)], ["key", "node", "n", "pos"])

    met = materialise(nodes.select("node", "n", "front").mapInArrow(keep, "key long, node long, n long, pos long"), "met")
    shared.destroy()
    return met


def _segments(docs: DataFrame, named: DataFrame, shingle: int, order) -> DataFrame:
    """node, fragment, own: the n-grams of each node in each fragment of the order. ``named`` has (node, hi, lo)."""
    spark = docs.sparkSession
    parts = 64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(batch.column("lo").to_numpy().view(np.uint64), return_counts=True)
            if len(found):
                yield _packs(found, n, parts)

    asked = spark.sparkContext.broadcast(_bitmap(named.select("lo").mapInArrow(pack, _PACKED), parts, 1, named.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, seen = Rolling(21), set()
        for batch in batches:
            for sets in _sets(batch.column("text"), shingle, rolling):
                rows = []
                names = [_digest(own) for own in sets]
                want = asked.value.has(np.array([lo for _, lo in names], np.int64).view(np.uint64))
                for k in np.flatnonzero(want):
                    if names[k] in seen or not len(sets[k]):
                        continue
                    seen.add(names[k])
                    part = order.value.fragment(sets[k])
                    rows += [(*names[k], int(f), sets[k][part == f].tobytes()) for f in np.unique(part)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], ["hi", "lo", "fragment", "own"])

    found = docs.select("text").mapInArrow(run, "hi long, lo long, fragment int, own binary")
    # copies in other tasks arrive in the same partition as the join's, so they cost no shuffle of their own
    out = materialise(found.join(named, ["hi", "lo"]).dropDuplicates(["hi", "lo", "fragment"]).select("node", "fragment", "own"), "segments")
    asked.destroy()
    return out


# --- counting ---------------------------------------------------------------------


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """a, b and their overlap in each fragment. Behind a hub's segment come those of the members that it is paired with, in runs."""
    sizes = pairs.groupBy("b").agg(F.count("*").alias("members"))
    runs = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / RUN)).alias("run"))
    members = runs.join(segments.withColumnRenamed("node", "a"), "a").select("b", "run", "fragment", "a", "own")
    hubs = runs.select("b", "run").distinct().join(segments.withColumnRenamed("node", "b"), "b").select("b", "run", "fragment", F.lit(None).cast("long").alias("a"), "own")
    by = ["b", "run", "fragment"]
    both = members.unionByName(hubs).repartition(*by).sortWithinPartitions(*by, F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hub = None, None
        for batch in batches:
            out = []
            for b, turn, fragment, a, own in zip(*[batch.column(c).to_pylist() for c in (*by, "a", "own")], strict=True):
                grams = np.frombuffer(own, np.uint64)
                if a is None:
                    current, hub = (b, turn, fragment), grams
                elif current == (b, turn, fragment):
                    at = np.searchsorted(hub, grams)
                    shared = int((hub[np.minimum(at, len(hub) - 1)] == grams).sum())
                    if shared:
                        out.append((a, b, shared))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["a", "b", "overlap"])

    return both.mapInArrow(run, "a long, b long, overlap long")


def _linked(pairs: DataFrame, segments: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose overlaps, summed over fragments, reach the similarity."""
    total = _overlaps(pairs, segments).groupBy("a", "b").agg(F.sum("overlap").alias("o"))
    return pairs.join(total, ["a", "b"]).filter(100 * F.col("o") >= similar * (F.col("n_a") + F.col("n_b") - F.col("o"))).select("a", "b")


def _possible(pairs: DataFrame, shapes: DataFrame, similar: int) -> DataFrame:
    """Pairs whose shapes allow the overlap that they need."""
    both = pairs.join(shapes.select(F.col("node").alias("a"), F.col("shape").alias("sa")), "a").join(shapes.select(F.col("node").alias("b"), F.col("shape").alias("sb")), "b")
    most = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda t, x: t + x)
    return both.filter((100 + similar) * most >= similar * (F.col("n_a") + F.col("n_b"))).drop("sa", "sb")


def _classes(met: DataFrame, shapes: DataFrame, segments_of: Callable[[DataFrame], DataFrame], similar: int) -> DataFrame:
    """node, component for all nodes that met. Only nodes of a round's pairs are cut into segments."""
    labels = materialise(met.select("node").distinct().withColumn("component", F.col("node")), "labels")
    total = labels.count()
    apart = met.withColumn("component", F.col("node"))
    tested, hubs = None, HUBS
    while True:
        groups = apart.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key", "members")
        live = materialise(apart.join(groups, "key"), "live")
        most, pairs_left = live.agg(F.max("members"), F.sum((F.col("members") - 1) / 2)).first()
        if not most:
            return labels
        last = hubs >= most or pairs_left <= PAIRS_A_NODE * total
        front = live if last else live.withColumn("turn", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("node", F.lit(hubs)), "node"))).filter(F.col("turn") <= hubs)
        front = front.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("component").alias("of"))
        pairs = live.join(front, "key").filter("component <> of")
        share = similar * (F.col("n") + F.col("n_b"))
        pairs = pairs.filter((100 * F.col("n") >= similar * F.col("n_b")) & (100 * F.col("n_b") >= similar * F.col("n")))
        pairs = pairs.filter((100 + similar) * F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) >= share)
        # one row a pair, whichever of the two was the hub
        pairs = pairs.groupBy(F.least("node", "b").alias("x"), F.greatest("node", "b").alias("y")).agg(F.min(F.struct("b", "n_b", F.col("node").alias("a"), F.col("n").alias("n_a"))).alias("p")).select("x", "y", "p.a", "p.b", "p.n_a", "p.n_b")
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = materialise(pairs, "met-pairs")
        tested = pairs.select("x", "y") if tested is None else tested.unionByName(pairs.select("x", "y"))
        pairs = materialise(_possible(pairs, shapes, similar), "pairs")
        segments = segments_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        links = materialise(_linked(pairs.drop("x", "y"), segments, similar), "links")
        edges = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        moved = components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("into"))
        labels = materialise(labels.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "labels")
        if last:
            return labels
        # with all members but one as hubs, all pairs of a group were counted
        apart = live.filter(F.col("members") - 1 > hubs).drop("members").join(moved, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into")
        hubs *= 4


def join(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for each row of (doc_id, text).

    Two texts link when their sets of ``shingle``-word n-grams (ASCII lower case;
    a shorter text is one n-gram) have a Jaccard similarity of ``similar``
    percent. Null and wordless texts have the empty set, link with nothing and
    name themselves. A null id names a class only if it has no other id. Repeated
    rows stay repeated; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << min(max(math.ceil(math.log2(max(size / 256, 1))), int(math.log2(LEAST_CELLS))), int(math.log2(MOST_CELLS)))
    marks = materialise(_marked(docs, shingle, cells), "marks")
    rows = marks.filter("segment IS NULL").select("doc_id", "hi", "lo", "n")
    order = spark.sparkContext.broadcast(_order(marks, cells, fragments))
    nodes = _nodes(docs, shingle, similar, order)
    met = _met(nodes, similar)

    def segments_of(wanted: DataFrame) -> DataFrame:
        return _segments(docs, materialise(nodes.join(wanted, "node", "left_semi").select("node", "hi", "lo"), "wanted"), shingle, order)

    labels = _classes(met, nodes.select("node", "shape"), segments_of, similar)
    known = nodes.select("node", "hi", "lo").join(labels, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    least = rows.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("least")).join(known, ["hi", "lo"])
    roots = least.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = least.join(roots, "component").select("hi", "lo", "component_id")
    found = rows.join(classes, ["hi", "lo"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
