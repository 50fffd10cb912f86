"""Near-duplicate documents by SimHash fingerprints and a Gray-order hierarchical index.

Equal fingerprints are one node, so copies cost nothing. Fingerprints within
``k`` bits agree on at least one of k + 1 blocks of bits (pigeonhole); nodes
meet only in groups that agree on a block. Such a group is sorted by Gray rank
and indexed as a tree: a node factors out the bits all its members share and
its children keep only what they share beyond that. A search adds up
differences on the way down and prunes whole groups once they exceed ``k``. A
group gives a star of links for each local component, never its pairs. Groups
above ``group_rows`` are split again: bits outside the block are cut into k + 1
finer blocks, of which one must agree as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import IN_WORD, bounded_batches, components, local_labels, materialise, slices, text_bytes, without, word_spans

SHINGLE = 3
SEED = 42
MAX_BITS = 2
FANOUT = 16
GROUP_ROWS = 4096
SHARD_NODES = 100_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANES = np.array([sum((b >> j & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


# --- fingerprints -----------------------------------------------------------


def _shingle_hashes(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and the index of each text's first one."""
    start, end, first = word_spans(data, at)
    inside, gap = IN_WORD[data], np.zeros(len(data), bool)
    gap[end[end < len(data)]] = True  # one separator behind each word
    keep = inside | gap
    new = np.concatenate([[0], np.cumsum(keep)])
    text = np.where(inside, _LOWER[data], np.uint8(0x20))[keep].tobytes()
    words = np.diff(first)
    count = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    word = np.repeat(first[:-1], count) + np.arange(begin[-1]) - np.repeat(begin[:-1], count)
    last = np.minimum(word + shingle, np.repeat(first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    left, right = new[start[word]].tolist(), new[end[last] - 1] + 1
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(left, right.tolist(), strict=True)), np.uint64, len(left)), begin


def _majority(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of each text's hashes. Eight counters share a word, for runs of at most 255 hashes."""
    n = np.diff(begin)
    runs = -(-n // 255)
    run_begin = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(len(n), np.uint64)
    if not len(hashes):
        return out
    edge = np.repeat(begin[:-1], runs) + 255 * (np.arange(run_begin[-1]) - np.repeat(run_begin[:-1], runs))
    full = np.flatnonzero(n)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        counts = np.add.reduceat(_LANES[octets[:, k]], edge).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(counts, run_begin[full], axis=0, dtype=np.int64)
        bits = 2 * counts > n[full, None]
        out[full] |= (bits.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``fingerprint`` (64 bits as a long). Null and wordless texts get 0."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, ["fingerprint"])
    others = [c for c in docs.columns if c != text]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(text))
            parts = [_majority(*_shingle_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a], shingle)) for a, b in slices(at)]
            bits = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(bits.view(np.int64))], [*others, "fingerprint"])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(hashed, StructType([*[docs.schema[c] for c in others], StructField("fingerprint", LongType())]))


# --- the index ----------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, where neighbours differ in one bit."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Tree over codes in Gray order. ``levels`` run from the root down to single codes: (mask, pattern) of the bits that a
    node shares beyond its parent."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        ones = zeros = codes[self.order]
        zeros = ~zeros
        stack = [(ones, zeros)]  # bits set in all members, bits clear in all members
        while len(stack[-1][0]) > 1:
            edge = np.arange(0, len(stack[-1][0]), FANOUT)
            stack.append((np.bitwise_and.reduceat(stack[-1][0], edge), np.bitwise_and.reduceat(stack[-1][1], edge)))
        self.levels, above = [], None
        for ones, zeros in reversed(stack):
            shared = ones | zeros
            beyond = shared if above is None else shared & ~np.repeat(above, FANOUT)[: len(shared)]
            self.levels.append((beyond, ones & beyond))
            above = shared

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code) of indices whose codes differ in at most ``k`` bits."""
        query, node, sum_ = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for depth, (mask, pattern) in enumerate(self.levels):
            if depth:
                width = np.minimum(FANOUT, len(mask) - node * FANOUT)
                step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                query, sum_, node = np.repeat(query, width), np.repeat(sum_, width), np.repeat(node * FANOUT, width) + step
            sum_ = sum_ + np.bitwise_count((queries[query] & mask[node]) ^ pattern[node])
            near = sum_ <= k
            query, node, sum_ = query[near], node[near], sum_[near]
        return query, self.order[node]


def group_links(codes: np.ndarray, k: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, representative) that connect all codes within ``k`` bits of each other: one star per component."""
    n = len(codes)
    if n <= FANOUT:
        left, right = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= k)
        label = local_labels(n, left, right)
    else:
        index, label = GrayIndex(codes), np.arange(n)
        for a in range(0, n, block):
            left, right = index.search(codes[a : a + block], k)
            label = local_labels(n, left + a, right, label)
    linked = np.flatnonzero(label != np.arange(n))
    return codes[linked], codes[label[linked]]


def _blocks(bits: int, parts: int, offset: int = 0) -> list[tuple[int, int]]:
    """``bits`` cut into ``parts`` blocks: (shift, width)."""
    edge = [offset + bits * i // parts for i in range(parts + 1)]
    return list(zip(edge[:-1], np.diff(edge).tolist(), strict=True))


def _key(column, blocks):
    """The bits of some blocks, side by side, as a long."""
    out, at = F.lit(0).cast("long"), 0
    for shift, width in blocks:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out


def _rest(shift: int, width: int, parts: int) -> list[list[tuple[int, int]]]:
    """The bits outside a block, cut into ``parts``; each part is a list of runs of bits."""
    places = [b for b in range(64) if not shift <= b < shift + width]
    edge = [len(places) * i // parts for i in range(parts + 1)]
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        runs: list[tuple[int, int]] = []
        for p in places[a:b]:
            if runs and runs[-1][0] + runs[-1][1] == p:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((p, 1))
        out.append(runs)
    return out


def links(nodes: DataFrame, k: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``nodes`` that join everything within ``k`` bits."""
    f = F.col("fingerprint")
    blocks = _blocks(64, k + 1)
    keyed = nodes.select(f, F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _key(f, [b]).alias("v")) for j, b in enumerate(blocks)])).alias("g")).select("fingerprint", "g.*")
    sizes = keyed.groupBy("j", "v").agg(F.count("*").alias("size")).filter("size > 1")
    met = keyed.join(sizes, ["j", "v"]).select("fingerprint", "j", "v", "size")
    finer = [F.struct(F.lit(j * (k + 1) + i + k + 1).alias("j"), F.xxhash64(F.lit(j), _key(f, [b]), _key(f, runs)).alias("v")) for j, b in enumerate(blocks) for i, runs in enumerate(_rest(*b, k + 1))]
    split = F.when(F.col("size") <= group_rows, F.array(F.struct("j", "v")))
    for j in range(k + 1):
        split = split.when(F.col("j") == j, F.array(*finer[j * (k + 1) : (j + 1) * (k + 1)]))
    total = nodes.count()
    shards = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-total * (k + 1) // SHARD_NODES))
    grouped = met.select("fingerprint", F.explode(split).alias("g")).select("fingerprint", "g.*").withColumn("shard", F.pmod(F.xxhash64("j", "v"), F.lit(shards)))

    def search(table: pa.Table) -> pa.Table:
        code = table.column("fingerprint").to_numpy().view(np.uint64)
        j, v = table.column("j").to_numpy(), table.column("v").to_numpy()
        order = np.lexsort((v, j))
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(j[order]) != 0) | (np.diff(v[order]) != 0)]))
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
            if b - a > 1:
                x, y = group_links(code[order[a:b]], k)
                left.append(x)
                right.append(y)
        return pa.table({"a": np.concatenate(left).view(np.int64), "b": np.concatenate(right).view(np.int64)})

    return grouped.groupBy("shard").applyInArrow(search, "a long, b long")


def classes(marked: DataFrame, k: int = MAX_BITS, doc_id: str = "doc_id") -> DataFrame:
    """(fingerprint, component_id) for each distinct fingerprint of ``marked`` (doc_id, fingerprint): the smallest doc_id reachable."""
    nodes = materialise(marked.groupBy("fingerprint").agg(F.min(doc_id).alias("least")), "nodes")
    linked = components(links(nodes, k)).withColumnRenamed("node", "fingerprint")
    joined = nodes.join(linked, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    roots = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(roots, "component").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, k: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    A null text counts as empty; wordless texts share fingerprint 0 and are
    linked like any other. A null id names a component only if it has no other
    id. Repeated rows stay repeated. Empty in, empty out.
    """
    marked = materialise(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    return marked.join(classes(marked, k), "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, k: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it. Of rows that share that id one stays.
    Rows without an id stay, as nothing can name them."""
    keep = materialise(near_duplicates(docs, k, shingle).filter("doc_id = component_id").select("doc_id").distinct(), "representatives")
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return named.unionByName(docs.filter("doc_id IS NULL"))
