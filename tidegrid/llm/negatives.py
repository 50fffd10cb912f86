"""Hard negatives by a secondary sort.

Anchors meet all rows in blocks. A first round over rows of the anchor's own
label gives its positives, a second one over the other labels keeps what falls
into a positive's window. Pairs travel as one packed binary key: anchor,
descending score, kind, id. They are shuffled by anchor and sorted by key within
partitions; an iterator reads an anchor's pairs from the highest score down,
opens a window at each positive and emits negatives as they pass. It holds the
open windows and nothing else. Blocks send the pairs that may still count: the
best positives and, for each window, the first negatives of the block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import bounded_batches, materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Rows of a block, anchors of a group of blocks, and anchors scored at once.
BLOCK = 8192
SUPER = 8192
CHUNK = 256
_BIAS = 1 << 63
_LONG = (1 << 63) - 1
POSITIVE, NEGATIVE = 0, 1


# --- packed keys --------------------------------------------------------------


def _falling(score: int) -> bytes:
    """Bytes that sort by falling score; whole numbers of any size."""
    if -_BIAS <= score <= _LONG:
        return b"\x80" + struct.pack(">Q", _LONG - score)
    size = abs(score).bit_length() // 8 + 1
    raw = struct.pack(">H", size) + abs(score).to_bytes(size, "big")
    return b"\xc0" + raw if score < 0 else b"\x40" + bytes(255 - b for b in raw)


def packed(anchor: int, anchor_id: int, score: int, kind: int, vec_id: int, row: int) -> bytes:
    return struct.pack(">QQ", anchor + _BIAS, anchor_id + _BIAS) + _falling(score) + struct.pack(">BQQ", kind, vec_id + _BIAS, row + _BIAS)


def unpacked(key: bytes) -> tuple[int, int, int, int, int, int]:
    """anchor, anchor_id, score, kind, vec_id, row."""
    anchor, anchor_id = struct.unpack(">QQ", key[:16])
    kind, vec_id, row = struct.unpack(">BQQ", key[-17:])
    mark, body = key[16], key[17:-17]
    if mark == 0x80:
        score = _LONG - struct.unpack(">Q", body)[0]
    else:
        body = body if mark == 0xC0 else bytes(255 - b for b in body)
        score = int.from_bytes(body[2:], "big") * (-1 if mark == 0xC0 else 1)
    return anchor - _BIAS, anchor_id - _BIAS, score, kind, vec_id - _BIAS, row - _BIAS


def _by_anchor(keys: DataFrame, partitions: int):
    """Packed keys of one anchor in one partition, in order."""
    return keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(partitions, lambda key: int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 >> 20)


# --- vectors ------------------------------------------------------------------


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, dim, comps): floor(scale * x) of each component as doubles; ``row`` names a row. Rows without an id or a
    label, and those whose vector is null, empty or not finite in every component, take no part."""
    bounded_batches(vectors.sparkSession, 4096)

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, comps = [], [], []
            for k, vec in enumerate(batch.column("embedding")):
                x = vec.values
                if x is None or not len(x) or x.null_count:
                    continue
                v = x.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    v = np.floor(scale * v)
                if np.isfinite(v).all():
                    keep.append(k)
                    dims.append(len(v))
                    comps.append(v.tobytes())
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(dims, pa.int32()), pa.array(comps, pa.binary())], ["vec_id", "label", "dim", "comps"])

    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    out = known.mapInArrow(floor, "vec_id long, label long, dim int, comps binary")
    return materialise(out.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _exact(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles where a hundred times every inner product stays below 2**53 and so is exact; else Python's integers."""
    most = float(np.abs(left).max(initial=0)), float(np.abs(right).max(initial=0))
    if most[0] * most[1] * left.shape[1] < 2**53 / 128:
        return left, right
    whole = np.frompyfunc(int, 1, 1)
    return whole(left), whole(right)


def _first(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line of ``scores`` the columns of the ``k`` best allowed ones, by falling score, then id and row."""
    if scores.dtype == object:
        rank = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    else:
        rank = scores
    if scores.shape[1] > k:
        masked = np.where(allowed, rank, -1 if scores.dtype == object else -np.inf)
        least = np.partition(masked, -k, axis=1)[:, -k]
        allowed = allowed & (rank >= least[:, None])
    i, j = np.nonzero(allowed)
    order = np.lexsort((rows[j], ids[j], -rank[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


# --- rounds ---------------------------------------------------------------------


def _grouped(vectors: DataFrame, anchors: DataFrame, keys: list[str], block: int, super_: int, n: int, n_anchors: int):
    """Rows in blocks and anchors in groups meet: one task has a block of rows and at most a group of anchors."""
    blocks, supers = max(1, -(-n // block)), max(1, -(-n_anchors // super_))
    rows = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("super", F.explode(F.sequence(F.lit(0), F.lit(supers - 1)).cast("array<long>")))
    sent = anchors.withColumn("super", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(supers))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    by = ["dim", *keys, "block", "super"]
    return sent.groupBy(*by).cogroup(rows.groupBy(*by))


def _positive_keys(vectors: DataFrame, anchors: DataFrame, k: int, block: int, super_: int, n: int, n_anchors: int) -> DataFrame:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            dim = rows.column("dim")[0].as_py()
            left, right = _exact(_matrix(anchors.column("comps"), dim), _matrix(rows.column("comps"), dim))
            own, own_id, row, vec_id = (t.column(c).to_numpy() for t in (anchors, rows) for c in ("row", "vec_id"))
            for a in range(0, len(own), CHUNK):
                scores = left[a : a + CHUNK] @ right.T
                for i, j in zip(*_first(scores, own[a : a + CHUNK, None] != row[None, :], vec_id, row, k), strict=True):
                    out.append(packed(int(own[a + i]), int(own_id[a + i]), int(scores[i, j]), POSITIVE, int(vec_id[j]), int(row[j])))
        return pa.table({"key": pa.array(out, pa.binary())})

    return _grouped(vectors, anchors, ["label"], block, super_, n, n_anchors).applyInArrow(run, "key binary")


def _chosen(keys: DataFrame, k: int, partitions: int) -> DataFrame:
    """(row, keys): each anchor's first ``k`` positives."""

    def run(items: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, list[bytearray]]]:
        anchor, own = None, []
        for key, _ in items:
            if key[:8] != anchor:
                if own:
                    yield int.from_bytes(anchor, "big") - _BIAS, own
                anchor, own = key[:8], []
            if len(own) < k:
                own.append(bytearray(key))
        if own:
            yield int.from_bytes(anchor, "big") - _BIAS, own

    return keys.sparkSession.createDataFrame(_by_anchor(keys, partitions).mapPartitions(run), "row long, keys array<binary>")


def _negative_keys(vectors: DataFrame, anchors: DataFrame, k: int, low: int, high: int, block: int, super_: int, n: int, n_anchors: int) -> DataFrame:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            dim = rows.column("dim")[0].as_py()
            left, right = _exact(_matrix(anchors.column("comps"), dim), _matrix(rows.column("comps"), dim))
            own, own_id, own_label, row, vec_id, label = (t.column(c).to_numpy() for t in (anchors, rows) for c in ("row", "vec_id", "label"))
            positives = [[unpacked(key)[2] for key in keys] for keys in anchors.column("keys").to_pylist()]
            for a in range(0, len(own), CHUNK):
                scores = left[a : a + CHUNK] @ right.T
                other = own_label[a : a + CHUNK, None] != label[None, :]
                found = set()
                for slot in range(max(map(len, positives[a : a + CHUNK]))):
                    has = np.array([slot < len(p) for p in positives[a : a + CHUNK]])
                    score = np.array([p[slot] if slot < len(p) else 0 for p in positives[a : a + CHUNK]], scores.dtype)
                    inside = (100 * scores >= (low * score)[:, None]) & (100 * scores <= (high * score)[:, None]) & other & has[:, None]
                    found.update(zip(*(x.tolist() for x in _first(scores, inside.astype(bool), vec_id, row, k)), strict=True))
                out += [packed(int(own[a + i]), int(own_id[a + i]), int(scores[i, j]), NEGATIVE, int(vec_id[j]), int(row[j])) for i, j in found]
        return pa.table({"key": pa.array(out, pa.binary())})

    return _grouped(vectors, anchors, [], block, super_, n, n_anchors).applyInArrow(run, "key binary")


def streamed(keys: Iterator[bytes], negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """anchor_id, positive_id, rank, negative_id, positive score, negative score from sorted packed keys: each positive opens a window,
    a negative is emitted for every open window that it falls into. Nothing of an anchor but its open windows is held."""
    anchor, open_ = None, []
    for key in keys:
        if key[:8] != anchor:
            anchor, open_ = key[:8], []
        _, anchor_id, score, kind, vec_id, _ = unpacked(key)
        if kind == POSITIVE:
            open_.append([score, vec_id, 0])
            continue
        open_ = [w for w in open_ if w[2] < negatives and 100 * score >= low * w[0]]
        for window in open_:
            if 100 * score <= high * window[0]:
                window[2] += 1
                yield anchor_id, window[1], window[2], vec_id, window[0], score


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, super_: int = SUPER) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` and ``anchors`` have (row, vec_id, label, dim, comps), as ``scaled``
    gives; anchors are some of the vectors. An anchor's positives are its first
    ``positives`` other rows of its label by falling inner product, then id. A
    positive's negatives are the first ``negatives`` rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's; none where
    the positive's score is below zero. Only vectors of equal length meet. Rows
    repeated whole count one by one. Scores are compared exactly; one that a long
    cannot hold is returned as the nearest long.
    """
    anchors = anchors.toDF(*anchors.columns)
    n, n_anchors = vectors.count(), anchors.count()
    sizes = {"block": block, "super_": super_, "n": n, "n_anchors": n_anchors}
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = materialise(_positive_keys(vectors, anchors, positives, **sizes), "positive-keys")
    chosen = materialise(_chosen(best, positives, partitions), "positives")
    windows = anchors.join(chosen, "row")
    hits = _negative_keys(vectors, windows, negatives, low, high, **sizes)
    keys = chosen.select(F.explode("keys").alias("key")).unionByName(hits)

    def run(items: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
        for a, p, rank, i, *scores in streamed((key for key, _ in items), negatives, low, high):
            yield a, p, rank, i, *(min(max(s, -_BIAS), _LONG) for s in scores)

    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(_by_anchor(keys, partitions).mapPartitions(run), schema)
