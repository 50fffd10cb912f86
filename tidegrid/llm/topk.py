"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt to shards. In a shard, median splits along the widest side
give leaves with tight bounding boxes. For a query, the best inner product that
a box allows is known exactly, so leaves are visited best first until the bound
falls below the k-th score found so far. That score starts from a first pass in
which every query block meets one shard, and is handed to all other shards.
Query blocks and shards meet as packed rows; one task holds one shard and at
most ``SUPER`` query blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import bounded_batches, materialise

K = 20
SCALE = 64
SHARD = 4096
LEAF = 64
QUERY_BLOCK = 1024
SUPER = 16
_NONE = np.iinfo(np.int64).min
_LARGE = np.iinfo(np.int64).max


def scaled(vectors: DataFrame, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, comps): floor(scale * x) of every component as doubles, for rows with an id whose components are all finite, also when scaled. An empty
    vector takes no part either."""
    bounded_batches(vectors.sparkSession, 4096)

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column("vec_id"), batch.column("x")
            rows, dims, comps = [], [], []
            for k, vec in enumerate(vecs):
                x = vec.values
                if x is None or not len(x) or x.null_count or not ids[k].is_valid:
                    continue
                v = x.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    v = np.floor(scale * v)
                if np.isfinite(v).all():
                    rows.append(k)
                    dims.append(len(v))
                    comps.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(dims, pa.int32()), pa.array(comps, pa.binary())], ["vec_id", "dim", "comps"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x")).mapInArrow(floor, "vec_id long, dim int, comps binary")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """Doubles where every inner product stays below 2**53 and so is exact; else Python's integers."""
    most = max(float(np.abs(m).max(initial=0)) for m in matrices)
    if most * most * matrices[0].shape[1] < 2**53:  # infinite if beyond doubles
        return list(matrices)
    as_int = np.frompyfunc(int, 1, 1)
    return [as_int(m) for m in matrices]


def _bottom(dtype: np.dtype) -> float | int:
    """A number below every inner product."""
    return -(1 << 4096) if dtype == object else -np.inf


def _sortable(score: int) -> bytes | None:
    """Bytes that order scores which a long cannot hold; none for the others."""
    return (int(score) + (1 << 4096)).to_bytes(513, "big") if not _NONE < score < _LARGE else None


class BoxTree:
    """Median splits down to leaves of at most ``LEAF`` vectors; boxes of leaves and of all nodes above them."""

    def __init__(self, points: np.ndarray):
        self.points, self.bottom = points, _bottom(points.dtype)
        parts, levels = [np.arange(len(points))], []
        while True:
            levels.append(parts)
            if max(map(len, parts)) <= LEAF:
                break
            parts = [half for part in parts for half in self._split(part)]
        self.leaves = levels[-1]
        self.boxes = [(np.array([points[p].min(0) for p in level]), np.array([points[p].max(0) for p in level])) for level in levels]

    def _split(self, part: np.ndarray) -> list[np.ndarray]:
        own = self.points[part]
        axis = int((own.max(0) - own.min(0)).argmax())
        order = part[np.argsort(own[:, axis], kind="stable")]
        return [order[: len(order) // 2], order[len(order) // 2 :]]

    def bounds(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Best inner product that each leaf's box allows; below an inner node whose box cannot reach ``least``, the lowest number."""
        above, below = np.maximum(queries, 0), np.minimum(queries, 0)
        alive = None
        for low, high in self.boxes:
            bound = above @ high.T + below @ low.T
            if alive is not None:
                bound = np.where(np.repeat(alive, 2, axis=1), bound, self.bottom)
            alive = (bound >= least[:, None]) & (bound > self.bottom)
        return np.where(alive, bound, self.bottom)

    def search(self, queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates (query, point, score) that hold the k best of this shard for each query, as far as they reach ``least``.

        ``rows`` and ``own`` name points and queries, so that a query skips its own row; ties go to smaller ``ids``."""
        least = least.copy()
        bound = self.bounds(queries, least)
        order = np.argsort(-bound, axis=1, kind="stable")
        found_q, found_p, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, queries.dtype)]
        active = np.arange(len(queries))
        for turn in range(len(self.leaves)):
            leaf = order[active, turn]
            live = (bound[active, leaf] >= least[active]) & (bound[active, leaf] > self.bottom)
            active, leaf = active[live], leaf[live]
            if not len(active):
                break
            new_q, new_p, new_s = [], [], []
            by_leaf = np.argsort(leaf, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(leaf[by_leaf]) != 0, [True]]))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                q, points = active[by_leaf[a:b]], self.leaves[leaf[by_leaf[a]]]
                score = queries[q] @ self.points[points].T
                keep = (score >= least[q][:, None]) & (rows[points][None, :] != own[q][:, None])
                i, j = np.nonzero(keep)
                new_q.append(q[i])
                new_p.append(points[j])
                new_s.append(score[i, j])
            q, p, s = (np.concatenate(x) for x in ([*found_q, *new_q], [*found_p, *new_p], [*found_s, *new_s]))
            q, p, s = _best(q, p, s, ids, k)
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            kth = rank == k - 1
            least[q[kth]] = np.maximum(least[q[kth]], s[kth])
            found_q, found_p, found_s = [q], [p], [s]
        return found_q[0], found_p[0], found_s[0]


def _best(q: np.ndarray, p: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, by query, falling score and rising id."""
    key = np.unique(s, return_inverse=True)[1] if s.dtype == object else s
    order = np.lexsort((ids[p], -key, q))
    q, p, s = q[order], p[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], p[keep], s[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries``: query_id, rank (from 1), vec_id, score.

    Both have (row, vec_id, dim, comps), ``row`` naming a row of one table, of which a query skips its own. Only vectors of equal
    length meet. Ties go to the smaller vec_id. Scores beyond a long are ranked exactly and then cut to its ends.
    """
    n, n_queries = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // QUERY_BLOCK))
    supers = -(-blocks // SUPER)
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    packed = (
        queries.withColumn("qb", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)))
        .groupBy("dim", "qb")
        .applyInArrow(_pack, "dim int, qb long, rows binary, ids binary, comps binary")
    )
    first = packed.withColumn("shard", F.pmod("qb", F.lit(shards))).withColumn("least", F.lit(None).cast("binary"))
    seeds = _meet(dealt, first, supers, k).groupBy("dim", "query_row").agg(F.count("*").alias("found"), F.min("score").alias("kth")).filter(F.col("found") == k)
    known = queries.select("dim", "row").join(seeds.withColumnRenamed("query_row", "row"), ["dim", "row"], "left")
    known = known.withColumn("qb", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))).groupBy("dim", "qb").agg(F.collect_list(F.struct("row", F.coalesce("kth", F.lit(_NONE)).alias("kth"))).alias("kths"))
    armed = packed.join(known, ["dim", "qb"]).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = _meet(dealt, armed.select("dim", "qb", "rows", "ids", "comps", "shard", F.to_json("kths").cast("binary").alias("least")), supers, k)
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pack(table: pa.Table) -> pa.Table:
    """One block of queries as one row."""
    blob = {c: table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("row", "vec_id")}
    return pa.table({"dim": table.column("dim").slice(0, 1), "qb": table.column("qb").slice(0, 1), "rows": [blob["row"]], "ids": [blob["vec_id"]], "comps": pa.array([b"".join(table.column("comps").to_pylist())], pa.binary())})


def _meet(vectors: DataFrame, blocks: DataFrame, supers: int, k: int) -> DataFrame:
    """Search every query block in the shard it is sent to."""
    import json

    def run(key, points, queries):
        names = ("query_row", "query_id", "row", "vec_id", "score")
        if not len(points) or not len(queries):
            return pa.table({"dim": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in names}, "beyond": pa.array([], pa.binary())})
        dim = key[0].as_py()
        rows, ids = points.column("row").to_numpy(), points.column("vec_id").to_numpy()
        raw = _matrix(points.column("comps"), dim)
        out: dict[str, list] = {c: [] for c in names}
        beyond: list[bytes | None] = []
        trees: dict[str, BoxTree] = {}
        for block in queries.to_pylist():
            own, own_ids = np.frombuffer(block["rows"], np.int64), np.frombuffer(block["ids"], np.int64)
            q, p = _exact(np.frombuffer(block["comps"], np.float64).reshape(-1, dim), raw)
            if p.dtype.kind not in trees:
                trees[p.dtype.kind] = BoxTree(p)
            tree = trees[p.dtype.kind]
            kth = {x["row"]: x["kth"] for x in json.loads(block["least"])} if block["least"] is not None else {}
            least = np.array([tree.bottom if kth.get(r, _NONE) == _NONE else kth[r] for r in own.tolist()], object).astype(q.dtype)
            a, b, score = tree.search(q, own, rows, ids, k, least)
            out["query_row"].append(own[a])
            out["query_id"].append(own_ids[a])
            out["row"].append(rows[b])
            out["vec_id"].append(ids[b])
            out["score"].append(np.array([min(max(int(s), _NONE), _LARGE) for s in score.tolist()], np.int64))
            beyond += map(_sortable, score.tolist()) if score.dtype == object else [None] * len(score)
        columns = {c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in out.items()}
        return pa.table({"dim": pa.array([dim] * len(columns["row"]), pa.int32()), **columns, "beyond": pa.array(beyond, pa.binary())})

    left = vectors.select("dim", "shard", "row", "vec_id", "comps", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(supers - 1).cast("long"))).alias("super"))
    right = blocks.withColumn("super", F.pmod("qb", F.lit(supers)))
    keys = ["dim", "shard", "super"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "dim int, query_row long, query_id long, row long, vec_id long, score long, beyond binary")


def top_k(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """``search`` with the rows whose vec_id ``every`` divides as queries and all rows as candidates."""
    vectors = materialise(scaled(embeddings), "vectors").withColumn("row", F.monotonically_increasing_id())
    return search(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
