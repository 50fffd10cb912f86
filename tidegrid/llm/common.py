"""Helpers of the corpus operators: Arrow batches of text as byte arrays, word boundaries, rolling hashes, scratch tables, components."""

from __future__ import annotations

import ctypes
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import shared_dir

SLICE_BYTES = 2 << 20
_SPACE = [0x20, *range(0x09, 0x0E)]
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[_SPACE] = False
#: Only glibc has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


# --- tables ---------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: nothing upstream runs twice, and a lost executor loses no result."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reliable(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns whose names the results will take, in any letter case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Smaller Arrow batches, so that a worker's memory does not follow the length of its documents."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release() -> None:
    """Give freed memory back to the system. Workers serve one stage after the other, and what their allocators keep adds up."""
    for rolling in Rolling.made:
        rolling.forget()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


# --- text as bytes --------------------------------------------------------


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values one behind the other, and where each begins; null counts as empty."""
    release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes, so that work arrays stay small."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_spans(data: np.ndarray, at: np.ndarray, table: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (one more entry at the end)."""
    n = len(data)
    inside = table[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[at[at < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[at[at > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, at)


# --- hashes ---------------------------------------------------------------

_MASK = (1 << 64) - 1


class Rolling:
    """Polynomial hashes modulo 2**64, computed for all spans at once from running sums."""

    made: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.forget()
        Rolling.made.add(self)

    def forget(self) -> None:
        """Drop the tables of powers, which grow with the longest slice and are quickly made again."""
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 5 * len(self.up) // 4)
            with np.errstate(over="ignore"):
                for name, root in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                    steps = np.full(n, root & _MASK, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each [start, end) of ``values`` (unsigned 64 bit)."""
        self.powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.spans(self.byte[data], start, end)

    def windows(self, words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``length`` words of one text begin, and the hash of each such window."""
        n = len(words)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        stop = np.repeat(first[1:], np.diff(first))
        place = np.arange(n, dtype=np.int64)
        place = place[place + length <= stop]
        return place, self.spans(words, place, place + length)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def covered(n: int, places: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``length`` that begins at one of ``places``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, places, 1)
    np.add.at(step, places + length, -1)
    return np.cumsum(step[:-1]) > 0


def hashed_words(rolling: Rolling, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the index of each text's first word; work arrays cover one slice at a time."""
    hashes, first, seen = [], [np.zeros(1, np.int64)], 0
    for a, b in slices(at):
        part, own = data[at[a] : at[b]], at[a : b + 1] - at[a]
        start, end, index = word_spans(part, own)
        hashes.append(rolling.words(part, start, end))
        first.append(index[1:] + seen)
        seen += len(start)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(first)


# --- components -----------------------------------------------------------


def local_labels(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes."""
    label = np.arange(n) if label is None else label
    while len(left):
        a, b = label[left], label[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps. Neighbourhoods stay rows, so a
    node with many neighbours is a skewed join, never one list. Each round is
    checkpointed in the shared folder.
    """
    current = reliable(edges.select("a", "b").filter("a <> b").distinct())
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        current = reliable(small.filter("a <> b").distinct())
        new = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    labels = current.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(roots)
