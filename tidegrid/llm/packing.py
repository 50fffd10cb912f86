"""Packing token sequences with a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Full pieces are
sequences already. The others are dealt to blocks; each block is solved by
several islands, each with its own population. A crossover injects whole
well-filled bins of one parent into the other, drops the bins that would hold a
document twice, and best-fits what they displaced. After each epoch an island's
elite migrates to its neighbour (the shuffle between two epochs). Poorly filled
bins of all blocks are then dissolved and solved once more together.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import pieces
from tidegrid.llm.common import bounded_batches, materialise, release, slices, text_bytes

CAPACITY = 2048
END = 0
BLOCK = 4096
ISLANDS, EPOCHS, POPULATION, CROSSOVERS = 2, 2, 5, 24
INJECTED = 12
WELL_FILLED = 0.995
POOR = 0.97
MAX_CACHED = 1_000_000


# --- tokens -------------------------------------------------------------------


class WordIds(dict):
    """Token ids (little-endian bytes) of each word of the split pattern, from a tokenizer file; filled as words are met.

    The tokenizer treats every such word by itself, so a text's ids are its words' ids in a row. Added tokens of the file are words
    of their own, found in the raw text."""

    _CACHE: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenize = tokenizer.model.tokenize
        added = tokenizer.get_added_tokens_decoder()
        odd = [t.content for t in added.values() if t.single_word or t.lstrip or t.rstrip or t.normalized]
        if odd:
            raise NotImplementedError(f"added tokens that look at their surroundings or at normalised text: {odd}")
        self.added = {t.content: array("I", [k]).tobytes() for k, t in added.items() if t.content}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else lambda text: [text]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.visible = {b: 256 + k for k, b in enumerate(rest)}  # byte-level tokenizers write these bytes as other characters

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._CACHE:
            cls._CACHE[path] = cls(path)
        return cls._CACHE[path]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_CACHED:
            self.clear()
        written = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.visible)
        ids = self[word] = array("I", [t.id for t in self.tokenize(written)]).tobytes()
        return ids

    def texts(self, texts: list[str], added_tokens: bool = False) -> list[bytes]:
        """Ids of each text. ``added_tokens``: strings of added tokens are those tokens, else ordinary text."""
        if not added_tokens or not any(x in t for t in texts for x in self.added):
            return self._plain(texts)
        cut = [self.cut(t) for t in texts]  # every other part is an added token
        plain = iter(self._plain([p for parts in cut for p in parts[::2]]))
        return [b"".join(self.added[p] if k % 2 else next(plain) for k, p in enumerate(parts)) for parts in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        joined, start, end, first = pieces.words([_normal(t) for t in texts])
        ids = list(map(self.__getitem__, map(joined.__getitem__, map(slice, start.tolist(), end.tolist()))))
        edge = first.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without regard to the place in a word
    return text.lower()


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document (its ids, then ``END``). A null text is only ``END``.
    Strings of added tokens in a text are ordinary text unless ``added_tokens``."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = array("I", [END]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            _, at = text_bytes(batch.column("text"))
            row, start, length, crc = [], [], [], []
            for a, b in slices(at, 1 << 20):
                for k, ids in enumerate(words.texts(texts[a:b], added_tokens), a):
                    ids += end
                    for s in range(0, len(ids), 4 * capacity):
                        part = ids[s : s + 4 * capacity]
                        row.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array([s // capacity for s in start], pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        words.clear()  # the worker serves other stages next
        release()

    return docs.mapInArrow(cut, schema)


# --- one block ------------------------------------------------------------------


def _best_fit(items: list[int], sizes: list[int], bins: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put each item into the fullest bin that takes it, else into a new one."""
    free = sorted((capacity - f) << 24 | b for b, f in enumerate(fill) if f < capacity)
    for i in items:
        at = bisect_left(free, sizes[i] << 24)
        if at < len(free):
            b = free.pop(at) & 0xFFFFFF
        else:
            b = len(fill)
            fill.append(0)
        bins[i] = b
        fill[b] += sizes[i]
        if fill[b] < capacity:
            insort(free, (capacity - fill[b]) << 24 | b)


def _fills(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bins, sizes).astype(np.int64)


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean square of the bins' fill: fuller bins count more than evenly filled ones."""
    return float(np.mean((_fills(bins, sizes) / capacity) ** 2))


def initial(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best-fit packings of decreasing sizes; all but the first with some noise in the order."""
    out, listed = [], sizes.tolist()
    for k in range(POPULATION):
        order = np.argsort(-(sizes * (1 + (0.15 * k / POPULATION) * rng.standard_normal(len(sizes)))), kind="stable")
        bins = np.zeros(len(sizes), np.int64)
        _best_fit(order.tolist(), listed, bins, [], capacity)
        out.append(bins)
    return out


def crossover(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``left`` with some whole well-filled bins of ``right``, and with its worst bin dissolved."""
    good = np.flatnonzero(_fills(right, sizes) >= WELL_FILLED * capacity)
    taken = rng.choice(good, min(INJECTED, len(good)), replace=False) if len(good) else good
    inject = np.isin(right, taken)
    fill = _fills(left, sizes)
    broken = np.zeros(len(fill), bool)
    broken[left[inject]] = True
    broken[fill.argmin()] = True
    loose = broken[left] & ~inject
    place = np.cumsum(~broken) - 1
    stay = int((~broken).sum())
    child = np.where(broken[left], -1, place[left])
    child[inject] = stay + np.searchsorted(np.sort(taken), right[inject])
    settled = ~loose
    filled = np.bincount(child[settled], sizes[settled], minlength=stay + len(taken)).astype(np.int64).tolist()
    order = np.flatnonzero(loose)
    _best_fit(order[np.argsort(-sizes[order], kind="stable")].tolist(), sizes.tolist(), child, filled, capacity)
    return np.unique(child, return_inverse=True)[1]


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, rng: np.random.Generator, crossovers: int = CROSSOVERS) -> list[np.ndarray]:
    """The population after some crossovers, best first."""
    bound = -(-int(sizes.sum()) // capacity)
    ranked = sorted(((fitness(b, sizes, capacity), k, b) for k, b in enumerate(population)), reverse=True)[:POPULATION]
    for turn in range(crossovers):
        if len(ranked) < 2 or ranked[0][2].max() + 1 <= bound:
            break
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[min(i, j)][2], ranked[max(i, j)][2], sizes, capacity, rng)
        made = (fitness(child, sizes, capacity), -1 - turn, child)
        if made[0] > ranked[-1][0]:
            ranked = sorted([*ranked[:-1], made], key=lambda x: (x[0], x[1]), reverse=True)
    return [b for _, _, b in ranked]


# --- islands ----------------------------------------------------------------------

_ISLAND = "block long, island int, elite boolean, sizes binary, bins binary"


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("row", "ascending")])


def _rows(block: int, island: int, elite: bool, sizes: np.ndarray, packings: list[np.ndarray]) -> dict:
    return {"block": block, "island": island, "elite": elite, "sizes": sizes.astype(np.int32).tobytes(), "bins": np.concatenate([b.astype(np.int32) for b in packings]).tobytes()}


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("island", pa.int32()), ("elite", pa.bool_()), ("sizes", pa.binary()), ("bins", pa.binary())]))


def solve(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (row, block, length, more) with ``bin`` and ``fill`` by block. Blocks are independent; islands of a block run in
    parallel and every draw is seeded by block, island and epoch, so that a lost task repeats itself."""

    def settle(key, table):
        """First population of every island of a block."""
        block = key[0].as_py()
        sizes = _ordered(table).column("length").to_numpy()
        return _table([_rows(block, i, False, sizes, initial(sizes, capacity, np.random.default_rng([block, i]))) for i in range(ISLANDS)])

    def epoch(number: int):
        def run(key, table):
            """Own population and immigrants evolve; the elite moves on to the next island."""
            block, island = (k.as_py() for k in key)
            sizes = np.frombuffer(table.column("sizes")[0].as_py(), np.int32).astype(np.int64)
            packings = [b for blob in table.column("bins").to_pylist() for b in np.frombuffer(blob, np.int32).astype(np.int64).reshape(-1, len(sizes))]
            best = evolve(packings, sizes, capacity, np.random.default_rng([block, island, number]))
            return _table([_rows(block, island, False, sizes, best), _rows(block, (island + 1) % ISLANDS, True, sizes, best[:1])])

        return run

    def finish(key, table, islands):
        table = _ordered(table)
        sizes = table.column("length").to_numpy()
        packings = [b for blob in islands.column("bins").to_pylist() for b in np.frombuffer(blob, np.int32).astype(np.int64).reshape(-1, len(sizes))]
        best = min(packings, key=lambda b: (b.max(), -fitness(b, sizes, capacity), b.tobytes()))
        fill = _fills(best, sizes)
        order = np.argsort(best, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        offset = np.zeros(len(sizes), np.int64)
        first = np.searchsorted(best[order], best[order])
        offset[order] = before - before[first]
        return table.append_column("bin", pa.array(best)).append_column("fill", pa.array(fill[best])).append_column("offset", pa.array(offset))

    from pyspark.sql.types import LongType, StructField, StructType

    state = rows.select("row", "block", "length").groupBy("block").applyInArrow(settle, _ISLAND)
    for number in range(EPOCHS):
        state = state.groupBy("block", "island").applyInArrow(epoch(number), _ISLAND)
    schema = StructType([*rows.schema.fields, *[StructField(c, LongType()) for c in ("bin", "fill", "offset")]])
    return rows.groupBy("block").cogroup(state.filter("elite").groupBy("block")).applyInArrow(finish, schema)


def _deal(rows: DataFrame) -> DataFrame:
    """Deal written rows to blocks of about ``BLOCK`` by a hash of their place, so that repeated documents spread."""
    n = rows.count()
    placed = rows.withColumn("row", F.monotonically_increasing_id())
    return placed.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // BLOCK)))))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, added_tokens: bool = False) -> DataFrame:
    """One row per piece of (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` names the tokenizer file. With ``added_tokens`` ids are those of the
    library's ``encode``; without, those under its ``encode_special_tokens``. Pieces follow one another without gaps in
    a sequence. Null texts are one END token; an empty table gives no rows; rows
    that share an id are packed one by one. Other columns are not carried.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = materialise(token_pieces(docs, path, capacity, added_tokens), "pieces")
    full = cut.filter(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    solved = materialise(solve(_deal(cut.filter(F.col("length") < capacity)), capacity), "packed")
    good = solved.filter(F.col("fill") >= POOR * capacity)
    rest = materialise(solved.filter(F.col("fill") < POOR * capacity).select(*columns), "rest")
    again = solve(_deal(rest), capacity)
    number = F.shiftleft(F.col("block"), 24) + F.col("bin")
    done = [df.select(*columns, (number * 2 + level).alias("sequence_id"), "offset") for level, df in enumerate((good, again))]
    return full.unionByName(done[0]).unionByName(done[1])
