"""Phrase collocations by mergeable Misra-Gries summaries.

Phrases are counted level by level. At each level a task packs the hashes and
counts of its own phrases by hash partition; in a partition the packs are merged
into one Misra-Gries summary whose capacity exceeds the partition's mass divided
by the threshold, so every phrase that reaches the threshold keeps a counter. What
survives is one bit per hash slot, a bitmap of bounded size, and the next level
only looks at phrases whose shorter parts survived. A second pass counts the
survivors' texts exactly: the summaries decide what is counted, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import Rolling, bounded_batches, materialise, mix, slices, text_bytes, word_spans

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
COVER = 50
#: Bytes of text for each hash partition; a partition's packs and summary follow it.
PART_BYTES = 32 << 20
#: Most slots of a level's bitmap (16 MB).
MAX_SLOTS = 1 << 27
LOCAL_KEYS = 1 << 20
SLICE = 1 << 20
UNKNOWN = "und"
_STOPS = [ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))
IS_STOP = np.zeros(256, bool)
IS_STOP[_STOPS] = True
IS_WORD = ~IS_STOP
IS_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Summary:
    """Misra-Gries counters over 64-bit keys. ``removed`` is the most that any key has lost."""

    def __init__(self, capacity: int):
        self.capacity, self.removed = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge: counts of equal keys are added; beyond the capacity, all lose as much as the first key that has no room."""
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[edge], (np.add.reduceat(counts, edge) if len(edge) else counts)
        if len(self.keys) > self.capacity:
            least = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            stay = self.counts > least
            self.keys, self.counts, self.removed = self.keys[stay], self.counts[stay] - least, self.removed + least

    def reaching(self, threshold: int) -> np.ndarray:
        """Keys that may have been seen ``threshold`` times; all that were are among them."""
        return self.keys[self.counts + self.removed >= threshold]


class Bitmap:
    """One bit per hash slot; each hash partition owns a run of slots."""

    def __init__(self, parts: int, slots: int, bits: np.ndarray):
        self.parts, self.slots, self.bits = parts, slots, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        at = part_of(h, self.parts) * self.slots + _slot(h, self.slots)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition by the upper half of a hash; rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


# --- phrases of a batch ---------------------------------------------------------


class _Words:
    """The words of a slice of texts: spans, pieces, hashes by phrase length."""

    def __init__(self, data: np.ndarray, at: np.ndarray, salts: np.ndarray, rolling: Rolling):
        self.data, self.rolling = _LOWER[data], rolling
        self.start, self.end, first = word_spans(self.data, at, IS_WORD)
        n = len(self.start)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(first))
        stops = np.cumsum(IS_STOP[self.data])[self.start] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (stops[1:] != stops[:-1]) | (self.row[1:] != self.row[:-1])
        self.first = np.append(np.flatnonzero(new), n)
        self.words = rolling.words(self.data, self.start, self.end)
        self.salt = salts[self.row]

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where phrases of ``size`` words start, and their hashes; pieces bound them and languages differ."""
        place, h = self.rolling.windows(self.words, self.first, size)
        return place, mix(h ^ self.salt[place])

    def texts(self, place: np.ndarray, size: int) -> pa.Array:
        """Phrases as strings, words joined by one space."""
        lengths = np.concatenate([[0], np.cumsum(self.end - self.start + 1)])
        joined = np.full(int(lengths[-1]), 0x20, np.uint8)
        src = np.flatnonzero(IS_WORD[self.data])
        word = np.repeat(np.arange(len(self.start)), self.end - self.start)
        joined[src - self.start[word] + lengths[word]] = self.data[src]
        begin, stop = lengths[place], lengths[place + size] - 1
        ends = np.concatenate([[0], np.cumsum(stop - begin)])
        take = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], stop - begin)
        return pa.LargeStringArray.from_buffers(len(place), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(joined[take])).cast(pa.string())


def _slices(batch: pa.RecordBatch, rolling: Rolling) -> Iterator[tuple[_Words, list[str]]]:
    langs = batch.column("lang").to_pylist()
    codes = {name: xxhash.xxh64_intdigest(name.encode()) for name in set(langs)}
    salts = np.array([codes[name] for name in langs], np.uint64)
    data, at = text_bytes(batch.column("text"))
    for a, b in slices(at, SLICE):
        yield _Words(data[at[a] : at[b]], at[a : b + 1] - at[a], salts[a:b], rolling), langs[a:b]


def _planes(values: np.ndarray) -> bytes:
    """Small numbers as byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _values(packed: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T).view(np.uint32).reshape(-1).astype(np.int64)


def _packs(keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each hash partition: its mass, the lower halves of its keys as steps, and counts. Keys that only differ above are one
    then, which can only add survivors."""
    cut = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(cut)):
        own, n = keys[cut[p] : cut[p + 1]] & np.uint64(0xFFFFFFFF), counts[cut[p] : cut[p + 1]]
        order = np.argsort(own)
        rows.append((int(p), int(n.sum()), len(own), _planes(np.diff(own[order], prepend=np.uint64(0))), _planes(n[order])))
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "mass", "size", "keys", "counts"])


def _level(docs: DataFrame, size: int, threshold: int, parts: int, shorter: Bitmap | None) -> Bitmap:
    """The bitmap of phrases of ``size`` words that may reach ``threshold``."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(shorter)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, filter_ = Rolling(11), known.value
        local, waiting, n, mass = Summary(1 << 62), [], 0, 0

        def fold() -> None:
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            local.add(keys, counts.astype(np.int64))

        for batch in batches:
            for words, _ in _slices(batch, rolling):
                place, h = words.phrases(size)
                if filter_ is not None and len(h):
                    at, parts_h = words.phrases(size - 1)
                    good = np.zeros(len(words.start) + 1, bool)
                    good[at] = filter_.has(parts_h)
                    h = h[good[place] & good[place + 1]]
                waiting.append(h)
                n, mass = n + len(h), mass + len(h)
                if n >= LOCAL_KEYS:
                    fold()
                    waiting, n = [], 0
                    if len(local.keys) >= LOCAL_KEYS or mass >> 31:
                        yield _packs(local.keys, local.counts, parts)
                        local, mass = Summary(1 << 62), 0
        if n:
            fold()
        if len(local.keys):
            yield _packs(local.keys, local.counts, parts)

    slots = max(64, min(MAX_SLOTS // parts, PART_BYTES // 4) // 64 * 64)

    def merge(table: pa.Table) -> pa.Table:
        mass = sum(table.column("mass").to_pylist())
        summary = Summary(mass // threshold + 1)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def fold() -> None:
            summary.add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

        for row in table.select(["size", "keys", "counts"]).to_pylist():
            waiting.append((np.cumsum(_values(row["keys"], row["size"])).astype(np.uint64), _values(row["counts"], row["size"])))
            n += len(waiting[-1][0])
            if n > summary.capacity:
                fold()
                waiting, n = [], 0
        if waiting:
            fold()
        bits = np.zeros(slots, bool)
        bits[_slot(summary.reaching(threshold), slots)] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    packed = docs.mapInArrow(pack, "part int, mass long, size long, keys binary, counts binary")
    rows = packed.groupBy("part").applyInArrow(merge, "part int, bits binary").collect()
    known.destroy()
    bits = np.zeros((parts, slots // 8), np.uint8)
    for row in rows:
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return Bitmap(parts, slots, bits.reshape(-1))


def _grouped(h: np.ndarray, check: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each pair of hashes, in order of the first, and the sum of ``n``; equal first hashes of different texts stay apart."""
    order = np.lexsort((check, h))
    edge = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])]))
    return order[edge], np.add.reduceat(n[order], edge)


class _Found:
    """Phrases of one language and length that a task has seen: hashes, counts and texts."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.size += len(row[0])

    def packs(self, parts: int) -> Iterator[tuple[int, int, bytes, int, bytes]]:
        """Hash partition, number of phrases, their texts in order, the length of those, and the counts."""
        h, check, n = (np.concatenate(x) for x in list(zip(*self.rows, strict=True))[:3])
        rep, n = _grouped(h, check, n)
        texts = pa.concat_arrays([row[3] for row in self.rows]).take(pa.array(rep))
        cut = np.searchsorted(part_of(h[rep], parts), np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cut)):
            own = texts.slice(cut[p], cut[p + 1] - cut[p])
            order = pc.sort_indices(own)
            blob = "\n".join(own.take(order).to_pylist()).encode()
            yield int(p), len(own), pa.compress(blob, codec="zstd", asbytes=True), len(blob), _planes(n[cut[p] : cut[p + 1]][order.to_numpy()])


def _exact(docs: DataFrame, bitmaps: dict[int, Bitmap], threshold: int) -> DataFrame:
    """lang, size, phrase, n: exact counts of all phrases whose bit is set, from ``threshold`` on. Size 0 has the language's words."""
    known = docs.sparkSession.sparkContext.broadcast(bitmaps)
    parts = next(iter(bitmaps.values())).parts
    names = ["part", "lang", "size", "many", "texts", "bytes", "counts"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, other, maps = Rolling(11), Rolling(12), known.value
        found: dict[tuple[str, int], _Found] = {}
        totals: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, size), own in found.items():
                rows = [(p, lang, size, n, texts, length, counts) for p, n, texts, length, counts in own.packs(parts)]
                yield batch_of(rows)
            found.clear()

        for batch in batches:
            for words, langs in _slices(batch, rolling):
                own, code = np.unique(np.array(langs, object), return_inverse=True)
                code = code.reshape(-1)
                for lang, n in zip(own.tolist(), np.bincount(code[words.row], minlength=len(own)).tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
                check = other.words(words.data, words.start, words.end)
                for size, bitmap in maps.items():
                    place, h = words.phrases(size)
                    keep = bitmap.has(h)
                    place, h = place[keep], h[keep]
                    if not len(place):
                        continue
                    second = other.spans(check, place, place + size) ^ words.salt[place]
                    rep, n = _grouped(h, second, np.ones(len(h), np.int64))
                    texts, of = words.texts(place[rep], size), code[words.row[place[rep]]]
                    for k in np.unique(of):
                        at = np.flatnonzero(of == k)
                        found.setdefault((own[k], size), _Found()).add(h[rep][at], second[rep][at], n[at], texts.take(pa.array(at)))
                if sum(x.size for x in found.values()) >= LOCAL_KEYS:
                    yield from flush()
        yield from flush()
        if totals:
            yield batch_of([(0, lang, 0, 1, None, n, None) for lang, n in totals.items()])

    def merge(table: pa.Table) -> pa.Table:
        parts_ = []
        for row in table.to_pylist():
            if row["counts"] is None:
                phrases, n = [""], np.array([row["bytes"]])
            else:
                phrases = pa.decompress(row["texts"], row["bytes"], codec="zstd", asbytes=True).decode().split("\n")
                n = _values(row["counts"], row["many"])
            parts_.append(pa.table({"phrase": pa.array(phrases, pa.string()), "n": pa.array(n, pa.int64())}))
        sums = pa.concat_tables(parts_).group_by("phrase").aggregate([("n", "sum")])
        size = table.column("size")[0].as_py()
        sums = sums.filter(pc.greater_equal(sums.column("n_sum"), threshold if size else 0))
        k = len(sums)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * k, pa.string()), "size": pa.array([size] * k, pa.int32()), "phrase": sums.column("phrase"), "n": sums.column("n_sum")})

    packed = docs.mapInArrow(count, "part int, lang string, size int, many long, texts binary, bytes long, counts binary")
    return packed.groupBy("part", "lang", "size").applyInArrow(merge, "lang string, size int, phrase string, n long")


# --- the operator -----------------------------------------------------------------


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, size (words), phrase, n, id: exact counts of every phrase of up to ``max_words`` words that occurs ``min_count`` times
    or more in its language; size 0 has all words of a language."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(1, -(-int(total) // PART_BYTES)), MAX_SLOTS // 64)
    bitmaps: dict[int, Bitmap] = {}
    for size in range(1, max_words + 1):
        bitmaps[size] = _level(docs, size, min_count, parts, bitmaps.get(size - 1))
    return materialise(_exact(docs, bitmaps, min_count).withColumn("id", F.monotonically_increasing_id()), "phrases")


def _score(a: str, left: str, right: str) -> F.Column:
    """floor(1000000 * a * a / (left * right)) in whole decimals; counts up to 10**15."""
    return F.expr(f"cast(1000000 as decimal(7,0)) * (cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def _parts(words: F.Column, size: int) -> F.Column:
    """All proper parts of ``size`` words."""
    starts = F.when(F.col("size") > size, F.sequence(F.lit(1), F.col("size") - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, cover: int = COVER) -> DataFrame:
    """Each language's ``top`` collocations: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has (text, lang). A candidate has 2 to ``max_words`` words and occurs
    ``a`` >= ``min_count`` times. Its cut is the one with the lowest score, then
    the fewest words in front; ``l`` and ``r`` count the cut's parts. Candidates
    inside a longer one that has ``cover`` percent of their count go. A null text
    is empty, a null language is 'und', a language without a candidate has no
    row; repeated rows count again; other columns are ignored.
    """
    counted = frequent(docs, min_count, max_words)
    phrases = counted.filter("size > 0")
    words = F.split("phrase", " ")
    sides = []
    for k in range(1, max_words):
        both = [(F.slice(words, 1, k), 2 * k), (F.slice(words, k + 1, max_words), 2 * k + 1)]
        sides += [F.when(F.col("size") > k, F.struct(F.array_join(part, " ").alias("part"), F.lit(slot).alias("slot"))) for part, slot in both]
    inner = [F.transform(_parts(words, size), lambda p: F.struct(p.alias("part"), F.lit(0).alias("slot"))) for size in range(2, max_words - 1)]
    needed = F.concat(F.array_compact(F.array(*sides)), *inner)
    asked = phrases.filter("size > 1").select("lang", "id", F.col("n").alias("a"), F.explode(needed).alias("s")).select("lang", "id", "a", "s.part", "s.slot")
    met = asked.join(phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.col("id").alias("part_id"), (F.col("size") > 1).alias("phrase_too")), ["lang", "part"])
    # a row for the phrase that asked, and one for a part that it covers
    own = F.struct("id", "a", "slot", "f")
    covers = F.when(F.col("phrase_too") & (100 * F.col("a") >= cover * F.col("f")), F.struct(F.col("part_id").alias("id"), F.col("f").alias("a"), F.lit(1).alias("slot"), F.col("f")))
    told = met.select("lang", F.explode(F.array_compact(F.array(own, covers))).alias("t")).select("lang", "t.id", "t.a", "t.slot", "t.f")
    sums = [F.max(F.when(F.col("slot") == slot, F.col("f"))).alias(f"f{slot}") for slot in range(1, 2 * max_words)]
    wide = told.groupBy("lang", "id", "a").agg(*sums).filter("f1 IS NULL")
    cuts = [F.when(F.col(f"f{2 * k}").isNotNull(), F.struct(_score("a", f"f{2 * k}", f"f{2 * k + 1}").alias("score"), F.lit(k).alias("k"), F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r"))) for k in range(1, max_words)]
    scored = wide.withColumn("b", F.array_min(F.array_compact(F.array(*cuts)))).select("lang", "id", "a", "b.l", "b.r", "b.score")
    by_score = [F.col("score").desc(), F.col("a").desc()]
    front = scored.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(*by_score))).filter(F.col("place") <= top).drop("place")
    named = front.join(phrases.select("id", "phrase"), "id")
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by_score, "phrase")).cast("long")).filter(F.col("rank") <= top)
    sizes = counted.filter("size = 0").select("lang", "n")
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
