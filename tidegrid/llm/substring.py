"""Passages that repeat across documents, by level-wise doubling.

The ladder of lengths ends at the window asked for, each level at most twice
the one before (7, 13 for 13 words). At the first level every window is a
candidate. A window of the next level is one only if the two shorter windows
that cover it were both found more than once; levels stop when no candidate
is left.

Documents are dealt to chunks once (the only time that text is shuffled). A
chunk sends one packed list of its distinct hashes to each bucket of hashes, so
a passage that a million documents share costs one entry a chunk: no key is
hot, and both chunks and buckets stay small. Below the last level a bucket
answers with one bit for each hash; at the last level with the smallest id that
holds the window, where that is smaller than the chunk's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.llm.common import Rolling, covered, hashed_words, slices, text_bytes, without, word_spans

WINDOW = 13
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
CHUNKS_A_TASK = 8
RESULTS = ["n_words", "n_removed", "kept_sha256", "kept_text"]
_TYPES = "n_words long, n_removed long, kept_sha256 string, kept_text string"
_WORDS, _NO_ID = Rolling(13), np.iinfo(np.int64).max


def ladder(window: int, start: int = 7) -> list[int]:
    """Lengths up to ``window``, each at most twice the one before it and none below ``start`` unless the window is."""
    out = [window]
    while -(-out[0] // 2) >= start:
        out.insert(0, -(-out[0] // 2))
    return out


class _Chunk:
    """Hashed words of one chunk's documents."""

    def __init__(self, texts: pa.ChunkedArray, ids: pa.ChunkedArray):
        self.data, self.at = text_bytes(texts)
        self.words, self.first = hashed_words(_WORDS, self.data, self.at)
        self.ids = ids.combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, np.int64)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        return _WORDS.windows(self.words, self.first, length)

    def owner(self, place: np.ndarray) -> np.ndarray:
        """The id of the document that holds a word."""
        return self.ids[np.searchsorted(self.first, place, "right") - 1]


def _edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; one more entry at the end."""
    low = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(hashes, low), len(hashes))


def _packed(chunk: int, by: np.ndarray, buckets: int, **columns: np.ndarray) -> pa.Table:
    """One row for each bucket that has some of the sorted hashes ``by``: chunk, bucket and the bytes of every column."""
    edge = _edges(by, buckets)
    full = np.flatnonzero(np.diff(edge))
    rows = {"chunk": pa.array(np.full(len(full), chunk), pa.int64()), "bucket": pa.array(full, pa.int64())}
    rows |= {name: pa.array([c[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary()) for name, c in columns.items()}
    return pa.table(rows)


def _prints(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits that tell hashes of one bucket apart. Hashes that still look alike cost a needless candidate only."""
    return (hashes >> np.uint64(max(0, 32 - (buckets - 1).bit_length()))).astype(np.uint32)


def _marks(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _candidates(chunk: _Chunk, levels: list[int], answers: list[dict[int, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows to judge at the level behind the last answer.

    ``answers`` has, for each level so far, every bucket's marks of the hashes found elsewhere too."""
    place, hashes = chunk.windows(levels[0])
    for k, marks in enumerate(answers):
        distinct, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
        repeated, edge = n > 1, _edges(distinct, buckets)
        for bucket, blob in marks.items():
            a, b = edge[bucket], edge[bucket + 1]
            repeated[a:b] |= _marks(blob, b - a)
        found = np.zeros(len(chunk.words) + 1, bool)
        found[place[repeated[inverse]]] = True
        place, hashes = _doubled(chunk, found, levels[k], levels[k + 1])
    return place, hashes


def _doubled(chunk: _Chunk, found: np.ndarray, short: int, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``long`` words that two found windows of ``short`` words cover."""
    place, hashes = chunk.windows(long)
    both = found[place] & found[place + long - short]
    return place[both], hashes[both]


def removals(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, with_text: bool = True) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_removed, kept_sha256 and kept_text for each row.

    A word goes if a window over it (``window`` words of one document) also
    starts in a document with a smaller id; windows are judged on the input.
    kept_sha256 is of the kept words joined by one space; kept_text holds the
    kept stretches as they were, joined by one space (null unless ``with_text``). Null texts have no words.
    Rows without an id neither lose words nor cause a loss; rows that share an
    id do not count as each other's earlier documents. Texts shorter than a
    window stay whole. An empty table gives an empty result. Other columns pass
    through; those named like a result are replaced.

    Equality of windows is equality of 64-bit hashes whose two halves' hashes
    were both found twice before.
    """
    docs = without(docs, RESULTS)
    others = [c for c in docs.columns if c != text]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks, buckets = max(1, -(-size // chunk_bytes)), max(16, -(-size // BUCKET_BYTES))
    levels = ladder(window)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks // CHUNKS_A_TASK)
    dealt = docs.withColumn("__chunk", F.pmod(F.xxhash64(doc_id, text), F.lit(chunks))).repartition(tasks, "__chunk")

    def chunk_of(table: pa.Table) -> _Chunk:
        return _Chunk(table.column(text), table.column(doc_id))

    def so_far(answers: pa.Table | None, level: int) -> list[dict[int, bytes]]:
        out: list[dict[int, bytes]] = [{} for _ in range(level)]
        if answers is not None:
            for k, bucket, blob in zip(*[answers.column(c).to_pylist() for c in ("level", "bucket", "marks")], strict=True):
                out[k][bucket] = blob
        return out

    def ask(level: int):
        def first(key, table):
            return later(key, table, None)

        def later(key, table, answers):
            _, hashes = _candidates(chunk_of(table), levels, so_far(answers, level), buckets)
            distinct = np.unique(hashes)
            return _packed(key[0].as_py(), distinct, buckets, prints=_prints(distinct, buckets))

        return later if level else first

    def mark(level: int):
        def answer(key, table):
            """Which fingerprints more than one chunk has sent."""
            parts = [np.frombuffer(x, np.uint32) for x in table.column("prints").to_pylist()]
            ordered = np.sort(np.concatenate(parts))
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            marks = []
            for own in parts:
                at = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
                marks.append(np.packbits(twice[at] == own if len(twice) else np.zeros(len(own), bool)).tobytes())
            return pa.table({"chunk": table.column("chunk"), "level": pa.array([level] * len(parts), pa.int32()), "bucket": table.column("bucket"), "marks": pa.array(marks, pa.binary())})

        return answer

    def ask_last(key, table, answers = None):
        chunk = chunk_of(table)
        place, hashes = _candidates(chunk, levels, so_far(answers, len(levels) - 1), buckets)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        least = np.full(len(distinct), _NO_ID)
        np.minimum.at(least, inverse, chunk.owner(place))
        return _packed(key[0].as_py(), distinct, buckets, hashes=distinct, least=least)

    def answer_least(key, table):
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        least = [np.frombuffer(x, np.int64) for x in table.column("least").to_pylist()]
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        smallest = np.full(len(distinct), _NO_ID)
        np.minimum.at(smallest, inverse, np.concatenate(least))
        edge, out = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]), {"hashes": [], "least": []}
        for own, mine, a, b in zip(hashes, least, edge[:-1], edge[1:], strict=True):
            best = smallest[inverse[a:b]]
            smaller = best < mine
            out["hashes"].append(own[smaller].tobytes())
            out["least"].append(best[smaller].tobytes())
        return pa.table({"chunk": table.column("chunk"), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    def finish(key, table, answers):
        chunk = chunk_of(table)
        place, hashes = chunk.windows(window)
        owner = chunk.owner(place)
        # the smallest id inside the chunk, then the smaller ones that other chunks hold
        distinct, inverse = np.unique(hashes, return_inverse=True)
        least = np.full(len(distinct), _NO_ID)
        np.minimum.at(least, inverse, owner)
        for blob, ids in zip(answers.column("hashes").to_pylist(), answers.column("least").to_pylist(), strict=True):
            at = np.searchsorted(distinct, np.frombuffer(blob, np.uint64))
            least[at] = np.minimum(least[at], np.frombuffer(ids, np.int64))
        gone = covered(len(chunk.words), place[(least[inverse] < owner) & (owner != _NO_ID)], window)
        results = _kept(chunk, gone, with_text)
        return pa.table([*[table.column(c) for c in others], *results], names=[*others, *RESULTS])

    def with_answers(answers: DataFrame | None, function: Callable, schema) -> DataFrame:
        chunked = dealt.groupBy("__chunk")
        return chunked.applyInArrow(function, schema) if answers is None else chunked.cogroup(answers.groupBy("chunk")).applyInArrow(function, schema)

    answers = None
    for level in range(len(levels) - 1):
        marks = with_answers(answers, ask(level), "chunk long, bucket long, prints binary").groupBy("bucket").applyInArrow(mark(level), "chunk long, level int, bucket long, marks binary")
        answers = marks if answers is None else answers.unionByName(marks)
    asked = with_answers(answers, (lambda key, table: ask_last(key, table)) if answers is None else ask_last, "chunk long, bucket long, hashes binary, least binary")
    smaller = asked.groupBy("bucket").applyInArrow(answer_least, "chunk long, hashes binary, least binary")
    schema = StructType([*[docs.schema[c] for c in others], *StructType.fromDDL(_TYPES).fields])
    return with_answers(smaller, finish, schema)


def _kept(chunk: _Chunk, gone: np.ndarray, with_text: bool) -> list[pa.Array]:
    """n_words, n_removed, kept_sha256 and kept_text of each document of a chunk."""
    lost = np.concatenate([[0], np.cumsum(gone)])
    n_lost = lost[chunk.first[1:]] - lost[chunk.first[:-1]]
    digests, texts, base = [], [], 0
    for a, b in slices(chunk.at):
        data, at = chunk.data[chunk.at[a] : chunk.at[b]], chunk.at[a : b + 1] - chunk.at[a]
        start, end, first = word_spans(data, at)
        raw = data.tobytes()
        for k in range(b - a):
            text = raw[at[k] : at[k + 1]]
            words = text.split()  # bytes are split at the same six characters as words are
            if n_lost[a + k]:
                i, j = first[k], first[k + 1]
                stay = ~gone[base + i : base + j]
                words = [w for w, keep in zip(words, stay.tolist(), strict=True) if keep]
                step = np.diff(np.concatenate([[0], stay.astype(np.int8), [0]]))
                begin, stop = start[i + np.flatnonzero(step == 1)], end[i + np.flatnonzero(step == -1) - 1]
                text = b" ".join(raw[x:y] for x, y in zip(begin.tolist(), stop.tolist(), strict=True))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            texts.append(text if with_text else None)
        base += len(start)
    return [pa.array(np.diff(chunk.first), pa.int64()), pa.array(n_lost, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())]


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut from their texts; documents that lose all their words go. ``n_chars`` is counted anew."""
    columns = docs.columns
    place = {c: f"c{k}" for k, c in enumerate(columns)}
    cut = removals(docs.toDF(*place.values()), window, place["text"], place["doc_id"]).filter("n_removed = 0 OR n_removed < n_words")
    new = {"text": F.col("kept_text")}
    if "n_chars" in columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col(place[c])).alias(c) for c in columns])
