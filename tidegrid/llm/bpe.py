"""Byte-level BPE on Spark's higher-order functions.

Each task cuts its texts at the split pattern and hands every distinct word on
once, ahead of the documents that use it. Native expressions then fold the
ranked merges over the word's bytes: the state holds the pieces so far and the
ranks of neighbouring pairs; a step joins the leftmost pair of lowest rank and
looks up two new ranks in a literal map. Decoding concatenates the ids' binary
pieces. Documents follow in the same partition as indices of words and are put
together behind the fold, so nothing is shuffled and only one task's words are
held at a time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidegrid.llm import pieces
from tidegrid.llm.common import bounded_batches, slices, text_bytes, without

#: Ids take 16 bits; a pair that no token joins has this rank.
NO_RANK = 1 << 16
#: Multipliers and sizes of the rank map's hashes.
SLOT, SHIFT, MIX_SLOT, MIX_SHIFT = 1 << 17, 1 << 15, 0x2545F491, 0x1B873593
#: Distinct words that a task holds before it starts anew.
MAX_WORDS = 1_200_000
#: Bytes of table files that one task reads at least, if the scan cuts them smaller.
TASK_BYTES = 128 << 20
#: Bytes of a word from which the fold's quadratic time is left to a library call on that word.
LONG_WORD = 1024
RESULTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pairs(path: str) -> dict[int, int]:
    """Rank of the joined token for every pair of ids, as left * 65536 + right."""
    own = ranks(path)
    return {own[t[:k]] << 16 | own[t[k:]]: rank for t, rank in own.items() for k in range(1, len(t)) if t[:k] in own and t[k:] in own}


@functools.cache
def rank_map(path: str) -> tuple[list[int], list[int]]:
    """The pairs' ranks as two arrays, so that a look-up is two array accesses: a pair's group says by how much its slot is shifted,
    and the slot holds pair and rank. Shifts are chosen so that no two pairs share a slot."""
    joined = pairs(path)
    groups: dict[int, list[int]] = {}
    for pair in joined:
        groups.setdefault((pair * MIX_SHIFT >> 20) % SHIFT, []).append(pair)
    slots, shifts = [(1 << 48) - 1] * SLOT, [0] * SHIFT
    for group, own in sorted(groups.items(), key=lambda g: -len(g[1])):
        first = [pair * MIX_SLOT >> 18 for pair in own]
        shift = next(d for d in range(SLOT) if len({(f + d) % SLOT for f in first}) == len(first) and all(slots[(f + d) % SLOT] == (1 << 48) - 1 for f in first))
        shifts[group] = shift
        for f, pair in zip(first, own, strict=True):
            slots[(f + shift) % SLOT] = pair << 16 | joined[pair]
    return slots, shifts


def _literal(values: list, kind: str) -> Column:
    """A constant array; parsed once, when the plan is made."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


class Merges:
    """Expressions over a rank file. A word's state is an array with one number per piece: the rank of the piece joined with the
    next one, where the piece begins, and its id. Its smallest number is the leftmost pair of lowest rank."""

    def __init__(self, path: str):
        own = ranks(path)
        if max(own.values()) >= NO_RANK or any(bytes([b]) not in own for b in range(256)):
            raise ValueError(f"{path} needs a rank below {NO_RANK} for every byte and token")
        slots, shifts = rank_map(path)
        self.slots, self.shifts = _literal(slots, "bigint"), _literal(shifts, "int")
        self.bytes = _literal([own[bytes([b])] for b in range(256)], "bigint")

    def rank(self, left: Column, right: Column) -> Column:
        """Rank of a pair of ids, or something from ``NO_RANK`` on."""
        pair = left * (1 << 16) + right
        shift = self.shifts[F.shiftright(pair * MIX_SHIFT, 20).bitwiseAND(F.lit(SHIFT - 1))]
        return self.slots[(F.shiftright(pair * MIX_SLOT, 18) + shift).bitwiseAND(F.lit(SLOT - 1))].bitwiseXOR(F.shiftleft(pair, 16))

    def _piece(self, left: Column, right: Column, rest: Column) -> Column:
        return F.shiftleft(F.least(self.rank(left, right), F.lit(NO_RANK).cast("long")), 36) + rest  # least skips the null of a pair without a right side

    def start(self, word: Column) -> Column:
        """Every byte is a piece."""
        return F.transform(word, lambda b, i: self._piece(self.bytes[b], self.bytes[F.get(word, i + 1)], i.cast("long") * (1 << 16) + self.bytes[b]))

    def step(self, s: Column, _: Column) -> Column:
        """Join the leftmost pair of lowest rank, if any pair has one."""

        def at(i: Column) -> Column:
            here = F.element_at(s, i)
            joined, before = F.shiftright(here, 36), F.element_at(s, F.greatest(i - 1, F.lit(1)))
            following = F.get(s, i + 1).bitwiseAND(F.lit(NO_RANK - 1))
            merged = self._piece(joined, following, here.bitwiseAND(F.lit((1 << 36) - NO_RANK)) + joined)
            earlier = self._piece(before.bitwiseAND(F.lit(NO_RANK - 1)), joined, before.bitwiseAND(F.lit((1 << 36) - 1)))
            new = F.when(i > 1, F.array(earlier, merged)).otherwise(F.array(merged))
            rebuilt = F.concat(F.slice(s, F.lit(1), F.greatest(i - 2, F.lit(0))), new, F.slice(s, i + 2, F.size(s)))
            return F.when(joined >= NO_RANK, s).otherwise(rebuilt)

        return F.transform(F.array(F.array_position(s, F.array_min(s)).cast("int")), at)[0]

    def ids(self, word: Column, whole: Column) -> Column:
        """Ids of a word given as an array of bytes; ``whole`` is its rank where the whole word is a token."""
        folded = F.aggregate(F.sequence(F.lit(2), F.size(word)), self.start(word), self.step)
        several = F.transform(folded, lambda e: e.bitwiseAND(F.lit(NO_RANK - 1)).cast("int"))
        return F.when(whole.isNotNull(), F.array(whole)).when(F.size(word) > 1, several)


def encoded(words: DataFrame, path: str) -> DataFrame:
    """``words`` (word as an array of bytes, whole) with ``ids``; null for null words and for those longer than ``LONG_WORD``."""
    short = F.col("word").isNotNull() & (F.size("word") <= LONG_WORD)
    return words.withColumn("ids", F.when(short, Merges(path).ids(F.col("word"), F.col("whole"))))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit numbers) and decoded_sha256.

    Null counts as empty; an empty text has no ids. Texts are read whole; repeated rows get repeated results. Input columns named
    like a result are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = _fewer(without(docs, RESULTS))
    others = [c for c in docs.columns if c != text]
    held = StructType([StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(others)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks(path)
        seen: dict[str, int] = {}
        number = 0  # of the word table
        for batch in batches:
            column = batch.column(text)
            _, at = text_bytes(column)
            for a, b in slices(at, 1 << 20):
                if len(seen) > MAX_WORDS:
                    seen, number = {}, number + 1
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                joined, start, end, first = pieces.byte_level(texts)
                known = len(seen)
                refs = np.fromiter((seen.setdefault(joined[x:y], len(seen)) for x, y in zip(start.tolist(), end.tolist(), strict=True)), np.int32, len(start))
                new = [w.encode("utf-8", "surrogatepass") for w in itertools.islice(reversed(seen), len(seen) - known)][::-1]
                yield rows_of(batch, range(0), number, new, [own.get(w) for w in new], [])
                yield rows_of(batch, range(a, b), number, [], [], [refs[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)])

    def rows_of(batch: pa.RecordBatch, rows: range, number: int, words: list[bytes], whole: list[int | None], refs: list[bytes]) -> pa.RecordBatch:
        n, m = len(words), len(refs)
        carried = [pa.concat_arrays([pa.nulls(n, batch.schema.field(c).type), batch.column(c).slice(rows.start, m)]) if m else pa.nulls(n, batch.schema.field(c).type) for c in others]
        edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int32, n))]).astype(np.int32)
        bytes_ = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [*carried, pa.concat_arrays([bytes_, pa.nulls(m, bytes_.type)]), pa.array(whole + [None] * m, pa.int32()), pa.array([number] * (n + m), pa.int32()), pa.array([None] * n + refs, pa.binary())],
            [*held.names, "word", "whole", "number", "refs"],
        )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(path)
        for batch in batches:
            numbers = batch.column("number").to_numpy()
            is_word = batch.column("word").is_valid().to_numpy(zero_copy_only=False)
            for number in np.unique(numbers):  # tables follow one another
                own = numbers == number
                table.add(int(number), batch.filter(pa.array(own & is_word)))
                part = batch.filter(pa.array(own & ~is_word))
                n, digests, decoded = [], [], []
                for blob in part.column("refs").to_pylist():
                    refs = np.frombuffer(blob, np.int32).tolist()
                    ids = b"".join(map(table.ids.__getitem__, refs))
                    n.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(table.decoded.__getitem__, refs))).hexdigest())
                if n:
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in held.names], pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], [*others, *RESULTS])

    between = StructType([*held.fields, *StructType.fromDDL("word array<int>, whole int, number int, refs binary").fields])
    after = StructType([*[docs.schema[c] for c in others], StructField(RESULTS[0], LongType()), *[StructField(r, StringType()) for r in RESULTS[1:]]])
    return encoded(docs.mapInArrow(cut, between), path).mapInArrow(assemble, after)


class _Table:
    """Ids (little-endian bytes) and decoded bytes of a task's words, in the order of their numbers."""

    def __init__(self, path: str):
        self.path, self.number, self.single = path, -1, None
        self.tokens = {rank: token for token, rank in ranks(path).items()}
        self.ids: list[bytes] = []
        self.decoded: list[bytes] = []

    def add(self, number: int, words: pa.RecordBatch) -> None:
        if number != self.number:
            self.number, self.ids, self.decoded = number, [], []
        ids = words.column("ids")
        edge = ids.offsets.to_numpy().tolist()
        flat = ids.values.to_numpy(zero_copy_only=False)
        raw, tokens = flat.astype("<u4").tobytes(), list(map(self.tokens.__getitem__, flat.tolist()))
        known = len(self.ids)
        self.ids += [raw[4 * a : 4 * b] for a, b in itertools.pairwise(edge)]
        self.decoded += [b"".join(tokens[a:b]) for a, b in itertools.pairwise(edge)]
        for k in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)).tolist():
            self.single = self.single or _library(self.path)
            found, self.decoded[known + k] = self.single(bytes(words.column("word")[k].as_py()))
            self.ids[known + k] = np.array(found, "<u4").tobytes()


def _fewer(docs: DataFrame) -> DataFrame:
    """Scan partitions put together to about ``TASK_BYTES``, as a word table pays off with the text it serves."""
    spark = docs.sparkSession
    read = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = "".join(c for c in read if c.isdigit())
    most = int(digits) * next((v for k, v in scale.items() if k in read.lower()), 1)
    n = docs.rdd.getNumPartitions()
    few = max(spark.sparkContext.defaultParallelism, -(-n * most // TASK_BYTES))
    return docs.coalesce(few) if few < n else docs


def _library(path: str):
    """Ids and their bytes of one very long word, from the library whose results these are."""
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})

    def one(word: bytes) -> tuple[list[int], bytes]:
        ids = encoding._encode_single_piece(word)
        return ids, encoding.decode_bytes(ids)

    return one
