"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A batch of inserts, deletes and revised counts becomes signed rows: what a
document counted before with a minus, what it counts now with a plus. Signed
rows add up, so totals are sums of small per-batch deltas and nothing is
counted twice. Every attempt at a batch writes a folder of its own and is
published by one small row of the table of commits, which names the attempt. So
readers see a batch whole or not at all, a ledger opened anew finds what others
have committed, and a repeated commit gives the same rows, since a batch looks
only at batches before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidegrid.llm import bpe, pieces
from tidegrid.llm.common import bounded_batches, slices, text_bytes

KEYS = ["source", "lang", "tokenizer"]
MAX_CACHED = 1_000_000
BUCKETS = 16
COMMITS = "batch long, seq long, attempt string, base boolean"


class _Counts(dict):
    """Tokens of each word of the split pattern under a rank file; one table per worker."""

    _CACHE: dict[str, _Counts] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str) -> _Counts:
        if path not in cls._CACHE:
            cls._CACHE[path] = cls(path)
        return cls._CACHE[path]

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_CACHED:
            self.clear()
        n = self[word] = len(self.encode(word))
        return n


def counted(docs: DataFrame, path: str, text: str = "text", name: str = "tokens") -> DataFrame:
    """``docs`` without ``text``, with the tokens of each whole text under a rank file. Null counts as empty: no tokens."""
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts.of(path)
        for batch in batches:
            column = batch.column(text)
            _, at = text_bytes(column)
            out = []
            for a, b in slices(at, 1 << 20):
                joined, start, end, first = pieces.byte_level([t or "" for t in column.slice(a, b - a).to_pylist()])
                each = np.fromiter(map(counts.__getitem__, map(joined.__getitem__, map(slice, start.tolist(), end.tolist()))), np.int64, len(start))
                total = np.concatenate([[0], np.cumsum(each)])
                out.append(total[first[1:]] - total[first[:-1]])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], [*others, name])

    return docs.mapInArrow(run, StructType([*[docs.schema[c] for c in others], StructField(name, LongType())]))


class TokenLedger:
    """Signed rows per document and their totals per batch, below ``path`` in the shared store. One writer at a time.

    ``buckets`` cuts the signed rows by a hash of the document's id; a batch reads earlier rows only in the buckets of its documents.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _commits(self) -> dict[int, tuple[int, str, bool]]:
        """The last commit of each batch from the newest base on: batch to (seq, attempt, base). One small row a commit."""
        try:
            rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").orderBy("seq").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        last = {r.batch: (r.seq, r.attempt, r.base) for r in rows}
        start = max((b for b, c in last.items() if c[2]), default=None)
        return {b: c for b, c in last.items() if start is None or b >= start}

    @property
    def batches(self) -> list[int]:
        """Committed batches since the last compaction, that included."""
        return sorted(self._commits())

    def _read(self, kind: str, commits: dict[int, tuple[int, str, bool]]) -> DataFrame | None:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{kind}/{attempt}") for _, attempt, _ in commits.values()]) if commits else None

    def _bucket(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.buckets)).cast("int")

    def _publish(self, batch: int, rows: DataFrame, base: bool = False) -> None:
        """Write signed rows and their totals below a new name, then name it in the table of commits."""
        attempt = f"{batch}-{uuid.uuid4().hex[:12]}"
        rows = rows.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")
        rows = rows.withColumn("bucket", self._bucket(F.col("doc_id"))).repartition(F.col("bucket"))
        rows.write.partitionBy("bucket").parquet(f"{self.path}/ledger/{attempt}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/ledger/{attempt}")
        written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/deltas/{attempt}")
        seq = max((c[0] for c in self._commits().values()), default=-1) + 1
        self.spark.createDataFrame([(batch, seq, attempt, base)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Apply (op, doc_id, source, lang, tokenizer, tokens) as batch ``batch``.

        ``insert`` and ``revise`` give a document's present count under a
        tokenizer, ``delete`` none. All three take back what earlier batches
        hold for (doc_id, tokenizer), with null ids as an id of their own.
        Several rows of one document in one batch all count. Rows without a
        token count count as 0 tokens. Unknown operations fail and change
        nothing. A batch that a compaction has taken in stays as it was.
        """
        commits = self._commits()
        if any(base and batch <= b for b, (_, _, base) in commits.items()):
            return
        known = F.col("op").isin("insert", "revise", "delete")
        changes = changes.withColumn("op", F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null"))))))
        tokens = F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
        now = changes.filter("op <> 'delete'").select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), tokens.alias("tokens"))
        before = self._read("ledger", {b: c for b, c in commits.items() if b < batch})
        if before is not None:
            touched = changes.select(self._bucket(F.col("doc_id")).alias("b"), F.col("doc_id").alias("id"), F.col("tokenizer").alias("version")).distinct()
            match = (before["bucket"] == touched["b"]) & before["doc_id"].eqNullSafe(touched["id"]) & before["tokenizer"].eqNullSafe(touched["version"])
            held = before.join(touched, match, "left_semi")
            now = now.unionByName(held.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        self._publish(batch, now)

    def compact(self) -> None:
        """Replace all batches by their sum, under the name of the last one. What no commit names any more may be deleted later."""
        commits = self._commits()
        if len(commits) > 1:
            self._publish(max(commits), self._read("ledger", commits).drop("bucket"), base=True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; groups without documents left are not listed."""
        deltas = self._read("deltas", self._commits())
        if deltas is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")
