"""Language identification by prediction by partial matching.

One byte context tree per language (contexts of up to three bytes) with escape
probabilities by distinct-symbol counts (method C) and full exclusion. The
statistics are frozen after training, so the code length of a byte depends on
its last three bytes only. That turns scoring into two table look-ups per byte
for all languages at once, and a text's exact code length is their sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import bounded_batches, slices, text_bytes, without

UNKNOWN = "und"
RESULTS = ["lang_pred", "score", "bits_per_byte"]
_NEWLINE = 10
DRAWN_CHARS = 20_000
MAX_CONTEXTS = 20_000


def held_out(doc_id) -> F.Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _shifted(values: np.ndarray, at: np.ndarray, by: int, fill: int) -> np.ndarray:
    """values[i - by] within each text; a text begins as after line breaks."""
    out = np.full(len(values), fill, values.dtype)
    out[by:] = values[:-by] if by else values
    for k in range(by):
        edge = at[:-1] + k
        out[edge[edge < at[1:]]] = fill
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over (lang, text): how often three bytes of context are followed by a byte, as one number of 32 bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            data, at = text_bytes(batch.column("text"))
            for a, b in slices(at):
                part, own = data[at[a] : at[b]].astype(np.uint32), at[a : b + 1] - at[a]
                if not len(part):
                    continue
                code = part | _shifted(part, own, 1, _NEWLINE) << 8 | _shifted(part, own, 2, _NEWLINE) << 16 | _shifted(part, own, 3, _NEWLINE) << 24
                of = np.repeat(np.arange(b - a), np.diff(own))
                for lang in sorted(set(langs[a:b])):
                    grams, n = np.unique(code[(langs[a:b] == lang)[of]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class ContextTrees:
    languages: list[str]
    symbol: np.ndarray  # byte to symbol; bytes never seen share the last one
    state: np.ndarray  # three symbols to the longest known context
    bits: np.ndarray  # context, symbol, language: code length

    @classmethod
    def build(cls, rows: list[tuple[str, int, int]], max_contexts: int = MAX_CONTEXTS) -> ContextTrees:
        languages = sorted({r[0] for r in rows})
        which = {x: k for k, x in enumerate(languages)}
        lang = np.array([which[r[0]] for r in rows], np.int64)
        gram = np.array([r[1] for r in rows], np.int64)
        n = np.array([r[2] for r in rows], np.float64)
        seen = np.unique(np.concatenate([gram >> s & 255 for s in (0, 8, 16, 24)] + [np.array([_NEWLINE])]))
        size = len(seen) + 1
        symbol = np.full(256, size - 1, np.int32)
        symbol[seen] = np.arange(len(seen))
        nxt, p1, p2, p3 = (symbol[gram >> s & 255].astype(np.int64) for s in (0, 8, 16, 24))
        # contexts of each order; of the longest, the most frequent ones
        keys = [np.zeros(len(gram), np.int64), p1, p2 * size + p1, (p3 * size + p2) * size + p1]
        table = np.zeros(1, np.int32)
        parents, counts, base = [np.zeros(1, np.int32)], [], 1
        for order, key in enumerate(keys):
            known, inverse = np.unique(key, return_inverse=True)
            if order:
                weight = np.bincount(inverse, n)
                if len(known) > max_contexts:
                    kept = np.sort(np.argsort(-weight, kind="stable")[:max_contexts])
                    place = np.full(len(known), -1)
                    place[kept] = np.arange(len(kept))
                    known, inverse = known[kept], place[inverse]
                shorter = np.tile(table, size)  # the first symbol of a context is its most significant digit
                parents.append(shorter[known])
                table = shorter.copy()
                table[known] = base + np.arange(len(known), dtype=np.int32)
                ids, base = base + inverse, base + len(known)
            else:
                ids = inverse
            counts.append((ids, inverse >= 0))
        parent = np.concatenate(parents)
        bits = np.zeros((base, size, len(languages)), np.float32)
        order_of = np.concatenate([[0], *[np.full(len(p), k + 1) for k, p in enumerate(parents[1:])]])
        for l in range(len(languages)):
            c = np.zeros((base, size))
            for ids, valid in counts:
                own = valid & (lang == l)
                np.add.at(c, (ids[own], nxt[own]), n[own])
            bits[:, :, l] = -np.log2(_probabilities(c, parent, order_of))
        return cls(languages, symbol, table, bits)

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits that each text takes under each language; ``at`` as of ``text_bytes``."""
        size = self.bits.shape[1]
        s = self.symbol[data]
        fill = int(self.symbol[_NEWLINE])
        context = (_shifted(s, at, 3, fill) * size + _shifted(s, at, 2, fill)) * size + _shifted(s, at, 1, fill)
        rows = self.bits.reshape(-1, len(self.languages))[self.state[context].astype(np.int64) * size + s]
        out = np.zeros((len(at) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(at))
        if len(full):
            out[full] = np.add.reduceat(rows, at[full], axis=0, dtype=np.float64)
        return out


def _probabilities(c: np.ndarray, parent: np.ndarray, order_of: np.ndarray) -> np.ndarray:
    """P(symbol | context) for all contexts; what a longer context has seen is excluded below it."""
    p, q = np.zeros_like(c), np.zeros_like(c)
    n, d = c.sum(1), (c > 0).sum(1)
    rest = 1.0 / (256 - d[0])
    q[0] = rest
    p[0] = np.where(c[0] > 0, c[0] / max(n[0] + d[0], 1), (d[0] / (n[0] + d[0]) if n[0] else 1.0) * rest)
    for order in range(1, int(order_of.max()) + 1):
        at = np.flatnonzero(order_of == order)
        up, own = parent[at], c[at] > 0
        left = np.where(own, 0, c[up])
        seen = left > 0
        total, kinds = left.sum(1), seen.sum(1)
        whole = np.maximum(total + kinds, 1)
        escape = np.where(total > 0, kinds / whole, 1.0)
        q[at] = np.where(seen, left / whole[:, None], escape[:, None] * q[up])
        whole = np.maximum(n[at] + d[at], 1)
        escape = np.where(n[at] > 0, d[at] / whole, 1.0)
        p[at] = np.where(own, c[at] / whole[:, None], escape[:, None] * q[at])
    return np.maximum(p, 1e-300)


def train(docs: DataFrame, train_chars: int = 1_000_000, doc_id: str = "doc_id", max_contexts: int = MAX_CONTEXTS) -> ContextTrees | None:
    """Context trees from (doc_id, text, lang) of the rows that are not held out and have a language.

    A language of at most ``train_chars`` characters is learned whole. Of a larger
    one, stretches of ``DRAWN_CHARS`` characters (shorter texts whole) are drawn by a
    hash of id and place, so that ``train_chars`` is the expected size of the sample;
    the stretch with the smallest hash is always in it, and with it its exact
    copies. So every language is learned. The counting runs on Spark. Of each
    order's contexts the trees keep the ``max_contexts`` most frequent ones over all
    languages; rarer ones fall back to the next shorter context. None if there is
    nothing to learn from.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id", F.lit("train")))
    rows = rows.withColumn("own", own).withColumn("stretches", F.sequence(F.lit(0), F.floor((F.length("text") - 1) / DRAWN_CHARS).cast("int")))

    def place(k):
        return F.pmod(F.when(k == 0, F.col("own")).otherwise(F.xxhash64("own", k)), F.lit(1 << 30))

    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("lang").agg(F.sum(F.length("text")), F.min(F.array_min(F.transform("stretches", place)))).collect()}
    if not sizes:
        return None
    limits = {lang: max(int(train_chars / size * (1 << 30)), least + 1) for lang, (size, least) in sizes.items() if size > train_chars}
    below = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")] if limits else F.lit(None)
    rows = rows.withColumn("below", below.cast("long"))
    drawn = rows.withColumn("stretches", F.when(F.col("below").isNull(), F.array(F.lit(-1))).otherwise(F.filter("stretches", lambda k: place(k) < F.col("below"))))
    drawn = drawn.filter(F.size("stretches") > 0).select("lang", "text", F.explode("stretches").alias("k"))
    counts = gram_counts(drawn.select("lang", F.when(F.col("k") < 0, F.col("text")).otherwise(F.substring("text", F.col("k") * DRAWN_CHARS + 1, F.lit(DRAWN_CHARS))).alias("text"))).collect()
    return ContextTrees.build([tuple(r) for r in counts], max_contexts) if counts else None


def identify(docs: DataFrame, model: ContextTrees | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (posterior of the language under equal priors) and bits_per_byte of the best language.

    Texts that are null, empty or without a letter get ``und``, score 0 and null
    bits; so does every text if there is no model. Input columns named like a
    result are replaced. One narrow pass, no shuffle; memory is bounded by slices
    of whole texts. Repeated rows get repeated results.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = without(docs, RESULTS)
    shared = spark.sparkContext.broadcast(model)  # bounded by train_chars and max_contexts

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: ContextTrees | None = shared.value
        for batch in batches:
            column = batch.column(text)
            data, at = text_bytes(column)
            n = len(at) - 1
            pred, sure, rate = [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan)
            if trees is not None:
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
                for a, b in slices(at, 1 << 20):
                    own = at[a : b + 1] - at[a]
                    bits = trees.code_lengths(data[at[a] : at[b]], own)
                    best = bits.argmin(1)
                    least = bits[np.arange(b - a), best]
                    posterior = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
                    for k in np.flatnonzero(letters[a:b]):
                        pred[a + k], sure[a + k], rate[a + k] = trees.languages[best[k]], posterior[k], least[k] / (own[k + 1] - own[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(sure), pa.array(rate, mask=np.isnan(rate))], [*batch.schema.names, *RESULTS])

    fields = ", ".join(f"{name} {kind}" for name, kind in zip(RESULTS, ("string", "double", "double"), strict=True))
    return docs.mapInArrow(score, _schema(docs, fields))


def _schema(docs: DataFrame, extra: str):
    from pyspark.sql.types import StructType

    return StructType([*docs.schema.fields, *StructType.fromDDL(extra).fields])


def accept(docs: DataFrame, model: ContextTrees | None, least_score: float = 0.5) -> DataFrame:
    """Documents whose language is known with at least ``least_score``, with their own columns only."""
    columns = docs.columns
    renamed = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    scored = identify(renamed, model, text=f"c{columns.index('text')}")
    return scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
