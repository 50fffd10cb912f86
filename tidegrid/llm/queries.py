"""Registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, collocations, html, language, license, negatives, ngramjoin, packing, quality, simhash, substring, tokencounts, topk
from tidegrid.llm.common import materialise, scratch
from tidegrid.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def _leads(n: int) -> str:
    """The next ``n`` words in a window named o, as one string; null where fewer are left."""
    return " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, n)]])


@query("op1_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _license_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split(' ')!r}, {label!r})" for p, label in license.PHRASES.items())
    sets = [(label, license.template_words(text)) for label, text in license.TEMPLATES]
    templates = ", ".join(f"({label!r}, {license.FAMILIES.get(label, str(k))!r}, {ws!r}, {license.needed(len(ws))}, {license.MARKS.get(label, [''])!r})" for k, (label, ws) in enumerate(sets))
    half = license.SPAN // 2
    return rf"""
    WITH d AS (SELECT doc_id, {lower} AS t, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    ph(p, label) AS (VALUES {phrases}),
    tp(label, family, p, need, asked) AS (VALUES {templates}),
    u AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d WHERE len(list_intersect(w, ['license', 'cc'])) > 0),
    b AS (SELECT doc_id, label, i FROM u JOIN ph ON list_slice(w, i + 1, i + len(p)) = p),
    bs AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY doc_id),
    bl AS (SELECT doc_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM
           (SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n[ \t\r]*\n'))) AS x FROM d)),
    sp AS (SELECT row_number() OVER () AS span, doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM (
           SELECT doc_id, list_slice(w, i + 1, i + {license.SPAN}) AS w FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {half}, 1), {half})) AS i FROM bl))),
    m AS (SELECT span, doc_id, family, label, len(list_intersect(p, w)) AS shared, len(p) AS size FROM sp, tp WHERE len(list_intersect(p, w)) >= need
          AND (asked = [''] OR len(list_filter(asked, lambda x: contains(joined, ' ' || x || ' '))) > 0) QUALIFY rank() OVER (PARTITION BY span, family ORDER BY shared + (asked <> [''])::INTEGER DESC) = 1),
    ms AS (SELECT doc_id, list(DISTINCT label) AS found, max(shared / size) AS share FROM m GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
    FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN ms USING (doc_id)
    """


@query("op2_license_scan", _license_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


@query(
    "op3_substring_dedup",
    rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d),
    s AS (SELECT doc_id, k AS i, {_leads(13)} AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
    m AS (SELECT g, min(doc_id) AS least FROM s WHERE g IS NOT NULL GROUP BY g HAVING min(doc_id) < max(doc_id)),
    r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM s JOIN m USING (g) WHERE least < doc_id),
    x AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY doc_id),
    k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) AS kept FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.k = u.k WHERE r.k IS NULL GROUP BY u.doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.removals(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


_LINE_WORDS = r"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))"
_LINE_SYMBOLS = "(len(x) - len(regexp_replace(x, '[#*$%&|<>]', '', 'g')))"
_BARS = "(len(x) - len(replace(x, '|', '')))"
_ASCII_LOWER = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NOTICE = " OR ".join(f"contains({_ASCII_LOWER}, '{n}')" for n in quality.NOTICES)


@query(
    "op6_quality_rules",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                      string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d),
    p AS (SELECT doc_id, k AS i, {_leads(8)} AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
    s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p WHERE g IS NOT NULL),
    r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM s WHERE n > 1) GROUP BY doc_id),
    l AS (SELECT doc_id, x, count(*) AS times FROM (SELECT doc_id, unnest(ls) AS x FROM d) WHERE {_LINE_WORDS} > 0 GROUP BY doc_id, x),
    f AS (SELECT doc_id, sum(times - 1) AS n_dup_lines,
                 sum(CASE WHEN ({_LINE_SYMBOLS} > 0 AND 100 * {_LINE_SYMBOLS} > {quality.MAX_SYMBOLS} * len(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')))
                            OR ({_BARS} >= {quality.MENU_ITEMS} AND {_LINE_WORDS} - {_BARS} <= {quality.MENU_WORDS} * ({_BARS} + 1))
                            OR ({_LINE_WORDS} <= {quality.NOTICE_WORDS} AND ({_NOTICE})) THEN times * {_LINE_WORDS} ELSE 0 END) AS n_lost_words
          FROM l GROUP BY doc_id),
    a AS (SELECT doc_id, len(w) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                 len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words
          FROM d LEFT JOIN r USING (doc_id) LEFT JOIN f USING (doc_id))
    SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
           NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words) AND 100 * n_lost_words <= {quality.MAX_LOST} * n_words AS kept
    FROM a
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).select("doc_id", *[c for c in quality.RESULTS if c != "cleaned"])


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_bestfit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), added_tokens=True)


@query(
    "op8_topk",
    f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= {topk.K}
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter with their bytes as a first estimate, which the next batch revises to exact token counts. That is committed
    twice, the second time by a ledger opened anew, as after a lost acknowledgement."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.octet_length("text").cast("long").alias("bytes"), "text")
    counts = materialise(tokencounts.counted(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), "counts")
    path = scratch(spark, "token-ledger")
    keys = ["doc_id", "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer")]
    tokencounts.TokenLedger(spark, path).commit(0, counts.select(F.lit("insert").alias("op"), *keys, F.col("bytes").alias("tokens")))
    for _ in range(2):
        ledger = tokencounts.TokenLedger(spark, path)
        ledger.commit(1, counts.select(F.lit("revise").alias("op"), *keys, "tokens"))
    return ledger.totals()


_COLLOCATIONS = rf"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT row_number() OVER () AS piece, lang, x FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
    w AS (SELECT lang, piece, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM p),
    u AS (SELECT lang, piece, unnest(ws) AS w1, unnest(range(len(ws))) AS k FROM w),
    t AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY piece ORDER BY k)),
    s AS (SELECT lang, count(*) AS n FROM u GROUP BY lang),
    f1 AS (SELECT lang, w1, count(*) AS f FROM t GROUP BY ALL),
    f2 AS (SELECT lang, w1, w2, count(*) AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {collocations.MIN_COUNT}),
    f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {collocations.MIN_COUNT}),
    c2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
           WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= {collocations.COVER} * f2.f)
             AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= {collocations.COVER} * f2.f)),
    c3 AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
           UNION ALL
           SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 2 FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
    c AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c3)),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM b JOIN s ON s.lang = b.lang QUALIFY rank <= {collocations.TOP}
    """


@query("op11_collocations", _COLLOCATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("text", "lang"))


_NEGATIVES = f"""
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}),
    n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
          FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN {negatives.LOW} * positive_score AND {negatives.HIGH} * positive_score)
    SELECT * FROM n WHERE rank <= {negatives.NEGATIVES}
    """


@query("op12_hard_negatives", _NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.scaled(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))
    return negatives.mine(vectors, vectors.filter("vec_id % 50 = 0"))


_NGRAM_JOIN = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d),
    g AS (SELECT DISTINCT doc_id, s FROM (
          SELECT doc_id, {_leads(3)} AS s FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY k)
          UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2) WHERE s IS NOT NULL),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= {ngramjoin.SIMILAR} * (nx.n + ny.n - o)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """


@query("op13_ngram_join", _NGRAM_JOIN)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))
