"""Operators that compare documents: substring dedup, SimHash, top-k, and the pipeline."""

import math
import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import common, simhash, substring, topk

from corpus_fixtures import SMALL, clashing, documents  # noqa: F401
from test_nearcopies import _components as jaccard_components

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))


def _passages(seed, n=60, size=40, vocabulary=30):
    """Texts over a small vocabulary that share passages of 5 to 40 words."""
    rng = random.Random(seed)
    bag = [f"v{k}" for k in range(vocabulary)]
    shared = [[rng.choice(bag) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for k in range(n):
        ws = [f"u{k}_{i}" if rng.random() < 0.7 else rng.choice(bag) for i in range(size)]
        at = rng.randint(0, size)
        rows.append((rng.randint(0, 80), rng.choice([" ", "  ", "\n"]).join(ws[:at] + rng.choice(shared) + ws[at:])))
    return rows


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "few words"), (5, LONG), (6, LONG), (None, LONG), (7, "few words"), (7, "few words"), (8, "12 words is one too few for any window here at all")]


@pytest.mark.parametrize(("seed", "window", "chunk"), [(1, 13, 1 << 20), (2, 13, 300), (3, 5, 500), (4, 30, 400)])
def test_substring_dedup(documents, clashing, seed, window, chunk):
    rows = _passages(seed) + (ODD if seed == 2 else [])
    want = [(d, n, gone, digest) for d, n, gone, digest, _ in plain.removals(rows, window)]
    out = substring.removals(clashing(documents(rows, 3)), window, chunk_bytes=chunk).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()
    assert sorted([tuple(r)[:4] for r in out], key=str) == sorted(want, key=str)
    left = sorted([" ".join(plain.words(r.kept_text)) for r in out])
    assert left == sorted(" ".join(x[4]) for x in plain.removals(rows, window))
    assert sum(x[2] for x in want) > 0


def test_substring_stage(spark, documents, clashing):
    rows = [(1, "a b c d e f g h i j k l m n\n\nlast one"), (2, "start\n a b c d e f g h i j k l m n  end two"), (3, "a b c d e f g h i j k l m n"), (4, None), (5, "")]
    docs = clashing(documents(rows))
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (rows[0][1], len(rows[0][1])), 2: ("start end two", 13), 4: ("", 0), 5: ("", 0)}
    assert substring.removals(spark.createDataFrame([], EMPTY)).count() == 0
    assert substring.ladder(13) == [7, 13] and substring.ladder(50) == [7, 13, 25, 50] and substring.ladder(5) == [5]


def test_fingerprints(documents):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["Ab", "c", "É", "d\x0be", "f"]) for _ in range(rng.choice([0, 1, 2, 3, 9, 700])))) for k in range(40)] + [(100, None), (101, LONG)]
    got = {r.doc_id: r.fingerprint % (1 << 64) for r in simhash.fingerprints(documents(rows)).select("doc_id", "fingerprint").collect()}
    assert got == {k: plain.fingerprint(t) for k, t in rows}


def _codes(seed, n, spread):
    """Codes around a few centres, at 0 to ``spread`` bits from them."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)] + [0]
    out = set()
    while len(out) < n:
        code = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, spread)):
            code ^= 1 << b
        out.add(code)
    return sorted(out)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_gray_index_finds_all_pairs(k):
    codes = np.array(_codes(k, 400, 4), np.uint64)
    index = simhash.GrayIndex(codes)
    q, c = index.search(codes, k)
    want = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= k)
    assert sorted(zip(q.tolist(), c.tolist())) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize(("spread", "group_rows"), [(3, 4096), (3, 8), (9, 8)])
def test_classes_are_all_links(spread, group_rows, spark, monkeypatch):
    monkeypatch.setattr(simhash, "links", lambda nodes, k, f=simhash.links: f(nodes, k, group_rows))
    codes = _codes(spread, 300, spread)
    rows = [(1000 - i, c) for i, c in enumerate(codes)] + [(2000, codes[0]), (2000, codes[0]), (None, codes[1]), (None, 0xFFFF)]
    want = sorted(zip([d for d, _ in rows], plain.components(rows)), key=str)
    signed = [(d, c - (1 << 64) if c >> 63 else c) for d, c in rows]
    marked = spark.createDataFrame(signed, "doc_id long, fingerprint long")
    got = marked.join(simhash.classes(marked), "fingerprint").select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_near_duplicates(spark, documents, clashing):
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(5, base), (3, base + " more"), (9, base.upper()), (1, None), (2, ""), (4, "something else entirely over here"), (4, "something else entirely over here"), (None, base), (6, LONG)]
    docs = clashing(documents(rows))
    out = sorted([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()], key=str)
    prints = [(d, plain.fingerprint(t)) for d, t in rows]
    assert out == sorted([(d, f"{f:016x}", c) for (d, f), c in zip(prints, plain.components(prints))], key=str)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in {c for c in plain.components(prints)} | {None})
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 299), (299, 300), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 299: 299, 300: 299}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, [rng.choice([-1, 0, 0.5, rng.uniform(-1, 1)]) for _ in range(6)]) for k in range(300)]
    rows += [(400, None), (401, [0.1, None, 0, 0, 0, 0]), (402, [float("nan")] + [0.0] * 5), (403, [float("inf")] * 6), (420, [1.0, 2.0]), (421, [2.0, 1.0]), (None, [1.0] * 6), (440, []), (500, [1e7] * 6), (520, [1e7] * 5 + [-9999999.0])]
    rows += [(600 + k, [0.5] * 6) for k in range(60)]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).repartition(3)
    want = plain.top_k(rows)
    for shard, block, leaf in ((4096, 1024, 64), (40, 7, 4)):
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        monkeypatch.setattr(topk, "LEAF", leaf)
        monkeypatch.setattr(topk, "SUPER", 2)
        assert sorted(tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()) == want
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [4096, 15])
def test_top_k_beyond_longs(spark, monkeypatch, shard):
    """Scores that no long holds are ranked exactly, ties by id, and cut to the ends of a long."""
    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 1.0, -1.0, 1e200, -1e200, 1e154, 3e200, rng.gauss(0, 1)]) for _ in range(3)]) for k in range(60)]
    rows += [(100, [1e200, 1e200, 0.0]), (101, [1e200, 1e200, 0.0]), (102, [1.7e308, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    ints = {k: [math.floor(64 * x) for x in v] for k, v in rows if k is not None and max(map(abs, v)) < 1e306}
    want = []
    for q in (k for k in ints if k % 20 == 0):
        ranked = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), k) for k, v in ints.items() if k != q)[:20]
        want += [(q, i, k, max(min(-s, 2**63 - 1), -(2**63))) for i, (s, k) in enumerate(ranked, 1)]
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "LEAF", 4)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# --- the pipeline against plain versions, stage by stage -----------------------


def test_pipeline(spark):
    import corpus_pipeline
    from tidegrid.llm import language

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}

    out = stages["language"](spark, docs, SMALL)
    assert out.columns == columns
    scored = language.identify(docs, language.train(docs))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in scored.filter("lang_pred <> 'und' and score >= 0.5").collect()}
    assert out.count() >= 0.99 * sum(any(map(str.isalpha, t or "")) for t in rows.values())

    kept = common.materialise(stages["quality"](spark, out, SMALL), "t")
    assert kept.columns == columns
    failed = {d for d, t in rows.items() if (q := plain.quality(t))[0] < 20 or 100 * q[4] > 30 * q[0]}
    found = {r.doc_id: r.text for r in kept.collect()}
    assert not failed & set(found) and all(set(t.split("\n")) <= set(rows[d].split("\n")) for d, t in found.items())

    near = common.materialise(stages["near_duplicates"](spark, kept, SMALL), "t")
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(set(jaccard_components(list(found.items()))))

    single = {r.doc_id: r.text for r in near.collect()}
    cut = common.materialise(stages["substring_dedup"](spark, near, SMALL), "t")
    want = {d: left for d, n, gone, _, left in plain.removals(list(single.items())) if not gone or left}
    assert cut.columns == columns and {r.doc_id: plain.words(r.text) for r in cut.collect()} == want

    packed = stages["packing"](spark, cut, SMALL).toPandas()
    assert set(packed.doc_id) == set(want) and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "ids_crc32").collect())) == sorted(packed[["doc_id", "piece", "ids_crc32"]].itertuples(index=False, name=None))
