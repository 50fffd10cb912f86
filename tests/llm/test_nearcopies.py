"""Near copies by the similarity of their shingles, against all pairs."""

import random

import plain
import pytest

from tidegrid.llm import nearcopies, ngramjoin, simhash

from corpus_fixtures import clashing, documents  # noqa: F401

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def _grams(text):
    ws = plain.words(plain.ascii_lower(text))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _components(rows, similar=0.8):
    sets, label = [_grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and _jaccard(sets[i], sets[j]) >= similar:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min((d for (d, _), y in zip(rows, label) if x == y and d is not None), default=None) for x in label}
    return [least[x] for x in label]


def _copy(rng, words, changed):
    out = list(words)
    for k in rng.sample(range(len(out)), changed):
        out[k] = f"x{rng.random()}"
    return out


def _planted(seed):
    """Originals, copies at about 0.8 to 0.95, texts at about 0.5 to 0.75, and a chain whose ends are far apart."""
    rng, rows, near = random.Random(seed), [], []
    for k in range(40):
        base = [f"w{k}_{i}" for i in range(400)]
        rows.append((100 * k, " ".join(base)))
        for n in (2, 4, 5, 7, 8, 8):
            rows.append((100 * k + len(rows) % 90 + 1, " ".join(_copy(rng, base, n))))
            near.append(_jaccard(_grams(rows[-1][1]), _grams(" ".join(base))))
        rows += [(100 * k + 95 + n % 4, " ".join(_copy(rng, base, n))) for n in (14, 25)]
    step = [f"c{i}" for i in range(400)]
    for k in range(12):
        rows.append((9000 - k, " ".join(step)))
        step = _copy(rng, step, 6)
    rng.shuffle(rows)
    return rows, near


@pytest.mark.parametrize("limit", [0, 4])
def test_near_copies(documents, clashing, monkeypatch, limit):
    monkeypatch.setattr(ngramjoin, "PAIRS_A_NODE", limit)
    rows, near = _planted(3)
    assert sum(0.8 <= x < 0.9 for x in near) > 80 and sum(0.9 <= x < 0.96 for x in near) > 30
    want = _components(rows)
    got = sorted((r.doc_id, r.component_id) for r in nearcopies.near_copies(clashing(documents(rows, 3))).collect())
    assert got == sorted(zip([d for d, _ in rows], want))


def test_near_duplicates_stage(spark, documents, clashing):
    import corpus_pipeline

    rows, _ = _planted(5)
    rows += [(None, rows[0][1]), (rows[0][0], rows[0][1]), (9500, None), (9400, " "), (9600, "few words"), (9700, "FEW words")]
    docs = clashing(documents(rows))
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, {*_components([(d, t or "") for d, t in rows]), None}))
    assert nearcopies.near_copies(spark.createDataFrame([], EMPTY)).count() == 0


def test_simhash_passes_its_radius_and_shingle_on(documents):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(_copy(rng, base, 3 * k))) for k in range(8)]
    prints = [(d, plain.fingerprint(t)) for d, t in rows]
    assert plain.components(prints, 9) != plain.components(prints, 2)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(rows), 9).collect()}
    assert got == dict(zip([d for d, _ in rows], plain.components(prints, 9)))
    five = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(documents(rows), shingle=5).collect()}
    assert five != {d: f"{f:016x}" for d, f in prints}


def test_pipeline_from_near_copies_on(spark):
    """The stages behind quality, with the near copies that all pairs give."""
    import corpus_pipeline
    from tidegrid.llm import common

    from corpus_fixtures import SMALL

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = common.materialise(stages["quality"](spark, stages["language"](spark, docs, SMALL), SMALL), "t")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    near = common.materialise(stages["near_duplicates"](spark, kept, SMALL), "t")
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == sorted(set(_components(rows)))
    cut = common.materialise(stages["substring_dedup"](spark, near, SMALL), "t")
    want = {d: left for d, n, gone, _, left in plain.removals([(r.doc_id, r.text) for r in near.collect()]) if not gone or left}
    assert cut.columns == docs.columns and {r.doc_id: plain.words(r.text) for r in cut.collect()} == want
    packed = stages["packing"](spark, cut, SMALL).toPandas()
    assert set(packed.doc_id) == set(want) and packed.groupby("sequence_id").length.sum().max() <= 2048
