"""Collocations against plain counting, and what the summaries promise."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import collocations

from corpus_fixtures import clashing, documents  # noqa: F401

EMPTY = "doc_id long, text string, lang string"


def _mined(rows, min_count, max_words, top, cover):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain.ascii_lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for size in range(1, max_words + 1):
                f[lang].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = defaultdict(int)
        for p, a in good.items():
            for q in {p[i : i + s] for s in range(2, len(p)) for i in range(len(p) - s + 1)}:
                inside[q] = max(inside[q], a)
        rows_of = []
        for p, a in good.items():
            if 100 * inside[p] >= cover * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _texts(seed, n=120):
    rng = random.Random(seed)
    bag = ["a", "B", "cc", "d'd", "é", "ß", "日", "x-y", "of", "the", "\x00z", "w\xa0v"]
    weights = [9, 8, 5, 4, 3, 3, 2, 2, 9, 9, 1, 1]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "\r", "\x0b"]
    rows = []
    for k in range(n):
        ws = rng.choices(bag, weights, k=rng.choice([0, 1, 2, 3, 30, 60]))
        rows.append((k % 90, "".join(w + rng.choice(gaps) for w in ws), rng.choice(["en", "en", "fr", None, "und"])))
    return rows


ODD = [(1, None, "en"), (2, "", "de"), (None, " \t\n", None), (3, "one two three " * 4000, "es"), (4, "new york city hall new york city hall", "fr"), (4, "new york city hall new york city hall", "fr")]


@pytest.mark.parametrize(("seed", "min_count", "max_words", "top", "cover"), [(1, 10, 3, 2000, 50), (2, 3, 4, 40, 80), (3, 2, 2, 5, 50), (4, 1, 5, 10_000, 1)])
def test_mine(documents, clashing, monkeypatch, seed, min_count, max_words, top, cover):
    monkeypatch.setattr(collocations, "PART_BYTES", 700)
    rows = _texts(seed) + ODD
    got = collocations.mine(clashing(documents([(d, t, g) for d, t, g in rows], 3)), min_count, max_words, top, cover).collect()
    assert sorted(map(tuple, got)) == _mined(rows, min_count, max_words, top, cover)


def test_empty(spark):
    assert collocations.mine(spark.createDataFrame([], EMPTY)).count() == 0


def test_score_beyond_64_bits(spark):
    got = spark.sql("select 3000000007L as a, 4000000009L as l, 3999999999L as r").select(collocations._score("a", "l", "r").alias("s")).first().s
    assert got == 1_000_000 * 3000000007**2 // (4000000009 * 3999999999)


def test_summary_keeps_all_that_reach_the_threshold():
    rng = np.random.default_rng(5)
    stream = np.concatenate([rng.integers(0, 40, 6000), rng.integers(1000, 90_000, 20_000)]).astype(np.uint64)
    rng.shuffle(stream)
    threshold = 60
    summary = collocations.Summary(len(stream) // threshold + 1)
    parts = [np.unique(part, return_counts=True) for part in np.array_split(stream, 37)]
    for keys, counts in parts:
        summary.add(keys, counts)
    assert summary.removed > 0 and len(summary.keys) <= summary.capacity
    keys, counts = np.unique(stream, return_counts=True)
    assert set(keys[counts >= threshold].tolist()) <= set(summary.reaching(threshold).tolist())
    true = dict(zip(keys.tolist(), counts.tolist()))
    assert all(c <= true[k] <= c + summary.removed for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))


def test_equal_hashes_of_different_texts_stay_apart(documents, monkeypatch):
    """All phrases of one size share a hash; the check by a second hash still counts them one by one."""
    monkeypatch.setattr(collocations._Words, "phrases", lambda self, size: (lambda place, h: (place, np.full(len(h), 7 * size, np.uint64)))(*self.rolling.windows(self.words, self.first, size)))
    rows = [(k, "red car. blue car. red car", "en") for k in range(6)]
    docs = documents(rows, 1)
    bitmaps = {size: collocations.Bitmap(1, 64, np.full(8, 255, np.uint8)) for size in (1, 2)}
    got = {(r.size, r.phrase): r.n for r in collocations._exact(docs.select("text", "lang"), bitmaps, 1).collect()}
    assert got == {(0, ""): 36, (1, "red"): 12, (1, "blue"): 6, (1, "car"): 18, (2, "red car"): 12, (2, "blue car"): 6}


def test_other_columns_and_missing_ids(documents):
    docs = documents([(None, "Some Text here. " * 12, "en")]).withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x"))
    assert [r.phrase for r in collocations.mine(docs).collect()] == ["some text here"]
