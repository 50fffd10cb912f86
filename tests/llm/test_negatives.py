"""Hard negatives against plain scoring."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def _mined(rows, every, n_positive, n_negative, low, high, scale=256):
    good = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in v):
            continue
        good.append((i, label, [math.floor(scale * x) for x in v]))
    out = []
    for a, (i, label, q) in enumerate(good):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), j, b, other) for b, (j, other, v) in enumerate(good) if b != a and len(v) == len(q))
        for score, p, _, _ in [s for s in scored if s[3] == label][:n_positive]:
            window = [(j, -s) for s, j, _, other in scored if other != label and low * -score <= 100 * -s <= high * -score][:n_negative]
            out += [(i, p, rank, j, -score, s) for rank, (j, s) in enumerate(window, 1)]
    long = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    return sorted((a, p, r, j, long(x), long(y)) for a, p, r, j, x, y in out)


def _rows(seed, n=400):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for k in range(n):
        label = rng.randrange(4)
        rows.append((k, label, [c + rng.gauss(0, 0.8) for c in centres[label]]))
    return rows


ODD = [
    (1000, 1, None), (1010, None, [0.5] * 8), (1020, 1, [0.5] * 7 + [None]), (1030, 1, [float("nan")] * 8), (1040, 2, []), (1050, 2, [1.0, 2.0]), (1060, 3, [2.0, 1.0]), (None, 1, [0.1] * 8),
    (1070, 1, [0.0] * 8), (1080, 1, [0.0] * 8), (1090, 2, [0.0] * 8), (1100, 3, [0.25] * 8), (1100, 3, [0.25] * 8), (1100, 2, [0.25] * 8),
    (1110, 1, [1e200] * 8), (1120, 1, [1e200] * 7 + [2e200]), (1130, 2, [0.8e200] * 8), (1140, 2, [-1e200] * 8), (1150, 3, [1e308] * 8),
]


def _table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", F.lit("x").alias("row"), F.lit(1).alias("key"), F.lit(2.0).alias("dim"), F.lit(3).alias("block"))


@pytest.mark.parametrize(("seed", "block", "super_", "odd"), [(1, 8192, 8192, True), (2, 37, 11, False), (3, 60, 1000, True)])
def test_mine(spark, monkeypatch, seed, block, super_, odd):
    monkeypatch.setattr(negatives, "CHUNK", 7)
    rows = _rows(seed) + (ODD if odd else [])
    vectors = negatives.scaled(_table(spark, rows))
    got = negatives.mine(vectors, vectors.filter("vec_id % 10 = 0"), 4, 3, 50, 95, block, super_)
    want = _mined(rows, 10, 4, 3, 50, 95)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_one_hot_label(spark):
    rows = [(k, 0 if k % 10 else 1, [1.0 + (k % 5) / 10, 1.0]) for k in range(300)]
    vectors = negatives.scaled(_table(spark, rows))
    got = negatives.mine(vectors, vectors.filter("vec_id % 50 = 0"), 5, 3, 50, 95, 20, 3)
    assert sorted(map(tuple, got.collect())) == _mined(rows, 50, 5, 3, 50, 95)


def test_empty(spark):
    vectors = negatives.scaled(spark.createDataFrame([], SCHEMA))
    assert negatives.mine(vectors, vectors).count() == 0


def test_packed_keys_sort_and_come_back():
    rng = random.Random(4)
    scores = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 1 << 63, -(1 << 63) - 1, 1 << 400, -(1 << 400), 10**90] + [rng.randint(-(10**6), 10**6) for _ in range(50)]
    items = [(rng.choice([-5, 3, 7]), 9, s, rng.randrange(2), rng.choice([-2, 4, 8]), rng.randrange(5)) for s in scores for _ in range(4)]
    keys = [negatives.packed(*x) for x in items]
    assert [negatives.unpacked(k) for k in keys] == items
    assert [negatives.unpacked(k) for k in sorted(keys)] == sorted(items, key=lambda x: (x[0], x[1], -x[2], *x[3:]))


def test_streaming_holds_open_windows_only():
    """An anchor with a million pairs passes through an iterator that has been asked for a few."""

    def keys():
        yield negatives.packed(1, 1, 1000, negatives.POSITIVE, 5, 5)
        for k in range(1_000_000):
            yield negatives.packed(1, 1, 900 - k // 10_000, negatives.NEGATIVE, 10 + k, 10 + k)

    stream = negatives.streamed(keys())
    assert [next(stream) for _ in range(3)] == [(1, 5, 1, 10, 1000, 900), (1, 5, 2, 11, 1000, 900), (1, 5, 3, 12, 1000, 900)]
