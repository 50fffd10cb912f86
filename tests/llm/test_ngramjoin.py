"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import plain
import pytest

from tidegrid.llm import ngramjoin

from corpus_fixtures import clashing, documents  # noqa: F401

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def _grams(text, size):
    ws = plain.words(plain.ascii_lower(text))
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())


def _joined(rows, size=3, similar=90):
    sets = [_grams(t, size) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and label[i] != label[j] and 100 * shared >= similar * (len(sets[i]) + len(sets[j]) - shared):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min((d for (d, _), y in zip(rows, label) if x == y and d is not None), default=None) for x in label}
    return sorted([(d, len(s), least[x]) for (d, _), s, x in zip(rows, sets, label)], key=str)


def _changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.random()}"
    return out


def _corpus(seed):
    """Copies at all similarities around the limit, chains, one large group of near copies, passages shared by texts that differ."""
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for k in range(25):
        base = [f"w{k}_{i}" for i in range(rng.choice([12, 40, 120, 300]))]
        rows.append(base)
        rows += [_changed(rng, base, max(1, round(len(base) * share))) for share in (0.004, 0.01, 0.015, 0.02, 0.03, 0.05)]
        rows += [base[: -max(1, len(base) // cut)] for cut in (9, 10, 11, 20)]
    step = [f"c{i}" for i in range(200)]
    for _ in range(10):
        rows.append(step)
        step = _changed(rng, step, 2)
    hot = [f"h{i}" for i in range(150)]
    rows += [_changed(rng, hot, rng.randint(0, 3)) for _ in range(60)]
    rows += [[f"q{k}_{i}" for i in range(rng.randint(0, 8))] + passage for k in range(40)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(d, " ".join(rows[k])) for d, k in enumerate(order)]


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "one two"), (906, "ONE  two"), (907, "one two three"), (None, "one two"), (None, "lonely text here now"), (905, "one two"), (908, "a b " * 30_000), (909, "a b " * 29_000)]


@pytest.mark.parametrize(("seed", "size", "similar", "fragments", "limit"), [(1, 3, 90, 4, 4), (2, 3, 90, 1, 0), (3, 2, 70, 7, 0)])
def test_join(documents, clashing, monkeypatch, seed, size, similar, fragments, limit):
    monkeypatch.setattr(ngramjoin, "PAIRS_A_NODE", limit)
    rows = _corpus(seed) + ODD
    got = ngramjoin.join(clashing(documents(rows, 3)), size, similar, fragments).collect()
    want = _joined(rows, size, similar)
    assert sorted(map(tuple, got), key=str) == want
    assert len({x[2] for x in want}) < 0.8 * len(want)


def test_empty(spark):
    assert ngramjoin.join(spark.createDataFrame([], EMPTY)).count() == 0


def test_a_group_of_copies_costs_few_pairs(documents, monkeypatch):
    """300 near copies of each other: hubs, not all 44,850 pairs."""
    rng = random.Random(9)
    hot = [f"h{i}" for i in range(400)]
    counted = []
    linked = ngramjoin._linked
    monkeypatch.setattr(ngramjoin, "_linked", lambda pairs, *rest: (counted.append(pairs.count()), linked(pairs, *rest))[1])
    got = ngramjoin.join(documents([(k, " ".join(_changed(rng, hot, 2))) for k in range(300)], 3)).collect()
    assert {r.component_id for r in got} == {0} and sum(counted) < 3000


def test_fragments_follow_the_order():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 9, 1 << 16).astype(np.uint8)
    order = ngramjoin.Order(classes, np.bincount(classes, minlength=64).astype(float), 5)
    own = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    part = order.fragment(order.sorted(own))
    assert (np.diff(part) >= 0).all() and np.bincount(part).min() > 3000
