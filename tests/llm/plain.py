"""Brute-force versions of the corpus operators: plain Python, one row at a time, written from the definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- language ------------------------------------------------------------


class Contexts:
    """One language's counts: context bytes (0 to 3) to next-byte counts."""

    def __init__(self):
        self.n = defaultdict(Counter)

    def learn(self, text):
        data = b"\n\n\n" + text.encode()
        for i in range(3, len(data)):
            for k in range(4):
                self.n[data[i - k : i]][data[i]] += 1

    def bits(self, text):
        data, total = b"\n\n\n" + text.encode(), 0.0
        for i in range(3, len(data)):
            excluded, p, k = set(), 1.0, 3
            while True:
                seen = {b: c for b, c in self.n.get(data[i - k : i], {}).items() if b not in excluded}
                size = sum(seen.values())
                if data[i] in seen:
                    p *= seen[data[i]] / (size + len(seen))
                    break
                if size:
                    p *= len(seen) / (size + len(seen))
                excluded |= set(seen)
                if k == 0:
                    p /= 256 - len(excluded)
                    break
                k -= 1
            total -= math.log2(p)
        return total


# --- quality --------------------------------------------------------------


def quality(text):
    text = text or ""
    ws = words(text)
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {j for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    repeated = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), repeated, len(hit)


# --- substring dedup --------------------------------------------------------


def removals(rows, window=13):
    first = {}
    for doc, text in rows:
        ws = words(text)
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        ws = words(text)
        gone = {j for i in range(len(ws) - window + 1) if doc is not None and first[tuple(ws[i : i + window])] < doc for j in range(i, i + window)}
        left = [w for j, w in enumerate(ws) if j not in gone]
        out.append((doc, len(ws), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest(), left))
    return out


# --- simhash ----------------------------------------------------------------


def fingerprint(text):
    ws = words(ascii_lower(text))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, k=2):
    """Smallest id reachable for each (id, fingerprint)."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= k:
                label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)].append(doc)
    return [min(least[root(i)], default=None) for i in range(len(prints))]


# --- top-k --------------------------------------------------------------------


def top_k(rows, every=20, k=20):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)
