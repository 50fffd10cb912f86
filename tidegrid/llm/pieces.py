"""Cutting texts at the public tokenizers' split patterns, for whole batches of code points at once.

Both patterns take runs of letters, of numbers and of other marks, with the
English contractions in front. The byte-level pattern lets one space lead a run
and keeps other white space as pieces; the word pattern drops white space and
takes numbers one by one.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Unicode's White_Space, and the endings that the patterns name.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ["re", "ve", "ll"]


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def _runs(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Code points and their classes, where texts begin, and where runs of one class begin and end."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    kind = classes()[points]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True
    begin = np.flatnonzero(edge)[:-1] if len(points) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(points)) if len(points) else begin
    return joined, points, kind, at, begin, end


def _contractions(points, at, begin, end, kind, free) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lone apostrophes that start a piece (``free``) with an ending behind them: run, start, end of the piece."""
    n = len(points)
    last_of_text = np.zeros(n + 1, bool)
    last_of_text[at] = True
    lone = np.flatnonzero((end - begin == 1) & free)
    lone = lone[(points[begin[lone]] == 0x27) & ~last_of_text[end[lone]]]
    lone = lone[kind[end[lone]] == LETTER] if len(lone) else lone
    start = begin[lone]
    first = points[start + 1]
    long_enough = end[lone + 1] - begin[lone + 1] >= 2 if len(lone) else np.zeros(0, bool)
    second = points[np.minimum(start + 2, n - 1)]
    short = np.isin(first, [ord(c) for c in SHORT_ENDINGS])
    long_ = np.zeros(len(lone), bool)
    for a, b in LONG_ENDINGS:
        long_ |= (first == ord(a)) & (second == ord(b)) & long_enough
    hit = short | long_
    return lone[hit], start[hit], start[hit] + np.where(short, 2, 3)[hit]


def byte_level(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one string, start and end of every piece in it, and each text's first piece (one more entry at the end)."""
    joined, points, kind, at, begin, end = _runs(texts)
    n = len(points)
    cut = np.zeros(n + 1, bool)
    cut[begin] = True
    cut[n] = True
    last_of_text = np.zeros(n + 1, bool)
    last_of_text[at] = True
    if n:
        # white space before something: its last character is cut off, and leads the next run if it is a space
        spaces = np.flatnonzero((kind[begin] == SPACE) & ~last_of_text[end])
        tail = end[spaces] - 1
        cut[tail] = True
        leads = points[tail] == 0x20
        cut[end[spaces][leads]] = False
        free = kind[begin] == OTHER
        free[spaces[leads] + 1] = False
        run, _, stop = _contractions(points, at, begin, end, kind, free)
        cut[end[run]] = False
        cut[stop] = True
    edge = np.flatnonzero(cut)
    return joined, edge[:-1], edge[1:], np.searchsorted(edge[:-1], at)


def words(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """As ``byte_level``, for the word pattern: no white space, numbers one by one."""
    joined, points, kind, at, begin, end = _runs(texts)
    n = len(points)
    cut = np.zeros(n + 1, bool)
    cut[begin] = True
    cut[n] = True
    if n:
        cut[:n][kind == NUMBER] = True
        run, _, stop = _contractions(points, at, begin, end, kind, kind[begin] == OTHER)
        cut[end[run]] = False
        cut[stop] = True
    edge = np.flatnonzero(cut)
    start, stop = edge[:-1], edge[1:]
    kept = kind[start] != SPACE if n else np.zeros(0, bool)
    start = start[kept]
    return joined, start, stop[kept], np.searchsorted(start, at)
