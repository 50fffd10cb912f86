"""Line-first quality rules: lines that are markup, menus or boilerplate go, then documents that lost too much.

Nulls count as empty texts. Empty texts fail (fewer than ``MIN_WORDS`` words).
Texts are read whole, in slices; repeated rows get repeated results. Input
columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.llm.common import Rolling, bounded_batches, covered, mix, slices, text_bytes, without, word_spans

MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
MAX_SYMBOLS = 10  # per cent of a line's word characters
MENU_ITEMS = 3  # separators of a menu line
MENU_WORDS = 3  # words between two of them, on average
NOTICE_WORDS = 12  # a boilerplate line is short
MAX_LOST = 30  # per cent of the words

#: Phrases of notices that are not prose.
NOTICES = ["all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript", "sign up for our newsletter", "click here to subscribe"]

RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept", "cleaned"]
_TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lost_words long, kept boolean, cleaned string"
_SPACES = "\t\n\x0b\x0c\r "
_TO_SPACE = {ord(c): " " for c in _SPACES}
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_ROLLING = Rolling(8)


def line_fails(line: str) -> bool:
    """Punctuation, menu and notice rules for one line that has a word."""
    words = [w for w in line.translate(_TO_SPACE).split(" ") if w]
    symbols = sum(line.count(c) for c in SYMBOLS)
    if symbols and 100 * symbols > MAX_SYMBOLS * sum(map(len, words)):
        return True
    bars = line.count("|")
    if bars >= MENU_ITEMS and len(words) - bars <= MENU_WORDS * (bars + 1):
        return True
    low = line.translate(_LOWER)
    return len(words) <= NOTICE_WORDS and any(n in low for n in NOTICES)


def _lines(text: str, suspicious: bool) -> tuple[int, int, str]:
    """Repeated lines, words lost with failing lines, and what is left. Repeats are counted only: a refrain is not boilerplate."""
    lines = text.split("\n")
    seen: set[str] = set()
    repeats = lost = 0
    left = []
    for line in lines:
        if not line.strip(_SPACES):
            left.append(line)
            continue
        repeats += line in seen
        seen.add(line)
        if suspicious and line_fails(line):
            lost += sum(1 for w in line.translate(_TO_SPACE).split(" ") if w)
        else:
            left.append(line)
    return repeats, lost, "\n".join(left) if lost else text


def _notices(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold the words of a notice."""
    low, out = data.tobytes().lower(), np.zeros(len(at) - 1, bool)
    for notice in NOTICES:
        place = low.find(notice.encode())
        while place >= 0:
            out[np.searchsorted(at, place, "right") - 1] = True
            place = low.find(notice.encode(), place + 1)
    return out


def _measure(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    start, end, first = word_spans(data, at)
    n_words = np.diff(first)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(chars[end] - chars[start])])
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
    place, window = _ROLLING.windows(_ROLLING.words(data, start, end), first, REPEAT_WINDOW)
    of = np.searchsorted(first, place, "right") - 1
    key = mix(window + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # equal windows of one text
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(place), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.concatenate([[0], np.cumsum(covered(len(start), place[twice], REPEAT_WINDOW))])
    return n_words, in_words[first[1:]] - in_words[first[:-1]], symbols[at[1:]] - symbols[at[:-1]], marked[first[1:]] - marked[first[:-1]]


def assess(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with the counts, the verdict ``kept`` and the ``cleaned`` text (without ``with_text`` neither text is returned). One
    narrow pass without a shuffle."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, [r for r in RESULTS if r.lower() != text.lower()])
    others = [c for c in docs.columns if with_text or c != text]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            data, at = text_bytes(column)
            parts = [_measure(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in slices(at)]
            words, chars, symbols, repeated = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
            failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * words)
            suspicious = (symbols > 0) | _notices(data, at)
            lines = [_lines(t or "", s) for t, s in zip(column.to_pylist(), suspicious.tolist(), strict=True)]
            lost = np.array([x[1] for x in lines], np.int64)
            kept = ~failed & (100 * lost <= MAX_LOST * words)
            columns = [words, chars, symbols, np.array([x[0] for x in lines], np.int64), repeated, failed, lost, kept]
            cleaned = pa.array([x[2] for x in lines], pa.string()) if with_text else pa.nulls(len(lines), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(c) for c in columns], cleaned], [*others, *RESULTS])

    return docs.mapInArrow(measure, StructType([*[docs.schema[c] for c in others], *StructType.fromDDL(_TYPES).fields]))


def accept(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their failing lines, in their own columns; ``n_chars`` is counted anew where there is one."""
    columns = docs.columns
    renamed = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    passed = assess(renamed, f"c{columns.index('text')}").filter("kept")
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None}
    return passed.select(*[new.get(c, F.col(f"c{k}")).alias(c) for k, c in enumerate(columns)])
