"""Licence notices by an exact set-similarity join, in native expressions only.

Template words are ordered by how few documents hold them, rarest first. A
block (a line or a paragraph) that holds a share ``threshold`` of a template's
words must hold one of the template's first few (prefix filter), must have
enough words (length filter), and the words behind the first shared one must
still suffice (positional filter). Only such pairs are compared. A block of
more than ``SPAN`` words is cut into overlapping spans of that many. Notices that
differ in a word or two name what tells them apart (``MARKS``); of the templates
of a family that one span matches, those that share most words, a mark being one
more, count. The template
side is a parameter and so bounded; its index is the side that is broadcast.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import materialise

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8

#: Phrases whose words must follow one another, and notices of which most words must be there.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "either version 3 of the License, or at your option any later version, as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
]
#: Of a label's notices, phrases of which one must stand in the span; and labels whose notices are much alike.
MARKS = {"cc-by-nc": ["noncommercial", "non commercial"], "cc-by-sa": ["sharealike", "share alike"], "gpl-3": ["gnu general public license", "free software foundation"], "mpl-2": ["mozilla public license"], "reserved": ["all rights reserved"]}
FAMILIES = {"cc-by": "cc", "cc-by-nc": "cc", "cc-by-sa": "cc"}
SPAN = 128
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    """Distinct words of a template, in order of their first place."""
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())))


def needed(n: int, threshold: float = THRESHOLD) -> int:
    """Shared words that a template of ``n`` distinct words asks for."""
    return math.ceil(round(threshold * n, 9))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATOR), "")


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _strings(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _phrases(joined: Column, n_words: Column, phrases: dict[str, str]) -> tuple[Column, Column, Column, Column]:
    """Places, first start, last start and labels of all phrases in words joined by spaces, with a space at either end."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        needle, k = f" {phrase} ", len(phrase.split(" "))
        has = F.contains(joined, F.lit(needle))
        counts.append(F.when(has, F.regexp_count(joined, F.lit(f"(?={re.escape(needle)})"))).otherwise(0))
        firsts.append(F.when(has, _spaces(F.substring_index(joined, needle, 1))))
        lasts.append(F.when(has, n_words - _spaces(F.substring_index(joined, needle, -1)) - k))
        labels.append(F.when(has, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    one = len(phrases) == 1
    return total, firsts[0] if one else F.least(*firsts), lasts[0] if one else F.greatest(*lasts), F.array_compact(F.array(*labels))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A to Z are lower-cased; null texts are empty. ``score`` is 1 with a base
    phrase, else the largest share of a matching template, else 0. Repeated rows
    get repeated results; an empty table gives an empty result; other columns
    are not carried.
    """
    spark = docs.sparkSession
    sets = [(label, template_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    texts = docs.select("doc_id", _lower(F.col("text")).alias("t")).withColumn("words", _words(F.col("t")))

    # document frequency of the templates' words: as many rows as the templates have words
    seen = texts.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in seen.collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    index, rare = [], {max(p.split(" "), key=lambda w: -frequency.get(w, 0) if w in rank else 0) for p in phrases}
    for k, (label, ws) in enumerate(sets):
        ordered, need = sorted(rank[w] for w in ws), needed(len(ws), threshold)
        prefix = ordered[: len(ordered) - need + 1]
        rare |= {w for w in ws if rank[w] in prefix}
        index += [{"template": k, "label": label, "rank": r, "j": j + 1, "ranks": ordered, "need": need, "asked": MARKS.get(label), "family": FAMILIES.get(label, str(k))} for j, r in enumerate(prefix)]

    # one pass over all texts; those without any word of a prefix or phrase are decided
    hit = F.arrays_overlap("words", _strings(sorted(rare)))
    marked = texts.select("doc_id", F.size("words").alias("n_words"), F.when(hit, F.col("t")).alias("t")).withColumn("row", F.monotonically_increasing_id())
    marked = materialise(marked, "licence-candidates")

    joined = F.concat(F.lit(" "), F.array_join(_words(F.col("t")), " "), F.lit(" "))
    based = marked.withColumn("joined", F.when(F.col("t").isNotNull(), joined))
    total, first, last, labels = _phrases(F.col("joined"), F.col("n_words"), phrases)
    based = based.select("row", "doc_id", F.col("n_words").cast("long"), total.cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), labels.alias("base"))

    ranks = F.from_json(F.lit(json.dumps(rank)), "map<string,int>")
    block = F.explode(F.array_union(F.split("t", "\n"), F.split("t", r"\n[ \t\r]*\n"))).alias("block")
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - SPAN // 2 - 1, F.lit(0)), F.lit(SPAN // 2))
    spans = marked.filter("t IS NOT NULL").select("row", block).select("row", _words(F.col("block")).alias("ws")).select("row", F.explode(F.transform(starts, lambda i: F.slice("ws", i + 1, SPAN))).alias("ws"))
    tokens = F.array_intersect("ws", _strings(vocabulary))
    phrase = F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" "))
    held_marks = F.array_compact(F.array(*[F.when(F.contains(phrase, F.lit(f" {m} ")), F.lit(m)) for m in sorted({m for ms in MARKS.values() for m in ms})]))
    blocks = spans.select("row", F.array_sort(F.transform(tokens, lambda w: ranks[w])).alias("held"), held_marks.alias("marks")).filter(F.size("held") > 0).distinct()
    probes = blocks.select("row", "held", "marks", F.posexplode("held").alias("i", "rank"))
    wanted = "array<struct<template:int,label:string,rank:int,j:int,ranks:array<int>,need:int,asked:array<string>,family:string>>"
    prefixes = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(index)), wanted)).alias("p")).select("p.*")
    pairs = (
        probes.join(F.broadcast(prefixes), "rank")  # a row for each prefix word of the templates given
        .filter(F.size("held") >= F.col("need"))
        .filter(F.least(F.size("held") - F.col("i"), F.size("ranks") - F.col("j") + 1) >= F.col("need"))
        .filter(F.col("asked").isNull() | F.arrays_overlap("asked", "marks"))
        .select("row", "label", "family", "asked", "held", "marks", "ranks", "need")
        .distinct()
        .withColumn("shared", F.size(F.array_intersect("held", "ranks")))
        .filter("shared >= need")
    )
    share = F.max(F.col("shared") / F.size("ranks")).alias("share")
    strength = F.max(F.col("shared") + F.col("asked").isNotNull().cast("int")).alias("strength")
    of_label = pairs.groupBy("row", "held", "marks", "family", "label").agg(strength, share)
    nearest = of_label.groupBy("row", "held", "marks", "family").agg(F.max("strength").alias("most"), F.collect_list(F.struct("label", "strength", "share")).alias("each"))  # at most one for each label
    best = nearest.select("row", F.explode(F.filter("each", lambda e: e["strength"] == F.col("most"))).alias("e"))
    matched = best.groupBy("row").agg(F.collect_set("e.label").alias("found"), F.max("e.share").alias("share"))
    none = F.array().cast("array<string>")
    return based.join(matched, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
