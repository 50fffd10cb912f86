"""Narrow operators (language, licences, quality, pages, tokens) against plain versions and on odd rows."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import plain
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from tidegrid.llm.common import materialise
from tidegrid.llm import bpe, html, language, license, packing, pieces, quality, tokencounts
from tidegrid.llm.queries import QUERIES

from corpus_fixtures import SMALL, clashing, documents  # noqa: F401

BPE, COUNTS, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
LONG = "deep water runs still " * 30_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "one"), (6, "one"), (None, "a row without an id"), (7, "12 34 !?"), (8, "x" * 5000), (9, "é\x0b中 文 don't 'll"), (10, "\x85\x1c|")]
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# --- language ---


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_code_lengths_are_those_of_plain_context_trees(spark, documents):
    train = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("ein hund und noch ein hund", "de"), ("über den fluß", "de"), ("a", "en"), ("le chat", None)] * 3)]
    model = language.train(documents(train))
    trees = {lang: plain.Contexts() for lang in ("de", "en")}
    import zlib

    for doc, text, lang in train:
        if lang and zlib.crc32(str(doc).encode()) % 3 != 1:
            trees[lang].learn(text)
    assert model.languages == ["de", "en"]
    for text in ("the hund", "zzz é", "a", "über the mat\n\nein"):
        data = text.encode()
        got = model.code_lengths(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        assert got == pytest.approx([trees[x].bits(text) for x in ("de", "en")], rel=1e-5)


def test_probabilities_of_a_context_sum_to_one(documents):
    model = language.train(documents([(k, "abracadabra banana", "x") for k in range(9)]))
    times = np.ones(model.bits.shape[1])
    times[-1] = 256 - (model.bits.shape[1] - 1)  # the last symbol stands for all bytes never seen
    assert np.exp2(-model.bits[:, :, 0].astype(float)) @ times == pytest.approx(np.ones(len(model.bits)), abs=1e-4)


def test_held_out_accuracy(corpus):
    out = language.identify(corpus, language.train(corpus)).filter(language.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right, n = out.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right / n > 0.97


def test_language_of_odd_rows(spark, documents, clashing, corpus):
    model = language.train(corpus)
    out = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(clashing(documents(ODD)), model).collect()]
    assert len(out) == len(ODD)
    by = {d: (p, s) for d, p, s in out}
    assert all(by[d] == ("und", 0.0) for d in (1, 2, 3, 7, 10)) and by[5][0] in model.languages
    assert all(0 <= s <= 1 for _, _, s in out)
    assert language.identify(spark.createDataFrame([], EMPTY), model).count() == 0
    assert language.train(documents([(1, "text", None)])) is None
    assert {r.lang_pred for r in language.identify(documents(ODD), None).collect()} == {"und"}
    kept = language.accept(clashing(documents(ODD)), model)
    assert kept.columns == clashing(documents(ODD)).columns and not {1, 2, 3, 7} & {r.doc_id for r in kept.collect()}


# --- licences ---


def test_licence_places_and_labels(spark, documents, clashing):
    rows = [
        (1, "Released under the MIT License. Also under the MIT license"),
        (2, "CC BY-NC cc by nc"),
        (3, "Licensed under the Apache License, Version 2.0."),
        (4, "under the mit\nlicense"),
        (5, "understanding the mit license"),
        (6, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files\n\nother words"),
        (7, "All rights reserved."),
        (8, "all my rights were never reserved here\nbut kept"),
        (9, "This work is licensed under the GNU General Public License, version 3."),
        (10, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        (11, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        (12, "this work is licensed under a creative commons attribution-share alike 4.0 international license"),
        (13, "river stone " * 300 + "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License." + " river" * 300),
        (14, " river stone brook ".join("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0".split() * 2) * 2),
        *[(20 + k, t) for k, (_, t) in enumerate(ODD)],
    ]
    out = {r.doc_id: r for r in license.scan(clashing(documents(rows))).collect()}
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (10, 2, 1, 6, "mit")
    assert (out[2].n_base, out[2].first_word, out[2].last_word, out[2].labels) == (2, 0, 3, "cc-by-nc")
    assert (out[3].base_labels, out[3].labels, out[3].score) == ("apache-2", "apache-2", 1.0)
    assert (out[4].n_base, out[5].n_base) == (1, 0)
    assert (out[6].base_labels, out[6].labels) == ("", "mit") and out[6].score >= 0.8
    assert (out[7].labels, out[8].labels, out[9].labels) == ("reserved", "", "gpl-3")
    assert [out[k].labels for k in range(10, 15)] == ["cc-by", "cc-by-nc", "cc-by-sa", "cc-by-sa", ""]
    assert out[20].n_words == 0 and out[20].first_word is None and out[20].score == 0
    assert len(out) == len(rows) and license.scan(spark.createDataFrame([], EMPTY)).count() == 0


def test_licence_join_finds_what_brute_force_finds(documents):
    rng = random.Random(5)
    bag = sorted({w for _, t in license.TEMPLATES for w in license.template_words(t)}) + ["river", "stone"]
    rows = []
    for k in range(150):
        label, text = rng.choice(license.TEMPLATES)
        ws = [w for w in license.template_words(text) if rng.random() < 0.85] + rng.sample(bag, 4)
        rows.append((k, "\n".join([" ".join(rng.sample(bag, 5)), " ".join(ws)])))
    want = {}
    for k, text in rows:
        found = set()
        for block in [*text.split("\n"), text]:
            ws, held = block.split(), {}
            for n, (label, t) in enumerate(license.TEMPLATES):
                own = set(license.template_words(t))
                shared = len(own & set(ws))
                marked = label not in license.MARKS or any(f" {m} " in f" {' '.join(ws)} " for m in license.MARKS[label])
                if shared >= license.needed(len(own)) and marked:
                    held.setdefault(license.FAMILIES.get(label, n), []).append((shared + (label in license.MARKS), label))
            found |= {label for group in held.values() for shared, label in group if shared == max(group)[0]}
        want[k] = found
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in license.scan(documents(rows)).collect()}
    phrases = {k: {label for p, label in license.PHRASES.items() if f" {p} " in f" {' '.join(t.split())} "} for k, t in rows}
    assert all(want[k] <= got[k] <= want[k] | phrases[k] for k in want) and sum(map(bool, want.values())) > 30


# --- quality ---


def test_quality_counts(spark, documents, clashing):
    rng = random.Random(2)
    rows = [(k, "\n".join(" ".join(rng.choice(["a", "bb", "c|", "#d"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 5)))) for k in range(60)] + [(100 + k, t) for k, (_, t) in enumerate(ODD)]
    out = {r.doc_id: r for r in quality.assess(clashing(documents(rows))).collect()}
    for k, text in rows:
        r, want = out[k], None if text is LONG else plain.quality(text)
        if want:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert out[104].base_failed and not out[104].kept
    assert quality.assess(spark.createDataFrame([], EMPTY)).count() == 0


def test_quality_lines(documents):
    prose = "\n".join(f"Line {k} says something plain about river number {k * 7} and its banks." for k in range(8))
    menu = "Home | About | Products | Contact | Help"
    rows = [(1, prose), (2, prose + "\n" + menu), (3, "\n".join([menu] * 1 + [f"{menu} {k} | {k}" for k in range(30)])), (4, prose + "\n*** ### $$$ &&& %%%"), (5, prose + "\nAll Rights Reserved.")]
    out = {r.doc_id: r for r in quality.assess(documents(rows)).collect()}
    assert out[1].kept and out[1].cleaned == prose and out[1].n_lost_words == 0
    assert all(out[k].kept and out[k].cleaned == prose for k in (2, 4, 5)) and not out[3].kept
    kept = quality.accept(documents(rows))
    assert kept.columns == documents(rows).columns and {r.doc_id: r.n_chars for r in kept.collect()} == {k: len(prose) for k in (1, 2, 4, 5)}


# --- pages ---


def test_pages(spark):
    page = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <div class="ad">Buy now</div><aside>More</aside><main><article><header><h1>The &eacute;vent &amp; more</h1></header>
    <p>First   para&nbsp;<b>bold</b>
    line <a href=x>link</a><br>next<p>Second &lt;b&gt; one</p><ul><li>a<li>b</ul><form>Name <input></form>
    <div id="comments"><p>nice post</p></div></article></main><div class="sidebar">side</div><footer>&copy; me</footer></body></html>"""
    want = "The évent & more\nFirst para bold line link next\nSecond <b> one\na\nb"
    assert html.main_text(page) == want
    prose = "The river was low and it is said that the bank of the stream was on the map for a year or so in the past. " * 2
    loose = f"<div class=menu><a href=1>Home</a></div><p>{prose}</p><p>Short one.</p><div><a href=2>More stories like this</a></div>"
    assert html.main_text(loose) == f"{prose.strip()}\nShort one."
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>unclosed <b>bold"), (4, "w", "<p>unclosed <b>bold"), (5, "x", "a < b & c"), (6, "y", "<script>" * 50), (7, "z", "<div>" * 20_000 + "deep" + "</div>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("label", F.lit("x"))
    out = [(r.page_id, r.url, r.text) for r in html.extract(df).collect()]
    assert out == [(1, "u", want), (2, None, ""), (3, "v", ""), (4, "w", "unclosed bold"), (4, "w", "unclosed bold"), (5, "x", "a < b & c"), (6, "y", ""), (7, "z", "deep")]
    assert html.extract(df.limit(0)).count() == 0


# --- tokens ---


def test_split_patterns():
    rng, letters = random.Random(3), ["'", "'", "s", "t", "re", "ve", "ll", "d", "m", "é", " ", " ", "\n", "\t", "\x1c", "\x85", " ", "1", "٣", "½", "-", "😀", "​", "\x00", "中", "r", "Σ"]
    for cut, pattern in ((pieces.byte_level, regex.compile(public_tokenizers.PATTERN)), (pieces.words, regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"))):
        for _ in range(400):
            texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 5))]
            joined, start, end, first = cut(texts)
            assert [[joined[a:b] for a, b in zip(start[i:j], end[i:j])] for i, j in zip(first[:-1], first[1:])] == [pattern.findall(t) for t in texts]


def _tiktoken(path):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})


def test_byte_bpe_is_the_library_s(spark, documents, clashing, corpus):
    rows = [(k, t) for k, (_, t) in enumerate(ODD)] + [(100 + r.doc_id, r.text) for r in corpus.limit(40).collect()]
    out = {r.doc_id: r for r in bpe.round_trip(clashing(documents(rows)), BPE).collect()}
    encoding = _tiktoken(BPE)
    for k, text in rows:
        ids = encoding.encode_ordinary(text or "")
        assert (out[k].n_tokens, out[k].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert out[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(spark.createDataFrame([], EMPTY), BPE).count() == 0


def test_byte_bpe_with_a_small_word_table(documents, corpus, monkeypatch):
    rows = [(r.doc_id, r.text) for r in corpus.limit(60).collect()]
    whole = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(documents(rows, 1), BPE).collect()}
    monkeypatch.setattr(bpe, "MAX_WORDS", 50)
    monkeypatch.setattr(bpe, "slices", lambda at, limit=0: [(k, k + 1) for k in range(len(at) - 1)])
    assert {r.doc_id: r.ids_sha256 for r in bpe.round_trip(documents(rows, 1), BPE).collect()} == whole


def test_token_ledger(spark, tmp_path):
    kinds = "op string, doc_id long, source string, lang string, tokenizer string, tokens long"

    def change(*rows):
        return spark.createDataFrame(rows, kinds)

    def totals():
        return sorted([tuple(r) for r in ledger.totals().collect()], key=str)

    ledger = tokencounts.TokenLedger(spark, str(tmp_path))
    assert totals() == []
    first = change(("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", None, "v1", 5), ("insert", 3, None, "en", "v1", None), ("insert", None, "a", "en", "v1", 1), ("insert", 4, "b", "de", "v1", 2), ("insert", 4, "b", "de", "v1", 2))
    ledger.commit(0, first)
    assert totals() == sorted([("a", "en", "v1", 2, 11), ("a", None, "v1", 1, 5), (None, "en", "v1", 1, 0), ("b", "de", "v1", 2, 4)], key=str)
    second = change(("revise", 1, "a", "de", "v1", 12), ("delete", 4, None, None, "v1", None), ("insert", 1, "a", "de", "v2", 7), ("delete", 99, "a", "en", "v1", 3))
    for _ in range(3):
        ledger.commit(1, second)
        ledger.commit(0, first)
    assert totals() == sorted([("a", "de", "v1", 1, 12), ("a", "en", "v1", 1, 1), ("a", None, "v1", 1, 5), (None, "en", "v1", 1, 0), ("a", "de", "v2", 1, 7)], key=str)
    with pytest.raises(Exception, match="unknown operation"):
        ledger.commit(2, change(("upsert", 1, "a", "en", "v1", 1)))
    # another process finds the batches, an attempt that was not published does not count, and compaction changes no total
    change(("insert", 5, "a", "en", "v1", 1)).write.parquet(f"{tmp_path}/ledger/2-unpublished")
    before, ledger = totals(), tokencounts.TokenLedger(spark, str(tmp_path))
    assert ledger.batches == [0, 1] and totals() == before
    ledger.commit(0, first)
    ledger.compact()
    ledger = tokencounts.TokenLedger(spark, str(tmp_path))
    assert ledger.batches == [1] and totals() == before
    ledger.commit(1, second)
    ledger.commit(2, change(("delete", 1, None, None, "v1", None), ("revise", None, "c", "en", "v1", 3), ("insert", 6, "c", "en", "v1", 4)))
    assert ledger.batches == [1, 2] and totals() == sorted([("a", None, "v1", 1, 5), (None, "en", "v1", 1, 0), ("a", "de", "v2", 1, 7), ("c", "en", "v1", 2, 7)], key=str)


def test_token_totals_of_the_query(spark):
    """The registered query against plain sums of the library's counts."""
    encoding, want = _tiktoken(COUNTS), {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        n, total = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = n + 1, total + len(encoding.encode_ordinary(r.text or ""))
    got = QUERIES["op10_token_counts"](spark, SMALL).collect()
    assert len(got) == len(want) and {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == want
    assert {r.tokenizer for r in got} == {"byte_bpe_50k"}


def test_token_counts(documents, corpus):
    rows = [(k, t) for k, (_, t) in enumerate(ODD)] + [(100 + r.doc_id, r.text) for r in corpus.limit(40).collect()]
    encoding = _tiktoken(COUNTS)
    assert {r.doc_id: r.tokens for r in tokencounts.counted(documents(rows), COUNTS).collect()} == {k: len(encoding.encode_ordinary(t or "")) for k, t in rows}


# --- packing ---


def test_packing(spark, documents, clashing, corpus):
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    rows = [(k, t) for k, (_, t) in enumerate(ODD)] + [(100 + r.doc_id, r.text) for r in corpus.collect()] + [(90, "ΑΣ ς Σ İ K é <|endoftext|>")]
    out = packing.pack(clashing(documents(rows)), WORDS).toPandas()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want = [(s // 2048, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)]
        assert sorted(out[out.doc_id == doc][["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    _whole_sequences(out)
    assert out.sequence_id.nunique() <= math.ceil(out.length.sum() / 2048) + 2
    assert packing.pack(spark.createDataFrame([], EMPTY), WORDS).count() == 0


def _whole_sequences(out: pd.DataFrame):
    for _, rows in out.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 2048


def test_packing_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 60)
    rng = random.Random(4)
    rows = materialise(spark.createDataFrame([(k, rng.randint(1, 2000)) for k in range(700)], "doc_id long, length long").repartition(3), "t")
    out = packing.solve(packing._deal(rows)).withColumn("sequence_id", F.struct("block", "bin").cast("string")).toPandas()
    assert sorted(out.doc_id) == list(range(700))
    _whole_sequences(out)


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1500, 400)
    population = packing.initial(sizes, 2048, rng)
    child = packing.crossover(population[0], population[1], sizes, 2048, rng)
    assert len(child) == len(sizes) and np.bincount(child, sizes).max() <= 2048 and set(child) == set(range(child.max() + 1))
    best = packing.evolve(population, sizes, 2048, rng)[0]
    assert packing.fitness(best, sizes, 2048) >= max(packing.fitness(p, sizes, 2048) for p in population)
