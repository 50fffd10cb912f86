"""Texts that quote added tokens of the tokenizer get the library's ids, in the query and in the pipeline's last stage."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidegrid.llm import packing, queries

from corpus_fixtures import documents  # noqa: F401

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|><|endoftext|>'s", "<|EndOfText|> <|endoftext|", "<<|endoftext|>|> Été e<|endoftext|>́", "plain words", "", "it<|endoftext|>'s ΑΣ<|startoftext|>", None]


def _want(text):
    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_encode():
    words = packing.WordIds(WORDS)
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(["<|endoftext|>", "<|startoftext|>", " ", "ab", "'s", "<|", "|>", "É", "\n"]) for _ in range(12)) for _ in range(100)]
    assert [np.frombuffer(x, np.uint32).tolist() for x in words.texts(texts, True)] == [_want(t) for t in texts]
    assert _want(TEXTS[0]) == [3306, 49407, 1002]


def test_query_and_stage(spark, documents, tmp_path):
    import corpus_pipeline

    docs = documents(list(enumerate(TEXTS)), 1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = {k: [*_want(t), 0] for k, t in enumerate(TEXTS)}
    want = {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in ids.items()}
    for out in (queries.QUERIES["op5_bestfit_packing"](spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in out.collect()} == want
