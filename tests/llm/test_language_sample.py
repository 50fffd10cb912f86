"""The training sample of language identification when text sits in few long documents."""

import zlib

from tidegrid.llm import language

from corpus_fixtures import documents  # noqa: F401

EN, DE = "the cat sat on the mat and it was at the door ", "ein hund und noch ein hund liegen auf der wiese "


def test_one_very_long_labelled_document(documents):
    for k in [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1][:4]:
        model = language.train(documents([(k, EN * 60_000, "en")]), train_chars=50_000)
        assert model is not None and model.languages == ["en"]


def test_languages_of_few_long_documents_are_learned_within_the_bound(documents, monkeypatch):
    seen = []
    count = language.gram_counts
    monkeypatch.setattr(language, "gram_counts", lambda docs: seen.append({r[0]: r[1] for r in docs.selectExpr("lang", "length(text) n").groupBy("lang").sum("n").collect()}) or count(docs))
    rows = [(k, DE * 20_000, "de") for k in range(3)] + [(None, EN * 20_000 + str(k), "en") for k in range(3)] + [(9, "le chat est sur la table", "fr")]
    model = language.train(documents(rows), train_chars=100_000)
    assert model.languages == ["de", "en", "fr"] and seen[0]["fr"] == 24
    assert all(20_000 <= seen[0][x] <= 300_000 for x in ("de", "en"))
    out = {r.doc_id: r.lang_pred for r in language.identify(documents([(1, EN), (2, DE)]), model).collect()}
    assert out == {1: "en", 2: "de"}
    small = language.train(documents(rows), train_chars=1)
    assert small.languages == ["de", "en", "fr"]
