"""Toxicity and language identification: held-out accuracy, and defined answers on odd rows."""

import zlib

import numpy as np
import pytest
from conftest_words import words

from flatsieve.llm import catalogue, language_id, toxicity

SF = "/root/testdata/sf0.01"


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def test_toxicity_learns_words_and_their_misspellings(docs):
    rows = [(i, words(i, 60) + f" such a {('idiot' if i % 2 else 'moron') if i % 3 == 0 else ('friend' if i % 2 else 'meadow')} here " + words(i + 9000, 60)) for i in range(600)]
    model = toxicity.fit([(t, int(i % 3 == 0)) for i, t in rows], 1 / 3)
    test = [(i, words(i, 80) + (" idiott " if i % 2 else " ") + words(i + 100, 80)) for i in range(20_000, 20_100)]
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs(test), model).collect()}
    right = np.mean([(out[i] >= 0.5) == bool(i % 2) for i, _ in test])
    assert right > 0.8


def test_toxicity_on_the_tables(spark):
    rows = {r["doc_id"]: r for r in catalogue.queries()["op2_toxicity"](spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == held(i, 5, 0) for i, r in rows.items())
    test = [i for i in labels if held(i, 5, 0)]
    wrong = np.mean([rows[i]["predicted"] != labels[i] for i in test])
    assert wrong < 0.12  # 51 toxic rows in all to learn from


def test_toxicity_edges(spark, edges, none):
    model = toxicity.fit([("bad word", 1), ("fine text", 0)] * 5, 0.5)
    out = toxicity.score(edges, model).collect()
    assert len(out) == edges.count() and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[1] == by[2] == by[3] == by[10]
    assert toxicity.score(none, model).count() == 0
    assert 0 <= toxicity.fit([], 0.0).score(np.zeros(0)) < 1e-6
    assert toxicity.fit([("a", 1)], 1.0).score(np.zeros(3)) > 0.9
    labels = spark.createDataFrame([(5, 1), (7, 0), (4, None), (99, 1), (None, 0)], "doc_id long, toxic int")
    out = toxicity.drop_toxic(edges, labels)
    assert out.columns == edges.columns
    assert toxicity.drop_toxic(none, labels).count() == 0
    assert toxicity.drop_toxic(edges, labels.limit(0)).count() == edges.count()


def test_drop_toxic_keeps_clean(spark, docs):
    rows = [(i, words(i, 50) + (" you idiot " if i % 4 == 0 else " ") + words(i + 5000, 50)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs(rows), labels).collect()}
    assert len([i for i, _ in rows if i % 4 and i in kept]) >= 297 and len([i for i, _ in rows if i % 4 == 0 and i in kept]) <= 5


def test_codewords():
    for n in (1, 2, 3, 4, 7, 12):
        c = language_id.codewords(n)
        assert c.shape[0] == n and len({tuple(r) for r in c}) == n
        assert n < 3 or min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 2


def test_language_on_the_tables(spark):
    rows = {r["doc_id"]: r for r in catalogue.queries()["op4_language_id"](spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    test = [i for i in rows if held(i, 4, 2)]
    assert all(r["held_out"] == held(i, 4, 2) for i, r in rows.items())
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in test]) > 0.97


def test_language_edges(edges, none, docs):
    model = language_id.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)
    out = {r["doc_id"]: r for r in language_id.predict(edges, model).collect()}
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out.values())
    assert {i for i, r in out.items() if r["lang_pred"] == "und"} == {1, 2, 3, 10}
    assert language_id.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(edges, None).collect()} == {"und"}
    one = language_id.predict(edges, language_id.fit([("a b", "xx")])).where("doc_id = 4").head()
    assert (one["lang_pred"], one["score"]) == ("xx", pytest.approx(1))
    assert language_id.training_rows(none, "text", "lang", "doc_id") == []
    assert len(language_id.training_rows(edges, "text", "lang", "doc_id", 3)) <= 6


def test_letters_only(docs):
    """Number signs and digits are no letters."""
    model = language_id.fit([("the words of one", "en"), ("les mots de deux", "fr")] * 4)
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs([(1, "½ ½ ² 12 _"), (2, "the"), (3, None)]), model).collect()}
    assert out[1] == out[3] == "und" and out[2] != "und"


def test_length_gathers_no_toxicity():
    rows = [(words(i, 60) + f" such a {'idiot' if i % 3 == 0 else 'friend'} here " + words(i + 9000, 60), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.fit(rows, 1 / 3)
    values = np.array(model.words(words(77, 50).split()), np.float32)
    once = model.score(values)
    assert once < 0.5 and all(model.score(np.tile(values, n)) < 0.5 for n in (10, 1000))
    learned = [model.score(np.array(model.words(t.split()), np.float32)) >= 0.5 for t, _ in rows]
    assert np.mean([a == bool(y) for a, (_, y) in zip(learned, rows)]) > 0.9  # a constant answer has 2 of 3
