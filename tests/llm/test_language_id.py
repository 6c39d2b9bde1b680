"""The chain against brute force, held-out accuracy, code-switched text and odd rows."""

import itertools

import numpy as np
import pytest

from tickloom.llm import language_id as lid

SCHEMA = "doc_id long, text string, lang string"
FOLDER = "/root/testdata/sf0.01"


def brute(scores, transitions):
    n, k = scores.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(scores[i, s] for i, s in enumerate(path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path)))
        for i, s in enumerate(path):
            out[i, s] += w
    return out / out.sum(1, keepdims=True)


def test_posteriors_equal_all_paths(monkeypatch):
    monkeypatch.setattr(lid, "CHUNK", 2)
    rng = np.random.default_rng(1)
    lengths = np.array([1, 7, 2, 5, 3])
    scores, step = rng.normal(0, 2, (lengths.sum(), 3)), rng.normal(0, 1, (3, 3))
    got = lid.posteriors(scores, step, lengths)
    ends = np.cumsum(lengths)
    for a, b in zip(ends - lengths, ends):
        assert np.allclose(got[a:b], brute(scores[a:b], step))


def test_long_chains_do_not_underflow():
    rng = np.random.default_rng(2)
    scores = rng.normal(0, 40, (50_000, 4))
    got = lid.posteriors(scores, rng.normal(0, 4, (4, 4)), np.array([1, 49_998, 1]))
    assert np.isfinite(got).all() and np.allclose(got.sum(1), 1)


def test_pairwise_agrees_with_chunks():
    rng = np.random.default_rng(3)
    scores, step = rng.normal(0, 1, (4, 9, 3)), rng.normal(0, 1, (3, 3))
    post, pair = lid._pairwise(scores, step)
    assert np.allclose(post.reshape(-1, 3), lid.posteriors(scores.reshape(-1, 3), step, np.full(4, 9)))
    assert np.isclose(pair.sum(), 4 * 8)


@pytest.fixture(scope="module")
def model(spark):
    return lid.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where(lid.held_out() & lid.F.col("lang").isNotNull())
    rows = lid.predict(docs, model).collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched_words(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where(lid.held_out())
    texts = {lang: lid.words_of(docs.where(lid.F.col("lang") == lang).where("n_chars between 400 and 4000").orderBy("doc_id").first().text)[:15] for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, " ".join(texts["en"] + texts["de"]), None)], SCHEMA)
    labels = [x.lang for x in lid.label_words(mixed, model).first().word_langs]
    truth = ["en"] * len(texts["en"]) + ["de"] * len(texts["de"])
    assert np.mean([a == b for a, b in zip(labels, truth)]) > 0.85


def test_odd_rows_and_names(spark, model):
    rows = [(None, None, None), (1, "", "en"), (2, "12 34 !?", "de"), (3, "der die und nicht auch " * 20_000, None), (3, "the", None), (3, "the", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", lang_pred string, words int")
    got = lid.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "words", "lang_pred", "score"]
    out = [(r.lang_pred, r.score) for r in got.collect()]
    assert out[:3] == [("und", 0.0)] * 3 and out[3][0] == "de" and out[4] == out[5]
    assert lid.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_without_labels_all_is_undefined(spark):
    df = spark.createDataFrame([(1, "some words", None)], SCHEMA)
    assert [tuple(r)[2:] for r in lid.report(df).collect()] == [("und", 0.0)]


def test_prediction_ignores_label_source_and_id(spark, model):
    df = spark.createDataFrame([(1, "under the with is de la", "en"), (4, "under the with is de la", "fr")], SCHEMA)
    a, b = lid.predict(df, model).collect()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score)


def test_numerals_are_no_letters(spark, model):
    assert lid.words_of("½ ² ① Ⅷ 12_3") == [] and lid.words_of("x²y ab½ c") == ["x", "y", "ab", "c"]
    rows = lid.predict(spark.createDataFrame([(1, "½ ² ①", None), (2, "Ⅷ", "en")], SCHEMA), model).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
