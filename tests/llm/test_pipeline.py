"""Stages one by one on a planted corpus, and the whole on the given tables."""

import pytest

import corpus_pipeline as p
from tickloom.llm import decontamination, jaccard, language_id, line_templates, sentencepieces

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece_encoding"]
    assert p.ORACLE_SQL is None


def test_language_stage_keeps_what_has_a_language(spark, docs):
    odd = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "12 !?", "en", "s", 5), (-3, "", "en", "s", 0)], docs.schema)
    out = p.identify_language(spark, docs.unionByName(odd), FOLDER)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))


def test_line_stage_keeps_documents_and_their_lengths(spark, docs):
    rows = {r.doc_id: r for r in p.dedup_lines(spark, docs, FOLDER).collect()}
    old = {r.doc_id: r for r in docs.collect()}
    assert rows.keys() == old.keys()
    for i, r in rows.items():
        assert r.text == old[i].text and r == old[i] or (r.n_chars == len(r.text) < len(old[i].text))
    assert {r.doc_id: r.text for r in line_templates.report(docs).collect()} == {i: r.text for i, r in rows.items()}


def test_join_stage_keeps_one_of_each_group(spark, docs):
    groups = jaccard.near_duplicates(docs).collect()
    kept = {r.doc_id for r in p.join_near_duplicates(spark, docs, FOLDER).collect()}
    assert kept == {r.component_id for r in groups} and len(kept) < len(groups)


def test_join_stage_keeps_a_passage_of_two_documents_once(spark, docs, tmp_path):
    words = lambda a, n: " ".join(f"{a}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    passage = words("p", 60)
    texts = [f"{words('x', 90)}\n{passage}", f"{passage}\n{words('y', 90)}", words("z", 60)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], docs.schema)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.n_chars) for r in p.join_near_duplicates(spark, df, str(tmp_path)).collect()}
    texts[1] = words("y", 90)
    assert got == {i: (t, len(t)) for i, t in enumerate(texts)}


def test_benchmark_stage_keeps_clean_documents(spark, docs):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    clean = {r.doc_id for r in decontamination.report(docs, bench).where("not contaminated").collect()}
    out = p.decontaminate(spark, docs, FOLDER)
    assert {r.doc_id for r in out.collect()} == clean and out.columns == docs.columns and len(clean) < docs.count()


def test_whole_pipeline(spark, docs):
    out = p.run(spark, FOLDER).collect()
    assert 0 < len(out) < docs.count()
    encoder = sentencepieces.Encoder(sentencepieces.Pieces.load())
    for r in out:
        assert r.ids == encoder.encode(r.text).tolist() and r.n_tokens == len(r.ids)
    assert language_id.UNDEFINED not in {r.lang for r in out}


def test_one_of_each_group_of_copies_stays(spark, docs, tmp_path):
    alone = {r.doc_id for r in p.run(spark, FOLDER).collect()}
    long = sorted((r for r in docs.collect() if r.doc_id in alone and r.lang == "en" and 100 < len(r.text.split()) < 400), key=lambda r: r.doc_id)
    rows, groups = [], {}
    for n, (size, near) in enumerate([(s, k) for s in (2, 3, 1000) for k in (False, True)]):
        words = long[n].text.split()
        lines = [" ".join(words[i : i + 10]) for i in range(0, 100, 10)]
        for j in range(size):
            edited = [*lines[:5], f"{lines[5]} then {words[j % 50]} went {words[j // 50]} home", *lines[6:]] if near else lines
            text = "\n".join(edited)
            rows.append((10_000 * (n + 1) + j, text, "en", "copies", len(text)))
        groups[n] = {10_000 * (n + 1) + j for j in range(size)}
    used = [r.doc_id for r in long[: len(groups)]]
    rest = docs.where(~docs.doc_id.isin(used)).unionByName(spark.createDataFrame(rows, docs.schema))
    rest.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r.text for r in p.run(spark, str(tmp_path)).collect()}
    assert {n: len(ids & out.keys()) for n, ids in groups.items()} == dict.fromkeys(groups, 1)
    given = {r[0]: r[1] for r in rows}
    assert all(len(out[i]) > len(given[i]) / 2 for ids in groups.values() for i in ids & out.keys())


def test_empty_documents(spark, docs):
    out = docs.limit(0)
    for _, stage in p.STAGES:
        out = stage(spark, out, FOLDER)
    assert out.count() == 0
