"""Templates, what recurs, and what stays."""

from tickloom.llm import line_templates as t

LICENSE = "Licensed to the reader under the terms of licence number {} of this site for good"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in t.dedup_lines(df, **kw).collect()}


def test_variable_fields_share_a_template(spark):
    rows = [(i, f"{chr(97 + i) * 5} own text\n" + LICENSE.format(i)) for i in range(5)]
    got = run(spark, rows)
    assert got[0] == rows[0][1]
    assert [got[i] for i in range(1, 5)] == [rows[i][1].split("\n")[0] for i in range(1, 5)]


def test_words_vary_inside_a_leaf(spark):
    names = ["anna", "berta", "carla", "doris"]
    rows = [(i, f"line {n * 3}\nPosted by user {n} on the front page of our site") for i, n in enumerate(names)]
    got = run(spark, rows)
    assert all("Posted" not in got[i] for i in (1, 2, 3)) and "Posted" in got[0]


def test_rare_lines_blank_lines_and_clean_documents_stay(spark):
    rows = [(1, "a b c\n\n\nonly here"), (2, "a b c\nother"), (3, None), (4, ""), (5, "\n"), (None, "x " * 30_000)]
    assert run(spark, rows) == dict(rows)
    assert run(spark, rows, min_docs=2) == {**dict(rows), 2: "other"}


def test_within_one_document_nothing_recurs(spark):
    rows = [(1, "same line\n" * 50), (2, "else")]
    assert run(spark, rows) == dict(rows)


def test_equal_rows_are_one_document(spark):
    rows = [(1, "the line\nx y z"), (1, "the line\nx y z"), (2, "the line"), (3, "the line\nz")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, at int")
    got = sorted((r.doc_id, r.text, r.at, r.n_lines_dropped) for r in t.dedup_lines(df).collect())
    assert got == [(1, "the line\nx y z", 9, 0), (1, "the line\nx y z", 9, 0), (2, "", 9, 1), (3, "z", 9, 1)]


def test_empty_table_and_shuffled_route(spark, monkeypatch):
    assert run(spark, [(1, "x")][:0]) == {}
    rows = [(i, f"own {i} text\n" + LICENSE.format(i)) for i in range(6)]
    want = run(spark, rows)
    monkeypatch.setattr(t, "MAX_BROADCAST", 0)
    assert run(spark, rows) == want


def test_only_long_lines_where_asked(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))
    rows = [(1, f"short line\n{passage}\nown a"), (2, f"short line\nown b\n{passage}"), (3, passage.rsplit(" ", 1)[0])]
    assert run(spark, rows) == dict(rows)
    assert run(spark, rows, min_docs=2, min_tokens=50) == {**dict(rows), 2: "short line\nown b"}
