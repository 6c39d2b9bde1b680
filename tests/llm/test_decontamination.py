"""Windows against a brute-force scan, on both routes, and what removal leaves."""

import hashlib
import re

import pytest

from tickloom.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def brute(docs, bench, n=10):
    wins = {}
    for item, text in bench:
        w = words(text)
        for s in range(max(len(w) - n, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for size in {len(x) for x in wins}:
            for s in range(len(w) - size + 1):
                if (ids := wins.get(tuple(w[s : s + size]))) is not None:
                    hit |= set(range(s, s + size))
                    items |= ids
        ids = sorted(str(i) for i in items if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
BENCH = [(1, ITEM), (10, "short ÉTUDE one"), (2, ITEM.upper()), (3, None), (4, " ,. "), (None, "null id item"), (5, "x"), (5, "x")]
DOCS = [
    (1, f"Before. {ITEM}! After it."),
    (2, f"{ITEM} {ITEM}"),
    (3, ITEM.replace(",", "").replace(" ", "--").upper()),
    (4, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (5, "a short ÉTUDE one here"),
    (6, "a short étude one here"),
    (7, None),
    (8, ""),
    (9, "... !!!"),
    (None, "a null id item there"),
    (10, "clean text with nothing"),
    (11, "y " * 20_000 + ITEM),
    (12, "x"),
    (12, "x"),
]


@pytest.mark.parametrize("max_set", [50_000, 2])
def test_equals_brute_force(spark, max_set):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted((tuple(r) for r in d.report(docs, bench, max_set=max_set).collect()), key=repr)
    assert got == brute(DOCS, BENCH)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in d.report(docs, bench).collect())
    assert d.report(docs.limit(0), spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


def test_documents_go_and_clean_ones_stay_as_they_are(spark):
    docs = spark.createDataFrame([(*x, i, "k") for i, x in enumerate(DOCS)], "doc_id long, text string, w int, k string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    kept = d.decontaminate(docs, bench)
    bad = {r[0] for r in brute(DOCS, BENCH) if r[-1]}
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id not in bad)


def test_spans_go(spark):
    docs = spark.createDataFrame([(1, f"Before. {ITEM}! After it."), (2, "clean, text"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r.doc_id: r.text for r in d.decontaminate(docs, bench, how="spans").collect()}
    assert got == {1: "Before. After it.", 2: "clean, text", 3: None}
