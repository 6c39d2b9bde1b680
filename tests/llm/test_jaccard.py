"""The join against all pairs, on both routes and with blocks of a few."""

import random
import re

import numpy as np
import pytest

from tickloom.llm import components as cc
from tickloom.llm import jaccard as j

SCHEMA = "doc_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    for x, (i, a) in enumerate(sets):
        for k, b in sets[:x]:
            if i is not None and k is not None and a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[k]:
                lo, hi = sorted((label[i], label[k]))
                label = {d: lo if c == hi else c for d, c in label.items()}
    return sorted(((i, len(s), label.get(i)) for i, s in sets), key=repr)


def corpus(seed=1, families=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [" ".join(rng.choices(vocab, k=60)) for _ in range(3)]
    rows = []
    for _ in range(families):
        base = rng.choices(vocab, k=rng.choice([4, 6, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
            if rng.random() < 0.5:
                text += " " + rng.choice(common)
            rows.append(text)
    rng.shuffle(rows)
    out = list(enumerate(rows, 1))
    return out + [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "one  TWO"), (905, "one two three four five"), (906, "x " * 30_000), (906, "x " * 30_000), (None, "one two"), (None, None)]


def test_sets_match_words():
    rng = random.Random(4)
    texts = [t for _, t in corpus()] + ["É É é a b c d", "".join(rng.choices("aB é\n\v\x1c😀", k=500))]
    for text, got in zip(texts, j.shingle_sets(texts)):
        assert len(got) == len(shingles(text)) and (np.sort(got) == got).all()
    again = list(j.shingle_sets(["One two three four five six", "one two\tthree FOUR five", "two three four five six"]))
    assert set(again[1]) | set(again[2]) == set(again[0])


@pytest.mark.parametrize("block, broadcast", [(256, 10**6), (2, 0)])
def test_equals_all_pairs(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(j, "BLOCK", block)
    monkeypatch.setattr(j, "QUERIES", 3 if block == 2 else 1000)
    monkeypatch.setattr(j, "MAX_BROADCAST", broadcast)
    rows = corpus(block)
    got = sorted((tuple(r) for r in j.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == brute(rows)


def test_cross_links_alone_find_all(spark, monkeypatch):
    """Without first links, the matrix has to find everything."""
    monkeypatch.setattr(j, "_first_links", lambda docs, classes: spark.createDataFrame([], "u long, v long"))
    rows = corpus(7)
    got = sorted((tuple(r) for r in j.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == brute(rows)


def test_threshold_is_exact(spark):
    base = [f"t{i}" for i in range(104)]
    near = lambda k, other: " ".join([*base[:-k], *[f"{other}{i}" for i in range(k)]])
    # 100 shingles each, k of them differ: (100 - k) / (100 + k) >= 0.8 up to k = 11
    rows = [(5, " ".join(base)), (3, near(11, "u")), (2, near(12, "v"))]
    got = {r.doc_id: r.component_id for r in j.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {5: 3, 3: 3, 2: 2}


def test_keep_one_and_empty(spark):
    rows = [(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (2, "other words stay here now", "z"), (4, None, "n"), (1, "A b c d e f", "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", label string")
    assert sorted((r.doc_id, r.label) for r in j.keep_one(df).collect()) == [(1, "y"), (1, "y"), (2, "z"), (4, "n")]
    assert j.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_frequent_summary_keeps_what_is_frequent():
    f = j._Frequent(4)
    for i in range(3000):
        f.add(np.array([1, 2, 1000 + 3 * i, 1001 + 3 * i], np.uint64))
        if i % 500 == 0:
            f.fold()
    f.fold()
    assert {1, 2} <= set(f.keys.tolist()) and len(f.keys) <= 4
