"""Multiset hashes: algebra, likeness, edits and odd rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tickloom.llm import multiset_hash as mh

SCHEMA = "doc_id long, text string, h string"


def plain(text):
    """The fingerprint in hex, by integers of Python."""
    strong, lanes = [0] * 16, [0] * 240
    for line in text.split("\n"):
        for k in range(4):
            digest = hashlib.sha256(f"{k}:{line}".encode()).hexdigest()
            for j in range(4):
                strong[4 * k + j] = (strong[4 * k + j] + int(digest[16 * j : 16 * j + 16], 16)) % 2**62
    phrases = [m.group() for m in re.finditer(mh.PHRASE, text)]
    for phrase in phrases:
        digest = hashlib.sha256(phrase.encode()).hexdigest()
        for w in range(4):
            word = int(digest[16 * w : 16 * w + 16], 16)
            for i in range(20):
                for f in range(3):
                    lanes[60 * w + 3 * i + f] += word >> (i + 20 * f) & 1
    n = len(phrases)
    packed = [sum(lanes[3 * k + f] % 2**19 << 20 * f for f in range(3)) for k in range(80)]
    return "".join(f"{x:016x}" for x in [n, *strong, *packed]), [2 * c - n for c in lanes]


def near(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    total = dot(a, a) + dot(b, b)
    return 1.0 if not total else min(max(2 * dot(a, b) / total, 0.0), 1.0)


def corpus(n=60):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 8)))
    text = lambda: "\n".join(" ".join(word() + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8)))
    rows = [(3 * i, text(), "x") for i in range(n)]
    return rows + [(1, None, "x"), (2, "", None), (4, "a", "x"), (5, "\n\n", "x"), (7, " \t ", "x"), (None, "no id here", "x"), (8, "é. " * 20_000, "x")]


def test_report_equals_plain_integers(spark):
    rows = corpus()
    for size in (1 << 30, 2000):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = mh.report(df, size).collect()
        order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
        assert len(got) == len(order)
        by_id = {r.doc_id: r for r in got}
        for k, (i, text) in enumerate(order):
            follow, n = order[(k + 1) % len(order)][1], len(text)
            edited = text[: n - n // 2] + follow[: n // 2]
            (f, a), (e, b), (_, c) = plain(text), plain(edited), plain(follow)
            r = by_id[i]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, hashlib.sha256(edited.encode()).hexdigest(), f, e)
            assert abs(r.near_edited - near(a, b)) < 1e-12 and abs(r.near_next - near(a, c)) < 1e-12


def test_order_does_not_count_and_paragraphs_come_and_go(spark):
    a, b, c = "one two three.", "four five", "  six\tseven  "
    df = spark.createDataFrame([(f"{a}\n{b}\n{c}\n{b}", f"{b}\n{c}\n{b}\n{a}", f"{a}\n{b}\n{c}", a, f"{b}\n{c}", b)], "all string, turned string, fewer string, a string, rest string, b string")
    f = {n: mh.fingerprint(F.col(n)) for n in df.columns}
    fs = df.select(*[x.alias(n) for n, x in f.items()])
    c = lambda n: F.col(n)
    row = fs.select(
        (mh.as_text(c("all")) == mh.as_text(c("turned"))).alias("same"),
        (mh.as_text(c("all")) == mh.as_text(c("fewer"))).alias("count"),
        (mh.as_text(mh.inserted(c("a"), mh.inserted(c("rest"), c("b")))) == mh.as_text(c("all"))).alias("inserted"),
        (mh.as_text(mh.deleted(c("all"), c("b"))) == mh.as_text(c("fewer"))).alias("deleted"),
        mh.likeness(c("all"), c("turned")).alias("near"),
    ).first()
    assert row.asDict() == {"same": True, "count": False, "inserted": True, "deleted": True, "near": 1.0}


def test_merged_is_the_sum_of_a_group(spark):
    rows = [(i % 3 if i % 7 else None, f"line {i % 5}\nand {i}", "s") for i in range(200)] + [(0, None, "s")]
    df = spark.createDataFrame(rows, "k long, text string, __k0 string").withColumn("f", mh.fingerprint(F.col("text")))
    got = {r.k: r.t for r in mh.merged(df, ["k"], "f").select("k", mh.as_text(F.col("f")).alias("t")).collect()}
    whole = {k: "\n".join(t or "" for g, t, _ in rows if g == k) for k in (None, 0, 1, 2)}
    assert got == {k: plain(t)[0] for k, t in whole.items()}


def test_halves_are_nearer_than_strangers(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(4000)}" + rng.choice(["", "", "", "."]) for _ in range(rng.randrange(60, 400))) for _ in range(200)]
    got = mh.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.near_edited > r.near_next for r in got)
    assert abs(sum(r.near_edited for r in got) / len(got) - 0.5) < 0.05 and sum(r.near_next for r in got) / len(got) < 0.05


def test_repeats_ties_and_empty(spark):
    rows = [(1, "same", "x")] * 40 + [(1, "other", "x"), (2, "z", "x")]
    got = mh.report(spark.createDataFrame(rows, SCHEMA), 100).collect()
    assert len(got) == 42 and len({r.fingerprint for r in got}) == 3
    assert sum(r.edited_sha256 == hashlib.sha256(b"sasa").hexdigest() for r in got) == 39
    assert mh.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mh.report(spark.createDataFrame([(9, "abcd", "x")], SCHEMA)).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
