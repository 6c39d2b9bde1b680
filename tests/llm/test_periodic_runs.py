"""Runs by block convolution against plain scans of every distance."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tickloom.llm import periodic_runs as pr


def plain(words):
    """All runs by comparing the list with itself at every distance."""
    n, out, whole = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in whole:
                whole.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return [w.decode() for w in words]


def digest(doc_id, text):
    words = planted(doc_id, text)
    runs = plain(words)
    keep = [True] * len(words)
    for s, length, q in runs:
        keep[s + q : s + length] = [False] * (length - q)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for w, k in zip(words, keep, strict=True) if k)))


def test_transform_is_the_exact_convolution():
    rng = np.random.default_rng(1)
    for n in (2, 16, 64, 128, 1024, 8192):
        x = rng.integers(0, 50, (3, n)).astype(float)
        back = pr.transform(pr.transform(x), inverse=True) % pr.PRIME * pow(n, -1, pr.PRIME) % pr.PRIME
        assert (back == x).all()
    codes = rng.integers(0, 3, 4000)
    squares = np.concatenate([[0], np.cumsum(codes * codes)])
    for block in (1, 4, 64, 256):
        starts = np.arange(0, 1000, block)
        got = pr.placements(codes, squares, starts, block, block)
        want = [[(codes[s : s + block] == codes[s + d : s + d + block]).all() for d in range(block, 2 * block)] for s in starts]
        assert (got == np.array(want)).all()


@pytest.mark.parametrize("max_block", [2, 4, pr.MAX_BLOCK])
def test_runs_equal_the_plain_scan(max_block):
    rng = random.Random(max_block)
    texts = []
    for _ in range(250):
        kind, n = rng.randrange(4), rng.randrange(0, 160)
        if kind == 0:
            words = [rng.choice("ab") for _ in range(n)]
        elif kind == 1:
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
            words = [rng.choice("xyz") for _ in range(rng.randrange(9))] + unit * rng.randrange(1, 8) + unit[: rng.randrange(len(unit) + 1)]
        elif kind == 2:
            inner = [rng.choice("ab")] * rng.randrange(1, 9) + [rng.choice("cd")]
            words = (inner * rng.randrange(1, 7) + ["e"]) * rng.randrange(1, 6)
        else:
            words = ["a"] * n
        texts.append(" ".join(words))
    runs, collapsed = pr._texts([*texts, None, ""], max_block)
    assert [[(r["start"], r["length"], r["period"]) for r in one] for one in runs] == [plain(t.split()) for t in texts] + [[], []]
    assert sum(map(len, runs)) > 200 and collapsed[-2:] == ["", ""]


def test_long_texts_take_linear_time():
    one = "a " * 400_000 + " ".join(f"w{i % 70_000}" for i in range(300_000))
    runs, collapsed = pr._texts([one], pr.MAX_BLOCK)
    assert [(r["start"], r["length"], r["period"]) for r in runs[0]] == [(0, 400_000, 1), (400_000, 300_000, 70_000)]
    assert len(collapsed[0].split()) == 70_001


def test_report_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "of", "and", "was"]) for _ in range(rng.randrange(90))), "s") for i in range(150)]
    rows += [(None, "a a a a a a a", "s"), (7, None, None), (8, "", "s"), (9, " \t\n\x0b ", "s"), (3, "q r " * 12, "s"), (3, "q r " * 12, "s"), (11, "x\x0by\rz " * 5, "s")]
    got = pr.report(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    want = [digest(i, t) for i, t, _ in rows if i is not None]
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r)) or sorted(map(repr, (tuple(r) for r in got if r.doc_id is not None))) == sorted(map(repr, want))
    lone = [r for r in got if r.doc_id is None]
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in lone] == [(1, 0, 7, 1, 7000)]
    assert pr.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "b " * 8, "mine", 5)], "id long, body string, collapsed string, `a.b` int")
    row = pr.find_runs(df, "body").first()
    assert row.asDict(True) == {"id": 1, "body": "b " * 8, "a.b": 5, "runs": [{"start": 0, "length": 8, "period": 1}], "collapsed": "b"}
