"""Repairs against a search over all edits, whatever the blocks."""

import hashlib
import heapq
import random
import re
import zlib

from tickloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, found int"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """The least (cost, audit, repaired rows) by a best-first search over (row, last initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        if (i, last) in done:
            continue
        done.add((i, last))
        for (a, role), b in STEP.items():
            full = {"u": "user", "a": "assistant"}.get(role)
            if a != last:
                continue
            if full:
                heapq.heappush(heap, (cost + 5, audit + "I", i, b, (*out, (full, ""))))
            if i < len(rows):
                kept, text, fault = rows[i]
                more = 5 * (fault == "truncated")
                if fault not in ("blank", "duplicate"):
                    if kept[:1] == role:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, b, (*out, (kept, text))))
                    if full:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, b, (*out, (full, text))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
    raise AssertionError


def plain(rows):
    """What ``repairs`` and ``digests`` say of one conversation's rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha), out


def conversations(n=120, longest=9, seed=2):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "Yes.", f"Say {t}!", f"cut {t}", " \n", "", None, "é? ", "end.\n", "end "])
            rows.append((c, rng.choice([t, t, t, 2 * t, None, t // 2]), role, text, 1))
    return rows


def grouped(rows):
    out = {}
    for c, t, r, x, *_ in rows:
        out.setdefault(c, []).append((t, r, x))
    return out


def test_repairs_equal_the_search_for_any_block(spark):
    rows = conversations() + [(None, 3, "user", "Hm.", 1), (-7, None, "assistant", None, 1)]
    rows += [(500, 10**12 * k, "user" if k % 2 else "assistant", f"{k}.", 1) for k in range(8)]
    rows += [(501, k, ["user", "assistant"][k % 2], f"turn {k % 9}." if k % 7 else "stub", 1) for k in range(60)]
    want = {c: plain(r)[0] for c, r in grouped(rows).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (2, 16, 128):
        found = cr.repairs(df, block=block)
        got = {r.conv_id: tuple(r)[1:] for r in cr.digests(df, found).collect()}
        assert got == want


def test_repaired_rows(spark):
    rows = conversations(40, seed=4) + [(None, 0, "user", "q.", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in sorted(cr.repaired(df, cr.repairs(df)).collect(), key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.place == len(got[r.conv_id]) - 1
    assert got == {c: out for c, r in grouped(rows).items() if (out := plain(r)[1])}


def test_report_damages_as_stated(spark):
    rows = [r for r in conversations(300, seed=8) if r[0] is not None] + [(None, None, "user", "x.", 1)]
    broken = {c: [] for c, *_ in rows}
    for c, t, role, text, _ in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        broken[c] += [(t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = {r.conv_id: tuple(r)[1:] for r in cr.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: plain(r)[0] if r else nothing for c, r in broken.items()}
    assert nothing in got.values()


def test_many_equal_rows_and_empty_tables(spark):
    rows = [(1, k % 3, "user", "same.", 0) for k in range(3000)] + [(1, 5, "assistant", "Ok.", 0)]
    (r,) = cr.report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert r.duplicate + len(r.audit.replace("D", "")) >= 1 and r.audit.count("D") == r.duplicate and len(r.audit) > 900
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.report(empty).count() == 0 and cr.repaired(empty, cr.repairs(empty)).count() == 0
