"""Secret scans through a trigram inverted index.

Every rule's regex is turned into a Boolean query over trigrams that any match
must contain, in disjunctive form: a rule can match only where all trigrams of
one of its clauses occur (in either case).  The index holds postings
(trigram, document key) of the trigrams that some rule asks for.  Intersecting
postings per clause gives each document's candidate rules; their regexes then
run on the whole text.  Rules whose query is empty scan every text.

Candidates are a superset by construction, so verified spans never depend on
the index.  Null texts count as empty.  Repeated rows give repeated results.
Rows keep their order of columns; ``spans`` is added, or replaced if there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as code
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import let, text_key

#: Alternatives that a literal run may have, and clauses a query may have,
#: before the rest of the regex is left unconstrained (a weaker query is safe).
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A regex in the syntax Java and Python share, and a test of each match.

    Matches are leftmost and non-overlapping; those whose ``group`` is shorter
    than ``least`` characters are dropped afterwards.
    """

    kind: str
    regex: str
    least: int = 1
    group: int = 0


#: Fixed patterns of the base kinds.  Runs of 24 and more hexadecimal digits
#: are exactly the long ones among maximal runs, and scanning for them is fast.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Published formats that the base kinds miss.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset({frozenset()})


def _either(a: Clauses, b: Clauses) -> Clauses:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _all(a: Clauses, b: Clauses) -> Clauses:
    joined = frozenset(x | y for x in a for y in b)
    out = frozenset(x for x in joined if not any(y < x for y in joined))
    return out if len(out) <= MAX_ALTERNATIVES else a


def _of_strings(found: set[str]) -> Clauses:
    out: Clauses = frozenset()
    for s in found:
        out = _either(out, frozenset({frozenset(s[i : i + 3] for i in range(len(s) - 2))}))
    return out


def _strings(op, arg) -> set[str] | None:
    """All lower-cased strings a node matches, if they are few."""
    if op is code.LITERAL:
        return {chr(arg).lower()}
    if op is code.IN:
        if arg[0][0] is code.NEGATE or any(k not in (code.LITERAL, code.RANGE) for k, _ in arg):
            return None
        got = {chr(c).lower() for k, v in arg for c in (range(v[0], v[1] + 1) if k is code.RANGE else [v])}
        return got if len(got) <= 8 else None
    if op is code.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is code.BRANCH:
        arms = [_sequence_strings(x) for x in arg[1]]
        return set().union(*arms) if all(x is not None for x in arms) else None
    if op is code.MAX_REPEAT and arg[1] <= 4:
        body = _sequence_strings(arg[2])
        if body is None:
            return None
        out: set[str] = set()
        for times in range(arg[0], arg[1] + 1):
            grown = {""}
            for _ in range(times):
                grown = {a + b for a in grown for b in body}
                if len(grown) > MAX_ALTERNATIVES:
                    return None
            out |= grown
        return out if len(out) <= MAX_ALTERNATIVES else None
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > MAX_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in more}
    return out


def _inside(op, arg) -> Clauses:
    """Trigrams that a node without a short list of strings still demands."""
    if op is code.SUBPATTERN:
        return _sequence_query(arg[-1])
    if op is code.BRANCH:
        out: Clauses = frozenset()
        for arm in arg[1]:
            out = _either(out, _sequence_query(arm))
        return out
    if op is code.MAX_REPEAT and arg[0] >= 1:
        return _sequence_query(arg[2])
    return ANY


def _sequence_query(nodes) -> Clauses:
    query, run = ANY, {""}
    for op, arg in nodes:
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= MAX_ALTERNATIVES:
            run = {a + b for a in run for b in more}
            continue
        query = _all(query, _of_strings(run))
        run = more if more is not None else {""}
        if more is None:
            query = _all(query, _inside(op, arg))
    return _all(query, _of_strings(run))


def trigram_query(regex: str) -> Clauses:
    """Clauses of lower-case trigrams, one of which is wholly in every match; ``ANY`` if none is sure."""
    if re.search(r"\\[1-9]|\(\?[=!<]", regex):
        return ANY
    return _sequence_query(parser.parse(regex))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: distinct (``trigram``, ``k``) of each row, for the given trigrams."""
    by_first: dict[str, list[str]] = {}
    for t in sorted(set(trigrams)):
        by_first.setdefault(t[0], []).append(re.escape(t[1:]))
    pattern = "(?i)(?=(" + "|".join(f"{re.escape(a)}(?:{'|'.join(rest)})" for a, rest in by_first.items()) + "))"
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.lower))
    return docs.select(text_key().alias("k"), F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``k`` and ``rules``, the kinds that the index leaves open for its text; one row per key."""
    clauses = [(r.kind, sorted(c)) for r in rules for c in sorted(trigram_query(r.regex), key=sorted) if c]
    spark = docs.sparkSession
    # one row per trigram of a clause: bounded by the rules
    terms = [(t, n, 1 << i) for n, (_, trigrams) in enumerate(clauses) for i, t in enumerate(trigrams)]
    wanted = spark.createDataFrame(terms, "trigram string, clause int, bit long")
    asked = postings(docs, [t for t, _, _ in terms]).join(F.broadcast(wanted), "trigram")
    # a clause is met when the bits of all its trigrams have come together; equal rows add nothing
    masks = [F.bit_or(F.when(F.col("clause") == n, F.col("bit"))).alias(f"m{n}") for n in range(len(clauses))]
    met = [F.when(F.col(f"m{n}") == (1 << len(c)) - 1, F.lit(kind)) for n, (kind, c) in enumerate(clauses)]
    open_rules = asked.groupBy("k").agg(*masks).select("k", F.array_distinct(F.array_compact(F.array(*met))).alias("rules"))
    return open_rules.where(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """(start, order, end, kind) of a rule's matches, in code points, end exclusive."""
    empty = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string>>)")
    pair = F.struct(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)).alias("found"), F.split(text, rule.regex).alias("gap"))

    def placed(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(p["gap"], i))
            end = start + F.length(F.get(p["found"], i))
            at = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], at).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        every = F.aggregate(F.sequence(F.lit(0), F.size(p["found"]) - 1), begin, step, lambda acc: acc["out"])
        if rule.least > 1:
            long_enough = F.transform(p["found"], lambda m: F.length(F.regexp_extract(m, rule.regex, rule.group)) >= rule.least)
            every = let(F.struct(every.alias("s"), long_enough.alias("ok")), lambda q: F.filter(q["s"], lambda s, i: F.get(q["ok"], i)))
        return F.when(F.size(p["found"]) > 0, every).otherwise(empty)

    return F.when(text.rlike(rule.regex), let(pair, placed)).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``, sorted by start, then as rules are listed."""
    free = {r.kind for r in rules if trigram_query(r.regex) == ANY}
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = [
        spans_of(text, r, n)
        if r.kind in free
        else F.when(F.array_contains("__rules", r.kind), spans_of(text, r, n)).otherwise(F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>"))
        for n, r in enumerate(rules)
    ]
    kept = [c for c in docs.columns if c != "spans"]
    if len(free) < len(rules):
        found = candidates(docs, rules).select(F.col("k").alias("__k"), F.col("rules").alias("__rules"))
        docs = docs.join(found, text_key() == F.col("__k"), "left")
    return docs.select(*kept, F.array_sort(F.concat(*listed)).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs.select("doc_id", "text"), rules).select(
        "doc_id",
        *[count(r.kind) for r in BASE],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )
