"""Benchmark decontamination with a hash set of normalised test n-grams.

A window is ``n`` consecutive item words; an item with fewer is one window.
Each document is cut into words in place, every run of as many words as some
window has gets a 64-bit fingerprint, and runs whose fingerprint is in the set
of window fingerprints are candidates.  Only they leave the row: their words
are compared with the windows' own, so a fingerprint collision changes nothing.

Repeated rows give repeated results.  Null and wordless texts have no words, are
never hit and stay.  Windows of items with null id hit words but are no item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, text_key

#: Between words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows whose fingerprints travel with each task (8 bytes each); a larger
#: benchmark takes the route by a shuffled join.
MAX_SET = 50_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct ``item_id, len, window`` of a benchmark; ``window`` is joined by blanks."""
    cut = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    return cut.select(
        "item_id",
        F.least(F.size("w"), F.lit(n)).alias("len"),
        F.explode(
            F.expr(f"transform(sequence(0, greatest(size(w) - {n}, 0)), i -> concat_ws(' ', slice(w, i + 1, {n})))")
        ).alias("window"),
    ).distinct()


def _fingerprint(length: int, at: str = "i") -> str:
    return "xxhash64(" + ", ".join(f"get(h, {at} + {k})" for k in range(length)) + ")"


def _runs(length: int, keep: str) -> str:
    """SQL: starts of the runs of ``length`` word hashes that ``keep`` accepts."""
    return f"CASE WHEN size(h) >= {length} THEN filter(sequence(0, size(h) - {length}), i -> {keep}) ELSE array() END"


def _candidates(keyed: DataFrame, fingerprints: list[tuple[int, int]]) -> DataFrame:
    """``keyed`` with ``cand``, an array of (at, len), by membership in a set."""
    by_length: dict[int, list[int]] = {}
    for length, value in fingerprints:
        by_length.setdefault(length, []).append(value)
    parts = []
    for length, values in sorted(by_length.items()):
        members = ", ".join(f"{v}L" if v > -(2**63) else "bigint('-9223372036854775808')" for v in values)
        keep = f"{_fingerprint(length)} IN ({members})"
        parts.append(f"transform({_runs(length, keep)}, i -> struct(int(i) AS at, {length} AS len))")
    # h is bound once: a filter over a one-element array
    body = f"concat({', '.join(parts)})"
    return keyed.withColumn("cand", F.expr(f"get(transform(array(transform(w, x -> xxhash64(x))), h -> {body}), 0)"))


def _candidates_by_join(keyed: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark of any size: runs meet fingerprints in a join.

    Equal rows share a key, so positions are gathered as sets.
    """
    runs = None
    for length in lengths:
        listed = f"transform({_runs(length, 'true')}, i -> struct(int(i) AS at, {length} AS len, {_fingerprint(length)} AS fp))"
        cut = keyed.select("k", F.explode(F.expr(f"get(transform(array(transform(w, x -> xxhash64(x))), h -> {listed}), 0)")).alias("r"))
        runs = cut if runs is None else runs.unionByName(cut)
    found = (
        runs.select("k", "r.at", "r.len", "r.fp")
        .join(prints, ["len", "fp"], "left_semi")
        .groupBy("k")
        .agg(F.collect_set(F.struct("at", "len")).alias("cand"))
    )
    return keyed.join(found, "k", "left").withColumn("cand", F.coalesce("cand", F.expr("cast(array() as array<struct<at:int,len:int>>)")))


def _cut(docs: DataFrame) -> DataFrame:
    return docs.select(text_key().alias("k"), "doc_id", words_of(F.col("text")).alias("w"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_set: int = MAX_SET) -> DataFrame:
    """Per row of ``docs``: ``k, doc_id, n_words``, ``runs`` (at, len) hit and ``items`` (ids as text, sorted)."""
    wins = windows(benchmark, n)
    by_words = F.expr("get(transform(array(transform(split(window, ' '), x -> xxhash64(x))), h -> CASE "
                      + " ".join(f"WHEN len = {k} THEN {_fingerprint(k, '0')}" for k in range(1, n + 1)) + " END), 0)")
    prints = wins.select("len", by_words.alias("fp")).distinct()
    # at most max_set + 1 rows reach the driver
    held = [(r.len, r.fp) for r in prints.limit(max_set + 1).collect()]
    keyed = _cut(docs)
    fits = len(held) <= max_set
    if not held:
        cand = keyed.withColumn("cand", F.expr("cast(array() as array<struct<at:int,len:int>>)"))
    elif fits:
        cand = _candidates(keyed, held)
    else:
        lengths = sorted(r.len for r in prints.select("len").distinct().collect())
        cand = _candidates_by_join(keyed, prints, lengths)
    # every row of docs brings one sentinel (at -1), so that its copies are counted
    listed = cand.select(
        "k", "doc_id", F.size("w").alias("n_words"),
        F.explode(F.expr(
            "concat(array(struct(-1 AS at, 0 AS len, cast(null as string) AS window)), "
            "transform(cand, c -> struct(c.at AS at, c.len AS len, concat_ws(' ', slice(w, c.at + 1, c.len)) AS window)))"
        )).alias("c"),
    ).select("k", "doc_id", "n_words", "c.at", "c.window", F.col("c.len").alias("len"))
    named = wins.select("window", F.col("item_id").cast("string").alias("item"), F.lit(True).alias("found"))
    verified = listed.join(F.broadcast(named) if fits else named, "window", "left")
    found = verified.groupBy("k", "doc_id", "n_words").agg(
        F.count_if(F.col("at") == -1).alias("copies"),
        F.collect_set(F.when(F.col("found"), F.struct("at", "len"))).alias("runs"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    return found.select("k", "doc_id", "n_words", "runs", "items", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).drop("_")


def covered(runs: Column) -> Column:
    """Distinct word positions inside any of ``runs``."""
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["at"], r["at"] + r["len"] - 1))))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_set: int = MAX_SET) -> DataFrame:
    """Per row of ``docs``: how much of it benchmark windows cover, and which items."""
    return hits(docs, benchmark, n, max_set).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(covered(F.col("runs"))).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: str = "documents", n: int = 10, max_set: int = MAX_SET) -> DataFrame:
    """``docs`` without contaminated documents, or (``how='spans'``) without the words that windows cover.

    All columns of ``docs`` stay as they are, ``text`` aside: a removed word goes
    with what stands between it and the next word.
    """
    if how not in ("documents", "spans"):
        raise ValueError(f"how is 'documents' or 'spans', not {how!r}")
    bad = hits(docs, benchmark, n, max_set).where("size(runs) > 0")
    if how == "documents":
        return docs.join(bad.select(F.col("k").alias("__k")), text_key() == F.col("__k"), "left_anti")
    drop = bad.select(F.col("k").alias("__k"), covered(F.col("runs")).alias("__drop")).dropDuplicates(["__k"])
    names = docs.columns
    pieces = F.expr(
        r"""get(transform(array(struct(regexp_extract_all(text, '{w}', 0) AS w, split(text, '{w}') AS gap)), p ->
            concat(get(p.gap, 0), array_join(transform(p.w, (x, i) ->
                CASE WHEN array_contains(__drop, i) THEN '' ELSE concat(x, get(p.gap, i + 1)) END), ''))), 0)""".format(
            w=RAW_WORD.replace("\\", "\\\\")
        )
    )
    joined = docs.join(drop, text_key() == F.col("__k"), "left")
    return joined.withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(pieces)).select(*names)
