"""Cheapest repair of conversations by weighted interval parsing.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles.  The
repair grammar is in Chomsky normal form: a nonterminal ``[p, q]`` derives rows
whose repair leads the automaton of that language from state p to q, with the
binary rules ``[p, q] -> [p, r] [r, q]`` and one terminal rule per edit of a row.
The cell of a span holds, for each nonterminal, the least (cost, audit), where the
audit spells the edits.  Insertions are closed in: every cell of a row may be
preceded and followed by inserted turns.

Cells are combined bottom up by span length, and a product of cells keeps the
minimum because appending never changes the order of two audits of equal cost
(none is a prefix of the other, both name the same rows).  Every derivation of a
span passes some state at every split of it, so one split per span is enough:
spans are halved within a block of turns, blocks of a long conversation join
their cells in rounds, and no conversation has to lie in one task to be parsed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turn numbers of a block, and blocks that one round joins.
BLOCK = 128
#: States: nothing yet, after the system turn, after a user's, after an assistant's; the first and the last accept.
STATES, ACCEPTING = range(4), (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
LEGAL = ("su", "ua", "au")
#: Symbols of rows by their role's initial: whole, truncated, and to be deleted.
INITIALS, WHOLE, CUT, GONE = "suax", "suax", "SUAX", "0123"

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cell: Cell, at: tuple[int, int], cost: int, audit: str) -> None:
    if at not in cell or (cost, audit) < cell[at]:
        cell[at] = (cost, audit)


def product(a: Cell, b: Cell) -> Cell:
    """The cell of two spans one after the other."""
    out: Cell = {}
    for (p, r), (cost, audit) in a.items():
        for q in STATES:
            if (r, q) in b:
                _least(out, (p, q), cost + b[r, q][0], audit + b[r, q][1])
    return out


def _insertions() -> Cell:
    cell: Cell = {(p, p): (0, "") for p in STATES}
    once = {(p, q): (INSERT, "I") for (p, role), q in STEP.items() if role != "s"}
    for _ in STATES:
        for at, (cost, audit) in list(product(cell, once).items()):
            _least(cell, at, cost, audit)
    return cell


INSERTED = _insertions()


@lru_cache(maxsize=64)
def _terminal(symbol: str) -> Cell:
    cell: Cell = {(p, p): (DELETE, "D") for p in STATES}
    kind = next(k for k in (WHOLE, CUT, GONE) if symbol in k)
    if kind != GONE:
        more, initial = (TRUNCATED if kind == CUT else 0), INITIALS[kind.index(symbol)]
        for (p, role), q in STEP.items():
            if role == initial:
                _least(cell, (p, q), more, "K")
            if role != "s":
                _least(cell, (p, q), more + REROLE, "R")
    return product(product(INSERTED, cell), INSERTED)


def parse(symbols: str) -> Cell:
    """The cell of the rows that ``symbols`` stand for."""
    if len(symbols) <= 1:
        return _terminal(symbols) if symbols else INSERTED
    half = 1 << (len(symbols) - 1).bit_length() - 1
    part = _short if half <= 64 else parse
    return product(part(symbols[:half]), part(symbols[half:]))


_short = lru_cache(maxsize=20_000)(parse)


def _initials(symbols: str) -> str:
    return symbols.translate(str.maketrans(CUT + GONE, INITIALS * 2))


# A part of a conversation travels as text: illegal pairs, first and last initial, then the cells.


def _written(illegal: int, first: str, last: str, cell: Cell) -> str:
    cells = (f"{cell[p, q][0]} {cell[p, q][1]}" if (p, q) in cell else "" for p in STATES for q in STATES)
    return ";".join([str(illegal), first, last, *cells])


def _read(part: str) -> tuple[int, str, str, Cell]:
    illegal, first, last, *cells = part.split(";")
    cell = {}
    for k, text in enumerate(cells):
        if text:
            cost, audit = text.split(" ")
            cell[divmod(k, 4)] = (int(cost), audit)
    return int(illegal), first, last, cell


@lru_cache(maxsize=20_000)
def _part(symbols: str) -> str:
    roles = _initials(symbols)
    illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))
    return _written(illegal, roles[:1], roles[-1:], parse(symbols))


def _joined(parts: list[str]) -> str:
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    (i, f, m, a), (j, n, z, b) = _read(_joined(parts[:half])), _read(_joined(parts[half:]))
    return _written(i + j + bool(m and n and m + n not in LEGAL), f or n, z or m, product(a, b))


@F.arrow_udf(T.StringType())
def _parts(symbols: pa.Array) -> pa.Array:
    return pa.array([_part(s) for s in symbols.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _rejoined(parts: pa.Array) -> pa.Array:
    return pa.array([_joined(p) for p in parts.to_pylist()], pa.string())


@F.arrow_udf(T.StructType().add("illegal", T.LongType()).add("cost", T.LongType()).add("audit", T.StringType()))
def _decided(parts: pa.Array) -> pa.Array:
    out = []
    for p in parts.to_pylist():
        illegal, first, _, cell = _read(_joined(p))
        cost, audit = min(cell[0, q] for q in ACCEPTING) if first else (0, "")
        out.append({"illegal": illegal, "cost": cost, "audit": audit})
    return pa.array(out, pa.struct([("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))


def _rows(turns: DataFrame) -> DataFrame:
    """The columns that count, nulls of role and text as one blank, and a digest that orders rows of one turn."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))


def _symbols(rows: DataFrame, copies: Column) -> DataFrame:
    """Equal rows as one, with their symbols and the counts of first faults."""
    has, ended = F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = rows.select("conv_id", "turn", "role", "digest", copies.alias("m"), (~has).alias("is_blank"), (~ended).alias("is_cut"))
    # a row without copies only keeps its conversation in the table
    light = light.select("conv_id", "m", "is_blank", "is_cut", *[F.when(F.col("m") > 0, F.col(c)).alias(c) for c in ("turn", "role", "digest")])
    equal = light.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("m").alias("m"), F.first("is_blank").alias("is_blank"), F.first("is_cut").alias("is_cut"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    kind = F.coalesce(F.expr(f"nullif(locate(left(role, 1), '{INITIALS[:3]}'), 0)"), F.lit(len(INITIALS)))
    kind = F.when(F.col("role") == "", len(INITIALS)).otherwise(kind)
    at = lambda letters: F.lit(letters).substr(F.col("kind"), F.lit(1))
    first = F.when(F.col("is_blank") | F.col("seen"), at(GONE)).when(F.col("is_cut"), at(CUT)).otherwise(at(WHOLE))
    more = F.expr("cast(m - 1 as int)")
    number = lambda c: c.cast("long")
    return equal.withColumns({"seen": seen, "kind": kind}).select(
        "conv_id",
        "turn",
        "role",
        "digest",
        F.when(F.col("m") == 0, "").otherwise(F.concat(first, F.repeat(at(GONE), more))).alias("symbols"),
        number(F.when(F.col("is_blank"), F.col("m")).otherwise(0)).alias("blank"),
        number(F.when(F.col("is_blank"), 0).otherwise(F.greatest(F.col("m") - 1, F.lit(0)) + F.when(F.col("seen"), 1).otherwise(0))).alias("duplicate"),
        number(F.when(~F.col("is_blank") & ~F.col("seen") & F.col("is_cut") & (F.col("m") > 0), 1).otherwise(0)).alias("truncated"),
    )


COUNTS = ("blank", "duplicate", "truncated")


def repairs(turns: DataFrame, copies: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: ``gaps``, first faults, ``illegal`` pairs, ``cost`` and ``audit`` of the cheapest repair.

    ``turns`` has ``conv_id, turn, role, text``; other columns are not read.  Rows are taken by turn,
    nulls first, rows of one turn by role and a digest of the text.  ``copies`` says how often a row
    counts, 0 to leave only its conversation.  Null roles and texts are one blank, a null ``conv_id`` is
    a conversation.  A role without a known initial cannot be kept.  A conversation without rows has
    zeros and the empty audit; an empty table gives an empty one.

    Blocks hold ``block`` turn numbers, however many rows these have; the number of rounds grows
    with the logarithm of the largest range of turns.
    """
    copies = F.lit(1) if copies is None else copies
    spread = turns.groupBy("conv_id").agg((F.max("turn").cast("double") - F.min("turn").cast("double")).alias("s")).agg(F.max("s")).first()[0] or 0.0
    rows = _symbols(_rows(turns), copies)
    sums = lambda: [F.sum(c).alias(c) for c in COUNTS]
    ends = lambda: [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns")]
    width = block
    keys = lambda: ["conv_id", F.floor(F.col("low") / width).alias("at")] if spread >= width else ["conv_id"]
    ordered = F.sort_array(F.collect_list(F.struct("low", "role", "digest", "symbols")))
    parts = (
        rows.withColumnRenamed("turn", "low")
        .groupBy(*keys())
        .agg(ordered.alias("r"), F.min("low").alias("least"), F.max("low").alias("high"), *sums())
        .withColumn("turns", F.size(F.array_distinct(F.filter(F.transform("r", lambda x: x.low), lambda x: x.isNotNull()))).cast("long"))
        .withColumn("part", _parts(F.array_join(F.transform("r", lambda x: x.symbols), "")))
        .select("conv_id", F.col("least").alias("low"), "high", "turns", *COUNTS, "part")
    )
    gather = F.sort_array(F.collect_list(F.struct("low", "part")))
    while spread >= width:
        width *= block
        parts = parts.groupBy(*keys()).agg(gather.alias("p"), *ends(), *sums())
        parts = parts.withColumn("part", _rejoined(F.transform("p", lambda x: x.part))).drop("p", "at")
    return parts.withColumn("best", _decided(F.array("part"))).select(
        "conv_id",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
        *COUNTS,
        "best.illegal",
        "best.cost",
        "best.audit",
    )


class _Walk:
    """Rows of one conversation after the other, with the edits of its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.user = audit, 0, True

    def _turn(self, role: str | None, text: str) -> tuple[str, str]:
        role = role or ("user" if self.user else "assistant")
        self.user = role[0] != "u"
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn(None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._turn(role if edit == "K" else None, text)


def _with_heads(turns: DataFrame, found: DataFrame, copies: Column) -> DataFrame:
    """Conversations one after the other in partitions: the row of ``found``, then the rows that it repairs."""
    stats = F.struct(*[F.col(c) for c in found.columns if c != "conv_id"])
    heads = found.select("conv_id", F.lit(0).alias("body"), F.lit(None).cast("bigint").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "digest", "text")], stats.alias("found"))
    rows = _rows(turns).select("conv_id", "turn", "role", "digest", "text", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("body"))
    both = heads.unionByName(rows.withColumn("found", F.lit(None).cast(heads.schema["found"].dataType)).withColumn("turn", F.col("turn").cast("bigint")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "body", "turn", "role", "digest").select("conv_id", "body", "role", "text", "found")


def repaired(turns: DataFrame, found: DataFrame, copies: Column | None = None) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id, place, role, text``, ``place`` from 0.

    ``found`` is ``repairs`` of the same ``turns`` and ``copies``.  A task streams its conversations in
    order and holds one batch of rows.
    """
    rows = _with_heads(turns, found.select("conv_id", "audit"), F.lit(1) if copies is None else copies)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, place, kind = None, None, 0, None
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            kind = batch.schema.field("conv_id").type

            def put(more, out=out):
                nonlocal place
                for role, text in more:
                    for column, x in zip(out, (conv, place, role, text), strict=True):
                        column.append(x)
                    place += 1

            for c, body, role, text, head in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if body:
                    put(now.row(role, text))
                else:
                    if now:
                        put(now.inserted())
                    now, conv, place = _Walk(head["audit"]), c, 0
            yield _batch(out, kind)
        if now:
            last = list(now.inserted())
            yield _batch(([conv] * len(last), list(range(place, place + len(last))), [r for r, _ in last], [t for _, t in last]), kind)

    def _batch(columns, kind) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "place", "role", "text"])

    conv = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(walk, f"conv_id {conv}, place bigint, role string, text string")


def digests(turns: DataFrame, found: DataFrame, copies: Column | None = None) -> DataFrame:
    """``found`` with ``repaired_sha256``, of the repaired rows ``role:text`` joined by line feeds.

    A hash runs along its conversation, so a conversation streams through one task; no rows are gathered.
    """
    rows = _with_heads(turns, found, F.lit(1) if copies is None else copies)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, stats, kinds = None, None, None, None

        def feed(more) -> None:
            nonlocal gap
            for role, text in more:
                sha.update(f"{gap}{role}:{text}".encode("utf-8", "surrogatepass"))
                gap = "\n"

        def closed() -> tuple:
            feed(now.inserted())
            return conv, stats, sha.hexdigest()

        def table(done: list[tuple]) -> pa.RecordBatch:
            ids, found, hashes = zip(*done, strict=True) if done else ((), (), ())
            columns = pa.array(found, kinds[1]).flatten()
            return pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), *columns, pa.array(hashes, pa.string())], names=["conv_id", *(f.name for f in kinds[1]), "repaired_sha256"])

        gap, sha = "", hashlib.sha256()
        for batch in batches:
            kinds = (batch.schema.field("conv_id").type, batch.schema.field("found").type)
            done = []
            for c, body, role, text, head in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if body:
                    feed(now.row(role, text))
                else:
                    if now:
                        done.append(closed())
                    now, conv, stats, gap, sha = _Walk(head["audit"]), c, head, "", hashlib.sha256()
            yield table(done)
        if now:
            yield table([closed()])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return rows.mapInArrow(walk, f"{fields}, repaired_sha256 string")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """``conv_id, turn, role, text`` after damage by a checksum of id and turn, and how often each row counts."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.withColumns({"role": role, "text": text}), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)


def report(turns: DataFrame) -> DataFrame:
    """The repair of every conversation after ``damaged``."""
    rows, copies = damaged(turns)
    return digests(rows, repairs(rows, copies), copies)
