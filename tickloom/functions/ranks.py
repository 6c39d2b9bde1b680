"""Exact ranks inside a session.

With a proven bound on the rows of a session one window does it.  Otherwise the
session is cut into value ranges at approximate quantiles: a row's rank is its
rank inside its range plus the rows of the lower ranges.  Equal values always
land in the same range, so the result is exact however rough the cuts are, and
no task sees a whole session.

Scores of many columns need no ranked rows back: within a bound on the values of
a session, ``session_scores`` ranks them side by side in Arrow tasks, one shuffle
for all columns, and returns sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import checkpointed
from tickloom.sizing import fits_task

RANGES = 64
#: Values (rows times columns) of one session a Python task may hold.
TASK_VALUES = 32_000_000


def fits_arrays(rows: int | None, columns: int) -> bool:
    return fits_task(rows) and rows * columns <= TASK_VALUES


def average_rank(value: Column, session: list[str]) -> Column:
    """Average-tie rank as a window expression (bounded sessions only)."""
    ties = F.count(F.lit(1)).over(W.partitionBy(*session, value))
    return F.rank().over(W.partitionBy(*session).orderBy(value)) + (ties - 1) / 2.0


def with_average_ranks(
    df: DataFrame, columns: dict[str, str], session: list[str], rows: int | None
) -> DataFrame:
    """Add ``{output: input}`` average-tie ranks within ``session``.

    ``rows`` bounds the rows of any session; ``None`` means unknown.  Either
    way all columns are ranked together: the number of shuffles does not depend
    on how many there are.
    """
    if fits_task(rows):
        return df.withColumns({o: average_rank(F.col(i), session) for o, i in columns.items()})
    return _split_average(df, columns, session)


def with_ordinal_rank(
    df: DataFrame, value: str, tie: str, out: str, session: list[str], rows: int | None
) -> DataFrame:
    """Add the 1-based position by ``(value, tie)`` within ``session``."""
    if fits_task(rows):
        order = W.partitionBy(*session).orderBy(value, tie)
        return df.withColumn(out, F.row_number().over(order))
    return _split_ordinal(df, value, tie, out, session)


def _cuts(df: DataFrame, value: str, session: list[str], name: str) -> DataFrame:
    # Approximate quantiles differ with the order rows arrive in, and every branch
    # of a plan must cut alike: they are computed once and written.
    points = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    return checkpointed(
        df.groupBy(*session).agg(F.array_distinct(F.percentile_approx(value, points, F.lit(1000))).alias(name))
    )


def _range_of(df: DataFrame, value: str, session: list[str]) -> DataFrame:
    cut = df.join(_cuts(df, value, session, "_cuts"), session)
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    upto = F.size(F.filter("_cuts", lambda c: c <= F.col(value)))
    # Even: values between two cuts.  Odd: exactly the value of one cut, so a
    # value frequent enough to be a cut has a range of its own.
    return cut.withColumn("_range", below + upto).drop("_cuts")


def _offsets(counted: DataFrame, keys: list[str], session: list[str], weight: Column) -> DataFrame:
    """Rows of the session that precede each range (at most a few per session)."""
    before = W.partitionBy(*session).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    totals = counted.groupBy(*session, *keys).agg(F.sum(weight).alias("_n"))
    return totals.select(
        *session, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )


def _split_average(df: DataFrame, columns: dict[str, str], session: list[str]) -> DataFrame:
    # The input is read several times: it is written once, with a row number.
    numbered = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    stacked = numbered.select(
        "_row", *session, F.posexplode(F.array(*[F.col(c).cast("double") for c in columns.values()])).alias("_column", "_value")
    ).where(F.col("_value").isNotNull())
    part = [*session, "_column"]
    # Equal values collapse first: a tie of any size becomes one row.
    counted = stacked.groupBy(*part, "_value").agg(F.count(F.lit(1)).alias("_ties"))
    ranged = _range_of(counted, "_value", part)
    inside = W.partitionBy(*part, "_range").orderBy("_value").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        ranged.withColumn("_inside", F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
        .join(_offsets(ranged, ["_range"], part, F.col("_ties")), [*part, "_range"])
        .select(*part, "_value", (F.col("_before") + F.col("_inside") + (F.col("_ties") + 1) / 2.0).alias("_rank"))
    )
    by_row = stacked.join(ranked, [*part, "_value"]).groupBy("_row").agg(
        *[F.max(F.when(F.col("_column") == i, F.col("_rank"))).alias(out) for i, out in enumerate(columns)]
    )
    return numbered.join(by_row, "_row", "left").drop("_row")


def _split_ordinal(
    df: DataFrame, value: str, tie: str, out: str, session: list[str]
) -> DataFrame:
    # A bounded uniform sample of the tie keys cuts large ties as well.
    sample = (
        df.select(tie).distinct().orderBy(F.xxhash64(tie), tie).limit(RANGES - 1)
        .agg(F.sort_array(F.collect_list(tie)))
    )
    ranged = _range_of(df, value, session)
    keyed = ranged.withColumn("_ties", sample.scalar()).withColumn(
        "_part", F.size(F.filter("_ties", lambda c: c < F.col(tie)))
    ).drop("_ties")
    # Sub-ranges of the tie key order rows of one value: odd ranges only.
    keyed = keyed.withColumn(
        "_part", F.when(F.col("_range") % 2 == 1, F.col("_part")).otherwise(F.lit(0))
    )
    keys = ["_range", "_part"]
    inside = W.partitionBy(*session, *keys).orderBy(value, tie)
    return (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(_offsets(keyed, keys, session, F.lit(1)), [*session, *keys])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_inside", "_before", *keys)
    )


def tie_ranks(values: np.ndarray) -> np.ndarray:
    """Average-tie ranks; NaN equals NaN and comes last, as in an ordering."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    fresh = np.ones(len(v), dtype=bool)
    fresh[1:] = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(v))
    out = np.empty(len(v))
    out[order] = ((starts + ends + 1) / 2.0)[np.cumsum(fresh) - 1]
    return out


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column and where it has one."""
    column = table.column(name)
    return column.to_numpy().astype(float), column.is_valid().to_numpy()


def session_scores(
    df: DataFrame, pairs: dict[str, tuple[str, str]], session: list[str], buckets: int = 5, tie: str | None = None
) -> DataFrame:
    """A row per session and pair ``{label: (signal, forward)}``, over rows that have both.

    ``names`` counts them and ``ic`` is the correlation of their average-tie
    ranks, null when a side is flat.  With ``tie``, ``sums`` and ``counts`` are
    the forward values in buckets of equal size by ``(signal, tie)``.
    """
    used = sorted({c for pair in pairs.values() for c in pair})
    kept = [*session, *used] if tie is None else [*session, tie, *used]
    keys = df.select(*session).schema
    types = "_label string, ic double, names bigint, sums array<double>, counts array<bigint>"

    def score(table: pa.Table) -> pa.Table:
        if tie is not None:
            table = table.take(pc.sort_indices(table, [(tie, "ascending")]))
        columns = {c: _column(table, c) for c in used}
        out = {"_label": [], "ic": [], "names": [], "sums": [], "counts": []}
        for label, (signal, forward) in pairs.items():
            (s, has), (f, have) = columns[signal], columns[forward]
            both = has & have
            n = int(both.sum())
            if not n:
                continue
            s, f = s[both], f[both]
            # centred ranks are multiples of a half: the sums are exact
            a, b = tie_ranks(s) - (n + 1) / 2, tie_ranks(f) - (n + 1) / 2
            spread = np.sqrt(a @ a) * np.sqrt(b @ b)
            out["_label"].append(label)
            out["ic"].append(float(a @ b / spread) if spread > 0 else None)
            out["names"].append(n)
            if tie is None:
                out["sums"].append(None)
                out["counts"].append(None)
                continue
            bucket = np.empty(n, dtype=np.int64)
            bucket[np.argsort(s, kind="stable")] = np.arange(n) * buckets // n
            out["sums"].append(np.bincount(bucket, f, buckets).tolist())
            out["counts"].append(np.bincount(bucket, minlength=buckets).tolist())
        m = len(out["_label"])
        first = table.select(session).slice(0, 1).take(pa.array([0] * m, pa.int64()))
        arrays = [
            pa.array(out["_label"], pa.string()), pa.array(out["ic"], pa.float64()), pa.array(out["names"], pa.int64()),
            pa.array(out["sums"], pa.list_(pa.float64())), pa.array(out["counts"], pa.list_(pa.int64())),
        ]
        return pa.table([*first.columns, *arrays], names=[*session, *out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    return df.select(*kept).groupBy(*session).applyInArrow(score, f"{fields}, {types}")


def session_shares(df: DataFrame, names: list[str], tie: str, session: str) -> DataFrame:
    """Each row's place by ``(value, tie)`` from 0 to 1 among the values of its session, for every column; null where it has none."""

    def place(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(tie, "ascending")]))
        out = []
        for name in names:
            v, has = _column(table, name)
            n = int(has.sum())
            share, mine = np.zeros(len(v)), np.empty(n)
            mine[np.argsort(v[has], kind="stable")] = np.arange(n) / max(n - 1, 1)
            share[has] = mine
            out.append(pa.array(share, mask=~has))
        return pa.table([table.column(session), table.column(tie), *out], names=[session, tie, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(session, tie).schema)
    return df.groupBy(session).applyInArrow(place, fields + "".join(f", `{n}` double" for n in names))


def rank_products(df: DataFrame, names: list[str], session: str) -> DataFrame:
    """A row per session: ``n`` and the centred cross products of its ranks, the upper triangle row by row.

    Every column has a value on every row.
    """
    upper = np.triu_indices(len(names))

    def multiply(table: pa.Table) -> pa.Table:
        n = table.num_rows
        ranks = np.column_stack([tie_ranks(_column(table, c)[0]) for c in names]) - (n + 1) / 2
        cells = (ranks.T @ ranks)[upper]
        return pa.table({"n": pa.array([n], pa.int64()), "products": pa.array([cells.tolist()], pa.list_(pa.float64()))})

    return df.select(session, *names).groupBy(session).applyInArrow(multiply, "n bigint, products array<double>")
