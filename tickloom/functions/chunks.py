"""Order-dependent work on groups of any size.

A hot key is cut along its own order into chunks.  Each chunk is processed
alone; what it needs from earlier rows is a small state per chunk, carried over
a table with one row per chunk.  The cut rows are read twice, so they are written
once: steps that follow each other would double their work with every step.
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


def _given(chunk: Column | None) -> Column:
    if chunk is None:
        raise ValueError("a key without a bound on its rows needs a chunk expression")
    return chunk


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    rows: int | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Attach ``prev_<value>`` of the preceding row of the key.

    ``rows`` bounds one key's rows.  Without a bound ``chunk`` must be an
    expression that never decreases along ``order``.
    """
    if fits_task(rows):
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns({f"prev_{v}": F.lag(v).over(w) for v in values})
    cut = checkpointed(df.withColumn("_chunk", _given(chunk)))
    w = W.partitionBy(*keys, "_chunk").orderBy(*order)
    inner = cut.withColumns({f"prev_{v}": F.lag(v).over(w) for v in values} | {"_i": F.row_number().over(w)})
    last = F.max_by(F.struct(*values), F.struct(*order))
    ends = cut.groupBy(*keys, "_chunk").agg(last.alias("_last"))
    carried = ends.select(
        *keys, "_chunk", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_chunk_carry")
    )
    first = F.col("_i") == 1
    return (
        inner.join(carried, [*keys, "_chunk"])
        .withColumns(
            {f"prev_{v}": F.when(first, F.col(f"_chunk_carry.{v}")).otherwise(F.col(f"prev_{v}")) for v in values}
        )
        .drop("_chunk", "_i", "_chunk_carry")
    )


def with_running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    rows: int | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Attach running totals along the order of each key."""
    if fits_task(rows):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(col).over(w) for name, col in sums.items()})
    cut = checkpointed(df.withColumn("_chunk", _given(chunk)))
    totals = cut.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums])
    w = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = cut.withColumns({name: F.sum(col).over(w) for name, col in sums.items()})
    joined = inner.join(offsets, [*keys, "_chunk"])
    total = {n: F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in sums}
    return joined.withColumns(total).drop("_chunk", *[f"_o_{n}" for n in sums])


def key_changes(own: pa.Table, row: pa.Table | None) -> np.ndarray:
    """Which rows have other keys than the row before; ``row`` comes before the first."""
    seen = own if row is None else pa.concat_tables([row, own])
    new = np.zeros(len(seen) - 1, dtype=bool)
    for column in seen.columns:
        now, before = column.slice(1), column.slice(0, len(seen) - 1)
        differs = pc.coalesce(pc.not_equal(now, before), pc.xor(pc.is_null(now), pc.is_null(before)))
        new |= differs.to_numpy()
    return np.append(True, new) if row is None else new
