"""Connected components of an edge table, by alternating large and small stars.

Every round is a few joins and minima; no neighbourhood is ever gathered, so a
hub with millions of neighbours costs as many rows.  Rounds run until nothing
changes, their number grows with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialised


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` (longs, undirected) to ``node, label``, the least node that reaches it.

    Nodes without an edge, or with one to themselves only, are left out; repeated edges are harmless.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    ordered = materialised(ordered, "edges")
    before = None
    while (now := _signature(ordered)) != before:
        before = now
        both = ordered.unionByName(ordered.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        ordered = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        ordered = materialised(ordered.distinct(), "edges")
    # stars: each node points at the least of its component
    roots = ordered.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return ordered.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
