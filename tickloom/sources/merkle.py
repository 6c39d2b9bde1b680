"""Merkle trees over maps from paths to digests.

A path belongs to the leaf named by the first hex digits of its hash, so the tree's form depends on
nothing but the paths: not on the order of rows, their partitions or other entries.  A node
holds sixteen children at most; a leaf holds entries / 16 ** depth on average, so choose
the depth by the number of entries (four digits keep leaves of 100 million entries at some 1,500).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.feeds import changed_files

TREE = "level bigint, node string, digest string, entries bigint"


def leaf_of(path: Column, depth: int) -> Column:
    return F.substring(F.sha2(path, 256), 1, depth)


def _digest(key: str) -> Column:
    """Hash of the pairs (key, digest) of a node, in the order of keys; a null digest counts as the empty text."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.coalesce("digest", F.lit("")).alias("d"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["k"], F.lit("\u0001"), x["d"])), "\u0002"), 256)


def leaves(digests: DataFrame, depth: int = 4, path: str = "path", digest: str = "digest") -> DataFrame:
    """Nodes of the lowest level; rows without a path are no entries."""
    rows = digests.where(F.col(path).isNotNull()).select(leaf_of(F.col(path), depth).alias("node"), F.col(path).alias("path"), F.col(digest).alias("digest"))
    return rows.groupBy("node").agg(_digest("path").alias("digest"), F.count(F.lit(1)).alias("entries"))


def write_tree(digests: DataFrame, folder: str, depth: int = 4) -> None:
    """Write every level, from the leaves up; level 0 is the root.  An empty map has no nodes.

    Each level is made from the written one below, a sixteenth of its size.
    """
    if not 1 <= depth <= 8:
        raise ValueError(f"depth is {depth}, outside [1, 8]")
    spark, level = digests.sparkSession, leaves(digests, depth)
    for number in range(depth, -1, -1):
        level.write.parquet(f"{folder}/level={number}")
        below = spark.read.schema("node string, digest string, entries bigint").parquet(f"{folder}/level={number}")
        parents = below.withColumn("_parent", F.substring("node", 1, number - 1) if number > 1 else F.lit(""))
        level = parents.groupBy(F.col("_parent").alias("node")).agg(_digest("node").alias("digest"), F.sum("entries").alias("entries"))


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TREE).parquet(folder)


def root(tree: DataFrame) -> DataFrame:
    """Digest and number of entries of the whole map, from one row."""
    return tree.where("level = 0").select(F.col("digest").alias("content_hash"), "entries")


def changed_leaves(before: DataFrame, after: DataFrame, depth: int = 4) -> DataFrame:
    """Leaves that differ between two trees, found from the root down.

    A level's nodes are compared only below nodes that differ above, so a small
    change meets sixteen nodes a level and each level is one pruned partition.
    """
    columns = ["node", "digest"]
    suspect = None
    for level in range(depth + 1):
        a, b = (x.where(F.col("level") == level).select(*columns) for x in (before, after))
        if suspect is not None:
            a, b = (_below(x, suspect, level) for x in (a, b))
        both = a.withColumnRenamed("digest", "_a").join(b.withColumnRenamed("digest", "_b"), "node", "full_outer")
        suspect = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
    return suspect


def _below(nodes: DataFrame, suspect: DataFrame, level: int) -> DataFrame:
    above = suspect.select(F.col("node").alias("_above"))
    return nodes.withColumn("_above", F.substring("node", 1, level - 1) if level > 1 else F.lit("")).join(above, "_above", "left_semi").drop("_above")


def changes(before: DataFrame, after: DataFrame, tree_before: DataFrame, tree_after: DataFrame, depth: int = 4) -> DataFrame:
    """Paths that changed, appeared or vanished; only entries of leaves that differ are compared.

    A digest that became null or was null before is a change.
    """
    differ = changed_leaves(tree_before, tree_after, depth)
    near = [
        x.where("path is not null").withColumn("node", leaf_of(F.col("path"), depth)).join(differ, "node", "left_semi")
        .select("path", F.coalesce("digest", F.lit("")).alias("digest"))
        for x in (before, after)
    ]
    return changed_files(*near)
