"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets of bounded size by a seeded
hash of their identity.  Pass two gathers a bucket, which by construction fits
in memory, shuffles it with Spark's Fisher-Yates ``shuffle`` and lays the
buckets one after another.  The resulting global position deals records to
shards in turn, so that shard sizes differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import shared_path

#: Bytes of records a bucket should hold: a small part of an executor's memory.
BUCKET_BYTES = 32 * 1024 * 1024


def external_shuffle(
    records: DataFrame,
    identity: list[str],
    size: Column,
    seed: int = 42,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``records`` with ``bucket`` and ``position``, a gapless random order from 0.

    ``size`` is the bytes of a record and never null.  ``identity`` names the columns that the seeded
    hash reads: nulls are allowed, and records that agree in all of them share
    a bucket, so give columns that tell copies of a text apart.  Columns must be
    orderable.  ``bucket`` and ``position`` are added; input columns of these
    names are replaced.  An empty table gives an empty table.
    """
    total = records.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    kept = [c for c in records.columns if c not in ("bucket", "position")]
    keyed = records.select(
        F.struct(F.xxhash64(F.lit(seed), *identity).alias("h"), *kept).alias("record"),
    ).withColumn("bucket", F.pmod(F.col("record.h"), F.lit(buckets)).cast("int"))

    # the order before the draw is fixed, so that the seed alone decides; one
    # bucket is one row of one task: rows go to the task of their bucket's number
    gathered = (
        keyed.repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list("record")).alias("records"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    )
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    # one row per bucket, not per record
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (
        gathered.join(F.broadcast(starts), "bucket")
        .select("bucket", "start", F.posexplode("records").alias("at", "record"))
        .select(*[F.col(f"record.`{c}`").alias(c) for c in kept], "bucket", (F.col("start") + F.col("at")).alias("position"))
    )


def dealt(shuffled: DataFrame, shards: int) -> DataFrame:
    """``shard`` and gapless ``slot`` of each position; counts differ by one at most."""
    return shuffled.withColumns(
        {
            "shard": F.pmod("position", F.lit(shards)).cast("int"),
            "slot": F.floor(F.col("position") / shards).cast("long"),
        }
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write whole ``docs`` in shuffled order, a folder per shard.

    The files of a shard carry ``slot``; readers that need the exact order sort
    one shard by it.  Needs ``doc_id`` and ``text``; null texts weigh one byte.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    dealt(external_shuffle(docs, ["doc_id", "text"], size, seed, bucket_bytes), shards).write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus 1; null has none), ``text_crc32`` and columns named in ``others``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *others,
    )


def shard_table(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Where each row of ``docs`` went: the ``rows`` law of equal counts.

    Whole documents are shuffled and written below the shared folder; the
    result is read from the written shards.
    """
    path = shared_path(docs.sparkSession, "shards")
    records = docs.select("doc_id", "text")
    write_shards(records, path, shards, seed, bucket_bytes)
    kinds = ", ".join(f"{name} {kind}" for name, kind in records.dtypes)
    written = docs.sparkSession.read.schema(f"{kinds}, slot bigint, shard int").parquet(path)
    return digests(written, "shard", "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
