"""Token counts of flat token files: a separator scan with stitched blocks.

A token file is nothing but unsigned little-endian ids, documents closed by an
end-of-document id; it has no index.  Files are cut into blocks; each block is
searched for the separator in one vector comparison and summarised by the
lengths of the documents inside it and of the open ends.  A prefix scan over a
file's blocks then numbers the documents and adds up the ends that meet, so a
document may span any number of blocks.

A separator right after another closes an empty document.  Tokens after the last
separator are a document too.  A file whose bytes are no whole number of ids is
an error.  Files are read by Spark's binary source, which takes up to 2 GB each;
larger ones fail, none is cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tickloom.llm.common import shared_path

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: An id that no text is encoded to.
SEPARATOR = 50256
BLOCK_BYTES = 1 << 20


@dataclass
class Tokenizer:
    """Ranks and pattern, read by the driver; each task builds its own coder."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def load(cls, path: str = RANKS, pattern: str | None = None) -> Tokenizer:
        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)

    def coder(self):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, tokenizer: Tokenizer, separator: int = SEPARATOR, width: int = 2) -> None:
    """The texts of ``docs`` as flat files of ``width``-byte ids, each text closed by the separator; null is empty."""

    @arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder, kind = tokenizer.coder(), np.dtype(f"<u{width}")
        for batch in batches:
            yield pa.array([np.asarray(coder.encode_ordinary(t.as_py() or ""), kind).tobytes() for t in batch], pa.binary())

    # Spark's line writer puts the separator's bytes after each value
    end = separator.to_bytes(width, "little").decode("latin-1")
    docs.select(ids("text").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1").text(path)


def scan_blocks(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per block of each file: ``file, block, tokens, ends, head, tail`` and ``inner``.

    ``ends`` counts separators; ``head`` and ``tail`` are the tokens before the
    first and after the last (a block without one is all head and all tail);
    ``inner`` has the lengths of the documents that lie wholly between.
    """
    if block_bytes % width:
        raise ValueError("a block holds a whole number of ids")
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    cut = F.expr(f"transform(sequence(0, int((length - 1) div {block_bytes})), i -> struct(i AS block, substring(content, i * {block_bytes} + 1, {block_bytes}) AS bytes))")
    blocks = files.select(F.col("path").alias("file"), F.explode(cut).alias("b")).select("file", "b.block", "b.bytes")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            rows = []
            for raw in batch.column(2):
                found = np.frombuffer(raw.as_buffer(), np.uint8)
                if len(found) % width:
                    raise ValueError("a token file ends inside an id")
                found = found.view(kind)
                ends = np.flatnonzero(found == separator)
                head = int(ends[0]) if len(ends) else len(found)
                tail = len(found) - 1 - int(ends[-1]) if len(ends) else len(found)
                rows.append((len(found), len(ends), head, tail, (np.diff(ends) - 1).tolist()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["file", "block", "tokens", "ends", "head", "tail", "inner"])

    return blocks.mapInArrow(search, "file string, block int, tokens long, ends long, head long, tail long, inner array<long>")


def document_lengths(blocks: DataFrame) -> DataFrame:
    """``file, position, n_tokens`` of every document, positions from 0 in each file.

    Windows are per file, and a file has few thousand blocks at most.
    """
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # what is open after a block: its tail if it has a separator, else all since the last block that had
    closed = blocks.withColumn("run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(upto))
    run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    scanned = (
        closed.withColumn("open", F.sum("tail").over(run))
        .withColumn("before", F.coalesce(F.lag("open").over(order), F.lit(0)))
        .withColumn("first", F.sum("ends").over(upto) - F.col("ends"))
        .withColumn("last", F.lead("block").over(order).isNull())
    )
    closing = F.when(F.col("ends") > 0, F.concat(F.array(F.col("before") + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("last") & (F.col("open") > 0), F.array("open")).otherwise(F.array().cast("array<bigint>"))
    listed = scanned.select("file", "first", F.posexplode(F.concat(closing, rest)).alias("at", "n_tokens"))
    return listed.select("file", (F.col("first") + F.col("at")).alias("position"), "n_tokens")


def token_counts(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, position, n_tokens`` of every document in the token files below ``path``."""
    return document_lengths(scan_blocks(spark, path, separator, width, block_bytes))


def report(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Token files of all texts, written to the shared folder, and the lengths found in them.

    ``part`` is the number of the writing task.  Within a part, documents stand in the order of its rows.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    return token_counts(spark, path).select(part.alias("part"), "position", "n_tokens")
