"""Line dedup by a log-template tree of fixed depth.

A line goes down a tree of fixed depth: by its number of tokens, then by its
leading tokens, tokens with a digit counting as one variable.  A leaf's
template keeps the tokens that most of its lines share at a position and has
variables elsewhere.  A line belongs to the leaf's template if it agrees with
it at ``similarity`` of its positions, else it is a template of its own, up to
variables with digits.  Templates of at least ``min_docs`` documents recur:
their lines are dropped, but for those of the template's first document.  Lines
of fewer than ``min_tokens`` tokens are left alone.

Rows equal in id and text count as one document and are treated alike.  Lines
end at line feeds; blank lines stay.  Null texts stay null; a text all of whose
lines go becomes empty.  The first document is the one of the least id, null
before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialised, text_key

DEPTH, MIN_DOCS, SIMILARITY = 3, 3, 0.8
#: Rows of 64-bit keys that may be broadcast (about 60 MB with its hash table);
#: more are joined by a shuffle.
MAX_BROADCAST = 2_000_000
VARIABLE = "<*>"


def tokens_of(line: Column) -> Column:
    return F.array_remove(F.split(line, "[ \\t\\r\\f\\x0B]+"), "")


def masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t))


def _sized(df: DataFrame) -> DataFrame:
    """A written table of keys, with a broadcast hint where its count proves it small."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _lines(docs: DataFrame, depth: int, min_tokens: int = 1) -> DataFrame:
    cut = docs.where("text is not null").select(text_key().alias("k"), "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    tokens = cut.withColumn("tokens", tokens_of(F.col("line"))).where(F.size("tokens") >= max(1, min_tokens))
    lead = F.array_join(masked(F.slice("tokens", 1, depth)), " ")
    return tokens.withColumn("leaf", F.xxhash64(F.size("tokens"), lead))


def dropped_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, min_tokens: int = 1) -> DataFrame:
    """``k`` and ``at``, the numbers of the lines of each key that go, from 0."""
    lines = _lines(docs, depth, min_tokens)
    # leaves with too few lines cannot hold a template that recurs
    leaves = materialised(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf", "n"), "leaves")
    shared = lines.join(_sized(leaves.select("leaf")), "leaf", "left_semi")
    shared = materialised(shared.select("k", "doc_id", "at", "leaf", masked(F.col("tokens")).alias("tokens")), "lines")

    by_place = shared.select("leaf", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.count("*").alias("c"))
    usual = by_place.join(leaves, "leaf").where(F.col("c") * 2 > F.col("n"))
    # at most one token a position
    templates = usual.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("template"))
    agreed = F.size(F.filter(F.map_entries("template"), lambda e: F.get(F.col("tokens"), e["key"]) == e["value"]))
    fits = F.coalesce(agreed >= similarity * F.size("tokens"), F.lit(False))
    named = shared.join(templates, "leaf", "left").select(
        "k", "doc_id", "at", F.when(fits, F.xxhash64(F.lit(1), "leaf")).otherwise(F.xxhash64(F.lit(2), F.array_join("tokens", " "))).alias("template")
    )
    per_doc = materialised(named.groupBy("template", "k").agg(F.min("doc_id").alias("doc_id"), F.collect_set("at").alias("at")), "templates")
    recurring = (
        per_doc.groupBy("template")
        .agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "k")).alias("first"))
        .where(F.col("docs") >= min_docs)
        .select("template", F.col("first.k").alias("first"))
    )
    recurring = materialised(recurring, "recurring")
    gone = per_doc.join(_sized(recurring), "template").where(F.col("k") != F.col("first"))
    return gone.groupBy("k").agg(F.flatten(F.collect_list("at")).alias("at"))


def dedup_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, min_tokens: int = 1) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and ``n_lines_dropped`` added."""
    gone = dropped_lines(docs, depth, min_docs, similarity, min_tokens).select(F.col("k").alias("__k"), F.array_sort("at").alias("__at"))
    kept = [c for c in docs.columns if c != "n_lines_dropped"]
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__at", i)), "\n")
    text = F.when(F.col("__at").isNull(), F.col("text")).otherwise(left)
    return docs.join(gone, text_key() == F.col("__k"), "left").select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept],
        F.when(F.col("__at").isNull(), 0).otherwise(F.size("__at")).alias("n_lines_dropped"),
    )


def report(docs: DataFrame) -> DataFrame:
    """The deduplicated text of each document and how many lines it lost."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", F.col("n_lines_dropped").cast("long").alias("n_dropped"), "text")
