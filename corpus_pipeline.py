"""A training corpus from raw documents, in five stages.

Each stage reads the whole table that its predecessor wrote; the join also reads
the documents as they were given.  All stages but the last return the columns of
``documents``; the last adds ``ids`` and ``n_tokens``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, jaccard, language_id, line_templates, sentencepieces
from tickloom.llm.common import discard, materialised, table

#: Mean posterior below which no language is sure enough of a text.
LEAST_SCORE = 0.4
#: Lines of so many tokens are passages, which recur in two documents already.
PASSAGE_TOKENS, PASSAGE_DOCS = 50, 2
#: Texts with a line that is not blank.
FILLED = "text rlike '[^ \\\\t-\\\\r]'"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or that no language claims, go."""
    named = language_id.predict(docs, language_id.train(docs))
    kept = named.where((F.col("lang_pred") != language_id.UNDEFINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def _measured(out: DataFrame) -> DataFrame:
    changed = F.col("n_lines_dropped") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from texts; every document stays, with its new length.

    A document that lost all its lines has the empty text or blank lines here; the next stage removes it.
    """
    return _measured(line_templates.dedup_lines(docs)).select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, by the texts as given and by those left.

    The language stage lets no text without letters pass, so a text that is
    blank here lost all its lines, which stand in other documents: it goes.
    The line stage cuts near copies to their edited lines, which no longer look
    alike.  So groups are formed by the given texts of the documents first, then
    once more by what is left of texts, which finds copies below other lines.

    Passages that two of the remaining documents share stay in the first only;
    a document of nothing else goes.
    """
    rest = materialised(docs.where(f"{FILLED} or text is null"), "filled")
    given = table(spark, sf_dir, "documents").join(rest.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    whole = materialised(jaccard.without_copies(rest, given), "whole")
    single = materialised(jaccard.keep_one(whole), "single")
    discard(rest, whole)
    out = line_templates.dedup_lines(single, min_docs=PASSAGE_DOCS, min_tokens=PASSAGE_TOKENS)
    return _measured(out).where(f"n_lines_dropped = 0 or {FILLED}").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts get their piece ids."""
    return sentencepieces.encode(docs, sentencepieces.Pieces.load()).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece_encoding", encode),
]

#: The first and the last stage have no SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
