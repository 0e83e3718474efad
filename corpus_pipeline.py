"""A training corpus from `documents` in five stages; each works on all rows that its predecessor kept.

All stages take any table with doc_id, text, source and n_chars, return its columns in their order (the last one adds
two), read texts of any length whole, and return an empty table for an empty one. Columns of other names pass through, also
such as operators use for results of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from umbra.llm import decontamination, jaccard_join, line_dedup, mixing, quality_rules
from umbra.llm.common import WORD, cut, table
from umbra.llm.queries import OP1_CTES, OP3_CTES, OP4_CTES, OP6_CTES, OP9_CTES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and documents that fail them or lose too much text.

    Null and empty texts fail. Rows are judged one by one, so repeated rows share their fate; a null id changes nothing.
    """
    return quality_rules.clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the document with the smallest id; a document left without a word by that goes.

    Documents that lose nothing stay as they are, null and empty ones too. Rows that repeat an id are one document and keep
    what it keeps; rows with a null id hold no line against others and stay.
    """
    kept = line_dedup.dedup_lines(docs, line_dedup.line_index(docs))
    kept = kept.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id.

    Null texts and texts without words are like nothing and stay, as do rows with a null id. Rows that repeat an id are one
    document and stay or go together.
    """
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain nothing; rows with a null id stay, and rows that repeat an id go together. An empty
    benchmark takes nothing away.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are weighted by the square root of their sizes; rows come in a global random order.

    Adds copy and order_key. A null source is a source; rows that repeat an id are drawn alike, with null ids as one.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = rf"""WITH RECURSIVE {OP3_CTES.replace("{docs}", "documents")},
p1 AS (SELECT d.doc_id, clean_text AS text, lang, source, length(clean_text) AS n_chars FROM op3_out JOIN documents d USING (doc_id) WHERE kept),{OP1_CTES.replace("{docs}", "p1")},
p2 AS (
  SELECT p.doc_id, kept_text AS text, lang, source, length(kept_text) AS n_chars FROM op1_out JOIN p1 p USING (doc_id)
  WHERE n_dropped = 0 OR regexp_matches(kept_text, '[^\x20\x09-\x0D]')),{OP9_CTES.replace("{docs}", "p2")},
p3 AS (SELECT p.* FROM p2 p JOIN op9_out USING (doc_id) WHERE component_id = p.doc_id),{OP4_CTES.replace("{docs}", "p3")},
p4 AS (SELECT * FROM p3 WHERE doc_id NOT IN (SELECT doc_id FROM op4_out)),{OP6_CTES.replace("{docs}", "p4")}
SELECT doc_id, text, lang, source, n_chars, copy, order_key FROM op6_out"""
