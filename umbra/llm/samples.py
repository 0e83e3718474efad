"""Labelled rows for fitting classifiers: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from umbra.llm.common import met

#: Up to so many labels (some 20 bytes each) go to the texts; beyond, texts and labels meet by a shuffle.
MOST_BROADCAST = 2_000_000


def labels_of(labels: DataFrame, column: str, usable: Column) -> DataFrame:
    """(doc_id, y): a doc_id with several labels counts once, with the highest."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & usable).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, column: str, usable: Column) -> DataFrame:
    """(doc_id, text, y): every labelled document of which usable, over doc_id, says that it may be learnt from."""
    return met(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), labels_of(labels, column, usable), "doc_id", "doc_id", MOST_BROADCAST, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, usable: Column, rows_a_class: int) -> DataFrame:
    """(doc_id, text, y, weight): about rows_a_class labelled documents of each class.

    usable, over doc_id, says which rows may be learnt from. Rows are chosen by the hash of their id against
    a threshold from the exact class counts; weight is how many labelled rows a chosen one stands for. The
    ids are broadcast: there are about 2 * rows_a_class of them, at 20 bytes each. A doc_id with several
    labels counts once, with the highest.
    """
    known = labels_of(labels, column, usable)
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, rows_a_class / sizes.get(1, 1))).otherwise(min(1.0, rows_a_class / sizes.get(0, 1)))
    chosen = known.withColumn("weight", 1 / share).where(F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 30)) < share * (1 << 30))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
