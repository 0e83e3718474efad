"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and read on from there.

    The folder is the one named in spark.checkpoint.dir. Only in local mode (tests) a temporary one is made
    where that is unset; on a cluster its absence is an error, for a folder of one machine is lost with it. Spark
    removes the files of frames that are no longer used if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """How many bytes the texts have, counted."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts_for(size: int, most: int, least: int) -> int:
    """Into how many groups `size` is dealt so that one has about `most` on average; at least `least`."""
    return max(least, -(-size // most), 1)


def met(many: DataFrame, few: DataFrame, key: str, spread: str, most: int, salts: int = 16) -> DataFrame:
    """many joined with few on key: by broadcast if few has up to `most` rows, counted, else by key and a salt.

    The salt deals a key that very many rows have over several tasks by the hash of the column `spread`.
    """
    if few.limit(most + 1).count() <= most:
        return many.join(F.broadcast(few), key)
    salted = many.withColumn("__salt", F.pmod(F.hash(spread), F.lit(salts)))
    return salted.join(few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "__salt"]).drop("__salt")
