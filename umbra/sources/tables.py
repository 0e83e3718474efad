"""Readers and the one text relation that the privacy operators work on."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Closed schemas: what doesn't fit is kept in _corrupt_record, never inferred.
OBSERVATION = T.StructType([
    T.StructField("capture_id", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("elements", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("eid", "role", "name", "type", "autocomplete", "value")]))),
    T.StructField("textBlocks", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("blockRef", "text", "role", "sectionHeading")]))),
    T.StructField("_corrupt_record", T.StringType()),
])
TRUTH = T.StructType([
    T.StructField("schema", T.StringType()), T.StructField("page", T.StringType()), T.StructField("template", T.StringType()), T.StructField("split", T.StringType()), T.StructField("seed", T.IntegerType()),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("elementId", "category", "value", "label", "idiom")]))),
])
PROBE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("run_index", T.IntegerType()), T.StructField("latency_ms", T.DoubleType()),
    *(T.StructField(n, T.BooleanType()) for n in ("json_valid_first", "schema_valid", "grounded", "action_matched", "enforced_ok")), T.StructField("error", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Captures as rows; malformed records stay, in _corrupt_record."""
    return spark.read.schema(OBSERVATION).option("mode", "PERMISSIVE").json(path)


def read_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(page, split, seed, element, category, value, label, idiom): one row for each labelled item of the manifests, one a file or one a line."""
    rows = spark.read.schema(TRUTH).option("multiLine", not lines).json(path)
    return rows.select("page", "split", "seed", F.inline("items")).withColumnRenamed("elementId", "element")


def read_probe_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBE).json(path)


# Fixed patterns: what of a page is no text, tags that begin or end a block, other tags.
UNSEEN = r"(?is)<!--.*?-->|<(?:script|style|template|noscript)(?:\s[^>]*)?>.*?</(?:script|style|template|noscript)\s*>|<title(?:\s[^>]*)?>.*?</title\s*>"
BREAKS = r"(?i)</?(?:p|h[1-6]|li|td|th|label|dt|dd|figcaption|caption|blockquote|div|ul|ol|dl|table|tbody|thead|tr|section|article|header|footer|nav|main|body|html|head|form|br)(?:[\s/][^>]*)?>"
TAG = r"<[^>]*>"
TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def markup_text(markup: Column) -> Column:
    """Text between tags: entities resolved, white space as single spaces."""
    text = F.regexp_replace(markup, TAG, "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, seq, text): the title of each page (seq 0) and its text by blocks (from 1 on), by patterns alone.

    One projection, which stays in the engine; the page operators parse the markup where structure is asked for.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(F.col("html"), UNSEEN, " "), BREAKS, "\x01"), "\x01", -1)
    blocks = F.filter(F.transform(lines, markup_text), lambda t: t != "")
    every = F.concat(F.array(markup_text(F.regexp_extract("html", TITLE, 1))), blocks)
    return pages.where("html is not null").select("page_id", "url", F.posexplode_outer(every).alias("seq", "text")).where("text <> ''")


def host(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1), F.lit(""))


def to_units(documents: DataFrame, conversations: DataFrame, pages: DataFrame) -> DataFrame:
    """(unit_id, origin, target_kind, seq, text): documents, turns of conversations, page addresses, titles and blocks."""
    zero, kind = F.lit(0).cast("long").alias("seq"), lambda k: F.lit(k).alias("target_kind")
    docs = documents.select(F.concat(F.lit("doc:"), "doc_id").alias("unit_id"), F.col("source").alias("origin"), kind("text_span"), zero, "text")
    turns = conversations.select(F.concat(F.lit("conv:"), "conv_id", F.lit(":"), "turn").alias("unit_id"), F.concat(F.lit("conv:"), "conv_id").alias("origin"), kind("text_span"), F.col("turn").alias("seq"), "text")
    urls = pages.select(F.concat(F.lit("url:"), "page_id").alias("unit_id"), host("url").alias("origin"), kind("side_channel"), zero, F.col("url").alias("text"))
    inside = page_texts(pages).select(F.concat(F.lit("page:"), "page_id", F.lit(":"), "seq").alias("unit_id"), host("url").alias("origin"), F.when(F.col("seq") == 0, "title").otherwise("block").alias("target_kind"), F.col("seq").cast("long").alias("seq"), "text")
    return docs.unionByName(turns).unionByName(urls).unionByName(inside)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_units(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"), table(spark, sf_dir, "pages"))


def spread(df: DataFrame, rows_a_task: int) -> DataFrame:
    """df, dealt evenly over all cores, at most about rows_a_task to a task: for rows of a small file that are much work, which Spark would read in a task or two."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task)))


def stored(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there: for small results of long scans that are used again.

    The folder is that of spark.checkpoint.dir. Only in local mode, as in tests, a temporary one is made where it is
    unset; on a cluster that is an error, for a folder of one machine is lost with it.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
