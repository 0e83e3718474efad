"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from umbra.llm.common import cut

#: Up to so many sources (some 100 bytes each and a row of probabilities) their rates are broadcast.
BROADCAST_SOURCES = 20_000
#: Beyond, rates are joined by shuffle. Sources with more than a thousandth of the rows (a thousand at most) are dealt over so many tasks then.
SALTS = 64


def unit(*parts: F.Column) -> F.Column:
    """A number in [0, 1) from the md5 of the parts: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, alpha: float = 0.5) -> DataFrame:
    """(source, n, rate, cdf): the documents of each source, the mean repetition rate of each source, and P(copies <= k) for k = 0, 1, ...

    weights (source, weight) are the target shares up to a factor; without them a source of n documents
    weighs n ** alpha. total is the expected number of rows out, by default the number of documents in.
    A source without a weight has rate 0.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double"))
        weighed = sizes.join(w, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").fillna(0.0, "weight")
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("n").alias("all")).first()
    rows = (sums["all"] or 0) if total is None else total
    share = F.when(F.lit(sums["w"] or 0.0) > 0, F.col("weight") / F.lit(sums["w"] or 1.0)).otherwise(0.0)
    rates = weighed.select("source", "n", (share * rows / F.col("n")).alias("rate"))
    # Beyond 12 standard deviations no double in [0, 1) lies above the sum.
    steps = rates.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 25).cast("int"))))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = steps.withColumn("lf", F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(upto))
    mass = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("lf"))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    sums_of = logs.withColumn("c", F.sum(mass).over(upto))
    return sums_of.groupBy("source").agg(F.first("n").alias("n"), F.first("rate").alias("rate"), F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x.c).alias("cdf"))


def _with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """docs with the cdf of their source, as __cdf; rates: source, n, cdf."""
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = rates.select(F.col("source").alias("__source"), "n", F.col("cdf").alias("__cdf"))
    if few:
        return docs.join(F.broadcast(named.drop("n")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    hot = named.where(F.col("n") * 1000 > F.lit(rates.agg(F.sum("n")).first()[0])).select(F.col("__source").alias("__hot"))
    marked = docs.join(F.broadcast(hot.withColumn("__is_hot", F.lit(True))), F.col("source").eqNullSafe(F.col("__hot")), "left").drop("__hot")
    salted = marked.withColumn("__salt", F.when(F.col("__is_hot"), F.pmod(F.hash("doc_id"), F.lit(SALTS))).otherwise(0)).drop("__is_hot")
    every = named.join(F.broadcast(hot.withColumn("__is_hot", F.lit(True))), F.col("__source").eqNullSafe(F.col("__hot")), "left")
    dealt = every.withColumn("__part", F.explode(F.when(F.col("__is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("__hot", "__is_hot", "n")
    return salted.join(dealt, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__part"))).drop("__source", "__salt", "__part")


def mix(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, alpha: float = 0.5, seed: int = 17) -> DataFrame:
    """Each document as often as a Poisson draw at its source's rate says, in one global random order.

    The draw inverts the distribution at a hash of seed and doc_id, so it is the same on every run, and
    rows that repeat a doc_id have equal draws. Adds copy (0, 1, ...) and order_key; rows come sorted by
    order_key within partitions dealt by its hash, which is a random order of all rows. A null source is
    a source; a null doc_id draws as an empty one; an empty table gives none. Texts of any length pass through
    as they are, as do other columns, but for ones named copy or order_key, which are replaced.
    """
    rates = cut(poisson_rates(docs, weights, total, alpha))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = (
        _with_rates(docs.drop("copy", "order_key"), rates).withColumn("__u", unit(F.lit(str(seed)), doc))
        .withColumn("__copies", F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))).drop("__cdf", "__u")
    )
    copies = drawn.where("__copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), doc, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return copies.withColumn("order_key", key).repartition("order_key").sortWithinPartitions("order_key")
