"""Evaluation of detections against truth, and of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def match_truth(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """(unit_id, ann_id, category): annotations that a detection overlaps and contains or is contained in.

    Sides that grow are merged, here and below: Spark's estimates don't know how many rows a list is taken apart into, and would broadcast millions.
    """
    t = truth.select("unit_id", "ann_id", F.col("span_start").alias("ts"), F.col("span_end").alias("te"), F.lower("value").alias("tv"))
    hit = (F.col("span_start") < F.col("te")) & (F.col("ts") < F.col("span_end"))
    value = F.lower("value")
    return detections.join(t.hint("merge"), "unit_id").where(hit & (value.contains(F.col("tv")) | F.contains("tv", value))).select("unit_id", "ann_id", "category")


def dedup_hits(hits: DataFrame) -> DataFrame:
    return hits.select("unit_id", "ann_id", "category").distinct()


def _counts(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """(category, tp, fp, fn) rows, to be summed; a wrong category is a false positive there and a miss here.

    Truth and hits meet by one grouping, of which the partial sums are all that is shuffled; what has a null in its key is like nothing.
    """
    key = ["unit_id", "ann_id", "category"]
    both = truth.select(*key, F.lit(1).alias("__t"), F.lit(0).alias("__h")).unionByName(hits.select(*key, F.lit(0).alias("__t"), F.lit(1).alias("__h")))
    sums = both.groupBy(*key).agg(F.sum("__t").alias("__t"), F.max("__h").alias("__h"))
    right = (F.col("__t") > 0) & (F.col("__h") > 0) & F.col("unit_id").isNotNull() & F.col("ann_id").isNotNull() & F.col("category").isNotNull()
    counted = sums.select("category", right.cast("long").alias("tp"), ((F.col("__h") > 0) & ~right).cast("long").alias("fp"), F.when(~right & (F.col("category") != "NONE"), F.col("__t")).otherwise(0).alias("fn"))
    return counted.where("tp + fp + fn > 0").groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def precision_recall(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """(category, tp, fp, fn, precision, recall) by category and over all (null category); undefined ratios are null."""
    sums = _counts(truth, hits).rollup("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 3))
    return sums.select("category", "tp", "fp", "fn", ratio(F.col("tp"), F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("fn")).alias("recall"))


def scored_categories(truth: DataFrame, hits: DataFrame) -> DataFrame:
    return truth.select("category").union(hits.select("category")).where("category <> 'NONE'").distinct()


def error_rows(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """(unit_id, ann_id, expected, detected): annotations whose detected categories aren't just the expected one."""
    found = dedup_hits(hits).groupBy("unit_id", "ann_id").agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("detected"))
    joined = truth.join(found.hint("merge"), ["unit_id", "ann_id"], "left").select("unit_id", "ann_id", F.col("category").alias("expected"), F.coalesce("detected", F.lit("")).alias("detected"))
    return joined.where("expected <> detected")


def delta_pp(a: DataFrame, b: DataFrame) -> DataFrame:
    """(category, precision_pp, recall_pp): b's figures less a's in percentage points; null where a side lacks them."""
    side = lambda df, n: df.where("category is not null").select("category", F.col("precision").alias(f"p{n}"), F.col("recall").alias(f"r{n}"))
    less = lambda m: F.round((F.col(f"{m}b") - F.col(f"{m}a")) * 100, 1)
    return side(a, "a").join(side(b, "b"), "category", "full").select("category", less("p").alias("precision_pp"), less("r").alias("recall_pp"))


MODES = (("checksum", ("AADHAAR", "CARD_NUMBER")), ("shape", ("PAN", "EMAIL", "PHONE", "IFSC", "UPI_ID", "VEHICLE_REG")))


def _ratios(sums: DataFrame, *keys: str) -> DataFrame:
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round(F.col(a) / (F.col(a) + F.col(b)), 3))
    return sums.select(*keys, "tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def metrics_by_mode(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """(mode, category, tp, fp, fn, precision, recall) by how a category is recognised, by category within that, and over all (nulls)."""
    mode = F.lit("label")
    for name, categories in MODES:
        mode = F.when(F.col("category").isin(*categories), name).otherwise(mode)
    return _ratios(_counts(truth, hits).withColumn("mode", mode).rollup("mode", "category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), "mode", "category")


def exclude_refused(truth: DataFrame, refused: DataFrame) -> DataFrame:
    """truth without the annotations of refused units."""
    return truth.join(refused.select("unit_id").distinct(), "unit_id", "left_anti")


def coverage(truth: DataFrame, refused: DataFrame) -> DataFrame:
    """(n_units, n_refused, coverage): of the units with annotations, how many were refused, and the share that wasn't."""
    marked = truth.select("unit_id").distinct().join(refused.select("unit_id", F.lit(1).alias("r")).distinct(), "unit_id", "left")
    counts = marked.agg(F.count(F.lit(1)).alias("n_units"), F.count("r").alias("n_refused"))
    return counts.select("n_units", "n_refused", F.round(1 - F.col("n_refused") / F.col("n_units"), 3).alias("coverage"))


def replay_diff(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(unit_id, category, was, now): where the number of detections of a category at a unit has changed."""
    n = lambda df, was, now: df.select("unit_id", "category", F.lit(was).alias("was"), F.lit(now).alias("now"))
    return n(recorded, 1, 0).unionByName(n(current, 0, 1)).groupBy("unit_id", "category").agg(F.sum("was").alias("was"), F.sum("now").alias("now")).where("was <> now")


def false_success_rate(runs: DataFrame) -> DataFrame:
    """(reason, impossible, done, flagged, mutated, controls, controls_done) by reason and over all (null).

    runs: reason, impossible, verdict, mutated. How runs that can't succeed ended, how many changed something, and beside them
    how many of the runs that can succeed did.
    """
    n = lambda name, *on: F.count_if(F.expr(" and ".join(on))).alias(name)
    return runs.rollup("reason").agg(
        n("impossible", "impossible"), n("done", "impossible", "verdict = 'done'"), n("flagged", "impossible", "verdict = 'flagged'"), n("mutated", "impossible", "mutated"),
        n("controls", "not impossible"), n("controls_done", "not impossible", "verdict = 'done'"),
    )


def stratified_sample(tasks: DataFrame, n: int, salt: str) -> DataFrame:
    """The first n tasks of each stratum by the SHA-256 of salt and id."""
    order = Window.partitionBy("stratum").orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    return tasks.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n).select("stratum", "id", "pick")


def latency_summary(log: DataFrame, least: int = 12) -> DataFrame:
    """(name, n, low, mid, p90, p95, high, reportable): nearest-rank percentiles and the true median.

    Reportable from `least` answers on, if no run is missing: their numbers are 0, 1, ... without a gap.
    """
    return log.groupBy("name").agg(
        F.count("latency_ms").alias("n"), F.min("latency_ms").alias("low"), F.median("latency_ms").alias("mid"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY latency_ms)").alias("p90"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95"),
        F.max("latency_ms").alias("high"), ((F.count("latency_ms") >= least) & (F.count_distinct("run_index") == F.max("run_index") + 1)).alias("reportable"),
    )


def scorecard(log: DataFrame) -> DataFrame:
    """(name, metric, hits, asked): exact fractions over runs that answered."""
    metrics = ("schema_valid", "grounded", "enforced_ok")
    stacked = log.select("name", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("ok")) for m in metrics])).alias("m")).select("name", "m.*")
    return stacked.groupBy("name", "metric").agg(F.count_if("ok").alias("hits"), F.count("ok").alias("asked"))


def payload_sizes(payloads: DataFrame) -> DataFrame:
    """(mode, n, low, mid, p95, high): bytes of payloads by mode."""
    size = F.octet_length("text").cast("long")
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY octet_length(text))")
    return payloads.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.median(size).alias("mid"), p95.cast("long").alias("p95"), F.max(size).alias("high"))


def probe_log(events: DataFrame) -> DataFrame:
    """events as a log of calls: the type is the fixture, the value its latency, the key's remainders its verdicts."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("event_type").alias("name"), F.col("value").alias("latency_ms"), k.alias("run_index"), (k % 2 == 0).alias("schema_valid"), F.when(k % 5 != 0, k % 3 == 0).alias("grounded"), F.when(k % 7 != 0, k % 2 == 1).alias("enforced_ok"))


def changed_decisions(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, before, after): spans that two policies decide differently."""
    return a.select(*key, F.col("action").alias("before")).join(b.select(*key, F.col("action").alias("after")), key).where("before <> after")


def faceted_metrics(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """(label, construct, tp, fp, fn, precision, recall) for each facet and over each (null); truth also has label and construct."""
    found = hits.groupBy("unit_id", "ann_id").agg(F.collect_set("category").alias("__found"))
    none = F.array().cast("array<string>")
    seen = truth.join(found.hint("merge"), ["unit_id", "ann_id"], "left").withColumn("__found", F.coalesce("__found", none))
    right = F.coalesce(F.array_contains("__found", F.col("category")), F.lit(False)).cast("int")
    wrong = F.when(F.col("category").isNull(), 0).otherwise(F.size("__found") - right)
    counted = seen.select("label", "construct", right.alias("tp"), wrong.alias("fp"), (1 - right).alias("fn"))
    return _ratios(counted.cube("label", "construct").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), "label", "construct")


def layer_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """The spans that b has and a lacks (change: added) and the other way round (lost), each as often as it is more."""
    return signed_changes(a.withColumn("side", F.lit(-1)).unionByName(b.withColumn("side", F.lit(1))))


def signed_changes(both: DataFrame) -> DataFrame:
    """What layer_changes says, of spans of both in one: column side is -1 for those of a, 1 for those of b."""
    columns = [c for c in both.columns if c != "side"]
    more = both.groupBy(*columns).agg(F.sum("side").cast("int").alias("__n")).where("__n <> 0")
    change = F.when(F.col("__n") > 0, "added").otherwise("lost")
    return more.select(*columns, change.alias("change"), F.explode(F.array_repeat(F.lit(1), F.abs("__n")))).drop("col")
