"""Registered queries that run as streams: a table is written in several parts, and each part becomes a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as Y

from umbra.functions import rules as R
from umbra.operators import detect as D
from umbra.plans.more import _folder
from umbra.plans.queries import BURST, CONTEXT_UNITS, DET, HIDDEN, KNOWN, POLICY, REDACTED, RESCAN, FAULTY, SETTLED, TOKEN_SQL, VAULT, context_units, detections, key_of, query, scan_sql, stored, table, units
from umbra.streaming import streams as T, vault as V

FAR = "2100-01-01 00:00:00"


def fed(rows: DataFrame, number: Column, n: int, folder: str, writer: Callable[[DataFrame], object]) -> None:
    """Run a stream over rows: those with number 0 come in the first micro-batch, and so on; writer(stream) says what becomes of them."""
    spark = rows.sparkSession
    rows.withColumn("__number", number.cast("int")).write.partitionBy("__number").parquet(f"{folder}/dealt")
    dealt = spark.read.schema(Y.StructType([*rows.schema, Y.StructField("__number", Y.IntegerType())])).parquet(f"{folder}/dealt")
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(f"{folder}/in")
    for i in range(n):
        dealt.where(F.col("__number") == i).drop("__number").write.mode("append").parquet(f"{folder}/in")
        query = writer(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).trigger(availableNow=True).start()
        query.awaitTermination()


def replayed(rows: DataFrame, number: Column, n: int, op: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What op appends as a stream over rows in n micro-batches."""
    folder = _folder(rows.sparkSession, name)
    schema = []

    def writer(stream: DataFrame):
        out = op(stream)
        schema[:] = [out.schema]
        return out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")

    fed(rows, number, n, folder, writer)
    return rows.sparkSession.read.schema(schema[0]).parquet(f"{folder}/out")


def with_end(events: DataFrame, **others: Column) -> DataFrame:
    """Events and one far in the future, of no user, which moves the watermark past all others."""
    end = {c: F.lit(None).cast(t) for c, t in events.dtypes} | {"ts": F.lit(FAR).cast("timestamp"), "event_id": F.lit(-1).cast("long"), "user_id": F.lit(-1).cast("long")} | others
    return events.unionByName(events.sparkSession.range(1).select(*[v.cast(dict(events.dtypes)[c]).alias(c) for c, v in end.items()]))


# ---- bursts and sessions: every fourth event comes a batch late, within the lateness

BATCHES = 4


def disordered(events: DataFrame) -> tuple[DataFrame, Column, str]:
    """(events, the number of each one's batch, a lateness that covers them): parts of equal length in time, and every fourth event a part later."""
    low, high = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    part = (high - low) // BATCHES + 1
    at = F.floor((F.unix_seconds("ts") - low) / part)
    number = F.when(F.col("user_id") < 0, BATCHES - 1).otherwise(F.least(F.lit(BATCHES - 1), at + (F.col("event_id") % 4 == 1).cast("int")))
    return events, number, f"{2 * part} seconds"


def events_of(spark, sf) -> DataFrame:
    return T.timed(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value"))


@query(SETTLED)
def t1_settle_stream(spark, sf):
    """The bursts of t1_settle_bounded, from a stream whose events are out of order across batches; timers end them."""
    events, number, late = disordered(events_of(spark, sf))
    return replayed(with_end(events), number, BATCHES, lambda s: T.settle_bounded(s, late=late), "settle").where("user_id >= 0")


def planned(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    steps = F.transform(F.sequence(F.lit(1), k % 11 + 1), lambda i: F.repeat(F.concat("event_type", i.cast("string")), 50))
    return events.withColumns({"plan": F.when(k % 5 > 1, steps), "token": F.when(k % 4 == 1, F.concat(F.lit("s"), k))})


@query(f"""WITH b AS ({BURST.format(op='<=', s=7200)}), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session,
    CASE WHEN event_id % 5 > 1 THEN array_to_string(list_transform(range(1, least(event_id % 11 + 1, 8) + 1), lambda i: substr(repeat(event_type || i, 50), 1, 120)), '|') END AS plan, CASE WHEN event_id % 4 = 1 THEN 's' || event_id END AS token FROM b)
  SELECT user_id, epoch_us(min(ts)) AS start, coalesce(arg_min(plan, (ts, event_id)) FILTER (plan IS NOT NULL), '') AS plan, arg_max(token, (ts, event_id)) FILTER (token IS NOT NULL) AS token, count(*) AS n FROM g GROUP BY user_id, session""")
def t5_session_plans(spark, sf):
    """What sessions kept when they were evicted, from a stream of events out of order."""
    events, number, late = disordered(events_of(spark, sf))
    out = replayed(with_end(planned(events)), number, BATCHES, lambda s: T.session_plans(s, late=late), "plans")
    return out.where("user_id >= 0").withColumn("plan", F.array_join("plan", "|"))


# ---- what origins have shown

SHOWN = f"""{CONTEXT_UNITS}, {POLICY}, every AS (SELECT regexp_extract(unit_id, '[0-9]+', 0)::BIGINT AS seq, category, confidence FROM ({scan_sql('ctx', R.CONTEXT_RULES)})), spans AS (SELECT 'o' || seq % 301 AS origin, * FROM every),
firsts AS (SELECT origin, category, min(seq) AS seq FROM spans JOIN policy USING (category) WHERE class = 'quasi' GROUP BY ALL)"""


@query(f"""WITH {SHOWN} SELECT origin, 'linkable' AS what, seq FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq, category) AS n FROM firsts) WHERE n = 3
  UNION ALL SELECT origin, 'identity', min(seq) FROM spans JOIN policy USING (category) WHERE is_identity AND confidence >= 0.6 GROUP BY origin""")
def t6_origin_stream(spark, sf):
    """From which capture on an origin is named and linkable, from a stream of labelled spans of which every fourth comes a batch late."""
    spans = D.scan(context_units(spark, sf), R.CONTEXT_RULES).withColumn("seq", F.regexp_extract("unit_id", "[0-9]+", 0).cast("long"))
    spans = stored(spans.select(F.concat(F.lit("o"), F.col("seq") % 301).alias("origin"), "seq", "category", "confidence"))
    most = spans.agg(F.max("seq")).first()[0] or 0
    rows = spans.withColumn("ts", F.timestamp_seconds(1_600_000_000 + F.col("seq")))
    end = spark.range(1).select(F.lit("").alias("origin"), F.lit(most + 1).cast("long").alias("seq"), F.lit("CITY").alias("category"), F.lit(0.0).alias("confidence"), F.lit(FAR).cast("timestamp").alias("ts"))
    part = most // BATCHES + 1
    number = F.when(F.col("origin") == "", BATCHES - 1).otherwise(F.least(F.lit(BATCHES - 1), F.floor(F.col("seq") / part) + (F.col("seq") % 4 == 1).cast("int")))
    policy = R.load_policy(spark)
    return replayed(rows.unionByName(end), number, BATCHES, lambda s: T.origin_state(s, policy, late=f"{2 * part} seconds"), "origins")


# ---- tokens and texts


@query(f"WITH {DET}, {VAULT} SELECT category, normalized, token, unnest(origins) AS origin FROM vault")
def t7_tokenize_stream(spark, sf):
    """The vault of p6_tokenize, one row for each origin of a value, from a stream of detections."""
    rows = detections(spark, sf).where("confidence >= 0.6").select("unit_id", "category", "value", "origin")
    return replayed(rows, F.pmod(F.hash("unit_id"), F.lit(3)), 3, lambda s: V.tokenize_stream(s.drop("unit_id"), key_of(spark)), "tokens")


NUMBER = "CASE WHEN seq < 100 THEN 0 WHEN seq < 400 THEN 1 WHEN seq < 1000 THEN 2 ELSE 3 END"
PLANTED = " as said in [[PII:EMAIL:aaaaaaaa]]"
OFTEN = f"""{RESCAN.replace(FAULTY, REDACTED)}, {HIDDEN}, numbered AS (SELECT unit_id, {NUMBER} AS number FROM (SELECT unit_id, regexp_extract(unit_id, '[0-9]+', 0)::BIGINT AS seq FROM units)),
entered AS (SELECT v.category, v.normalized, min(number) AS number FROM vault v JOIN (SELECT d.*, {{normal}} AS normalized FROM decided d WHERE action IN ('TOKEN', 'TOKEN_WITH_APPROVAL')) d ON d.category = v.category AND d.normalized = v.normalized JOIN numbered USING (unit_id) GROUP BY ALL)"""


def _t8_sql() -> str:
    """Units by batches as the stream has them; all batches up to a unit's own count for its audit."""
    from umbra.plans.queries import normal_sql

    base = OFTEN.replace("{normal}", normal_sql("d.category", "d.value"))
    base = base.replace("\nunits AS (", "\nplain_units AS (", 1)
    # every seventh document, page or conversation carries a token that was never issued
    base = base.replace(", det AS (", f", units AS (SELECT * REPLACE (CASE WHEN regexp_extract(unit_id, '[0-9]+', 0)::BIGINT % 7 = 3 THEN text || {PLANTED!r} ELSE text END AS text) FROM plain_units), det AS (", 1)
    known = KNOWN.replace("SELECT DISTINCT b.unit_id, f.category, f.normalized FROM bared b JOIN forms f ON", "SELECT DISTINCT b.unit_id, f.category, f.normalized FROM bared b JOIN numbered n ON n.unit_id = b.unit_id JOIN (SELECT f.*, x.number FROM forms f JOIN shown x USING (category, normalized)) f ON f.number <= n.number AND (") + ")"
    known = known[:-2] + "))"
    shown = f"shown AS (SELECT category, normalized, min(number) AS number FROM (SELECT category, normalized, number FROM entered UNION ALL SELECT h.category, {normal_sql('h.category', 'h.value')}, number FROM hidden h JOIN numbered USING (unit_id) WHERE h.value IS NOT NULL) GROUP BY ALL)"
    return f"""WITH {base}, {shown}, {known}, failed AS (SELECT unit_id, 2 AS k, 'rule-scan' AS verdict FROM leaks UNION ALL SELECT unit_id, 3, 'known-value' FROM known_leaks
    UNION ALL SELECT o.unit_id, 4, 'unknown-token' FROM (SELECT unit_id, unnest(regexp_extract_all(text, '{TOKEN_SQL}')) AS token FROM outgoing) o JOIN numbered n USING (unit_id) WHERE token NOT IN (SELECT token FROM vault JOIN entered e USING (category, normalized) WHERE e.number <= n.number))
  SELECT u.unit_id, n.number AS batch, coalesce(v, 'SEALED') AS verdict, sha256(coalesce(o.text, '')) AS text_sha256 FROM units u JOIN numbered n USING (unit_id) JOIN outgoing o USING (unit_id) LEFT JOIN (SELECT unit_id, arg_min(verdict, k) AS v FROM failed GROUP BY unit_id) USING (unit_id)"""


@query(_t8_sql())
def t8_redact_stream(spark, sf):
    """All units redacted and audited in four micro-batches; tokens and known values of earlier batches count in later ones."""
    rows = units(spark, sf).withColumn("seq", F.regexp_extract("unit_id", "[0-9]+", 0).cast("long"))
    rows = rows.withColumn("text", F.when(F.col("seq") % 7 == 3, F.concat("text", F.lit(PLANTED))).otherwise(F.col("text"))).select("unit_id", "origin", "seq", "text")
    folder, policy, key = _folder(spark, "redacted"), R.load_policy(spark), key_of(spark)
    fed(rows, F.expr(NUMBER), 4, folder, lambda s: V.redact_stream(s, policy, key, folder))
    out = V.kept(spark, folder, "sealed").unionByName(V.kept(spark, folder, "quarantine"))
    return out.select("unit_id", "batch", "verdict", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))


@query("""WITH e AS (SELECT *, least(4, event_id * 5 // (SELECT count(*) FROM events) + CASE WHEN event_id % 10 = 3 THEN 2 ELSE 0 END) AS b FROM events),
  clocks AS (SELECT b, max(max(epoch_us(ts))) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000 AS w FROM e GROUP BY b),
  marked AS (SELECT e.*, date_trunc('day', ts) AS start, coalesce(epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) <= w, FALSE) AS late FROM e JOIN clocks USING (b))
  SELECT start, event_type, count(*) FILTER (NOT late) AS n, round(coalesce(sum(value) FILTER (NOT late), 0), 6) AS total, count(*) FILTER (late) AS n_late FROM marked GROUP BY start, event_type""")
def t9_late_rows(spark, sf):
    """Category counts of a stream of which every tenth event comes two batches late, with the rows that were too late."""
    events, folder = events_of(spark, sf), _folder(spark, "counts")
    n = events.count()
    number = F.least(F.lit(4), F.floor(F.col("event_id") * 5 / max(n, 1)) + F.when(F.col("event_id") % 10 == 3, 2).otherwise(0))
    fed(events, number, 5, folder, lambda s: V.counts_with_late(s, folder))
    return V.late_counts(spark, folder).withColumn("total", F.round(F.coalesce("total", F.lit(0.0)), 6))
