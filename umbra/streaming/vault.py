"""Streams of values and texts: a vault of tokens as keyed state, and redaction by micro-batches with an idempotent commit."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from umbra.operators import audit, detect, protect
from umbra.sources.tables import stored
from umbra.streaming.folds import keyed_state


class Vault(StatefulProcessor):
    """The values whose first code is the same: which turn gave each its token, and the origins it was seen at."""

    OUT = ["category", "normalized", "token", "origin"]

    def __init__(self, key: str):
        self.key = key.encode()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "normalized string", "turn int")
        self.origins = handle.getMapState("origins", "normalized string, origin string", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        category, _ = key
        made = []
        for part in rows:
            for normalized, origin in sorted(set(zip(part["normalized"], part["origin"], strict=True))):
                if not self.turns.containsKey((normalized,)):
                    self.turns.updateValue((normalized,), (sum(1 for _ in self.turns.keys()),))
                if not self.origins.containsKey((normalized, origin)):
                    self.origins.updateValue((normalized, origin), (True,))
                    made.append((category, normalized, self.token(category, normalized, self.turns.getValue((normalized,))[0]), origin))
        yield pd.DataFrame(made, columns=self.OUT)

    def close(self) -> None:
        pass

    def token(self, category: str, normalized: str, turn: int) -> str:
        message = "\0".join([category, normalized, *([str(turn)] if turn else [])])
        number = int(hmac.new(self.key, message.encode(), hashlib.sha256).hexdigest()[:10], 16)
        return f"[[PII:{category}:{''.join(protect.BASE32[number >> (35 - 5 * i) & 31] for i in range(8))}]]"


def tokenize_stream(values: DataFrame, key: str) -> DataFrame:
    """(category, normalized, token, origin): each value's token, once for each origin at which it is seen; values: category, value, origin.

    A value keeps its token for good, and its origins grow as it is seen at more. Values whose first code is the same share one
    state, where the later one's token is made with a counter. A counted code is not held against the first codes of other states:
    among n values about n^3 / 2^81 tokens stand for two of them. Categories that must never be held get none, nor do null values.
    """
    keyed_state(values.sparkSession)
    normal = protect.normalize_value(F.col("category"), F.col("value"))
    rows = values.where(~F.col("category").isin(*protect.NEVER_TOKENS)).select("category", normal.alias("normalized"), "origin").where("normalized is not null and origin is not null")
    code = protect.base32_prefix(protect.hmac_sha256(key, F.concat("category", F.lit("\0"), "normalized")))
    out = "category string, normalized string, token string, origin string"
    return rows.withColumn("code", code).groupBy("category", "code").transformWithStateInPandas(Vault(key), out, "append", "none")


# ---- redaction by micro-batches: what a batch writes stands under its number, so a batch that runs again replaces what it wrote

SCHEMAS = {
    "vault": "category string, normalized string, value string, token string, origin string, batch int",
    "sightings": "origin string, seq long, category string, confidence double, batch int",
    "sealed": "unit_id string, origin string, text string, verdict string, batch int",
    "quarantine": "unit_id string, origin string, text string, verdict string, batch int",
}


def kept(spark, folder: str, name: str, before: int | None = None) -> DataFrame:
    """The rows of one of a stream's tables; of batches before a number, if given."""
    rows = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def redact_batch(units: DataFrame, policy: DataFrame, key: str, vault: DataFrame, sightings: DataFrame) -> dict[str, DataFrame]:
    """What a batch adds to the tables vault and sightings; out, all its units redacted; verdict, of each SEALED or the first failing check.

    units: unit_id, origin, seq, text; vault and sightings: those of all batches before. Only certain spans that become tokens
    enter the vault; an origin's sightings of before count in decisions; the audit looks for the values of the whole
    vault and knows its tokens.
    """
    found = stored(detect.scan(units))
    spans = detect.merge_spans(found, policy).join(units.select("unit_id", "seq"), "unit_id").withColumns({"source": F.lit("rule"), "needed_by_task": F.col("category").isin("EMAIL", "PHONE")})
    spans = stored(protect.decide(spans, policy, seen=sightings).withColumn("normalized", protect.normalize_value(F.col("category"), F.col("value"))))
    certain = spans.where(F.col("action").isin("TOKEN", "TOKEN_WITH_APPROVAL") & F.col("value").isNotNull() & ~F.col("category").isin(*protect.NEVER_TOKENS) & (F.col("certainty") == "detected"))
    issued = vault.groupBy("category", "normalized").agg(F.min("token").alias("token"))
    tokens = stored(protect.tokenize(certain, key, issued).select("category", "normalized", "token"))
    entries = certain.groupBy("category", "normalized", "origin").agg(F.min("value").alias("value")).join(tokens, ["category", "normalized"])
    entries = stored(entries.join(vault.select("category", "normalized", "origin"), ["category", "normalized", "origin"], "left_anti"))
    put = spans.where("action <> 'ALLOW'").join(certain.select("unit_id", "span_start", F.lit(True).alias("__t")), ["unit_id", "span_start"], "left").join(tokens, ["category", "normalized"], "left")
    put = put.select("unit_id", "span_start", "span_end", F.coalesce(F.when(F.col("__t"), F.col("token")), F.concat(F.lit("[REDACTED:"), "category", F.lit("]"))).alias("replacement"))
    out = stored(protect.redact_spans(units, put).select("unit_id", "origin", F.col("text_redacted").alias("text")))
    known = vault.select("category", "normalized", "value").unionByName(spans.where("action <> 'ALLOW' and value is not null").select("category", "normalized", "value"))
    known = stored(known.where(~F.col("category").isin(*protect.NEVER_TOKENS)).distinct())
    failures = {
        "rule-scan": audit.rescan_rules(out, spans.where("action = 'ALLOW'").select("unit_id", "category")), "known-value": audit.known_value_leaks(out, known),
        "unknown-token": audit.unknown_tokens(out, vault.select("token").unionByName(tokens.select("token"))),
    }
    seen = spans.groupBy("origin", "category", "confidence").agg(F.min("seq").alias("seq"))
    return {"vault": entries, "sightings": seen, "out": out, "verdict": audit.seal_verdict(out, audit.union_failures(failures))}


def commit_batch(units: DataFrame, number: int, policy: DataFrame, key: str, folder: str) -> None:
    """Redact one micro-batch and write all it adds under its number, the vault first. Running it again gives the same files' rows.

    Texts are read from the batch itself and kept once, redacted: of the audit only the verdicts are kept.
    """
    spark = units.sparkSession
    for name, schema in SCHEMAS.items():  # an empty table where there is none yet
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{folder}/{name}")
    made = redact_batch(units.select("unit_id", "origin", "seq", "text"), policy, key, kept(spark, folder, "vault", number), kept(spark, folder, "sightings", number))
    out, verdict = made.pop("out"), stored(made.pop("verdict"))
    made |= {name: out.join(verdict.where(which), "unit_id") for name, which in (("sealed", "verdict = 'SEALED'"), ("quarantine", "verdict <> 'SEALED'"))}
    for name in SCHEMAS:
        made[name].write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")


def redact_stream(units: DataFrame, policy: DataFrame, key: str, folder: str):
    """A stream writer that redacts units: rows that may leave go to folder/sealed, refused ones to folder/quarantine.

    Every table is exact after a failure at any point: a batch that is run again overwrites its own rows and sees only
    the vault of the batches before it. folder must be shared by all executors.
    """
    return units.writeStream.foreachBatch(lambda batch, number: commit_batch(batch, number, policy, key, folder)).option("checkpointLocation", f"{folder}/checkpoint")


# ---- counts that also say how much came too late


def counts_with_late(events: DataFrame, folder: str, late_seconds: int = 3600, size: str = "1 day"):
    """A stream writer of category counts that counts late rows too; read them with late_counts(folder).

    A row is late if its window has ended by the watermark: the latest time of all batches before, less late_seconds. Each
    batch writes its sums and its clock under its number, so one that runs again replaces them. events: ts, event_type, value.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], CLOCK).write.mode("append").partitionBy("batch").parquet(f"{folder}/clock")
        before = spark.read.schema(CLOCK).parquet(f"{folder}/clock").where(F.col("batch") < number).agg(F.max("latest")).first()[0]
        rows = batch.withColumn("w", F.window("ts", size))
        late = F.lit(False) if before is None else F.unix_micros("w.end") <= before - late_seconds * 1_000_000
        sums = rows.groupBy(F.col("w.start").alias("start"), "event_type").agg(F.count_if(~late).alias("n"), F.sum(F.when(~late, F.col("value"))).alias("total"), F.count_if(late).alias("n_late"))
        sums.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
        batch.agg(F.unix_micros(F.max("ts")).alias("latest")).write.mode("overwrite").parquet(f"{folder}/clock/batch={number}")

    return events.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint")


CLOCK = "latest long, batch int"
COUNTS = "start timestamp, event_type string, n long, total double, n_late long, batch int"


def late_counts(spark, folder: str) -> DataFrame:
    """(start, event_type, n, total, n_late): rows counted in each window, and rows that came too late for it."""
    rows = spark.read.schema(COUNTS).parquet(f"{folder}/counts")
    return rows.groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("n_late").alias("n_late"))
