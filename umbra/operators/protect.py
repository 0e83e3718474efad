"""Policy decisions, tokens, redaction."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from umbra.sources.tables import stored

NEVER_TOKENS = ("PASSWORD", "OTP", "CVV", "UPI_PIN", "SECRET")
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
TOKEN = r"\[\[PII:[A-Z_]+:[a-z2-7]{8}\]\]"


def first_seen(detections: DataFrame, policy: DataFrame, kinds: Column) -> DataFrame:
    """(origin, category, seq): when an origin first showed each category. Sums up before it is windowed."""
    return detections.join(F.broadcast(policy), "category").where(kinds).groupBy("origin", "category").agg(F.min("seq").alias("seq"))


def identity_seen(detections: DataFrame, policy: DataFrame) -> DataFrame:
    """(origin, seq): from this capture on, an identity of confidence 0.6 or more has been seen at the origin."""
    return first_seen(detections, policy, F.col("is_identity") & (F.col("confidence") >= 0.6)).groupBy("origin").agg(F.min("seq").alias("seq"))


def linkability(detections: DataFrame, policy: DataFrame, k: int = 3) -> DataFrame:
    """(origin, seq): from this capture on, k quasi-identifying categories have been seen at the origin."""
    firsts = first_seen(detections, policy, F.col("class") == "quasi")
    nth = F.row_number().over(Window.partitionBy("origin").orderBy("seq", "category"))
    return firsts.withColumn("n", nth).where(F.col("n") == k).select("origin", "seq")


def decide(detections: DataFrame, policy: DataFrame, k: int = 3, overrides: dict[str, str] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """detections with class and action.

    detections: origin, seq, category, confidence, source, certainty, needed. Quasi-identifiers become tokens once
    the origin has shown an identity or k of them. Uncertain spans take the branch for values that aren't
    needed and are masked at least; known values are never let through; a user may change unlocked classes.
    seen: sightings from before (origin, seq, category, confidence), which count for their origin as the detections do.
    """
    joined = detections.join(F.broadcast(policy).drop("is_identity"), "category", "left")
    sightings = detections.select("origin", "seq", "category", "confidence")
    sightings = sightings if seen is None else sightings.unionByName(seen.select(*sightings.columns))
    named = identity_seen(sightings, policy).withColumnRenamed("seq", "__identity")
    linked = linkability(sightings, policy, k).withColumnRenamed("seq", "__linked")
    known = joined.join(named, "origin", "left").join(linked, "origin", "left")
    unsure = F.coalesce(F.col("certainty"), F.lit("detected")) == "uncertain"
    together = F.coalesce(F.col("__identity") <= F.col("seq"), F.lit(False)) | F.coalesce(F.col("__linked") <= F.col("seq"), F.lit(False))
    base = F.when(F.col("needed_by_task") & ~unsure, F.coalesce("needed", F.lit("ALLOW"))).otherwise(F.coalesce("not_needed", F.lit("ALLOW")))
    resolved = F.when(base != "TOKEN_IF_IDENTITY_PRESENT", base).when(together, F.col("cond_then")).otherwise(F.col("cond_else"))
    if overrides:
        wish = F.element_at(F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]), F.col("category"))
        resolved = F.when(wish.isNotNull() & ~F.coalesce("locked", F.lit(False)) & ~unsure, wish).otherwise(resolved)
    safe = F.when((F.col("source") == "vault") & (resolved == "ALLOW"), "FILL").otherwise(resolved)
    action = F.when(unsure & safe.isin("TOKEN", "TOKEN_WITH_APPROVAL", "ALLOW"), "FILL").otherwise(safe)
    return known.withColumns({"class": F.coalesce("class", F.lit("non_pii")), "action": action}).drop("risk_rank", "locked", "needed", "not_needed", "cond_then", "cond_else", "__identity", "__linked")


@F.pandas_udf(T.StringType())
def _nfkc(value: pd.Series) -> pd.Series:
    return value.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def compatible(value: Column) -> Column:
    """A text in the compatibility form of Unicode (NFKC): full-width digits are digits, composed letters one character. Plain ASCII stays in the engine."""
    other = value.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfkc(F.when(other, value)), value)


def normalize_value(category: Column, value: Column) -> Column:
    """A value as equal values are compared."""
    value = compatible(value)
    digits = F.regexp_replace(value, "[^0-9]", "")
    phone = F.when(digits.startswith("91") & (F.length(digits) > 10), F.right(digits, F.lit(10))).otherwise(digits)
    return (
        F.when(category == "EMAIL", F.lower(F.trim(value)))
        .when(category == "PHONE", F.right(F.regexp_replace(phone, "^0", ""), F.lit(10)))
        .when(category.isin("AADHAAR", "CARD_NUMBER", "BANK_ACCOUNT"), digits)
        .when(category.isin("PAN", "IFSC", "VEHICLE_REG"), F.upper(F.regexp_replace(value, r"\s", "")))
        .when(category.isin("NAME", "ADDRESS", "CITY", "EMPLOYER"), F.lower(F.regexp_replace(F.trim(value), r"\s+", " ")))
        .otherwise(F.trim(value))
    )


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hex, composed of two digests."""
    block = key.encode().ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def base32_prefix(hexadecimal: Column, chars: int = 8) -> Column:
    """The first characters, five bits each, of a digest."""
    number = F.conv(F.substring(hexadecimal, 1, 10), 16, 10).cast("long")
    letter = lambda i: F.substring(F.lit(BASE32), (F.shiftright(number, 35 - 5 * i).bitwiseAND(31)).cast("int") + 1, F.lit(1))
    return F.concat(*[letter(i) for i in range(chars)])


def tokenize(values: DataFrame, key: str, issued: DataFrame | None = None) -> DataFrame:
    """(category, normalized, token, origins): one keyed token for each value; equal values have equal tokens.

    Categories that must never be held get none, nor do uncertain detections (column certainty, or else a confidence below
    0.6, where values have them) and null values. A value whose token another one has, which was issued before or
    comes first in order, is hashed again with a counter until no two are alike. Values in issued (category,
    normalized, token) keep the tokens that they have, so a value's token doesn't change as more values come.
    """
    normal = normalize_value(F.col("category"), F.col("value"))
    sure = F.coalesce(F.col("certainty") != "uncertain", F.lit(True)) if "certainty" in values.columns else F.coalesce(F.col("confidence") >= 0.6, F.lit(True)) if "confidence" in values.columns else F.lit(True)
    distinct = values.where(~F.col("category").isin(*NEVER_TOKENS) & sure & F.col("value").isNotNull()).groupBy("category", normal.alias("normalized")).agg(F.sort_array(F.collect_set("origin")).alias("origins"))
    names = ["category", "normalized"]
    made = []
    if issued is not None:
        held = issued.select(*names, "token")
        made = [distinct.join(held, names)]
        distinct = distinct.join(held, names, "left_anti")
    taken = None if issued is None else issued.select("category", "token")
    left, turn = distinct, 0
    while True:
        message = F.concat("category", F.lit("\0"), "normalized", *([F.lit(f"\0{turn}")] if turn else []))
        asked = left.withColumn("token", F.concat(F.lit("[[PII:"), "category", F.lit(":"), base32_prefix(hmac_sha256(key, message)), F.lit("]]")))
        if taken is not None:
            asked = asked.join(taken.distinct().withColumn("__taken", F.lit(True)), ["category", "token"], "left")
        first = F.row_number().over(Window.partitionBy("category", "token").orderBy("normalized"))
        asked = stored(asked.withColumn("__ok", (first == 1) & (F.col("__taken").isNull() if taken is not None else F.lit(True))))
        good = asked.where("__ok").select(*names, "token", "origins")
        made.append(good)
        left = asked.where("not __ok").select(*names, "origins")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, (m.select(*names, "token", "origins") for m in made))
        taken = good.select("category", "token") if taken is None else taken.unionByName(good.select("category", "token"))
        turn += 1


def neutralize(text: Column) -> Column:
    """Text in which planted look-alikes of tokens are taken apart."""
    visible = F.regexp_replace(text, "[​-‏⁠﻿]", "")
    return F.regexp_replace(visible, r"(?i)[\[［]\s*[\[［]\s*PII\s*[:：]\s*[A-Z_]+\s*[:：]\s*[A-Z2-7]{8}\s*[\]］]\s*[\]］]", "[removed]")


def redact_spans(units: DataFrame, spans: DataFrame) -> DataFrame:
    """units with text_redacted and n_redacted; spans: unit_id, span_start, span_end, replacement (not overlapping)."""
    pieces = spans.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "replacement"))).alias("__s"))
    joined = units.join(pieces, "unit_id", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a.out, F.substring(F.col("text"), a.at + 1, s.span_start - a.at), s.replacement).alias("out"), s.span_end.alias("at"))
    done = F.aggregate("__s", start, step, lambda a: F.concat(a.out, F.substring(F.col("text"), a.at + 1, F.length("text"))))
    return joined.withColumns({"text_redacted": F.coalesce(done, F.col("text")), "n_redacted": F.coalesce(F.size("__s"), F.lit(0))}).drop("__s")


def sanitize_url(url: Column) -> Column:
    """Scheme, host and path; id-like path segments as :id; what is no address is empty."""
    base = F.regexp_extract(url, r"^([a-z][a-z0-9+.-]*://[^/?#\s]+)([^?#\s]*)", 1)
    path = F.regexp_extract(url, r"^([a-z][a-z0-9+.-]*://[^/?#\s]+)([^?#\s]*)", 2)
    id_like = lambda s: s.rlike(r"^[0-9]{3,}$") | s.rlike(r"^[0-9a-f]{8,}$") | s.rlike(r"^[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*$") & (F.length(s) >= 8)
    parts = F.transform(F.split(path, "/"), lambda s: F.when(id_like(s), ":id").otherwise(s))
    return F.when(base == "", "").otherwise(F.concat(base, F.array_join(parts, "/")))


def length_bucket(value: Column, category: Column) -> Column:
    n = F.length(value)
    return F.when(category.isin(*NEVER_TOKENS), None).when(n == 0, "empty").when(n <= 16, "short").when(n <= 64, "medium").otherwise("long")


def consent_summary(decisions: DataFrame) -> DataFrame:
    """(origin, ordinary, high, credential): what a user is asked about an origin."""
    of = lambda *classes: F.array_join(F.sort_array(F.collect_set(F.when(F.col("class").isin(*classes), F.col("category")))), ",")
    return decisions.groupBy("origin").agg(of("medium", "quasi").alias("ordinary"), of("high").alias("high"), F.bool_or(F.col("class").isin("credential", "never_automated")).alias("credential"))


def privacy_receipt(decisions: DataFrame) -> DataFrame:
    """(category, rule, n): protected spans by category and by each rule that found them."""
    return decisions.where("action <> 'ALLOW'").select("category", F.explode(F.split("rules", ",")).alias("rule")).groupBy("category", "rule").agg(F.count(F.lit(1)).alias("n"))


def text_budget(units: DataFrame, most: int = 4000) -> DataFrame:
    """(origin, unit_id): units that fit into `most` characters of their origin in order; a smaller later one is still taken.

    Whether one fits depends on all before it, so an origin's rows are read in order by one task, which holds only a
    sum of them, however many there are.
    """

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        origin, used = None, 0
        for rows in batches:
            keep = []
            for o, n in zip(rows["origin"], rows["n"], strict=True):
                if o != origin:
                    origin, used = o, 0
                keep.append(used + n <= most)
                used += n if keep[-1] else 0
            yield rows.loc[keep, ["origin", "unit_id"]]

    sized = units.select("origin", "unit_id", "seq", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return sized.repartition("origin").sortWithinPartitions("origin", "seq", "unit_id").mapInPandas(taken, "origin string, unit_id string")


def necessity(detections: DataFrame, vault: DataFrame, categories: list[str]) -> DataFrame:
    """detections (with editable and field_category, of their target) with needed_by_task: the value is in the vault already, or
    it stands in a field that can be edited and whose category the task asks for."""
    held = vault.select("category", "normalized", F.lit(True).alias("__held")).distinct()
    normal = detections.withColumn("normalized", normalize_value(F.col("category"), F.col("value")))
    joined = normal.join(held, ["category", "normalized"], "left")
    asked = F.coalesce(F.col("editable") & F.col("field_category").isin(*categories), F.lit(False))
    return joined.withColumn("needed_by_task", F.coalesce("__held", F.lit(False)) | asked).drop("__held")


def rehydrate(requests: DataFrame, vault: DataFrame) -> DataFrame:
    """(request_id, text, reason): all tokens of a text replaced by their values, or the request refused with a reason.

    requests: request_id, action, origin, text, field_category, input_type, consented. Only `type` may carry values, only where the
    user consented, only tokens that were issued, into a field of their category (a password's into a password field), and
    only at an origin where the value was seen.
    """
    token = F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))))
    asked = requests.withColumn("token", token).join(vault.select("token", "category", "normalized", "origins"), "token", "left")
    other = F.coalesce("field_category", F.lit("")) != F.col("category")
    other = other | (F.col("category") == "PASSWORD") & (F.coalesce("input_type", F.lit("")) != "password")
    reasons = ((F.col("action") != "type", "action"), (~F.col("consented"), "consent"), (F.col("normalized").isNull(), "unknown"), (other, "category"), (~F.array_contains("origins", F.col("origin")), "origin"))
    reason = F.lit(None).cast("string")
    for on, name in reversed(reasons):
        reason = F.when(on, name).otherwise(reason)
    rows = asked.withColumn("reason", F.when(F.col("token").isNotNull(), reason)).groupBy("request_id", "text").agg(
        F.min("reason").alias("reason"), F.array_sort(F.collect_list(F.when(F.col("normalized").isNotNull(), F.struct("token", "normalized")))).alias("pairs")
    )
    filled = F.aggregate("pairs", F.col("text"), lambda t, p: F.replace(t, p.token, p.normalized))
    return rows.select("request_id", F.when(F.col("reason").isNull(), filled).alias("text"), "reason")


def carried(sanitized: DataFrame) -> DataFrame:
    """(origin, tokens, bytes): tokens and bytes that leave, by origin."""
    return sanitized.groupBy("origin").agg(F.sum(F.regexp_count("text", F.lit(TOKEN))).alias("tokens"), F.sum(F.octet_length("text")).alias("bytes"))


def mask_plan(decisions: DataFrame, vault: DataFrame) -> DataFrame:
    """(unit_id, span_start, category, mask, label, token): how each protected span is masked; a label names the category and the id of the value's
    token, or the category alone where the vault has none."""
    mask = F.when(F.col("action").isin("TOKEN", "TOKEN_WITH_APPROVAL"), "LABELLED_FILL").when(F.col("action") == "BLUR", "BLUR").when(F.col("action") == "FILL_REGION", "FILL_REGION").otherwise("FILL")
    named = decisions.where("action <> 'ALLOW'").withColumn("normalized", normalize_value(F.col("category"), F.col("value"))).withColumn("mask", mask)
    joined = named.join(vault.select("category", "normalized", F.col("token").alias("__token")), ["category", "normalized"], "left")
    token = F.when(F.col("mask") == "LABELLED_FILL", F.col("__token"))
    code = F.coalesce(F.concat(F.lit("#"), F.expr("substring(__token, length(__token) - 9, 8)")), F.lit(""))
    label = F.when(F.col("mask") == "LABELLED_FILL", F.concat(F.lit("["), "category", code, F.lit("]")))
    return joined.select("unit_id", "span_start", "category", "mask", label.alias("label"), token.alias("token"))


def suppress_secret_values(fields: DataFrame, top: DataFrame) -> DataFrame:
    """(unit_id, value, has_value): values of fields whose label is that of a secret are nulled; top: unit_id, category."""
    joined = fields.join(top.select("unit_id", "category"), "unit_id", "left")
    value = F.when(~F.coalesce(F.col("category").isin(*NEVER_TOKENS), F.lit(False)), F.col("value"))
    return joined.select("unit_id", value.alias("value"), (F.coalesce("value", F.lit("")) != "").alias("has_value"))


def replace_known(units: DataFrame, values: DataFrame) -> DataFrame:
    """units with every occurrence of their values replaced, but inside tokens; values: unit_id, nth, value, replacement.

    Values come one after the other by nth, so a replacement that is a token is safe from those that follow.
    """
    listed = values.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("nth", "value", "replacement"))).alias("__v"))

    def step(text: Column, v: Column) -> Column:
        free, tokens = F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
        done = F.transform(free, lambda x, i: F.concat(F.replace(x, v.value, v.replacement), F.coalesce(F.get(tokens, i), F.lit(""))))
        return F.when(F.contains(text, v.value), F.array_join(done, "")).otherwise(text)

    joined = units.join(listed, "unit_id", "left")
    return joined.withColumn("text", F.when(F.col("__v").isNull(), F.col("text")).otherwise(F.aggregate("__v", F.col("text"), step))).drop("__v")


def outbound_projection(elements: DataFrame) -> DataFrame:
    """What of elements may leave: those seen or hidden but usable, the latter without place, value and length.

    elements: eid, fp, role, label, x, y, visible, hidden_interactive, enabled, input_type, has_value, category, bucket, token.
    """
    seen = F.col("visible")
    secret = F.coalesce(F.col("category").isin(*NEVER_TOKENS), F.lit(False)) | (F.coalesce("input_type", F.lit("")) == "password")
    if_seen = lambda c: F.when(seen, F.col(c))
    return elements.where(seen | F.col("hidden_interactive")).select(
        "eid", "fp", "role", "label", "visible", F.when(seen, F.col("x")).otherwise(0).alias("x"), F.when(seen, F.col("y")).otherwise(0).alias("y"), (seen & F.col("enabled")).alias("enabled"),
        if_seen("input_type").alias("input_type"), if_seen("has_value").alias("has_value"), F.when(seen & ~secret, F.col("bucket")).alias("bucket"), if_seen("token").alias("token"), (~seen).alias("hidden_interactive"),
    )


def render_context(units: DataFrame, history: DataFrame, most: int = 5) -> DataFrame:
    """(origin, context): the texts of an origin in order and the last few steps of its history (origin, step, action, verdict), line by line."""
    texts = units.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("seq", "unit_id", "text"))).alias("t"))
    last = history.withColumn("__r", F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("step")))).where(F.col("__r") <= most)
    steps = last.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("step", "action", "verdict"))).alias("h"))
    lines = F.transform("t", lambda x: F.concat(F.lit("- "), F.coalesce(x.text, F.lit(""))))
    done = F.transform(F.coalesce("h", F.array().cast("array<struct<step:bigint,action:string,verdict:string>>")), lambda x: F.concat(F.lit("* "), x.step.cast("string"), F.lit(" "), x.action, F.lit(" "), x.verdict))
    return texts.join(steps, "origin", "left").select("origin", F.array_join(F.concat(lines, done), "\n").alias("context"))


def text_window(units: DataFrame, most_blocks: int = 40, most_chars: int = 2000) -> DataFrame:
    """(origin, unit_id, text): the first blocks of an origin; the one that passes the characters is cut, and nothing follows."""
    order = Window.partitionBy("origin").orderBy("seq", "unit_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = units.withColumns({"__n": F.count(F.lit(1)).over(order), "__sum": F.sum(F.length("text")).over(order)})
    before = F.col("__sum") - F.length("text")
    return counted.where((F.col("__n") <= most_blocks) & (before < most_chars)).select("origin", "unit_id", F.substring("text", F.lit(1), F.lit(most_chars) - before).alias("text"))
