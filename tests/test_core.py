"""Rules, merging, policy, tokens, redaction, streams."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from umbra.functions import rules as R
from umbra.operators import actions as A, audit as L, corpus as G, detect as D, evaluate as E, protect as P
from umbra.streaming import streams as T


def scanned(spark, *texts):
    units = spark.createDataFrame([(str(i), "o", t) for i, t in enumerate(texts)], "unit_id string, origin string, text string")
    return sorted((int(r.unit_id), r.category, r.span_start, r.span_end, r.value, r.confidence) for r in D.scan(units).collect())


def test_rules_find_values_where_they_stand(spark):
    got = scanned(spark, "é mail a.b@mail.example.org now", "card 4111 1111 1111 1111", "card 4111 1111 1111 1112", "pan ABCPE1234F", "pay me@ybl or me@other", "me@site.org", "KA 01 AB 1234", "12BH1234AB", None, "")
    assert (0, "EMAIL", 7, 27, "a.b@mail.example.org", 0.95) in got
    assert [g[1] for g in got if g[0] == 1] == ["CARD_NUMBER"]
    assert not [g for g in got if g[0] == 2]
    assert (3, "PAN", 4, 14, "ABCPE1234F", 0.9) in got
    assert sorted((g[4], g[5]) for g in got if g[0] == 4) == [("me@other", 0.55), ("me@ybl", 0.9)]
    assert [g[1] for g in got if g[0] == 5] == ["EMAIL"]
    assert [(g[1], g[5]) for g in got if g[0] == 6] == [("VEHICLE_REG", 0.7)]
    assert [(g[1], g[5]) for g in got if g[0] == 7] == [("VEHICLE_REG", 0.85)]


def test_quirks_are_kept(spark):
    got = scanned(spark, "+919876543210", "+91 98765 43210", "**** **** 1234", "x*** **** 1234")
    assert not [g for g in got if g[0] == 0]
    assert [g[1] for g in got if g[0] == 1] == ["PHONE"]
    assert not [g for g in got if g[0] == 2]
    assert [g[1] for g in got if g[0] == 3] == ["AADHAAR"]


def test_spelt_patterns_match_what_the_patterns_do():
    both = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    parts = ["2345 6789 0123", "XXXX-XXXX-1234", "ABCPE1234F", "4111 1111 1111 1111", "a.b@c.com", "x_y@ybl", "+91 98765 43210", "ABCD0123456", "12BH1234AB", "MH 12 AB 1234", "12/05/1990", "3 Mar 2019", "ABC1234567", "eyJa.b.c", *"Aa09_-.@ ,é+/*X"]
    draw = random.Random(7)
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 8))) for _ in range(1500)]
    for rule in (*R.RULES, *R.CONTEXT_RULES, *R.SHAPES):
        plain, spelt = re.compile(rule.pattern.replace(r"\b", both)), re.compile(rule.spark_pattern)
        for text in texts:
            assert [m.span() for m in plain.finditer(text)] == [m.span() for m in spelt.finditer(text)], (rule.name, text)
    spelt = {r.name: r.spark_pattern for r in R.RULES}
    assert not [n for n in ("aadhaar", "pan", "card", "phone", "ifsc", "vehicle_bh", "vehicle") if R.BOUNDARY in spelt[n]]  # one side to look at, not both at every place


def test_marks_in_texts_are_read_as_spaces(spark):
    assert scanned(spark, "\x01a@b.com\x02 9876543210\x01", "no\x01thing\x02", "98765\x0143210") == [(0, "EMAIL", 1, 8, "a@b.com", 0.95), (0, "PHONE", 10, 20, "9876543210", 0.75)]


def test_check_digits(spark):
    ids = G.generate_identifiers(spark.range(1, 200).withColumnRenamed("id", "c_custkey"))
    units = ids.select("unit_id", F.lit("o").alias("origin"), "category", F.col("value").alias("text"))
    found = D.scan(units, keep=("unit_id",)).select("unit_id", "category").distinct()
    missed = ids.join(found, ["unit_id", "category"], "left_anti").where(F.col("category").isin("AADHAAR", "CARD_NUMBER", "PAN", "EMAIL", "PHONE", "IFSC", "UPI_ID"))
    assert missed.count() == 0
    misses = G.generate_near_misses(ids).select("unit_id", F.col("value").alias("text"), "category")
    assert D.scan(misses, keep=("unit_id",)).join(misses, ["unit_id", "category"]).count() == 0


def test_truth_stands_in_the_text(spark):
    rendered = G.render_labelled_text(G.generate_identifiers(spark.range(1, 20).withColumnRenamed("id", "c_custkey")))
    rows = G.truth_of(rendered).join(rendered.select("unit_id", "text"), "unit_id").collect()
    assert len(rows) == 19 * len(G.KINDS) and all(r.text[r.span_start : r.span_end] == r.value for r in rows)


def test_labels(spark):
    texts = spark.createDataFrame([("1", "City name"), ("2", "UPI PIN"), ("3", "Father's Name:"), ("4", "Company name"), ("5", "पिता का नाम"), ("6", "surname")], "unit_id string, text string")
    top = {r.unit_id: r.category for r in D.match_labels(texts, R.load_labels(spark)).where("rank = 1").collect()}
    assert top == {"1": "CITY", "2": "UPI_PIN", "3": "NAME", "4": "EMPLOYER", "5": "NAME"}


def test_merging(spark):
    rows = [("u", "o", "r1", "EMAIL", 0, 10, "x", 0.5), ("u", "o", "r2", "UPI_ID", 5, 12, "x", 0.5), ("u", "o", "r3", "PHONE", 12, 20, "x", 0.75)]
    df = spark.createDataFrame(rows, "unit_id string, origin string, rule string, category string, span_start int, span_end int, value string, confidence double")
    got = sorted((r.span_start, r.span_end, r.category, r.confidence) for r in D.merge_spans(df, R.load_policy(spark)).collect())
    assert got == [(0, 12, "UPI_ID", 0.75), (12, 20, "PHONE", 0.75)]


def test_decisions(spark):
    rows = [("o", 1, "CITY", 0.9, "rule", "detected", False), ("o", 2, "EMAIL", 0.9, "rule", "detected", True), ("o", 3, "CITY", 0.9, "rule", "detected", False), ("o", 3, "CITY", 0.4, "rule", "uncertain", False),
            ("p", 1, "OTP", 0.9, "rule", None, True), ("p", 2, "PAN", 0.9, "rule", None, True), ("q", 1, "CITY", 0.9, "vault", None, False), ("q", 1, "OTHER", 0.9, "rule", None, False)]
    df = spark.createDataFrame(rows, "origin string, seq int, category string, confidence double, source string, certainty string, needed_by_task boolean")
    got = sorted((r.origin, r.seq, r.category, r.action) for r in P.decide(df, R.load_policy(spark)).collect())
    assert got == [("o", 1, "CITY", "ALLOW"), ("o", 2, "EMAIL", "TOKEN"), ("o", 3, "CITY", "FILL"), ("o", 3, "CITY", "TOKEN"), ("p", 1, "OTP", "USER_ENTERS"), ("p", 2, "PAN", "TOKEN_WITH_APPROVAL"), ("q", 1, "CITY", "FILL"), ("q", 1, "OTHER", "ALLOW")]
    changed = {r.category: r.action for r in P.decide(df.where("origin in ('p', 'q')"), R.load_policy(spark), overrides={"PAN": "ALLOW", "CITY": "BLUR"}).collect()}
    assert changed["PAN"] == "TOKEN_WITH_APPROVAL" and changed["CITY"] == "BLUR"


def test_tokens(spark):
    rows = spark.createDataFrame([("EMAIL", " A@b.org", "x"), ("EMAIL", "a@B.org", "y"), ("OTP", "1234", "x"), ("PHONE", "+91 98765 43210", "x")], "category string, value string, origin string")
    got = {(r.category, r.normalized): (r.token, r.origins) for r in P.tokenize(rows, "k").collect()}
    assert set(got) == {("EMAIL", "a@b.org"), ("PHONE", "9876543210")}
    digest = int.from_bytes(hmac.new(b"k", b"EMAIL\0a@b.org", hashlib.sha256).digest()[:5], "big")
    want = "".join(P.BASE32[digest >> 35 - 5 * i & 31] for i in range(8))
    assert got["EMAIL", "a@b.org"] == (f"[[PII:EMAIL:{want}]]", ["x", "y"])
    other = {r.normalized: r.token for r in P.tokenize(rows, "another").collect()}
    assert not {t for t, _ in got.values()} & set(other.values())


def test_redaction_is_whole_and_repeats_change_nothing(spark):
    units = spark.createDataFrame([("1", "o", "mail a@b.org and c@d.org!"), ("2", "o", "none"), ("3", "o", None)], "unit_id string, origin string, text string")
    spans = D.merge_spans(D.scan(units), R.load_policy(spark)).withColumn("replacement", F.lit("[X]"))
    got = {r.unit_id: (r.text_redacted, r.n_redacted) for r in P.redact_spans(units, spans).collect()}
    assert got == {"1": ("mail [X] and [X]!", 2), "2": ("none", 0), "3": (None, 0)}
    again = P.redact_spans(units, spans).select("unit_id", "origin", F.col("text_redacted").alias("text"))
    assert D.scan(again).count() == 0


def test_neutralize_and_urls(spark):
    df = spark.createDataFrame([("a [[PII:EMAIL:abcdefgh]] b", "https://h.org/a/12345/b?q=1#f"), ("[ [pii : email : ABCDEFGH ] ]", "nothing")], "t string, u string")
    got = df.select(P.neutralize(F.col("t")).alias("t"), P.sanitize_url(F.col("u")).alias("u")).collect()
    assert got[0].t == "a [removed] b" and got[1].t == "[removed]"
    assert (got[0].u, got[1].u) == ("https://h.org/a/:id/b", "")


def test_known_values_in_other_forms(spark):
    texts = ["write to john@x.com.", "call +91 98765 43210 now", "(John@X.com)", "nothing 98765", "[[PII:PHONE:aaaaaa22]] 9876543 21", "pay 1,234,567.00 today"]
    units = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "unit_id string, text string")
    known = [("EMAIL", "john@x.com", "John@x.com"), ("PHONE", "9876543210", "+91 98765-43210"), ("AMOUNT", "1234567", "1,234,567")]
    vault = spark.createDataFrame(known, "category string, normalized string, value string")
    digits = lambda x: "".join(c for c in x if c.isdigit())
    want = {(str(i), c) for i, x in enumerate(texts) for c, n, v in known if n in x.lower() or v.lower() in x.lower() or any(len(digits(f)) >= 7 and digits(f) in digits(x) for f in (n, v))}
    assert {(r.unit_id, r.category) for r in L.known_value_leaks(units, vault).collect()} == want == {("0", "EMAIL"), ("1", "PHONE"), ("2", "EMAIL"), ("5", "AMOUNT")}


def test_every_check_reaches_the_verdict(spark):
    units = spark.createDataFrame([(c,) for c in (*L.CHECKS, "none")], "unit_id string")
    found = {c: units.where(F.col("unit_id") == c) for c in L.CHECKS[1:]}
    got = {r.unit_id: r.verdict for r in L.seal_verdict(units, L.union_failures(found)).collect()}
    assert got == {c: c for c in L.CHECKS[1:]} | {"schema": "SEALED", "none": "SEALED"}


def test_audit(spark):
    units = spark.createDataFrame([("1", "o", "x a@b.org"), ("2", "o", "[[PII:EMAIL:aaaaaaaa]]")], "unit_id string, origin string, text string")
    none = spark.createDataFrame([], "unit_id string, category string")
    assert [(r.unit_id, r.category) for r in L.rescan_rules(units, none).collect()] == [("1", "EMAIL")]
    vault = spark.createDataFrame([("EMAIL", "A@b.org", "[[PII:EMAIL:bbbbbbbb]]")], "category string, normalized string, token string")
    assert [r.unit_id for r in L.known_value_leaks(units, vault).collect()] == ["1"]
    assert [r.unit_id for r in L.unknown_tokens(units, vault).collect()] == ["2"]
    failures = spark.createDataFrame([("1", "known-value"), ("1", "rule-scan")], "unit_id string, check string")
    assert {r.unit_id: r.verdict for r in L.seal_verdict(units, failures).collect()} == {"1": "rule-scan", "2": "SEALED"}
    sent = L.digests(units)
    assert [r.unit_id for r in L.digest_mismatch(sent, units.withColumn("text", F.when(F.col("unit_id") == "1", "y").otherwise(F.col("text")))).collect()] == ["1"]


def test_coverage(spark):
    span = "unit_id string, span_start int, span_end int"
    want = spark.createDataFrame([("1", 0, 5), ("1", 10, 14), ("2", 3, 6), ("3", 0, 4)], span)
    applied = spark.createDataFrame([("1", 0, 3), ("1", 3, 6), ("1", 10, 13), ("3", 0, 4)], span)
    assert sorted((r.unit_id, r.span_start, r.covered) for r in L.coverage_gaps(want, applied).collect()) == [("1", 10, 3), ("2", 3, 0)]


def test_metrics(spark):
    truth = spark.createDataFrame([("u", 0, "A", "v", 0, 1), ("u", 1, "B", "v", 2, 3), ("u", 2, "NONE", "v", 4, 5)], "unit_id string, ann_id long, category string, value string, span_start int, span_end int")
    hits = spark.createDataFrame([("u", 0, "A"), ("u", 0, "A"), ("u", 1, "A"), ("u", 2, "B")], "unit_id string, ann_id long, category string")
    got = {r.category: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in E.precision_recall(truth, hits).collect()}
    assert got == {"A": (1, 1, 0, 0.5, 1.0), "B": (0, 1, 1, 0.0, 0.0), None: (1, 2, 1, 0.333, 0.5)}


def test_near_hashes_equal_brute_force(spark):
    random.seed(1)
    base = random.getrandbits(56)
    hashes = [(i, base ^ sum(1 << b for b in random.sample(range(56), i % 9))) for i in range(60)]
    got = {(r.a, r.b) for r in A.near_hashes(spark.createDataFrame(hashes, "vec_id long, dhash long")).collect()}
    reps = {}
    for i, h in hashes:
        reps.setdefault(h, i)
    want = {(min(reps[h], reps[g]), max(reps[h], reps[g])) for _, h in hashes for _, g in hashes if h != g and (h ^ g).bit_count() <= 5} | {(reps[h], i) for i, h in hashes if reps[h] != i}
    assert got == want


@pytest.mark.parametrize("op", [T.category_counts, T.settle_windows, T.session_state])
def test_streams_equal_their_batch_twins(spark, tmp_path, op):
    rows = spark.range(500).selectExpr("id as event_id", "timestamp_seconds(1700000000 + id * 977 % 400000) as ts", "id % 5 as user_id", "concat('t', id % 3) as event_type", "double(id) as value")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([(9999, "2100-01-01 00:00:00", -1, "end", 0.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    query = op(stream, late="30 days").writeStream.format("memory").queryName(op.__name__).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    last.write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all windows
    query = op(stream, late="30 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(op(rows).schema).parquet(str(tmp_path / "out"))
    key = lambda df: sorted(map(str, df.where("start < timestamp'2099-01-01'").collect()))
    assert key(got) == key(op(rows))
