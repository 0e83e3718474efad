"""Streams against their batch twins, over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from umbra.functions import rules as R
from umbra.operators import protect as P
from umbra.streaming import streams as T, vault as V

FAR = "2100-01-01 00:00:00"


def run(spark, rows, made, folder, batches=3, after=None):
    """The rows that made(stream) appends when rows come in `batches` files, one a batch; `after` comes last, to move the watermark."""
    parts = [rows.where(F.expr(f"day >= {i * 5} and day < {i * 5 + 5}")) for i in range(batches)]
    (folder / "in").mkdir()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out = made(stream)
    query = out.writeStream.format("parquet").option("path", str(folder / "out")).outputMode("append").option("checkpointLocation", str(folder / "c"))
    for part in [*parts, *([after] if after is not None else [])]:
        part.coalesce(1).write.mode("append").parquet(str(folder / "in"))
        query.trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(out.schema).parquet(str(folder / "out"))


@pytest.fixture(scope="module")
def events(spark):
    """Events in order from batch to batch: 15 days, four users, bursts of different lengths."""
    at = "1700000000 + day * 86400 + (k * k * 37) % 60000"
    return spark.range(15).withColumnRenamed("id", "day").crossJoin(spark.range(40).withColumnRenamed("id", "k")).selectExpr("day * 40 + k as event_id", f"timestamp_seconds({at}) as ts", "k % 4 as user_id", "concat('t', k % 3) as event_type", "double(k) as value", "day")


def sentinel(events):
    """A row far in the future, which moves the watermark past all others."""
    return events.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.lit(FAR).cast("timestamp"), "user_id": F.lit(-1).cast("long"), "day": F.lit(99).cast("long")})


def of_users(df):
    return sorted(map(str, df.where("user_id >= 0").collect()))


@pytest.mark.parametrize("op", [T.debounce, T.session_state])
def test_windowed_streams_equal_their_tables(spark, events, tmp_path, op):
    got = run(spark, events, lambda s: op(s, late="1 hour"), tmp_path, after=sentinel(events))
    want = of_users(op(events))
    assert of_users(got) == want and len(want) > 50


@pytest.fixture(scope="module")
def disordered(events):
    """Events of which many come a batch late, and bursts that go on from batch to batch: quiet times and lateness as long as a day and more."""
    return events.withColumn("day", F.when(F.col("event_id") % 3 == 0, F.least(F.col("day") + 5, F.lit(14))).otherwise(F.col("day"))).withColumns({
        "plan": F.when(F.col("event_id") % 5 > 1, F.transform(F.sequence(F.lit(1), F.col("event_id") % 11 + 1), lambda i: F.repeat(F.concat("event_type", i.cast("string")), 50))),
        "token": F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("s"), "event_id")),
    })


FOLDS = {
    "rate": lambda s: T.rate_limit(s, 1800, late="7 days"), "quiet": lambda s: T.settle_bounded(s, 5000, 1 << 30, late="7 days"), "bounded": lambda s: T.settle_bounded(s, 86400, 200_000, late="7 days"),
    "plans": lambda s: T.session_plans(s, 3600, late="7 days"),
}


@pytest.mark.parametrize("name", list(FOLDS))
def test_folds_of_disordered_streams_equal_their_tables(spark, disordered, tmp_path, name):
    got = run(spark, disordered, FOLDS[name], tmp_path, after=sentinel(disordered))
    want = of_users(FOLDS[name](disordered))
    assert of_users(got) == want and len(want) > (5 if name == "bounded" else 50)


def test_a_burst_goes_on_over_batches_and_ends_by_a_timer(spark, tmp_path):
    """Two events of one user at 0 s and 5,000 s in two batches are one burst for a quiet time of two hours and a lateness of one."""
    rows = [(0, 0, 1, 0), (1, 2000, 2, 0), (2, 4000, 2, 0), (3, 5000, 1, 5), (4, 6000, 2, 5), (5, 80000, 2, 5), (6, 90000, 2, 10)]
    timed = lambda rows: spark.createDataFrame(rows, "event_id long, at long, user_id long, day long").withColumn("ts", F.timestamp_seconds(F.col("at") + 10**6))
    day = 10**12
    got = run(spark, timed(rows), T.settle_bounded, tmp_path)
    assert [(r.start - day, r.stop - day, r.n, r.reason) for r in got.where("user_id = 1").collect()] == [(0, 5_000_000_000, 2, "quiet")]
    most = timed([(i, 1000 * i, 1, 0) for i in range(30)] + [(99, 10**6, 2, 5)])
    (tmp_path / "m").mkdir()
    got = run(spark, most.where("event_id < 10 or event_id = 99"), T.settle_bounded, tmp_path / "m", batches=2)
    assert [(r.start - day, r.n, r.reason) for r in got.where("user_id = 1").collect()] == [(0, 10, "quiet")]
    by_most = {(r.start - day, r.n, r.reason) for r in T.settle_bounded(most).where("user_id = 1").collect()}
    assert by_most == {(0, 22, "max"), (22_000_000_000, 8, "quiet")}


@pytest.mark.parametrize("buckets", [1, 64])
def test_keys_share_a_state(spark, disordered, tmp_path, monkeypatch, buckets):
    """However the keys are dealt, a stream gives what the table gives; sessions need no Python at all."""
    from umbra.streaming import folds

    monkeypatch.setattr(folds, "BUCKETS", buckets)
    many = disordered.withColumn("user_id", F.col("event_id") % 97)
    got = run(spark, many, FOLDS["bounded"], tmp_path, after=sentinel(many))
    assert of_users(got) == of_users(FOLDS["bounded"](many))
    assert "Python" not in FOLDS["plans"](many)._jdf.queryExecution().executedPlan().toString()


def test_the_newest_request_of_a_stream(spark, events, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i in range(3):
        events.where(f"day % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    T.coalesce_latest(stream).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(str, spark.table("newest").collect())) == sorted(map(str, T.coalesce_latest(events).collect()))


def test_origins_are_named_once_whatever_the_order(spark, tmp_path):
    kinds = ("CITY", "PIN_CODE", "DATE", "EMAIL", "OTP", "ORDER_ID")
    rows = [(f"o{i % 5}", i, kinds[(i * 7 + i // 5 * 2) % 6 if i % 5 else 0], 0.9 if i % 4 else 0.5, (i * 7) % 15) for i in range(75)]
    df = spark.createDataFrame([*rows, ("end", 10**6, "CITY", 0.9, 99)], "origin string, seq long, category string, confidence double, day long").withColumn("ts", F.timestamp_seconds("seq"))
    policy = R.load_policy(spark)
    got = run(spark, df.where("day < 99"), lambda s: T.origin_state(s, policy), tmp_path, after=df.where("day = 99"))
    key = lambda d: sorted((r.origin, r.what, r.seq) for r in d.collect())
    want = key(T.origin_state(df.where("day < 99").drop("ts"), policy))
    assert key(got) == want and {w for _, w, _ in want} == {"identity", "linkable"} and not any(o == "o0" and w == "linkable" for o, w, _ in want)


def test_origins_of_issued_values_grow(spark, tmp_path):
    rows = [("EMAIL", f"U{i % 7}@x.org", f"o{i % 4}", i % 15) for i in range(60)] + [("OTP", "123456", "o1", 3), ("EMAIL", None, "o1", 3), ("EMAIL", "a@b.org", None, 3)]
    df = spark.createDataFrame(rows, "category string, value string, origin string, day long")
    got = run(spark, df, lambda s: V.tokenize_stream(s.drop("day"), "k"), tmp_path)
    want = P.tokenize(df.where("value is not null and origin is not null"), "k").select("category", "normalized", "token", F.explode("origins").alias("origin"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 28


def test_values_of_one_code_get_other_tokens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "base32_prefix", lambda digest, chars=8, whole=P.base32_prefix: F.concat(F.lit("aaaaaaa"), F.substring(whole(digest), 1, 1)))
    df = spark.createDataFrame([("EMAIL", f"u{i}@x.org", "o", i % 15) for i in range(60)], "category string, value string, origin string, day long")
    got = run(spark, df, lambda s: V.tokenize_stream(s.drop("day"), "k"), tmp_path).collect()
    assert len(got) == len({r.token for r in got}) == len({r.normalized for r in got}) == 60


def vault_units(spark, rows):
    return spark.createDataFrame([(f"doc:{i}", o, i, t) for i, o, t in rows], "unit_id string, origin string, seq long, text string")


def test_a_stream_is_redacted_exactly_once(spark, tmp_path):
    policy, folder = R.load_policy(spark), str(tmp_path / "w")
    first = vault_units(spark, [(0, "s", "mail a@b.org please"), (1, "s", "card 4111 1111 1111 1111"), (2, "s", "plain, call 9876543210 now")])
    V.commit_batch(first, 0, policy, "k", folder)
    token = {r.normalized: r.token for r in V.kept(spark, folder, "vault").collect()}
    own = token["a@b.org"]
    second = vault_units(spark, [(3, "other", "again a@b.org or c@d.org"), (4, "s", f"as said {own}"), (5, "s", "see [[PII:EMAIL:aaaaaaaa]]"), (6, "s", "it is 98 / 765 / 432 / 10"), (7, "s", None)])
    everything = lambda: {name: sorted(map(str, V.kept(spark, folder, name).collect())) for name in V.SCHEMAS}
    V.commit_batch(second, 1, policy, "k", folder)
    once = everything()
    for number, batch in ((1, second), (1, second)):  # a batch that is run again, as after a failure
        V.commit_batch(batch, number, policy, "k", folder)
    assert everything() == once
    vault = V.kept(spark, folder, "vault").collect()
    token = {r.normalized: r.token for r in vault}
    assert token["a@b.org"] == own and {(r.normalized, r.origin, r.batch) for r in vault} == {("a@b.org", "s", 0), ("9876543210", "s", 0), ("a@b.org", "other", 1), ("c@d.org", "other", 1)}
    sealed = {r.unit_id: r.text for r in V.kept(spark, folder, "sealed").collect()}
    assert sealed == {"doc:0": f"mail {own} please", "doc:1": "card [REDACTED:CARD_NUMBER]", "doc:2": f"plain, call {token['9876543210']} now", "doc:3": f"again {own} or {token['c@d.org']}", "doc:4": f"as said {own}", "doc:7": None}
    refused = {r.unit_id: r.verdict for r in V.kept(spark, folder, "quarantine").collect()}
    assert refused == {"doc:5": "unknown-token", "doc:6": "known-value"}


def test_a_batch_keeps_its_texts_once(spark, tmp_path, monkeypatch):
    """Of what a batch writes beside its tables only the redacted texts hold texts: neither the batch itself nor the verdicts do."""
    kept = []
    monkeypatch.setattr(V, "stored", lambda df, whole=V.stored: kept.append(df.columns) or whole(df))
    V.commit_batch(vault_units(spark, [(0, "s", "mail a@b.org please"), (1, "s", "see [[PII:EMAIL:aaaaaaaa]]")]), 0, R.load_policy(spark), "k", str(tmp_path / "w"))
    assert sum("text" in columns for columns in kept) == 1
    assert [r.verdict for name in ("sealed", "quarantine") for r in V.kept(spark, str(tmp_path / "w"), name).collect()] == ["SEALED", "unknown-token"]


def test_sightings_of_earlier_batches_count(spark, tmp_path):
    """A quasi-identifier alone stays; after an identity at its origin, in an earlier batch, it does not."""
    policy = R.load_policy(spark)
    spans = lambda rows: spark.createDataFrame([(o, s, c, 0.9, "rule", "detected", False) for o, s, c in rows], "origin string, seq long, category string, confidence double, source string, certainty string, needed_by_task boolean")
    quasi = [r.category for r in policy.where("class = 'quasi' and not_needed = 'TOKEN_IF_IDENTITY_PRESENT'").orderBy("category").limit(1).collect()][0]
    named = [r.category for r in policy.where("is_identity").orderBy("category").limit(1).collect()][0]
    later, before = spans([("o", 5, quasi), ("p", 5, quasi)]), spans([("o", 1, named)])
    alone = {r.origin: r.action for r in P.decide(later, policy).collect()}
    after = {r.origin: r.action for r in P.decide(later, policy, seen=before).collect()}
    assert alone["o"] == alone["p"] == after["p"] != after["o"]


def test_late_rows_are_counted(spark, tmp_path):
    """Against a replay in plain Python; a batch that is run again changes nothing."""
    rows = [(i, (i * 97_777) % 400_000 + 86400, "ab"[i % 2], float(i), i // 60) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, at long, event_type string, value double, b long").withColumn("ts", F.timestamp_seconds("at"))
    folder = str(tmp_path / "late")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    clock, want = None, {}
    for b in range(5):
        df.where(f"b = {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        V.counts_with_late(stream, folder, 3600).trigger(availableNow=True).start().awaitTermination(120)
        for _, at, kind, value, n in rows:
            if n == b:
                start = at // 86400
                late = clock is not None and (start + 1) * 86400 <= clock - 3600
                old = want.get((start, kind), (0, 0.0, 0))
                want[start, kind] = (old[0] + (not late), old[1] + (0 if late else value), old[2] + late)
        clock = max([clock or 0, *(at for _, at, _, _, n in rows if n == b)])
    got = {(r.day, r.event_type): (r.n, r.total or 0.0, r.n_late) for r in V.late_counts(spark, folder).withColumn("day", F.unix_seconds("start") / 86400).collect()}
    assert got == want and sum(x[2] for x in want.values()) > 20


def test_tokens_that_collide_are_made_again_and_issued_ones_stay(spark, monkeypatch):
    """With codes of one letter, values collide round after round."""
    monkeypatch.setattr(P, "base32_prefix", lambda digest, chars=8, whole=P.base32_prefix: F.concat(F.lit("aaaaaaa"), F.substring(whole(digest), 1, 1)))
    values = spark.createDataFrame([("EMAIL", f"u{i}@x.org", "o") for i in range(12)], "category string, value string, origin string")
    first = P.tokenize(values.limit(6), "k")
    tokens = {r.normalized: r.token for r in first.collect()}
    assert len(set(tokens.values())) == len(tokens)
    more = {r.normalized: r.token for r in P.tokenize(values, "k", first).collect()}
    assert len(set(more.values())) == 12 and all(more[k] == t for k, t in tokens.items())
