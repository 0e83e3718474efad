"""Event-time operators. Each is one definition for streams and tables: windows, sessions, or folds over a key's rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from umbra.operators import protect
from umbra.streaming.folds import Fold, folded


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def timed(events: DataFrame) -> DataFrame:
    """Events with ts as an instant, which watermarks ask for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def category_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows; streaming rows later than the watermark are dropped, and counted in the query's progress."""
    rows = _watermarked(events, late)
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def settle_windows(events: DataFrame, quiet: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n): bursts of a user's events that end after a quiet time."""
    rows = _watermarked(events, late)
    return rows.groupBy(F.session_window("ts", quiet).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def _upto(seconds: int) -> str:
    """A session's gap that events exactly so far apart don't end."""
    return f"{seconds} seconds 1 microseconds"


def debounce(events: DataFrame, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id): the last event of each burst of a user."""
    rows = _watermarked(events, late)
    last = rows.groupBy(F.session_window("ts", _upto(seconds)).alias("w"), "user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return last.select("user_id", "event_id")


def session_state(events: DataFrame, ttl: int = 7200, late: str = "1 hour") -> DataFrame:
    """(user_id, start, first_type, last_type, n): what a session with a time to live keeps: its first plan and last token. Idle ones are evicted by the watermark."""
    rows, at = _watermarked(events, late), F.struct("ts", "event_id")
    kept = rows.groupBy(F.session_window("ts", _upto(ttl)).alias("w"), "user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"), F.count(F.lit(1)).alias("n"))
    return kept.select("user_id", F.col("w.start").alias("start"), "first_type", "last_type", "n")


def coalesce_latest(events: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id): the newest pending request of each key."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# ---- folds: what happens to an event depends on all before it

NEVER = -(2**62)


def rate_limit(events: DataFrame, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id): events admitted when fewer than two were in the time before."""
    span = seconds * 1_000_000

    def step(held: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        t, event = row
        return ((held[1], t), [(event,)]) if t - held[0] >= span else (held, [])

    fold = Fold(step, lambda held: [], lambda held: held[1] + span, (NEVER, NEVER), "event_id long", "a long, b long", "event_id long")
    return folded(events.select("user_id", "ts", "event_id"), "user_id", fold, late)


def settle_bounded(events: DataFrame, quiet: int = 7200, most: int = 21600, late: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n, reason): bursts that end after a quiet time (quiet), or when they have lasted for `most` seconds
    (max), whichever comes first; start and stop, the first and last event, in microseconds. On a stream a timer ends a burst."""

    def step(held: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        begin, _, n = held
        return (begin if n else row[0], row[0], n + 1), []

    def by_quiet(held: tuple) -> int:
        return held[1] + quiet * 1_000_000

    def by_most(held: tuple) -> int:
        return held[0] + most * 1_000_000

    fold = Fold(step, lambda held: [(*held, "quiet" if by_quiet(held) <= by_most(held) else "max")], lambda held: min(by_quiet(held), by_most(held)), (0, 0, 0), "event_id long", "begin long, last long, n long", "start long, stop long, n long, reason string")
    return folded(events.select("user_id", "ts", "event_id"), "user_id", fold, late)


# How many steps of a plan a session keeps, and how many characters of each.
PLAN_STEPS, PLAN_CHARS = 8, 120


def session_plans(events: DataFrame, ttl: int = 7200, late: str = "1 hour") -> DataFrame:
    """(user_id, start, plan, token, n): what a session keeps: its first plan, cut to eight steps of 120 characters, and its last token.

    events: user_id, ts, event_id, plan (array of texts, or null), token (or null). A session that is idle for more than ttl
    seconds is evicted, on a stream by the watermark; what it held comes out then. start, its first event, in microseconds.
    """
    cut = F.transform(F.slice("plan", 1, PLAN_STEPS), lambda x: F.substring(x, 1, PLAN_CHARS))
    rows = _watermarked(timed(events), late).select("user_id", "ts", "event_id", F.when(F.size(cut) > 0, cut).alias("plan"), "token")
    at = F.struct("ts", "event_id", "plan", "token")
    kept = rows.groupBy(F.session_window("ts", _upto(ttl)).alias("w"), "user_id").agg(
        F.min_by("plan", F.when(F.col("plan").isNotNull(), at)).alias("plan"), F.max_by("token", F.when(F.col("token").isNotNull(), at)).alias("token"), F.count(F.lit(1)).alias("n")
    )
    return kept.select("user_id", micros("w.start").alias("start"), F.coalesce("plan", F.array().cast("array<string>")).alias("plan"), "token", "n")


def origin_state(detections: DataFrame, policy: DataFrame, k: int = 3, late: str = "1 hour") -> DataFrame:
    """(origin, what, seq): from which capture on an origin has shown an identity, and is linkable; each once.

    detections: origin, seq, category, confidence and, on a stream, ts, the time of the capture, which rises with seq. Captures may
    come in any order within the lateness. The state is the set of quasi-identifying categories, k at most, and two flags.
    """
    if not detections.isStreaming:
        seen = protect.identity_seen(detections, policy).select("origin", F.lit("identity").alias("what"), F.col("seq").cast("long").alias("seq"))
        return seen.unionByName(protect.linkability(detections, policy, k).select("origin", F.lit("linkable").alias("what"), F.col("seq").cast("long").alias("seq")))
    rows = detections.join(F.broadcast(policy.select("category", "class", "is_identity")), "category")  # policy: the fixed table
    identity, quasi = F.col("is_identity") & (F.col("confidence") >= 0.6), F.col("class") == "quasi"
    marked = rows.where(quasi | identity).select("origin", "ts", F.col("seq").cast("long").alias("seq"), "category", identity.alias("identity"), quasi.alias("quasi"))

    def step(held: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        known, named, linked = held
        _, seq, category, is_identity, is_quasi = row
        made = [] if named or not is_identity else [("identity", seq)]
        have = set(filter(None, known.split(",")))
        if is_quasi and not linked:
            have.add(category)
            if len(have) >= k:
                made.append(("linkable", seq))
                linked = True
        return (",".join(sorted(have)), named or is_identity, linked), made

    def thin(rows: list[tuple]) -> list[tuple]:
        """The first row of an origin of each kind: a later one names nothing new."""
        first: dict[tuple, tuple] = {}
        at = lambda row: (row[1], row[2] is not None, row[2])
        for row in rows:
            kind = (row[0], *row[3:])
            if kind not in first or at(row) < at(first[kind]):
                first[kind] = row
        return list(first.values())

    fold = Fold(step, lambda held: [], lambda held: None, ("", False, False), "seq long, category string, identity boolean, quasi boolean", "known string, named boolean, linked boolean", "what string, seq long", thin)
    return folded(marked, "origin", fold, late)
