"""Action logs, sessions and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec


def steps() -> WindowSpec:
    return Window.partitionBy("session").orderBy("step")


def so_far() -> WindowSpec:
    return steps().rowsBetween(Window.unboundedPreceding, 0)


def action_log(events: DataFrame) -> DataFrame:
    """(session, step, ts, action, fp, digest, verdict, code, ocr): events as the log of an agent's actions."""
    k = F.get_json_object("props", "$.k").cast("long")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("session"), step.alias("step"), "ts", F.col("event_type").alias("action"), k.alias("fp"), F.pmod(k, F.lit(3)).alias("digest"),
                         F.when(F.pmod("event_id", F.lit(3)) == 0, "pass").when(F.pmod("event_id", F.lit(7)) == 0, "retry").otherwise("fail").alias("verdict"), F.when(k % 25 == 0, "BUDGET_EXHAUSTED").alias("code"), (k % 5 == 0).alias("ocr"))


def detect_loops(log: DataFrame) -> DataFrame:
    """(session, step, code): LOOP_DETECTED at the third equal (action, fp, digest), NO_PROGRESS at the fourth step since a pass."""
    same = F.count(F.lit(1)).over(Window.partitionBy("session", "action", "fp", "digest").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    passes = F.sum((F.col("verdict") == "pass").cast("int")).over(so_far())
    counted = log.withColumns({"__same": same, "__group": passes})
    idle = F.sum((F.col("verdict") != "pass").cast("int")).over(Window.partitionBy("session", "__group").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    code = F.when(F.col("__same") >= 3, "LOOP_DETECTED").when((F.col("verdict") != "pass") & (F.col("__idle") >= 4), "NO_PROGRESS")
    return counted.withColumn("__idle", idle).withColumn("code", code).where("code is not null").select("session", "step", "code")


# Failures that no new plan mends.
TERMINAL = ("BUDGET_EXHAUSTED", "LOOP_DETECTED", "NO_PROGRESS")


def escalations(log: DataFrame, most: int = 2) -> DataFrame:
    """(session, step, next): each failure's next move: replan, or ask_user after more than `most` in a row or at a terminal code."""
    resets = F.sum((F.col("verdict") != "fail").cast("int")).over(so_far())
    failed = log.withColumn("__g", resets).where("verdict = 'fail'")
    nth = F.row_number().over(Window.partitionBy("session", "__g").orderBy("step"))
    return failed.withColumn("next", F.when(F.coalesce(F.col("code").isin(*TERMINAL), F.lit(False)) | (nth > most), "ask_user").otherwise("replan")).select("session", "step", "next")


def budget_breaches(log: DataFrame, most_steps: int = 25, seconds: int = 300, most_calls: int = 15) -> DataFrame:
    """(session, step, reason): the first step beyond the budget of steps, of calls (steps that reuse nothing) or of active time (gaps count one minute at most)."""
    gap = F.least(F.coalesce(F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(steps()).cast("timestamp")), F.lit(0)), F.lit(60))
    timed = log.withColumn("__gap", gap).withColumns({"__active": F.sum("__gap").over(so_far()), "__calls": F.sum((F.col("digest") != 1).cast("int")).over(so_far())})
    reason = F.when(F.col("step") >= most_steps, "steps").when(F.col("__calls") >= most_calls, "calls").when(F.col("__active") >= seconds, "time")
    hit = timed.withColumn("reason", reason).where("reason is not null")
    return hit.groupBy("session").agg(F.min("step").alias("step"), F.min_by("reason", "step").alias("reason"))


def transition_violations(states: DataFrame, allowed: DataFrame, ends: tuple[str, ...] = ()) -> DataFrame:
    """(session, step, was, now): moves that aren't edges of the graph `allowed` (was, now), and all that leave an end state; staying is no move."""
    moves = states.withColumn("was", F.lag("action").over(steps())).where("was <> action").select("session", "step", "was", F.col("action").alias("now"))
    allowed = allowed.where(~F.col("was").isin(*ends)) if ends else allowed
    # moves of a kind are counted before they are asked for: as many rows as there are kinds of moves, whatever the log's size
    wrong = moves.select("was", "now").distinct().join(allowed.select("was", "now").distinct(), ["was", "now"], "left_anti")
    return moves.join(wrong, ["was", "now"], "left_semi").select("session", "step", "was", "now")


def bounded_history(log: DataFrame, n: int = 25) -> DataFrame:
    """The last n steps of each session."""
    return log.withColumn("__r", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("step")))).where(F.col("__r") <= n).drop("__r")


def sensing_counters(log: DataFrame) -> DataFrame:
    """(session, steps, dom_only, reused, vision, ocr): how steps of a session sensed their page."""
    return log.groupBy("session").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.expr("digest = 0")).alias("dom_only"), F.count_if(F.expr("digest = 1")).alias("reused"), F.count_if(F.expr("digest = 2")).alias("vision"), F.count_if("ocr").alias("ocr"))


def expansion_budget(requests: DataFrame, most: int = 3, most_rows: int = 20) -> DataFrame:
    """(session, step, outcome, remaining, rows): requests for more context: invalid, granted while any remain, or exhausted; and how many of the rows asked for are given."""
    valid = F.sum(F.col("valid").cast("int")).over(so_far())
    used = requests.withColumn("__n", valid)
    outcome = F.when(~F.col("valid"), "invalid").when(F.col("__n") > most, "exhausted").otherwise("granted")
    return used.select("session", "step", outcome.alias("outcome"), F.greatest(F.lit(most) - F.col("__n"), F.lit(0)).alias("remaining"), F.when(outcome == "granted", F.least("asked", F.lit(most_rows))).otherwise(0).alias("rows"))


def captures(events: DataFrame) -> DataFrame:
    """(session, capture, keys, url, dialog, scroll, dhash): a user's week as a capture of a page: what is visible, and how it looks."""
    k, even, week = F.get_json_object("props", "$.k").cast("long"), F.col("user_id") % 2 == 0, F.date_trunc("week", F.col("ts"))
    rows = events.groupBy(F.col("user_id").alias("session"), week.alias("week")).agg(
        F.sort_array(F.collect_set(F.when(even, k % 4).otherwise(k))).alias("keys"), F.min_by("event_type", F.struct("ts", "event_id")).alias("url"), (F.count_if(F.col("event_type") == "signup") % 4 == 3).alias("dialog"),
        F.max("value").alias("scroll"), F.bit_or(F.expr("shiftleft(1L, int(event_id * 7 % 56))")).alias("dhash"),
    )
    return rows.withColumn("url", F.when(F.col("session") % 3 == 0, F.col("url")).otherwise("view")).withColumn("capture", F.row_number().over(Window.partitionBy("session").orderBy("week"))).drop("week")


def mutation_diff(caps: DataFrame) -> DataFrame:
    """(session, capture, added, removed): keys that came and went since the capture before."""
    before = F.lag("keys").over(Window.partitionBy("session").orderBy("capture"))
    pairs = caps.withColumn("__b", before).where("__b is not null")
    return pairs.select("session", "capture", F.size(F.array_except("keys", "__b")).alias("added"), F.size(F.array_except("__b", "keys")).alias("removed"))


def screen_changes(caps: DataFrame, mutations: int = 15, ratio: float = 0.25, height: float = 500.0, scrolled: float = 0.5, unsure: int = 5, bits: int = 10) -> DataFrame:
    """(session, capture, reason): NEW screens by their first matching reason, else same.

    url: another address; dialog: one came or went; mutations: so many keys came or went; ratio: such a share of those
    before; scroll: by such a share of the height; hash: some keys changed and the picture differs in more bits.
    """
    order = Window.partitionBy("session").orderBy("capture")
    pairs = caps.withColumns({f"__{c}": F.lag(c).over(order) for c in ("keys", "url", "dialog", "scroll", "dhash")}).where("__keys is not null")
    changed = F.size(F.array_except("keys", "__keys")) + F.size(F.array_except("__keys", "keys"))
    far = F.bit_count(F.col("dhash").bitwiseXOR(F.col("__dhash")))
    reason = (
        F.when(F.col("url") != F.col("__url"), "url").when(F.col("dialog") != F.col("__dialog"), "dialog").when(changed >= mutations, "mutations").when(changed / F.greatest(F.size("__keys"), F.lit(1)) >= ratio, "ratio")
        .when(F.abs(F.col("scroll") - F.col("__scroll")) / height >= scrolled, "scroll").when((changed >= unsure) & (far > bits), "hash").otherwise("same")
    )
    return pairs.select("session", "capture", reason.alias("reason"))


def difference_hash(vectors: DataFrame) -> DataFrame:
    """(vec_id, dhash): 56 bits, set where a value of an 8 x 8 grid is larger than its right neighbour."""
    places = [r * 8 + c for r in range(8) for c in range(7)]
    bits = F.aggregate(F.array(*map(F.lit, places)), F.lit(0).cast("long"), lambda a, p: a * 2 + (F.col("embedding")[p] > F.col("embedding")[p + 1]).cast("long"))
    return vectors.select("vec_id", bits.alias("dhash"))


def near_hashes(hashes: DataFrame, most: int = 5) -> DataFrame:
    """(a, b, distance): pairs of hashes that differ in at most `most` bits.

    56 bits fall into so few parts that a pair differs by at most two bits in one of them. Each hash asks for its
    parts as they are and with each bit and each pair of bits turned, so parts stay wide and few hashes share one;
    equal hashes are joined once. What is asked for is hundreds of rows a hash, for which Spark's estimate takes one: it
    streams past the hashes of a partition and is never broadcast.
    """
    parts = most // 3 + 1
    edges = [56 * i // parts for i in range(parts + 1)]
    widest = max(b - a for a, b in zip(edges[:-1], edges[1:], strict=True))
    turned = [0, *(1 << i for i in range(widest)), *(1 << i | 1 << j for i in range(widest) for j in range(i))]
    reps = hashes.groupBy("dhash").agg(F.min("vec_id").alias("rep"))
    bits = [F.shiftrightunsigned("dhash", edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1).cast("long")) for i in range(parts)]
    own = reps.select("rep", "dhash", F.posexplode(F.array(*bits)).alias("part", "bits"))
    other = own.select(F.col("rep").alias("b"), F.col("dhash").alias("__h"), "part", F.col("bits").alias("__bits"), F.explode(F.array(*[F.lit(t).cast("long") for t in turned])).alias("__t"))
    asked = other.select("b", "__h", "part", F.col("__bits").bitwiseXOR(F.col("__t")).alias("bits"))
    distance = F.bit_count(F.col("dhash").bitwiseXOR(F.col("__h")))
    pairs = asked.join(own.hint("shuffle_hash"), ["part", "bits"]).where("rep < b").where(distance <= most).select(F.col("rep").alias("a"), "b", distance.alias("distance")).distinct()
    copies = hashes.join(reps.hint("merge"), "dhash").where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"), F.lit(0).alias("distance"))
    return pairs.unionByName(copies)


def latest_state_check(plans: DataFrame, states: DataFrame) -> DataFrame:
    """(session, step, token, current, stale): each plan against the latest state before it (an as-of join).

    Plans and states are ordered together and the last state is carried along, which takes one shuffle.
    """
    both = plans.select("session", "ts", "step", "token", F.lit(None).cast("long").alias("state")).unionByName(states.select("session", "ts", "step", F.lit(None).cast("long").alias("token"), "state"))
    latest = F.last("state", ignorenulls=True).over(Window.partitionBy("session").orderBy("ts", "step").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("current", latest).where("token is not null").select("session", "step", "token", "current", F.coalesce(F.col("token") != F.col("current"), F.lit(True)).alias("stale"))


# Words that commit something, in two languages.
COMMITS = ("submit", "pay", "pay now", "place order", "confirm", "send", "delete", "remove", "transfer", "apply", "book", "register", "sign up", "upload", "proceed to pay", "checkout", "जमा करें", "भुगतान करें", "भेजें", "हटाएं", "पुष्टि करें", "आवेदन करें", "पंजीकरण करें")


def authority_level(actions: DataFrame) -> DataFrame:
    """(session, step, level, reason, requires_user); actions: action, label, in_form, category, class.

    L0 changes nothing, L1 leads elsewhere, L2 is local, L3 sensitive, L4 a credential, L5 commits.
    """
    padded = F.concat(F.lit(" "), F.lower("label"), F.lit(" "))
    commits = F.exists(F.array(*map(F.lit, COMMITS)), lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" "))))
    a = F.col("action")
    rules = (
        (a.isin("wait", "scroll", "done", "fail"), "L0", "NO_DIRECT_CHANGE", False), (a == "navigate", "L1", "NAVIGATE", False), ((a == "click") & commits, "L5", "COMMIT", True),
        (F.col("category") == "PASSWORD", "L4", "CREDENTIAL", True), (a.isin("type", "select") & F.col("class").isin("high", "never_automated"), "L3", "SENSITIVE_APPROVAL_REQUIRED", True),
        (a.isin("type", "select") & F.col("category").isNotNull(), "L3", "SENSITIVE_FIELD_OR_TOKEN", False), ((a == "click") & F.col("in_form"), "L5", "UNKNOWN_FORM_BUTTON", True),
    )
    level, reason, user = F.lit("L2"), F.lit("LOCAL_CONTROL"), F.lit(False)
    for on, lv, why, asks in reversed(rules):
        on = F.coalesce(on, F.lit(False))
        level, reason, user = F.when(on, lv).otherwise(level), F.when(on, why).otherwise(reason), F.when(on, asks).otherwise(user)
    return actions.select("session", "step", level.alias("level"), reason.alias("reason"), user.alias("requires_user"))


def unmet_requirements(placements: DataFrame, filled: DataFrame) -> DataFrame:
    """(session, token): required tokens without a field that they were placed in last and that still has a value.

    placements: session, step, field, token; filled: session, field.
    """
    newest = Window.partitionBy("session", "field").orderBy(F.desc("step"))
    last = placements.withColumn("__r", F.row_number().over(newest)).where("__r = 1").join(filled.withColumn("__f", F.lit(True)), ["session", "field"], "left")
    met = last.groupBy("session", "token").agg(F.bool_or(F.coalesce("__f", F.lit(False))).alias("met"))
    return placements.select("session", "token").distinct().join(met, ["session", "token"], "left").where("not coalesce(met, false)").select("session", "token")


def stable_captures(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(session, fp, step, outcome): the first clean attempt of the first few, else the last complete one, else a refusal; attempts: session, fp, step, clean, complete."""
    nth = F.row_number().over(Window.partitionBy("session", "fp").orderBy("step"))
    tried = attempts.withColumn("__n", nth).where(F.col("__n") <= most)
    rows = tried.groupBy("session", "fp").agg(F.min(F.when(F.col("clean"), F.col("step"))).alias("__c"), F.max(F.when(F.col("complete"), F.col("step"))).alias("__d"))
    return rows.select("session", "fp", F.coalesce("__c", "__d").alias("step"), F.when(F.col("__c").isNotNull(), "clean").when(F.col("__d").isNotNull(), "complete").otherwise("refused").alias("outcome"))


def check_actions(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """(session, step, fault): the first thing wrong with an action's target.

    actions: session, step, eid, fp, action, level, token_category; elements: session, eid, fp, visible, hittable, enabled, ambiguous, category,
    input_type. Ambiguous targets stop actions from level 3 on; some fields are never typed into by a machine; a
    token goes into a field of its own category alone, a password's into a password field.
    """
    of = ("fp", "visible", "hittable", "enabled", "ambiguous", "category", "input_type")
    joined = actions.join(elements.select("session", "eid", *[F.col(c).alias(f"__{c}") for c in of]), ["session", "eid"], "left")
    touches, types, token = F.col("action").isin("click", "type"), F.col("action") == "type", F.col("token_category")
    wrong = token.isNotNull() & ((F.coalesce("__category", F.lit("")) != token) | (token == "PASSWORD") & (F.coalesce("__input_type", F.lit("")) != "password"))
    fault = (
        F.when(F.col("__fp").isNull(), "missing").when(F.col("__fp") != F.col("fp"), "changed").when(F.col("__ambiguous") & (F.col("level") >= 3), "ambiguous").when(touches & ~F.col("__visible"), "not_visible")
        .when(touches & ~F.col("__hittable"), "not_hittable").when(touches & ~F.col("__enabled"), "disabled").when(types & F.coalesce(F.col("__category").isin("OTP", "CVV", "UPI_PIN", "SECRET"), F.lit(False)), "never_automated").when(types & wrong, "token_type")
    )
    return joined.select("session", "step", fault.alias("fault")).where("fault is not null")


def verify_expectations(claims: DataFrame, elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(session, step, verdict): whether what a claim expects holds: PASS, FAIL or UNVERIFIABLE if it states nothing.

    claims: session, step, action, eid, visible, enabled, has_value, text_present, url_path_prefix, each null where not stated; elements:
    session, eid, visible, enabled, has_value; pages: session, path, text. A `done` that rests on a prefix of every path alone fails.
    """
    now = elements.select("session", "eid", *[F.col(c).alias(f"__{c}") for c in ("visible", "enabled", "has_value")])
    joined = claims.join(now, ["session", "eid"], "left").join(pages.select("session", F.col("path").alias("__path"), F.lower("text").alias("__text")), "session", "left")
    holds = [F.when(F.col(c).isNotNull(), F.coalesce(f"__{c}", F.lit(False)) == F.col(c)) for c in ("visible", "enabled", "has_value")]
    holds += [F.when(F.col("text_present").isNotNull(), F.coalesce(F.contains("__text", F.lower("text_present")), F.lit(False)))]
    holds += [F.when(F.col("url_path_prefix").isNotNull(), F.coalesce(F.startswith("__path", "url_path_prefix"), F.lit(False)))]
    stated = F.array_compact(F.array(*holds))
    empty = F.coalesce(F.col("url_path_prefix").isin("", "/"), F.lit(False)) & (F.size(stated) == 1)
    verdict = F.when(F.size(stated) == 0, "UNVERIFIABLE").when(~F.forall(stated, lambda x: x), "FAIL").when((F.col("action") == "done") & empty, "FAIL").otherwise("PASS")
    return joined.select("session", "step", verdict.alias("verdict"))


def check_plans(plans: DataFrame, most: int = 5) -> DataFrame:
    """(session, step, fault): the first thing wrong with a plan.

    plans: session, step, variants (how many of plan, answer, extract and request it has), stale, has_steps, n_actions, url, value, key,
    action. Steps are named once a session; tokens stay out of addresses, values and keys; addresses are http or https.
    """
    token = r"\[\[PII:[A-Z_]+:[a-z2-7]{8}\]\]"
    seen = F.coalesce(F.max(F.col("has_steps").cast("int")).over(steps().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    held = lambda c: F.coalesce(F.col(c).rlike(token), F.lit(False))
    bad_scheme = (F.col("action") == "navigate") & ~F.coalesce(F.lower("url").rlike("^https?://[^/]"), F.lit(False))
    faults = ((F.col("variants") != 1, "INVALID_SCHEMA"), (F.col("n_actions") > most, "INVALID_SCHEMA"), (F.col("stale"), "STALE_PLAN"), (F.col("has_steps") & seen, "PLAN_STEPS_REPEATED"), (held("url"), "TOKEN_IN_URL"), (held("value"), "TOKEN_OUTSIDE_TYPE"), (held("key"), "TOKEN_IN_KEY"), (bad_scheme, "UNSUPPORTED_URL"))
    fault = F.lit(None).cast("string")
    for on, name in reversed(faults):
        fault = F.when(on, name).otherwise(fault)
    return plans.select("session", "step", fault.alias("fault")).where("fault is not null")
