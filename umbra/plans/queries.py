"""One query for each operator over the given tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from umbra.functions import rules as R
from umbra.operators import actions as A, audit as L, corpus as G, detect as D, evaluate as E, evidence as V, pages as H, protect as P
from umbra.sources import tables as S
from umbra.sources.tables import stored, table, to_units, units
from umbra.streaming import streams as T

#: The key of pseudonyms comes from the session's configuration; this one is for tests, whose SQL must know it.
KEY = "pseudonym key of the tests"
KEY_SETTING = "spark.umbra.pseudonym.key"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function as a query under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _markup_sql(x: str) -> str:
    x = f"regexp_replace({x}, {quoted(S.TAG)}, '', 'g')"
    for entity, character in S.ENTITIES:
        x = f"replace({x}, {quoted(entity)}, {quoted(character)})"
    return rf"trim(regexp_replace({x}, '[\x20\x09-\x0D]+', ' ', 'g'))"


UNITS = rf"""page_lines AS (SELECT page_id, url, html, unnest(string_split(regexp_replace(regexp_replace(html, {quoted(S.UNSEEN)}, ' ', 'g'), {quoted(S.BREAKS)}, chr(1), 'g'), chr(1))) AS line, generate_subscripts(string_split(regexp_replace(regexp_replace(html, {quoted(S.UNSEEN)}, ' ', 'g'), {quoted(S.BREAKS)}, chr(1), 'g'), chr(1)), 1) AS i FROM pages),
page_blocks AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) AS seq, text FROM (SELECT page_id, url, i, {_markup_sql('line')} AS text FROM page_lines) WHERE text <> ''),
page_texts AS (SELECT * FROM page_blocks UNION ALL SELECT page_id, url, 0, text FROM (SELECT page_id, url, {_markup_sql(f"regexp_extract(html, {quoted(S.TITLE)}, 1)")} AS text FROM pages) WHERE text <> ''),
units AS (
  SELECT 'doc:' || doc_id AS unit_id, source AS origin, 'text_span' AS target_kind, 0 AS seq, text FROM documents
  UNION ALL SELECT 'conv:' || conv_id || ':' || turn, 'conv:' || conv_id, 'text_span', turn, text FROM conversations
  UNION ALL SELECT 'url:' || page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), 'side_channel', 0, url FROM pages
  UNION ALL SELECT 'page:' || page_id || ':' || seq, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), CASE WHEN seq = 0 THEN 'title' ELSE 'block' END, seq, text FROM page_texts)"""


@query(f"WITH {UNITS} SELECT unit_id, origin, target_kind, seq, text FROM units")
def s2_to_units(spark, sf):
    return to_units(table(spark, sf, "documents"), table(spark, sf, "conversations"), table(spark, sf, "pages"))


# ---- detection

DIGITS = "regexp_replace(v, '[ -]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({DIGITS}, -i, 1)::INT WHEN substr({DIGITS}, -i, 1)::INT > 4 THEN substr({DIGITS}, -i, 1)::INT * 2 - 9 ELSE substr({DIGITS}, -i, 1)::INT * 2 END)) % 10 = 0"
VERHOEFF = f"list_reduce(list_prepend(0, list_transform(range(1, length({DIGITS}) + 1), lambda i: ((i - 1) % 8)::INT * 10 + substr({DIGITS}, -i, 1)::INT)), lambda c, x: substr('{R.VERHOEFF_D}', c * 10 + substr('{R.VERHOEFF_P}', x + 1, 1)::INT + 1, 1)::INT) = 0"
CHECK = {
    "": "TRUE", "verhoeff": VERHOEFF, "digit": "regexp_matches(v, '[0-9]')", "letter_digit": "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')",
    "card": f"length({DIGITS}) BETWEEN 13 AND 19 AND regexp_matches({DIGITS}, {quoted(R.CARD_PREFIX)}) AND {LUHN}", "upi": "nxt <> '.'", "not_bh": "NOT contains(upper(v), 'BH')",
}


def scan_sql(source: str, rules: tuple[R.Rule, ...] = R.RULES) -> str:
    parts = []
    for r in rules:
        conf = f"CASE WHEN lower(split_part(v, '@', -1)) IN ({', '.join(map(quoted, R.UPI_HANDLES))}) THEN 0.9 ELSE 0.55 END" if r.check == "upi" else str(r.confidence)
        where = f"regexp_matches(text, {quoted(r.pattern)})" + (f" AND context = '{r.context}'" if r.context else "")
        parts.append(f"""SELECT unit_id, origin, '{r.name}' AS rule, '{r.category}' AS category, s AS span_start, s + length(v) AS span_end, v AS value, CAST({conf} AS DOUBLE) AS confidence
  FROM (SELECT unit_id, origin, p[i] AS v, length(array_to_string(p[1:i - 1], '')) AS s, substr(p[i + 1], 1, 1) AS nxt
    FROM (SELECT unit_id, origin, p, unnest(range(2, len(p), 2)) AS i
      FROM (SELECT unit_id, origin, string_split(regexp_replace(translate(text, chr(1) || chr(2), '  '), {quoted("(" + r.pattern + ")")}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM {source} WHERE {where}))) WHERE {CHECK[r.check]}""")
    return "\n  UNION ALL ".join(parts)


DET = f"{UNITS}, det AS ({scan_sql('units')})"


def detections(spark, sf):
    """All spans, found once and stored: they are few, and most queries use them several times."""
    return stored(D.scan(units(spark, sf)))


@query(f"WITH {DET} SELECT * FROM det")
def d1_scan_rules(spark, sf):
    return D.scan(units(spark, sf))


CONTEXTS = ("BANK_ACCOUNT", "OTP", "PIN_CODE", "ORDER_ID", "FINANCIAL_VALUE", "DATE", "DOB", "VOTER_ID", "PASSPORT", "UAN", "TRACKING_ID", "ABHA", "DRIVING_LICENCE")
CONTEXT_UNITS = f"""ctx AS (
  SELECT 'ord:' || o_orderkey AS unit_id, o_orderpriority AS origin, ([{', '.join(map(quoted, CONTEXTS))}])[(o_orderkey % {len(CONTEXTS)} + 1)::INT] AS context,
         'ref ' || (o_orderkey * 7919 + 100000) || ', due 12/05/' || (1990 + o_orderkey % 30) || ' or 3 Mar 2019, INR ' || o_orderkey || ', ABC' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') || ' and ' || (o_orderkey * 104729 + 100000000000) || ' or 12-3456-7890-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '.' AS text FROM orders)"""


def context_units(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("ref "), k * 7919 + 100000, F.lit(", due 12/05/"), 1990 + k % 30, F.lit(" or 3 Mar 2019, INR "), k, F.lit(", ABC"), F.lpad((k % 10000000).cast("string"), 7, "0"), F.lit(" and "), k * 104729 + 100000000000, F.lit(" or 12-3456-7890-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("."))
    context = F.element_at(F.array(*map(F.lit, CONTEXTS)), (k % len(CONTEXTS) + 1).cast("int"))
    return table(spark, sf, "orders").select(F.concat(F.lit("ord:"), k).alias("unit_id"), F.col("o_orderpriority").alias("origin"), context.alias("context"), text.alias("text"))


@query(f"""WITH {CONTEXT_UNITS}, dob AS (SELECT unit_id, origin, 'DATE' AS context, text FROM ctx WHERE context = 'DOB')
  SELECT * FROM ({scan_sql('ctx', R.CONTEXT_RULES)}) UNION ALL SELECT * REPLACE ('DOB' AS category) FROM ({scan_sql('dob', tuple(r for r in R.CONTEXT_RULES if r.name == 'date'))})""")
def d2_scan_context_rules(spark, sf):
    return D.scan_context_rules(context_units(spark, sf))


LABELS = "labels_d(category, phrase, phrase_len, is_generic, is_override, ord) AS (VALUES " + ", ".join(f"({quoted(c)}, {quoted(p)}, {n}, {g}, {o}, {i})" for c, p, n, g, o, i in R.label_rows()) + ")"
N_LABELS = len(R.label_rows())
PLAIN = r"""trim(regexp_replace(regexp_replace(lower({x}), '[.,;:!?''"()\[\]{{}}/\\_-]', ' ', 'g'), '\s+', ' ', 'g'))"""
LABELLED = "labelled AS (SELECT 'cust:' || c_custkey AS unit_id, c_nationkey AS origin, c_custkey AS seq, phrase || CASE WHEN c_custkey % 3 = 0 THEN ' Number' WHEN c_custkey % 3 = 1 THEN '-Name' ELSE '' END AS label, c_name AS name FROM customer JOIN labels_d ON ord = c_custkey % " + str(N_LABELS) + ")"


def label_match_sql(source: str) -> str:
    x = PLAIN.format(x="text")
    return f"""(SELECT unit_id, category, phrase, phrase_len, row_number() OVER (PARTITION BY unit_id ORDER BY is_generic, phrase_len DESC, is_override DESC, ord) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, category ORDER BY is_generic, phrase_len DESC, is_override DESC, ord) AS r
    FROM (SELECT unit_id, ' ' || {x} || ' ' AS label FROM {source}) JOIN labels_d ON CASE WHEN regexp_matches(phrase, '^[a-z0-9 ]+$') THEN contains(label, ' ' || phrase || ' ') ELSE contains(label, phrase) END) WHERE r = 1)"""


def labelled(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").join(F.broadcast(R.load_labels(spark).select("phrase", "ord")), F.col("ord") == k % N_LABELS)
    tail = F.when(k % 3 == 0, " Number").when(k % 3 == 1, "-Name").otherwise("")
    return rows.select(F.concat(F.lit("cust:"), k).alias("unit_id"), F.col("c_nationkey").alias("origin"), k.alias("seq"), F.concat("phrase", tail).alias("label"), F.col("c_name").alias("name"))


@query(f"WITH {LABELS}, {LABELLED}, t AS (SELECT unit_id, label AS text FROM labelled) SELECT * FROM {label_match_sql('t')}")
def d3_match_labels(spark, sf):
    return D.match_labels(labelled(spark, sf).withColumnRenamed("label", "text"), R.load_labels(spark))


@query(f"""WITH {LABELS}, {LABELLED}, t AS (SELECT unit_id, label AS text, name AS value FROM labelled WHERE length(label) BETWEEN 2 AND 40)
  SELECT unit_id, category, text AS label, value FROM {label_match_sql('t')} JOIN t USING (unit_id) WHERE rank = 1""")
def d5_bind_leading_key(spark, sf):
    return D.bind_leading_key(labelled(spark, sf).select("unit_id", F.concat("label", F.lit(": "), "name").alias("text")), R.load_labels(spark))


@query(f"""WITH {LABELS}, {LABELLED}, b AS (SELECT *, lag(label) OVER (PARTITION BY origin ORDER BY seq) AS text, lag(seq % 2) OVER (PARTITION BY origin ORDER BY seq) AS was FROM labelled),
  t AS (SELECT unit_id, text FROM b WHERE seq % 2 = 1 AND was = 0) SELECT unit_id, category AS context FROM {label_match_sql('t')} WHERE rank = 1""")
def d6_pair_adjacent_labels(spark, sf):
    blocks = labelled(spark, sf).select("unit_id", "origin", "seq", F.when(F.col("seq") % 2 == 0, "term").otherwise("definition").alias("role"), F.col("label").alias("text"))
    return D.pair_adjacent_labels(blocks, R.load_labels(spark))


SHAPES = f"shapes AS (SELECT * FROM ({scan_sql('units', R.SHAPES)}) AS x(unit_id, origin, rule, category, span_start, span_end, v, confidence) WHERE NOT (rule = 'digits_12' AND {VERHOEFF}) AND NOT (rule = 'digits_9_18' AND {LUHN}))"


@query(f"WITH {UNITS}, {SHAPES} SELECT unit_id, origin, rule, category, span_start, span_end, v AS value, confidence FROM shapes")
def d13_find_shapes(spark, sf):
    return D.find_shapes(units(spark, sf))


@query(rf"""WITH {UNITS}, {SHAPES}, k AS (SELECT *, lower(regexp_replace(v, '\s', '', 'g')) AS n FROM shapes)
  SELECT k.unit_id, k.origin, k.rule, k.category, k.span_start, k.span_end, k.v AS value, k.confidence, c.n_targets FROM k JOIN (SELECT origin, n, count(DISTINCT unit_id) AS n_targets FROM k GROUP BY origin, n) c ON c.origin = k.origin AND c.n = k.n""")
def d14_repeat_index(spark, sf):
    return D.repeat_index(D.find_shapes(units(spark, sf)))


POLICY = "policy(category, class, risk_rank, locked, is_identity, needed, not_needed, cond_then, cond_else) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if not isinstance(x, str) else quoted(x) for x in r) + ")" for r in R.policy_rows()) + ")"
MERGED = f"""{DET}, {POLICY}, ranked AS (SELECT d.*, coalesce(risk_rank, 99) AS risk_rank FROM det d LEFT JOIN policy USING (category)),
reach AS (SELECT *, max(span_end) OVER (PARTITION BY unit_id ORDER BY span_start, span_end, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranked),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR span_start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY span_start, span_end, rule) AS island FROM reach),
merged AS (SELECT unit_id, origin, min(span_start) AS span_start, max(span_end) AS span_end, arg_min(category, (confidence < 0.6, category <> 'SECRET', risk_rank, span_start, rule)) AS category,
  round(1 - product(1 - confidence), 6) AS confidence, CASE WHEN max(confidence) >= 0.6 THEN 'detected' ELSE 'uncertain' END AS certainty, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules,
  CASE WHEN max(span_end - span_start) = max(span_end) - min(span_start) THEN arg_max(value, span_end - span_start) END AS value FROM islands GROUP BY unit_id, origin, island)"""


def merged(spark, sf, found=None):
    return D.merge_spans(detections(spark, sf) if found is None else found, R.load_policy(spark))


@query(f"WITH {MERGED} SELECT * FROM merged")
def d18_merge_spans(spark, sf):
    return merged(spark, sf)


@query(f"WITH {DET} SELECT category, count(*) AS n, count(DISTINCT unit_id) AS n_units, count(*) FILTER (confidence >= 0.6) AS n_certain FROM det GROUP BY category")
def d20_detection_stats(spark, sf):
    return D.detection_stats(detections(spark, sf))


@query(f"WITH {DET}, {POLICY} SELECT category, class, risk_rank, locked, needed, not_needed, count(*) AS n FROM det JOIN policy USING (category) GROUP BY ALL")
def s3_load_policy(spark, sf):
    """The policy of what was detected."""
    return detections(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(R.load_policy(spark)), "category").select("category", "class", "risk_rank", "locked", "needed", "not_needed", "n")


@query(f"WITH {LABELS}, {LABELLED} SELECT category, phrase, is_generic, is_override, count(*) AS n FROM labels_d JOIN labelled ON contains(label, phrase) GROUP BY ALL")
def s4_load_labels(spark, sf):
    """The dictionary's phrases in the labels of customers."""
    fields = labelled(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("k"))  # a few hundred labels
    return fields.join(F.broadcast(R.load_labels(spark)), F.contains("label", "phrase")).groupBy("category", "phrase", "is_generic", "is_override").agg(F.sum("k").alias("n"))


# ---- protection

ORDERED = f"""{MERGED}, ordered AS (SELECT *, regexp_extract(unit_id, '[0-9]+', 0)::BIGINT AS seq, 'rule' AS source, category IN ('EMAIL', 'PHONE') AS needed_by_task FROM merged),
firsts AS (SELECT origin, o.category, min(seq) AS seq, bool_or(is_identity AND confidence >= 0.6) AS identity, min(CASE WHEN is_identity AND confidence >= 0.6 THEN seq END) AS id_seq, any_value(class) AS class FROM ordered o JOIN policy USING (category) GROUP BY origin, o.category),
ident AS (SELECT origin, min(id_seq) AS seq FROM firsts WHERE identity GROUP BY origin),
linked AS (SELECT origin, seq FROM (SELECT origin, seq, row_number() OVER (PARTITION BY origin ORDER BY seq, category) AS n FROM firsts WHERE class = 'quasi') WHERE n = 3),
based AS (SELECT o.*, coalesce(class, 'non_pii') AS class, cond_then, cond_else, coalesce(i.seq <= o.seq, FALSE) OR coalesce(l.seq <= o.seq, FALSE) AS together,
  coalesce(CASE WHEN needed_by_task AND certainty <> 'uncertain' THEN needed ELSE not_needed END, 'ALLOW') AS base FROM ordered o LEFT JOIN policy p USING (category) LEFT JOIN ident i ON i.origin = o.origin LEFT JOIN linked l ON l.origin = o.origin),
resolved AS (SELECT *, CASE WHEN base <> 'TOKEN_IF_IDENTITY_PRESENT' THEN base WHEN together THEN cond_then ELSE cond_else END AS r FROM based),
decided AS (SELECT unit_id, origin, span_start, span_end, category, confidence, rules, value, seq, class, CASE WHEN certainty = 'uncertain' AND r IN ('TOKEN', 'TOKEN_WITH_APPROVAL', 'ALLOW') THEN 'FILL' ELSE r END AS action FROM resolved)"""


def ordered(spark, sf, found=None):
    return merged(spark, sf, found).withColumns({"seq": F.regexp_extract("unit_id", "[0-9]+", 0).cast("long"), "source": F.lit("rule"), "needed_by_task": F.col("category").isin("EMAIL", "PHONE")})


def decided(spark, sf, found=None):
    return P.decide(ordered(spark, sf, found), R.load_policy(spark)).select("unit_id", "origin", "span_start", "span_end", "category", "confidence", "rules", "value", "seq", "class", "action")


@query(f"WITH {ORDERED} SELECT * FROM decided")
def p1_decide(spark, sf):
    return decided(spark, sf)


@query(f"WITH {ORDERED} SELECT origin, seq FROM ident")
def p3_identity_seen(spark, sf):
    return P.identity_seen(ordered(spark, sf), R.load_policy(spark))


QUASI = f"""{CONTEXT_UNITS}, {POLICY}, spans AS (SELECT unit_id, origin, regexp_extract(unit_id, '[0-9]+', 0)::BIGINT AS seq, category, rule, span_start, confidence FROM ({scan_sql('ctx', R.CONTEXT_RULES)})),
firsts AS (SELECT origin, category, min(seq) AS seq FROM spans JOIN policy USING (category) WHERE class = 'quasi' GROUP BY ALL),
linked AS (SELECT origin, seq FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq, category) AS n FROM firsts) WHERE n = 3)"""


def quasi(spark, sf):
    """Labelled spans of orders: dates, order ids and such, which identify together."""
    spans = D.scan(context_units(spark, sf), R.CONTEXT_RULES).withColumn("seq", F.regexp_extract("unit_id", "[0-9]+", 0).cast("long"))
    return spans.withColumns({"source": F.lit("rule"), "certainty": F.lit("detected"), "needed_by_task": F.lit(False)})


@query(f"WITH {QUASI} SELECT origin, seq FROM linked")
def p4_linkability(spark, sf):
    return P.linkability(quasi(spark, sf), R.load_policy(spark))


def normal_sql(c: str, v: str) -> str:
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    phone = f"CASE WHEN starts_with({digits}, '91') AND length({digits}) > 10 THEN right({digits}, 10) ELSE {digits} END"
    return rf"""CASE WHEN {c} = 'EMAIL' THEN lower(trim({v})) WHEN {c} = 'PHONE' THEN right(regexp_replace({phone}, '^0', ''), 10) WHEN {c} IN ('AADHAAR', 'CARD_NUMBER', 'BANK_ACCOUNT') THEN {digits}
  WHEN {c} IN ('PAN', 'IFSC', 'VEHICLE_REG') THEN upper(regexp_replace({v}, '\s', '', 'g')) WHEN {c} IN ('NAME', 'ADDRESS', 'CITY', 'EMPLOYER') THEN lower(regexp_replace(trim({v}), '\s+', ' ', 'g')) ELSE trim({v}) END"""


@query(f"WITH {DET} SELECT unit_id, span_start, rule, {normal_sql('category', 'value')} AS normalized FROM det")
def p5_normalize_value(spark, sf):
    return detections(spark, sf).select("unit_id", "span_start", "rule", P.normalize_value(F.col("category"), F.col("value")).alias("normalized"))


def _hmac_sql(message: str) -> str:
    block = KEY.encode().ljust(64, b"\0")
    pad = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in block) + "'::BLOB"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


VAULT = f"""vals AS (SELECT category, {normal_sql('category', 'value')} AS normalized, list_sort(list_distinct(list(origin))) AS origins FROM det WHERE confidence >= 0.6 AND category NOT IN ('PASSWORD', 'OTP', 'CVV', 'UPI_PIN', 'SECRET') GROUP BY ALL),
hashed AS (SELECT *, ('0x' || substr({_hmac_sql("category || chr(0) || normalized")}, 1, 10))::BIGINT AS n FROM vals),
vault AS (SELECT category, normalized, origins, '[[PII:' || category || ':' || array_to_string(list_transform(range(8), lambda i: substr('{P.BASE32}', ((n >> (35 - 5 * i)) & 31)::INT + 1, 1)), '') || ']]' AS token FROM hashed)"""
VAULT = VAULT.replace("GROUP BY ALL", "GROUP BY 1, 2")


def key_of(spark):
    return spark.conf.get(KEY_SETTING, KEY)


def vault(spark, sf):
    return P.tokenize(detections(spark, sf), key_of(spark))


@query(f"WITH {DET}, {VAULT} SELECT category, normalized, token, array_to_string(origins, ',') AS origins FROM vault")
def p6_tokenize(spark, sf):
    return vault(spark, sf).withColumn("origins", F.array_join("origins", ","))


def redacted_sql(name: str, spans: str) -> str:
    """Text with spans replaced by the vault's token where the decision is one, else by the category."""
    return f"""{name} AS (
  SELECT u.unit_id, u.origin, u.seq, u.text, count(d.unit_id) AS n_redacted,
    coalesce(string_agg(substr(u.text, d.prev + 1, d.span_start - d.prev) || d.rep, '' ORDER BY d.span_start), '') || substr(u.text, coalesce(max(d.span_end), 0) + 1) AS text_redacted
  FROM units u LEFT JOIN (SELECT s.*, lag(span_end, 1, 0) OVER (PARTITION BY unit_id ORDER BY span_start) AS prev,
      coalesce(CASE WHEN action IN ('TOKEN', 'TOKEN_WITH_APPROVAL') THEN token END, '[REDACTED:' || s.category || ']') AS rep
    FROM {spans} s LEFT JOIN vault v ON v.category = s.category AND v.normalized = {normal_sql('s.category', 's.value')} WHERE action <> 'ALLOW') d ON d.unit_id = u.unit_id GROUP BY u.unit_id, u.origin, u.seq, u.text)"""


REDACTED = f"{ORDERED}, {VAULT}, {redacted_sql('red', 'decided')}"
#: Redactions with planted faults: every fifth document, page or conversation is left as it was.
FAULTY = f"{ORDERED}, {VAULT}, applied AS (SELECT * FROM decided WHERE seq % 5 <> 0), {redacted_sql('red', 'applied')}"


def replaced(spans, held):
    """spans with the replacement that the decision asks for; held: the vault."""
    normal = P.normalize_value(F.col("category"), F.col("value"))
    joined = spans.withColumn("normalized", normal).join(held.select("category", "normalized", "token"), ["category", "normalized"], "left")
    token = F.when(F.col("action").isin("TOKEN", "TOKEN_WITH_APPROVAL"), F.col("token"))
    return joined.where("action <> 'ALLOW'").select("unit_id", "span_start", "span_end", F.coalesce(token, F.concat(F.lit("[REDACTED:"), "category", F.lit("]"))).alias("replacement"))


def redacted(spark, sf, found=None, spans=None):
    found = detections(spark, sf) if found is None else found
    spans = decided(spark, sf, found) if spans is None else spans
    return P.redact_spans(units(spark, sf).select("unit_id", "origin", "seq", "text"), replaced(spans, P.tokenize(found, key_of(spark))))


@query(f"WITH {REDACTED} SELECT unit_id, n_redacted, text_redacted FROM red")
def p9_redact_spans(spark, sf):
    return redacted(spark, sf).select("unit_id", "n_redacted", "text_redacted")


@query(r"""WITH b AS (SELECT page_id, regexp_extract(url, '^([a-z][a-z0-9+.-]*://[^/?#\s]+)([^?#\s]*)', 1) AS base, regexp_extract(url, '^([a-z][a-z0-9+.-]*://[^/?#\s]+)([^?#\s]*)', 2) AS path FROM pages)
  SELECT page_id, CASE WHEN base = '' THEN '' ELSE base || array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]{3,}$') OR regexp_matches(s, '^[0-9a-f]{8,}$')
    OR regexp_matches(s, '^[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*$') AND length(s) >= 8 THEN ':id' ELSE s END), '/') END AS url FROM b""")
def p11_sanitize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.sanitize_url(F.col("url")).alias("url"))


@query(f"WITH {DET} SELECT unit_id, span_start, rule, CASE WHEN category IN ('PASSWORD', 'OTP', 'CVV', 'UPI_PIN', 'SECRET') THEN NULL WHEN length(value) = 0 THEN 'empty' WHEN length(value) <= 16 THEN 'short' WHEN length(value) <= 64 THEN 'medium' ELSE 'long' END AS bucket FROM det")
def p13_length_bucket(spark, sf):
    return detections(spark, sf).select("unit_id", "span_start", "rule", P.length_bucket(F.col("value"), F.col("category")).alias("bucket"))


@query("""WITH RECURSIVE c AS (SELECT 'conv:' || conv_id AS origin, 'conv:' || conv_id || ':' || turn AS unit_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, 'conv:' || conv_id || ':' || turn) AS r FROM conversations),
  f AS (SELECT origin, unit_id, r, CASE WHEN n <= 1500 THEN n ELSE 0 END AS used, n <= 1500 AS kept FROM c WHERE r = 1
    UNION ALL SELECT c.origin, c.unit_id, c.r, CASE WHEN f.used + c.n <= 1500 THEN f.used + c.n ELSE f.used END, f.used + c.n <= 1500 FROM f JOIN c ON c.origin = f.origin AND c.r = f.r + 1)
  SELECT origin, unit_id FROM f WHERE kept""")
def p15_text_budget(spark, sf):
    return P.text_budget(units(spark, sf).where("unit_id like 'conv:%'"), 1500)


@query(f"""WITH {ORDERED} SELECT origin, coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (class IN ('medium', 'quasi')), '') AS ordinary,
  coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (class = 'high'), '') AS high, bool_or(class IN ('credential', 'never_automated')) AS credential FROM decided GROUP BY origin""")
def p17_consent_summary(spark, sf):
    return P.consent_summary(decided(spark, sf))


@query(f"WITH {ORDERED} SELECT category, rule, count(*) AS n FROM (SELECT category, unnest(string_split(rules, ',')) AS rule FROM decided WHERE action <> 'ALLOW') GROUP BY category, rule")
def p18_privacy_receipt(spark, sf):
    return P.privacy_receipt(decided(spark, sf))


# ---- leak audit

TOKEN_SQL = P.TOKEN.replace("'", "''")
RESCAN = f"""{FAULTY}, bare AS (SELECT unit_id, origin, regexp_replace(text_redacted, '{TOKEN_SQL}', ' ', 'g') AS text FROM red), again AS ({scan_sql('bare')}),
leaks AS (SELECT unit_id, category, count(*) AS n FROM again WHERE (unit_id, category) NOT IN (SELECT (unit_id, category) FROM decided WHERE action = 'ALLOW') GROUP BY unit_id, category)"""


def rescanned(out, spans):
    return L.rescan_rules(out, spans.where("action = 'ALLOW'").select("unit_id", "category"))


def faulty(spark, sf):
    """(redacted units of which every fifth kept all it had: what the audit must find, the decided spans, the vault)."""
    found = detections(spark, sf)
    spans = stored(decided(spark, sf, found))
    out = redacted(spark, sf, found, spans.where("seq % 5 <> 0"))
    return stored(out.select("unit_id", "origin", F.col("text_redacted").alias("text"))), spans, P.tokenize(found, key_of(spark))


@query(f"WITH {RESCAN} SELECT * FROM leaks")
def l3_rescan_rules(spark, sf):
    out, spans, _ = faulty(spark, sf)
    return rescanned(out, spans)


def known_values(found):
    """(category, normalized, value) of the detections that may have a token."""
    normal = P.normalize_value(F.col("category"), F.col("value"))
    return found.where(~F.col("category").isin(*P.NEVER_TOKENS)).select("category", normal.alias("normalized"), "value").distinct()


LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
KNOWN = f"""known AS (SELECT DISTINCT category, {normal_sql('category', 'value')} AS normalized, value FROM hidden WHERE value IS NOT NULL AND category NOT IN ({', '.join(map(quoted, P.NEVER_TOKENS))})),
forms AS (SELECT DISTINCT category, normalized, {LOW.format('form')} AS form, regexp_replace(form, '[^0-9]', '', 'g') AS digits FROM (SELECT category, normalized, unnest([normalized, value]) AS form FROM known) WHERE form IS NOT NULL),
bared AS (SELECT unit_id, {LOW.format('text')} AS low, regexp_replace(regexp_replace(text, '{TOKEN_SQL}', ' ', 'g'), '[^0-9]', '', 'g') AS digits FROM outgoing),
known_leaks AS (SELECT DISTINCT b.unit_id, f.category, f.normalized FROM bared b JOIN forms f ON length(f.form) >= {L.MIN_CHARS} AND contains(b.low, f.form) OR length(f.digits) >= {L.MIN_DIGITS} AND contains(b.digits, f.digits))"""
HIDDEN = "hidden AS (SELECT * FROM decided WHERE action <> 'ALLOW'), outgoing AS (SELECT unit_id, text_redacted AS text FROM red)"


@query(f"WITH {FAULTY}, {HIDDEN}, {KNOWN} SELECT * FROM known_leaks")
def l4_known_value_leaks(spark, sf):
    out, spans, _ = faulty(spark, sf)
    return L.known_value_leaks(out, known_values(spans.where("action <> 'ALLOW' and value is not null")))


def token_texts(spark, sf):
    """Texts that carry one token each; those of even length have theirs altered by one letter of its alphabet, every fifth one only looks like one."""
    turned = F.concat(F.expr("substring(token, 1, length(token) - 10)"), F.translate(F.expr("substring(token, length(token) - 9, 8)"), P.BASE32, P.BASE32[1:] + P.BASE32[:1]), F.lit("]]"))
    like = F.concat(F.lit("[ [pii: "), F.expr("substring(token, 7)"))
    text = F.concat(F.lit("send "), F.when(F.length("normalized") % 5 == 0, like).when(F.length("normalized") % 2 == 0, turned).otherwise(F.col("token")), F.lit(" now"))
    return vault(spark, sf).select(F.concat("category", F.lit("/"), "normalized").alias("unit_id"), text.alias("text"))


@query(rf"""WITH {DET}, {VAULT}, t AS (SELECT category || '/' || normalized AS unit_id, 'send ' || CASE WHEN length(normalized) % 5 = 0 THEN '[ [pii: ' || substr(token, 7) WHEN length(normalized) % 2 = 0 THEN left(token, length(token) - 10) || translate(substr(token, length(token) - 9, 8), '{P.BASE32}', '{P.BASE32[1:] + P.BASE32[:1]}') || ']]' ELSE token END || ' now' AS text FROM vault)
  SELECT DISTINCT unit_id, token FROM (SELECT unit_id, unnest(regexp_extract_all(text, '{TOKEN_SQL}')) AS token FROM t) WHERE token NOT IN (SELECT token FROM vault)
  UNION ALL SELECT unit_id, 'look-alike' FROM t WHERE regexp_matches(text, '(?i)\[\s*\[\s*P\s*I\s*I\s*:') AND NOT regexp_matches(text, '{TOKEN_SQL}')""")
def l5_unknown_tokens(spark, sf):
    return L.unknown_tokens(token_texts(spark, sf), vault(spark, sf))


COVERAGE = """want AS (SELECT DISTINCT unit_id, span_start, span_end FROM decided WHERE action <> 'ALLOW'), got AS (SELECT unit_id, span_start, CASE WHEN span_start % 3 = 0 THEN span_end - 1 ELSE span_end END AS span_end FROM applied),
gaps AS (SELECT * FROM (SELECT w.unit_id, w.span_start, w.span_end, CAST(sum(CASE WHEN a.unit_id IS NULL THEN 0 ELSE greatest(least(w.span_end, a.span_end) - greatest(w.span_start, a.span_start), 0) END) AS BIGINT) AS covered FROM want w LEFT JOIN got a ON a.unit_id = w.unit_id GROUP BY ALL) WHERE covered < span_end - span_start)"""


def gaps(spans):
    """What is left open when every fifth unit is left out and some redactions end one character early."""
    want = spans.where("action <> 'ALLOW'").select("unit_id", "span_start", "span_end").distinct()
    end = F.when(F.col("span_start") % 3 == 0, F.col("span_end") - 1).otherwise(F.col("span_end"))
    return L.coverage_gaps(want, spans.where("seq % 5 <> 0").select("unit_id", "span_start", end.alias("span_end")))


@query(f"WITH {FAULTY}, {COVERAGE} SELECT * FROM gaps")
def l6_coverage_gaps(spark, sf):
    return gaps(decided(spark, sf))


@query(f"""WITH {RESCAN}, {HIDDEN}, {KNOWN}, {COVERAGE}, failed AS (SELECT unit_id, 2 AS k, 'rule-scan' AS verdict FROM leaks UNION ALL SELECT unit_id, 3, 'known-value' FROM known_leaks UNION ALL SELECT unit_id, 5, 'coverage' FROM gaps
    UNION ALL SELECT unit_id, 4, 'unknown-token' FROM (SELECT unit_id, unnest(regexp_extract_all(text, '{TOKEN_SQL}')) AS token FROM outgoing) WHERE token NOT IN (SELECT token FROM vault))
  SELECT u.unit_id, coalesce(v, 'SEALED') AS verdict FROM units u LEFT JOIN (SELECT unit_id, arg_min(verdict, k) AS v FROM failed GROUP BY unit_id) USING (unit_id)""")
def l8_seal_verdict(spark, sf):
    out, spans, held = faulty(spark, sf)
    values = known_values(spans.where("action <> 'ALLOW' and value is not null"))
    found = {"rule-scan": rescanned(out, spans), "known-value": L.known_value_leaks(out, values), "unknown-token": L.unknown_tokens(out, held), "coverage": gaps(spans)}
    return L.seal_verdict(units(spark, sf), L.union_failures(found))


@query(f"""WITH {REDACTED}, b AS (SELECT unit_id, 'origin:' || strlen(origin) || ':' || origin || chr(10) || 'text_redacted:' || coalesce(strlen(text_redacted), -1) || ':' || coalesce(text_redacted, '') || chr(10) || 'unit_id:' || strlen(unit_id) || ':' || unit_id || chr(10) AS body FROM red)
  SELECT unit_id, sha256(body) AS digest, strlen(body) AS n_bytes FROM b""")
def s7_write_sanitized(spark, sf):
    return L.digests(redacted(spark, sf).select("unit_id", "origin", "text_redacted"))


# ---- action logs and captures

LOG = """log AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, ts, event_type AS action, (props->>'$.k')::BIGINT AS fp, (props->>'$.k')::BIGINT % 3 AS digest,
  CASE WHEN event_id % 3 = 0 THEN 'pass' WHEN event_id % 7 = 0 THEN 'retry' ELSE 'fail' END AS verdict, CASE WHEN (props->>'$.k')::BIGINT % 25 = 0 THEN 'BUDGET_EXHAUSTED' END AS code, (props->>'$.k')::BIGINT % 5 = 0 AS ocr FROM events)"""


def log(spark, sf):
    return A.action_log(table(spark, sf, "events"))


@query(f"""WITH {LOG}, c AS (SELECT *, count(*) OVER (PARTITION BY session, action, fp, digest ORDER BY step) AS same, sum(CASE WHEN verdict = 'pass' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY step) AS g FROM log),
  d AS (SELECT *, sum(CASE WHEN verdict <> 'pass' THEN 1 ELSE 0 END) OVER (PARTITION BY session, g ORDER BY step) AS idle FROM c)
  SELECT session, step, CASE WHEN same >= 3 THEN 'LOOP_DETECTED' ELSE 'NO_PROGRESS' END AS code FROM d WHERE same >= 3 OR verdict <> 'pass' AND idle >= 4""")
def a6_detect_loops(spark, sf):
    return A.detect_loops(log(spark, sf))


@query(f"""WITH {LOG}, c AS (SELECT *, sum(CASE WHEN verdict <> 'fail' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY step) AS g FROM log)
  SELECT session, step, CASE WHEN code IS NOT NULL OR row_number() OVER (PARTITION BY session, g ORDER BY step) > 2 THEN 'ask_user' ELSE 'replan' END AS next FROM c WHERE verdict = 'fail'""")
def a7_escalations(spark, sf):
    return A.escalations(log(spark, sf))


@query(f"""WITH {LOG}, c AS (SELECT *, least(coalesce(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY session ORDER BY step))), 0), 60) AS gap FROM log),
  d AS (SELECT *, sum(gap) OVER (PARTITION BY session ORDER BY step) AS active, sum(CASE WHEN digest <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY step) AS calls FROM c)
  SELECT session, min(step) AS step, arg_min(CASE WHEN step >= 25 THEN 'steps' WHEN calls >= 15 THEN 'calls' ELSE 'time' END, step) AS reason FROM d WHERE step >= 25 OR calls >= 15 OR active >= 300 GROUP BY session""")
def a8_budget_breaches(spark, sf):
    return A.budget_breaches(log(spark, sf))


@query(f"""WITH {LOG}, m AS (SELECT session, step, lag(action) OVER (PARTITION BY session ORDER BY step) AS was, action AS now FROM log),
  e AS (SELECT DISTINCT a.event_type AS was, b.event_type AS now FROM events a, events b WHERE a.event_type <= b.event_type AND a.event_id < 100 AND b.event_id < 100)
  SELECT session, step, was, now FROM m WHERE was IS NOT NULL AND was <> now AND (was = 'purchase' OR (was, now) NOT IN (SELECT (was, now) FROM e))""".replace(" AND a.event_id < 100 AND b.event_id < 100", "").replace("FROM events a, events b WHERE", "FROM (SELECT DISTINCT event_type FROM events) a, (SELECT DISTINCT event_type FROM events) b WHERE"))
def a9_transition_violations(spark, sf):
    kinds = table(spark, sf, "events").select("event_type").distinct()  # the few kinds of events
    allowed = kinds.withColumnRenamed("event_type", "was").join(kinds.withColumnRenamed("event_type", "now"), F.col("was") <= F.col("now"))
    return A.transition_violations(log(spark, sf), allowed, ("purchase",))


@query(f"WITH {LOG} SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY session ORDER BY step DESC) <= 25")
def a10_bounded_history(spark, sf):
    return A.bounded_history(log(spark, sf))


@query(f"WITH {LOG} SELECT session, count(*) AS steps, count(*) FILTER (digest = 0) AS dom_only, count(*) FILTER (digest = 1) AS reused, count(*) FILTER (digest = 2) AS vision, count(*) FILTER (ocr) AS ocr FROM log GROUP BY session")
def a12_sensing_counters(spark, sf):
    return A.sensing_counters(log(spark, sf))


@query(f"""WITH {LOG}, r AS (SELECT session, step, fp % 40 AS asked, fp % 4 <> 0 AS valid, sum(CASE WHEN fp % 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY step) AS n FROM log)
  SELECT session, step, CASE WHEN NOT valid THEN 'invalid' WHEN n > 3 THEN 'exhausted' ELSE 'granted' END AS outcome, CAST(greatest(3 - n, 0) AS BIGINT) AS remaining, CASE WHEN valid AND n <= 3 THEN least(asked, 20) ELSE 0 END AS rows FROM r""")
def a13_expansion_budget(spark, sf):
    return A.expansion_budget(log(spark, sf).select("session", "step", (F.col("fp") % 4 != 0).alias("valid"), (F.col("fp") % 40).alias("asked")))


CAPS = """caps AS (SELECT session, keys, url, dialog, scroll, dhash, row_number() OVER (PARTITION BY session ORDER BY span) AS capture FROM (
  SELECT user_id AS session, date_trunc('week', ts) AS span, list_distinct(list(CASE WHEN user_id % 2 = 0 THEN (props->>'$.k')::BIGINT % 4 ELSE (props->>'$.k')::BIGINT END)) AS keys, CASE WHEN user_id % 3 = 0 THEN arg_min(event_type, (ts, event_id)) ELSE 'view' END AS url,
    count(*) FILTER (event_type = 'signup') % 4 = 3 AS dialog, max(value) AS scroll, bit_or(1::BIGINT << (event_id * 7 % 56)::INT) AS dhash FROM events GROUP BY user_id, date_trunc('week', ts))),
pairs AS (SELECT *, lag(keys) OVER w AS b, lag(url) OVER w AS b_url, lag(dialog) OVER w AS b_dialog, lag(scroll) OVER w AS b_scroll, lag(dhash) OVER w AS b_hash FROM caps WINDOW w AS (PARTITION BY session ORDER BY capture)),
diffs AS (SELECT session, capture, url, b_url, dialog <> b_dialog AS dialog_changed, abs(scroll - b_scroll) / 500 AS scrolled, bit_count(xor(dhash, b_hash)) AS far, len(b) AS n, len(list_filter(keys, lambda x: NOT list_contains(b, x))) AS added, len(list_filter(b, lambda x: NOT list_contains(keys, x))) AS removed FROM pairs WHERE b IS NOT NULL)"""


@query(f"WITH {CAPS} SELECT session, capture, added, removed FROM diffs")
def a14_mutation_diff(spark, sf):
    return A.mutation_diff(A.captures(table(spark, sf, "events")))


@query(f"WITH {CAPS} SELECT session, capture, CASE WHEN url <> b_url THEN 'url' WHEN dialog_changed THEN 'dialog' WHEN added + removed >= 15 THEN 'mutations' WHEN (added + removed) / greatest(n, 1) >= 0.25 THEN 'ratio' WHEN scrolled >= 0.5 THEN 'scroll' WHEN added + removed >= 5 AND far > 10 THEN 'hash' ELSE 'same' END AS reason FROM diffs")
def a15_screen_changes(spark, sf):
    return A.screen_changes(A.captures(table(spark, sf, "events")))


HASHES = "h AS (SELECT vec_id, CAST(list_sum(list_transform(range(56), lambda i: CASE WHEN embedding[(i // 7) * 8 + i % 7 + 1] > embedding[(i // 7) * 8 + i % 7 + 2] THEN 1::BIGINT << (55 - i)::INT ELSE 0 END)) AS BIGINT) AS dhash FROM embeddings)"


@query(f"WITH {HASHES} SELECT vec_id, dhash FROM h")
def a16_difference_hash(spark, sf):
    return A.difference_hash(table(spark, sf, "embeddings"))


@query(f"""WITH {HASHES}, r AS (SELECT dhash, min(vec_id) AS rep FROM h GROUP BY dhash)
  SELECT x.rep AS a, y.rep AS b, CAST(bit_count(xor(x.dhash, y.dhash)) AS INT) AS distance FROM r x JOIN r y ON x.rep < y.rep AND bit_count(xor(x.dhash, y.dhash)) <= 10
  UNION ALL SELECT rep, vec_id, 0 FROM h JOIN r USING (dhash) WHERE vec_id <> rep""")
def a16_near_hashes(spark, sf):
    return A.near_hashes(A.difference_hash(table(spark, sf, "embeddings")), 10)


@query(f"""WITH {LOG}, b AS (SELECT *, max(CASE WHEN digest = 0 THEN step END) OVER (PARTITION BY session ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM log)
  SELECT p.session, p.step, p.fp AS token, coalesce(s.fp, -1) AS current, coalesce(p.fp <> s.fp, TRUE) AS stale FROM b p LEFT JOIN log s ON s.session = p.session AND s.step = p.at WHERE p.digest <> 0""")
def a1_latest_state_check(spark, sf):
    rows = log(spark, sf)
    checked = A.latest_state_check(rows.where("digest <> 0").select("session", "ts", "step", F.col("fp").alias("token")), rows.where("digest = 0").select("session", "ts", "step", F.col("fp").alias("state")))
    return checked.fillna(-1, "current")


# ---- event time


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def t9_category_counts(spark, sf):
    return T.category_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 6))


BURST = "SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) {op} INTERVAL {s} SECOND THEN 0 ELSE 1 END AS fresh FROM events"


@query(f"""WITH b AS ({BURST.format(op='<', s=7200)}), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM b)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 7200 SECOND AS stop, count(*) AS n FROM g GROUP BY user_id, session""")
def t1_settle_windows(spark, sf):
    return T.settle_windows(table(spark, sf, "events"))


@query("SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS gap FROM events) WHERE gap IS NULL OR gap > INTERVAL 3600 SECOND")
def t4_debounce(spark, sf):
    return T.debounce(table(spark, sf, "events"))


@query(f"""WITH b AS ({BURST.format(op='<=', s=7200)}), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM b)
  SELECT user_id, min(ts) AS start, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM g GROUP BY user_id, session""")
def t5_session_state(spark, sf):
    return T.session_state(table(spark, sf, "events"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def t3_coalesce_latest(spark, sf):
    return T.coalesce_latest(table(spark, sf, "events"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
  f AS (SELECT user_id, event_id, r, (-4611686018427387904)::BIGINT AS a, t AS b, TRUE AS kept FROM e WHERE r = 1
    UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN e.t - f.a >= 3600000000 THEN f.b ELSE f.a END, CASE WHEN e.t - f.a >= 3600000000 THEN e.t ELSE f.b END, e.t - f.a >= 3600000000 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
  SELECT user_id, event_id FROM f WHERE kept""")
def t2_rate_limit(spark, sf):
    return T.rate_limit(table(spark, sf, "events"))


SETTLED = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
  f AS (SELECT user_id, r, t, t AS begin, 1 AS fresh FROM e WHERE r = 1
    UNION ALL SELECT e.user_id, e.r, e.t, CASE WHEN e.t - f.t >= 7200000000 OR e.t - f.begin >= 21600000000 THEN e.t ELSE f.begin END, CASE WHEN e.t - f.t >= 7200000000 OR e.t - f.begin >= 21600000000 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY r) AS burst FROM f)
  SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n, CASE WHEN max(t) + 7200000000 <= min(t) + 21600000000 THEN 'quiet' ELSE 'max' END AS reason FROM n GROUP BY user_id, burst"""


@query(SETTLED)
def t1_settle_bounded(spark, sf):
    return T.settle_bounded(table(spark, sf, "events"))


# ---- generated corpora and evaluation

LET = lambda e, n: " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', ((({e}) // {26**i}) % 26 + 1)::INT, 1)" for i in range(n))
VERHOEFF_DIGIT = f"list_reduce(list_prepend(0, list_transform(range(1, length(v) + 1), lambda i: (i % 8)::INT * 10 + substr(v, -i, 1)::INT)), lambda c, x: substr('{R.VERHOEFF_D}', c * 10 + substr('{R.VERHOEFF_P}', x + 1, 1)::INT + 1, 1)::INT)"
LUHN_SUM = "list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i % 2 = 0 THEN substr(v, -i, 1)::INT WHEN substr(v, -i, 1)::INT > 4 THEN substr(v, -i, 1)::INT * 2 - 9 ELSE substr(v, -i, 1)::INT * 2 END))"
GEN = f"""keys AS (SELECT c_custkey AS k, 'gen:' || c_custkey AS unit_id FROM customer),
ids AS (
  SELECT unit_id, 1 AS rank, 'AADHAAR' AS category, v || CASE WHEN c BETWEEN 1 AND 4 THEN 5 - c ELSE c END AS value FROM (SELECT unit_id, v, {VERHOEFF_DIGIT} AS c FROM (SELECT unit_id, (2 + k % 8) || lpad(((k * 7919 + 13) % 10000000000)::VARCHAR, 10, '0') AS v FROM keys))
  UNION ALL SELECT unit_id, 2, 'CARD_NUMBER', v || ((10 - ({LUHN_SUM}) % 10) % 10)::BIGINT FROM (SELECT unit_id, '4' || lpad(((k * 104729 + 7) % 100000000000000)::VARCHAR, 14, '0') AS v FROM keys)
  UNION ALL SELECT unit_id, 3, 'PAN', {LET('k * 31', 3)} || 'P' || {LET('k * 17', 1)} || lpad((k * 37 % 10000)::VARCHAR, 4, '0') || {LET('k * 3', 1)} FROM keys
  UNION ALL SELECT unit_id, 4, 'EMAIL', 'user' || k || '@mail.example.org' FROM keys
  UNION ALL SELECT unit_id, 5, 'PHONE', '9' || lpad((k * 15485863 % 1000000000)::VARCHAR, 9, '0') FROM keys
  UNION ALL SELECT unit_id, 6, 'IFSC', {LET('k * 11', 4)} || '0' || lpad((k * 271 % 1000000)::VARCHAR, 6, '0') FROM keys
  UNION ALL SELECT unit_id, 7, 'VEHICLE_REG', {LET('k * 5', 2)} || lpad((k % 99 + 1)::VARCHAR, 2, '0') || {LET('k * 7', 2)} || lpad((k * 13 % 10000)::VARCHAR, 4, '0') FROM keys
  UNION ALL SELECT unit_id, 8, 'UPI_ID', 'pay' || k || '@ybl' FROM keys
  UNION ALL SELECT unit_id, 9, 'VOTER_ID', {LET('k * 19', 3)} || lpad((k * 7 % 10000000)::VARCHAR, 7, '0') FROM keys
  UNION ALL SELECT unit_id, 10, 'UAN', '1' || lpad((k * 6151 % 100000000000)::VARCHAR, 11, '0') FROM keys
  UNION ALL SELECT unit_id, 11, 'ABHA', '91' || lpad((k * 7127 % 1000000000000)::VARCHAR, 12, '0') FROM keys
  UNION ALL SELECT unit_id, 12, 'BANK_ACCOUNT', '0' || lpad((k * 104711 % 10000000000)::VARCHAR, 10, '0') FROM keys
  UNION ALL SELECT unit_id, 13, 'PIN_CODE', (1 + k % 9) || lpad((k * 37 % 100000)::VARCHAR, 5, '0') FROM keys
  UNION ALL SELECT unit_id, 14, 'PASSPORT', {LET('k * 23', 1)} || lpad((k * 31 % 10000000)::VARCHAR, 7, '0') FROM keys
  UNION ALL SELECT unit_id, 15, 'ORDER_ID', 'OD-' || lpad(k::VARCHAR, 8, '0') FROM keys
  UNION ALL SELECT unit_id, 16, 'DOB', lpad((k % 28 + 1)::VARCHAR, 2, '0') || '/' || lpad((k % 12 + 1)::VARCHAR, 2, '0') || '/' || (1940 + k % 60) FROM keys
  UNION ALL SELECT unit_id, 17, 'OTP', lpad((k * 7919 % 1000000)::VARCHAR, 6, '0') FROM keys
  UNION ALL SELECT unit_id, 18, 'TRACKING_ID', {LET('k * 29', 2)} || lpad((k * 8191 % 1000000000)::VARCHAR, 9, '0') || 'IN' FROM keys),
sentences AS (SELECT *, ([{', '.join(quoted(x) for _, x in G.KINDS)}])[rank] AS label FROM ids),
rendered AS (SELECT unit_id, string_agg(label || ': ' || value || '. ', '' ORDER BY rank) AS text FROM sentences GROUP BY unit_id),
placed AS (SELECT *, coalesce(sum(length(label) + length(value) + 4) OVER (PARTITION BY unit_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(label) + 2 AS span_start FROM sentences),
truth AS (SELECT unit_id, rank - 1 AS ann_id, category, value, span_start, span_start + length(value) AS span_end FROM placed)"""
FOUND = f"{GEN}, gen_units AS (SELECT unit_id, 'gen' AS origin, text FROM rendered), found AS ({scan_sql('gen_units')})"
HITS = f"""{FOUND}, hits AS (SELECT t.unit_id, ann_id, f.category FROM found f JOIN truth t ON t.unit_id = f.unit_id AND f.span_start < t.span_end AND t.span_start < f.span_end AND (contains(lower(f.value), lower(t.value)) OR contains(lower(t.value), lower(f.value)))),
uniq AS (SELECT DISTINCT * FROM hits),
counts AS (
  SELECT u.category, CASE WHEN t.unit_id IS NULL THEN 0 ELSE 1 END AS tp, CASE WHEN t.unit_id IS NULL THEN 1 ELSE 0 END AS fp, 0 AS fn FROM uniq u LEFT JOIN truth t ON t.unit_id = u.unit_id AND t.ann_id = u.ann_id AND t.category = u.category
  UNION ALL SELECT t.category, 0, 0, 1 FROM truth t LEFT JOIN uniq u ON t.unit_id = u.unit_id AND t.ann_id = u.ann_id AND t.category = u.category WHERE u.unit_id IS NULL),
scores AS (SELECT category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CASE WHEN sum(tp) + sum(fp) > 0 THEN round(sum(tp) / (sum(tp) + sum(fp)), 3) END AS precision, CASE WHEN sum(tp) + sum(fn) > 0 THEN round(sum(tp) / (sum(tp) + sum(fn)), 3) END AS recall FROM counts GROUP BY ROLLUP (category))"""


def customers(spark, sf):
    """Customers by tasks of some thousands: what is made of each is much larger than its row."""
    return S.spread(table(spark, sf, "customer"), 10000)


def identifiers(spark, sf):
    return G.generate_identifiers(customers(spark, sf))


def rendered(spark, sf):
    return G.render_lists(G.identifier_lists(customers(spark, sf)))


def truth(spark, sf):
    return G.truth_of(rendered(spark, sf))


def found(spark, sf):
    return stored(D.scan(rendered(spark, sf).select("unit_id", F.lit("gen").alias("origin"), "text")))


def hits(spark, sf):
    return E.match_truth(found(spark, sf), truth(spark, sf))


@query(f"WITH {GEN} SELECT unit_id, category, value FROM ids")
def g1_generate_identifiers(spark, sf):
    return identifiers(spark, sf)


@query(f"WITH {GEN} SELECT unit_id, category, left(value, length(value) - 1) || ((right(value, 1)::INT + 1) % 10) AS value FROM ids WHERE category IN ('AADHAAR', 'CARD_NUMBER')")
def g2_generate_near_misses(spark, sf):
    return G.generate_near_misses(identifiers(spark, sf))


@query("""SELECT unit_id, value FROM (SELECT 'gen:' || c_custkey AS unit_id, unnest(['REF-' || (c_custkey * 7919), lpad((c_custkey * 48271 % 10000000000)::VARCHAR, 10, '0'), 'v' || (c_custkey % 9) || '.' || (c_custkey % 17) || '.' || (c_custkey % 31), (c_custkey % 90 + 10) || ' x ' || (c_custkey % 70 + 10)]) AS value FROM customer)
  WHERE NOT regexp_matches(value, '^[6-9][0-9]{9}$') AND NOT regexp_matches(value, '^[2-9][0-9]{11}$')""")
def g2_catalogue_negatives(spark, sf):
    return G.generate_catalogue(table(spark, sf, "customer"))


@query(f"WITH {GEN} SELECT t.*, r.text FROM truth t JOIN rendered r USING (unit_id)")
def g3_render_labelled_text(spark, sf):
    return rendered(spark, sf).select("unit_id", F.posexplode_outer("truth").alias("ann_id", "t"), "text").select("unit_id", F.col("ann_id").cast("long").alias("ann_id"), "t.*", "text")


@query(f"WITH {LABELS}, {LABELLED} SELECT unit_id, label AS phrase, CASE WHEN ('0x' || substr(sha256(label), 1, 2))::INT % 2 = 0 THEN 'train' ELSE 'heldout' END AS split FROM labelled")
def g4_split_phrases(spark, sf):
    return G.split_phrases(labelled(spark, sf).select("unit_id", F.col("label").alias("phrase")))


@query(f"""WITH {GEN}, c AS (SELECT unit_id, category, count(*) AS n FROM truth WHERE length(value) % 2 = 0 GROUP BY ALL), e AS (SELECT unit_id, unnest([{', '.join(quoted(c) for c, _ in G.KINDS)}, 'DRIVING_LICENCE']) AS category FROM (SELECT DISTINCT unit_id FROM truth WHERE length(value) % 2 = 0))
  SELECT unit_id, category, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'control' END AS kind FROM e LEFT JOIN c USING (unit_id, category)""")
def g5_derive_tasks(spark, sf):
    return G.derive_tasks(truth(spark, sf).where("length(value) % 2 = 0"))


@query("""SELECT 'doc:' || doc_id AS unit_id, CASE WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'added' ELSE 'changed' END AS drift FROM documents WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0 OR doc_id % 5 = 0 AND doc_id % 7 <> 0 OR doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def g6_verify_seal(spark, sf):
    docs, k = table(spark, sf, "documents"), F.col("doc_id")
    unit = F.concat(F.lit("doc:"), k).alias("unit_id")
    recorded = docs.where(k % 5 != 0).select(unit, F.sha2(F.col("text"), 256).alias("digest"))
    current = docs.where(k % 7 != 0).select(unit, F.when(k % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return G.verify_seal(recorded, current)


@query(f"WITH {HITS} SELECT * FROM hits")
def e1_match_truth(spark, sf):
    return hits(spark, sf)


@query(f"WITH {HITS} SELECT * FROM uniq")
def e2_dedup_hits(spark, sf):
    return E.dedup_hits(hits(spark, sf))


@query(f"WITH {HITS} SELECT * FROM scores")
def e3_precision_recall(spark, sf):
    return E.precision_recall(truth(spark, sf), hits(spark, sf))


@query(f"WITH {HITS} SELECT DISTINCT category FROM (SELECT category FROM truth UNION ALL SELECT category FROM hits)")
def e4_scored_categories(spark, sf):
    return E.scored_categories(truth(spark, sf), hits(spark, sf))


WORSE = "worse AS (SELECT unit_id, ann_id, CASE WHEN category = 'PHONE' AND ann_id = 4 AND length(unit_id) % 2 = 0 THEN 'UAN' ELSE category END AS category FROM uniq WHERE NOT (category = 'IFSC' AND length(unit_id) % 2 = 1))"


def worse(spark, sf, found=None):
    """Hits with planted errors: some phones under another name, some codes missed."""
    odd = F.length("unit_id") % 2
    renamed = F.when((F.col("category") == "PHONE") & (F.col("ann_id") == 4) & (odd == 0), "UAN").otherwise(F.col("category"))
    return (hits(spark, sf) if found is None else found).where(~((F.col("category") == "IFSC") & (odd == 1))).withColumn("category", renamed)


@query(f"""WITH {HITS}, {WORSE} SELECT * FROM (SELECT t.unit_id, t.ann_id, t.category AS expected, coalesce(d, '') AS detected FROM truth t LEFT JOIN (SELECT unit_id, ann_id, string_agg(DISTINCT category, ',' ORDER BY category) AS d FROM worse GROUP BY ALL) USING (unit_id, ann_id)) WHERE expected <> detected""")
def e5_error_rows(spark, sf):
    return E.error_rows(truth(spark, sf), worse(spark, sf))


MODE = "CASE WHEN category IN ('AADHAAR', 'CARD_NUMBER') THEN 'checksum' WHEN category IN ('PAN', 'EMAIL', 'PHONE', 'IFSC', 'UPI_ID', 'VEHICLE_REG') THEN 'shape' ELSE 'label' END"
RATIOS = "CASE WHEN sum(tp) + sum(fp) > 0 THEN round(sum(tp) / (sum(tp) + sum(fp)), 3) END AS precision, CASE WHEN sum(tp) + sum(fn) > 0 THEN round(sum(tp) / (sum(tp) + sum(fn)), 3) END AS recall"
WORSE_COUNTS = f"""{WORSE}, worse_counts AS (
  SELECT u.category, CASE WHEN t.unit_id IS NULL THEN 0 ELSE 1 END AS tp, CASE WHEN t.unit_id IS NULL THEN 1 ELSE 0 END AS fp, 0 AS fn FROM (SELECT DISTINCT * FROM worse) u LEFT JOIN truth t ON t.unit_id = u.unit_id AND t.ann_id = u.ann_id AND t.category = u.category
  UNION ALL SELECT t.category, 0, 0, 1 FROM truth t LEFT JOIN worse u ON t.unit_id = u.unit_id AND t.ann_id = u.ann_id AND t.category = u.category WHERE u.unit_id IS NULL)"""


@query(f"""WITH {HITS}, {WORSE_COUNTS}, a AS (SELECT category, precision, recall FROM scores WHERE category IS NOT NULL), b AS (SELECT category, {RATIOS} FROM worse_counts GROUP BY category)
  SELECT category, round((b.precision - a.precision) * 100, 1) AS precision_pp, round((b.recall - a.recall) * 100, 1) AS recall_pp FROM a FULL JOIN b USING (category)""")
def e6_delta_pp(spark, sf):
    t, h = truth(spark, sf), stored(hits(spark, sf))
    return E.delta_pp(E.precision_recall(t, h), E.precision_recall(t, worse(spark, sf, h)))


@query(f"WITH {HITS}, {WORSE_COUNTS}, m AS (SELECT *, {MODE} AS mode FROM worse_counts) SELECT mode, category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {RATIOS} FROM m GROUP BY ROLLUP (mode, category)")
def e7_metrics_by_mode(spark, sf):
    return E.metrics_by_mode(truth(spark, sf), worse(spark, sf))


@query(f"WITH {GEN}, r AS (SELECT DISTINCT 'gen:' || o_custkey AS unit_id FROM orders WHERE o_orderpriority = '1-URGENT') SELECT count(DISTINCT t.unit_id) AS n_units, count(DISTINCT r.unit_id) AS n_refused, round(1 - count(DISTINCT r.unit_id) / count(DISTINCT t.unit_id), 3) AS coverage FROM truth t LEFT JOIN r USING (unit_id)")
def e8_coverage(spark, sf):
    return E.coverage(truth(spark, sf), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("gen:"), "o_custkey").alias("unit_id")))


@query(f"WITH {GEN} SELECT * FROM truth WHERE unit_id NOT IN (SELECT 'gen:' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def e8_exclude_refused(spark, sf):
    return E.exclude_refused(truth(spark, sf), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("gen:"), "o_custkey").alias("unit_id")))


@query(f"""WITH {FOUND}, a AS (SELECT unit_id, category, count(*) AS was FROM found GROUP BY ALL), b AS (SELECT unit_id, category, count(*) AS now FROM found WHERE confidence >= 0.9 GROUP BY ALL)
  SELECT unit_id, category, coalesce(was, 0) AS was, coalesce(now, 0) AS now FROM a FULL JOIN b USING (unit_id, category) WHERE coalesce(was, 0) <> coalesce(now, 0)""")
def e11_replay_diff(spark, sf):
    rows = found(spark, sf)
    return E.replay_diff(rows, rows.where("confidence >= 0.9"))


@query(f"""WITH {LOG}, r AS (SELECT action AS reason, fp % 2 = 0 AS impossible, CASE verdict WHEN 'pass' THEN 'done' WHEN 'retry' THEN 'flagged' ELSE 'open' END AS verdict, fp % 3 = 0 AS mutated FROM log)
  SELECT reason, count(*) FILTER (impossible) AS impossible, count(*) FILTER (impossible AND verdict = 'done') AS done, count(*) FILTER (impossible AND verdict = 'flagged') AS flagged, count(*) FILTER (impossible AND mutated) AS mutated,
    count(*) FILTER (NOT impossible) AS controls, count(*) FILTER (NOT impossible AND verdict = 'done') AS controls_done FROM r GROUP BY ROLLUP (reason)""")
def e12_false_success_rate(spark, sf):
    verdict = F.when(F.col("verdict") == "pass", "done").when(F.col("verdict") == "retry", "flagged").otherwise("open")
    return E.false_success_rate(log(spark, sf).select(F.col("action").alias("reason"), (F.col("fp") % 2 == 0).alias("impossible"), verdict.alias("verdict"), (F.col("fp") % 3 == 0).alias("mutated")))


@query("SELECT stratum, id, pick FROM (SELECT o_orderpriority AS stratum, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('salt' || o_orderkey)) AS pick FROM orders) WHERE pick <= 10")
def e13_stratified_sample(spark, sf):
    return E.stratified_sample(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderkey").alias("id")), 10, "salt")


PROBE = "probe AS (SELECT event_type AS name, value AS latency_ms, k AS run_index, k % 2 = 0 AS schema_valid, CASE WHEN k % 5 <> 0 THEN k % 3 = 0 END AS grounded, CASE WHEN k % 7 <> 0 THEN k % 2 = 1 END AS enforced_ok FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))"


@query(f"WITH {PROBE} SELECT name, count(latency_ms) AS n, min(latency_ms) AS low, median(latency_ms) AS mid, quantile_disc(latency_ms, 0.9) AS p90, quantile_disc(latency_ms, 0.95) AS p95, max(latency_ms) AS high, count(latency_ms) >= 12 AND count(DISTINCT run_index) = max(run_index) + 1 AS reportable FROM probe GROUP BY name")
def e14_latency_summary(spark, sf):
    return E.latency_summary(E.probe_log(table(spark, sf, "events")))


@query(f"WITH {PROBE} " + " UNION ALL ".join(f"SELECT name, '{m}' AS metric, count(*) FILTER ({m}) AS hits, count({m}) AS asked FROM probe GROUP BY name" for m in ("schema_valid", "grounded", "enforced_ok")))
def e15_scorecard(spark, sf):
    return E.scorecard(E.probe_log(table(spark, sf, "events")))


@query(f"WITH {UNITS} SELECT target_kind AS mode, count(*) AS n, min(strlen(text)) AS low, median(strlen(text)) AS mid, quantile_disc(strlen(text), 0.95) AS p95, max(strlen(text)) AS high FROM units GROUP BY target_kind")
def e16_payload_sizes(spark, sf):
    return E.payload_sizes(units(spark, sf).select(F.col("target_kind").alias("mode"), "text"))


# ---- pages


def parts(spark, sf):
    return H.page_parts(table(spark, sf, "pages"))


@query()
def h1_html_text_blocks(spark, sf):
    return H.text_blocks(parts(spark, sf))


@query()
def h2_html_elements(spark, sf):
    return H.elements(parts(spark, sf))


@query()
def h3_html_media(spark, sf):
    return H.media(parts(spark, sf))


@query()
def h4_static_visibility(spark, sf):
    return parts(spark, sf).groupBy("page_id", F.coalesce("hidden", F.lit("visible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query()
def h5_structural_context(spark, sf):
    return H.structural_context(H.text_blocks(parts(spark, sf)))


@query()
def h6_inherit_privacy_attrs(spark, sf):
    return parts(spark, sf).select("page_id", "seq", F.explode(F.split("marks", ",")).alias("mark")).where("mark <> ''")


FP = "fps AS (SELECT *, substr(sha256('salt' || chr(1) || action || chr(1) || verdict || chr(1) || regexp_replace('item ' || fp, '[0-9]+', '#', 'g')), 1, 8) AS key FROM log), nth AS (SELECT session, step, key, row_number() OVER (PARTITION BY session, key ORDER BY step) - 1 AS ordinal FROM fps)"


def fingerprints(spark, sf):
    rows = log(spark, sf).select("session", F.col("step").alias("seq"), F.col("action").alias("role"), F.col("verdict").alias("tag"), F.concat(F.lit("Item "), "fp").alias("name"))
    return H.row_fingerprint(rows, "salt", "session")


@query(f"WITH {LOG}, {FP} SELECT session, step, key FROM nth")
def h8_row_fingerprint(spark, sf):
    return fingerprints(spark, sf).select("session", F.col("seq").alias("step"), F.col("fp").alias("key"))


@query(f"WITH {LOG}, {FP} SELECT session, step, key, ordinal FROM nth")
def h9_assign_ordinals(spark, sf):
    return fingerprints(spark, sf).select("session", F.col("seq").alias("step"), F.col("fp").alias("key"), "ordinal")


@query(f"""WITH {LOG}, {FP}, b AS (SELECT session, key, ordinal, row_number() OVER (PARTITION BY session ORDER BY key, ordinal) AS eid FROM nth WHERE step % 3 <> 0), t AS (SELECT session, max(eid) AS top FROM b GROUP BY session),
  n AS (SELECT n.session, n.key, n.ordinal, b.eid, coalesce(top, 0) AS top FROM nth n LEFT JOIN b ON b.session = n.session AND b.key = n.key AND b.ordinal = n.ordinal LEFT JOIN t ON t.session = n.session WHERE n.step % 2 = 0)
  SELECT session AS page_id, key AS fp, ordinal, coalesce(eid, top + row_number() OVER (PARTITION BY session, eid IS NULL ORDER BY key, ordinal)) AS eid, count(*) OVER (PARTITION BY session, key) > 1 AS ambiguous FROM n""")
def h10_stable_ids(spark, sf):
    rows = fingerprints(spark, sf).withColumnRenamed("session", "page_id")
    before = rows.where("seq % 3 <> 0").withColumn("eid", F.row_number().over(Window.partitionBy("page_id").orderBy("fp", "ordinal")))
    return H.stable_ids(before, rows.where("seq % 2 = 0"))


BOXES = "boxes AS (SELECT o_custkey % 50 AS page_id, o_orderkey AS id, (o_orderkey % 97) * 100 AS x, (o_orderkey * 53 % 311) * 10 AS y FROM orders)"


@query(f"""WITH {BOXES}, p AS (SELECT v.page_id, v.id AS value_id, l.id AS label_id, (v.x - l.x) ** 2 + (v.y - l.y) ** 2 AS far FROM boxes v JOIN boxes l ON v.page_id = l.page_id AND v.id % 3 <> 0 AND l.id % 3 = 0 AND (l.y = v.y AND l.x < v.x AND v.x - l.x <= 120 OR l.x = v.x AND l.y < v.y AND v.y - l.y <= 120))
  SELECT page_id, value_id, arg_min(label_id, (far, label_id)) AS label_id FROM p GROUP BY page_id, value_id""")
def h12_nearest_label(spark, sf):
    k = F.col("o_orderkey")
    boxes = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("page_id"), k.alias("id"), ((k % 97) * 100).alias("x"), ((k * 53 % 311) * 10).alias("y"))
    return H.nearest_label(boxes.where("id % 3 <> 0").withColumnRenamed("id", "value_id"), boxes.where("id % 3 = 0").withColumnRenamed("id", "label_id"))


FRAMES = "frames AS (SELECT c_custkey AS frame_id, CASE WHEN c_custkey % 97 = 0 OR c_custkey < 2 THEN NULL WHEN c_custkey % 89 = 0 THEN c_custkey ELSE c_custkey // 3 END AS parent_id FROM customer)"


@query(f"""WITH RECURSIVE {FRAMES}, walk AS (SELECT frame_id, frame_id::VARCHAR AS path, 1 AS depth FROM frames WHERE parent_id IS NULL
  UNION ALL SELECT f.frame_id, w.path || '/' || f.frame_id, w.depth + 1 FROM walk w JOIN frames f ON f.parent_id = w.frame_id) SELECT frame_id, path FROM walk""")
def h13_frame_paths(spark, sf):
    k = F.col("c_custkey")
    parent = F.when((k % 97 == 0) | (k < 2), None).when(k % 89 == 0, k).otherwise(F.floor(k / 3))
    return H.frame_paths(table(spark, sf, "customer").select(k.alias("frame_id"), parent.alias("parent_id")))


# ---- evidence

TOKENS = tuple(V.AUTOCOMPLETE)
CANDS = f"""cands AS (SELECT o_orderkey AS id, ([{', '.join(map(quoted, ('UAN', 'SECRET', 'PIN_CODE', 'DATE')))}])[(o_orderkey % 4 + 1)::INT] AS category,
  CASE o_orderkey % 6 WHEN 0 THEN 'AB-' || o_orderkey WHEN 1 THEN 'user_' || (o_orderkey % 1000) WHEN 2 THEN (o_orderkey % 100) || '%' ELSE o_orderkey::VARCHAR END AS value,
  (['weak', 'structured', 'self_describing'])[(o_orderkey % 3 + 1)::INT] AS strength, CASE WHEN o_orderkey % 5 = 0 THEN 'fail' WHEN o_orderkey % 5 = 1 THEN 'pass' END AS checksum,
  CASE WHEN o_orderkey % 7 = 0 THEN 'NAME' END AS bound, CASE WHEN o_orderkey % 4 = 1 THEN ([{', '.join(quoted(V.AUTOCOMPLETE[t]) for t in TOKENS)}])[(o_orderkey % {len(TOKENS)} + 1)::INT] END AS autocomplete,
  CASE WHEN o_orderkey % 8 = 0 THEN 'Our Product list' WHEN o_orderkey % 8 = 1 THEN 'Productivity' END AS container, o_orderkey % 5 AS n_targets,
  CASE o_orderkey % 9 WHEN 0 THEN 'tel' WHEN 1 THEN 'number' WHEN 2 THEN 'password' END AS input_type, o_orderkey % 10 = 0 AS length_agrees, CASE WHEN o_orderkey % 12 = 0 THEN 'UAN' END AS container_category, o_orderkey % 6 = 1 AS identity_seen, o_orderkey % 14 = 3 AS in_search FROM orders)"""


def candidates(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    value = F.when(k % 6 == 0, F.concat(F.lit("AB-"), k)).when(k % 6 == 1, F.concat(F.lit("user_"), k % 1000)).when(k % 6 == 2, F.concat(k % 100, F.lit("%"))).otherwise(k.cast("string"))
    auto = F.when(k % 4 == 1, V.map_autocomplete(F.concat(F.lit("section-x "), F.upper(pick(TOKENS, k % len(TOKENS))), F.lit(" email"))))
    return table(spark, sf, "orders").select(
        k.alias("id"), pick(("UAN", "SECRET", "PIN_CODE", "DATE"), k % 4).alias("category"), value.alias("value"), pick(("weak", "structured", "self_describing"), k % 3).alias("strength"),
        F.when(k % 5 == 0, "fail").when(k % 5 == 1, "pass").alias("checksum"), F.when(k % 7 == 0, "NAME").alias("bound"), auto.alias("autocomplete"),
        F.when(k % 8 == 0, "Our Product list").when(k % 8 == 1, "Productivity").alias("container"), (k % 5).alias("n_targets"),
        F.when(k % 9 == 0, "tel").when(k % 9 == 1, "number").when(k % 9 == 2, "password").alias("input_type"), (k % 10 == 0).alias("length_agrees"), F.when(k % 12 == 0, "UAN").alias("container_category"), (k % 6 == 1).alias("identity_seen"), (k % 14 == 3).alias("in_search"),
    )


@query(f"WITH {CANDS} SELECT id, autocomplete FROM cands")
def d7_map_autocomplete(spark, sf):
    return candidates(spark, sf).select("id", "autocomplete")


PADDED = "' ' || regexp_replace(lower(coalesce(container, '')), '[^a-z]+', ' ', 'g') || ' '"
SIGNALS = f"""signals AS (SELECT *, (CASE WHEN coalesce(checksum = 'fail', FALSE) THEN -4 ELSE 0 END) AS s1,
  (CASE WHEN {' OR '.join(f"contains({PADDED}, ' {t} ')" for t in V.CONTAINERS)} THEN -3 ELSE 0 END) AS s2, (CASE WHEN {' OR '.join(f"regexp_matches(trim(value), {quoted(x)})" for x in V.SHAPES)} THEN -3 ELSE 0 END) AS s3,
  (CASE WHEN n_targets >= 3 THEN -2 ELSE 0 END) AS s4, (CASE WHEN category = 'SECRET' AND regexp_matches(trim(value), {quoted(V.USERNAME)}) THEN -2 ELSE 0 END) AS s5, (CASE WHEN in_search THEN -2 ELSE 0 END) AS s6 FROM cands)"""


@query(f"""WITH {CANDS}, {SIGNALS} SELECT id, concat_ws(',', CASE WHEN s1 < 0 THEN 'checksum_fail' END, CASE WHEN s2 < 0 THEN 'non_pii_container' END, CASE WHEN s3 < 0 THEN 'non_pii_shape' END, CASE WHEN s4 < 0 THEN 'repeated' END, CASE WHEN s6 < 0 THEN 'in_search_scope' END, CASE WHEN s5 < 0 THEN 'username' END) AS signals FROM signals""")
def d15_negative_signals(spark, sf):
    found = V.negative_signals(F.col("container"), F.col("value"), F.col("n_targets"), F.col("category"), F.col("checksum"), F.col("in_search"))
    return candidates(spark, sf).select("id", F.array_join(F.transform(found, lambda s: s["name"]), ",").alias("signals"))


AGREES = "CASE input_type " + " ".join(f"WHEN '{k}' THEN coalesce(bound, autocomplete, category) IN ({', '.join(map(quoted, v))})" for k, v in V.INPUT_TYPES.items()) + " END"


@query(f"""WITH {CANDS}, {SIGNALS}, sc AS (SELECT id, coalesce(bound, autocomplete, category) AS claimed, CASE WHEN {AGREES} THEN 2 ELSE 0 END + CASE WHEN length_agrees THEN 2 ELSE 0 END + CASE WHEN container_category = coalesce(bound, autocomplete, category) THEN 2 ELSE 0 END + CASE WHEN identity_seen THEN 1 ELSE 0 END + CASE WHEN checksum = 'pass' THEN 5 ELSE 0 END + CASE strength WHEN 'weak' THEN 1 WHEN 'structured' THEN 3 ELSE 5 END + CASE WHEN bound IS NOT NULL THEN 3 ELSE 0 END
    + CASE WHEN autocomplete = coalesce(bound, autocomplete, category) THEN 3 ELSE 0 END + s1 + s2 + s3 + s4 + s5 + s6 AS score FROM signals)
  SELECT id, claimed, score, CASE WHEN score >= 5 THEN 'DETECTED' WHEN score >= 3 THEN 'UNCERTAIN' ELSE 'NOT_DETECTED' END AS verdict,
    CAST(round(CASE WHEN score <= 0 THEN 0 WHEN score >= 5 THEN least(0.95, 0.75 + 0.05 * (score - 5)) ELSE greatest(0.05, least(0.55, 0.15 * score)) END, 6) AS DOUBLE) AS score_confidence FROM sc""")
def d16_score_evidence(spark, sf):
    return V.score_evidence(candidates(spark, sf)).select("id", "claimed", "score", "verdict", "score_confidence")


LEAST_LENGTH = "CASE category WHEN 'UAN' THEN 12 WHEN 'PIN_CODE' THEN 6 END"


@query(f"WITH {CANDS} SELECT id, CASE WHEN value = '' THEN 'empty' WHEN length(regexp_replace(value, '[ -]', '', 'g')) < {LEAST_LENGTH} THEN 'partial' ELSE 'filled' END AS state FROM cands")
def d19_fill_state(spark, sf):
    return candidates(spark, sf).select("id", H.fill_state(F.col("category"), F.col("value")).alias("state"))


# ---- more of protection, actions and evaluation


@query(f"""WITH {DET}, n AS (SELECT unit_id, rule, category, span_start, origin, confidence, {normal_sql('category', 'value')} AS normalized FROM det), v AS (SELECT DISTINCT category, normalized FROM n WHERE origin < 'src5' AND confidence >= 0.6 AND category NOT IN ({', '.join(map(quoted, P.NEVER_TOKENS))}))
  SELECT n.unit_id, n.rule, n.span_start, n.normalized, v.normalized IS NOT NULL OR n.span_start % 2 = 0 AND CASE WHEN n.span_start % 3 = 0 THEN 'EMAIL' ELSE n.category END = 'CARD_NUMBER' AS needed_by_task FROM n LEFT JOIN v USING (category, normalized)""")
def p2_necessity(spark, sf):
    found = detections(spark, sf)
    at = F.col("span_start")
    targets = found.withColumns({"editable": at % 2 == 0, "field_category": F.when(at % 3 == 0, "EMAIL").otherwise(F.col("category"))})
    return P.necessity(targets, P.tokenize(found.where("origin < 'src5'"), key_of(spark)), ["CARD_NUMBER"]).select("unit_id", "rule", "span_start", "normalized", "needed_by_task")


REQUESTS = """req AS (SELECT category || '/' || normalized AS request_id, category, token, normalized, origins, CASE WHEN n % 7 = 0 THEN 'click' ELSE 'type' END AS action, CASE WHEN n % 5 = 0 THEN 'elsewhere' ELSE origins[1] END AS origin,
  CASE WHEN n % 11 = 0 THEN NULL WHEN n % 3 = 0 THEN 'NAME' ELSE category END AS field_category, n % 2 = 0 OR n > 12 AS consented FROM (SELECT *, length(normalized) AS n FROM vault))"""


@query(f"""WITH {DET}, {VAULT}, {REQUESTS}, r AS (SELECT *, CASE WHEN action <> 'type' THEN 'action' WHEN NOT consented THEN 'consent' WHEN coalesce(field_category, '') <> category THEN 'category' WHEN origin = 'elsewhere' THEN 'origin' END AS reason FROM req)
  SELECT request_id, CASE WHEN reason IS NULL THEN 'use ' || normalized || ' and ' || normalized END AS text, reason FROM r""")
def p7_rehydrate(spark, sf):
    held, n = vault(spark, sf), F.length("normalized")
    requests = held.select(
        F.concat("category", F.lit("/"), "normalized").alias("request_id"), F.when(n % 7 == 0, "click").otherwise("type").alias("action"), F.when(n % 5 == 0, "elsewhere").otherwise(F.col("origins")[0]).alias("origin"), F.lit("text").alias("input_type"),
        F.when(n % 11 == 0, None).when(n % 3 == 0, "NAME").otherwise(F.col("category")).alias("field_category"), ((n % 2 == 0) | (n > 12)).alias("consented"), F.concat(F.lit("use "), "token", F.lit(" and "), "token").alias("text"),
    )
    return P.rehydrate(requests, held)


@query(f"WITH {REDACTED} SELECT origin, CAST(sum(len(regexp_extract_all(text_redacted, '{P.TOKEN}'))) AS BIGINT) AS tokens, CAST(sum(strlen(text_redacted)) AS BIGINT) AS bytes FROM red GROUP BY origin")
def p18_carried(spark, sf):
    """Tokens and bytes that leave, by origin."""
    return P.carried(redacted(spark, sf).select("origin", F.col("text_redacted").alias("text")))


PLANNED = f"""named AS (SELECT d.*, v.token FROM decided d LEFT JOIN vault v ON v.category = d.category AND v.normalized = {normal_sql('d.category', 'd.value')} WHERE action <> 'ALLOW')"""


@query(f"""WITH {ORDERED}, {VAULT}, {PLANNED} SELECT unit_id, span_start, CASE WHEN action IN ('TOKEN', 'TOKEN_WITH_APPROVAL') THEN 'LABELLED_FILL' WHEN action IN ('BLUR', 'FILL_REGION') THEN action ELSE 'FILL' END AS mask,
  CASE WHEN action IN ('TOKEN', 'TOKEN_WITH_APPROVAL') THEN '[' || category || coalesce('#' || substr(token, length(token) - 9, 8), '') || ']' END AS label FROM named""")
def p12_mask_plan(spark, sf):
    found = detections(spark, sf)
    return P.mask_plan(decided(spark, sf, found), P.tokenize(found, key_of(spark))).select("unit_id", "span_start", "mask", "label")


@query(f"WITH {ORDERED}, {VAULT}, {PLANNED} SELECT unit_id, span_start, 'not_carried' AS fault FROM named WHERE action IN ('TOKEN', 'TOKEN_WITH_APPROVAL') AND token IS NOT NULL AND seq % 5 = 0")
def l7_labels_of_plans(spark, sf):
    """The labels of mask plans, checked against redactions of which every fifth was left out: their tokens are not in the text."""
    out, spans, held = faulty(spark, sf)
    carried = out.select("unit_id", F.explode(F.regexp_extract_all("text", F.lit(P.TOKEN), F.lit(0))).alias("token"))
    return L.bad_mask_labels(P.mask_plan(spans, held), held, carried)


WIDE = "translate({0}, '0123456789', '０１２３４５６７８９')"
SPELT = f"""spelt AS (SELECT c_custkey, unnest([{{{{'category': 'PHONE', 'plain': lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 10, '9')}}}}, {{{{'category': 'NAME', 'plain': 'josé ' || lower(c_name)}}}}, {{{{'category': 'CITY', 'plain': lower(c_mktsegment)}}}}]) AS v FROM customer)""".replace("{{", "{").replace("}}", "}")


@query(f"WITH {SPELT} SELECT c_custkey, v.category AS category, v.plain AS normalized FROM spelt")
def p5_compatible_forms(spark, sf):
    """Values in full-width digits, composed and decomposed letters and odd spaces, as they are compared."""
    k = F.col("c_custkey")
    phone = F.lpad((k * 7919 % 1000000000).cast("string"), 10, "9")
    values = F.array(
        F.struct(F.lit("PHONE").alias("category"), F.when(k % 2 == 0, F.translate(phone, "0123456789", "０１２３４５６７８９")).otherwise(phone).alias("value")),
        F.struct(F.lit("NAME").alias("category"), F.concat(F.when(k % 2 == 0, "Jose\u0301").otherwise("JOSÉ"), F.when(k % 3 == 0, "\u3000").otherwise("  "), "c_name").alias("value")),
        F.struct(F.lit("CITY").alias("category"), F.translate("c_mktsegment", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ").alias("value")),
    )
    rows = table(spark, sf, "customer").select(k, F.inline(values))
    return rows.select(k, "category", P.normalize_value(F.col("category"), F.col("value")).alias("normalized"))


@query(f"""WITH {LABELS}, {LABELLED}, t AS (SELECT unit_id, label AS text FROM labelled), top AS (SELECT unit_id, category FROM {label_match_sql('t')} WHERE rank = 1)
  SELECT unit_id, CASE WHEN coalesce(category IN ('PASSWORD', 'OTP', 'CVV', 'UPI_PIN', 'SECRET'), FALSE) THEN NULL ELSE name END AS value, name <> '' AS has_value FROM labelled LEFT JOIN top USING (unit_id)""")
def p19_suppress_secret_values(spark, sf):
    fields = labelled(spark, sf)
    top = D.match_labels(fields.withColumnRenamed("label", "text"), R.load_labels(spark)).where("rank = 1")
    return P.suppress_secret_values(fields.select("unit_id", F.col("name").alias("value")), top)


@query(f"WITH {LABELS}, {LABELLED} SELECT unit_id, label AS value FROM labelled WHERE seq % 3 <> 2 AND {PLAIN.format(x='label')} NOT IN (SELECT phrase FROM labels_d) AND seq % 2 = 0 UNION ALL SELECT unit_id, name FROM labelled WHERE seq % 2 = 1")
def d10_drop_structural_values(spark, sf):
    rows, even = labelled(spark, sf), F.col("seq") % 2 == 0
    values = rows.select("unit_id", F.when(even, F.col("label")).otherwise(F.col("name")).alias("value"))
    labels_of = rows.select("unit_id", F.when(even & (F.col("seq") % 3 != 2), "other").otherwise(F.when(even, F.col("label")).otherwise("other")).alias("label"))
    return D.drop_structural_values(values, labels_of, R.load_labels(spark))


@query(f"""WITH {FOUND} SELECT unit_id, category, span_start, span_end, CAST(0.65 AS DOUBLE) AS confidence FROM truth t WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.category IN ('EMAIL', 'PAN') AND f.unit_id = t.unit_id AND t.span_start < f.span_end AND f.span_start < t.span_end)""")
def d17_residual_label_fallback(spark, sf):
    return D.residual_label_fallback(truth(spark, sf).select("unit_id", "category", "span_start", "span_end"), found(spark, sf).where("category in ('EMAIL', 'PAN')"))


@query()
def d8_detect_tags(spark, sf):
    return D.detect_tags(parts(spark, sf))


ACTS = """acts AS (SELECT session, step, (['wait', 'navigate', 'click', 'type', 'select'])[(fp % 5 + 1)::INT] AS action, (['Pay now', 'Open', 'please confirm it', 'Payment'])[(step % 4 + 1)::INT] AS label, step % 3 = 0 AS in_form,
  CASE WHEN fp % 7 = 0 THEN 'PASSWORD' WHEN fp % 7 = 1 THEN 'PAN' WHEN fp % 7 = 2 THEN 'EMAIL' END AS category, CASE WHEN fp % 7 = 0 THEN 'credential' WHEN fp % 7 = 1 THEN 'high' WHEN fp % 7 = 2 THEN 'medium' END AS class FROM log)"""


@query(f"""WITH {LOG}, {ACTS}, l AS (SELECT *, CASE WHEN action = 'wait' THEN 0 WHEN action = 'navigate' THEN 1 WHEN action = 'click' AND label IN ('Pay now', 'please confirm it') THEN 2 WHEN category = 'PASSWORD' THEN 3
    WHEN action IN ('type', 'select') AND class = 'high' THEN 4 WHEN action IN ('type', 'select') AND category IS NOT NULL THEN 5 WHEN action = 'click' AND in_form THEN 6 ELSE 7 END AS i FROM acts)
  SELECT session, step, (['L0', 'L1', 'L5', 'L4', 'L3', 'L3', 'L5', 'L2'])[i + 1] AS level, (['NO_DIRECT_CHANGE', 'NAVIGATE', 'COMMIT', 'CREDENTIAL', 'SENSITIVE_APPROVAL_REQUIRED', 'SENSITIVE_FIELD_OR_TOKEN', 'UNKNOWN_FORM_BUTTON', 'LOCAL_CONTROL'])[i + 1] AS reason, i IN (2, 3, 4, 6) AS requires_user FROM l""")
def a3_authority_level(spark, sf):
    k, pick = F.col("fp"), lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    seven = lambda a, b, c: F.when(k % 7 == 0, a).when(k % 7 == 1, b).when(k % 7 == 2, c)
    rows = log(spark, sf).select("session", "step", pick(("wait", "navigate", "click", "type", "select"), k % 5).alias("action"), pick(("Pay now", "Open", "please confirm it", "Payment"), F.col("step") % 4).alias("label"), (F.col("step") % 3 == 0).alias("in_form"), seven("PASSWORD", "PAN", "EMAIL").alias("category"), seven("credential", "high", "medium").alias("class"))
    return A.authority_level(rows)


@query(f"""WITH {LOG}, p AS (SELECT session, step, fp % 10 AS field, action AS token FROM log), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY session, field ORDER BY step DESC) = 1),
  m AS (SELECT session, token, bool_or(field % 2 = 0) AS met FROM l GROUP BY ALL) SELECT DISTINCT p.session, p.token FROM p LEFT JOIN m USING (session, token) WHERE NOT coalesce(met, FALSE)""")
def a5_unmet_requirements(spark, sf):
    placements = log(spark, sf).select("session", "step", (F.col("fp") % 10).alias("field"), F.col("action").alias("token"))
    return A.unmet_requirements(placements, placements.where("field % 2 = 0").select("session", "field").distinct())


@query(f"""WITH {LOG}, t AS (SELECT *, row_number() OVER (PARTITION BY session, fp ORDER BY step) AS n FROM log), r AS (SELECT session, fp, min(step) FILTER (verdict = 'pass') AS c, max(step) FILTER (verdict <> 'fail') AS d FROM t WHERE n <= 3 GROUP BY ALL)
  SELECT session, fp, coalesce(c, d, -1) AS step, CASE WHEN c IS NOT NULL THEN 'clean' WHEN d IS NOT NULL THEN 'complete' ELSE 'refused' END AS outcome FROM r""")
def a17_stable_captures(spark, sf):
    attempts = log(spark, sf).select("session", "fp", "step", (F.col("verdict") == "pass").alias("clean"), (F.col("verdict") != "fail").alias("complete"))
    return A.stable_captures(attempts).fillna(-1, "step")


@query(f"""WITH {LOG}, e AS (SELECT session, fp % 20 AS eid, min(fp) AS fp, count(*) % 5 <> 0 AS visible, count(*) % 7 <> 0 AS hittable, count(*) % 3 <> 0 AS enabled, max(fp) % 4 = 0 AS ambiguous, CASE fp % 20 % 7 WHEN 0 THEN 'OTP' WHEN 1 THEN 'EMAIL' WHEN 2 THEN 'PASSWORD' END AS category, CASE WHEN max(fp) % 2 = 0 THEN 'password' ELSE 'text' END AS input_type FROM log WHERE step % 4 <> 0 GROUP BY session, fp % 20),
  a AS (SELECT *, CASE action WHEN 'click' THEN 'click' WHEN 'signup' THEN 'type' WHEN 'view' THEN 'type' ELSE 'wait' END AS act, fp % 6 AS level, CASE step % 4 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PASSWORD' END AS token FROM log)
  SELECT * FROM (SELECT l.session, l.step, CASE WHEN e.fp IS NULL THEN 'missing' WHEN e.fp <> l.fp THEN 'changed' WHEN ambiguous AND level >= 3 THEN 'ambiguous' WHEN act IN ('click', 'type') AND NOT visible THEN 'not_visible' WHEN act IN ('click', 'type') AND NOT hittable THEN 'not_hittable'
    WHEN act IN ('click', 'type') AND NOT enabled THEN 'disabled' WHEN act = 'type' AND coalesce(category IN ('OTP', 'CVV', 'UPI_PIN', 'SECRET'), FALSE) THEN 'never_automated' WHEN act = 'type' AND token IS NOT NULL AND (coalesce(category, '') <> token OR token = 'PASSWORD' AND input_type <> 'password') THEN 'token_type' END AS fault
    FROM a l LEFT JOIN e ON e.session = l.session AND e.eid = l.fp % 20) WHERE fault IS NOT NULL""")
def a2_check_actions(spark, sf):
    rows, n, kind = log(spark, sf).withColumn("eid", F.col("fp") % 20), F.count(F.lit(1)), F.col("eid") % 7
    elements = rows.where("step % 4 <> 0").groupBy("session", "eid").agg(F.min("fp").alias("fp"), (n % 5 != 0).alias("visible"), (n % 7 != 0).alias("hittable"), (n % 3 != 0).alias("enabled"), (F.max("fp") % 4 == 0).alias("ambiguous"), F.when(F.max("fp") % 2 == 0, "password").otherwise("text").alias("input_type"))
    elements = elements.withColumn("category", F.when(kind == 0, "OTP").when(kind == 1, "EMAIL").when(kind == 2, "PASSWORD"))
    act = F.when(F.col("action") == "click", "click").when(F.col("action").isin("signup", "view"), "type").otherwise("wait")
    token = F.when(F.col("step") % 4 == 0, "EMAIL").when(F.col("step") % 4 == 1, "PASSWORD")
    return A.check_actions(rows.withColumns({"action": act, "level": F.col("fp") % 6, "token_category": token}), elements)


@query(f"""WITH {QUASI} SELECT unit_id, rule, span_start, 'TOKEN' AS before, 'ALLOW' AS after FROM spans s JOIN linked l ON l.origin = s.origin AND l.seq <= s.seq JOIN policy USING (category) WHERE class = 'quasi'""")
def e9_policy_ablation(spark, sf):
    """What linkability changes: decisions with it and without."""
    spans, policy = quasi(spark, sf), R.load_policy(spark)
    # labelled spans may be identities themselves, which would decide in its stead
    spans = spans.join(F.broadcast(policy.where("class = 'quasi'").select("category")), "category", "left_semi")
    return E.changed_decisions(P.decide(spans, policy), P.decide(spans, policy, k=1 << 30), ["unit_id", "rule", "span_start"])


@query(f"""WITH {HITS}, {WORSE}, t AS (SELECT *, CASE WHEN length(value) % 2 = 0 THEN 'labelled' ELSE 'misleading' END AS label, CASE WHEN span_start < 60 THEN 'table' ELSE 'prose' END AS construct FROM truth),
  h AS (SELECT DISTINCT * FROM worse), c AS (SELECT label, construct, CASE WHEN h.category = t.category THEN 1 ELSE 0 END AS tp, CASE WHEN h.category <> t.category THEN 1 ELSE 0 END AS fp, 0 AS fn FROM t JOIN h USING (unit_id, ann_id)
    UNION ALL SELECT label, construct, 0, 0, 1 FROM t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.unit_id = t.unit_id AND h.ann_id = t.ann_id AND h.category = t.category))
  SELECT label, construct, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {RATIOS} FROM c GROUP BY CUBE (label, construct)""")
def e17_faceted_metrics(spark, sf):
    t = truth(spark, sf).withColumns({"label": F.when(F.length("value") % 2 == 0, "labelled").otherwise("misleading"), "construct": F.when(F.col("span_start") < 60, "table").otherwise("prose")})
    return E.faceted_metrics(t, worse(spark, sf))


@query(f"""WITH {REDACTED} SELECT origin, count(*) AS n_units, CAST(sum(n_redacted) AS BIGINT) AS n_redacted, CAST(sum(length(text_redacted)) AS BIGINT) AS n_chars FROM red GROUP BY origin""")
def flagship_redaction(spark, sf):
    """Texts of every origin, redacted: units, redactions and characters left."""
    return redacted(spark, sf).groupBy("origin").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n_redacted").alias("n_redacted"), F.sum(F.length("text_redacted")).alias("n_chars"))
