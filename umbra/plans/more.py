"""More registered queries: fields and pages, known values, plans and claims, audit rows, ablation of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from umbra.functions import rules as R
from umbra.operators import actions as A, audit as L, corpus as G, detect as D, evaluate as E, evidence as V, layers as Y, pages as H, protect as P
from umbra.plans.queries import (
    CONTEXT_UNITS, DET, FAULTY, GEN, HIDDEN, KNOWN, LABELLED, LABELS, LOG, POLICY, SHAPES, TOKEN_SQL, UNITS, VAULT, context_units, customers, detections, faulty, identifiers, known_values, label_match_sql, labelled, log, normal_sql, query, quoted, rendered, scan_sql, vault,
)
from umbra.sources.tables import stored, table, units

# ---- labels in running text and in fields

KEYED = """keyed AS (SELECT c_custkey, 'cust:' || c_custkey AS unit_id, 'Our records currently show ' || phrase || ': ' || c_name || ', and ' || c_mktsegment || ': x. Note: Ref: ' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '; Permanent account number : ABCPE' || c_custkey || ' until now' ELSE '' END AS text
  FROM customer JOIN labels_d ON ord = c_custkey % """ + str(len(R.label_rows())) + ")"


def keyed(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    rows = customers(spark, sf).join(F.broadcast(R.load_labels(spark).select("phrase", "ord")), F.col("ord") == k % len(R.label_rows()))
    tail = F.when(k % 2 == 0, F.concat(F.lit("; Permanent account number : ABCPE"), k, F.lit(" until now"))).otherwise("")
    return rows.select(F.concat(F.lit("cust:"), k).alias("unit_id"), F.concat(F.lit("Our records currently show "), "phrase", F.lit(": "), "c_name", F.lit(", and "), "c_mktsegment", F.lit(": x. Note: Ref: "), k, tail).alias("text"))


BOUND = rf"""pieces AS (SELECT unit_id, text, string_split(text, ':') AS p FROM {{source}}),
  colons AS (SELECT unit_id, text, p[i] AS piece, length(array_to_string(p[1:i], ':')) AS pos FROM (SELECT *, unnest(range(1, len(p))) AS i FROM pieces)),
  worded AS (SELECT *, string_split(trim(regexp_replace(regexp_extract(piece, '[^.,;\n]*$'), '\s+', ' ', 'g')), ' ') AS words FROM colons),
  tails AS (SELECT unit_id, pos, w, array_to_string(words[len(words) - w + 1:len(words)], ' ') AS text FROM (SELECT *, unnest(range(1, least(len(words), 6) + 1)) AS w FROM worded)),
  t AS (SELECT unit_id || '|' || pos || '|' || w AS unit_id, text FROM tails WHERE length(text) >= 2),
  top AS (SELECT split_part(unit_id, '|', 1) AS unit_id, split_part(unit_id, '|', 2)::INT AS pos, split_part(unit_id, '|', 3)::INT AS w, category, phrase_len FROM {label_match_sql('t')} WHERE rank = 1),
  best AS (SELECT unit_id, pos, arg_min(category, (-phrase_len, w)) AS category FROM top GROUP BY unit_id, pos),
  started AS (SELECT c.*, category, pos + 1 + length(regexp_extract(substr(text, pos + 2), '^\s*')) AS value_start FROM colons c JOIN best USING (unit_id, pos)),
  windowed AS (SELECT *, substr(text, value_start + 1, 64) AS win FROM started),
  valued AS (SELECT unit_id, category, pos, value_start, value_start + CASE WHEN regexp_matches(win, '(?s)^(.*?)(?:,\s+and\s+|[;.]\s+|[.;]\z)') THEN length(regexp_extract(win, '(?s)^(.*?)(?:,\s+and\s+|[;.]\s+|[.;]\z)', 1)) ELSE length(win) END AS value_end FROM windowed),
  nth AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY pos) AS r FROM valued WHERE value_end > value_start),
  f AS (SELECT *, TRUE AS kept, value_end AS cursor FROM nth WHERE r = 1
    UNION ALL SELECT n.*, n.pos >= f.cursor, CASE WHEN n.pos >= f.cursor THEN n.value_end ELSE f.cursor END FROM f JOIN nth n ON n.unit_id = f.unit_id AND n.r = f.r + 1)"""


@query(rf"""WITH RECURSIVE {LABELS}, {KEYED}, {BOUND.replace('{source}', 'keyed')}
  SELECT unit_id, category, CAST(pos AS INT) AS key_end, CAST(value_start AS INT) AS value_start, CAST(value_end AS INT) AS value_end FROM f WHERE kept""")
def d4_bind_inline_key_values(spark, sf):
    return D.bind_inline_key_values(keyed(spark, sf), R.load_labels(spark))


FIELDS = """fields AS (SELECT unit_id, l.seq // 10 AS page_id, l.seq AS eid, CASE WHEN seq % 11 = 0 THEN 'password' ELSE 'text' END AS input_type, CASE WHEN seq % 5 = 0 THEN (['EMAIL', 'PIN_CODE', 'CITY', 'NAME'])[(seq % 4 + 1)::INT] END AS autocomplete,
  CASE WHEN seq % 3 = 0 THEN label WHEN seq % 3 = 1 THEN 'misc' END AS f_name, CASE WHEN seq % 6 = 0 THEN 'Email address' WHEN seq % 3 = 1 THEN label ELSE 'xyz' END AS f_label, CASE WHEN seq % 3 = 2 THEN label END AS f_attr, CASE WHEN seq % 7 = 0 THEN '' ELSE l.name END AS value FROM labelled l)"""
SAID = f"""said AS (SELECT unit_id || '|' || place AS unit_id, text FROM (SELECT unit_id, 0 AS place, f_name AS text FROM fields UNION ALL SELECT unit_id, 1, f_label FROM fields UNION ALL SELECT unit_id, 2, f_attr FROM fields) WHERE text <> ''),
  top AS (SELECT split_part(unit_id, '|', 1) AS unit_id, arg_min(category, split_part(unit_id, '|', 2)::INT) AS said FROM {label_match_sql('said')} WHERE rank = 1 GROUP BY 1),
  context AS (SELECT f.*, CASE WHEN input_type = 'password' THEN 'PASSWORD' WHEN autocomplete = 'PIN_CODE' THEN 'PIN_CODE' ELSE coalesce(said, autocomplete) END AS category FROM fields f LEFT JOIN top USING (unit_id))"""


def fields(spark, sf) -> DataFrame:
    k, rows = F.col("seq"), labelled(spark, sf)
    auto = F.element_at(F.array(*map(F.lit, ("EMAIL", "PIN_CODE", "CITY", "NAME"))), (k % 4 + 1).cast("int"))
    return rows.select(
        "unit_id", F.floor(k / 10).alias("page_id"), k.alias("eid"), F.when(k % 11 == 0, "password").otherwise("text").alias("input_type"), F.when(k % 5 == 0, auto).alias("autocomplete"),
        F.when(k % 3 == 0, F.col("label")).when(k % 3 == 1, "misc").alias("name"), F.when(k % 6 == 0, "Email address").when(k % 3 == 1, F.col("label")).otherwise("xyz").alias("label"),
        F.when(k % 3 == 2, F.col("label")).alias("attr"), F.when(k % 7 == 0, "").otherwise(F.col("name")).alias("value"),
    )


@query(f"WITH {LABELS}, {LABELLED}, {FIELDS}, {SAID} SELECT unit_id, category, CAST(0.7 AS DOUBLE) AS confidence FROM context WHERE value <> '' AND category IS NOT NULL")
def d9_field_context(spark, sf):
    return D.field_context(fields(spark, sf), R.load_labels(spark))


def typed(spark, sf) -> DataFrame:
    rows = fields(spark, sf)
    return rows.drop("category").join(D.field_context(rows, R.load_labels(spark)).select("unit_id", "category"), "unit_id", "left")


@query(f"""WITH {LABELS}, {LABELLED}, {FIELDS}, {SAID}, c AS (SELECT *, CASE WHEN value <> '' THEN category END AS known FROM context)
  SELECT page_id, CASE WHEN p AND n >= 3 THEN 'kyc_form' WHEN p THEN 'login' WHEN n >= 3 THEN 'form' END AS page_type FROM (SELECT page_id, bool_or(input_type = 'password') AS p, count(*) FILTER (known IN ({', '.join(map(quoted, H.IDENTITY_FIELDS))})) AS n FROM c GROUP BY page_id)""")
def h7_page_type(spark, sf):
    return H.page_type(typed(spark, sf))


FORMS = """forms AS (SELECT o_custkey AS page_id, o_orderkey AS eid, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 END AS form, o_orderkey % 3 = 0 AS in_search, CASE WHEN o_orderkey % 11 = 0 THEN 'password' ELSE 'search' END AS input_type, CASE WHEN o_orderkey % 13 = 0 THEN 'EMAIL' END AS category,
  CASE WHEN o_orderkey % 10 = 7 THEN 'https://other.example' WHEN o_orderkey % 10 > 2 THEN 'https://own.example' END AS action_origin, 'https://own.example' AS origin FROM orders)"""


@query(f"""WITH {FORMS}, f AS (SELECT page_id, form, bool_or(input_type = 'password' OR category IS NOT NULL) AS private, max(action_origin) AS action FROM forms WHERE form IS NOT NULL GROUP BY ALL)
  SELECT page_id, eid, CASE WHEN o.form IS NULL THEN TRUE ELSE NOT coalesce(action <> origin, FALSE) AND NOT private END AS safe FROM forms o LEFT JOIN f USING (page_id, form) WHERE in_search""")
def h11_safe_search_forms(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("page_id"), k.alias("eid"), F.when(k % 4 != 0, k % 5).alias("form"), (k % 3 == 0).alias("in_search"), F.when(k % 11 == 0, "password").otherwise("search").alias("input_type"), F.when(k % 13 == 0, "EMAIL").alias("category"),
        F.when(k % 10 == 7, "https://other.example").when(k % 10 > 2, "https://own.example").alias("action_origin"), F.lit("https://own.example").alias("origin"),
    )
    return H.safe_search_forms(rows)


# ---- pages made of customers: their parts are known

PAGE = (
    (0, "block", "h2", "heading", "'Account ' || c_custkey", "", None, ""), (1, "block", "dt", "term", "'Name'", "", None, ""), (2, "block", "dd", "definition", "c_name", "", None, ""), (3, "block", "th", "columnheader", "'City'", "t:1:1:1", None, ""),
    (4, "block", "th", "columnheader", "'Code'", "t:1:1:2", None, ""), (5, "block", "td", "cell", "c_mktsegment", "t:1:2:1", None, ""), (6, "block", "td", "cell", "'C-' || c_custkey", "t:1:2:2", None, ""), (7, "block", "legend", "legend", "'Contact'", "f:1", None, ""),
    (8, "block", "label", "label", "'Email'", "f:1", None, ""), (9, "element", "input", "textbox", "'Your email'", "email", None, ""), (10, "element", "input", "textbox", "''", "cc-csc", None, "autocomplete-cc,type-password"), (11, "element", "button", "button", "'Pay now'", "", None, ""),
    (12, "block", "p", "paragraph", "'Note ' || c_custkey", "", None, "data-private"), (13, "block", "p", "paragraph", "'Hidden ' || c_custkey", "", "display", ""), (14, "block", "p", "paragraph", "'Faint ' || c_custkey", "", "opacity", ""),
    (15, "element", "span", "button", "'More ' || c_custkey", "", None, ""), (16, "media", "img", "img", "'Face ' || c_custkey", "", None, ""),
)
PARTS = "parts AS (" + " UNION ALL ".join(f"SELECT c_custkey AS page_id, '{k}' AS kind, {i} AS seq, '{t}' AS tag, '{r}' AS role, {x} AS text, '{a}' AS attr, {quoted(h) if h else 'NULL'} AS hidden, '{m}' AS marks, {9 <= i <= 11} AS in_form FROM customer" for i, k, t, r, x, a, h, m in PAGE) + ")"


def made_parts(spark, sf) -> DataFrame:
    return H.page_parts(G.render_pages(customers(spark, sf)))


@query(f"WITH {PARTS} SELECT page_id, seq, tag, role, text, attr, hidden, marks FROM parts WHERE kind = 'block'")
def h1_blocks_of_made_pages(spark, sf):
    return H.text_blocks(made_parts(spark, sf))


@query(f"WITH {PARTS} SELECT page_id, seq, tag, role, text AS name, attr, hidden, marks, in_form FROM parts WHERE kind = 'element'")
def h2_elements_of_made_pages(spark, sf):
    return H.elements(made_parts(spark, sf))


@query(f"WITH {PARTS} SELECT page_id, seq, role AS kind, text AS alt, page_id || '.png' AS filename, hidden FROM parts WHERE kind = 'media'")
def h3_media_of_made_pages(spark, sf):
    return H.media(made_parts(spark, sf))


@query(f"WITH {PARTS} SELECT hidden AS reason, count(*) AS n FROM parts WHERE hidden IS NOT NULL GROUP BY hidden")
def h4_hidden_parts_of_made_pages(spark, sf):
    return made_parts(spark, sf).where("hidden is not null").groupBy(F.col("hidden").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PARTS} SELECT page_id, seq, CASE WHEN seq > 0 THEN 'Account ' || page_id END AS heading, CASE WHEN seq = 8 THEN 'Contact' END AS legend, CASE seq WHEN 5 THEN 'City' WHEN 6 THEN 'Code' END AS column_header FROM parts WHERE kind = 'block'""")
def h5_context_of_made_pages(spark, sf):
    return H.structural_context(H.text_blocks(made_parts(spark, sf))).select("page_id", "seq", "heading", "legend", "column_header")


@query(f"WITH {PARTS} SELECT page_id, seq, unnest(string_split(marks, ',')) AS mark FROM parts WHERE marks <> ''")
def h6_marks_of_made_pages(spark, sf):
    return made_parts(spark, sf).where("marks <> ''").select("page_id", "seq", F.explode(F.split("marks", ",")).alias("mark"))


@query(f"WITH {PARTS} SELECT page_id, seq, CASE seq WHEN 10 THEN 'PASSWORD' ELSE 'PRIVATE_GENERIC' END AS category, CASE seq WHEN 10 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM parts WHERE marks <> ''")
def d8_tags_of_made_pages(spark, sf):
    return D.detect_tags(made_parts(spark, sf))


@query(f"WITH {PARTS} SELECT page_id, seq, 'UNSCANNED_MEDIA' AS category, 1.0::DOUBLE AS confidence FROM parts WHERE kind = 'media'")
def d12_unscanned_media(spark, sf):
    return D.unscanned_media(H.media(made_parts(spark, sf)))


@query("""WITH shown AS (SELECT c_custkey AS page_id, c_name AS value FROM customer WHERE c_custkey % 10 <> 4 UNION SELECT c_custkey, 'C-' || c_custkey FROM customer WHERE c_custkey % 10 <> 4 UNION SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 4),
  told AS (SELECT c_custkey AS page_id, c_name AS value FROM customer UNION SELECT c_custkey, 'C-' || c_custkey FROM customer WHERE c_custkey % 10 <> 3 UNION SELECT c_custkey, c_mktsegment FROM customer)
  SELECT *, 'page' AS missing FROM (SELECT * FROM told EXCEPT SELECT * FROM shown) UNION ALL SELECT *, 'truth' FROM (SELECT * FROM shown EXCEPT SELECT * FROM told)""")
def g7_truth_agreement(spark, sf):
    """Values in terms and cells of the made pages against what was put there; some pages and some truths are left out."""
    k, rows = F.col("c_custkey"), customers(spark, sf)
    shown = H.text_blocks(H.page_parts(G.render_pages(rows.where(k % 10 != 4)))).where("role in ('definition', 'cell')").select("page_id", F.col("text").alias("value"))
    told = rows.select(k.alias("page_id"), F.explode(F.array_compact(F.array("c_name", F.when(k % 10 != 3, F.concat(F.lit("C-"), k)), "c_mktsegment"))).alias("value"))
    return G.truth_agreement(shown, told)


# ---- known values, what goes out

SPACED = r"array_to_string(string_split(digits, ''), '[\s,./()-]*')"


@query(rf"""WITH {DET}, hidden AS (SELECT * FROM det), outgoing AS (SELECT unit_id, text FROM units), {KNOWN},
  asked AS (SELECT DISTINCT b.unit_id, f.category, f.normalized, '(?i)\Q' || form || '\E' AS pattern FROM bared b JOIN forms f ON length(f.form) >= {L.MIN_CHARS} AND contains(b.low, f.form)
    UNION SELECT DISTINCT u.unit_id, f.category, f.normalized, {SPACED} FROM units u JOIN forms f ON length(f.digits) >= {L.MIN_DIGITS} AND contains(regexp_replace(u.text, '[^0-9]', '', 'g'), f.digits)),
  found AS (SELECT a.*, regexp_extract_all(u.text, pattern) AS m, string_split_regex(u.text, pattern) AS g FROM asked a JOIN units u USING (unit_id)),
  spans AS (SELECT DISTINCT unit_id, category, normalized, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i], '')) AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
  r AS (SELECT *, max(e) OVER (PARTITION BY unit_id, category, normalized ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)
  SELECT unit_id, category, normalized, CAST(s AS INT) AS span_start, CAST(e AS INT) AS span_end FROM r WHERE reach IS NULL OR e > reach""")
def d11_scan_known_values(spark, sf):
    return L.scan_known_values(units(spark, sf), known_values(detections(spark, sf)))


@query(f"""WITH {FAULTY}, listed AS (SELECT DISTINCT d.category, d.value, coalesce(token, '[REDACTED:' || d.category || ']') AS rep FROM decided d LEFT JOIN vault v ON v.category = d.category AND v.normalized = {normal_sql('d.category', 'd.value')} WHERE action <> 'ALLOW' AND length(d.value) >= 7),
  ordered_values AS (SELECT *, row_number() OVER (ORDER BY category, value) AS nth FROM listed),
  hit AS (SELECT unit_id, text_redacted AS text, list({{'t': value, 'r': rep}} ORDER BY nth) AS v FROM red JOIN ordered_values ON contains(text_redacted, value) GROUP BY ALL),
  done AS (SELECT unit_id, list_reduce(list_prepend({{'t': text, 'r': ''}}, v), lambda a, b: {{'t': array_to_string(list_transform(range(1, len(string_split_regex(a.t, '{TOKEN_SQL}')) + 1), lambda i: replace(string_split_regex(a.t, '{TOKEN_SQL}')[i], b.t, b.r) || coalesce(regexp_extract_all(a.t, '{TOKEN_SQL}')[i], '')), ''), 'r': ''}}) AS x FROM hit)
  SELECT unit_id, x.t AS text FROM done""")
def p10_replace_known(spark, sf):
    """Values that were left in every fifth unit, replaced wherever they stand."""
    out, spans, held = faulty(spark, sf)
    normal = P.normalize_value(F.col("category"), F.col("value"))
    values = spans.where("action <> 'ALLOW' and length(value) >= 7").withColumn("normalized", normal).join(held.select("category", "normalized", "token"), ["category", "normalized"], "left")
    listed = stored(values.select("category", "value", F.coalesce("token", F.concat(F.lit("[REDACTED:"), "category", F.lit("]"))).alias("replacement")).distinct())
    leaks = L.known_value_leaks(out, listed.select("category", F.col("value").alias("normalized"))).withColumnRenamed("normalized", "value")
    asked = leaks.join(listed, ["category", "value"]).select("unit_id", F.struct("category", "value").alias("nth"), "value", "replacement")
    texts = out.select("unit_id", "text").join(asked.select("unit_id").distinct(), "unit_id", "left_semi")
    changed = P.replace_known(texts, asked.join(texts, "unit_id").where(F.contains("text", "value")).drop("text"))
    return changed.join(texts.withColumnRenamed("text", "__was"), "unit_id").where("text <> __was").select("unit_id", "text")


ELEMENTS = """elements AS (SELECT o_orderkey AS eid, o_orderkey % 1000 AS fp, o_orderstatus AS role, 'Field ' || o_orderkey AS label, o_orderkey % 100 * 10 AS x, o_orderkey % 97 AS y, o_orderkey % 3 <> 0 AS visible, o_orderkey % 5 = 0 AS hidden_interactive, o_orderkey % 7 <> 0 AS enabled,
  CASE WHEN o_orderkey % 11 = 0 THEN 'password' ELSE 'text' END AS input_type, o_orderkey % 2 = 0 AS has_value, CASE o_orderkey % 13 WHEN 0 THEN 'OTP' WHEN 1 THEN 'EMAIL' END AS category, (['empty', 'short', 'medium', 'long'])[(o_orderkey % 4 + 1)::INT] AS bucket, CASE WHEN o_orderkey % 13 = 1 THEN '[[PII:EMAIL:abcdefgh]]' END AS token FROM orders)"""


@query(f"""WITH {ELEMENTS} SELECT eid, fp, role, label, visible, CASE WHEN visible THEN x ELSE 0 END AS x, CASE WHEN visible THEN y ELSE 0 END AS y, visible AND enabled AS enabled, CASE WHEN visible THEN input_type END AS input_type, CASE WHEN visible THEN has_value END AS has_value,
  CASE WHEN visible AND coalesce(category, '') <> 'OTP' AND input_type <> 'password' THEN bucket END AS bucket, CASE WHEN visible THEN token END AS token, NOT visible AS hidden_interactive FROM elements WHERE visible OR hidden_interactive""")
def p14_outbound_projection(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k.alias("eid"), (k % 1000).alias("fp"), F.col("o_orderstatus").alias("role"), F.concat(F.lit("Field "), k).alias("label"), (k % 100 * 10).alias("x"), (k % 97).alias("y"), (k % 3 != 0).alias("visible"), (k % 5 == 0).alias("hidden_interactive"), (k % 7 != 0).alias("enabled"),
        F.when(k % 11 == 0, "password").otherwise("text").alias("input_type"), (k % 2 == 0).alias("has_value"), F.when(k % 13 == 0, "OTP").when(k % 13 == 1, "EMAIL").alias("category"),
        F.element_at(F.array(*map(F.lit, ("empty", "short", "medium", "long"))), (k % 4 + 1).cast("int")).alias("bucket"), F.when(k % 13 == 1, "[[PII:EMAIL:abcdefgh]]").alias("token"),
    )
    return P.outbound_projection(rows)


@query("""WITH t AS (SELECT 'conv:' || conv_id AS origin, string_agg('- ' || coalesce(text, ''), chr(10) ORDER BY turn) AS a FROM conversations GROUP BY conv_id),
  h AS (SELECT 'conv:' || user_id AS origin, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
  b AS (SELECT origin, string_agg('* ' || step || ' ' || event_type || ' ' || CASE WHEN event_id % 3 = 0 THEN 'pass' WHEN event_id % 7 = 0 THEN 'retry' ELSE 'fail' END, chr(10) ORDER BY step) AS b FROM h WHERE r <= 5 GROUP BY origin)
  SELECT origin, CASE WHEN b IS NULL THEN a ELSE a || chr(10) || b END AS context FROM t LEFT JOIN b USING (origin)""")
def p16_render_context(spark, sf):
    steps = log(spark, sf).select(F.concat(F.lit("conv:"), "session").alias("origin"), F.col("step").cast("long").alias("step"), "action", "verdict")
    return P.render_context(units(spark, sf).where("unit_id like 'conv:%'"), steps)


@query(f"""WITH {UNITS}, c AS (SELECT *, count(*) OVER w AS n, sum(length(text)) OVER w AS total FROM units WHERE unit_id LIKE 'conv:%' OR unit_id LIKE 'page:%' WINDOW w AS (PARTITION BY origin ORDER BY seq, unit_id ROWS UNBOUNDED PRECEDING))
  SELECT origin, unit_id, substr(text, 1, (2000 - (total - length(text)))::BIGINT) AS text FROM c WHERE n <= 40 AND total - length(text) < 2000""")
def p15_text_window(spark, sf):
    return P.text_window(units(spark, sf).where("unit_id like 'conv:%' or unit_id like 'page:%'"))


LOOKALIKE = "planted AS (SELECT category || '/' || normalized AS unit_id, CASE length(normalized) % 3 WHEN 0 THEN 'see ' || token || ' now' WHEN 1 THEN 'see ' || replace(lower(token), ':', ' : ') || '!' ELSE 'see nothing' END AS text FROM vault)"


@query(rf"""WITH {DET}, {VAULT}, {LOOKALIKE} SELECT unit_id, CASE WHEN text = 'see nothing' THEN text WHEN text LIKE '%!' THEN 'see [removed]!' ELSE 'see [removed] now' END AS text FROM planted""")
def p8_neutralize(spark, sf):
    n, token = F.length("normalized") % 3, F.col("token")
    text = F.when(n == 0, F.concat(F.lit("see "), token, F.lit(" now"))).when(n == 1, F.concat(F.lit("see "), F.replace(F.lower(token), F.lit(":"), F.lit(" : ")), F.lit("!"))).otherwise("see nothing")
    return vault(spark, sf).select(F.concat("category", F.lit("/"), "normalized").alias("unit_id"), P.neutralize(text).alias("text"))


# ---- audit

CANONICAL = "'origin:' || strlen(origin) || ':' || origin || chr(10) || 'text:' || coalesce(strlen(text), -1) || ':' || coalesce(text, '') || chr(10) || 'unit_id:' || strlen(unit_id) || ':' || unit_id || chr(10)"


@query(f"WITH {UNITS} SELECT unit_id FROM units WHERE length(text) % 7 = 0 AND text <> '' OR length(text) % 11 = 3 UNION ALL SELECT 'new:' || unit_id FROM units WHERE length(text) % 13 = 5")
def l9_digest_mismatch(spark, sf):
    """Rows of which a character was changed on the way, rows that were lost and rows that were added."""
    rows = units(spark, sf).select("unit_id", "origin", "text")
    changed = F.when(F.length("text") % 7 == 0, F.concat(F.lit("x"), F.expr("substring(text, 2)"), F.lit("y"))).otherwise(F.col("text"))
    arrived = rows.where("length(text) is null or length(text) % 11 <> 3").withColumn("text", F.when(F.col("text") == "", F.col("text")).otherwise(changed))
    added = rows.where("length(text) % 13 = 5").withColumn("unit_id", F.concat(F.lit("new:"), "unit_id"))
    return L.digest_mismatch(L.digests(rows), arrived.unionByName(added))


@query(f"""WITH {FAULTY}, {HIDDEN}, sent AS (SELECT unit_id, origin, text_redacted AS text FROM red), counts AS (SELECT unit_id, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM (SELECT unit_id, category, count(*) AS n FROM decided GROUP BY ALL) GROUP BY unit_id)
  SELECT unit_id, sha256({CANONICAL}) AS digest, CASE WHEN unit_id IN (SELECT unit_id FROM hidden WHERE seq % 5 = 0) THEN 'coverage' ELSE 'SEALED' END AS verdict, coalesce(categories, '') AS categories FROM sent LEFT JOIN counts USING (unit_id)""")
def s8_audit_rows(spark, sf):
    """What the audit keeps of each unit; L.append_audit adds such rows to a table."""
    out, spans, _ = faulty(spark, sf)
    hidden = spans.where("action <> 'ALLOW'").select("unit_id", "span_start", "span_end").distinct()
    left_out = L.coverage_gaps(hidden, spans.where("seq % 5 <> 0").select("unit_id", "span_start", "span_end"))
    rows = L.audit_rows(spans.select("unit_id", "category"), L.seal_verdict(out, L.union_failures({"coverage": left_out})), L.digests(out.select("unit_id", "origin", "text")))
    counts = F.transform(F.array_sort(F.map_entries("category_counts")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return rows.select("unit_id", "digest", "verdict", F.array_join(counts, ",").alias("categories"))


@query("""WITH a AS (SELECT event_id AS row_id, event_id % 17 = 0 AS c, event_id % 19 = 0 AS d, event_id % 23 = 0 AS l, event_id % 29 = 0 AS t FROM events)
  SELECT row_id, concat_ws(',', CASE WHEN c THEN 'category' END, CASE WHEN d THEN 'digest' END, CASE WHEN l THEN 'level' END, CASE WHEN t THEN 'timing' END) AS faults FROM a WHERE c OR d OR l OR t""")
def a11_invalid_audit_rows(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select(
        k.alias("row_id"), F.create_map(F.when(k % 17 == 0, "SHOE_SIZE").otherwise("EMAIL"), F.lit(1)).alias("category_counts"), F.when(k % 19 == 0, "abc").otherwise(F.sha2(k.cast("string"), 256)).alias("digest"),
        F.when(k % 23 == 0, "L9").otherwise("L2").alias("level"), F.create_map(F.lit("sealMs"), F.when(k % 29 == 0, -1.0).otherwise(2.5)).alias("timings"),
    )
    return L.invalid_audit_rows(rows, ["EMAIL", "PHONE"])


KINDS = ("text_span", "side_channel", "block")


@query(f"""WITH {UNITS} SELECT unit_id, 'origin' AS fault FROM units WHERE NOT regexp_matches(origin, '^[a-z0-9.:-]+$') UNION ALL SELECT unit_id, 'target_kind' FROM units WHERE target_kind NOT IN ({', '.join(map(quoted, KINDS))})
  UNION ALL SELECT unit_id, 'text' FROM units WHERE coalesce(length(text), 9999) > 4000 UNION ALL SELECT unit_id, 'extra:seq' FROM units""")
def l1_validate_schema(spark, sf):
    """Units as payloads under a schema that knows no titles, no long texts and no numbers."""
    rules = {"origin": F.col("origin").rlike("^[a-z0-9.:-]+$"), "target_kind": F.col("target_kind").isin(*KINDS), "text": F.length("text") <= 4000}
    return L.schema_faults(units(spark, sf), rules, ("unit_id", "origin", "target_kind", "text"))


@query(r"""WITH p AS (SELECT 'conv:' || conv_id AS unit_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
  SELECT unit_id, 'body.texts[' || i || '].text' AS path, text AS value FROM p WHERE text IS NOT NULL UNION ALL SELECT DISTINCT unit_id, 'body.page.title', 'Talk of ' || unit_id FROM p""")
def l2_json_leaves(spark, sf):
    """Conversations as nested payloads; what the protocol itself says is left out."""
    texts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf, "conversations").groupBy(F.concat(F.lit("conv:"), "conv_id").alias("unit_id")).agg(texts.alias("texts"))
    payload = F.struct(F.struct(F.concat(F.lit("Talk of "), "unit_id").alias("title"), F.lit(2).alias("version")).alias("page"), "texts")
    return L.json_leaves(rows.select("unit_id", F.lit("s/2").alias("schema"), payload.alias("body")), r"^schema$|\.role$")


TURN = f"translate({{0}}, '{P.BASE32}', '{P.BASE32[1:] + P.BASE32[:1]}')"
MASKS = f"""masks AS (SELECT *, substr(token, length(token) - 9, 8) AS code, length(normalized) AS n FROM vault),
named AS (SELECT category || '/' || normalized AS unit_id, n AS span_start, category, CASE n % 5 WHEN 0 THEN '[my own words]' WHEN 1 THEN '[' || category || '#' || {TURN.format('code')} || ']' WHEN 2 THEN '[' || category || ']' ELSE '[' || category || '#' || code || ']' END AS label, token, n % 2 = 0 AS carried FROM masks)"""


@query(f"""WITH {DET}, {VAULT}, {MASKS} SELECT unit_id, span_start, CASE WHEN span_start % 5 = 0 THEN 'vocabulary' WHEN span_start % 5 = 1 THEN 'other_token' ELSE 'not_carried' END AS fault FROM named WHERE span_start % 5 <> 2 AND (span_start % 5 < 2 OR NOT carried)""")
def l7_bad_mask_labels(spark, sf):
    n, held = F.length("normalized"), vault(spark, sf)
    code = F.expr("substring(token, length(token) - 9, 8)")
    of = lambda c: F.concat(F.lit("["), "category", F.lit("#"), c, F.lit("]"))
    label = F.when(n % 5 == 0, "[my own words]").when(n % 5 == 1, of(F.translate(code, P.BASE32, P.BASE32[1:] + P.BASE32[:1]))).when(n % 5 == 2, F.concat(F.lit("["), "category", F.lit("]"))).otherwise(of(code))
    masks = held.select(F.concat("category", F.lit("/"), "normalized").alias("unit_id"), n.alias("span_start"), "category", label.alias("label"), "token")
    return L.bad_mask_labels(masks, held, masks.where("span_start % 2 = 0").select("unit_id", "token"))


# ---- plans and claims

CLAIMS = f"""{LOG}, claims AS (SELECT session, step, CASE WHEN fp % 4 = 0 THEN 'done' ELSE 'click' END AS action, fp % 20 AS eid, CASE WHEN fp % 3 = 0 THEN TRUE END AS visible, CASE WHEN step % 4 = 0 THEN step % 8 = 0 END AS enabled, CAST(NULL AS BOOLEAN) AS has_value,
  CASE WHEN step % 5 = 0 THEN 'Order ' || fp % 3 END AS text_present, CASE fp % 7 WHEN 0 THEN '/' WHEN 1 THEN '/page/' END AS url_path_prefix FROM log),
now AS (SELECT session, fp % 20 AS eid, count(*) % 2 = 0 AS e_visible, count(*) % 3 = 0 AS e_enabled FROM log WHERE step % 4 <> 0 GROUP BY session, fp % 20)"""


@query(f"""WITH {CLAIMS}, h AS (SELECT c.session, c.step, action, url_path_prefix, list_filter([CASE WHEN visible IS NOT NULL THEN coalesce(e_visible, FALSE) = visible END, CASE WHEN enabled IS NOT NULL THEN coalesce(e_enabled, FALSE) = enabled END,
    CASE WHEN text_present IS NOT NULL THEN contains('order ' || c.session % 3, lower(text_present)) END, CASE WHEN url_path_prefix IS NOT NULL THEN starts_with('/page/' || c.session, url_path_prefix) END], lambda x: x IS NOT NULL) AS s FROM claims c LEFT JOIN now n ON n.session = c.session AND n.eid = c.eid)
  SELECT session, step, CASE WHEN len(s) = 0 THEN 'UNVERIFIABLE' WHEN NOT list_bool_and(s) THEN 'FAIL' WHEN action = 'done' AND len(s) = 1 AND coalesce(url_path_prefix IN ('', '/'), FALSE) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM h""")
def a4_verify_expectations(spark, sf):
    rows, fp = log(spark, sf), F.col("fp")
    claims = rows.select(
        "session", "step", F.when(fp % 4 == 0, "done").otherwise("click").alias("action"), (fp % 20).alias("eid"), F.when(fp % 3 == 0, F.lit(True)).alias("visible"), F.when(F.col("step") % 4 == 0, F.col("step") % 8 == 0).alias("enabled"),
        F.lit(None).cast("boolean").alias("has_value"), F.when(F.col("step") % 5 == 0, F.concat(F.lit("Order "), fp % 3)).alias("text_present"), F.when(fp % 7 == 0, "/").when(fp % 7 == 1, "/page/").alias("url_path_prefix"),
    )
    now = rows.where("step % 4 <> 0").groupBy("session", (fp % 20).alias("eid")).agg((F.count(F.lit(1)) % 2 == 0).alias("visible"), (F.count(F.lit(1)) % 3 == 0).alias("enabled"), F.lit(False).alias("has_value"))
    pages = rows.select("session").distinct().select("session", F.concat(F.lit("/page/"), "session").alias("path"), F.concat(F.lit("order "), F.col("session") % 3).alias("text"))
    return A.verify_expectations(claims, now, pages)


PLANS = f"""{LOG}, plans AS (SELECT session, step, CASE WHEN fp % 9 = 0 THEN 2 ELSE 1 END AS variants, fp % 7 AS n_actions, digest = 1 AS stale, step % 6 = 1 AS has_steps, CASE fp % 5 WHEN 0 THEN 'https://x.example/[[PII:EMAIL:abcdefgh]]' WHEN 1 THEN 'ftp://x.example' WHEN 2 THEN 'HTTPS://x.example' END AS url,
  CASE WHEN fp % 8 = 3 THEN 'pay [[PII:PAN:abcdefgh]]' END AS value, CASE WHEN fp % 16 = 5 THEN '[[PII:PAN:abcdefgh]]' END AS key, CASE WHEN step % 2 = 0 THEN 'navigate' ELSE 'type' END AS action FROM log)"""


@query(rf"""WITH {PLANS}, s AS (SELECT *, coalesce(max(has_steps::INT) OVER (PARTITION BY session ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM plans)
  SELECT * FROM (SELECT session, step, CASE WHEN variants <> 1 OR n_actions > 5 THEN 'INVALID_SCHEMA' WHEN stale THEN 'STALE_PLAN' WHEN has_steps AND seen THEN 'PLAN_STEPS_REPEATED' WHEN url LIKE '%[[PII:%' THEN 'TOKEN_IN_URL' WHEN value IS NOT NULL THEN 'TOKEN_OUTSIDE_TYPE'
    WHEN key IS NOT NULL THEN 'TOKEN_IN_KEY' WHEN action = 'navigate' AND NOT coalesce(regexp_matches(lower(url), '^https?://[^/]'), FALSE) THEN 'UNSUPPORTED_URL' END AS fault FROM s) WHERE fault IS NOT NULL""")
def a1_check_plans(spark, sf):
    fp = F.col("fp")
    plans = log(spark, sf).select(
        "session", "step", F.when(fp % 9 == 0, 2).otherwise(1).alias("variants"), (fp % 7).alias("n_actions"), (F.col("digest") == 1).alias("stale"), (F.col("step") % 6 == 1).alias("has_steps"),
        F.when(fp % 5 == 0, "https://x.example/[[PII:EMAIL:abcdefgh]]").when(fp % 5 == 1, "ftp://x.example").when(fp % 5 == 2, "HTTPS://x.example").alias("url"),
        F.when(fp % 8 == 3, "pay [[PII:PAN:abcdefgh]]").alias("value"), F.when(fp % 16 == 5, "[[PII:PAN:abcdefgh]]").alias("key"), F.when(F.col("step") % 2 == 0, "navigate").otherwise("type").alias("action"),
    )
    return A.check_plans(plans)


# ---- layers

POINTS = {"currency": 3, "digits_12": 1, "digits_9_18": 1, "voter": 3, "pin": 1, "date": 3, "bearer": 5, "opaque": 1}
LAYER = f"""{CONTEXT_UNITS}, {SHAPES.replace('FROM units WHERE', 'FROM ctx WHERE')}, k AS (SELECT *, lower(regexp_replace(v, '\\s', '', 'g')) AS n FROM shapes), counted AS (SELECT k.*, c.n_targets FROM k JOIN (SELECT origin, n, count(DISTINCT unit_id) AS n_targets FROM k GROUP BY origin, n) c ON c.origin = k.origin AND c.n = k.n),
scored AS (SELECT unit_id, rule, category, span_start, span_end, CASE rule {' '.join(f"WHEN '{r}' THEN {n}" for r, n in POINTS.items())} END - CASE WHEN {' OR '.join(f"regexp_matches(trim(v), {quoted(x)})" for x in V.SHAPES)} THEN 3 ELSE 0 END - CASE WHEN n_targets >= 3 THEN 2 ELSE 0 END
  - CASE WHEN category = 'SECRET' AND regexp_matches(trim(v), {quoted(V.USERNAME)}) THEN 2 ELSE 0 END AS score FROM counted)"""


@query(f"WITH {LAYER} SELECT unit_id, rule, category, span_start, span_end, 'added' AS change FROM scored WHERE score >= 3")
def e10_layer_ablation(spark, sf):
    """Spans that the evidence layer adds to those of the rules, over the same texts."""
    texts = context_units(spark, sf).select("unit_id", "origin", "text")
    base = D.scan(texts).select("unit_id", "rule", "category", "span_start", "span_end")
    strength = F.create_map(*[F.lit(x) for r, n in POINTS.items() for x in (r, {1: "weak", 3: "structured", 5: "self_describing"}[n])])
    none = F.lit(None).cast("string")
    shapes = D.repeat_index(stored(D.find_shapes(texts))).withColumns({"strength": strength[F.col("rule")], "checksum": none, "bound": none, "autocomplete": none, "container": none})
    more = V.score_evidence(shapes).where("verdict <> 'NOT_DETECTED'").select(*base.columns)
    return E.layer_changes(base, base.unionByName(more))


# ---- sources written and read again


def _folder(spark, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    import uuid

    stored(spark.range(0))  # a checkpoint folder is set or made
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type AS name, CAST((props->>'$.k')::INT AS INT) AS run_index, value AS latency_ms, event_id % 2 = 0 AS schema_valid FROM events")
def s6_read_probe_log(spark, sf):
    """A log of calls written as JSON lines and read under its closed schema."""
    from umbra.sources.tables import read_probe_log

    rows = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("int").alias("run_index"), F.col("value").alias("latency_ms"), (F.col("event_id") % 2 == 0).alias("schema_valid"), F.lit("x").alias("not_in_the_schema"))
    path = _folder(spark, "probe")
    rows.write.json(path)
    return read_probe_log(spark, path).select("name", "run_index", "latency_ms", "schema_valid")


@query(f"WITH {GEN} SELECT unit_id AS page, CAST(rank - 1 AS VARCHAR) AS element, category, value FROM ids")
def s5_read_truth(spark, sf):
    """Manifests of labelled items, one file of JSON lines a task, read and taken apart."""
    from umbra.sources.tables import read_truth

    items = F.transform("truth", lambda t, i: F.struct(i.cast("string").alias("elementId"), t.category.alias("category"), t.value.alias("value")))
    path = _folder(spark, "truth")
    rendered(spark, sf).select(F.col("unit_id").alias("page"), items.alias("items")).write.json(path)
    return read_truth(spark, path, lines=True).select("page", "element", "category", "value")


@query("SELECT page_id::VARCHAR AS capture_id, url, page_id % 9 = 0 AS corrupt FROM pages")
def s1_read_observations(spark, sf):
    """Captures as JSON lines, every ninth of them cut off, read with the broken records kept."""
    from umbra.sources.tables import read_observations

    k = F.col("page_id")
    whole = F.to_json(F.struct(k.cast("string").alias("capture_id"), "url"))
    path = _folder(spark, "observations")
    table(spark, sf, "pages").select(F.when(k % 9 == 0, F.regexp_replace(whole, r"\}$", "")).otherwise(whole).alias("value")).write.text(path)
    rows = read_observations(spark, path)
    raw = F.col("_corrupt_record")
    return rows.select(F.coalesce("capture_id", F.regexp_extract(raw, '"capture_id":"([^"]*)"', 1)).alias("capture_id"), F.coalesce("url", F.regexp_extract(raw, '"url":"([^"]*)"', 1)).alias("url"), raw.isNotNull().alias("corrupt"))


# ---- JSON of unknown shape


@query("""WITH payloads AS (SELECT 'conv:' || conv_id AS unit_id, to_json({'conv': conv_id, 'meta': {'first': min_by(role, turn), 'tags': [['t' || conv_id], ['x', 'y']]}, 'turns': list({'role': role, 'body': {'text': text, 'n': turn}} ORDER BY turn)}) AS payload FROM conversations GROUP BY conv_id)
  SELECT unit_id, substr(fullkey, 3) AS path, atom->>'$' AS value FROM payloads, json_tree(payload) WHERE type = 'VARCHAR'""")
def l2_variant_leaves(spark, sf):
    """The strings of conversations as JSON texts, whose shape the walk doesn't know."""
    body = F.struct("role", F.struct("text", F.col("turn").alias("n")).alias("body"))
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))), lambda x: x.b).alias("turns"))
    tags = F.array(F.array(F.concat(F.lit("t"), "conv_id")), F.array(F.lit("x"), F.lit("y")))
    payload = F.to_json(F.struct(F.col("conv_id").alias("conv"), F.struct("first", tags.alias("tags")).alias("meta"), "turns"), {"ignoreNullFields": "false"})
    return L.variant_leaves(turns.select(F.concat(F.lit("conv:"), "conv_id").alias("unit_id"), payload.alias("payload")))


# ---- names and places on pages

NAMED = (
    ("input", "textbox", "'Mail address'", "Mail address", "email", "email", None, True), ("input", "textbox", "'Account of ' || c_name || ' (' || c_custkey || ')'", "", "tel", None, None, True), ("input", "textbox", "'Street'", "Street", "text", "street-address", None, True),
    ("input", "textbox", "'Code ' || c_custkey", "", "text", None, None, True), ("input", "textbox", "'Town'", "", "text", None, None, True), ("input", "textbox", "'Left over'", "", "text", None, None, True), ("select", "combobox", "'Choice'", "Choice", None, None, None, True),
    ("a", "link", "'See order ' || c_custkey", "", None, None, "'/c/' || c_custkey", False), ("button", "button", "'(' || c_custkey || ')'", "", None, None, None, False), ("button", "button", "'Send'", "", None, None, None, False),
)


@query(" UNION ALL ".join(f"SELECT c_custkey AS page_id, '{t}' AS tag, '{r}' AS role, {n} AS name, '{lab}' AS label_text, {quoted(i) if i else 'NULL'} AS input_type, {quoted(a) if a else 'NULL'} AS autocomplete, {h or 'NULL'} AS href, {f} AS in_form FROM customer" for t, r, n, lab, i, a, h, f in NAMED))
def h2_named_elements(spark, sf):
    """Elements of forms that Spark makes of customers, with the names that ids, labels, texts and hints give them."""
    return H.named_elements(H.saying_parts(G.render_forms(customers(spark, sf)))).drop("seq", "hidden")


@query("""WITH RECURSIVE frames AS (SELECT c_custkey AS frame_id, CASE WHEN c_custkey % 97 = 0 OR c_custkey < 2 THEN NULL WHEN c_custkey % 89 = 0 THEN c_custkey ELSE c_custkey // 3 END AS parent_id, (c_custkey % 13 * 10)::DOUBLE AS x, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 7)::DOUBLE END AS y FROM customer),
  walk AS (SELECT frame_id, x AS dx, coalesce(y, 0) AS dy FROM frames WHERE parent_id IS NULL UNION ALL SELECT f.frame_id, w.dx + f.x, w.dy + coalesce(f.y, 0) FROM walk w JOIN frames f ON f.parent_id = w.frame_id)
  SELECT o_orderkey AS box_id, frame_id, dx + o_orderkey % 31 AS left, dy + o_orderkey % 17 AS top FROM orders JOIN walk ON frame_id = o_custkey""")
def h13_page_boxes(spark, sf):
    """Boxes in nested frames, placed on the page."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    parent = F.when((k % 97 == 0) | (k < 2), None).when(k % 89 == 0, k).otherwise(F.floor(k / 3))
    frames = table(spark, sf, "customer").select(k.alias("frame_id"), parent.alias("parent_id"), (k % 13 * 10).cast("double").alias("x"), F.when(k % 7 > 0, (k % 7).cast("double")).alias("y"))
    boxes = table(spark, sf, "orders").select(o.alias("box_id"), F.col("o_custkey").alias("frame_id"), (o % 31).cast("double").alias("x"), (o % 17).cast("double").alias("y"), F.lit(10.0).alias("w"), F.lit(5.0).alias("h"))
    return H.page_boxes(boxes, H.frame_offsets(frames)).select("box_id", "frame_id", "left", "top")


# ---- one detection by all layers

SCORE = f"CASE rule {' '.join(f'WHEN {quoted(r)} THEN {n}' for r, n in POINTS.items())} END + CASE WHEN bound IS NULL THEN 0 ELSE 3 END - CASE WHEN {' OR '.join(f'regexp_matches(trim(v), {quoted(x)})' for x in V.SHAPES)} THEN 3 ELSE 0 END - CASE WHEN n_targets >= 3 THEN 2 ELSE 0 END - CASE WHEN category = 'SECRET' AND regexp_matches(trim(v), {quoted(V.USERNAME)}) THEN 2 ELSE 0 END"
CUT = "substr(text, {0} + 1, {1} - {0})"
LAYERS = rf"""{GEN}, gen_units AS (SELECT unit_id, 'gen' AS origin, text || 'paid INR ' || regexp_extract(unit_id, '[0-9]+', 0) || ' on the way' AS text FROM rendered), {LABELS}, {BOUND.replace('{source}', 'gen_units')},
  bound AS (SELECT unit_id, category AS context, CAST(value_start AS INT) AS a, CAST(value_end AS INT) AS e FROM f WHERE kept),
  bvals AS (SELECT unit_id || '|' || a AS unit_id, origin, context, {CUT.format('a', 'e')} AS text FROM bound JOIN gen_units USING (unit_id)), bdob AS (SELECT unit_id, origin, 'DATE' AS context, text FROM bvals WHERE context = 'DOB'),
  in_context AS (SELECT * FROM ({scan_sql('bvals', R.CONTEXT_RULES)}) UNION ALL SELECT * REPLACE ('DOB' AS category) FROM ({scan_sql('bdob', tuple(r for r in R.CONTEXT_RULES if r.name == 'date'))})),
  by_rule AS ({scan_sql('gen_units')}),
  firm AS (SELECT * FROM by_rule UNION ALL SELECT split_part(unit_id, '|', 1), origin, 'context:' || rule, category, span_start + split_part(unit_id, '|', 2)::INT, span_end + split_part(unit_id, '|', 2)::INT, value, confidence FROM in_context),
  hidden AS (SELECT category, value FROM ids WHERE category IN ('EMAIL', 'ORDER_ID', 'PHONE') AND regexp_extract(unit_id, '[0-9]+', 0)::INT % 3 = 0), outgoing AS (SELECT unit_id, text FROM gen_units), {KNOWN},
  asked AS (SELECT DISTINCT b.unit_id, f.category, f.normalized, '(?i)\Q' || form || '\E' AS pattern FROM bared b JOIN forms f ON length(f.form) >= {L.MIN_CHARS} AND contains(b.low, f.form)
    UNION SELECT DISTINCT b.unit_id, f.category, f.normalized, {SPACED.replace('digits', 'f.digits')} FROM bared b JOIN forms f ON length(f.digits) >= {L.MIN_DIGITS} AND contains(b.digits, f.digits)),
  pieced AS (SELECT a.*, regexp_extract_all(u.text, pattern) AS m, string_split_regex(u.text, pattern) AS g FROM asked a JOIN gen_units u USING (unit_id)),
  stood AS (SELECT DISTINCT unit_id, category, normalized, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i], '')) AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM pieced)),
  reached AS (SELECT *, max(e) OVER (PARTITION BY unit_id, category, normalized ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stood),
  {SHAPES.replace('FROM units WHERE', 'FROM gen_units WHERE')}, counted AS (SELECT k.*, n_targets FROM (SELECT *, lower(regexp_replace(v, '\s', '', 'g')) AS n FROM shapes) k JOIN (SELECT origin, lower(regexp_replace(v, '\s', '', 'g')) AS n, count(DISTINCT unit_id) AS n_targets FROM shapes GROUP BY ALL) c ON c.origin = k.origin AND c.n = k.n),
  scored AS (SELECT *, {SCORE} AS score FROM (SELECT c.*, b.context AS bound FROM counted c LEFT JOIN bound b ON b.unit_id = c.unit_id AND c.span_start >= b.a AND c.span_end <= b.e)),
  layered AS (SELECT unit_id, origin, rule, category, span_start, span_end, value, confidence, confidence < 0.6 AS unsure FROM firm
    UNION ALL SELECT unit_id, origin, 'label', context, a, e, {CUT.format('a', 'e')}, 0.65, FALSE FROM bound b JOIN gen_units USING (unit_id) WHERE NOT EXISTS (SELECT 1 FROM firm x WHERE x.unit_id = b.unit_id AND x.span_start < b.e AND b.a < x.span_end)
    UNION ALL SELECT unit_id, origin, 'vault', category, s, e, {CUT.format('s', 'e')}, 1.0, FALSE FROM reached JOIN gen_units USING (unit_id) WHERE reach IS NULL OR e > reach
    UNION ALL SELECT unit_id, origin, 'evidence:' || rule, coalesce(bound, category), span_start, span_end, v, round(CASE WHEN score >= 5 THEN least(0.95, 0.75 + 0.05 * (score - 5)) ELSE least(0.55, 0.15 * score) END, 6), score < 5 FROM scored WHERE score >= 3),
  {POLICY}"""


def merge_sql(name: str, source: str) -> str:
    return f"""{name}_ranked AS (SELECT d.*, coalesce(risk_rank, 99) AS risk_rank FROM {source} d LEFT JOIN policy USING (category)),
  {name}_reach AS (SELECT *, max(span_end) OVER (PARTITION BY unit_id ORDER BY span_start, span_end, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}_ranked),
  {name}_islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR span_start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY span_start, span_end, rule) AS island FROM {name}_reach),
  {name} AS (SELECT unit_id, origin, min(span_start) AS span_start, max(span_end) AS span_end, arg_min(category, (unsure, category <> 'SECRET', risk_rank, span_start, rule)) AS category, round(1 - product(1 - confidence), 6) AS confidence,
    CASE WHEN bool_and(unsure) THEN 'uncertain' ELSE 'detected' END AS certainty, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, CASE WHEN max(span_end - span_start) = max(span_end) - min(span_start) THEN arg_max(value, span_end - span_start) END AS value FROM {name}_islands GROUP BY unit_id, origin, island)"""


def layered(spark, sf) -> DataFrame:
    """What all layers find in the generated texts, which end with an amount that no label names; every third customer's address, order and phone are known before."""
    amount = F.concat("text", F.lit("paid INR "), F.regexp_extract("unit_id", "[0-9]+", 0), F.lit(" on the way"))
    texts = rendered(spark, sf).select("unit_id", F.lit("gen").alias("origin"), amount.alias("text"))
    ids = identifiers(spark, sf).where("category in ('EMAIL', 'ORDER_ID', 'PHONE')").where(F.regexp_extract("unit_id", "[0-9]+", 0).cast("int") % 3 == 0)
    known = ids.select("category", P.normalize_value(F.col("category"), F.col("value")).alias("normalized"), "value").distinct()
    return Y.detect_layers(texts, R.load_labels(spark), known)


@query(f"WITH RECURSIVE {LAYERS}, {merge_sql('whole', 'layered')} SELECT * FROM whole")
def d18_merge_layers(spark, sf):
    return D.merge_spans(layered(spark, sf), R.load_policy(spark))


ARM = "SELECT unit_id, span_start, span_end, category, certainty FROM"


@query(f"""WITH RECURSIVE {LAYERS}, {merge_sql('whole', 'layered')}, plain AS (SELECT * FROM layered WHERE NOT starts_with(rule, 'evidence:')), {merge_sql('base', 'plain')}
  SELECT *, 'added' AS change FROM ({ARM} whole EXCEPT ALL {ARM} base) UNION ALL SELECT *, 'lost' FROM ({ARM} base EXCEPT ALL {ARM} whole)""")
def e10_whole_detections(spark, sf):
    """What the evidence layer changes in whole detections, of which each is merged for itself: spans it adds, and spans that go because they grow or get sure."""
    return E.signed_changes(whole_arms(layered(spark, sf), R.load_policy(spark)))


def whole_arms(spans: DataFrame, policy: DataFrame) -> DataFrame:
    """(side, unit_id, span_start, span_end, category, certainty): spans merged with the evidence layer (side 1) and without it (side -1), by one shuffle, so that they needn't be written to be read twice."""
    sides = F.when(F.col("source") == "evidence", F.array(F.lit(1))).otherwise(F.array(F.lit(-1), F.lit(1)))
    both = spans.withColumn("side", F.explode(sides)).withColumn("unit_id", F.struct("side", "unit_id")).drop("side")
    return D.merge_spans(both, policy).select("unit_id.side", "unit_id.unit_id", "span_start", "span_end", "category", "certainty")
