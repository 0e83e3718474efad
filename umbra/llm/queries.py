"""The registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from umbra.llm import decontamination, fingerprints, jaccard_join, language_id, lexical_search, line_dedup, mixing, nbsvm, periodic_runs, quality_rules, secrets, suffix_dedup, toxicity
from umbra.llm.common import WORD, table

SP = r"[\x20\x09-\x0D]"


def sha(text: str) -> F.Column:
    return F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, line_dedup.line_index(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", sha("text").alias("kept_sha256"))


OP1_CTES = rf"""
op1_lines AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM {{docs}})),
op1_keys AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^{SP}+', ''), '{SP}+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM op1_lines),
op1_counts AS (
  SELECT k, min(doc_id) AS first_doc FROM op1_keys WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
op1_marked AS (
  SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id > c.first_doc AS gone
  FROM op1_keys l LEFT JOIN op1_counts c ON c.k = l.k),
op1_out AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept_text
  FROM op1_marked GROUP BY doc_id)"""

OP1_SQL = f"WITH {OP1_CTES.replace('{docs}', 'documents')} SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM op1_out"


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


def _line_ok(x: str) -> str:
    """The rules of quality_rules.line_fails, said again for RE2: marks and phrases count by their share of the words."""
    word = r"[^\x20\x09-\x0D]+"
    noise, nav, end, plate, quoted = (v.replace("'", "''") for v in (quality_rules.NOISE, quality_rules.NAVIGATION, quality_rules.SENTENCE_END, quality_rules.BOILERPLATE, quality_rules.QUOTED))
    n = lambda text, pattern: f"len(regexp_extract_all({text}, '{pattern}'))"
    bare = f"regexp_replace({x}, '{quoted}', ' ', 'g')"
    menu = f"regexp_matches({x}, '{nav}') AND regexp_matches({bare}, '{nav}') AND {n(bare, '[|»›•]')} * {quality_rules.WORDS_A_SEPARATOR} >= {n(x, word)}"
    boilerplate = f"regexp_matches({x}, '{plate}') AND {n(x, plate)} * {quality_rules.WORDS_A_PHRASE} >= {n(x, word)}"
    stub = f"NOT regexp_matches({x}, '{end}') AND NOT regexp_matches({x}, '{word}{SP}+{word}{SP}+{word}')"
    return f"NOT (regexp_matches({x}, '{word}') AND ({n(x, noise)} * 10 > length({x}) OR {menu} OR {stub} OR {boilerplate}))"


OP3_CTES = rf"""
op3_words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {{docs}}),
op3_windows AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM op3_words)),
op3_repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM op3_windows) WHERE c > 1)
  GROUP BY doc_id),
op3_lines AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM op3_words))),
op3_judged AS (SELECT *, {_line_ok("line")} AS ok, regexp_matches(line, '[^\x20\x09-\x0D]') AS full_line FROM op3_lines),
op3_by_doc AS (
  SELECT doc_id, count(*) FILTER (full_line) - count(DISTINCT line) FILTER (full_line) AS n_dup_lines, count(*) FILTER (NOT ok) AS n_lines_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (ok), '') AS clean_text
  FROM op3_judged GROUP BY doc_id),
op3_counts AS (
  SELECT w.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines_removed, clean_text
  FROM op3_words w JOIN op3_by_doc USING (doc_id) LEFT JOIN op3_repeats USING (doc_id)),
op3_out AS (
  SELECT *, NOT base_failed AND 100 * length(regexp_replace(clean_text, '{SP}+', '', 'g')) >= {quality_rules.MIN_KEPT_PERCENT} * word_chars AS kept
  FROM (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM op3_counts))"""

OP3_SQL = f"WITH {OP3_CTES.replace('{docs}', 'documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed FROM op3_out"


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles_sql(name: str, source: str, key: str, lower: str) -> str:
    return rf"""
{name}_w AS (SELECT {key}, w FROM (SELECT {key}, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM {source}) WHERE len(w) > 0),
{name} AS (
  SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM {name}_w))"""


OP4_CTES = f"""{_shingles_sql("op4_docs", "{docs}", "doc_id", "lower(text)")},{_shingles_sql("op4_items", "benchmark", "item_id", "lower(text)")},
op4_sizes AS (SELECT item_id, count(*) AS n_item FROM op4_items GROUP BY item_id),
op4_out AS (
  SELECT doc_id, item_id, n_shared, n_item FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM op4_docs JOIN op4_items USING (s) GROUP BY doc_id, item_id)
  JOIN op4_sizes USING (item_id) WHERE 100 * n_shared >= 80 * n_item)"""

OP4_SQL = f"WITH {OP4_CTES.replace('{docs}', 'documents')} SELECT * FROM op4_out"


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP6_CTES = """
op6_weighed AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight FROM {docs} GROUP BY source),
op6_rates AS (SELECT source, weight / (SELECT sum(weight) FROM op6_weighed) * (SELECT sum(n) FROM op6_weighed) / n AS rate FROM op6_weighed),
op6_steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 25) AS BIGINT) + 1)) AS k FROM op6_rates),
op6_logs AS (SELECT *, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS lf FROM op6_steps),
op6_cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM op6_logs),
op6_drawn AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM {docs}),
op6_copies AS (
  SELECT d.*, unnest(range(0, (SELECT count(*) FROM op6_cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u))) AS copy FROM op6_drawn d),
op6_out AS (SELECT *, ('0x' || substr(md5('17/order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 15))::BIGINT AS order_key FROM op6_copies)"""

OP6_SQL = f"WITH {OP6_CTES.replace('{docs}', 'documents')} SELECT doc_id, source, text, copy, order_key FROM op6_out"


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


OP9_CTES = f"""{_shingles_sql("op9_s", "{docs}", "doc_id", ASCII_LOWER)},
op9_n AS (SELECT doc_id, count(*) AS n FROM op9_s GROUP BY doc_id),
op9_links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM op9_s x JOIN op9_s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN op9_n p ON p.doc_id = a JOIN op9_n q ON q.doc_id = b WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
op9_reach AS (
  SELECT doc_id AS a, doc_id AS b FROM {{docs}}
  UNION SELECT r.a, l.b FROM op9_reach r JOIN op9_links l ON l.a = r.b),
op9_out AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM {{docs}} d JOIN (SELECT a, min(b) AS c FROM op9_reach GROUP BY a) ON a = d.doc_id LEFT JOIN op9_n n ON n.doc_id = d.doc_id)"""

OP9_SQL = f"WITH RECURSIVE {OP9_CTES.replace('{docs}', 'documents')} SELECT doc_id, n_shingles, component_id FROM op9_out"


def op2_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.fit_and_predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.fit_and_predict(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.fit_and_predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = made.select("doc_id", "n_chars", "edited_text", F.col("fingerprint").alias("a"), F.col("edited_fingerprint").alias("b"), F.col("next.fingerprint").alias("c"))
    own, new = F.col("a"), F.col("b")
    return made.select(
        "doc_id", "n_chars", sha("edited_text").alias("edited_sha256"), fingerprints.as_text(own).alias("fingerprint"), fingerprints.as_text(new).alias("edited_fingerprint"),
        fingerprints.likeness(own, new).alias("near_edited"), fingerprints.likeness(own, F.col("c")).alias("near_next"),
    )


def _fingerprint_sql(text: str) -> str:
    words = rf"regexp_extract_all({ASCII_LOWER.replace('text', text, 1)}, '[^\x20\x09-\x0D]+')"
    return f"(SELECT list_sort(list_distinct(list_transform(range(1, len(w) + 1), lambda i: substr(md5(array_to_string(w[greatest(i - {fingerprints.N_WORDS - 1}, 1):i], ' ')), 1, 16)))) FROM (SELECT {words} AS w))"


def _likeness_sql(a: str, b: str) -> str:
    bound = f"least(greatest('{fingerprints.BOUND}', {a}[-1]), greatest('{fingerprints.BOUND}', {b}[-1]))"
    of = lambda x: f"list_filter({x}, lambda v: v <= {bound})"
    shared = f"len(list_intersect({of(a)}, {of(b)}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN (len({a}) = len({b}))::INT::DOUBLE ELSE {shared} / (len({of(a)}) + len({of(b)}) - {shared}) END"


def _kept_sql(h: str) -> str:
    below = f"list_filter({h}, lambda v: v < '{fingerprints.BOUND}')"
    return f"CASE WHEN len({below}) >= {fingerprints.LEAST} THEN {below} ELSE {h}[1:{fingerprints.LEAST}] END"


OP11_SQL = f"""WITH op11_docs AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents),
op11_edited AS (
  SELECT doc_id, n_chars, t, substr(t, 1, n_chars - n_chars // 3) || substr(coalesce(lead(t) OVER o, first_value(t) OVER o), 1, n_chars // 3) AS e
  FROM op11_docs WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
op11_all AS (SELECT doc_id, n_chars, e, {_fingerprint_sql("t")} AS ha, {_fingerprint_sql("e")} AS hb FROM op11_edited),
op11_kept AS (SELECT doc_id, n_chars, e, {_kept_sql("ha")} AS a, {_kept_sql("hb")} AS b FROM op11_all),
op11_next AS (
  SELECT *, coalesce(lead(a) OVER o, first_value(a) OVER o) AS c FROM op11_kept WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, n_chars, sha256(e) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       {_likeness_sql("a", "b")} AS near_edited, {_likeness_sql("a", "c")} AS near_next FROM op11_next"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""WITH op12_terms AS (SELECT doc_id, unnest(regexp_extract_all({ASCII_LOWER}, '{lexical_search.TERM}')) AS term FROM documents),
op12_tf AS (SELECT doc_id, term, count(*) AS tf FROM op12_terms GROUP BY ALL),
op12_n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM op12_tf GROUP BY doc_id),
op12_all AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM op12_n),
op12_m AS (SELECT doc_id, 100 - 75 + ((75 * n * nn) // ll) AS m FROM op12_n, op12_all),
op12_w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM op12_tf GROUP BY term), op12_all),
op12_items AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({ASCII_LOWER}, '{lexical_search.TERM}')) AS term FROM benchmark) GROUP BY ALL),
op12_scores AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM op12_items JOIN op12_w USING (term) JOIN op12_tf USING (term) JOIN op12_m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM op12_scores WHERE score > 0) WHERE rank <= 10"""


def _looped(doc_id: F.Column, text: F.Column) -> F.Column:
    """Every tenth text with its words from a place on looping, both by the hash of the id; the others as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def rewritten(w: F.Column) -> F.Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.transform(F.array(words), rewritten)[0]).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs).withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("a"), (-r.period).alias("p")))))
    line = lambda r: F.concat_ws(",", r.start, r.length, r.period)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.a")).alias("start"), "best.length", (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_line_dedup, op3_quality_rules, op4_benchmark_decontamination, op6_source_mixing, op2_nbsvm_quality, op5_language_id, op7_secret_scan, op8_suffix_dedup, op9_ngram_jaccard_join, op10_toxicity_cnn, op11_fingerprints, op12_ranked_search, op13_periodic_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_quality_rules": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL, "op6_source_mixing": OP6_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op11_fingerprints": OP11_SQL, "op12_ranked_search": OP12_SQL}
