"""Set-based leak audit of outgoing rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from umbra.operators.detect import places, scan
from umbra.operators.protect import TOKEN
from umbra.operators.windows import Windows, form_hashes
from umbra.sources.tables import stored

CHECKS = ("schema", "rule-scan", "known-value", "unknown-token", "coverage", "digest")
#: Fewer digits stand in any text by chance.
MIN_DIGITS = 7
MIN_CHARS = 4
# Fixed value: what may stand between the digits of a known value.
BETWEEN_DIGITS = r"[\s,./()-]*"
#: Known values of one automaton (some 1 kB of a task's memory each), and how many passes over the texts are made with such.
AUTOMATON_FORMS, AUTOMATON_PASSES = 50_000, 8
#: Known values beyond those are told by hashes: so many (some 12 bytes of a task's memory each) in a pass over the texts.
HASHED_FORMS = 4_000_000


def rescan_rules(sanitized: DataFrame, allowed: DataFrame) -> DataFrame:
    """(unit_id, category, n): rule hits left after tokens are taken out, but for categories allowed at the unit."""
    bare = sanitized.select("unit_id", "origin", F.regexp_replace("text", TOKEN, " ").alias("text"))
    return scan(bare).join(allowed, ["unit_id", "category"], "left_anti").groupBy("unit_id", "category").agg(F.count(F.lit(1)).alias("n"))


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digits_of(text: Column | str) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")  # by runs: one replacement for each character costs several times the rest of a pass


def _by_automata(texts: DataFrame, forms: DataFrame, n_blocks: int, in_tokens: bool) -> DataFrame:
    """(unit_id, form, by_digits) where the text holds the form: one pass over the texts for each block of forms, by automata of them."""
    found = []
    kinds = T.StructType([texts.schema["unit_id"], T.StructField("form", T.StringType()), T.StructField("by_digits", T.BooleanType())])
    texts = stored(texts) if n_blocks > 1 else texts  # so that pages are taken apart once
    for i in range(n_blocks):
        block = [tuple(r) for r in forms.where(F.pmod(F.xxhash64("form"), F.lit(n_blocks)) == i).select("form", "by_digits").collect()]

        def search(batches: Iterator[pa.RecordBatch], block: list[tuple[str, bool]] = block) -> Iterator[pa.RecordBatch]:
            as_text, as_digits = ahocorasick.Automaton(), ahocorasick.Automaton()
            for form, by_digits in block:
                (as_digits if by_digits else as_text).add_word(form, (form, by_digits))
            as_text.make_automaton()
            as_digits.make_automaton()
            token, others = re.compile(TOKEN), bytes(c for c in range(256) if not 48 <= c <= 57)

            def held(text: str) -> list[tuple[str, bool]]:
                out = {x for _, x in as_text.iter(text.encode().lower().decode())} if len(as_text) else set()
                if len(as_digits):
                    bare = text if in_tokens or "[" not in text else token.sub(" ", text)
                    out |= {x for _, x in as_digits.iter(bare.encode().translate(None, others).decode())}
                return sorted(out)

            for batch in batches:
                every = [held(text) for text in batch.column(1).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(every)), [len(x) for x in every]), pa.int64())
                flat = [x for xs in every for x in xs]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([f for f, _ in flat], pa.string()), pa.array([d for _, d in flat], pa.bool_())], names=["unit_id", "form", "by_digits"])

        if block:
            found.append(texts.mapInArrow(search, kinds))
    return reduce(DataFrame.unionByName, found) if found else texts.select("unit_id", F.lit("").alias("form"), F.lit(False).alias("by_digits")).limit(0)


def _by_hashes(texts: DataFrame, forms: DataFrame, n_blocks: int, in_tokens: bool) -> DataFrame:
    """(unit_id, form, by_digits) where the text holds the form: one pass over the texts for each block of forms, by hashes of all stretches of a form's length.

    What a pass says is the stretch itself, which meets the forms as a string; so a hash that two strings share adds nothing.
    """
    found = []
    kinds = T.StructType([texts.schema["unit_id"], T.StructField("form", T.StringType()), T.StructField("by_digits", T.BooleanType())])
    texts = stored(texts) if n_blocks > 1 else texts  # so that pages are taken apart once
    block_of = F.pmod(F.xxhash64("form"), F.lit(n_blocks))
    widths = forms.groupBy(block_of.alias("i"), "by_digits", F.octet_length("form").alias("n")).count().collect()
    for i in range(n_blocks):
        sizes = {d: sorted(r.n for r in widths if r.i == i and r.by_digits == d) for d in (False, True)}
        windows = {d: Windows(sizes[d], form_hashes(forms.where((block_of == i) & (F.col("by_digits") == d)), sizes[d])) for d in sizes if sizes[d]}

        def search(batches: Iterator[pa.RecordBatch], windows: dict[bool, Windows] = windows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column, rows, held = batch.column(1), [], []
                for by_digits, w in windows.items():
                    bare = pc.replace_substring_regex(column, TOKEN, " ") if by_digits and not in_tokens else column
                    for row, form in w.found(bare, by_digits):
                        rows.append(row)
                        held.append((form, by_digits))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([f for f, _ in held], pa.string()), pa.array([d for _, d in held], pa.bool_())], names=["unit_id", "form", "by_digits"])

        found.append(texts.mapInArrow(search, kinds))
    return reduce(DataFrame.unionByName, found)


def _holding(texts: DataFrame, known: DataFrame, in_tokens: bool) -> DataFrame:
    """(unit_id, category, normalized, form, by_digits) where the text (unit_id, text) holds a known form anywhere in it, A-Z lower-cased, or its digits in those of the text.

    Digits of tokens count only if in_tokens. Up to AUTOMATON_FORMS * AUTOMATON_PASSES forms are looked for by automata,
    beyond by hashes: as text and as digits in the same pass over the texts, and passes move nothing but what they find.
    """
    key = ["category", "normalized"]
    as_text = known.where(F.length("form") >= MIN_CHARS).select(*key, "form", F.lit(False).alias("by_digits"))
    as_digits = known.where(F.length("digits") >= MIN_DIGITS).select(*key, F.col("digits").alias("form"), F.lit(True).alias("by_digits"))
    values = as_text.unionByName(as_digits).distinct()
    forms = values.select("form", "by_digits").distinct()
    n = forms.count()
    automata = n <= AUTOMATON_FORMS * AUTOMATON_PASSES
    found = _by_automata(texts, forms, -(-n // AUTOMATON_FORMS), in_tokens) if automata else _by_hashes(texts, forms, -(-n // HASHED_FORMS), in_tokens)
    return found.join(values.hint("merge"), ["form", "by_digits"])


def known_forms(vault: DataFrame) -> DataFrame:
    """(category, normalized, form, digits): values as they are looked for: normalized and (column value, if given) raw, A-Z lower-cased."""
    forms = ["normalized", *(["value"] if "value" in vault.columns else [])]
    every = vault.select("category", "normalized", F.explode(F.array(*forms)).alias("form")).where("form is not null")
    return every.withColumn("form", ascii_lower("form")).distinct().withColumn("digits", digits_of("form"))


def known_value_leaks(sanitized: DataFrame, vault: DataFrame) -> DataFrame:
    """(unit_id, category, normalized): units that still hold a known value, normalized or (column value, if given) raw.

    Values of four characters or more are looked for anywhere in the text, case of A-Z aside. Values of seven digits
    or more are also looked for in the digits of the text alone, whatever stands between them; tokens are taken out
    before that.
    """
    texts = sanitized.where("text is not null").select("unit_id", "text")
    return _holding(texts, known_forms(vault), in_tokens=False).select("unit_id", "category", "normalized").distinct()


# How a look-alike of a token begins, and what is reported of it.
LOOK_ALIKE = r"(?i)\[\s*\[\s*P\s*I\s*I\s*:"
LOOK_ALIKE_FOUND = "look-alike"


def unknown_tokens(sanitized: DataFrame, vault: DataFrame) -> DataFrame:
    """(unit_id, token): tokens in the text that the vault didn't issue; `look-alike` for a text without any token in which something looks like one."""
    found = sanitized.select("unit_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token")).distinct()
    unknown = found.join(vault.select("token").distinct(), "token", "left_anti")
    like = sanitized.where(F.col("text").rlike(LOOK_ALIKE) & ~F.col("text").rlike(TOKEN)).select("unit_id", F.lit(LOOK_ALIKE_FOUND).alias("token")).distinct()
    return unknown.select("unit_id", "token").unionByName(like)


def coverage_gaps(spans: DataFrame, applied: DataFrame) -> DataFrame:
    """(unit_id, span_start, span_end, covered): decided spans that applied redactions don't cover whole."""
    a = applied.select("unit_id", F.col("span_start").alias("s"), F.col("span_end").alias("e"))
    # least and greatest pass over nulls, so a unit without any redaction must be told apart
    overlap = F.when(F.col("s").isNotNull(), F.greatest(F.least("span_end", "e") - F.greatest("span_start", "s"), F.lit(0)))
    joined = spans.join(a, "unit_id", "left").groupBy("unit_id", "span_start", "span_end").agg(F.sum(F.coalesce(overlap, F.lit(0))).alias("covered"))
    return joined.where("covered < span_end - span_start")


def union_failures(found: dict[str, DataFrame]) -> DataFrame:
    """(unit_id, check) of the units that each check, by its name, has found."""
    return reduce(DataFrame.unionByName, (df.select("unit_id", F.lit(check).alias("check")) for check, df in found.items())).distinct()


def seal_verdict(units: DataFrame, failures: DataFrame) -> DataFrame:
    """(unit_id, verdict): the first failing check in their fixed order, or SEALED; failures: unit_id, check."""
    rank = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("check"))
    worst = failures.groupBy("unit_id").agg(F.min_by("check", rank).alias("verdict"))
    return units.select("unit_id").join(worst, "unit_id", "left").fillna("SEALED", "verdict")


def canonical(df: DataFrame) -> Column:
    """The columns in the order of their names, each as name:bytes:value in a line; -1 bytes is a null."""
    line = lambda c: F.concat(F.lit(f"{c}:"), F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))
    return F.concat(*[line(c) for c in sorted(df.columns)])


def digests(df: DataFrame) -> DataFrame:
    """(unit_id, digest, n_bytes) of the canonical bytes of each row that would be written."""
    body = canonical(df)
    return df.select("unit_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))


def write_sanitized(df: DataFrame, path: str, allowed: tuple[str, ...]) -> None:
    """Write rows with their digest, partitioned by origin; a column that isn't allowed is an error, not dropped."""
    if extra := sorted(set(df.columns) - set(allowed)):
        raise ValueError(f"columns that may not be written: {extra}")
    body = canonical(df)
    df.withColumns({"digest": F.sha2(body, 256), "n_bytes": F.octet_length(body).cast("long")}).write.mode("overwrite").partitionBy("origin").parquet(path)


def digest_mismatch(sent: DataFrame, received: DataFrame) -> DataFrame:
    """(unit_id): rows whose recomputed digest isn't the recorded one, rows that were lost on the way, and rows that were added."""
    again = digests(received).select("unit_id", F.col("digest").alias("again"))
    return sent.select("unit_id", "digest").join(again, "unit_id", "full").where("not digest <=> again").select("unit_id")


def invalid_audit_rows(audit: DataFrame, categories: list[str]) -> DataFrame:
    """(row_id, faults): audit rows with an unknown category, a bad digest or level, or a negative timing."""
    checks = {
        "category": F.exists(F.map_keys("category_counts"), lambda k: ~k.isin(*categories)),
        "digest": ~F.col("digest").rlike("^[0-9a-f]{64}$"), "level": ~F.col("level").rlike("^L[0-5]$"),
        "timing": F.exists(F.map_values("timings"), lambda v: v < 0),
    }
    faults = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])), ",")
    return audit.withColumn("faults", faults).where("faults <> ''").select("row_id", "faults")


def scan_known_values(units: DataFrame, vault: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(unit_id, category, normalized, span_start, span_end): where known values stand, case of A-Z aside.

    Values of seven digits or more are also found with marks between their digits. A span inside another one of the
    same value counts for nothing. With keep, those columns of the units and the value of each span stay as well.
    """
    key = ["category", "normalized"]
    texts = units.where("text is not null").select("unit_id", *(keep or ()), "text")
    literal = F.concat(F.lit("(?i)\\Q"), "form", F.lit("\\E"))
    spaced = F.array_join(F.split("form", ""), BETWEEN_DIGITS)
    asked = _holding(texts.select("unit_id", "text"), known_forms(vault), in_tokens=True).select("unit_id", *key, F.when(F.col("by_digits"), spaced).otherwise(literal).alias("pattern"))
    found = places(F.col("text"), F.col("pattern"))
    if keep is not None:
        found = F.transform(found, lambda s: F.struct(s.span_start.alias("span_start"), s.span_end.alias("span_end"), F.substring(F.col("text"), s.span_start + 1, s.span_end - s.span_start).alias("value")))
    spans = asked.hint("merge").join(texts.hint("merge"), "unit_id").select("unit_id", *(keep or ()), *key, F.explode_outer(found).alias("s")).where("s is not null")
    spans = spans.select("unit_id", *(keep or ()), *key, "s.*").distinct()
    order = Window.partitionBy("unit_id", *key).orderBy("span_start", F.desc("span_end"))
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("__reach", reach).where("__reach is null or span_end > __reach").drop("__reach")


def bad_mask_labels(masks: DataFrame, vault: DataFrame, carried: DataFrame) -> DataFrame:
    """(unit_id, span_start, fault): labels that are no words of the vocabulary, or name a token that wasn't issued, isn't
    the mask's own, or isn't carried by the text; masks: unit_id, span_start, category, label, token; carried: unit_id, token."""
    named = F.regexp_extract("label", r"^\[[A-Z_]+#([a-z2-7]{8})\]$", 1)
    rows = masks.where("label is not null").withColumn("__named", named)
    issued, there = vault.select("token", F.lit(True).alias("__issued")).distinct(), carried.select("unit_id", "token", F.lit(True).alias("__there")).distinct()
    joined = rows.join(issued, "token", "left").join(there, ["unit_id", "token"], "left")
    own = F.concat(F.lit("[[PII:"), "category", F.lit(":"), "__named", F.lit("]]"))
    fault = (
        F.when(~F.col("label").rlike(r"^\[[A-Z_]+(#[a-z2-7]{8})?\]$"), "vocabulary").when(F.col("__named") == "", None).when(F.col("__issued").isNull(), "not_issued")
        .when(F.col("token") != own, "other_token").when(F.col("__there").isNull(), "not_carried")
    )
    return joined.select("unit_id", "span_start", fault.alias("fault")).where("fault is not null")


def schema_faults(payloads: DataFrame, rules: dict[str, Column], allowed: tuple[str, ...]) -> DataFrame:
    """(unit_id, fault): fields that break their rule, by name alone; columns that aren't allowed are faults of every row."""
    extra = sorted(set(payloads.columns) - set(allowed))
    faults = [F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in rules.items()] + [F.lit(f"extra:{c}") for c in extra]
    return payloads.select("unit_id", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def audit_rows(decisions: DataFrame, verdicts: DataFrame, sealed: DataFrame) -> DataFrame:
    """(unit_id, digest, verdict, category_counts): one audit row for each unit that was sent or refused.

    decisions: unit_id, category; verdicts: unit_id, verdict; sealed: unit_id, digest. Nothing of the text is in it.
    """
    counts = decisions.groupBy("unit_id", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("unit_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"))
    empty = F.create_map().cast("map<string,bigint>")
    return sealed.join(verdicts, "unit_id").join(counts, "unit_id", "left").select("unit_id", "digest", "verdict", F.coalesce("category_counts", empty).alias("category_counts"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Add rows to the audit table at path; what is there is never changed."""
    rows.select("unit_id", "digest", "verdict", "category_counts").write.mode("append").parquet(path)


def _leaves(value: Column, kind: T.DataType, path: Column) -> Column | None:
    """array<struct<path, value>> of the strings in a value of that type, or None where the type can't hold one."""
    if isinstance(kind, T.StringType):
        return F.array(F.struct(path.alias("path"), value.alias("value")))
    if isinstance(kind, T.StructType):
        parts = [_leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType) and _leaves(F.lit(None), kind.elementType, path) is not None:
        inside = F.transform(value, lambda x, i: _leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(inside), F.array().cast("array<struct<path:string,value:string>>"))
    return None


def json_leaves(payloads: DataFrame, skipped: str = "^$") -> DataFrame:
    """(unit_id, path, value): every string that is not null, anywhere in a payload's nested columns; paths that match `skipped` are left out."""
    parts = [_leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in payloads.schema.fields if f.name != "unit_id"]
    found = payloads.select("unit_id", F.inline(F.concat(*[p for p in parts if p is not None])))
    return found.where(F.col("value").isNotNull() & ~F.col("path").rlike(skipped))


def variant_leaves(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(unit_id, path, value): every string in JSON of any shape; paths as those of json_leaves, `$` for a payload that is a string itself.

    Texts that are no JSON have one leaf, themselves, so that nothing goes unseen. Each round takes one level of all payloads apart; there are
    as many as the deepest payload has levels.
    """
    parsed = payloads.where(F.col(column).isNotNull()).select("unit_id", F.lit("").alias("path"), F.try_parse_json(column).alias("v"), F.col(column).alias("raw"))
    broken = parsed.where("v is null").select("unit_id", F.lit("$").alias("path"), F.col("raw").alias("value"))
    left, found = parsed.where("v is not null").select("unit_id", "path", "v"), [broken]
    while True:
        kind = F.schema_of_variant("v")
        strings = left.where(kind == "STRING")
        found.append(strings.select("unit_id", F.when(F.col("path") == "", "$").otherwise(F.col("path")).alias("path"), F.expr("v::string").alias("value")))
        inside = left.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        if inside.isEmpty():
            return reduce(DataFrame.unionByName, found)
        parts = inside.lateralJoin(inside.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "part"))
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), "key"))
        left = stored(parts.where(~F.schema_of_variant("part").isin("BIGINT", "BOOLEAN", "VOID", "DOUBLE") & ~F.schema_of_variant("part").startswith("DECIMAL")).select("unit_id", F.concat("path", name).alias("path"), F.col("part").alias("v")))
