"""Detection by all layers over the same texts: rules, labelled values, known values and label-free evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from umbra.operators import audit, detect, evidence
from umbra.sources.tables import stored

# What shapes say of themselves, and the confidence of a labelled value that no rule knows and of a known value.
STRENGTHS = {"currency": "structured", "digits_12": "weak", "digits_9_18": "weak", "voter": "structured", "pin": "weak", "date": "structured", "bearer": "self_describing", "opaque": "weak"}
LABELLED, KNOWN = 0.65, 1.0
SPAN = ("unit_id", "origin", "rule", "category", "span_start", "span_end", "value", "confidence", "certainty", "source")


def labelled_values(units: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit_id, origin, context, value_start, value_end, text): the values that stand behind a label in running text."""
    bound = detect.bind_inline_key_values(units, labels, ("unit_id", "origin", "text"))
    text = F.substring(F.col("text"), F.col("value_start") + 1, F.col("value_end") - F.col("value_start"))
    return bound.select("unit_id", "origin", F.col("category").alias("context"), "value_start", "value_end", text.alias("text"))


def evidence_spans(units: DataFrame, values: DataFrame) -> DataFrame:
    """Label-free shapes that their evidence makes detected or uncertain; one inside a labelled value is claimed by that label."""
    shapes = detect.repeat_index(stored(detect.find_shapes(units)))
    inside = values.select(F.col("unit_id").alias("__u"), F.col("context").alias("bound"), F.col("value_start").alias("__a"), F.col("value_end").alias("__e")).hint("merge")
    joined = shapes.join(inside, (F.col("unit_id") == F.col("__u")) & (F.col("span_start") >= F.col("__a")) & (F.col("span_end") <= F.col("__e")), "left")
    strength = F.create_map(*[F.lit(x) for kv in STRENGTHS.items() for x in kv])[F.col("rule")]
    none = F.lit(None).cast("string")
    scored = evidence.score_evidence(joined.withColumns({"strength": strength, "checksum": none, "autocomplete": none, "container": none})).where("verdict <> 'NOT_DETECTED'")
    certainty = F.when(F.col("verdict") == "DETECTED", "detected").otherwise("uncertain")
    return scored.select("unit_id", "origin", F.concat(F.lit("evidence:"), "rule").alias("rule"), F.col("claimed").alias("category"), "span_start", "span_end", "value", F.col("score_confidence").alias("confidence"), certainty.alias("certainty"), F.lit("evidence").alias("source"))


def detect_layers(units: DataFrame, labels: DataFrame, vault: DataFrame) -> DataFrame:
    """(unit_id, origin, rule, category, span_start, span_end, value, confidence, certainty, source): what every layer finds, for merge_spans.

    units: unit_id, origin, text; vault: category, normalized and value of known values. Rules read the whole text, and those that need a
    context the values behind labels; a labelled value that neither touches counts by its label alone. Spans of different layers may overlap.
    """
    units = stored(units).hint("merge")  # texts grow and are joined by their id; Spark takes made ones for small
    values = stored(labelled_values(units, labels))
    sure = F.when(F.col("confidence") >= 0.6, "detected").otherwise("uncertain")
    rules = detect.scan(units)
    context = detect.scan_context_rules(values, ("unit_id", "origin", "value_start")).withColumns({"span_start": F.col("span_start") + F.col("value_start"), "span_end": F.col("span_end") + F.col("value_start"), "rule": F.concat(F.lit("context:"), "rule")})
    firm = stored(rules.select(*SPAN[:8]).unionByName(context.select(*SPAN[:8])))
    bindings = values.select("unit_id", "origin", F.col("context").alias("category"), F.col("value_start").alias("span_start"), F.col("value_end").alias("span_end"), F.col("text").alias("value"))
    left = detect.residual_label_fallback(bindings, firm)
    known = audit.scan_known_values(units, vault, ("origin",))
    of = lambda df, **cols: df.withColumns({k: v if not isinstance(v, str) else F.lit(v) for k, v in cols.items()}).select(*SPAN)
    layers = [
        of(firm, certainty=sure, source="rule"), of(left, rule="label", confidence=F.lit(LABELLED), certainty="detected", source="label"),
        of(known, rule="vault", confidence=F.lit(KNOWN), certainty="detected", source="vault"), evidence_spans(units, values),
    ]
    return reduce(DataFrame.unionByName, layers)
