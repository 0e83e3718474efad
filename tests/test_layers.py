"""All layers over the same texts, merged."""

from pyspark.sql import functions as F

from umbra.functions import rules as R
from umbra.operators import detect as D, layers as Y


def test_every_layer_finds_and_certain_spans_name_the_island(spark):
    texts = ["Email: ann@x.org. Name: Asha Rao. Date of birth: 12/05/1990; thanks", "asha rao was here, UAN: 100200300400.", "ref 100200300400 and INR 5,000 due", None, "", "no colon 12/05/1990"]
    units = spark.createDataFrame([(f"u{i}", "o", t) for i, t in enumerate(texts)], "unit_id string, origin string, text string")
    vault = spark.createDataFrame([("NAME", "asha rao", "Asha Rao")], "category string, normalized string, value string")
    spans = Y.detect_layers(units, R.load_labels(spark), vault)
    rows = spans.collect()
    assert {r.source for r in rows} == {"rule", "label", "vault", "evidence"} and any(r.rule.startswith("context:") for r in rows)
    assert all(texts[int(r.unit_id[1:])][r.span_start : r.span_end] == r.value for r in rows)
    merged = {(r.unit_id, r.value): r for r in D.merge_spans(spans, R.load_policy(spark)).collect()}
    name = merged["u0", "Asha Rao"]
    assert (name.category, name.certainty, name.rules) == ("NAME", "detected", "label,vault") and name.confidence == 1.0
    assert merged["u0", "ann@x.org"].category == "EMAIL" and merged["u1", "asha rao"].rules == "vault"
    dob = merged["u0", "12/05/1990"]
    assert dob.category == "DOB" and "context:date" in dob.rules and "evidence:date" in dob.rules
    assert merged["u5", "12/05/1990"].certainty == "uncertain" and "context:date" not in merged["u5", "12/05/1990"].rules


def test_no_units(spark):
    none = spark.createDataFrame([], "unit_id string, origin string, text string")
    vault = spark.createDataFrame([], "category string, normalized string, value string")
    assert Y.detect_layers(none, R.load_labels(spark), vault).count() == 0
    assert D.scan(none.withColumn("context", F.lit("DOB"))).count() == 0


def test_texts_meet_known_values_once_and_changes_take_one_shuffle(spark):
    """Bound values carry their text instead of meeting it again; both merges of the whole read the layers once and give what two would."""
    from umbra.operators import audit as L, evaluate as E
    from umbra.plans.more import whole_arms

    texts = ["Email: ann@x.org. Date of birth: 12/05/1990; INR 5,000 and 12/05/1991", "asha rao, UAN: 100200300400."]
    units = spark.createDataFrame([(f"u{i}", "o", t) for i, t in enumerate(texts)], "unit_id string, origin string, text string")
    vault = spark.createDataFrame([("NAME", "asha rao", "Asha Rao")], "category string, normalized string, value string")
    assert "Join" not in Y.labelled_values(units, R.load_labels(spark))._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "")
    known = L.scan_known_values(units, vault, ("origin",)).collect()
    assert [(r.unit_id, r.origin, r.value, r.span_start) for r in known] == [("u1", "o", "asha rao", 0)]
    spans, policy, columns = Y.detect_layers(units, R.load_labels(spark), vault), R.load_policy(spark), ("unit_id", "span_start", "span_end", "category", "certainty")
    two = E.layer_changes(D.merge_spans(spans.where("source <> 'evidence'"), policy).select(*columns), D.merge_spans(spans, policy).select(*columns))
    one = E.signed_changes(whole_arms(spans, policy))
    assert sorted(map(tuple, one.select(*two.columns).collect())) == sorted(map(tuple, two.collect())) != []
    assert one.columns == two.columns
