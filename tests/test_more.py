"""Labels in running text, fields, known values, pages as text, plans, sinks."""

import re

import pytest
from pyspark.sql import functions as F

from umbra.functions import rules as R
from umbra.operators import actions as A, audit as L, detect as D, pages as H, protect as P
from umbra.sources import tables as S


def units(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "unit_id string, text string")


def test_inline_keys(spark):
    texts = [
        "Our records currently show Registered name: Asha Rao, and City: Pune. Thanks", "Note: Ref: 12345", "Permanent account number: ABCPE1234F; done", "first clause, mobile number : 98765", "no colon here", "email:", None,
        "name: " + "x" * 100, "one two three four five six seven email: a@b.org", "Name: City: Pune",
    ]
    got = {}
    for r in D.bind_inline_key_values(units(spark, *texts), R.load_labels(spark)).collect():
        got.setdefault(int(r.unit_id), []).append((r.category, texts[int(r.unit_id)][r.value_start : r.value_end]))
    assert {k: sorted(v) for k, v in got.items()} == {0: [("CITY", "Pune"), ("NAME", "Asha Rao")], 2: [("PAN", "ABCPE1234F")], 3: [("PHONE", "98765")], 7: [("NAME", "x" * 64)], 8: [("EMAIL", "a@b.org")], 9: [("NAME", "City: Pune")]}


def test_field_context(spark):
    rows = [("1", "password", None, "name", None, None, "x"), ("2", "text", "PIN_CODE", "City", None, None, "x"), ("3", "text", "EMAIL", None, None, "phone", "x"), ("4", "text", "EMAIL", "what", "ever", None, "x"), ("5", "text", None, "email", None, None, ""), ("6", "text", None, "misc", "City name", "email", "x"), ("7", "text", None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "unit_id string, input_type string, autocomplete string, name string, label string, attr string, value string")
    assert {r.unit_id: r.category for r in D.field_context(df, R.load_labels(spark)).collect()} == {"1": "PASSWORD", "2": "PIN_CODE", "3": "PHONE", "4": "EMAIL", "6": "CITY"}


def test_known_values_where_they_stand(spark):
    texts = ["é Asha and asha; xashay", "call 98765-43210 or 98765 43210", "9876543210", "98765 4321", None]
    vault = spark.createDataFrame([("NAME", "asha", "Asha"), ("PHONE", "9876543210", "+91 98765 43210"), ("CITY", "abc", "abc")], "category string, normalized string, value string")
    got = sorted((int(r.unit_id), r.category, r.span_start, r.span_end) for r in L.scan_known_values(units(spark, *texts), vault).collect())
    assert got == [(0, "NAME", 2, 6), (0, "NAME", 11, 15), (0, "NAME", 18, 22), (1, "PHONE", 5, 16), (1, "PHONE", 20, 31), (2, "PHONE", 0, 10)]


@pytest.mark.parametrize("blocks", [100_000, 0])
def test_leaks_inside_words_and_by_shuffle(spark, monkeypatch, blocks):
    monkeypatch.setattr(L, "AUTOMATON_FORMS", blocks)
    vault = spark.createDataFrame([("NAME", "asha rao"), ("PHONE", "9876543210")], "category string, normalized string")
    got = {(r.unit_id, r.category) for r in L.known_value_leaks(units(spark, "xxASHA RAOyy", "asha  rao", "(987) 654-3210", "98765", None), vault).collect()}
    assert got == {("0", "NAME"), ("2", "PHONE")}


def test_values_are_replaced_outside_tokens(spark):
    rows = spark.createDataFrame([("1", "abcd and [[PII:NAME:abcdefgh]] abcd"), ("2", "none"), ("3", None)], "unit_id string, text string")
    values = spark.createDataFrame([("1", 1, "abcd", "[[PII:NAME:qqqqqqqq]]"), ("1", 2, "qqqq", "no"), ("3", 1, "x", "y")], "unit_id string, nth int, value string, replacement string")
    got = {r.unit_id: r.text for r in P.replace_known(rows, values).collect()}
    assert got == {"1": "[[PII:NAME:qqqqqqqq]] and [[PII:NAME:abcdefgh]] [[PII:NAME:qqqqqqqq]]", "2": "none", "3": None}


def test_pages_as_text(spark):
    html = '<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>x";</script></head><body><!-- no --><h1>Head</h1><p>One <b>two</b><br>three<p>four&nbsp; <a href="/x">link</a><ul><li>five</li></ul><pre>six</pre></body></html>'
    pages = spark.createDataFrame([(1, "https://h.example/a", html), (2, None, None), (3, "x", "")], "page_id long, url string, html string")
    got = [(r.seq, r.text) for r in S.page_texts(pages).orderBy("page_id", "seq").collect()]
    assert got == [(0, "A & B"), (1, "Head"), (2, "One two"), (3, "three"), (4, "four link"), (5, "five"), (6, "six")]


def test_parts_with_more_context(spark):
    html = '<form><fieldset><legend>Who</legend><label>Name</label><input name="a"></fieldset></form><table><tr><th>A<th>B<tr><td>1<td>2</table><div style="opacity:.2"><p style="opacity:0.2">faint</p></div><div contenteditable>edit</div><span tabindex="0">tab</span><span tabindex="-1">no</span>'
    parts = H.page_parts(spark.createDataFrame([(1, html), (None, "<p>no id")], "page_id long, html string")).cache()
    blocks = {r.text: r for r in H.structural_context(H.text_blocks(parts.where("page_id = 1"))).collect()}
    assert blocks["Name"].legend == "Who" and (blocks["1"].column_header, blocks["2"].column_header) == ("A", "B") and blocks["A"].column_header is None
    assert blocks["faint"].hidden == "opacity"
    assert {(r.tag, r.in_form) for r in H.elements(parts).collect()} == {("input", True), ("div", False), ("span", False)}
    assert parts.where("page_id is null").count() == 1


def test_frames_of_any_depth(spark):
    rows = [(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (103, 100), (104, 104), (105, 999)]
    got = {r.frame_id: r.path for r in H.frame_paths(spark.createDataFrame(rows, "frame_id long, parent_id long")).collect()}
    assert got == {i: "/".join(map(str, range(i + 1))) for i in range(40)}


def test_screen_changes_in_order(spark):
    def cap(n, keys, url="a", dialog=False, scroll=0.0, dhash=0):
        return (1, n, keys, url, dialog, scroll, dhash)

    many = list(range(100))
    rows = [cap(1, many), cap(2, many), cap(3, many, url="b"), cap(4, many, url="b", dialog=True), cap(5, many[20:], url="b", dialog=True), cap(6, [*many[20:], 200], url="b", dialog=True), cap(7, [*many[20:], 200], url="b", dialog=True, scroll=300.0), cap(8, [*many[26:], 200], url="b", dialog=True, scroll=300.0, dhash=(1 << 12) - 1), cap(9, [1], url="b", dialog=True, scroll=300.0), cap(10, [2], url="b", dialog=True, scroll=300.0)]
    df = spark.createDataFrame(rows, "session int, capture int, keys array<int>, url string, dialog boolean, scroll double, dhash long")
    assert [r.reason for r in A.screen_changes(df).orderBy("capture").collect()] == ["same", "url", "dialog", "mutations", "same", "scroll", "hash", "mutations", "ratio"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "o", "x"), ("2", "p", None)], "unit_id string, origin string, text string")
    L.write_sanitized(rows, str(tmp_path / "out"), ("unit_id", "origin", "text"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert L.digest_mismatch(back.select("unit_id", "digest"), back.select("unit_id", F.col("origin").cast("string"), "text")).count() == 0
    with pytest.raises(ValueError, match="secret"):
        L.write_sanitized(rows.withColumn("secret", F.lit(1)), str(tmp_path / "out2"), ("unit_id", "origin", "text"))
    audit = L.audit_rows(spark.createDataFrame([("1", "EMAIL"), ("1", "EMAIL")], "unit_id string, category string"), L.seal_verdict(rows, spark.createDataFrame([], "unit_id string, check string")), L.digests(rows))
    for _ in range(2):
        L.append_audit(audit, str(tmp_path / "audit"))
    kept = spark.read.parquet(str(tmp_path / "audit"))
    assert kept.count() == 4 and {r.unit_id: r.category_counts for r in kept.collect()} == {"1": {"EMAIL": 2}, "2": {}}


def test_leaves(spark):
    rows = spark.createDataFrame([("1", ("a", [("x", 1), (None, 2)]), ["p", "q"])], "unit_id string, body struct<t:string, xs:array<struct<s:string, n:int>>>, tags array<string>")
    got = {(r.path, r.value) for r in L.json_leaves(rows, r"\.t$").collect()}
    assert got == {("body.xs[0].s", "x"), ("tags[0]", "p"), ("tags[1]", "q")}


@pytest.mark.parametrize("passes", [8, 0])
def test_values_that_begin_alike_meet_few_texts(spark, monkeypatch, passes):
    """By automata in several passes, and by the rarest gram; the values share their first characters with every text."""
    monkeypatch.setattr(L, "AUTOMATON_PASSES", passes)
    monkeypatch.setattr(L, "AUTOMATON_FORMS", 30_000)
    n = 100_000 if passes else 20_000
    vault = spark.range(n).selectExpr("'EMAIL' as category", "concat('user', lpad(id, 6, '0'), '@x.org') as normalized")
    texts = units(spark, *[f"mail of USER{i * 37:06d}@x.org and user{i * 37 + 1:06d}@x.orgy and user{i:05d}@x.org" for i in range(200)], "user", None, "")
    got = {(int(r.unit_id), r.normalized) for r in L.known_value_leaks(texts, vault).collect()}
    assert got == {(i, f"user{i * 37 + k:06d}@x.org") for i in range(200) for k in (0, 1)}


@pytest.mark.parametrize("hashed", [4_000_000, 700])
def test_known_values_by_hashes_are_those_in_the_texts(spark, monkeypatch, hashed):
    """Beyond the automata texts meet values by what they hold: no value that only shares a part with a text is shuffled, in one pass or in several."""
    monkeypatch.setattr(L, "AUTOMATON_FORMS", 0)
    monkeypatch.setattr(L, "HASHED_FORMS", hashed)
    values = [("NAME", x) for x in ("asha", "asha r", "\u00e9t\u00e9 asha", "ab\U0001f600c", "abc", "x" * 70)] + [("PHONE", f"98{i * 37:08d}") for i in range(1500)]
    vault = spark.createDataFrame(values, "category string, normalized string")
    texts = ["\u00c9T\u00c9 ASHA", "\u00e9t\u00e9 ASHA RAO", "AB\U0001f600C", "x" * 69, "y" + "x" * 71, "ash", "a abc", "", None, *(f"call 98-{i:08d} or 9800000{i:03d}" for i in range(300)), "[[PII:PHONE:abcd9800]] 000037"]
    known = L.known_forms(vault)
    got = {(int(r.unit_id), r.form, r.by_digits) for r in L._holding(units(spark, *texts).where("text is not null"), known, False).collect()}
    low = lambda t: t.encode().lower().decode()
    want = {(i, v, False) for i, t in enumerate(texts) if t for _, v in values if len(v) >= 4 and v in low(t)}
    want |= {(i, v, True) for i, t in enumerate(texts) if t for c, v in values if c == "PHONE" and v in "".join(x for x in re.sub(L.TOKEN, " ", t) if x in "0123456789")}
    assert got == want and len(want) > 20
    moved = L._by_hashes(units(spark, *texts).where("text is not null"), known.where("length(form) >= 4").select("form", F.lit(False).alias("by_digits")), 1, True)
    assert moved.count() == sum(not d for *_, d in want)


def test_look_alikes_of_tokens_are_unknown(spark):
    vault = spark.createDataFrame([("[[PII:EMAIL:aaaaaaaa]]",)], "token string")
    texts = units(spark, "a [[PII:EMAIL:aaaaaaaa]]", "b [[PII:EMAIL:bbbbbbbb]]", "c [ [ P I I : EMAIL", "d [[pii:email:aaaaaaaa]]", "[[PII:EMAIL:aaaaaaaa]] and [[pii:x", "none", None)
    assert sorted((r.unit_id, r.token) for r in L.unknown_tokens(texts, vault).collect()) == [("1", "[[PII:EMAIL:bbbbbbbb]]"), ("2", "look-alike"), ("3", "look-alike")]


def test_digests_of_lost_and_added_rows(spark):
    rows = units(spark, "a", "b", "c", None).select("unit_id", "text")
    sent = L.digests(rows)
    got = rows.where("unit_id <> '1'").withColumn("text", F.when(F.col("unit_id") == "2", "C").otherwise(F.col("text"))).unionByName(spark.createDataFrame([("9", "new")], "unit_id string, text string"))
    assert sorted(r.unit_id for r in L.digest_mismatch(sent, got).collect()) == ["1", "2", "9"]


def test_leaves_of_json_of_any_shape(spark):
    import json

    def walk(x, path):
        if isinstance(x, str):
            yield path or "$", x
        for k, v in x.items() if isinstance(x, dict) else []:
            yield from walk(v, f"{path}.{k}" if path else k)
        for i, v in enumerate(x if isinstance(x, list) else []):
            yield from walk(v, f"{path}[{i}]")

    deep = "end"
    for i in range(12):
        deep = {f"k{i}": [deep, i]} if i % 2 else [deep, {"s": "x"}]
    shapes = [{"a": "x", "b": [1, "y", {"c": None, "d": True, "e": ["z", ["w"]]}], "f": {}, "g": []}, ["p", 2.5, 10**30, "q"], "alone", 7, None, {"n": {"n": {"n": "é « 漢 »"}}}, deep, {"t": "2024-01-01"}]
    rows = [(str(i), json.dumps(x, ensure_ascii=i % 2 == 0)) for i, x in enumerate(shapes)] + [("bad", '{"a": "cut'), ("none", None), ("empty", "")]
    got = sorted((r.unit_id, r.path, r.value) for r in L.variant_leaves(spark.createDataFrame(rows, "unit_id string, payload string")).collect())
    want = [(str(i), p, v) for i, x in enumerate(shapes) for p, v in walk(x, "")] + [("bad", "$", '{"a": "cut'), ("empty", "$", "")]
    assert got == sorted(want)
