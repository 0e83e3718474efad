from pyspark.sql import functions as F

from umbra.operators import detect as D, evidence as V, pages as H

HTML = """<html><body><script>var x = "<p>no</p>";</script><h2>Account</h2><p>One <b>two</b><p>three &amp; four
<ul><li>item<ul><li>inner</ul></ul><div style="display: none"><p>hidden</p></div><div data-private><dl><dt>Name</dt><dd>Asha</dd></dl></div>
<a href="/x?y=1">go <i>on</i></a><a name="t">no link</a><button aria-label="Pay now">P</button><input type="password" autocomplete="cc-csc"><img src="/a/b/face.png?s=1" alt="me"></body></html>"""


def test_parts_of_a_page(spark):
    parts = H.page_parts(spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "<p>unclosed <b>text")], "page_id long, html string")).cache()
    blocks = [(r.role, r.text, r.hidden, r.marks) for r in H.text_blocks(parts.where("page_id = 1")).orderBy("seq").collect()]
    assert blocks == [("heading", "Account", None, ""), ("paragraph", "One two", None, ""), ("paragraph", "three & four", None, ""), ("listitem", "item", None, ""), ("listitem", "inner", None, ""), ("paragraph", "hidden", "display", ""), ("term", "Name", None, "data-private"), ("definition", "Asha", None, "data-private")]
    elements = {(r.tag, r.name, r.attr) for r in H.elements(parts.where("page_id = 1")).collect()}
    assert elements == {("a", "go on", "/x?y=1"), ("button", "Pay now", ""), ("input", "", "cc-csc")}
    assert [(r.kind, r.alt, r.filename) for r in H.media(parts).collect()] == [("img", "me", "face.png")]
    assert [r.text for r in H.text_blocks(parts.where("page_id = 4")).collect()] == ["unclosed text"]
    headings = {r.text: r.heading for r in H.structural_context(H.text_blocks(parts.where("page_id = 1"))).collect()}
    assert headings["Account"] is None and headings["item"] == "Account"
    assert {r.category for r in D.detect_tags(parts).collect()} == {"PASSWORD", "PRIVATE_GENERIC"}


def test_stable_ids(spark):
    rows = lambda names: H.row_fingerprint(spark.createDataFrame([(1, i, "link", "a", n) for i, n in enumerate(names)], "page_id long, seq int, role string, tag string, name string"), "s")
    before = rows(["a", "b", "b"]).withColumn("eid", F.col("seq") + 1)
    now = H.stable_ids(before.select("page_id", "fp", "ordinal", "eid"), rows(["b", "c", "a"]))
    got = {r.name: r.eid for r in rows(["b", "c", "a"]).join(now, ["page_id", "fp", "ordinal"]).collect()}
    assert got == {"a": 1, "b": 2, "c": 4}


def test_evidence(spark):
    rows = [(1, "SECRET", "user_1", "weak", None, None, None, None, 1), (2, "UAN", "123456789012", "structured", "pass", None, None, None, 1), (3, "UAN", "123456789012", "structured", "pass", None, None, "Product list", 4), (4, "PIN_CODE", "560001", "weak", None, "CITY", "PIN_CODE", None, 1)]
    df = spark.createDataFrame(rows, "id int, category string, value string, strength string, checksum string, bound string, autocomplete string, container string, n_targets int")
    got = {r.id: (r.claimed, r.score, r.verdict) for r in V.score_evidence(df).collect()}
    assert got == {1: ("SECRET", -1, "NOT_DETECTED"), 2: ("UAN", 8, "DETECTED"), 3: ("UAN", 3, "UNCERTAIN"), 4: ("CITY", 4, "UNCERTAIN")}


def test_names_by_reference(spark):
    html = '<p id="a">One</p><p id="a">Twice</p><div id="b">Two <b>more</b></div><label for="f">For it</label><input id="f" aria-labelledby=" b a x " title="t"><label>Around <input></label><input aria-label=" " placeholder="P"><button><img alt="x">Go</button><input>'
    other = '<input id="f" aria-labelledby="a b">'
    rows = H.named_elements(H.saying_parts(spark.createDataFrame([(1, html), (2, other), (None, other), (3, None)], "page_id long, html string"))).collect()
    assert [(r.name, r.label_text) for r in sorted((r for r in rows if r.page_id == 1), key=lambda r: r.seq)] == [("Two more One", "For it"), ("Around", "Around"), ("P", ""), ("Go", ""), ("", "")]
    assert [r.name for r in rows if r.page_id != 1] == ["", ""]


def test_boxes_of_nested_frames(spark):
    frames = spark.createDataFrame([(1, None, 5.0, 1.0), (2, 1, 10.0, None), (3, 2, 1.0, 1.0), (4, 5, 0.0, 0.0), (5, 4, 0.0, 0.0), (6, 99, 0.0, 0.0)], "frame_id long, parent_id long, x double, y double")
    boxes = spark.createDataFrame([(i, 2.0, 3.0) for i in range(1, 8)], "frame_id long, x double, y double")
    got = {r.frame_id: (r.left, r.top) for r in H.page_boxes(boxes, H.frame_offsets(frames)).collect()}
    assert got == {1: (7.0, 4.0), 2: (17.0, 4.0), 3: (18.0, 5.0)}


def test_tags_without_attributes_take_over_what_is_around_them(monkeypatch):
    asked, of = [], H._Page._inherited
    monkeypatch.setattr(H._Page, "_inherited", staticmethod(lambda tag, *rest: asked.append(tag) or of(tag, *rest)))
    page = H._Page()
    page.feed('<div data-private style="opacity: 0.2"><section style="opacity:.1"><p>Faint</p><ul><li>One</li></ul></section><p>Seen</p></div><p>Free</p>')
    page.close()
    assert [(p[4], p[6], p[7]) for p in page.parts] == [(["Faint"], "opacity", "data-private"), (["One"], "opacity", "data-private"), (["Seen"], None, "data-private"), (["Free"], None, "")]
    assert asked == ["div", "section"]
