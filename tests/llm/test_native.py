"""Quality rules, decontamination, mixing."""

from tests.llm.conftest import prose
from umbra.llm import decontamination as D, mixing as M, quality_rules as Q


def test_quality_rules(docs, no_docs):
    got = {r.doc_id: r for r in Q.score_rules(docs.where("doc_id is not null")).collect()}
    assert got[4].n_words == got[5].n_words == got[6].n_words == 0
    assert got[4].base_failed and not got[4]["kept"]
    assert got[15].n_repeat_words == 180 and got[15].base_failed
    assert got[1]["kept"] and got[1].clean_text == got[1].text
    assert got[11].n_words == 20000
    assert Q.clean(no_docs).count() == 0
    assert Q.clean(docs).columns == docs.columns


def test_one_phrase_does_not_fail_a_long_line(spark):
    long = prose(9, 400).replace("\n", " ")
    quotes = "Elle dit « bonjour » et puis « merci » avant de partir."
    rows = [(1, long + " Click here to read more."), (2, long + "\n" + quotes + "\nEr sagte »ja« und dann »nein« zu ihr.\nHome » Shop » Shoes\nRead more about our privacy policy."), (3, long + " a | b | c")]
    got = {r.doc_id: r for r in Q.score_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == rows[0][1] and got[3].clean_text == rows[2][1]
    assert got[2].n_lines_removed == 2 and quotes in got[2].clean_text and "»nein«" in got[2].clean_text


def test_lines_go_first(spark):
    good = prose(9, 81)
    rows = [(1, good + "\nHome | About | Contact"), (2, "Home | About | Contact\n" * 40 + "One sentence stays here."), (3, good + "\nAll rights reserved.\n### ### %%%")]
    got = {r.doc_id: r for r in Q.score_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == good
    assert not got[2].kept
    assert got[3].kept and got[3].n_lines_removed == 2


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_decontamination(spark, docs, rows, no_docs):
    text = rows[10][1].split()
    items = [(1, " ".join(text[500:530])), (2, " ".join(text[900:910] + ["zz"] + text[911:930])), (3, "nothing of this is there at all, not a word"), (4, None), (5, ""), (6, "few words"), (None, "few words")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contained_items(docs, table).collect()}
    sets = {i: shingles(t or "") for i, t in items if i}
    want = {(d, i) for d, t, *_ in rows for i, s in sets.items() if d is not None and s and 100 * len(s & shingles(t or "")) >= 80 * len(s)}
    assert got == want and {(11, 1), (12, 1), (7, 6)} <= got
    assert D.contained_items(no_docs, table).count() == 0
    assert D.contained_items(docs, table.limit(0)).count() == 0
    assert D.decontaminate(docs, table).where("doc_id is null").count() == 2


def test_items_are_found_without_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    table = spark.createDataFrame([(1, " ".join(rows[10][1].split()[500:530]))], "item_id long, text string")
    assert {r.doc_id for r in D.contained_items(docs, table).collect()} == {11, 12}


def test_mixing(spark, docs, no_docs):
    out = M.mix(docs)
    again = M.mix(docs.repartition(5))
    key = lambda df: sorted((str(r.doc_id), r["copy"], r.order_key) for r in df.select("doc_id", "copy", "order_key").collect())
    assert key(out) == key(again)
    assert M.mix(no_docs).count() == 0
    many = spark.range(20000).selectExpr("id as doc_id", "if(id % 10 = 0, 'small', 'big') as source")
    weights = spark.createDataFrame([("small", 1.0), ("big", 1.0)], "source string, weight double")
    n = {r.source: r["count"] for r in M.mix(many, weights).groupBy("source").count().collect()}
    assert abs(n["small"] - 10000) < 400 and abs(n["big"] - 10000) < 400
    assert {r.source for r in M.mix(many, weights.where("source = 'big'")).select("source").distinct().collect()} == {"big"}


def test_mixing_without_broadcast_deals_hot_sources_over_tasks(spark, monkeypatch):
    many = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, null, if(id % 3 = 1, 'big', concat('s', id))) as source", "'x' as cdf")
    rows = lambda: sorted((r.doc_id, str(r.source), r["copy"], r.order_key, r.cdf) for r in M.mix(many).collect())
    want = rows()
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 5)
    assert rows() == want and len(want) > 4000
