"""The pipeline, stage by stage and whole."""

import duckdb
import pytest

import corpus_pipeline as C
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    """A folder with documents (awkward ones, repeated rows but no null id among them) and benchmark items."""
    folder = tmp_path_factory.mktemp("sf")
    text = rows[10][1].split()
    more = [(200, prose(71, 90) + " " + " ".join(text[600:640]) + ".", "en", "b"), (201, prose(72, 200) + "\nHome | About | Contact", "de", "b"), (202, "| | |\n" * 60, "en", None)]
    known = [r for r in rows if r[0] not in (None, 18)] + more
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in known], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, " ".join(text[600:630])), (2, "not to be found anywhere in the documents at all"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = sorted((r.doc_id, r.text, r.lang, str(r.source), r.n_chars, r["copy"], r.order_key) for r in C.run(spark, sf).collect())
    want = sorted((d, t, g, str(s), n, c, k) for d, t, g, s, n, c, k in con.execute(C.ORACLE_SQL).fetchall())
    assert got == want and got


def test_stages_take_effect(spark, sf):
    docs = C.table(spark, sf, "documents")
    quality = C.quality(spark, docs, sf)
    assert {1, 2, 201} <= ids(quality) and not ids(quality) & {4, 5, 6, 7, 15, 202}
    assert "Home | About" not in quality.where("doc_id = 201").first().text
    assert not ids(C.dedup_near(spark, quality, sf)) & {2, 3, 12}
    assert not ids(C.decontaminate(spark, quality, sf)) & {11, 12, 200} and 201 in ids(C.decontaminate(spark, quality, sf))
    lines = {r.doc_id: r for r in C.dedup_lines(spark, docs, sf).collect()}
    assert lines[9].text.startswith("This line") and not lines[10].text.startswith("THIS LINE") and lines[10].n_chars == len(lines[10].text)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_of_any_table(spark, sf, docs, no_docs):
    """Null ids and texts, repeated rows, clashing names; and a table without rows."""
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, no_docs, sf).count() == 0
    assert C.mix(spark, docs, sf).count() > 0 and C.mix(spark, no_docs, sf).count() == 0
