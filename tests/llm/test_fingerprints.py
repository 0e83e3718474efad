"""Fingerprints against plain counting, and what they estimate against the exact figures."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from umbra.llm import fingerprints as P


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {hashlib.md5(" ".join(words[max(0, i - 4) : i + 1]).encode()).hexdigest()[:16] for i in range(len(words))}


def plain(text):
    every = sorted(shingles(text))
    below = [h for h in every if h < "1"]
    return below if len(below) >= 32 else every[:32]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def known(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_fingerprints_edits_and_neighbours(docs, known, monkeypatch):
    monkeypatch.setattr(P, "RANGE_BYTES", 2000)
    made = P.edited(docs).collect()
    assert len(made) == len(known) and made[0].score == "x"
    order = [t or "" for _, t in sorted((x for x in known if x[0] is not None), key=lambda x: -x[0])]
    for r in made:
        text = r.text or ""
        assert r.fingerprint == plain(text) and r.n_chars == len(text) and r.edited_fingerprint == plain(r.edited_text)
        cut = len(text) // 3
        if r.doc_id is None:
            assert r.next is None and r.edited_text == text[: len(text) - cut]
        elif r.doc_id != 18:
            at = [d for d, _ in sorted((x for x in known if x[0] is not None), key=lambda x: -x[0])].index(r.doc_id)
            following = order[(at + 1) % len(order)]
            assert (r.next.text or "") == following and r.edited_text == text[: len(text) - cut] + following[:cut]


def test_ranges_of_very_few_and_no_rows(spark, no_docs):
    assert P.edited(no_docs).count() == 0
    one = P.edited(spark.createDataFrame([(7, "one two three")], "doc_id long, text string")).first()
    assert one.next.text == "one two three" and one.edited_text == "one two t" + "one "
    ids = [2**62, -(2**62), 0, 5, -5, 1, 2, 3]
    got = {r.doc_id: r.next.text for r in P.edited(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(3)).collect()}
    down = sorted(ids, reverse=True)
    assert got == {d: str(down[(i + 1) % len(down)]) for i, d in enumerate(down)}
    nulls = P.edited(spark.createDataFrame([(None, "abcdef")] * 5, "doc_id long, text string")).collect()
    assert [r.edited_text for r in nulls] == ["abcd"] * 5


def test_estimates_of_unequal_texts(spark):
    long, part, other = prose(1, 9000), " ".join(prose(1, 9000).split()[3000:5000]), prose(2, 9000)
    pairs = [(long, part), (part, long), (long, other), (long, long), (part + " " + other, long), ("", ""), ("", long), ("few words", long), ("few words", "few words here")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.fingerprint(F.col("a")).alias("x"), P.fingerprint(F.col("b")).alias("y"))
    got = df.select("a", "b", P.likeness(F.col("x"), F.col("y")).alias("near"), P.containment(F.col("x"), F.col("y")).alias("inside"), P.merged(F.col("x"), F.col("y")).alias("both")).collect()
    for r in got:
        a, b = shingles(r.a), shingles(r.b)
        assert abs(r.near - jaccard(a, b)) < 0.12
        assert r.inside is None if r.a == "few words" and r.b == long else abs(r.inside - (len(a & b) / len(a) if a else 1.0)) < 0.12
        every = sorted(a | b)
        assert r.both == ([h for h in every if h < "1"] if sum(h < "1" for h in every) >= 32 else every[:32])
    assert got[3].near == 1.0 and got[5].near == 1.0 and got[6].near == 0.0
