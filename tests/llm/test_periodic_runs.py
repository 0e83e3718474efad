"""Runs against brute force, on sequences and on documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import prose
from umbra.llm import periodic_runs as P
from umbra.llm import queries as Q


def brute(s, least=P.MIN_WORDS):
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any(all(s[k] == s[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(5)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 70))]
        a, p = rng.randrange(len(s)), rng.randint(1, 12)
        yield s if rng.random() < 0.4 else [s[i] if i < a else s[min(a + (i - a) % p, len(s) - 1)] for i in range(len(s))]


def test_runs_of_sequences_equal_brute_force():
    for s in sequences():
        for least in (2, 12):
            assert [tuple(r) for r in P.runs_of(s, least).tolist()] == brute(s, least)


def test_common_extensions_equal_plain_comparison():
    rng = random.Random(9)
    s = [rng.randrange(2) for _ in range(700)]
    depths, leaf = P.SuffixTree(s).tour()
    lowest = P.Lowest(depths)
    a, b = (np.array([rng.randrange(700) for _ in range(4000)]) for _ in range(2))
    got = lowest(np.minimum(leaf[a], leaf[b]), np.maximum(leaf[a], leaf[b]))
    for x, y, n in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        want = 0
        while x != y and max(x, y) + want < 700 and s[x + want] == s[y + want]:
            want += 1
        assert n == (want if x != y else 701 - x)
    assert sorted(range(701), key=lambda i: s[i:]) == np.argsort(leaf).tolist()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapse(w, runs):
    gone = {i for at, length, q in runs for i in range(at + q, at + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.fixture(scope="module")
def looping(spark, rows):
    loop = "a b c d e f g"
    more = [
        (200, prose(60, 50) + (" " + loop) * 5 + " " + prose(61, 40)), (201, " ".join([loop] * 2)), (202, "x " * 11), (203, "x " * 12), (204, ("head\n" + loop + "\n") * 3 + prose(62, 30) + (" y z" * 9)),
        (205, "Aa aa " * 9), (206, (prose(63, 3000) + " ") * 4), (207, prose(64, 30) + "\n" + prose(65, 8) + "\n" + prose(64, 30)), (208, "été « 漢字 »  " * 7),
    ]
    extra = "doc_id long, text string, runs string, n_words string, collapsed string, best string"
    return spark.createDataFrame([(*r, *["x"] * 4) for r in [(i, t) for i, t, _, _ in rows] + more], extra).repartition(3)


def test_documents_equal_brute_force(looping, no_docs):
    made = P.find_runs(looping).collect()
    assert len(made) == looping.count() and sum(bool(r.runs) for r in made) > 8
    for r in made:
        w = words(r.text)
        if len(w) > 20000 - 1:
            assert r.n_words == len(w) and not r.runs
        elif len(w) > 5000:
            assert [tuple(x) for x in r.runs] == [(0, 12000, 3000)]
        else:
            want = brute(w)
            assert [tuple(x) for x in r.runs] == want and r.n_words == len(w) and r.collapsed == collapse(w, want) and r.best == "x"
    assert P.find_runs(no_docs).count() == 0


def test_the_query_equals_brute_force(spark, tmp_path, looping):
    docs = [(i, prose(300 + i, 5 + 7 * i % 150)) for i in range(120)] + [(r.doc_id, r.text) for r in looping.collect() if r.doc_id and r.doc_id >= 200 and r.doc_id != 206] + [(121, None), (122, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in Q.op13_periodic_runs(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 10
    for d, text in docs:
        w = words(text)
        h = zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs, r = brute(w), got[d]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best) and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)) and r.collapsed_sha256 == digest(collapse(w, runs))
