"""Ranked search against plain scoring; shared sets against the items they come from."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from umbra.llm import lexical_search as S


def terms(text):
    return re.findall(S.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    by_item = {}
    for i, text in items:
        if i is not None:
            by_item.setdefault(i, []).extend(terms(text))
    for i, asked in by_item.items():
        scored = []
        for d, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // n_all
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_shared_sets_add_up():
    rng = random.Random(2)
    common = [rng.choices(range(60), k=12) for _ in range(5)]
    items = [sorted(rng.choices(range(60), k=rng.randint(1, 30)) + rng.choice(common) * rng.randint(0, 2)) for _ in range(60)]
    nodes, rows = S.shared_sets(items, 60)

    def leaves(node):
        return [node] if node < 60 else [x for part in nodes[node - 60] for x in leaves(part)]

    assert [sorted(x for node in row for x in leaves(node)) for row in rows] == items
    used = Counter(x for row in rows for x in set(row)) + Counter(x for pair in nodes for x in pair)
    assert len(nodes) > 40 and sum(map(len, rows)) + 2 * len(nodes) < 0.8 * sum(map(len, items))
    assert all(used[60 + i] >= 1 for i in range(len(nodes)))
    plan = S.Plan.of(items, 60)
    values = np.zeros((plan.n_nodes, 7), np.int64)
    values[:60] = np.random.default_rng(1).integers(0, 10**9, (60, 7))
    want = np.array([values[np.array(item)].sum(axis=0) for item in items])
    assert (plan.scores(values) == want).all()


@pytest.fixture(scope="module")
def items(spark):
    texts = [(1, "w1a w2b w3c w3c line IS in many"), (2, "of the documents w1a w2b"), (3, "zzz never"), (4, None), (5, ""), (None, "w1a"), (6, "déjà été 漢字 few"), (7, "w1a w2b w3c w3c line IS in many"), (2, "w5e"), (8, "the"), (9, "a,a a.A")]
    return spark.createDataFrame([(*t, "x") for t in texts], "item_id long, text string, score string")


def test_search_equals_plain_scoring(docs, no_docs, items, spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    key = lambda df: sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    want = brute(rows, asked)
    assert key(S.search(docs, items)) == want and len(want) > 40
    monkeypatch.setattr(S, "BLOCK_TERMS", 8)
    monkeypatch.setattr(S, "GROUP_SCORES", 40)
    monkeypatch.setattr(S, "HELD", 5)
    assert key(S.search(docs, items, 3)) == brute(rows, asked, 3)
    for d, i in ((no_docs, items), (docs, items.limit(0)), (docs.where("text is null"), items)):
        assert S.search(d, i).count() == 0
