import re

import numpy as np
import pytest

from umbra.llm import jaccard_join as J


def sets_of(rows):
    out = {}
    for doc, text, *_ in rows:
        if doc is not None:
            w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
            out[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return {(d, len(sets[d]), comp[d]) for d in sets}


def family(n):
    base = [f"w{i}" for i in range(60)]
    out = []
    for k in range(n):
        words = list(base)
        for j in range(k % 5):
            words[(k * 7 + j * 13) % 60] = f"x{k}"
        out.append((1000 + k, " ".join(words), "en", "a"))
    return out


def test_equals_brute_force(docs, rows):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.linked(docs).collect() if r.doc_id is not None}
    assert got == brute(rows)


@pytest.mark.parametrize(("small", "pairs"), [(6, 4_000_000), (2, 3)])
def test_families_near_the_threshold(spark, monkeypatch, small, pairs):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "PAIRS", pairs)
    monkeypatch.setattr(J, "LEVELS", 2)
    rows = family(40)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in J.linked(df).collect()} == brute(rows)


def test_linked_sets_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(2)
    for size in (1, 2, 4, 5, 8, 9, 16, 33, 100, 257):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop = int(rng.integers(0, size // 9 + 1))
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, size // 9 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                for level in (0, 1):
                    assert len(np.intersect1d(J.signatures(x, level), J.signatures(y, level)))


def test_empty_and_one_kept(docs, no_docs):
    assert J.linked(no_docs).count() == 0
    kept = {r.doc_id for r in J.keep_one(docs).select("doc_id").collect()}
    assert 1 in kept and None in kept and not kept & {2, 3, 8, 12, 18}


def test_copies_never_meet_and_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "LEVELS", 1)
    monkeypatch.setattr(J, "PAIRS", 200)
    signed, tasks = [], []
    candidates, block_members = J.candidates, J.block_members
    monkeypatch.setattr(J, "candidates", lambda rows, *a: signed.append(rows.count()) or candidates(rows, *a))
    monkeypatch.setattr(J, "block_members", lambda *a: tasks.append(block_members(*a)) or tasks[-1])
    rows = family(60)
    rows += [(5000 + i, rows[3][1], "en", "a") for i in range(300)] + [(7000, "an id with two texts here", "en", "a"), (7001, "an id with two texts here", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in J.linked(df).collect()} == brute(rows)
    assert signed[0] <= 61
    sizes = [r for m in tasks for r in m.groupBy(*J.BLOCK_KEY, "p", "q", "side").count().collect()]
    assert {0, 1} <= {r.side for r in sizes} and max(r["count"] for r in sizes) <= 16


def test_a_mixed_group_is_counted_without_coming_together(spark, monkeypatch):
    """Members of one signature are counted by class; each pair across the largest class meets in some block."""
    import numpy as np

    docs = list(range(100, 160))
    packs = [("group", 0, J._planes(np.full(30, 7, np.uint64), 6), J._planes(np.array(docs[k::2], np.uint64), 8)) for k in (0, 1)]
    found = spark.createDataFrame([(k, h, bytearray(s), bytearray(d)) for k, h, s, d in packs], "kind string, a long, cells binary, docs binary")
    comps = spark.createDataFrame([(d, 100) for d in docs[:40]] + [(d, 140) for d in docs[40:50]], "node long, component long")
    monkeypatch.setattr(J, "COPIES", 0)  # by shuffle with a salt
    mixed = J.mixed_groups(found, comps, 1)
    assert [tuple(r) for r in mixed.select("sig", "n", "outside", "top", "least").collect()] == [(7, 60, 20, 100, 100)]
    members = J.members_of(found, mixed, comps)
    assert members.count() == 60
    rows = J.block_members(members, 8).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault((r.n_left, r.n_right, r.i, r.j, r.p, r.q), ([], []))[r.side].append(r.doc_id)
    met = {(a, b) for left, right in tasks.values() for a in left for b in right}
    assert met >= {(a, b) for a in docs for b in docs[40:]} and len(tasks) > 8


def test_an_id_with_two_texts_ties_their_copies(spark):
    one, two = "a b c d e f g", "h i j k l m n"
    df = spark.createDataFrame([(1, one), (2, one), (2, two), (3, two)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in J.linked(df).collect()} == {(1, 1), (2, 1), (3, 1)}


@pytest.mark.parametrize("most", [60, 9000])
def test_blocks_are_compared_by_products(most):
    """No pair whose cells may be linked is missing, and far fewer pairs than all are left to be compared one by one."""
    rng = np.random.default_rng(most)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, int(rng.integers(5, most)))
        sets += [np.unique(np.where(rng.random(len(base)) < k / 40, rng.integers(0, 2**63, len(base)), base)) for k in range(8)]
    cells = np.stack([np.minimum(np.bincount(s % J.CELLS, minlength=J.CELLS), 255) for s in sets]).astype(np.int16)
    n = np.array([len(s) for s in sets])
    exact = np.stack([9 * np.abs(cells - cells[i]).sum(1, dtype=np.int64) <= n + n[i] for i in range(70)], 1)
    found = J.may_link(cells, cells[:70], n, n[:70])
    assert found.shape == (96, 70) and not (exact & ~found).any() and exact.sum() <= found.sum() < found.size / 3
    assert J.may_link(cells[:0], cells, n[:0], n).shape == (0, 96)
