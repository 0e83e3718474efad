import numpy as np

from umbra.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    import string

    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    key = lambda line: line.strip(SPACE).translate(lower)
    ids = {}
    for doc, text, *_ in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                ids.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [doc is not None and len(key(x)) >= 10 and len(ids[key(x)]) > 1 and doc > min(ids[key(x)]) for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=str)


def test_equals_brute_force(docs, rows):
    out = L.dedup_lines(docs, L.line_index(docs, batches=3))
    assert set(docs.columns) <= set(out.columns)
    assert got(out) == brute(rows)


def test_empty(no_docs):
    assert L.dedup_lines(no_docs, L.line_index(no_docs)).count() == 0


def test_deleting_undoes_adding(spark, docs, rows):
    some = docs.where("doc_id < 10")
    index = L.insert(L.insert(L.new_index(spark, 8), some), docs.where("doc_id >= 10"))
    index = L.delete(index, docs.where("doc_id >= 10").select("doc_id"))
    counts = lambda i: sorted((bytes(r.key), r.n_refs, r.first_doc, r.last_doc) for r in i.counts.collect())
    assert counts(index) == counts(L.insert(L.new_index(spark, 8), some))
    held = sum(len(L.CuckooFilter.from_bytes(f)) for r in index.filters.collect() for f in r.filters)
    assert held == index.counts.count()
    assert got(L.dedup_lines(some, index)) == brute([r for r in rows if r[0] is not None and r[0] < 10])


def test_filter_has_no_false_negatives_and_can_forget():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    f = L.CuckooFilter.sized_for(len(keys))
    assert f.insert(keys)
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.001
    f.remove(keys[:10_000])
    assert f.contains(keys[10_000:]).all()
    assert len(f) == 10_000


def test_a_full_index_gets_more_shards(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(L, "KEYS_A_SHARD", 3)
    index = L.insert(L.new_index(spark, 2), docs.where("doc_id < 10"))
    assert index.n_keys > 6
    more = L.insert(index, docs.where("doc_id >= 10"))
    assert more.n_shards > 2 and more.n_shards * 3 >= index.n_keys
    filters = {r.shard: [L.CuckooFilter.from_bytes(f) for f in r.filters] for r in more.filters.collect()}
    keys = more.counts.collect()
    assert all(any(f.contains(L.hash64([bytes(r.key)]))[0] for f in filters[r.shard]) for r in keys)
    assert sum(len(f) for fs in filters.values() for f in fs) == len(keys) == more.n_keys
    assert got(L.dedup_lines(docs, more)) == brute(rows)
