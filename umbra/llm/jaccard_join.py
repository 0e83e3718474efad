"""Exact n-gram Jaccard join by PartEnum signatures, and its connected classes.

Sets of five-word shingles are linked at a Jaccard similarity of 0.8 or more. Sizes fall into bands, and
sets that may be linked are in one band or in neighbours, so each set takes part in the instance of its own
band and, where a partner of at most 5/4 its size reaches into it, of the next. In an instance the feature
domain is partitioned by hash. Linked sets differ in at most k = (a + b) / 9 features, so of the first k + 1
non-empty partitions of the one whose k + 1st comes first at least one has the same features in the other:
the pair shares the signature (instance, partition, features in it). A set with too few non-empty partitions
has all of them and one signature more that all such sets share. So no link is missed.

Documents with equal sets are one: only the smallest id of them is signed, and the others join its class at
the end. A group of a signature gives the pairs with its smallest member first. Where verified links don't make
it one class, the pairs of different classes follow, by blocks of members; if it is large, its members are signed
again before that under another partitioning, together with the group's signature, which enumerates subsets of
two, three, ... partitions. Candidate pairs are held against counts of features by 1024 cells of the domain, which bound the
difference of the sets from below, and what is left is verified on the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from umbra.llm.common import cut, met, parts_for, shuffle_partitions, text_bytes
from umbra.llm.components import components
from umbra.llm.kernels import mix64, shingle_sets

#: Groups of up to so many sets give all their pairs at once; larger ones the pairs with their smallest member.
SMALL = 6
#: A mixed group whose members outside its largest class make up to so many pairs with the others has their cells
#: compared; beyond, the group is refined first.
PAIRS = 4_000_000
#: A task compares the cells of two blocks of about so many members of a group.
BLOCK = 1000
#: Up to so many documents that repeat others are broadcast; more are joined by shuffle.
COPIES = 500_000
CELLS = 1024
#: Heights of cells' counts at which two blocks are compared by a product of matrices.
LAYERS = 12
#: A bucket of signatures has those of about so many bytes of text, a home the findings of twice as many.
BUCKET_BYTES = 16 << 20
#: Levels of refinement before all blocks of a group that is still large and mixed are compared.
LEVELS = 5
#: Partitions of an instance for each feature of its largest set.
DENSITY = 0.27


def bands() -> list[tuple[int, int]]:
    """(smallest, largest size) of each band, each half as large again as the one before."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, low * 3 // 2)
        out.append((low, high))
        low = high + 1
    return out


BANDS = bands()
LOWS = np.array([low for low, _ in BANDS])


def signatures(features: np.ndarray, level: int = 0, prefixes: np.ndarray | None = None) -> np.ndarray:
    """The signatures of a set of distinct sorted 64-bit features, for each of the groups in prefixes."""
    size = len(features)
    if not size:
        return np.zeros(0, np.uint64)
    if prefixes is None:
        prefixes = np.zeros(1, np.uint64)
    if level:
        features = np.sort(mix64(features ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    codes = mix64(features + np.uint64(1))
    top, widest, band = features >> np.uint64(32), size * 5 // 4, int(np.searchsorted(LOWS, size, "right")) - 1
    out = []
    for instance in (band, band + 1):
        low, high = BANDS[instance]
        if widest < low:
            break
        need = (size + min(widest, high)) // 9 + 1
        parts = max(8, int(np.ceil(DENSITY * high)))
        part = (top * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        seeds = mix64(prefixes ^ np.uint64((instance + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        if len(starts) < need:
            out.append(seeds)
        end = starts[need] if len(starts) > need else size
        starts = starts[:need]
        sums = np.add.reduceat(codes[:end], starts)
        out.append(mix64(sums + (part[starts] + np.uint64(1)) * seeds[:, None]).ravel())
    return np.concatenate(out)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each number, byte by byte, which packs well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    rows = np.zeros((len(data) // width, 8), np.uint8)
    rows[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return rows.view("<u8").ravel()


def _pairs(sig: np.ndarray, doc: np.ndarray, comp: np.ndarray, size: np.ndarray, small: int, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a, b) of rows with equal sig, and which rows are in groups that need refining.

    Only pairs of different classes whose sizes allow a link count. joined marks rows that stand for more.
    """
    order = np.lexsort((doc, sig))
    s = sig[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([start, [len(s)]]))
    first = np.repeat(start, count)
    rank = np.arange(len(s)) - first
    m = np.repeat(count, count)
    left, right = [], []
    large = m > small
    i = np.flatnonzero(large & (rank > 0))
    left.append(i)
    right.append(first[i])
    i = np.flatnonzero(~large & (rank > 0))
    left.append(np.repeat(i, rank[i]))
    right.append(np.repeat(first[i], rank[i]) + np.arange(rank[i].sum()) - np.repeat(np.cumsum(rank[i]) - rank[i], rank[i]))
    a, b = order[np.concatenate(left)], order[np.concatenate(right)]
    ok = (comp[a] != comp[b]) & (doc[a] != doc[b]) & (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b]))
    refine = np.zeros(len(sig), bool)
    if len(s):
        any_joined = np.logical_or.reduceat(joined[order], start)
        refine[order] = large | np.repeat(any_joined & (count > 1), count)
    return a[ok], b[ok], refine


def cells_of(features: np.ndarray) -> bytes:
    """Packed counts, up to 255, of the features by cells of the domain."""
    counts = np.bincount((features & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)


def set_hashes(texts: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2): the size and a 128-bit hash of each document's set."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(x), x.sum(dtype=np.uint64), mix64(x ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)) for x in shingle_sets(batch.column(1))]
            n, h1, h2 = (np.array([f[i] for f in found], np.uint64).astype(np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(h1), pa.array(h2)], names=["doc_id", "n", "h1", "h2"])

    return texts.select("doc_id", "text").mapInArrow(hashed, "doc_id long, n long, h1 long, h2 long")


def equal_sets(hashes: DataFrame) -> DataFrame:
    """(doc_id, rep): documents whose set equals that of a smaller id, with the smallest such id."""
    key = ["n", "h1", "h2"]
    groups = hashes.where("n > 0").groupBy(key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    return few_broadcast(groups, hashes, key).where("doc_id <> rep").select("doc_id", "rep").distinct()


def few_broadcast(some: DataFrame, to: DataFrame, key: list[str] | str, how: str = "inner") -> DataFrame:
    """to joined with some, which is broadcast if it has up to COPIES rows."""
    some = cut(some)
    return to.join(F.broadcast(some) if some.count() <= COPIES else some, key, how)


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose cells don't already differ by more than linked sets can; sets: doc_id, n, cells."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = lambda data: np.frombuffer(zlib.decompress(data), np.uint8).astype(np.int16)
        for batch in batches:
            b_of: dict[int, np.ndarray] = {}
            ok = []
            for a, b, n, m, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b not in b_of:
                    b_of = {b: counts(y)}  # rows come sorted by b
                ok.append(5 * min(n, m) >= 4 * max(n, m) and 9 * int(np.abs(counts(x) - b_of[b]).sum()) <= n + m)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    one = sets.join(pairs, F.col("doc_id") == F.col("a")).select("a", "b", F.col("n").alias("n_a"), F.col("cells").alias("cells_a"))
    two = sets.join(one, F.col("doc_id") == F.col("b")).select("a", "b", "n_a", F.col("n").alias("n_b"), "cells_a", F.col("cells").alias("cells_b"))
    return two.mapInArrow(check, "a long, b long")


def _bucketed(kind: str, key: np.ndarray, buckets: int, columns: tuple[tuple[np.ndarray, int], ...], schema: pa.Schema) -> pa.RecordBatch:
    """A row for each bucket of key (modulo buckets): kind, bucket, and the columns packed to so many bytes a number."""
    bucket = key % buckets
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    parts = [order[cuts[i] : cuts[i + 1]] for i in full]
    packed = [pa.array([_planes(x[p], w) for p in parts], pa.binary()) for x, w in columns]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(full), pa.string()), pa.array(full, pa.int64()), *packed], schema=schema)


def _whole(values: list[bytes | None], width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(_numbers(x, width) for x in values if x)])


def pairs_of(found: DataFrame) -> DataFrame:
    """The distinct candidate pairs (a, b), a > b; packs of them come by the bucket of a."""

    def unpack(rows: pa.Table) -> pa.Table:
        pairs = np.unique(np.stack([_whole(rows[c].to_pylist(), 8).astype(np.int64) for c in ("cells", "docs")], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return found.where("kind = 'pair'").select("a", "cells", "docs").groupBy("a").applyInArrow(unpack, "a long, b long")


SUMS = pa.schema([("home", pa.int64()), ("sigs", pa.binary()), ("comps", pa.binary()), ("ns", pa.binary()), ("leasts", pa.binary())])
SUMS_SQL = "home long, sigs binary, comps binary, ns binary, leasts binary"


def mixed_groups(found: DataFrame, comps: DataFrame, homes: int) -> DataFrame:
    """(sig, n, outside, top, least): groups of a signature that hold more than one class.

    n is the number of members, top the largest class, outside how many aren't in it, least the smallest member. No
    group comes together for that: members are counted by class where their documents are, counts of a class meet by
    signature and class, and a signature's classes are summed up by Spark's aggregation.
    """

    def count(groups: pa.Table, known: pa.Table) -> pa.Table:
        sig, doc = _whole(groups["cells"].to_pylist(), 6), _whole(groups["docs"].to_pylist(), 8).astype(np.int64)
        node, comp = known["node"].to_numpy(), known["component"].to_numpy()
        order = np.argsort(node)
        node, comp = node[order], comp[order]
        at = np.minimum(np.searchsorted(node, doc), max(len(node) - 1, 0))
        own = np.where(node[at] == doc, comp[at], doc) if len(node) else doc
        order = np.lexsort((doc, own, sig))
        sig, doc, own = sig[order], doc[order], own[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])]) if len(sig) else np.zeros(0, bool)
        return pa.Table.from_batches([_summed(sig[new], own[new], np.ones(int(new.sum()), np.int64), doc[new], homes)])

    def merge(rows: pa.Table) -> pa.Table:
        sig, comp, n, least = _sums(rows)
        order = np.lexsort((n, sig))
        sig, comp, n, least = sig[order], comp[order], n[order], least[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        last = np.append(start[1:], len(sig)) - 1
        columns = {"sig": sig[start].astype(np.int64), "classes": last - start + 1, "n": np.add.reduceat(n, start), "top_n": n[last], "top": comp[last], "least": np.minimum.reduceat(least, start)}
        return pa.table(columns)

    groups = found.where("kind = 'group'").select(F.col("a").alias("home"), "cells", "docs")
    known = comps.withColumn("home", F.pmod("node", F.lit(homes)))
    summed = groups.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(count, SUMS_SQL).groupBy("home").applyInArrow(merge, "sig long, classes long, n long, top_n long, top long, least long")
    whole = summed.groupBy("sig").agg(F.sum("classes").alias("classes"), F.sum("n").alias("n"), F.max("top_n").alias("top_n"), F.max_by("top", F.struct("top_n", "top")).alias("top"), F.min("least").alias("least"))
    return whole.where("classes > 1").select("sig", "n", (F.col("n") - F.col("top_n")).alias("outside"), "top", "least")


def _sums(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Unpacked (sig, comp, n, least), one for each signature and class."""
    sig, comp, n, least = (_whole(rows[c].to_pylist(), w) for c, w in (("sigs", 6), ("comps", 8), ("ns", 8), ("leasts", 8)))
    return _by_class(sig, comp.astype(np.int64), n.astype(np.int64), least.astype(np.int64))


def _by_class(sig: np.ndarray, comp: np.ndarray, n: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((comp, sig))
    sig, comp, n, least = sig[order], comp[order], n[order], least[order]
    start = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (comp[1:] != comp[:-1])])) if len(sig) else np.zeros(0, np.int64)
    if not len(start):
        return sig, comp, n, least
    return sig[start], comp[start], np.add.reduceat(n, start), np.minimum.reduceat(least, start)


def _summed(sig: np.ndarray, comp: np.ndarray, n: np.ndarray, least: np.ndarray, homes: int) -> pa.RecordBatch:
    """Packs of (sig, comp, n, least) by the hash of signature and class."""
    sig, comp, n, least = _by_class(sig, comp, n, least)
    home = (mix64(sig + mix64(comp.astype(np.uint64))) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(homes + 1))
    full = np.flatnonzero(np.diff(cuts))
    parts = [order[cuts[i] : cuts[i + 1]] for i in full]
    columns = [pa.array([_planes(x[p], w) for p in parts], pa.binary()) for x, w in ((sig, 6), (comp, 8), (n, 8), (least, 8))]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *columns], schema=SUMS)


def members_of(found: DataFrame, mixed: DataFrame, comps: DataFrame) -> DataFrame:
    """(sig, doc_id, comp, n, outside, top, least): the members of mixed groups with their classes; some come twice."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sigs, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(sigs, 6).astype(np.int64)), pa.array(_numbers(docs, 8).astype(np.int64))], names=["sig", "doc_id"])

    rows = found.where("kind = 'group'").select("cells", "docs").mapInArrow(unpack, "sig long, doc_id long")
    known = comps.select(F.col("node").alias("doc_id"), "component")
    joined = met(rows, mixed, "sig", "doc_id", COPIES).join(known, "doc_id", "left")
    return joined.select("sig", "doc_id", F.coalesce("component", "doc_id").alias("comp"), "n", "outside", "top", "least")


BLOCK_KEY = ["least", "n_left", "n_right", "i", "j"]


def _dealt(n_left: Column, n_right: Column, bits: Column, left: Column, right: Column) -> Column:
    """array<struct<side, i, j>>: a member of the left side goes to its own i and every j, one of the right to its j and every i."""
    i, j = (F.pmod(bits, n).cast("int") for n in (n_left, n_right))
    upto = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    lefts = F.transform(upto(n_right), lambda x: F.struct(F.lit(0).alias("side"), i.alias("i"), x.alias("j")))
    rights = F.transform(upto(n_left), lambda x: F.struct(F.lit(1).alias("side"), x.alias("i"), j.alias("j")))
    return F.concat(F.when(left, lefts).otherwise(F.slice(lefts, 1, 0)), F.when(right, rights).otherwise(F.slice(rights, 1, 0)))


def block_members(members: DataFrame, block: int | None = None) -> DataFrame:
    """(least, n_left, n_right, i, j, p, q, side, doc_id, comp): by what tasks members of mixed groups are to be compared.

    All members (side 0) are compared with those outside the largest class (side 1), by blocks of about `block` by the
    hash of the document. Groups with the same smallest member mostly are the same documents and share their
    blocks; blocks that they have made large together are split again, by p and q.
    """
    block = block or BLOCK
    blocks = lambda n: F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(n / block)))).cast("long")
    hashed = F.xxhash64("doc_id")
    sized = members.withColumns({"n_left": blocks(F.col("n")), "n_right": blocks(F.col("outside"))})
    dealt = sized.select("least", "n_left", "n_right", "doc_id", "comp", F.inline(_dealt(F.col("n_left"), F.col("n_right"), hashed, F.lit(True), F.col("comp") != F.col("top")))).distinct()
    dealt = cut(dealt)
    counts = dealt.groupBy(*BLOCK_KEY).agg(F.count_if(F.col("side") == 0).alias("lefts"), F.count_if(F.col("side") == 1).alias("rights"))
    large = cut(counts.where(F.greatest("lefts", "rights") > block).select(*BLOCK_KEY, blocks(F.col("lefts")).alias("m_left"), blocks(F.col("rights")).alias("m_right")))
    if large.isEmpty():
        return dealt.withColumns({"p": F.lit(0), "q": F.lit(0)})
    split = dealt.join(F.broadcast(large) if large.count() <= COPIES else large, BLOCK_KEY, "left").fillna(1, ["m_left", "m_right"])
    again = _dealt(F.col("m_left"), F.col("m_right"), F.shiftright(hashed, 32), F.col("side") == 0, F.col("side") == 1)
    return split.select(*BLOCK_KEY, "doc_id", "comp", F.inline(F.transform(again, lambda x: F.struct(x.side.alias("side"), x.i.alias("p"), x.j.alias("q")))))


def may_link(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Whether each x (counts by cells) may be linked with each y: a matrix with no link missing, by the product of which cells have counts of 1, 2, ...

    Counts that two sets share are those of each height that both reach. Where few are left above a height, or at LAYERS, all that both have above it is taken for shared.
    """
    shared, rest = np.zeros((len(x), len(y)), np.float32), [x, y]
    for _ in range(LAYERS):
        shared += (rest[0] > 0).astype(np.float32) @ (rest[1] > 0).astype(np.float32).T
        rest = [np.maximum(z - 1, 0) for z in rest]
        if any(40 * z.sum(dtype=np.int64) <= n.sum() for z, n in zip(rest, (n_x, n_y), strict=True)):
            break
    shared += np.minimum(rest[0].sum(1, dtype=np.float32)[:, None], rest[1].sum(1, dtype=np.float32))
    sums = x.sum(1, dtype=np.float32)[:, None] + y.sum(1, dtype=np.float32)
    return 9 * (sums - 2 * shared) <= (n_x[:, None] + n_y).astype(np.float32) + 1  # one more than exact, for what floats round


def cross_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes whose cells may be linked, among the members of mixed groups.

    A task holds one block of each side, with one copy of each document's cells, and only pairs that pass leave it.
    """

    def pair(rows: pa.Table) -> pa.Table:
        side, doc, comp, n = (rows[c].to_numpy() for c in ("side", "doc_id", "comp", "n"))
        docs, first, which = np.unique(doc, return_index=True, return_inverse=True)
        comp, n, packed = comp[first], n[first], rows["cells"].take(pa.array(first)).to_pylist()
        cells = np.stack([np.frombuffer(zlib.decompress(x), np.uint8) for x in packed]).astype(np.int16)
        left, right = (np.unique(which[side == k]) for k in (0, 1))
        both = np.isin(left, right)
        whole = rows["n_left"][0].as_py() == rows["n_right"][0].as_py() == 1  # then each pair outside the largest class would come twice
        found = [np.zeros((0, 2), np.int64)]
        for some in np.array_split(right, len(right) // BLOCK + 1):
            near = may_link(cells[left], cells[some], n[left], n[some]) & (comp[left][:, None] != comp[some])
            if whole:
                near &= ~(both[:, None] & (left[:, None] > some))
            j, i = np.nonzero(near)
            j, i = left[j], some[i]
            for part in np.array_split(np.arange(len(j)), len(j) // 4000 + 1):
                a, b = j[part], i[part]
                ok = (9 * np.abs(cells[a] - cells[b]).sum(1, dtype=np.int64) <= n[a] + n[b]) & (9 * np.abs(n[a] - n[b]) <= n[a] + n[b])
                found.append(np.stack([np.maximum(docs[a[ok]], docs[b[ok]]), np.minimum(docs[a[ok]], docs[b[ok]])], 1))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    key = [*BLOCK_KEY, "p", "q"]
    with_cells = block_members(members).join(sets, "doc_id").select(*key, "side", "doc_id", "comp", "n", "cells")
    return with_cells.groupBy(*key).applyInArrow(pair, "a long, b long").distinct()


GROUPED = "bucket int, sigs binary, docs binary, comps binary, sizes binary, joined binary, kind string"
FOUND = "kind string, a long, b long, cells binary, docs binary"
FOUND_ARROW = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("cells", pa.binary()), ("docs", pa.binary())])


def candidates(rows: DataFrame, level: int, buckets: int, homes: int) -> DataFrame:
    """(kind, a, b, cells, docs): 'pair' holds packs of candidate pairs by the bucket of the larger id (a), 'group' packs of
    (signature, document) of groups that gave part of their pairs, by the bucket of the document (a), and 'set', at
    level 0, a document (a), the size of its set (b) and its packed cells.

    rows: doc_id, comp (its class so far), prefixes (signatures of the groups to refine; 0 for none), text. A task
    first meets its own rows: of a signature that many of them share it passes on the smallest alone.
    """
    small = SMALL
    packed = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("sigs", "docs", "comps", "sizes", "joined")), ("kind", pa.string())])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Runs of rows of 400,000 signatures or so: ids, classes, sizes of sets, signatures, packed cells."""
        held: list[tuple] = []
        n = 0
        for batch in batches:
            prefixes = batch.column(2)
            for doc, comp, prefix, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), prefixes, shingle_sets(batch.column(3)), strict=True):
                sigs = signatures(features, level, prefix.values.to_numpy().astype(np.uint64))
                held.append((doc, comp, len(features), sigs, b"" if level else cells_of(features)))
                n += len(sigs)
                if n > 400_000:
                    yield (*(np.array(x, np.int64) for x in list(zip(*held, strict=True))[:3]), [x[3] for x in held], [x[4] for x in held])
                    held, n = [], 0
        if held:
            yield (*(np.array(x, np.int64) for x in list(zip(*held, strict=True))[:3]), [x[3] for x in held], [x[4] for x in held])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, comps, sizes, sigs, cells in signed(batches):
            if not level:
                home = pa.array(ids % buckets, pa.int32())
                yield pa.RecordBatch.from_arrays([home, *(pa.array([int(v).to_bytes(8, "little", signed=True) for v in x], pa.binary()) for x in (ids, sizes)), pa.array(cells, pa.binary()), *(pa.array([b""] * len(ids), pa.binary()) for _ in range(2)), pa.array(["set"] * len(ids))], schema=packed)
            row = np.repeat(np.arange(len(ids)), [len(x) for x in sigs])
            sig = np.concatenate(sigs) & np.uint64((1 << 48) - 1)
            doc, comp, size = ids[row], comps[row], sizes[row]
            order = np.argsort(sig, kind="stable")
            s = sig[order]
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            many = np.zeros(len(s), bool)
            many[order] = np.repeat(np.diff(np.concatenate([start, [len(s)]])) > small, np.diff(np.concatenate([start, [len(s)]])))
            send, joined = ~many, np.zeros(len(s), bool)
            if many.any():
                at = np.flatnonzero(many)
                at = at[np.lexsort((doc[at], sig[at]))]
                lead = np.concatenate([[True], sig[at][1:] != sig[at][:-1]])
                send[at[lead]] = joined[at[lead]] = True
                a, b, _ = _pairs(sig[at], doc[at], comp[at], size[at], small, joined[at])
                local = np.unique(np.stack([doc[at][a], doc[at][b]], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
                home = int(mix64(ids[:1].astype(np.uint64))[0] % np.uint64(buckets))  # by the run, not by the group, which many runs have
                for kind, x, y in (("pair", local[:, 0], local[:, 1]), ("group", sig[at], doc[at])):
                    yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), *(pa.array([v], pa.binary()) for v in (_planes(x, 8), _planes(y, 8), b"", b"", b"")), pa.array([kind])], schema=packed)
            else:
                send[:] = True
            sig, doc, comp, size, joined = sig[send], doc[send], comp[send], size[send], joined[send]
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut_at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut_at))
            part = [order[cut_at[b] : cut_at[b + 1]] for b in full]
            columns = [pa.array(full, pa.int32())]
            columns += [pa.array([_planes(x[p], w) for p in part], pa.binary()) for x, w in ((sig, 6), (doc, 8), (comp - doc, 8), (size, 4), (joined, 1))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(["rows"] * len(full))], schema=packed)

    def meet(rows: pa.Table) -> pa.Table:
        t = rows.combine_chunks().to_pydict()
        at = {kind: [i for i, k in enumerate(t["kind"]) if k == kind] for kind in ("rows", "pair", "group", "set")}

        def whole(kind: str, name: str, width: int) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.uint64), *(_numbers(t[name][i], width) for i in at[kind])])

        sig, doc, size, joined = whole("rows", "sigs", 6), whole("rows", "docs", 8).astype(np.int64), whole("rows", "sizes", 4).astype(np.int64), whole("rows", "joined", 1).astype(bool)
        comp = whole("rows", "comps", 8).astype(np.int64) + doc
        a, b, refine = _pairs(sig, doc, comp, size, small, joined)
        x = np.concatenate([doc[a], whole("pair", "sigs", 8).astype(np.int64)])
        y = np.concatenate([doc[b], whole("pair", "docs", 8).astype(np.int64)])
        pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0)
        member = np.concatenate([doc[refine], whole("group", "docs", 8).astype(np.int64)])
        of = np.concatenate([sig[refine], whole("group", "sigs", 8)])
        sets = {"kind": ["set"] * len(at["set"]), "a": whole("set", "sigs", 8).astype(np.int64), "b": whole("set", "docs", 8).astype(np.int64), "cells": [t["comps"][i] for i in at["set"]], "docs": [None] * len(at["set"])}
        two = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("cells", pa.binary()), ("docs", pa.binary())])
        packs = pa.Table.from_batches([_bucketed("pair", pairs[:, 0], homes, ((pairs[:, 0], 8), (pairs[:, 1], 8)), two), _bucketed("group", member, homes, ((of, 6), (member, 8)), two)])
        return pa.concat_tables([pa.table(sets, schema=FOUND_ARROW), packs.add_column(2, "b", pa.nulls(len(packs), pa.int64())).cast(FOUND_ARROW)])

    return rows.select("doc_id", "comp", "prefixes", "text").mapInArrow(sign, GROUPED).groupBy("bucket").applyInArrow(meet, FOUND)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents whose shingle sets have a Jaccard similarity of 0.8 or more; pairs are read twice."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            # rows come sorted by b, so a set that many pairs need is made once
            _, first, which = np.unique(b, return_index=True, return_inverse=True)
            right = list(shingle_sets(batch.column(3).take(pa.array(first))))
            ok = np.zeros(len(a), bool)
            for i, left in enumerate(shingle_sets(batch.column(2))):
                other = right[which[i]]
                both = len(np.intersect1d(left, other, assume_unique=True))
                ok[i] = both > 0 and 100 * both >= 80 * (len(left) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = few_broadcast(ids, docs.select("doc_id", "text"), "doc_id", "left_semi")  # few documents have a pair
    one = texts.join(pairs, F.col("doc_id") == F.col("a")).select("a", "b", F.col("text").alias("text_a"))
    two = texts.join(one, F.col("doc_id") == F.col("b")).select("a", "b", "text_a", F.col("text").alias("text_b"))
    return two.mapInArrow(check, "a long, b long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n): the size of each document's set, (node, component): the class of each linked document)."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    hashes = cut(set_hashes(texts))
    copies = cut(equal_sets(hashes))
    # an id that is repeated with another text may stand for that one's set and stays
    gone = copies.select("doc_id").distinct().join(copies.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_anti")
    # only the first signing has to leave the others out: none of them is in a pair or a group then
    rows = few_broadcast(gone, texts, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("comp"), F.array(F.lit(0).cast("long")).alias("prefixes"), "text")
    # signatures meet in many small buckets; what is found out goes home to documents in fewer, larger packs
    size, partitions = text_bytes(texts), shuffle_partitions(docs.sparkSession)
    buckets, homes = parts_for(size, BUCKET_BYTES, 2 * partitions), parts_for(size, 2 * BUCKET_BYTES, partitions // 2)
    sets = links = comps = None

    def link(pairs: DataFrame) -> None:
        nonlocal links, comps
        new = cut(verified(cut(pairs), texts))
        if comps is None or not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            comps = components(links)

    for level in range(LEVELS + 1):
        found = cut(candidates(rows, level, buckets, homes))
        if not level:
            sets = found.where("kind = 'set'").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "cells").dropDuplicates(["doc_id"])
        link(near(pairs_of(found), sets))
        mixed = cut(mixed_groups(found, comps, homes))
        if mixed.isEmpty():
            break
        members = cut(members_of(found, mixed, comps))
        refined = F.lit(level < LEVELS) & (F.col("outside") * F.col("n") > PAIRS)
        link(cross_pairs(members.where(~refined), sets))
        again = members.where(refined).groupBy("doc_id").agg(F.first("comp").alias("comp"), F.collect_set("sig").alias("prefixes"))
        if (again := cut(again)).isEmpty():
            break
        rows = texts.join(again, "doc_id").select("doc_id", "comp", "prefixes", "text")
    return hashes.select("doc_id", "n").dropDuplicates(["doc_id"]), with_copies(comps, copies)


def with_copies(comps: DataFrame, copies: DataFrame) -> DataFrame:
    """(node, component): the classes with those of the documents that have equal sets joined in."""
    several = copies.groupBy("doc_id").count().where("count > 1").select("doc_id")
    both = several.unionByName(copies.join(copies.select(F.col("rep").alias("r")).distinct(), F.col("doc_id") == F.col("r")).select("doc_id"))
    if not both.isEmpty():  # ids repeated with other texts tie classes together
        return components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    # a small id's class is asked once for all its copies
    heads = copies.select("rep").distinct().join(comps, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"))
    joined = few_broadcast(heads, copies, "rep").select(F.col("doc_id").alias("node"), "component")
    return comps.unionByName(joined).unionByName(heads.select(F.col("rep").alias("node"), "component")).distinct()


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document.

    Words are split at white space and A-Z lower-cased. A text of fewer than five words is one shingle; a
    null text and one without words have none and are linked with nothing. Rows that repeat an id are one
    document; a null id has neither a size nor a class.
    """
    sets, comps = classes(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(sets, "doc_id", "left")
    return ids.join(comps, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that are linked, over others or not, with one of a smaller id."""
    gone = classes(docs)[1].where("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
