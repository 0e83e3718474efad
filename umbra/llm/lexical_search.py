"""Ranked lexical search for many items at once, with what they have in common computed once for each document.

1. Items are dealt in blocks with a bounded number of terms. For each block, one pass over the documents counts the
   block's terms in them; document frequencies and lengths are sums over that table.
2. Shared term sets are mined among a block's items: their terms are put in order of how many items have them, and the
   pair of neighbours that most items share becomes a node of its own, again and again. Nodes are sums of two, so they and
   the items form a graph that says which partial scores serve which items.
3. Documents come in small groups. A group has one row of partial scores for each node: terms first, then shared sets level by
   level, each computed once; an item's scores are the sum of the few nodes left in it. A task keeps the best of each
   item, and the best of all tasks are ranked once more by salted windows.

Scores are exact whatever is shared. A term's identity is a hash of 64 bits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from umbra.llm.common import cut, parts_for
from umbra.llm.kernels import ALNUM, blocks, word_hashes

#: What a term is; A-Z alone are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of the items of one block, with repeats (an item with more is a block of its own), and partial scores of one group of documents.
BLOCK_TERMS, GROUP_SCORES = 1 << 18, 1 << 21
#: Candidates a task holds before it keeps the best alone, and how many tasks one item's candidates are dealt to.
HELD, SALTS = 1 << 18, 32
K1_MILLI, B_PERCENT = 8, 75


def terms_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, term hashes, their rows from the first one on) of blocks of texts."""
    for first, end, buf, offsets in blocks(column):
        hashes, row = word_hashes(buf, offsets, ALNUM)
        yield first, end, hashes, row


def shared_sets(items: list[list[int]], n_terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(nodes, what is left of the items): node n_terms + i is the sum of the two nodes[i], which at least two items share.

    items: lists of terms, with repeats. The most shared pair of neighbours goes first.
    """
    held_by = Counter(t for item in items for t in set(item))
    rows = [sorted(item, key=lambda t: (-held_by[t], t)) for item in items]
    pairs_of = lambda row: set(zip(row, row[1:], strict=False))
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, row in enumerate(rows):
        for pair in pairs_of(row):
            where[pair].add(i)
    heap = [(-len(w), p) for p, w in where.items() if len(w) > 1]
    heapify(heap)
    nodes: list[tuple[int, int]] = []
    while heap:
        n, pair = heappop(heap)
        if len(where[pair]) < 2:
            continue
        if len(where[pair]) != -n:  # fewer items have it than when it was put here
            heappush(heap, (-len(where[pair]), pair))
            continue
        node = n_terms + len(nodes)
        nodes.append(pair)
        touched: set[tuple[int, int]] = set()
        for i in list(where[pair]):
            old, new, at = rows[i], [], 0
            while at < len(old):
                both = at + 1 < len(old) and (old[at], old[at + 1]) == pair
                new.append(node if both else old[at])
                at += 2 if both else 1
            before, after = pairs_of(old), pairs_of(new)
            for p in before - after:
                where[p].discard(i)
            for p in after - before:
                where[p].add(i)
            touched |= after - before
            rows[i] = new
        for p in touched:
            if len(where[p]) > 1:
                heappush(heap, (-len(where[p]), p))
    return nodes, rows


@dataclass
class Plan:
    """How the scores of a block's items come from those of its terms."""

    n_terms: int
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (node, left, right) of each level
    parts: np.ndarray  # the nodes of all items one after the other
    begins: np.ndarray  # where an item's nodes begin
    n_nodes: int

    @classmethod
    def of(cls, items: list[list[int]], n_terms: int) -> Plan:
        nodes, rows = shared_sets(items, n_terms)
        level = [0] * n_terms
        by_level: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, (a, b) in enumerate(nodes):
            level.append(1 + max(level[a], level[b]))
            by_level[level[-1]].append((n_terms + i, a, b))
        steps = [tuple(np.array(x, np.int64) for x in zip(*by_level[k], strict=True)) for k in sorted(by_level)]
        sizes = np.array([len(r) for r in rows], np.int64)
        return cls(n_terms, steps, np.array([x for r in rows for x in r], np.int64), np.cumsum(sizes) - sizes, n_terms + len(nodes))

    def scores(self, partial: np.ndarray) -> np.ndarray:
        """(items, documents): partial has a row for each node, with those of the terms filled in."""
        for node, left, right in self.steps:
            partial[node] = partial[left] + partial[right]
        return np.add.reduceat(partial[self.parts], self.begins, axis=0)


def counted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and which of the sorted vocabulary it has how often; documents with no term are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, row in terms_of(batch.column(1)):
                n = np.bincount(row, minlength=end - first)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                key, tf = np.unique(row[known] * len(vocabulary) + at[known], return_counts=True)
                rows, term = key // len(vocabulary), key % len(vocabulary)
                offsets = pa.array(np.searchsorted(rows, np.arange(end - first + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                made = pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield made.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each item; greater scores first, then smaller ids."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
    return item[rank < k], score[rank < k], doc[rank < k]


def _scored(postings: DataFrame, plan: Plan, weights: np.ndarray, item_ids: np.ndarray, n_docs: int, n_all: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of each item in each task."""
    width = max(1, GROUP_SCORES // plan.n_nodes)
    least_of = 100 - B_PERCENT

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial = np.zeros((plan.n_nodes, width), np.int64)
        floor_of = np.ones(len(item_ids), np.int64)  # what a score must have to be among an item's best
        held = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        n_held = 0

        def trimmed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            item, value, doc = _best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
            count = np.bincount(item, minlength=len(item_ids))
            last = np.cumsum(count) - 1
            full = count == k
            floor_of[full] = value[last[full]]
            return item, value, doc

        for batch in batches:
            ids = batch.column(0).to_numpy()
            m = np.array([least_of + B_PERCENT * n * n_docs // n_all for n in batch.column(1).to_pylist()], np.int64)
            terms, tfs = batch.column(2), batch.column(3)
            offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
            term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(ids)), np.diff(offsets))
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + K1_MILLI * m[row]))
            for a in range(0, len(ids), width):
                b = min(a + width, len(ids))
                own = slice(offsets[a], offsets[b])
                partial[: plan.n_terms] = 0
                partial[term[own], row[own] - a] = value[own]
                scores = plan.scores(partial)[:, : b - a]
                item, at = np.nonzero(scores >= floor_of[:, None])
                held.append((item, scores[item, at], ids[a + at]))
                n_held += len(item)
                if n_held > HELD:
                    held = [trimmed()]
                    n_held = len(held[0][0])
        item, value, doc = trimmed()
        yield pa.RecordBatch.from_arrays([pa.array(item_ids[item]), pa.array(doc), pa.array(value)], names=["item_id", "doc_id", "score"])

    return postings.where("doc_id is not null and size(terms) > 0").mapInArrow(score, "item_id long, doc_id long, score long")


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    """The k best documents of each item in each task, for the items of one block (as many as the driver can hold)."""
    found = items.select(F.col("item_id").cast("long"), "text").toArrow()
    of_item: dict[int, list[int]] = {}
    ids = found.column(0).to_pylist()
    for first, _, hashes, row in terms_of(found.column(1).combine_chunks()):
        for h, r in zip(hashes.tolist(), row.tolist(), strict=True):
            of_item.setdefault(ids[first + r], []).append(h)
    if not of_item:
        return None
    vocabulary = np.unique(np.array([h for item in of_item.values() for h in item], np.uint64))
    numbers = {h: i for i, h in enumerate(vocabulary.tolist())}
    postings = cut(counted(docs, vocabulary))
    n_docs, n_all = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row for each term of the block at most
        weights[r["term"]] = floor(1000 * log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    plan = Plan.of([[numbers[h] for h in item] for item in of_item.values()], len(vocabulary))
    return _scored(postings, plan, weights, np.array(list(of_item), np.int64), n_docs, n_all, k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for each item with a score above 0, greater scores first, then smaller ids.

    docs: doc_id, text; items: item_id, text; ids are whole numbers. Rows of items that repeat an id are one item with all
    their terms; items without an id or a term find nothing. Each row of docs is a document of its own; null and empty texts have no
    term and count for nothing, and rows without an id count in the statistics but aren't ranked.
    """
    asked = items.where("item_id is not null")
    n_terms = asked.agg(F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TERM), F.lit(0))))).first()[0] or 0
    n = parts_for(n_terms, BLOCK_TERMS, 1)
    made = None
    for i in range(n):
        block = _block(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i), k)
        made = block if made is None else made if block is None else made.unionByName(block)
    if made is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = (F.desc("score"), F.col("doc_id"))
    some = made.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "__salt").orderBy(*best))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
