"""Periodic runs of words by suffix trees: maximal repetitions such as looping phrases and tables of one row.

A run is a stretch of words with a smallest period, at least twice as long as that, that no neighbouring word extends.
Every run has a Lyndon root: a stretch of one period that is the longest Lyndon word at its start, for the order of words
or the reversed one. So the longest Lyndon words of both orders are all candidates there are, two for each word. Each is
extended to both sides by longest common extensions: to the right in Ukkonen's suffix tree of the document, to the left in
that of its reversal, both by lowest common ancestors in constant time on an Euler tour.

Two words that are a period apart in a run of MIN_WORDS or more begin equal stretches of half as many words, so a run lies
where each word is in such a stretch that repeats. Trees are made of these parts of a text; elsewhere there can be no run.
A text is handled in one task; in its repeating parts it needs some 300 bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from umbra.llm.kernels import SPACES, blocks, mix64, prefix_hashes, span_hashes, words

MIN_WORDS = 12
END = -1


class SuffixTree:
    """The suffix tree of a sequence of numbers from 0 on, by Ukkonen's algorithm; leaf k is the one of suffix k."""

    def __init__(self, sequence: list[int]):
        s = [*sequence, END]
        n = len(s)
        self.s, self.start, self.end, self.leaves = s, [0], [0], []
        link, kids = [0], [{}]
        self.kids: list[dict[int, int] | None] = kids
        start, end = self.start, self.end

        def node(first: int, last: int, children: dict[int, int] | None) -> int:
            start.append(first)
            end.append(last)
            link.append(0)
            kids.append(children)
            return len(start) - 1

        at, edge, length, left = 0, 0, 0, 0
        for i, c in enumerate(s):
            unlinked, left = 0, left + 1
            while left:
                if not length:
                    edge = i
                child = kids[at].get(s[edge])
                if child is None:
                    kids[at][s[edge]] = new = node(i, n, None)
                    self.leaves.append(new)
                    if unlinked:
                        link[unlinked], unlinked = at, 0
                else:
                    span = min(end[child], i + 1) - start[child]
                    if length >= span:
                        edge, length, at = edge + span, length - span, child
                        continue
                    if s[start[child] + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = at
                        break
                    middle = start[child] + length
                    new = node(i, n, None)
                    self.leaves.append(new)
                    kids[at][s[edge]] = split = node(start[child], middle, {c: new, s[middle]: child})
                    start[child] = middle
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                left -= 1
                if not at and length:
                    length, edge = length - 1, i - left + 1
                else:
                    at = link[at]

    def tour(self, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(depths along the Euler tour, where each suffix's leaf is in it); children in the order of their first number.

        The end of the sequence comes first in both orders.
        """
        depths, seen, kids = [], [0] * len(self.start), self.kids
        key = (lambda x: (x[0] != END, -x[0])) if reverse else None
        stack = [(0, 0)]
        while stack:
            v, d = stack.pop()
            if v < 0:
                depths.append(d)
                continue
            d += self.end[v] - self.start[v]
            seen[v] = len(depths)
            depths.append(d)
            if kids[v]:
                for _, child in sorted(kids[v].items(), key=key, reverse=False)[::-1]:
                    stack += ((-1, d), (child, d))
        return np.array(depths, np.int32), np.array(seen, np.int64)[self.leaves]


class Lowest:
    """The least number of any stretch of an array in constant time: a sparse table over blocks, runs of minima within."""

    SIZE = 16

    def __init__(self, x: np.ndarray):
        n = -(-len(x) // self.SIZE)
        self.x = np.concatenate([x, np.full(n * self.SIZE - len(x), np.iinfo(np.int32).max, np.int32)])
        rows = self.x.reshape(n, self.SIZE)
        self.ahead = np.minimum.accumulate(rows, axis=1).ravel()
        self.behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of each x[a] ... x[b], a <= b."""
        first, last = a // self.SIZE, b // self.SIZE
        out = np.minimum(self.behind[a], self.ahead[b])
        inside = np.flatnonzero(first == last)
        wide = a[inside, None] + np.arange(self.SIZE)
        out[inside] = np.where(wide <= b[inside, None], self.x[np.minimum(wide, len(self.x) - 1)], np.iinfo(np.int32).max).min(axis=1, initial=np.iinfo(np.int32).max)
        count = last - first - 1
        for level, table in enumerate(self.levels):
            some = np.flatnonzero((count >= 1 << level) & (count < 2 << level))
            out[some] = np.minimum(out[some], np.minimum(table[first[some] + 1], table[last[some] - (1 << level)]))
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the empty one (the last), the next one that is less."""
    ranks, found, stack = rank.tolist(), [0] * len(rank), []
    for j, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            found[stack.pop()] = j
        stack.append(j)
    return np.array(found[:-1], np.int64)


def runs_of(sequence: list[int], least: int = MIN_WORDS) -> np.ndarray:
    """(start, length, period) of the runs of a sequence of numbers that have `least` members or more, by start and period."""
    n = len(sequence)
    tree, mirror = SuffixTree(sequence), SuffixTree(sequence[::-1])
    (depths, leaf), (mirrored, back) = tree.tour(), mirror.tour()
    ahead, behind = Lowest(depths), Lowest(mirrored)
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([next_smaller(np.argsort(np.argsort(leaf))), next_smaller(np.argsort(np.argsort(tree.tour(True)[1])))])
    period = j - i
    end = j + ahead(np.minimum(leaf[i], leaf[j]), np.maximum(leaf[i], leaf[j]))
    x, y = back[n - i], back[n - j]
    start = i - np.where(i > 0, behind(np.minimum(x, y), np.maximum(x, y)), 0)
    length = end - start
    found = np.column_stack([start, length, period])[length >= np.maximum(least, 2 * period)]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def repeating_parts(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of words in which runs can lie; codes: a hash of each word, row: its text.

    Each word there is in a stretch of MIN_WORDS / 2 words that comes twice in the same part.
    """
    size = MIN_WORDS // 2
    n = len(codes)
    none = np.zeros(0, np.int64)
    if n < MIN_WORDS:
        return none, none
    grams = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        grams = mix64(grams + codes[k : n - size + 1 + k])
    part, at, covered = row.astype(np.int64), np.flatnonzero(row[: n - size + 1] == row[size - 1 :]), n
    while len(at):
        key = mix64(grams[at] ^ mix64(part[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][equal]] = again[order[:-1][equal]] = True
        at = np.sort(at[again])
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
        inside = np.cumsum(change[:-1]) > 0
        head = inside & np.concatenate([[True], ~inside[:-1] | (part[1:] != part[:-1])])
        part = np.where(inside, np.cumsum(head), -1)
        if (now := int(inside.sum())) == covered:
            begin = np.flatnonzero(head)
            tail = inside & np.concatenate([~inside[1:] | (part[1:] != part[:-1]), [True]])
            return begin, np.flatnonzero(tail) + 1
        covered = now
    return none, none


_RUNS = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
_RUNS_TYPE = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")]))


def _found(text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The number of words, the runs and the collapsed text of each text."""
    counts: list[int] = []
    every: list[list[dict[str, int]]] = []
    texts: list[bytes] = []
    for _, _, buf, offsets in blocks(text):
        start, end, row = words(buf, offsets, ~SPACES)
        cuts = np.searchsorted(row, np.arange(len(offsets)))
        prefix, data = prefix_hashes(buf), buf.tobytes()
        codes = mix64(span_hashes(prefix, start, end) + (end - start).astype(np.uint64))
        kept, runs = np.ones(len(start), bool), [[] for _ in range(len(offsets) - 1)]
        for a, b in zip(*repeating_parts(codes, row), strict=True):
            numbers: dict[bytes, int] = {}
            sequence = [numbers.setdefault(data[x:y], len(numbers)) for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
            for at, length, period in runs_of(sequence).tolist():
                kept[a + at + period : a + at + length] = False
                runs[row[a]].append({"start": int(a + at - cuts[row[a]]), "length": length, "period": period})
        spans = list(zip(start.tolist(), end.tolist(), kept.tolist(), strict=True))
        texts += [b" ".join([data[x:y] for x, y, stays in spans[i:j] if stays]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        counts += np.diff(cuts).tolist()
        every += runs
    return pa.array(counts, pa.int64()), pa.array(every, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())


def find_runs(docs: DataFrame) -> DataFrame:
    """docs with n_words, runs and collapsed: the periodic runs of the words of a text, and the text without their repeats.

    runs is an array of (start, length, period), by start and period; words are numbered from 0. A word is left out of
    collapsed if a run contains it after its first period; the others are joined by one space. Null, empty and blank texts
    have no word. Rows stand for themselves, so repeated rows, ties and null ids change nothing; columns of these three names are replaced.
    """
    kept = docs.drop("n_words", "runs", "collapsed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, column in zip(("n_words", "runs", "collapsed"), _found(batch.column("text")), strict=True):
                batch = batch.append_column(name, column)
            yield batch

    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", _RUNS_TYPE), T.StructField("collapsed", T.StringType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))
