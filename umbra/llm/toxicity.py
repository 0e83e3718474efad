"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

A word's embedding is the sum of two rows of a hashed table, so two words share one only if both rows
collide. Filters of several widths slide over the words, each keeps its maximum over the whole text, and a
linear layer scores the maxima. Weights, word counts and thresholds come from every labelled row: parts of the rows
are descended over side by side, and their nets are averaged after each pass. The threshold is calibrated for each predicted language and moved to 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from umbra.llm import language_id
from umbra.llm.common import cut, fold_of
from umbra.llm.kernels import ALNUM, blocks, word_hashes
from umbra.llm.samples import labelled

BITS = 17
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 10
BATCH = 32
RATE = 0.05
#: Rows are dealt over so many parts at most, of about so many rows at least; a part's rows are mixed so many at a time.
MOST_PARTS = 32
ROWS_A_PART = 4000
SHUFFLED = 4096
#: Words that go through the filters together, and bytes of the texts they are read from: what a core's cache holds.
BLOCK_WORDS, BLOCK_BYTES = 8192, 1 << 17
#: Logits are counted in steps of 1 / STEPS where thresholds are sought.
STEPS = 1000
#: A language with fewer toxic rows to calibrate on takes the threshold of all.
LEAST_TO_CALIBRATE = 5
WORDS = ALNUM.copy()
THRESHOLD = 0.5


def word_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, ids, row): two table rows for each word, and the word's row."""
    low = np.uint64((1 << BITS) - 1)
    for first, end, buf, offsets in blocks(column, BLOCK_BYTES):
        h, row = word_hashes(buf, offsets, WORDS)
        yield first, end - first, np.stack([h & low, (h >> np.uint64(32)) & low], 1).astype(np.int32), row


@dataclass
class Net:
    table: np.ndarray  # 2**BITS x SIZE
    filters: list[np.ndarray]  # by width: width x SIZE x FILTERS
    bias: np.ndarray  # WIDTHS x FILTERS
    out: np.ndarray  # the linear layer over the maxima; the last one is its bias
    thresholds: dict[str, float]  # logits by language; "" is for all others

    @classmethod
    def started(cls, log_odds: np.ndarray) -> Net:
        """Small random weights; the first dimension of a word begins at the log odds of its classes."""
        rng = np.random.default_rng(7)
        table = rng.normal(0, 0.01, (1 << BITS, SIZE)).astype(np.float32)
        table[:, 0] = log_odds / 2
        filters = [rng.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0] += 0.5 / len(f)
        return cls(table, filters, np.zeros((len(WIDTHS), FILTERS), np.float32), np.append(np.full(len(WIDTHS) * FILTERS, 0.1), -1.0), {"": 0.0})

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        """words x SIZE."""
        x = self.table.take(ids[:, 0], axis=0)
        x += self.table.take(ids[:, 1], axis=0)
        return x

    def applied(self, x: np.ndarray, k: int) -> np.ndarray:
        """FILTERS x places: what the filters of the k-th width say at each place of words that follow one another; x: words x SIZE."""
        w, n = WIDTHS[k], len(x) - WIDTHS[k] + 1
        every = (self.filters[k].transpose(0, 2, 1).reshape(-1, SIZE) @ x.T).reshape(w, FILTERS, len(x))
        y = every[0, :, :n] + self.bias[k][:, None]
        for j in range(1, w):
            y += every[j, :, j : j + n]
        return y

    def maxima(self, ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The largest value of each filter in each of n rows, not below 0."""
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        x = self.embedded(ids)
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
        for k, w in enumerate(WIDTHS):
            if len(x) < w:
                continue
            y = self.applied(x, k)
            y[:, row[: y.shape[1]] != row[w - 1 :]] = 0
            first = start[: np.searchsorted(start, y.shape[1])]
            out[row[first], k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(y, first, axis=1), 0).T
        return out

    def logits(self, maxima: np.ndarray) -> np.ndarray:
        return maxima @ self.out[:-1] + self.out[-1]


def tops(net: Net, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """docs x WIDTHS x FILTERS: the largest value of each filter in each of docs, not below 0, and the word at which it begins."""
    top, where = np.zeros((len(docs), len(WIDTHS), FILTERS), np.float32), np.zeros((len(docs), len(WIDTHS), FILTERS), np.int64)
    ends = np.cumsum([len(ids) for ids in docs])
    first = 0
    while first < len(docs):
        # docs of about BLOCK_WORDS words together go through the filters at once; a longer one goes alone
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + BLOCK_WORDS, "right")))
        ids = np.concatenate(docs[first:end])
        x = net.embedded(ids)
        for k, w in enumerate(WIDTHS):
            if len(x) < w:
                continue
            y = net.applied(x, k)
            for i in range(first, end):
                a, b = ends[i] - len(docs[i]) - before, ends[i] - before - w + 1
                if a < b:
                    where[i, k] = y[:, a:b].argmax(1)
                    top[i, k] = y[np.arange(FILTERS), a + where[i, k]]
        first = end
    return np.maximum(top, 0), where


def descend(net: Net, seen: Net, docs: list[np.ndarray], y: np.ndarray, order: np.ndarray) -> None:
    """One pass of stochastic gradient descent over docs with Adagrad steps on the logistic loss; gradients flow through the maxima alone. seen has the sums of squares."""
    for begin in range(0, len(order), BATCH):
        part = order[begin : begin + BATCH]
        held = [docs[i] for i in part]
        top, where = tops(net, held)
        flat_top = top.reshape(len(part), -1)
        z = flat_top @ net.out[:-1] + net.out[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
        g_out = np.append(error @ flat_top, error.sum())
        g_top = (error[:, None] * net.out[:-1]).reshape(top.shape) * (top > 0)
        g_bias = g_top.sum(0).astype(np.float32)
        g_filters = [np.zeros_like(f) for f in net.filters]
        every, starts = np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]
        words, g_words = [], []
        for k, w in enumerate(WIDTHS):
            # what is no maximum above 0 has no gradient
            doc, f = np.nonzero(g_top[:, k])
            g, at = g_top[doc, k, f][:, None].astype(np.float32), starts[doc] + where[doc, k, f]
            of_filter = (f == np.arange(FILTERS)[:, None]) * g.T
            for j in range(w):
                ids = every.take(at + j, axis=0)
                g_filters[k][j] += (of_filter @ net.embedded(ids)).T
                words.append(ids)
                g_words.append(net.filters[k][j].T[f] * g)
        for value, grad, sums in ((net.out, g_out, seen.out), (net.bias, g_bias, seen.bias), *zip(net.filters, g_filters, seen.filters, strict=True)):
            sums += grad * grad
            value -= RATE * (grad + 1e-5 * value) / np.sqrt(sums)
        ids, grad = np.concatenate(words).T.ravel(), np.tile(np.concatenate(g_words), (2, 1))
        if len(ids):
            by_id = ids.argsort(kind="stable")
            ids = ids[by_id]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            rows, total = ids[first], np.add.reduceat(grad[by_id], first, axis=0).astype(np.float32)
            seen.table[rows] += total * total
            net.table[rows] -= RATE * total / np.sqrt(seen.table[rows])


def log_odds(count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each row of the table, from the texts of either class that have it and all texts of the classes."""
    count, totals = count + 0.5, np.maximum(1, sizes) + 1.0
    odds = np.log(count[1] / totals[1]) - np.log(count[0] / totals[0])
    odds[count.sum(0) < 3] = 0  # a word seen once tells nothing
    return np.clip(odds, -3, 3)


def started(odds: np.ndarray) -> tuple[Net, Net]:
    """A net before its first step, and its sums of squares."""
    net = Net.started(odds)
    return net, Net(np.full_like(net.table, 1e-2), [np.full_like(f, 1e-2) for f in net.filters], np.full_like(net.bias, 1e-2), np.full_like(net.out, 1e-2), {})


def train(docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> Net:
    """A net fitted to docs in one place."""
    count = np.zeros((2, 1 << BITS))
    for ids, k in zip(docs, y, strict=True):
        count[int(k), np.unique(ids)] += 1
    net, seen = started(log_odds(count, np.array([(y == k).sum() for k in (0, 1)])))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        descend(net, seen, docs, y, rng.permutation(len(docs)))
    return net


def flat(net: Net) -> np.ndarray:
    """All numbers of a net in rows of SIZE: those of the table, then the others."""
    rest = np.concatenate([x.ravel() for x in (*net.filters, net.bias, net.out)]).astype(np.float32)
    return np.concatenate([net.table, np.pad(rest, (0, -len(rest) % SIZE)).reshape(-1, SIZE)])


def from_flat(rows: np.ndarray) -> Net:
    shapes = [*((w, SIZE, FILTERS) for w in WIDTHS), (len(WIDTHS), FILTERS), (len(WIDTHS) * FILTERS + 1,)]
    cuts = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    rest = rows[1 << BITS :].ravel()
    parts = [rest[a:b].reshape(s).copy() for a, b, s in zip(cuts[:-1], cuts[1:], shapes, strict=True)]
    return Net(rows[: 1 << BITS].copy(), parts[: len(WIDTHS)], parts[-2], parts[-1], {"": 0.0})


def unpacked(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.frombuffer(x, np.int32).reshape(-1, 2) for x in batch.column("ids").to_pylist()], batch.column("y").to_numpy(zero_copy_only=False)


def featured(texts: DataFrame, *others: str) -> DataFrame:
    """(y, ids, *others) of texts (text, y, *others), written down: every pass reads them."""
    names = ["y", *others]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, ids, row in word_rows(batch.column(0)):
                cuts = np.searchsorted(row, np.arange(n + 1))
                packed = pa.array([ids[cuts[i] : cuts[i + 1]].tobytes() for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n) for c in range(1, len(names) + 1)), packed], names=[*names, "ids"])

    return cut(texts.select("text", *names).mapInArrow(features, "".join(f"{c} string, " if c != "y" else "y int, " for c in names) + "ids binary"))


def trained(rows: DataFrame, sizes: np.ndarray) -> Net:
    """A net fitted to all rows (y, ids); sizes counts them by class.

    Rows are dealt over up to MOST_PARTS parts. In each pass a part descends over its rows as they come, from the net of the
    pass before; then each number is the mean of those parts that changed it. A task holds SHUFFLED rows and the net.
    """
    spark = rows.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for ids, k in zip(*unpacked(batch), strict=True):
                count[k, np.unique(ids)] += 1
        k, b = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(count[k, b])], names=["k", "b", "n"])

    found = rows.mapInArrow(counted, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros((2, 1 << BITS))
    count[found["k"], found["b"]] = found["n"]
    values, sums = map(flat, started(log_odds(count, sizes)))
    dealt = rows.coalesce(min(MOST_PARTS, max(1, int(sizes.sum()) // ROWS_A_PART)))
    names = [f"v{i}" for i in range(2 * SIZE)]
    for epoch in range(EPOCHS):
        held = spark.sparkContext.broadcast((values, sums))

        def pass_over(batches: Iterator[pa.RecordBatch], held=held, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            net, seen = map(from_flat, held.value)
            rng = np.random.default_rng(epoch + 3)
            docs, y = [], []
            for batch in batches:
                ids, k = unpacked(batch)
                for begin in range(0, len(ids), SHUFFLED):
                    docs += ids[begin : begin + SHUFFLED]
                    y += k[begin : begin + SHUFFLED].tolist()
                    if len(docs) >= SHUFFLED:
                        descend(net, seen, docs, np.array(y), rng.permutation(len(docs)))
                        docs, y = [], []
            if docs:
                descend(net, seen, docs, np.array(y), rng.permutation(len(docs)))
            new, new_sums = flat(net), flat(seen)
            at = np.flatnonzero((new_sums != held.value[1]).any(1) | (new != held.value[0]).any(1))
            both = np.concatenate([new[at], new_sums[at]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(both[:, i]) for i in range(2 * SIZE))], names=["r", *names])

        means = dealt.mapInArrow(pass_over, "r int, " + ", ".join(f"{v} float" for v in names)).groupBy("r").agg(*[F.avg(v).cast("float").alias(v) for v in names]).toPandas()
        at, both = means["r"].to_numpy(), means[names].to_numpy(np.float32)
        values, sums = values.copy(), sums.copy()
        values[at], sums[at] = both[:, :SIZE], both[:, SIZE:]
        held.unpersist()
    return from_flat(values)


def best_threshold(z: np.ndarray, hits: np.ndarray, n: np.ndarray) -> float:
    """The logit with the best F1, half-way to the next lower one; z: different logits, with their toxic rows and all their rows."""
    order = np.argsort(-z)
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(n[order]) + hits.sum())
    k = int(f1.argmax())
    below = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + below) / 2)


def thresholds(rows: DataFrame, net: Net) -> dict[str, float]:
    """Logits by language, over all rows (y, ids, lang_pred), which are counted by language and logit in steps of 1 / STEPS."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf(T.IntegerType())
    def step(packed: pa.Array) -> pa.Array:
        docs = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in packed.to_pylist()]
        net = held.value
        z = [net.logits(net.maxima(ids, np.zeros(len(ids), np.int64), 1))[0] for ids in docs]
        return pa.array(np.round(np.clip(np.array(z, float), -30, 30) * STEPS).astype(np.int32))

    counts = rows.withColumn("z", step("ids")).groupBy("lang_pred", "z").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n")).toPandas()
    best = lambda c: best_threshold(c["z"].to_numpy() / STEPS, c["hits"].to_numpy(), c["n"].to_numpy())
    out = {"": best(counts.groupby("z", as_index=False)[["hits", "n"]].sum())}
    for name, own in counts.groupby("lang_pred"):
        if own["hits"].sum() >= LEAST_TO_CALIBRATE and (own["n"] - own["hits"]).sum() >= LEAST_TO_CALIBRATE:
            # drawn half-way to the threshold of all rows, which more rows support
            out[name] = (best(own) + out[""]) / 2
    return out


def fit(rows: DataFrame, named: Callable[[DataFrame], DataFrame]) -> Net:
    """A net fitted to all rows (doc_id, text, y): trained on four of five, its thresholds calibrated on the fifth; named adds lang_pred."""
    fifth = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(5)) == 4
    sizes = {(r["fifth"], r["y"]): r["n"] for r in rows.groupBy(fifth.alias("fifth"), "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda held: np.array([sizes.get((held, y), 0) for y in (0, 1)])
    if not (of(True) + of(False)).all():
        net = Net.started(np.zeros(1 << BITS))
        net.out[:-1], net.out[-1] = 0, 4.0 if of(True)[1] + of(False)[1] else -4.0
        return net
    split = of(True).all() and of(False).all()
    net = trained(featured(rows.where(~fifth) if split else rows), of(False) if split else of(True) + of(False))
    net.thresholds = thresholds(featured(named(rows.where(fifth) if split else rows), "lang_pred"), net)
    return net


def predict(docs: DataFrame, net: Net) -> DataFrame:
    """docs (with lang_pred) with score and predicted; null texts count as empty ones."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array, lang: pa.Array) -> pa.Array:
        net = held.value
        z = np.empty(len(text))
        for first, n, ids, row in word_rows(text):
            z[first : first + n] = net.logits(net.maxima(ids, row, n))
        z -= np.array([net.thresholds.get(x, net.thresholds[""]) for x in lang.to_pylist()])
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    return docs.drop("score", "predicted").withColumn("score", score("text", "lang_pred")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fit_and_predict(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted): fitted outside one fold, for all documents.

    The language that picks the threshold is named from the text alone, by a model of the texts outside the fold.
    Each row has a score of its own, also one that repeats an id or has a null one (never held out, never learnt from).
    Null texts count as empty ones, which have the score of a text without words; texts of any length are read whole.
    Without labels of both classes every text has one score; an empty table gives no row. No column of docs but
    doc_id passes through, so none can clash.
    """
    held_out = F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False))
    named = language_id.fit(docs.where(~held_out & F.col("doc_id").isNotNull()), language_id.EVERY)
    lang = lambda df: language_id.predict(df, named).drop("score")
    net = fit(labelled(docs, labels, "toxic", ~held_out), lang)
    return predict(lang(docs.select("doc_id", "text")), net).select("doc_id", held_out.alias("held_out"), "score", "predicted")
