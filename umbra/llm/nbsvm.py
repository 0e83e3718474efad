"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log-count ratio of the classes, and a linear hinge-loss model is fitted
on them by dual coordinate descent. The sample of labelled rows is bounded; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from umbra.llm.common import fold_of
from umbra.llm.kernels import SPACES, blocks, mix64, word_hashes, words
from umbra.llm.samples import labelled_sample

BITS = 18
#: Bound of the fitting sample: about so many labelled documents of each class.
ROWS_A_CLASS = 3000
EPOCHS = 8
COST = 1.0
#: How far the weights go from their mean magnitude (0) to the fitted ones (1).
BETA = 0.25
THRESHOLD = 0.7
#: Kinds of characters by their first or last byte: lower, upper, digit, other letters; ASCII marks by themselves.
KINDS = np.array([1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c >= 128 else 5 + c % 48 for c in range(256)], np.uint64)


def indicators(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bucket, row): the distinct n-gram buckets of each row, sorted by row.

    N-grams are one and two words, lower-cased; three bytes as they stand; and the shapes (first and last
    character's kind) of two words and of three, the latter with whether all three are the same word.
    """
    low = np.uint64((1 << BITS) - 1)
    for first, end, buf, offsets in blocks(column):
        n = end - first
        hashes, row = word_hashes(buf, offsets)
        pair = np.flatnonzero(row[1:] == row[:-1])
        three = np.arange(max(0, len(buf) - 2))
        at = np.repeat(np.arange(n), np.diff(offsets))
        three = three[at[three] == at[three + 2]]
        code = buf.astype(np.uint64)
        grams = mix64(code[three] | code[three + 1] << np.uint64(8) | code[three + 2] << np.uint64(16) | np.uint64(1 << 32))
        bigrams = mix64(hashes[pair] * np.uint64(3) + hashes[pair + 1])
        start, stop, _ = words(buf, offsets, ~SPACES)
        shape = KINDS[buf[start]] * np.uint64(64) + KINDS[buf[stop - 1]] if len(start) else hashes
        triple = np.flatnonzero(row[2:] == row[:-2])
        same = ((hashes[triple] == hashes[triple + 1]) & (hashes[triple] == hashes[triple + 2])).astype(np.uint64)
        shapes2 = mix64(shape[pair] << np.uint64(16) | shape[pair + 1] | np.uint64(1 << 40))
        shapes3 = mix64(shape[triple] << np.uint64(32) | shape[triple + 1] << np.uint64(16) | shape[triple + 2] | same << np.uint64(60) | np.uint64(1 << 50))
        repeat = mix64(same[same > 0] + np.uint64(1 << 41))
        rows = np.concatenate([row, row[pair], at[three], row[pair], row[triple], row[triple][same > 0]]).astype(np.uint64)
        both = np.unique(rows << np.uint64(BITS) | np.concatenate([hashes, bigrams, grams, shapes2, shapes3, repeat]) & low)
        yield first, n, (both & low).astype(np.int32), (both >> np.uint64(BITS)).astype(np.int64)


def dual_coordinate_descent(features: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) of min |w|^2 / 2 + sum cost * max(0, 1 - y w.x), one dual variable at a time."""
    w = np.zeros(len(ratio) + 1)
    alpha = np.zeros(len(y))
    norm = np.array([(ratio[f] ** 2).sum() + 1 for f in features])
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f = features[i]
            gradient = y[i] * (w[f] @ ratio[f] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[f] += step * ratio[f]
                w[-1] += step
                alpha[i] = new
    return w


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a z + b))), by Newton's method with Platt's soft targets."""
    up, down = max(weight[y > 0].sum(), 1e-9), max(weight[y <= 0].sum(), 1e-9)
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    middle, spread = float(z.mean()), float(z.std()) or 1.0
    x, a, b = (z - middle) / spread, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-6
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * x).sum(), g.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    a = max(float(a), 1e-3)
    return a / spread, float(b) - a * middle / spread


def fit_rows(features: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The 2**BITS scaled weights, then bias, a and b. Every fifth row is kept for the calibration."""
    size = 1 << BITS
    if len(set(y.tolist())) < 2:
        return np.concatenate([np.zeros(size), [0.0, 1.0, 4.0 if len(y) and y[0] > 0 else -4.0]])
    train = np.arange(len(y)) % 5 != 4
    if len(set(y[train].tolist())) < 2:
        train[:] = True
    count = np.ones((2, size))
    for f, k in zip((features[i] for i in np.flatnonzero(train)), y[train], strict=True):
        count[int(k > 0), f] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    sign = np.where(y > 0, 1.0, -1.0)
    w = dual_coordinate_descent([features[i] for i in np.flatnonzero(train)], ratio, sign[train], np.full(int(train.sum()), COST))
    mean = np.abs(w[:-1]).mean()
    scaled = ((1 - BETA) * mean + BETA * w[:-1]) * ratio
    check = ~train if len(set(y[~train].tolist())) == 2 else np.ones(len(y), bool)
    # long texts have more n-grams: their sum is brought to a length of one
    z = np.array([scaled[features[i]].sum() / np.sqrt(len(features[i]) + 1) + BETA * w[-1] for i in np.flatnonzero(check)])
    return np.concatenate([scaled, [BETA * w[-1], *platt(z, sign[check], weight[check])]])


@dataclass
class Model:
    weights: np.ndarray  # float32, by bucket
    bias: float
    a: float
    b: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for first, n, bucket, row in indicators(column):
            z = np.bincount(row, self.weights[bucket], n) / np.sqrt(np.bincount(row, minlength=n) + 1) + self.bias
            out[first : first + n] = 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))
        return out


def fit(sample: DataFrame) -> Model:
    """A model of sample (doc_id, text, y, weight), fitted in one task: the sample's size is bounded."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, bucket, row in indicators(batch.column(1)):
                cuts = np.searchsorted(row, np.arange(n + 1))
                packed = pa.array([bucket[cuts[i] : cuts[i + 1]].tobytes() for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n) for c in (0, 2, 3)), packed], names=["doc_id", "y", "weight", "f"])

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        w = fit_rows([np.frombuffer(f, np.int32) for f in rows["f"]], rows["y"].to_numpy(), rows["weight"].to_numpy())
        return pd.DataFrame({"w": [w.tobytes()]})

    made = sample.select("doc_id", "text", "y", "weight").mapInArrow(features, "doc_id long, y int, weight double, f binary").withColumn("all", F.lit(0))
    row = made.groupBy("all").applyInPandas(fitted, "w binary").first()
    w = np.frombuffer(row["w"]) if row else fit_rows([], np.zeros(0), np.zeros(0))
    return Model(w[: 1 << BITS].astype(np.float32), *w[1 << BITS :])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted; null texts count as empty ones."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(held.value.score(text), pa.float64())

    return docs.drop("score", "predicted").withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fit_and_predict(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted): fitted on labels outside one fold, for all documents.

    Each row has a score of its own, also one that repeats an id or has a null one (never held out, never learnt from).
    Null texts count as empty ones, which have the score of a text without n-grams; texts of any length are read whole.
    Without labels of both classes every text has one score; an empty table gives no row. No column of docs but
    doc_id passes through, so none can clash.
    """
    held_out = F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False))
    model = fit(labelled_sample(docs, labels, "quality", ~held_out, ROWS_A_CLASS))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
