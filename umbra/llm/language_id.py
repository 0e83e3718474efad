"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams on Spark; the matrix of log probabilities (buckets x languages) is broadcast, and
texts are scored in batches: a batch is a sparse matrix of n-gram buckets, in coordinate form, multiplied
by the matrix and summed by row. Where there are more languages than one matrix should have columns, they are
dealt over several by hash; texts are scored by one after the other, and the best of all is named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from umbra.llm.common import cut, fold_of, parts_for

SIZES = (1, 2, 3)
BITS = 16
#: Bound of the fitting sample: about so many texts of each language, chosen by the hash of the id.
TEXTS_A_LANGUAGE = 3000
#: About so many languages (a quarter of a megabyte each) are the columns of one broadcast matrix.
LANGUAGES_A_MATRIX = 400
#: N-grams of up to so many languages are counted in one go, which is faster, but touches all their buckets.
LANGUAGES_A_COUNT = 16
#: In place of a bound: every text is counted.
EVERY = 1 << 62
BLOCK = 1 << 19


def blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of about BLOCK characters of lower-cased texts, and the first one's row."""
    held, size, first = [], 0, 0
    for i, text in enumerate(column.to_pylist()):
        held.append((text or "").lower())
        size += len(held[-1])
        if size >= BLOCK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each n-gram of the texts. What is no letter is a space; n-grams of spaces don't count."""
    lengths = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    code[(code < 97) | (code > 122) & (code < 170)] = 32
    ends = np.repeat(np.cumsum(lengths), lengths)
    row = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(code))
    out, rows = [], []
    h = np.zeros(len(code), np.uint32)
    letters = np.zeros(len(code), bool)
    for n in range(1, max(SIZES) + 1):
        at = np.minimum(place + n - 1, max(len(code) - 1, 0))
        h = (h ^ code[at]) * np.uint32(0x01000193) + np.uint32(n)
        letters |= code[at] != 32
        if n in SIZES:
            ok = letters & (place + n <= ends)
            mixed = (h[ok] ^ (h[ok] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
            rows.append(row[ok])
    return np.concatenate(out), np.concatenate(rows)


@dataclass
class Model:
    languages: list[str]
    log_probs: np.ndarray  # float32, buckets x languages
    priors: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """Log probabilities, up to a constant by row, of each text and language."""
        bucket, row = buckets(texts)
        total = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(row, self.log_probs[bucket, k], len(texts)) + self.priors[k]
        return total


def fit(docs: DataFrame, texts_a_language: int = TEXTS_A_LANGUAGE) -> list[Model]:
    """Models of docs (doc_id, text, lang) with a non-null text and lang: one, or several that share the languages by hash."""
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    n = parts_for(known.select("lang").distinct().count(), LANGUAGES_A_MATRIX, 1)
    return [fit_matrix(known if n == 1 else known.where(F.pmod(F.xxhash64("lang"), F.lit(n)) == i), texts_a_language) for i in range(n)]


def fit_matrix(known: DataFrame, texts_a_language: int) -> Model:
    """One model of the languages of known (doc_id, text, lang).

    The sample of each language is bounded by a hash threshold set from its exact count, so a language with
    most of the rows weighs no more than another.
    """
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    part = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, texts_a_language / n))])
    sample = known.where(F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30)) < F.element_at(part, F.col("lang")) * (1 << 30))
    place = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 1 << BITS), np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(1).to_pylist()])
            for first, texts in blocks(batch.column(0)):
                bucket, row = buckets(texts)
                at = lang[first + row].astype(np.int64) << BITS | bucket
                if len(names) <= LANGUAGES_A_COUNT:
                    total += np.bincount(at, minlength=total.size).reshape(total.shape)
                else:
                    np.add.at(total.reshape(-1), at, 1)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(total[k, b])], names=["k", "b", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((1 << BITS, len(names)), 0.5)  # smoothing
    table[counts["b"], counts["k"]] += counts["n"]
    return Model(names, np.log(table / table.sum(0)).astype(np.float32), np.zeros(len(names)))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __lang: the best language of a model, its log probability, and the logarithm of all languages' sum."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = (("lang", T.StringType(), pa.string()), ("top", T.DoubleType(), pa.float64()), ("every", T.DoubleType(), pa.float64()))

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t, _ in fields]))
    def named(text: pa.Array) -> pa.Array:
        model, langs, tops, sums = held.value, [], [], []
        for _, texts in blocks(text):
            letters = [any(map(str.isalpha, t)) and bool(model.languages) for t in texts]
            if model.languages:
                total = model.score(texts)
                best, top = total.argmax(1), total.max(1)
                every = top + np.log(np.exp(total - top[:, None]).sum(1))
            langs += [model.languages[best[i]] if ok else None for i, ok in enumerate(letters)]
            tops += [float(top[i]) if ok else None for i, ok in enumerate(letters)]
            sums += [float(every[i]) if ok else None for i, ok in enumerate(letters)]
        return pa.StructArray.from_arrays([pa.array(x, t) for x, (_, _, t) in zip((langs, tops, sums), fields, strict=True)], [n for n, _, _ in fields])

    return docs.withColumn("__lang", named("text"))


def predict(docs: DataFrame, models: list[Model]) -> DataFrame:
    """docs with lang_pred and score, the posterior probability of the language that is named.

    A null text, one without a letter, and any text under models without languages are `und` with score 0. Between
    several models the texts are written down, so that an executor holds one matrix at a time.
    """
    out = docs.drop("lang_pred", "score")
    for i, model in enumerate(models):
        if not i:
            out = _scored(out, model).withColumnRenamed("__lang", "__best")
            continue
        out = _scored(cut(out), model)
        one, two = F.col("__best"), F.col("__lang")
        better = (two.top > one.top) | (two.top == one.top) & (two.lang < one.lang)
        every = F.greatest(one.every, two.every) + F.log1p(F.exp(-F.abs(one.every - two.every)))
        both = F.struct(F.when(better, two.lang).otherwise(one.lang).alias("lang"), F.greatest(one.top, two.top).alias("top"), every.alias("every"))
        out = out.withColumn("__best", F.when(two.lang.isNull(), one).when(one.lang.isNull(), two).otherwise(both)).drop("__lang")
    best = F.col("__best")
    share = F.coalesce(F.exp(best.top - best.every), F.lit(0.0))
    return out.select("*", F.coalesce(best.lang, F.lit("und")).alias("lang_pred"), share.alias("score")).drop("__best")


def fit_and_predict(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on the documents outside one fold, for all of them.

    Each row has a result of its own, also one that repeats an id or has a null one (never held out, never learnt
    from). Null and empty texts are `und`; texts of any length are read whole; equal languages' ties go to the first
    by name. An empty table gives no row. No column of docs but doc_id passes through, so none can clash.
    """
    held_out = F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False))
    model = fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
