"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

Each word with the four before it is a shingle (at the beginning of a text, with those that there are). A
fingerprint keeps every shingle hash below a fixed fraction of the hash space, so that the fingerprint of a long
text has more hashes than that of a short one, and what two texts share can be estimated from the hashes below the
threshold, however unequal they are. A text with few of those keeps its LEAST smallest hashes, so that no text with
a word goes without a fingerprint. Fingerprints can be merged: that of several texts together comes from theirs.

A fingerprint is a sorted array of hashes of 64 bits, as hexadecimal digits, so that SQL of any engine can say it. It
knows all of its text's hashes up to a bound: the threshold, or its greatest hash if that is beyond. Two fingerprints are
compared up to the smaller of their bounds.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from umbra.llm.common import SPACE, ascii_lower, parts_for, shuffle_partitions

N_WORDS = 5
#: Hashes below this are kept, one in 16, and so many of the smallest at least.
BOUND, LEAST = "1", 32
#: Neighbours by id are found by ranges of ids, each of about so many bytes of text; their bounds are a literal in the plan.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 16


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null, empty and blank texts have an empty one. A-Z counts as lower case."""
    cleaned = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), f"^[{SPACE}]+|[{SPACE}]+$", "")

    def of_words(words: Column) -> Column:
        shingle = lambda _, i: F.substring(F.md5(F.concat_ws(" ", *[F.get(words, i - k) for k in range(N_WORDS - 1, -1, -1)])), 1, 16)
        hashes = F.transform(words, shingle)

        def kept(hashes: Column) -> Column:
            below = F.filter(hashes, lambda h: h < BOUND)
            few = lambda found: F.when(F.size(found) >= LEAST, found).otherwise(F.slice(F.array_sort(F.array_distinct(hashes)), 1, LEAST))
            return _let(F.array_sort(F.array_distinct(below)), few)

        return _let(hashes, kept)

    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(_let(F.split(cleaned, f"[{SPACE}]+", -1), of_words))


def _bound(a: Column, b: Column) -> Column:
    """Up to which hash both fingerprints know all of their texts' hashes."""
    last = lambda x: F.greatest(F.lit(BOUND), F.get(x, F.size(x) - 1))
    return F.least(last(a), last(b))


def _up_to(x: Column, bound: Column) -> Column:
    return F.filter(x, lambda h: h <= bound)


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of two texts' shingles that both have (0 to 1); of two empty ones 1, of an empty one and another 0."""

    def of(shared: Column, x: Column, y: Column) -> Column:
        return F.size(shared) / (F.size(x) + F.size(y) - F.size(shared))

    def compared(bound: Column) -> Column:
        both = F.struct(_up_to(a, bound).alias("a"), _up_to(b, bound).alias("b"))
        return _let(both, lambda s: of(F.array_intersect(s.a, s.b), s.a, s.b))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(_let(_bound(a, b), compared))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of the shingles of a's text that b's has (0 to 1).

    An empty text is in every other. Null where a's text is so short beside b's that no hash of it can be looked up in b.
    """

    def compared(bound: Column) -> Column:
        return _let(_up_to(a, bound), lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, b)) / F.size(x)))

    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(b) == 0, F.lit(0.0)).otherwise(_let(_bound(a, b), compared))


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts side by side (as sets of shingles), from theirs."""

    def kept(every: Column) -> Column:
        below = F.size(F.filter(every, lambda h: h < BOUND))
        return F.slice(every, F.lit(1), F.greatest(below, F.lit(LEAST)))

    return _let(F.array_sort(F.array_union(a, b)), kept)


def as_text(a: Column) -> Column:
    """A fingerprint as one string, 16 digits for each hash."""
    return F.array_join(a, "")


def range_bounds(docs: DataFrame) -> list[int]:
    """The greatest ids of ranges of ids with about equally many documents, in order; MOST_RANGES at most."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_RANGES, parts_for(size, RANGE_BYTES, shuffle_partitions(docs.sparkSession)))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"))
    most = ids.repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("m"))
    return sorted(r.m for r in most.collect())


def _range_of(key: Column, bounds: list[int]) -> Column:
    """In which range an id is, by binary search among the ranges' greatest ids."""
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    known = F.lit(np.array(bounds, np.int64))
    step = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(known, at + s - 1) < key), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with `next`, a struct of the columns of the next document by descending id; that of the last one is the first.

    Ids are dealt by ranges, and each range also gets the first row of the next one as a guest, so no window spans
    more than a range. Rows that repeat an id follow each other by the hash of their text; rows without one have no next (null).
    """
    bounds = range_bounds(docs)
    key, n = F.col("doc_id").cast("long"), max(1, len(bounds))
    at = _range_of(key, bounds) if bounds else F.lit(0)
    most = F.get(F.lit(np.array(bounds, np.int64)), at) if bounds else F.lit(None).cast("long")
    guests = F.when(key == most, F.array(F.pmod(at + 1, F.lit(n)))).otherwise(F.array().cast("array<int>"))
    homes = F.concat(F.array(F.struct(F.when(key.isNull(), -1 - F.pmod(F.hash("text"), F.lit(n))).otherwise(at).alias("range"), F.lit(0).alias("guest"))), F.transform(guests, lambda r: F.struct(r.alias("range"), F.lit(1).alias("guest"))))
    dealt = docs.withColumn("__home", F.explode(homes))
    order = Window.partitionBy("__home.range").orderBy("__home.guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    following = F.struct(*[F.lead(c).over(order).alias(c) for c in columns])
    return dealt.withColumn("next", F.when(F.col("doc_id").isNotNull(), following)).where("__home.guest = 0").drop("__home")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with n_chars and fingerprint (an array); a null text is empty. Columns of these names are replaced."""
    return docs.withColumns({"n_chars": F.length(F.coalesce("text", F.lit(""))).cast("long"), "fingerprint": fingerprint(F.col("text"))})


def edited(docs: DataFrame) -> DataFrame:
    """docs with n_chars, fingerprint, next, edited_text and edited_fingerprint.

    The last third of the code points of a text makes way for as many first ones of the next document (or all of it, if
    that has fewer); a document without an id only loses them. next has the text and fingerprint of the next document.
    """
    full = with_next(fingerprints(docs), ["text", "fingerprint"])
    text, cut_off = F.coalesce("text", F.lit("")), F.floor(F.col("n_chars") / 3).cast("int")
    put = F.concat(F.substring(text, F.lit(1), F.col("n_chars").cast("int") - cut_off), F.substring(F.coalesce("next.text", F.lit("")), F.lit(1), cut_off))
    return full.withColumn("edited_text", put).withColumn("edited_fingerprint", fingerprint(F.col("edited_text")))
