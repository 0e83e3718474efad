"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

Test items are short and documents long, so a document's MinHash says little about an item in it. The
sketches are therefore of the items. Items are partitioned by the power of two of their size, and each
partition has a sketch length of its own: the k smallest hashes of an item's shingles, k = floor((1 - t) u)
+ 1 for the partition's largest size u. A document that contains a share t of an item lacks at most
floor((1 - t) u) of its shingles, so it has at least one of the k: no contained item is missed. Documents
are probed with every shingle they have; what shares a sketch value is verified by exact containment of
the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from umbra.llm.common import WORD, cut, met

N_WORDS = 5
THRESHOLD_PERCENT = 80
#: Up to so many rows (under 200 bytes each) the items' side, or the ids of suspects, are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: In such a shuffle a shingle that very many documents have is dealt over so many tasks, to each of which the items' few rows of it go.
SALTS = 16


def _shingled(df: DataFrame, id_col: str) -> DataFrame:
    """(id, w0..w4): each window of five words; fewer words are one window, padded with nulls."""
    words = F.col("words")
    base = df.select(F.col(id_col), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("words")).where(F.size("words") > 0)
    n = F.size(words)
    parts = [words if i == 0 else F.slice(words, i + 1, n) for i in range(N_WORDS)]
    zipped = F.arrays_zip(*parts).cast("array<struct<" + ",".join(f"w{i}:string" for i in range(N_WORDS)) + ">>")
    whole = F.slice(zipped, F.lit(1), F.greatest(n - (N_WORDS - 1), F.lit(1)))
    return base.select(id_col, F.inline(whole))


def _hash() -> Column:
    return F.xxhash64(*[f"w{i}" for i in range(N_WORDS)])


def _text() -> Column:
    return F.concat_ws(" ", *[f"w{i}" for i in range(N_WORDS)])


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _met(many: DataFrame, items: DataFrame, key: str) -> DataFrame:
    return met(many, items, key, "doc_id", BROADCAST_ROWS, SALTS)


def item_sketches(items: DataFrame) -> DataFrame:
    """(hash, item_id): the sketch values of each item, as many as its size partition asks for."""
    sets = _shingled(items, "item_id").groupBy("item_id").agg(F.sort_array(F.collect_set(_hash())).alias("h"))
    largest = F.pow(F.lit(2), F.floor(F.log2(F.size("h"))) + 1) - 1
    length = (F.floor(largest * (100 - THRESHOLD_PERCENT) / 100) + 1).cast("int")
    return sets.select(F.explode(F.slice("h", F.lit(1), length)).alias("hash"), "item_id")


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of which a document has at least 80 % of the shingles.

    Letters of all alphabets are lower-cased, for items stand in documents in either case. A shingle is five words, or all of a shorter text: an item of fewer than five words is
    found only where it is the whole text. Null and empty texts hold nothing, and empty tables give no row. Rows
    that repeat an id are one document or item; rows with a null id are left out. Other columns play no part.
    """
    docs, items = docs.where("doc_id is not null").select("doc_id", "text"), items.where("item_id is not null").select("item_id", "text")
    probes = _shingled(docs, "doc_id").select("doc_id", _hash().alias("hash"))
    # all documents are shingled for this once; what follows reads the few rows that it wrote
    candidates = cut(_met(probes, item_sketches(items), "hash").select("doc_id", "item_id").distinct())
    shingles = _shingled(items, "item_id").select("item_id", _text().alias("shingle")).distinct()
    sizes = shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    ids = candidates.select("doc_id").distinct()
    suspects = docs.join(F.broadcast(ids) if _small(ids) else ids, "doc_id", "left_semi")
    held = _shingled(suspects, "doc_id").select("doc_id", _text().alias("shingle"))
    shared = _met(held, shingles, "shingle").groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"))
    sized = shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(F.broadcast(sizes) if _small(sizes) else sizes, "item_id")
    return sized.where(f"100 * n_shared >= {THRESHOLD_PERCENT} * n_item").select("doc_id", "item_id", "n_shared", "n_item")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item; those with a null id stay."""
    found = cut(contained_items(docs, items).select("doc_id").distinct())
    return docs.join(F.broadcast(found) if _small(found) else found, "doc_id", "left_anti").select(*docs.columns)
