"""Line dedup with sharded cuckoo filters over exact reference-count tables.

The index is three tables, all hashed by the line key into shards, of which it gets more as it grows:

- ``postings`` (shard, key, doc_id, lines): which lines of which document hold a key;
- ``counts`` (shard, key, n_refs, first_doc, last_doc): the exact reference counts;
- ``filters`` (shard, filter): one cuckoo filter for each shard, holding a 16-bit fingerprint of each
  counted key.

Adding a batch asks the shard's filter first. A key that it doesn't know is new and needs no look at
the exact table; the others are joined with ``counts``, which also settles false positives. Deleting
documents lowers the counts, and a key that nothing refers to any more leaves its shard's filter.
So adding and deleting the same documents gives the index that was there before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from umbra.llm.common import cut, parts_for, shuffle_partitions, text_bytes

SPACE = b" \t\n\x0b\x0c\r"
MIN_CODE_POINTS = 10
SLOTS = 4
MAX_KICKS = 500
#: A shard's keys and filter are handled in one task: so many keys at most on average, and so many bytes of text for a first guess.
KEYS_A_SHARD, BYTES_A_SHARD = 200_000, 8 << 20
EMPTY = np.uint16(0)


def line_key(line: bytes) -> bytes | None:
    """The 128-bit digest of a line's key; None if the key is too short to count."""
    key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z only
    if len(key) < MIN_CODE_POINTS or len(key) < 4 * MIN_CODE_POINTS and len(key.decode("utf-8", "replace")) < MIN_CODE_POINTS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, each key in one of two buckets."""

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized_for(cls, n_keys: int) -> CuckooFilter:
        need = max(1, int(n_keys / (SLOTS * 0.84)) + 1)
        return cls(1 << (need - 1).bit_length())

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int((self.table != EMPTY).sum())

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of each 64-bit hash."""
        fp = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (hashes & np.uint64(self.n - 1)).astype(np.int64)
        return fp, one, self.other(one, fp)

    def other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ ((fp.astype(np.int64) * 0x5BD1E995) & (self.n - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        fp, one, two = self.places(hashes)
        return (self.table[one] == fp[:, None]).any(1) | (self.table[two] == fp[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """Add each hash once; False if the table is too full (then it must be rebuilt larger)."""
        fp, one, two = self.places(hashes)
        left = np.arange(len(fp))
        for bucket in (one, two):
            left = left[~self._fill(bucket[left], fp[left])]
        return all(self._kick(int(two[i]), fp[i]) for i in left)

    def _fill(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their bucket; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.searchsorted(b, b, "left")
        rank = np.arange(len(b)) - first
        free = (self.table == EMPTY)[b]
        slot = np.cumsum(free, 1) - 1
        where = free & (slot == rank[:, None])
        ok = where.any(1)
        self.table[b[ok], where[ok].argmax(1)] = fp[order[ok]]
        done = np.zeros(len(fp), bool)
        done[order[ok]] = True
        return done

    def _kick(self, bucket: int, fp: np.uint16) -> bool:
        for step in range(MAX_KICKS):
            row = self.table[bucket]
            if (free := np.flatnonzero(row == EMPTY)).size:
                row[free[0]] = fp
                return True
            k = step % SLOTS
            row[k], fp = fp, row[k].copy()
            bucket = int(self.other(np.array([bucket]), np.array([fp]))[0])
        return False

    def remove(self, hashes: np.ndarray) -> None:
        """Take out one fingerprint for each hash that was inserted before."""
        fp, one, two = self.places(hashes)
        for f, a, b in zip(fp, one, two, strict=True):
            for bucket in (a, b):
                if (at := np.flatnonzero(self.table[bucket] == f)).size:
                    self.table[bucket, at[0]] = EMPTY
                    break


def hash64(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8")[::2].copy()


@dataclass
class LineIndex:
    n_shards: int
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_keys: int = 0  # keys added so far


POSTINGS = "shard int, key binary, doc_id long, lines array<int>"
COUNTS = "shard int, key binary, n_refs long, first_doc long, last_doc long, gen int"
FILTERS = "shard int, filters array<binary>"


def postings_of(docs: DataFrame, n_shards: int) -> DataFrame:
    """(shard, key, doc_id, lines): one row for each document and key, with the key's line numbers."""
    out = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("lines", pa.list_(pa.int32()))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                seen: dict[bytes, list[int]] = {}
                for i, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    if key := line_key(line):
                        seen.setdefault(key, []).append(i)
                rows += [(int.from_bytes(k[8:12], "little") % n_shards, k, doc.as_py(), at) for k, at in seen.items()]
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(keys, POSTINGS)


def _counted(postings: DataFrame) -> DataFrame:
    """Exact counts. Tasks sum what they hold before the shuffle, so a line in every document is one row a task."""
    return postings.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n_refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def new_index(spark: SparkSession, n_shards: int | None = None) -> LineIndex:
    """An index without documents."""
    empty = lambda schema: spark.createDataFrame([], schema)
    return LineIndex(n_shards or max(16, 4 * shuffle_partitions(spark)), empty(POSTINGS), empty(COUNTS), empty(FILTERS))


def _generations(state: pd.DataFrame) -> list[CuckooFilter]:
    return [CuckooFilter.from_bytes(x) for x in state["filters"].iloc[0]] if len(state) else []


def _probe(keys: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    hashes = hash64(list(keys["key"]))
    maybe = np.zeros(len(hashes), bool)
    for one in _generations(state):
        maybe |= one.contains(hashes)
    return keys.assign(maybe=maybe)


def _add(keys: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """Each key goes to the newest filter of its shard; when that is full, a filter of its own size or more follows."""
    all_of = _generations(state)
    gens = np.zeros(len(keys), np.int32)
    hashes = hash64(list(keys["key"]))
    if len(keys):
        room = all_of[-1].n * SLOTS * 0.84 - len(all_of[-1]) if all_of else 0
        if room < len(keys):
            all_of.append(CuckooFilter.sized_for(max(len(keys), 2 * len(all_of[-1]) if all_of else 0)))
        before = all_of[-1].table.copy()
        while not all_of[-1].insert(hashes):  # no room in reach of some key: put this batch in a larger filter
            all_of[-1].table = before
            all_of.append(CuckooFilter(all_of[-1].n * 2))
            before = all_of[-1].table.copy()
        gens[:] = len(all_of) - 1
    shard = (keys if len(keys) else state)["shard"].iloc[0]
    kept = pd.DataFrame({"shard": [shard], "filters": [[x.to_bytes() for x in all_of]]})
    return pd.concat([keys.assign(gen=gens, filters=None), kept], ignore_index=True)[["shard", "key", "n_refs", "first_doc", "last_doc", "gen", "filters"]]


def _take_out(keys: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    all_of = _generations(state)
    for gen, part in keys.groupby("gen"):
        all_of[int(gen)].remove(hash64(list(part["key"])))
    shard = (state if len(state) else keys)["shard"].iloc[0]
    return pd.DataFrame({"shard": [shard], "filters": [[x.to_bytes() for x in all_of]]})


def _dealt(keyed: DataFrame, n_shards: int) -> DataFrame:
    number = F.conv(F.hex(F.concat(*[F.substring("key", i, 1) for i in (12, 11, 10, 9)])), 16, 10).cast("long")
    return keyed.withColumn("shard", F.pmod(number, F.lit(n_shards)).cast("int"))


def resharded(index: LineIndex, n_shards: int) -> LineIndex:
    """The same index over another number of shards; filters are built anew from the exact table."""
    keys, none = _dealt(index.counts, n_shards).drop("gen"), index.filters.limit(0)
    both = cut(keys.groupBy("shard").cogroup(none.groupBy("shard")).applyInPandas(_add, f"{COUNTS}, filters array<binary>"))
    counts, filters = both.where("filters is null").drop("filters"), both.where("filters is not null").select("shard", "filters")
    return LineIndex(n_shards, _dealt(index.postings, n_shards), counts, filters, index.n_keys)


def grown(index: LineIndex) -> LineIndex:
    """The index, with twice as many shards or more if its shards have too many keys."""
    n = index.n_shards
    while index.n_keys > n * KEYS_A_SHARD:
        n *= 2
    return index if n == index.n_shards else resharded(index, n)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with a batch of new documents (doc_id, text)."""
    index = grown(index)
    return insert_postings(index, postings_of(docs, index.n_shards))


def insert_postings(index: LineIndex, added: DataFrame) -> LineIndex:
    batch = _counted(added)
    schema = "shard int, key binary, n_refs long, first_doc long, last_doc long, maybe boolean"
    asked = cut(batch.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(_probe, schema))
    maybe = asked.where("maybe").drop("maybe")
    known = index.counts.alias("c").join(maybe.alias("b"), ["shard", "key"], "left").select(
        "shard", "key", F.expr("c.n_refs + coalesce(b.n_refs, 0)").alias("n_refs"), F.expr("least(c.first_doc, b.first_doc)").alias("first_doc"), F.expr("greatest(c.last_doc, b.last_doc)").alias("last_doc"), "gen"
    )
    new = asked.where("not maybe").drop("maybe").unionByName(maybe.join(index.counts, ["shard", "key"], "left_anti"))
    both = cut(new.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(_add, f"{COUNTS}, filters array<binary>"))
    counts = known.unionByName(both.where("filters is null").drop("filters"))
    n_keys = index.n_keys + both.where("filters is null").count()
    return LineIndex(index.n_shards, index.postings.unionByName(added), counts, both.where("filters is not null").select("shard", "filters"), n_keys)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of doc_ids (doc_id); ids that it doesn't hold change nothing."""
    gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
    left = cut(index.postings.join(gone, "doc_id", "left_anti"))
    hit = index.postings.join(gone, "doc_id", "left_semi").select("shard", "key").distinct()
    again = _counted(left.join(hit, ["shard", "key"], "left_semi"))
    gens = index.counts.select("shard", "key", "gen")
    counts = cut(index.counts.join(hit, ["shard", "key"], "left_anti").unionByName(again.join(gens, ["shard", "key"])))
    dead = index.counts.join(counts, ["shard", "key"], "left_anti").select("shard", "key", "gen")
    filters = dead.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(_take_out, FILTERS)
    return LineIndex(index.n_shards, left, counts, cut(filters), index.n_keys)


@F.arrow_udf(T.StringType())
def _without_lines(text: pa.Array, dropped: pa.Array) -> pa.Array:
    def kept(t: str | None, drop: list[int] | None) -> str | None:
        if not drop:
            return t
        gone = set(drop)
        return "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)

    return pa.array([kept(t.as_py(), d.as_py()) for t, d in zip(text, dropped, strict=True)], pa.string())


def dedup_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with text without its repeated lines, and n_lines and n_dropped.

    A key in at least two documents loses its lines everywhere but in the document with the smallest
    id. Keys under ten code points count for nothing. A null text is one empty line and stays null; a
    document that loses every line has an empty text. Rows with a null id hold no key and stay as they
    are; rows that repeat an id are one document. Other columns pass through.
    """
    repeated = index.counts.where("first_doc < last_doc").select("shard", "key", "first_doc")
    drops = (
        index.postings.join(repeated, ["shard", "key"]).where("doc_id > first_doc")
        .groupBy("doc_id").agg(F.flatten(F.collect_list("lines")).alias("__dropped"))
    )
    joined = docs.join(drops.withColumnRenamed("doc_id", "__id"), F.col("doc_id").cast("long") == F.col("__id"), "left").drop("__id")
    n_lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")).cast("long") + 1
    n_dropped = F.coalesce(F.size(F.array_distinct("__dropped")), F.lit(0)).cast("long")
    return joined.withColumns({"n_lines": n_lines, "n_dropped": F.when(F.col("__dropped").isNull(), F.lit(0).cast("long")).otherwise(n_dropped)}).withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(_without_lines("text", "__dropped"))).drop("__dropped")


def line_index(docs: DataFrame, batches: int = 2) -> LineIndex:
    """An index over docs, filled in batches by the hash of the id, as a growing corpus would fill it."""
    index = new_index(docs.sparkSession, parts_for(text_bytes(docs), BYTES_A_SHARD, max(16, 4 * shuffle_partitions(docs.sparkSession))))
    found = cut(postings_of(docs, index.n_shards))
    for i in range(batches):
        index = insert_postings(index, found.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    return LineIndex(index.n_shards, found, index.counts, index.filters, index.n_keys)
