"""Folds over a key's rows in the order of their time, the same on tables and on streams.

On a stream a row is held until the watermark has passed it, so that rows may come in any order within the lateness and
across batches; then it is folded after all that come before it. A timer wakes a key when its next row is due or its state
ends, so what a state leaves at its end comes out without a further row of the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Over so many buckets the keys of a stream are dealt, each one state with a timer. A stream that goes on has to keep the number.
BUCKETS = 256


def keyed_state(spark: SparkSession) -> None:
    """State variables with timers need this state store; queries started from now on have it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@dataclass
class Fold:
    """step(state, row) -> (state, rows out), for rows (t, *columns) with t in microseconds; end(state) -> the rows that are left when it ends.

    ends(state) says when a state ends of itself if no row comes before that, or None: then it stays. columns, state and out
    are schemas: of the rows without t, which are their order among equal times, of the state, and of the rows out without the key.
    thin(rows), of rows (key, t, *columns) of several keys in any order, leaves out those that change neither the state nor what comes out, whatever other rows come.
    """

    step: Callable[[tuple, tuple], tuple[tuple, list[tuple]]]
    end: Callable[[tuple], list[tuple]]
    ends: Callable[[tuple], int | None]
    start: tuple
    columns: str
    state: str
    out: str
    thin: Callable[[list[tuple]], list[tuple]] = field(default=lambda rows: rows)

    def take(self, held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        """The state after a row, and all rows out: those of a state that has ended before it too."""
        done: list[tuple] = []
        if held is not None and (due := self.ends(held)) is not None and row[0] >= due:
            done, held = self.end(held), None
        held, made = self.step(self.start if held is None else held, row)
        return held, done + made


def _names(schema: str) -> list[str]:
    depth, names, word = 0, [], ""
    for c in schema + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            names.append(word.split()[0])
            word = ""
        else:
            word += c
    return names


def _tuples(part: pd.DataFrame, columns: list[str]) -> list[tuple]:
    """Rows of a frame, with None for what is null."""
    return list(zip(*((c.astype(object).where(c.notna(), None) if c.hasnans else c).tolist() for c in (part[x] for x in columns)), strict=True))


def _order(row: tuple) -> list[tuple]:
    return [(x is not None, x) for x in row]


class Ordered:
    """Rows that may not be final yet, and the state of those that were folded, of all keys of a bucket: what its group state holds.

    A group costs some milliseconds of Python in each micro-batch whatever is in it, so keys share one; a bucket that has
    new rows, or a key that is due, is read and written whole.
    """

    def __init__(self, key: str, kind: str, fold: Fold):
        self.fold, self.columns, self.out = fold, [key, "at_micros", *_names(fold.columns)], [key, *_names(fold.out)]
        self.state = f"held array<struct<k {kind}, {fold.state}>>, waiting array<struct<k {kind}, t long, {fold.columns}>>"

    def __call__(self, bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        states, waiting = state.get if state.exists else ([], [])
        held, rows = {h[0]: tuple(h[1:]) for h in states}, [tuple(r) for r in waiting]
        if not state.hasTimedOut:
            for part in parts:
                rows.extend(_tuples(part, self.columns))
                rows = self.fold.thin(rows)
        made: list[tuple] = []
        for k, *row in sorted((r for r in rows if r[1] <= passed), key=_order):
            held[k], done = self.fold.take(held.get(k), tuple(row))
            made += [(k, *d) for d in done]
        rest = [r for r in rows if r[1] > passed]
        wake = min((r[1] for r in rest), default=None)
        for k, h in list(held.items()):
            due = self.fold.ends(h)
            if due is not None and due <= passed:
                made += [(k, *d) for d in self.fold.end(held.pop(k))]
            elif due is not None:
                wake = due if wake is None else min(wake, due)
        if held or rest:
            state.update(([(k, *h) for k, h in held.items()], rest))
            if wake is not None:  # a group is woken once the watermark is beyond its time, which is a millisecond before the one that is due
                state.setTimeoutTimestamp(max(1, -(-wake // 1000) - 1))
        else:
            state.remove()
        if made:
            yield pd.DataFrame(made, columns=self.out)


def folded(rows: DataFrame, key: str, fold: Fold, late: str) -> DataFrame:
    """The fold's rows out, by key; rows: the key (whose type is kept), ts and the fold's columns.

    On a table a key's rows are read in order by one task, which holds one state. On a stream rows later than the watermark are dropped.
    """
    kind = dict(rows.dtypes)[key]
    out, names = f"{key} {kind}, {fold.out}", [key, *_names(fold.out)]
    columns = _names(fold.columns)
    if rows.isStreaming:
        keyed_state(rows.sparkSession)
        timed = rows.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at_micros"), *columns)
        ordered = Ordered(key, kind, fold)
        dealt = timed.withColumn("__bucket", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))))
        return dealt.groupBy("__bucket").applyInPandasWithState(ordered.__call__, out, ordered.state, "append", GroupStateTimeout.EventTimeTimeout)

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for part in parts:
            made: list[tuple] = []
            for k, row in zip(part[key].tolist(), _tuples(part, ["at_micros", *columns]), strict=True):
                if k != at:
                    made += [(at, *r) for r in fold.end(held)] if held is not None else []
                    at, held = k, None
                held, done = fold.take(held, row)
                made += [(k, *r) for r in done]
            yield pd.DataFrame(made, columns=names)
        if held is not None:
            yield pd.DataFrame([(at, *r) for r in fold.end(held)], columns=names)

    timed = rows.where(F.col(key).isNotNull()).select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros"), *columns)
    return timed.repartition(key).sortWithinPartitions(key, "at_micros", *columns).mapInPandas(batch, out)
