"""Continuous periods and gaps of overlapping intervals per entity.

State per (entity, chunk of time) is an ordered map of disjoint intervals; each
insertion finds the overlapped ones by binary search and merges them.  Maps are
mergeable, so they are built within map tasks first, then once per chunk after
the shuffle: a hot entity is spread over its chunks, and each task holds the
map of one chunk.  An interval belongs to the chunk of its start; how far
earlier chunks reach is carried over from one summary row per chunk.

Cases: null entity, start or end, or an end before its start - the interval is
left out; empty intervals (start = end) are points and join what they touch;
repeated and nested ones vanish in what covers them; touching ones are one
period; an empty input gives no period and no gap; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class IntervalMap:
    """Disjoint closed intervals, ordered; touching ones are merged."""

    __slots__ = ("ends", "starts")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def __len__(self) -> int:
        return len(self.starts)

    def insert(self, start: int, end: int) -> None:
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end)
        if lo < hi:
            start = min(start, self.starts[lo])
            end = max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def insert_many(self, starts: np.ndarray, ends: np.ndarray) -> None:
        """Insert a batch: runs that overlap within the batch go in as one."""
        order = np.argsort(starts, kind="stable")
        s, reach = starts[order], np.maximum.accumulate(ends[order])
        head = np.flatnonzero(np.concatenate(([True], s[1:] > reach[:-1])))
        tail = np.concatenate((head[1:], [len(s)])) - 1
        for a, b in zip(s[head].tolist(), reach[tail].tolist()):
            self.insert(a, b)

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


def _segments(pdf: pd.DataFrame) -> np.ndarray:
    """Where the (entity, chunk) of consecutive rows changes, 0 and the length included."""
    e, c = pdf["entity"].to_numpy(), pdf["chunk"].to_numpy()
    return np.concatenate(([0], np.flatnonzero((e[1:] != e[:-1]) | (c[1:] != c[:-1])) + 1, [len(pdf)]))


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map side: the disjoint intervals of each (entity, chunk) of a batch."""
    for pdf in frames:
        if not len(pdf):
            continue
        pdf = pdf.sort_values(["entity", "chunk", "start"], kind="stable", ignore_index=True)
        cuts = _segments(pdf)
        first = np.zeros(len(pdf), bool)
        first[cuts[:-1]] = True
        group = np.cumsum(first) - 1
        start, end = pdf["start"].to_numpy(), pdf["end"].to_numpy()
        base, span = start.min(), int(end.max() - start.min()) + 1
        if span * (int(group[-1]) + 1) < 1 << 62:  # one running maximum for all groups
            reach = np.maximum.accumulate(end - base + group * span) - group * span + base
        else:
            reach = pd.Series(end).groupby(group).cummax().to_numpy()
        head = first.copy()
        head[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(head)
        out = pdf.iloc[at].copy()
        out["end"] = reach[np.concatenate((at[1:], [len(pdf)])) - 1]
        yield out


def _keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reduce side, rows grouped by key: one map of intervals is the state of
    the current (entity, chunk); it is emitted when the key changes."""
    key, state = None, IntervalMap()

    def emitted(parts: list[tuple[tuple, IntervalMap]]) -> pd.DataFrame:
        sizes = [len(m) for _, m in parts]
        return pd.DataFrame(
            {
                "entity": np.repeat(np.array([k[0] for k, _ in parts]), sizes),
                "chunk": np.repeat(np.array([k[1] for k, _ in parts]), sizes),
                "start": [x for _, m in parts for x in m.starts],
                "end": [x for _, m in parts for x in m.ends],
            }
        )

    for pdf in frames:
        if not len(pdf):
            continue
        done = []
        cuts = _segments(pdf)
        e, c = pdf["entity"].to_numpy(), pdf["chunk"].to_numpy()
        starts, ends = pdf["start"].to_numpy(), pdf["end"].to_numpy()
        for a, b in zip(cuts[:-1], cuts[1:]):
            if key != (now := (e[a], c[a])):
                if key is not None:
                    done.append((key, state))
                key, state = now, IntervalMap()
            if b - a > 8:
                state.insert_many(starts[a:b], ends[a:b])
            else:
                for s, t in zip(starts[a:b].tolist(), ends[a:b].tolist()):
                    state.insert(s, t)
        if done:
            yield emitted(done)
    if key is not None:
        yield emitted([(key, state)])


def _covered(intervals: DataFrame, chunk_ms: int) -> DataFrame:
    kind = dict(intervals.dtypes)["entity"]
    schema = f"entity {kind}, chunk bigint, start bigint, end bigint"
    return (
        intervals.filter(
            F.col("entity").isNotNull() & F.col("start").isNotNull() & (F.col("end") >= F.col("start"))
        )
        .select("entity", F.floor(F.col("start") / chunk_ms).cast("bigint").alias("chunk"), "start", "end")
        .mapInPandas(_combine, schema)
        .repartition("entity", "chunk")
        .sortWithinPartitions("entity", "chunk")
        .mapInPandas(_keyed, schema)
    )


def _reaching(intervals: DataFrame, chunk_ms: int) -> DataFrame:
    """Disjoint intervals of each chunk with ``reach``: the furthest end of all
    that start before, null for the entity's first."""
    pieces = _covered(intervals, chunk_ms)
    in_order = Window.partitionBy("entity").orderBy("chunk")
    carried = pieces.groupBy("entity", "chunk").agg(F.max("end").alias("_end")).select(
        "entity", "chunk", F.max("_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("carried")
    )
    within = Window.partitionBy("entity", "chunk").orderBy("start")
    return pieces.join(carried, ["entity", "chunk"]).select(
        "entity", "chunk", "start", "end", F.greatest(F.lag("end").over(within), F.col("carried")).alias("reach")
    )


def gaps(intervals: DataFrame, chunk_ms: int = 3_600_000) -> DataFrame:
    """(entity, gap_start, gap_end) between an entity's periods; ``intervals``
    has entity, start and end in the same integer unit as ``chunk_ms``."""
    return (
        _reaching(intervals, chunk_ms)
        .filter(F.col("start") > F.col("reach"))
        .select("entity", F.col("reach").alias("gap_start"), F.col("start").alias("gap_end"))
    )


def periods(intervals: DataFrame, chunk_ms: int = 3_600_000) -> DataFrame:
    """(entity, period_start, period_end), continuous and maximal.

    A period is a head (a start beyond the reach of all before) and the reach
    just before the next head.  The last head of a chunk looks that up in the
    summary of the chunks that follow, so no task sees a whole entity.
    """
    r = _reaching(intervals, chunk_ms)
    head = F.col("reach").isNull() | (F.col("start") > F.col("reach"))
    heads = r.filter(head)
    summary = r.groupBy("entity", "chunk").agg(
        F.min_by(F.col("reach"), F.when(head, F.col("start"))).alias("_before"),
        F.max(F.when(head, 1)).alias("_has"),
        F.max(F.greatest("end", F.coalesce("reach", "end"))).alias("_end"),
    )
    after = Window.partitionBy("entity").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    summary = summary.select(
        "entity",
        "chunk",
        F.coalesce(
            F.first(F.when(F.col("_has") == 1, F.col("_before")), ignorenulls=True).over(after),
            F.max("_end").over(Window.partitionBy("entity").orderBy("chunk").rowsBetween(0, Window.unboundedFollowing)),
        ).alias("_last"),
    )
    within = Window.partitionBy("entity", "chunk").orderBy("start")
    return (
        heads.withColumn("_next", F.lead("reach").over(within))
        .join(summary, ["entity", "chunk"])
        .select(
            "entity",
            F.col("start").alias("period_start"),
            F.coalesce("_next", "_last").alias("period_end"),
        )
    )
