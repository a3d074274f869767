"""Distinct counts with k-minimum-values sketches.

A sketch is the sorted array of the k smallest 64-bit hashes of a group's
distinct values.  Sketches merge by keeping the smallest hashes of both, so
days, exporters or any other groups can be put together later.  With fewer than
k values the count is exact; beyond, the estimate (k-1)/u, u the k-th hash on
the unit interval, has a relative standard error of 1/sqrt(k-2) (3.2 % at 1000).

Building: map tasks sketch before the shuffle (``partials``): each keeps the distinct
hashes of its groups, k smallest a group, in a buffer of bounded size, for several
groupings at once.  One shuffle by group brings the partial sketches together; a
group, however hot, sends at most k hashes a buffer.

Cases: null values are not counted; null groups form a group; repeated values
count once; an empty input gives no groups; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct rows of a map task's buffer before its partial sketches go out.
BUFFER = 500_000
K = 1000
Z95 = 1.959963984540054


def unit(h: Column) -> Column:
    """A hash on (0, 1); its order is that of the signed hash."""
    return h / F.lit(2.0**64) + F.lit(0.5)


def hashed(value: Column) -> Column:
    return F.when(value.isNotNull(), F.xxhash64(value))


def _distinct(t: pa.Table) -> pa.Table:
    return t.group_by(t.column_names, use_threads=False).aggregate([])


def _least(t: pa.Table, group: list[str], k: int) -> pa.Table:
    """The k smallest hashes of each group of distinct rows."""
    if not group:
        return t if t.num_rows <= k else t.take(pc.array_sort_indices(t["h"])[:k])
    sizes = t.group_by(group, use_threads=False).aggregate([([], "count_all")])
    if t.num_rows == 0 or pc.max(sizes["count_all"]).as_py() <= k:
        return t
    # Groups numbered, rows in the order of (group, hash), the first k of each.
    number = np.zeros(t.num_rows, np.int64)
    for c in group:
        codes = pc.dictionary_encode(t[c].combine_chunks(), null_encoding="encode")
        number = np.unique(number * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.lexsort((t["h"].to_numpy(), number))
    sorted_ = number[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return t.take(pa.array(order[place < k]))


def partials(rows: DataFrame, keys: list[str], groupings: list[list[str]], k: int = K, buffer: int = BUFFER) -> DataFrame:
    """(_g, keys, h): per map task and grouping (its place in the list) the k smallest
    distinct hashes; keys that a grouping leaves out are null.  ``rows`` has the keys and ``h``."""
    names = [*keys, "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            # All keys first: coarser groupings are then made from fewer rows.
            t = _distinct(t)
            for i, g in enumerate(groupings):
                part = _least(_distinct(t.select([*g, "h"])) if len(g) < len(keys) else t, g, k)
                number = pa.array(np.full(part.num_rows, i, np.int8))
                columns = [part[c] if c in part.column_names else pa.nulls(part.num_rows, t.schema.field(c).type) for c in names]
                yield from pa.table([number, *columns], ["_g", *names]).combine_chunks().to_batches(max_chunksize=20_000)

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count > buffer:
                t = _distinct(pa.Table.from_batches(held))
                if 2 * t.num_rows > buffer:
                    yield from flush(t)
                    held, count = [], 0
                else:
                    held, count = t.combine_chunks().to_batches(), t.num_rows
        if held:
            yield from flush(pa.Table.from_batches(held))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["_g tinyint", *(f"`{c}` {kinds[c]}" for c in names)])
    return rows.filter(F.col("h").isNotNull()).select(*names).mapInArrow(run, schema)


def _together(parts: DataFrame, group: list[str], k: int) -> DataFrame:
    """Partial sketches of each group in one place, cut to k: adds the rank ``_r`` of each hash."""
    order = Window.partitionBy(*group).orderBy("h")
    return parts.repartition(*group).withColumn("_r", F.dense_rank().over(order)).filter(F.col("_r") <= k)


def counts_of(parts: DataFrame, group: list[str], k: int = K) -> DataFrame:
    """(group, n, kth): hashes kept and the largest of them; no arrays are built."""
    return _together(parts, group, k).groupBy(*group).agg(F.max("_r").cast("bigint").alias("n"), F.max("h").alias("kth"))


def counts(rows: DataFrame, group: list[str], k: int = K) -> DataFrame:
    """(group, n, kth) straight from rows with the group's columns and ``h``."""
    return counts_of(partials(rows, group, [group], k), group, k)


def sketches(rows: DataFrame, group: list[str], k: int = K) -> DataFrame:
    """(group, kmv): mergeable sketches."""
    return _arrays(_together(partials(rows, group, [group], k), group, k), group)


def _arrays(kept: DataFrame, group: list[str]) -> DataFrame:
    return kept.groupBy(*group).agg(F.sort_array(F.collect_set("h")).alias("kmv"))


def merge(table: DataFrame, group: list[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups from those of finer ones.

    The k smallest hashes, counted without repeats, are taken per partition
    before the shuffle, so a coarse group never gathers its whole contents.
    """
    rows = table.select(*group, F.explode("kmv").alias("h"))
    return _arrays(_together(partials(rows, group, [group], k), group, k), group)


def estimate(n: Column, kth: Column, k: int = K) -> Column:
    return F.when(n < k, n.cast("double")).otherwise(F.lit(k - 1.0) / unit(kth))


def bounds(n: Column, kth: Column, k: int = K, z: float = Z95) -> tuple[Column, Column]:
    """Confidence bounds (95 % by default); equal to the count where it is exact."""
    e, err = estimate(n, kth, k), z / (k - 2) ** 0.5
    exact = n < k
    return F.when(exact, e).otherwise(e / (1 + err)), F.when(exact, e).otherwise(e / (1 - err))


def size_of(kmv: Column, k: int = K) -> Column:
    return estimate(F.size(kmv), F.element_at(kmv, -1), k)


def union(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.concat(a, b))), 1, k)


def _part(a: Column, b: Column, inside: Column, k: int, z: float) -> tuple[Column, Column, Column]:
    """Estimate and bounds of a part of the union, from its share of the union's sketch.

    The share has Wilson's bounds, which stay open where none or all of the sketch is
    in the part; the spread of the union's size is added to theirs by squares."""
    u = union(a, b, k)
    n = F.size(u).cast("double")
    hit = F.size(F.array_intersect(u, inside)).cast("double")
    whole = F.when(n == 0, F.lit(0.0)).otherwise(size_of(u, k))
    some = F.greatest(n, F.lit(1.0))
    p, exact = hit / some, n < k
    middle, half = (p + z * z / (2 * some)) / (1 + z * z / some), z * F.sqrt(p * (1 - p) / some + z * z / (4 * some * some)) / (1 + z * z / some)
    of_size = p * z / (k - 2) ** 0.5
    below, above = p - F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0)) - p
    estimate_ = p * whole
    lo = F.greatest(estimate_ - whole * F.sqrt(below * below + of_size * of_size), hit)
    hi = estimate_ + whole * F.sqrt(above * above + of_size * of_size)
    return estimate_, F.when(exact, estimate_).otherwise(lo), F.when(exact, estimate_).otherwise(hi)


def intersection(a: Column, b: Column, k: int = K, z: float = Z95) -> tuple[Column, Column, Column]:
    """(estimate, lower, upper) of the values in both."""
    return _part(a, b, F.array_intersect(a, b), k, z)


def difference(a: Column, b: Column, k: int = K, z: float = Z95) -> tuple[Column, Column, Column]:
    """(estimate, lower, upper) of the values in ``a`` and not in ``b``."""
    return _part(a, b, F.array_except(a, b), k, z)
