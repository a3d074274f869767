"""Pivot specifications: typed rows to columns per key and step of time.

A spec is a mapping: ``keys`` (columns), ``duration`` (seconds), ``value`` and
``type`` (columns), ``where`` (simple filters) and ``fields``: each with a name,
a pattern of the type, and ``aggregates`` (count, first, last, min, max, sum,
avg, percentiles, and ``{"top": n, "by": column}``: the n values of the largest sum of
the column, or of most rows, greatest first, ties by value); avg by default.  A field of
one aggregate has the field's name, of several field_aggregate... as agg_field.

Tops are counted exactly, by value with map-side combining; n values a partition
reach a group's task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.series.resample import simple_filter


def _percentile(x: Column, p: float) -> Column:
    """Nearest rank of the group's values."""
    v = F.array_sort(F.filter(F.collect_list(x), lambda y: y.isNotNull()))
    return F.get(v, F.round(F.lit(p) / 100 * (F.size(v) - 1)).cast("int"))


def pivot(df: DataFrame, spec: dict) -> DataFrame:
    start, kind, value = spec.get("start", "start"), F.col(spec["type"]), F.col(spec["value"])
    duration = float(spec["duration"])
    order = F.struct(F.col(start), *[F.col(c) for c in spec.get("order", [])])
    aggs, tops = [], []
    for f in spec["fields"]:
        x = F.when(kind.ilike(f["pattern"]), value)
        table = {
            "count": lambda x=x: F.count(x), "sum": lambda x=x: F.sum(x), "avg": lambda x=x: F.avg(x), "min": lambda x=x: F.min(x), "max": lambda x=x: F.max(x),
            "first": lambda x=x: F.min_by(x, F.when(x.isNotNull(), order)), "last": lambda x=x: F.max_by(x, F.when(x.isNotNull(), order)),
        }
        columns = []
        several = len(f.get("aggregates") or ["avg"]) > 1
        for a in f.get("aggregates") or ["avg"]:
            if isinstance(a, dict) and "top" in a:
                tops.append((f"top_{f['name']}" if several else f["name"], x, a))
            elif isinstance(a, dict) and "percentiles" in a:
                columns += [(f"{p:g}th", _percentile(x, p)) for p in a["percentiles"]]
            else:
                columns.append((a, table[a]()))
        single = len(columns) == 1 and not several
        aggs += [c.alias(f["name"] if single else f"{n}_{f['name']}") for n, c in columns]
    by = [*spec["keys"], (F.floor(F.col(start) / duration) * duration).alias("start")]
    rows = df.filter(simple_filter(spec.get("where", [])))
    out = rows.groupBy(*by).agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
    keys = [*spec["keys"], "start"]
    for name, x, a in tops:
        best = _top(rows.select(*by, x.alias("_x"), (F.col(a["by"]) if a.get("by") else F.lit(1)).alias("_w")), keys, name, int(a["top"]))
        best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = out.join(best, same, "left").drop(*[f"_{k}" for k in keys])
    return out.drop(*([] if aggs else ["_n"])).withColumn("stop", F.col("start") + duration)


def _top(rows: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    """(keys, name): the n heaviest values of each group."""
    sums = rows.filter(F.col("_x").isNotNull()).groupBy(*keys, "_x").agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("_w"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_w").desc(), F.col("_x")))
    kept = sums.withColumn("_r", rank).filter(F.col("_r") <= n)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_x"))), lambda v: v["_x"]).alias(name))
