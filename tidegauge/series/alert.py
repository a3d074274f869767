"""Alert specifications: filter and re-aggregate, judge with hysteresis, fire on
a share of bad time, notify of changes.

``alert`` returns the changes, ``judged`` every step.  Per group of ``keys`` the
steps are independent, so all windows partition by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.series.resample import reaggregate, simple_filter


def _seasonal(x: DataFrame, keys: list[str], start: str, value: Column, b: dict) -> DataFrame:
    """``x`` with ``_base``: the percentiles of earlier windows of ``avg_window`` seconds,
    exponentially smoothed, of every ``seasonality``-th window only."""
    x = x.withColumn("_w", F.floor(F.col(start) / float(b["avg_window"])))
    each = x.groupBy(*keys, "_w").agg(F.percentile_approx(value, float(b.get("percentile", 50)) / 100, 10_000).alias("_perc"))
    season = F.pmod(F.col("_w"), F.lit(int(b.get("seasonality") or 1)))
    past = Window.partitionBy(*keys, season).orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    new = float(b.get("smooth_factor", 1.0))
    smoothed = F.aggregate(F.collect_list("_perc").over(past), F.lit(None).cast("double"), lambda s, p: F.coalesce(s * (1 - new) + p * new, p))
    names = [*keys, "_w"]
    bases = each.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], smoothed.alias("_base"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)]
    return x.join(bases, on, "left").drop("_w", *(f"_k{i}" for i in range(len(names))))


def judged(df: DataFrame, spec: dict) -> DataFrame:
    """Steps with value, bounds, ok and firing.

    Spec: column, threshold, recovery (defaults to the threshold), where and
    having (simple filters), keys, time_step (0: as is), duration and ratio (fire
    when at least that share of the past ``duration`` seconds was bad), and a
    ``baseline`` {avg_window, percentile, max_distance}: the bound is then a
    distance from a percentile, that of the past ``avg_window`` seconds or, with
    ``smooth_factor`` or ``seasonality``, that of the earlier windows of the season,
    smoothed.  All values of a window count, none are sampled, and the top
    contributors of a step are not listed.
    """
    start, column, keys = spec.get("start", "start"), spec["column"], spec.get("keys", [])
    x = df.filter(simple_filter(spec.get("where", [])))
    step = float(spec.get("time_step") or 0)
    if step:
        x = reaggregate(x, keys, step, [column], {column: spec.get("aggregate", "avg")}, start)
    x = x.filter(simple_filter(spec.get("having", [])))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(start)
    # Ranges of time are in whole microseconds.
    ranged = Window.partitionBy(*(keys or [F.lit(0)])).orderBy((F.col(start) * 1e6).cast("bigint"))
    value = F.col(column).cast("double")
    if b := spec.get("baseline"):
        if "smooth_factor" in b or "seasonality" in b:
            x = _seasonal(x, keys, start, value, b)
        else:
            past = ranged.rangeBetween(-int(float(b["avg_window"]) * 1e6), -1)
            x = x.withColumn("_base", F.percentile_approx(value, float(b.get("percentile", 50)) / 100, 10_000).over(past))
        far = float(b["max_distance"]) * (F.abs("_base") if b.get("relative", True) else F.lit(1.0))
        x = x.withColumn("_v", F.abs(value - F.col("_base"))).withColumn("_most", far).withColumn("_accept", far * float(b.get("recovery", 1.0)))
    else:
        x = x.withColumn("_v", value).withColumn("_most", F.lit(float(spec["threshold"]))).withColumn("_accept", F.lit(float(spec.get("recovery", spec["threshold"]))))
    up = F.col("_most") >= F.col("_accept")
    good = F.when(up, F.col("_v") <= F.least("_accept", "_most")).otherwise(F.col("_v") >= F.greatest("_accept", "_most"))
    bad = F.when(up, F.col("_v") > F.greatest("_accept", "_most")).otherwise(F.col("_v") < F.least("_accept", "_most"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("ok", F.coalesce(F.last(F.when(good, True).when(bad, False), ignorenulls=True).over(upto), F.lit(True)))
    span = float(spec.get("duration") or 0)
    share = F.avg((~F.col("ok")).cast("int")).over(ranged.rangeBetween(-int(span * 1e6), 0)) if span else (~F.col("ok")).cast("double")
    x = x.withColumn("bad_share", share).withColumn("firing", F.col("bad_share") >= float(spec.get("ratio", 1.0)))
    return x.select(*keys, start, F.col(column).alias("value"), "ok", "bad_share", "firing")


def alert(df: DataFrame, spec: dict) -> DataFrame:
    """Notifications: (name, keys, start, value, firing), one per change; the first
    step counts only if it fires."""
    start, keys = spec.get("start", "start"), spec.get("keys", [])
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(start)
    j = judged(df, spec).withColumn("_was", F.coalesce(F.lag("firing").over(order), F.lit(False)))
    return j.filter(F.col("firing") != F.col("_was")).select(
        F.lit(spec.get("name", spec["column"])).alias("name"), *keys, start, "value", "firing"
    )
