"""Implausible values, spikes and frozen stretches of measured series.

Each value is judged by its own series and value position:

* *implausible*: not finite, or outside the limits of its type and position;
* *tail*: a peaks-over-threshold model of the seasonal residuals.  The residual
  is the value less the series' median and less its seasonal median (by hour of
  day, held within ``season_mads`` median distances).  Residuals beyond
  ``peak_mads`` median distances are peaks; a generalised Pareto law of the
  excesses sets the cut-off that a normal value exceeds with probability ``risk``.
  Excesses, in median distances, share one shape over all series; scale and rate of
  peaks are each series' own, drawn towards those of all by ``prior`` peaks, so a
  series of few peaks has a cut-off too.  Spikes must not inflate the fit that should
  find them: peaks beyond ``trim_mads`` take no part in it (no cut-off is held there);
* *stuck*: one of at least ``stuck`` consecutive readings with the same values.

A series whose plausible values never differ has no tail and no stuck values.
``fit`` tells what a cut-off rests on: ``series`` (``prior`` own peaks or more),
``pooled`` (fewer), or ``none`` where no fit is possible, for series whose median
distance is 0 or when there are fewer than ``least_peaks`` peaks in all; the cut-off
is then the threshold of the peaks.

Every statistic is a map-side combined aggregate (quantile sketches, counts,
moments), so one series may hold any share of the rows.  Medians are exact for
series of up to ``accuracy`` values and within a rank error of 1/accuracy
beyond.  Runs are found within blocks of time, and only the first and last run
of a block are joined up with their neighbours.

Cases: rows with a null key, time or values are no readings (see
``monitoring.readings``); null elements count as absent; equal rows are judged
alike, each on its own; an empty input gives no flags; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import durable
from tidegauge.sources.monitoring import bigint_floor, series_hash


@dataclass(frozen=True)
class Rules:
    risk: float = 1e-4
    peak_mads: float = 4.0
    season_mads: float = 2.0
    trim_mads: float = 9.0
    prior: int = 10
    least_peaks: int = 30
    stuck: int = 15
    block_s: int = 21_600
    accuracy: int = 100_000


def with_limits(readings: DataFrame, metric_type: DataFrame, ds_type: str = "gauge") -> DataFrame:
    """Readings of types with ``ds_type`` positions, as (metric_id, s1, s2, time,
    values, limits); ``limits`` maps a position to its (min, max).

    The type table is a fixed dictionary of a few rows, and joins as such."""
    limits = (
        metric_type.filter((F.col("ds_type") == ds_type) & F.col("type_name").isNotNull() & F.col("value_pos").isNotNull())
        .groupBy("type_name", "value_pos")
        .agg(F.min("min_value").alias("lo"), F.max("max_value").alias("hi"))
        .groupBy("type_name")
        .agg(F.map_from_entries(F.collect_list(F.struct("value_pos", F.struct("lo", "hi")))).alias("limits"))
    )
    return readings.join(limits, "type_name").select("metric_id", *series_hash(), "time", "values", "limits")


def _implausible(v: Column, limit: Column) -> Column:
    inf = F.lit(float("inf"))
    return (
        F.isnan(v)
        | (F.abs(v) == inf)
        | F.coalesce(v < limit["lo"], F.lit(False))
        | F.coalesce(v > limit["hi"], F.lit(False))
    )


def _points(limited: DataFrame) -> DataFrame:
    """One row per judged value: (metric_id, s1, s2, pos, hour, v, bad)."""
    return (
        limited.select("metric_id", "s1", "s2", bigint_floor(F.col("time") % 86_400, 3600).cast("int").alias("hour"), "limits", F.posexplode("values").alias("pos", "v"))
        .filter(F.col("v").isNotNull() & F.map_contains_key("limits", F.col("pos")))
        .select("metric_id", "s1", "s2", "pos", "hour", "v", _implausible(F.col("v"), F.element_at("limits", F.col("pos"))).alias("bad"))
    )


def _median(c: str, accuracy: int) -> Column:
    """Mean of the two middle values: the ranks ceil(n/2) and ceil(n/2 + tiny)."""
    q = F.percentile_approx(c, [0.5, 0.5 + 1e-9], accuracy)
    return (q[0] + q[1]) / 2


KEY = ["s1", "s2", "pos"]


def normals(points: DataFrame, rules: Rules) -> DataFrame:
    """What is normal for each varying series and position: (key, centre, scale, count).

    Two passes of map-side combined sketches; the first result is small, one
    row per series, and cut from its lineage because several plans read it.
    """
    good = points.filter(~F.col("bad"))
    centres = (
        good.groupBy(*KEY)
        .agg(_median("v", rules.accuracy).alias("centre"), F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count(F.lit(1)).alias("count"))
        .filter(F.col("_lo") < F.col("_hi"))
        .drop("_lo", "_hi")
    )
    distances = good.join(durable(centres), KEY).withColumn("distance", F.abs(F.col("v") - F.col("centre")))
    return durable(distances.groupBy(*KEY, "centre", "count").agg(_median("distance", rules.accuracy).alias("scale")))


def candidates(points: DataFrame, normal: DataFrame, rules: Rules) -> DataFrame:
    """Implausible values and those far enough off to be peaks, in one pass.

    With the season held within ``season_mads``, a residual can only be a peak
    where the distance is beyond ``peak_mads`` - ``season_mads``."""
    distance = F.abs(F.col("v") - F.col("centre"))
    near = (distance > 0) & (distance >= (rules.peak_mads - rules.season_mads) * F.col("scale"))
    return points.join(normal, KEY, "left").filter(F.col("bad") | near)


def tails(points: DataFrame, near: DataFrame, normal: DataFrame, rules: Rules) -> DataFrame:
    """Peaks beyond their series' cut-off: (metric_id, pos, v, centre, scale, residual, cutoff, fit)."""
    seasons = points.filter(~F.col("bad")).groupBy(*KEY, "hour").agg(F.percentile_approx("v", 0.5, 1000).alias("_hourly"))
    bound = rules.season_mads * F.col("scale")
    season = F.coalesce(F.least(F.greatest(F.col("_hourly") - F.col("centre"), -bound), bound), F.lit(0.0))
    peaks = durable(
        near.join(seasons, [*KEY, "hour"], "left")
        .withColumn("residual", F.col("v") - F.col("centre") - season)
        .withColumn("excess", F.abs("residual") - rules.peak_mads * F.col("scale"))
        .filter(F.col("excess") > 0)
        .select("metric_id", *KEY, "v", "centre", "scale", "count", "residual", "excess")
    )
    # Excesses in median distances, those of presumed spikes left out.
    e = F.col("excess") / F.col("scale")
    fitted = peaks.filter((F.col("scale") > 0) & (e <= rules.trim_mads - rules.peak_mads))
    own = durable(
        fitted.groupBy(*KEY, "count").agg(F.count(F.lit(1)).alias("peaks"), F.sum(e).alias("_e"), F.sum(e * e).alias("_e2"))
    )
    of_all = own.agg(F.sum("peaks").alias("n"), F.sum("_e").alias("e"), F.sum("_e2").alias("e2")).first()
    values = normal.filter(F.col("scale") > 0).agg(F.sum("count").alias("n")).first().n
    threshold = rules.peak_mads * F.col("scale")
    kept = ["metric_id", "pos", "v", "centre", "scale", "residual", "cutoff", "fit"]
    if not of_all.n or of_all.n < rules.least_peaks:
        return peaks.select(*[c for c in kept if c not in ("cutoff", "fit")], threshold.alias("cutoff"), F.lit("none").alias("fit"))
    # Moments: shape = (1 - m^2/s^2)/2, scale = m (1 - shape).
    mean = of_all.e / of_all.n
    spread = max(of_all.e2 / of_all.n - mean * mean, 1e-12)
    shape = min(max((1 - mean * mean / spread) / 2, -0.5), 0.3)
    shape = shape if abs(shape) > 1e-6 else 1e-6
    rate = of_all.n / values
    n, total = F.coalesce("peaks", F.lit(0)), F.coalesce("_e", F.lit(0.0))
    sigma = (total + rules.prior * mean) / (n + rules.prior) * (1 - shape)
    odds = (n + rules.prior) / (F.col("count") + rules.prior / rate) / rules.risk
    beyond = F.greatest(sigma / shape * (F.pow(odds, F.lit(shape)) - 1), F.lit(0.0))
    fit = F.when(F.col("scale") == 0, "none").when(n >= rules.prior, "series").otherwise("pooled")
    return (
        peaks.join(own.drop("count"), KEY, "left")
        .withColumn("cutoff", threshold + F.col("scale") * beyond)
        .filter(F.abs("residual") > F.col("cutoff"))
        .withColumn("fit", fit)
        .select(*kept)
    )


def stuck(limited: DataFrame, series: DataFrame, rules: Rules) -> DataFrame:
    """Readings (metric_id, run) in runs of at least ``rules.stuck`` equal ones, in
    the order (time, metric_id), of the given series."""
    block = ["s1", "s2", "block"]
    rows = limited.select(
        "metric_id", "s1", "s2", bigint_floor(F.col("time"), rules.block_s).alias("block"), "time", F.xxhash64("values").alias("vh")
    )
    order = Window.partitionBy(*block).orderBy("time", "metric_id")
    changed = F.coalesce((F.col("vh") != F.lag("vh").over(order)).cast("int"), F.lit(0))
    numbered = (
        rows.withColumn("_c", changed)
        .withColumn("run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("last", F.max("run").over(Window.partitionBy(*block)))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*block, "run")))
    )
    border = (F.col("run") == 0) | (F.col("run") == F.col("last"))
    whole = numbered.filter((F.col("n") >= rules.stuck) & ~border).select("metric_id", "s1", "s2", F.col("n").alias("run_length"))
    edge = numbered.filter(border)
    # Border runs of a series, two a block at most, in the order of time.
    borders = edge.groupBy(*block, "run", "vh").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("s1", "s2").orderBy("block", "run")
    joined = (F.lag("vh").over(line) == F.col("vh")) & (F.lag("block").over(line) != F.col("block"))
    chains = (
        borders.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
        .withColumn("_chain", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("run_length", F.sum("n").over(Window.partitionBy("s1", "s2", "_chain")))
        .filter(F.col("run_length") >= rules.stuck)
        .select(*block, "run", "run_length")
    )
    long_edges = edge.join(chains, [*block, "run"]).select("metric_id", "s1", "s2", "run_length")
    return whole.unionByName(long_edges).join(series, ["s1", "s2"], "left_semi").select("metric_id", "run_length")


def spikes(readings: DataFrame, metric_type: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All flags: (metric_id, rule, pos, v, centre, scale, cutoff, fit); ``pos`` and
    what follows are null for stuck readings, whose run length is in ``cutoff``."""
    limited = with_limits(readings, metric_type)
    points = _points(limited)
    normal = normals(points, rules)
    found = durable(candidates(points, normal, rules))
    none, unfitted = F.lit(None).cast("double"), F.lit(None).cast("string").alias("fit")
    implausible = found.filter("bad").select(
        "metric_id", F.lit("implausible").alias("rule"), "pos", "v", none.alias("centre"), none.alias("scale"), none.alias("cutoff"), unfitted
    )
    tail = tails(points, found.filter(~F.col("bad")), normal, rules).select(
        "metric_id", F.lit("tail").alias("rule"), "pos", "v", "centre", "scale", "cutoff", "fit"
    )
    frozen = stuck(limited, normal.select("s1", "s2").distinct(), rules).select(
        "metric_id",
        F.lit("stuck").alias("rule"),
        F.lit(None).cast("int").alias("pos"),
        none.alias("v"),
        none.alias("centre"),
        none.alias("scale"),
        F.col("run_length").cast("double").alias("cutoff"),
        unfitted,
    )
    return implausible.unionByName(tail).unionByName(frozen)


def confirmed(flags: DataFrame, mads: float = 12.0) -> DataFrame:
    """Exact check after the operator: tail flags must lie further from the
    centre than ``mads`` median distances.  Distinct (metric_id)."""
    far = F.abs(F.col("v") - F.col("centre")) > mads * F.col("scale")
    return flags.filter((F.col("rule") != "tail") | far).select("metric_id").distinct()
