"""Event-time windows that late records correct (stream slicing).

Event time is cut into non-overlapping *panes* at window-boundary granularity.
A record touches exactly one pane; a pane keeps mergeable partial aggregates
(count, sum) by *epoch*, the number of publication ticks its record came after
the pane's own first publication.  A window is composed from the panes it
covers: epochs up to its publication make up the first result, later epochs up
to the cut-off are its corrections, anything later is left out.  A late record
thus changes one pane, and only windows over that pane are composed anew.

Cases: null event time, receipt time or entity - the record is left out; a null
value counts as a record and adds nothing to the sum; equal records are
separate records (remove copies first); an empty input gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slicing:
    """Windows of ``size`` seconds every ``slide`` seconds, published ``delay``
    seconds after their end and corrected up to ``cutoff`` seconds after it,
    at most every ``tick`` seconds."""

    size: int = 300
    slide: int = 300
    delay: int = 30
    cutoff: int = 3600
    tick: int = 30

    def __post_init__(self) -> None:
        if min(self.size, self.slide, self.tick) <= 0 or self.cutoff < self.delay:
            raise ValueError("sizes must be positive and the cut-off not before the publication")
        if self.pane % self.tick or (self.cutoff - self.delay) % self.tick:
            raise ValueError("the tick must divide the pane and the time from publication to cut-off")
        if self.size % self.slide:
            raise ValueError("the window must be a multiple of its slide")

    @property
    def pane(self) -> int:
        return gcd(self.size, self.slide)

    @property
    def last_epoch(self) -> int:
        return (self.cutoff - self.delay) // self.tick


def panes(records: DataFrame, keys: list[str], spec: Slicing) -> DataFrame:
    """Partial aggregates (keys, pane_start, epoch, n, total).

    ``records`` has the keys and event_time, received, value.  One shuffle of
    map-side combined partials.  Records too late for every window go to one
    epoch past the last, so that they can be counted.
    """
    start = (F.floor(F.col("event_time") / spec.pane) * spec.pane).cast("bigint")
    late = F.ceil((F.col("received") - (F.col("pane_start") + spec.pane + spec.delay)) / F.lit(float(spec.tick)))
    most = spec.last_epoch + (spec.size - spec.pane) // spec.tick + 1
    wanted = F.col("event_time").isNotNull() & F.col("received").isNotNull()
    for k in keys:
        wanted = wanted & F.col(k).isNotNull()
    return (
        records.filter(wanted & ~F.isnan("event_time") & ~F.isnan("received"))
        .select(*keys, "event_time", "received", "value")
        .withColumn("pane_start", start)
        .withColumn("epoch", F.least(F.greatest(late, F.lit(0)), F.lit(most)).cast("int"))
        .groupBy(*keys, "pane_start", "epoch")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    )


def compose(pane_table: DataFrame, keys: list[str], spec: Slicing) -> DataFrame:
    """Window epochs (keys, period_start, epoch, n, total); epoch 0 is the first
    publication, 1..last_epoch the corrections, last_epoch + 1 what came too late."""
    covering = spec.size // spec.pane
    shift = spec.pane // spec.tick
    t = pane_table
    if covering > 1:
        t = t.withColumn("_j", F.explode(F.array(*[F.lit(j) for j in range(covering)])))
        t = t.withColumn("period_start", F.col("pane_start") - (covering - 1 - F.col("_j")) * spec.pane)
        t = t.filter(F.pmod(F.col("period_start"), F.lit(spec.slide)) == 0)
        t = t.withColumn("epoch", F.greatest(F.lit(0), F.col("epoch") - F.col("_j") * shift))
    else:
        t = t.withColumnRenamed("pane_start", "period_start")
    return (
        t.withColumn("epoch", F.least(F.col("epoch"), F.lit(spec.last_epoch + 1)))
        .groupBy(*keys, "period_start", "epoch")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )


def windows(records: DataFrame, keys: list[str], spec: Slicing = Slicing()) -> DataFrame:
    """One row per window: first and final count and sum, records that corrected
    it (``late_n``), and those too late for it (``dropped_n``)."""
    w = compose(panes(records, keys, spec), keys, spec)
    first, kept = F.col("epoch") == 0, F.col("epoch") <= spec.last_epoch
    zero = F.lit(0).cast("bigint")
    return w.groupBy(*keys, "period_start").agg(
        F.sum(F.when(first, F.col("n")).otherwise(zero)).alias("first_n"),
        F.sum(F.when(first, F.col("total"))).alias("first_total"),
        F.sum(F.when(kept, F.col("n")).otherwise(zero)).alias("final_n"),
        F.sum(F.when(kept, F.col("total"))).alias("final_total"),
        F.sum(F.when(kept & ~first, F.col("n")).otherwise(zero)).alias("late_n"),
        F.sum(F.when(~kept, F.col("n")).otherwise(zero)).alias("dropped_n"),
    )


def revisions(records: DataFrame, keys: list[str], spec: Slicing = Slicing()) -> DataFrame:
    """Every published state of every window: (keys, period_start, revision,
    published_at, n, total).  Revision 0 is the first result; a window whose
    records all came late has its revision 0 with its first correction.

    The running sum covers at most ``last_epoch + 1`` rows of a window.
    """
    w = compose(panes(records, keys, spec), keys, spec).filter(F.col("epoch") <= spec.last_epoch)
    order = Window.partitionBy(*keys, "period_start").orderBy("epoch")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return w.select(
        *keys,
        "period_start",
        (F.row_number().over(order) - 1).cast("bigint").alias("revision"),
        (F.col("period_start") + spec.size + spec.delay + F.col("epoch") * spec.tick).alias("published_at"),
        F.sum("n").over(upto).alias("n"),
        F.sum("total").over(upto).alias("total"),
    )
