"""Resampling of interval-valued series, factors, and re-aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample(
    df: DataFrame,
    since: float,
    until: float,
    points: int,
    fields: dict[str, str],
    factors: list[str] | None = None,
    start: str = "start",
    stop: str | None = None,
    at: str = "middle",
) -> DataFrame:
    """``points`` buckets over [since, until): (t, factors, fields).

    A value is taken as intensive: it counts for every bucket its interval
    overlaps, sums and averages weighted by the share of the bucket covered,
    minima and maxima as they are.  ``fields`` maps a column to min, max, sum,
    count or avg.  Every bucket appears for each combination of factors that
    has a value in the range (and once, with nulls, if there are no factors);
    empty ones have nulls.  Rows are pre-aggregated per bucket map-side; the
    spine is points times combinations, the size of the answer.
    """
    if points < 1 or until <= since:
        raise ValueError("an empty range of time")
    factors = factors or []
    width = (until - since) / points
    t1 = F.col(start).cast("double")
    t2 = F.greatest(F.col(stop).cast("double"), t1) if stop else t1
    inside = df.filter((t2 >= since) & (t1 < until) & t1.isNotNull())

    def index(t: Column) -> Column:
        return F.least(F.greatest(F.floor((t - since) / width), F.lit(0)), F.lit(points - 1)).cast("int")

    last = F.when((t2 > t1) & ((t2 - since) % width == 0), index(t2) - 1).otherwise(index(t2))
    rows = inside.withColumn("_b", F.explode(F.sequence(index(t1), F.greatest(last, index(t1)))))
    low = F.lit(since) + F.col("_b") * width
    share = F.when(t2 > t1, (F.least(t2, low + width) - F.greatest(t1, low)) / width).otherwise(F.lit(1.0))
    rows = rows.withColumn("_w", share)
    aggs = []
    for c, how in fields.items():
        x = F.col(c).cast("double")
        agg = {
            "min": lambda x=x: F.min(x),
            "max": lambda x=x: F.max(x),
            "sum": lambda x=x: F.sum(x * F.col("_w")),
            "count": lambda x=x: F.count(x),
            "avg": lambda x=x: F.sum(x * F.col("_w")) / F.sum(F.when(x.isNotNull(), F.col("_w"))),
        }[how]()
        aggs.append(agg.alias(c))
    got = rows.groupBy("_b", *factors).agg(*aggs)
    buckets = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_b")
    spine = inside.select(*factors).distinct().select(*factors, buckets) if factors else df.sparkSession.range(1).select(buckets)
    on = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ["_b", *factors]])
    shift = {"begin": 0.0, "middle": 0.5, "end": 1.0}[at]
    return spine.alias("s").join(got.alias("g"), on, "left").select(
        (F.lit(since) + (F.col("s._b") + shift) * width).alias("t"), *[F.col(f"s.{c}") for c in factors], *[F.col(f"g.{c}") for c in fields]
    )


def aligned(since: float, until: float, step: float) -> tuple[float, float, int]:
    """The range widened to multiples of ``step``, and its number of buckets."""
    lo = since // step * step
    hi = -(-until // step) * step
    return lo, hi, max(1, round((hi - lo) / step))


def possible_values(df: DataFrame, factor: str, since: float | None = None, until: float | None = None, start: str = "start", stop: str | None = None) -> DataFrame:
    """Distinct values of a factor among rows that touch the range."""
    if until is not None:
        df = df.filter(F.col(start) <= until)
    if since is not None:
        df = df.filter(F.coalesce(F.col(stop or start), F.col(start)) >= since)
    return df.select(factor).distinct()


def default_aggregate(df: DataFrame, field: str) -> str:
    """How a field is re-aggregated: as its metadata says, else by its type."""
    f = df.schema[field]
    how = (f.metadata or {}).get("aggregate")
    if how:
        return how
    return "sum" if f.dataType.simpleString() in ("double", "float", "int", "bigint", "smallint", "tinyint") or f.dataType.simpleString().startswith("decimal") else "first"


def reaggregate(df: DataFrame, keys: list[str], step: float, fields: list[str], how: dict[str, str] | None = None, start: str = "start") -> DataFrame:
    """Fields over steps of time by their own aggregates; ``same`` averages again."""
    bucket = (F.floor(F.col(start) / step) * step).alias(start)
    table = {
        "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "same": F.avg, "bitand": F.bit_and, "bitor": F.bit_or,
        "bitxor": F.bit_xor, "count": F.count, "first": lambda c: F.min_by(c, F.col(start)), "last": lambda c: F.max_by(c, F.col(start)),
    }
    aggs = [table[(how or {}).get(f) or default_aggregate(df, f)](F.col(f)).alias(f) for f in fields]
    return df.groupBy(*keys, bucket).agg(*aggs)


OPERATORS = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a.isin(b), "not in": lambda a, b: ~a.isin(b), "like": lambda a, b: a.ilike(b),
    "not like": lambda a, b: ~a.ilike(b),
}


def simple_filter(filters: list[dict]) -> Column:
    """Filters {lhs, op, rhs}, all of which must hold; a null left side fails."""
    out = F.lit(True)
    for f in filters:
        out = out & F.coalesce(OPERATORS[f.get("op", "=").lower()](F.col(f["lhs"]), f["rhs"]), F.lit(False))
    return out
