"""Tumbling windows of the language as watermarked aggregations.

The bucket key of the operation gives the window; how far its commit condition
waits beyond the window's end gives the lateness (or a caller's own).  Records
later than that are dropped by the watermark, where the batch plan would still
count them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.lang.tree import E, LanguageError
from tidegauge.plans.resolve import Resolved


def constant(e: E) -> float | None:
    if e.op == "lit" and isinstance(e.at["v"], (int, float)):
        return float(e.at["v"])
    if e.op in ("add", "mul"):
        a, b = (constant(x) for x in e.args)
        if a is not None and b is not None:
            return a + b if e.op == "add" else a * b
    if e.op == "cast":
        return constant(e.args[0])
    return None


def bucket(r: Resolved) -> tuple[E, float]:
    """The time expression and the size of its bucket."""
    for k in r.keys:
        if k.op in ("idiv", "truncate") and (size := constant(k.args[1])):
            return k.args[0], size
    raise LanguageError("a stream needs a key start // size or TRUNCATE(start, size)")


def at_output(e: E, value: float) -> float | None:
    """The value of an expression of constants and one field of the output."""
    if e.op == "out":
        return value
    if e.op in ("add", "sub", "mul", "div", "neg"):
        x = [at_output(a, value) for a in e.args]
        if None in x:
            return None
        return {"add": lambda: x[0] + x[1], "sub": lambda: x[0] - x[1], "mul": lambda: x[0] * x[1], "div": lambda: x[0] / x[1] if x[1] else None, "neg": lambda: -x[0]}[e.op]()
    return constant(e)


def lateness_of(r: Resolved, size: float) -> float:
    """For in.t > f(out.x): what f waits beyond the end of the window of the least x.

    x is the window's number (f has the window's size as its slope) or a time in it
    (a slope of 1); the first window ends at ``size`` in both cases."""
    bound = r.commit.args[1]
    if len({x.at["name"] for x in bound.walk() if x.op == "out"}) == 1:
        low, high, next_ = (at_output(bound, x) for x in (0.0, 1.0, 2.0))
        if None not in (low, high, next_) and abs(next_ - 2 * high + low) < 1e-9 * max(1.0, size) and (abs(high - low - 1) < 1e-9 or abs(high - low - size) < 1e-6 * size):
            return max(0.0, low - size)
    raise LanguageError("how late inputs may be does not follow from the COMMIT condition: name it with Engine(lateness=...)")


def watermarked(r: Resolved, df: DataFrame, cs: Any, lateness: float | None) -> tuple[DataFrame, list[Column]]:
    time, size = bucket(r)
    late = lateness_of(r, size) if lateness is None else lateness
    df = df.withColumn("__ts", F.timestamp_micros((cs.col(time) * 1e6).cast("bigint"))).withWatermark("__ts", f"{int(late * 1000)} milliseconds")
    return df, [F.window("__ts", f"{int(size * 1000)} milliseconds").alias("__w")]
