"""Operations that look one input back, without one task for all inputs.

An operation without keys whose only memory is the previous input (LAG, CHANGED,
BEFORE a value differs from the group's first) needs the order of all inputs, but not
in one place.  Inputs are put into blocks by ranges of their order, cut from their
lineage so that every use sees the same blocks; windows run within a block, and what
one block needs of the blocks before it is a row a block, known to the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from tidegauge.lang.tree import E
from tidegauge.plans.resolve import Resolved, mentions, states_of
from tidegauge.session import durable

BLOCK = "__block"


def lagged(r: Resolved) -> bool:
    """Whether the operation outputs every input, or filters, and all its states are LAG 1 of
    known values over all inputs."""
    states = [s for e in [r.where, *(e for _, e in r.fields)] for s in states_of(e)]
    trivial = r.commit is None or r.commit.op == "lit" and r.commit.at["v"] is True
    return trivial and not r.before and bool(states) and all(_lag(s, r) for s in states)


def _lag(s: E, r: Resolved) -> bool:
    k, x = s.args[:2] if len(s.args) > 1 else (None, None)
    over_all = s.at["life"] == "global" or not r.keys and not r.flush
    return s.op == "s:lag" and over_all and k.op == "lit" and k.at["v"] == 1 and not x.t.null and not mentions(x, "out") and not states_of(x)


def changing(r: Resolved) -> str | None:
    """The field x of AFTER (CHANGED x |? true) AND KEEP; what was last output is then
    the previous input's x."""
    c = r.commit
    plain = not r.flush and not r.before and not any(states_of(e) for _, e in r.fields) and not states_of(r.where)
    if not plain or c is None or c.op != "coalesce" or c.args[1].op != "lit" or c.args[1].at["v"] is not True or c.args[0].op != "ne":
        return None
    a, b = c.args[0].args
    same = a.op == "out" and b.op == "previous" and a.at["name"] == b.at["name"]
    others = mentions(r.where, "previous", "global_last") or any(mentions(e, "previous", "global_last", "global", "random", "split") for _, e in r.fields)
    return a.at["name"] if same and not others else None


def islands(r: Resolved) -> E | None:
    """The input x of BEFORE (in.x <> FIRST x |? false) without keys: runs of equal x."""
    c = r.commit
    if r.keys or not r.before or not r.flush or c is None or c.op != "coalesce" or c.args[1].op != "lit" or c.args[1].at["v"] is not False:
        return None
    if c.args[0].op != "ne" or states_of(r.where):
        return None
    a, b = c.args[0].args
    if a.op != "in" or a.t.null or b.op != "s:first" or b.at["life"] != "local":
        return None
    x = b.args[0]
    x = dict(r.fields).get(x.at["name"]) if x.op == "out" else x
    return a if x is not None and x.key() == a.key() else None


def blocks(df: DataFrame, order: str) -> DataFrame | None:
    """``df`` in blocks by ranges of ``order``; None where lineage cannot be cut."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, F.col(order)).withColumn(BLOCK, F.spark_partition_id())
    kept = durable(cut)
    return None if kept is cut else kept


def before(df: DataFrame, order: str, x: Column, name: str) -> DataFrame:
    """Adds ``name``: the previous row's x, over all blocks (null for the first row)."""
    df = df.withColumn(name, F.struct(x.alias("x")))
    last = df.groupBy(BLOCK).agg(F.max_by(name, order).alias("v")).collect()
    last.sort(key=lambda b: b[BLOCK])
    kind = df.schema[name].dataType
    borders = df.sparkSession.createDataFrame(
        [(b[BLOCK], a.v) for a, b in zip(last, last[1:])], S.StructType([S.StructField(BLOCK, S.IntegerType()), S.StructField("__border", kind)])
    )
    w = Window.partitionBy(BLOCK).orderBy(order)
    # One row a block, as many as shuffle partitions at most.
    return df.join(F.broadcast(borders), BLOCK, "left").withColumn(name, F.coalesce(F.lag(name).over(w), "__border")["x"]).drop("__border")


def numbered(df: DataFrame, order: str, starts: Column, name: str) -> tuple[DataFrame, int]:
    """Adds ``name``: how many rows up to this one start something; and how many do in all."""
    df = df.withColumn(name, starts.cast("bigint"))
    each = sorted(map(tuple, df.groupBy(BLOCK).agg(F.sum(name)).collect()))
    sums = list(accumulate(n for _, n in each))
    offsets = df.sparkSession.createDataFrame([(b, s - n) for (b, n), s in zip(each, sums)], f"`{BLOCK}` int, __offset bigint")
    w = Window.partitionBy(BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(F.broadcast(offsets), BLOCK).withColumn(name, F.col("__offset") + F.sum(name).over(w)).drop("__offset")
    return df, sums[-1] if sums else 0
