"""The commit machine on streams: one machine per key in the state store.

Within a micro-batch inputs are taken in their declared order.  Operations whose
state or commits span keys run under one key, as their meaning demands.  The buffer
of SORT LAST is part of the state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.lang.types import of_spark, spark_type
from tidegauge.lang.tree import LanguageError
from tidegauge.plans.commit import Machine, SortBuffer
from tidegauge.plans.resolve import Resolved, mentions, states_of


def commit_stream(r: Resolved, df: DataFrame, ordered: bool) -> DataFrame:
    from tidegauge.plans.planner import ORD, Columns, from_spark, to_spark

    exprs = [*(e for _, e in r.fields), *([r.where] if r.where else []), *([r.commit] if r.commit else [])]
    if any(x.op == "split" for e in exprs for x in e.walk()):
        raise LanguageError("SPLIT needs an operation of its own before recursive or grouped ones")
    by = [*r.sort[2], *([r.sort[1]] if r.sort[1] is not None else [])] if r.sort else []
    states = [s for e in exprs for s in states_of(e)]
    spans = not r.keys or any(s.at["life"] == "global" for s in states) or any(mentions(e, "global_last", "global") for e in exprs) or mentions(r.commit, "in") or r.sort is not None
    used = sorted({x.at["name"] for e in [*exprs, *r.keys, *by] for x in e.walk() if x.op in ("in", "sorted")})
    types = {n: of_spark(df.schema[n]) for n in used}
    cs = Columns({})
    keys = [F.lit(0).alias("__k0")] if spans else [cs.col(k).alias(f"__k{i}") for i, k in enumerate(r.keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    # Packed into a struct, nulls stay nulls and integers exact on their way through pandas.
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(used)], F.lit(0).alias("none")).alias("__row")
    rows = df.select(*keys, packed, ORD)
    order = df.schema[ORD].dataType
    schema = S.StructType([S.StructField(f"__f_{n}", spark_type(e.t)) for n, e in r.fields] + [S.StructField(ORD, order)])
    out_types = [(n, e.t) for n, e in r.fields]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Machine(r)
        buffer = SortBuffer(*r.sort) if r.sort else None
        if state.exists:
            m.load(bytes(state.get[0]))
            if buffer:
                buffer.load(pickle.loads(bytes(state.get[1])))
        inputs: list[tuple] = []
        for pdf in frames:
            for o, x in zip(values_of(pdf[ORD]), values_of(pdf["__row"])):
                inputs.append((tuple(o.values()), o, {c: from_spark(x[f"c{i}"], types[c]) for i, c in enumerate(used)}))
        inputs.sort(key=lambda x: x[0])
        found: list[list[Any]] = []
        for _, o, row in inputs:
            row[ORD] = o
            for x in buffer.push(row) if buffer else (row,):
                for out in m.step(x):
                    found.append([*(to_spark(out[n], t) for n, t in out_types), x[ORD]])
        state.update((m.dump(), pickle.dumps(buffer.dump() if buffer else None)))
        columns = [*(f"__f_{n}" for n, _ in out_types), ORD]
        yield pd.DataFrame({c: pd.Series([f[i] for f in found], dtype=object) for i, c in enumerate(columns)})

    return rows.groupBy(*names).applyInPandasWithState(step, schema, "machine binary, sorted binary", "append", GroupStateTimeout.NoTimeout)


def values_of(structs: Any) -> list[dict]:
    """A struct column as dicts, however it came."""
    if isinstance(structs, pd.DataFrame):
        return structs.to_dict("records")
    return [x.asDict() if hasattr(x, "asDict") else dict(x) for x in structs]
