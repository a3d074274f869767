"""From programs to DataFrames.

Each operation takes the cheapest of five plans:

1. *map*: no state - a projection, a filter, and rows made by SPLIT;
2. *running*: every input is output and each stateful function has a window form;
3. *grouped*: the commit condition is a recognised pattern (tumbling windows
   closed by time, blocks of n inputs) and each function has an aggregate form;
4. *chained*: without keys, looking back one input only - windows within blocks of the
   order and a row a block carried over;
5. *machine*: anything else, the commit machine over sorted rows, one task per
   hash partition of the keys; in one task only if the operation's state or its
   commits span keys.

Order of arrival is explicit: a source names its order columns, and a hidden
struct column carries them as far as an operation downstream needs them.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidegauge.functions import scalar, stateful
from tidegauge.functions.stateful import Win
from tidegauge.lang.parser import parse
from tidegauge.lang.tree import Aggregate, E, Field, Function, LanguageError, Listen, Program, Read, Sited
from tidegauge.lang.types import T, is_arr, is_int, of_spark, spark_type
from tidegauge.plans import chained
from tidegauge.plans.commit import Clause, Ctx, Machine, sorting
from tidegauge.plans.resolve import Resolved, Resolver, mentions, states_of

ORD = "__ord"


def literal(e: E) -> Column:
    v, t = e.at["v"], e.t
    if v is None:
        return F.lit(None).cast(spark_type(t))
    if isinstance(v, tuple):
        ip = F.lit(bytearray(v[0])) if isinstance(v[0], bytes) else F.lit(v[0]).cast("bigint")
        return F.struct(ip.alias("ip"), F.lit(v[1]).alias("mask"))
    if isinstance(v, bytes):
        return F.lit(bytearray(v))
    if isinstance(v, list):
        return F.array(*[F.lit(x) for x in v]).cast(spark_type(t))
    if isinstance(v, int) and not isinstance(v, bool) and abs(v) >= 1 << 63:
        return F.lit(str(v)).cast(spark_type(t))
    return F.lit(v).cast(spark_type(t))


def to_spark(v: Any, t: T) -> Any:
    """A Python value as the data source wants it."""
    if v is None:
        return None
    if t.kind == "tup":
        return {f"_{i}": to_spark(x, y) for i, (x, y) in enumerate(zip(v, t.args))}
    if is_arr(t):
        return [to_spark(x, t.args[0]) for x in v]
    if t.kind.startswith("cidr"):
        return {"ip": v[0], "mask": v[1]} if isinstance(v, tuple) else v
    if t.kind == "float":
        return float(v)
    if isinstance(spark_type(t), S.DecimalType):
        from decimal import Decimal

        return Decimal(int(v))
    return v


def from_spark(v: Any, t: T) -> Any:
    if v is None:
        return None
    if t.kind == "tup":
        return tuple(from_spark(v[f"_{i}"] if isinstance(v, dict) else v[i], y) for i, y in enumerate(t.args))
    if is_arr(t):
        return [from_spark(x, t.args[0]) for x in v]
    if is_int(t) and not isinstance(v, bool):
        return int(v)
    if t.kind == "time" and hasattr(v, "timestamp"):
        return v.timestamp()
    return v


def udf(e: E, cs: list[Column]) -> Column:
    """The Python meaning as an Arrow-batched function (columns in, a column out)."""
    import pyarrow as pa

    types = [a.t for a in e.args]
    inner = e.at.get("inner")
    f = scalar.REGISTRY[e.op] if inner is None else None
    if f is not None and f.py is None:
        raise LanguageError(f"{e.op.upper()} is not available here")
    out = spark_type(e.t)
    node = E(e.op, [E(a.op, [], dict(a.at) if a.op == "lit" else {}, a.t) for a in e.args], dict(e.at), e.t)

    def run(packed):  # noqa: ANN001, ANN202
        from pyspark.sql.pandas.types import to_arrow_type

        rows = zip(*[c.to_pylist() for c in packed.flatten()]) if types else [()] * len(packed)
        result = []
        for row in rows:
            v = [from_spark(x, t) for x, t in zip(row, types)]
            if inner is not None:
                r = stateful.over_array(inner, v[0])
            elif not f.lazy and any(x is None for x in v):
                r = None
            else:
                r = f.py(node, *v)
            result.append(to_spark(r, node.t))
        return pa.array(result, to_arrow_type(out))

    run.__annotations__ = {"packed": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, out)(F.struct(*[c.alias(f"a{i}") for i, c in enumerate(cs or [F.lit(0)])]))


class Columns:
    """Compiles typed expressions to columns of one DataFrame."""

    def __init__(self, names: dict[str, str]) -> None:
        self.out = names  # output field -> column that holds it
        self.states: dict[int, str] = {}

    def col(self, e: E) -> Column:
        if e.op == "lit":
            return literal(e)
        if e.op == "in":
            return F.col(f"`{e.at['name']}`")
        if e.op == "out":
            return F.col(f"`{self.out[e.at['name']]}`")
        if e.op.startswith("s:"):
            return F.col(self.states[id(e)])
        cs = [self.col(a) for a in e.args]
        if e.op == "imm":
            c = stateful.over_array_col(e.at["inner"], cs[0])
            return udf(e, cs) if c is None else c
        f = scalar.REGISTRY[e.op]
        c = f.col(e, *cs) if f.col is not None else None
        return udf(e, cs) if c is None else c


def count_block(r: Resolved) -> int | None:
    """n, if the condition commits every n-th input: SUM 1 or COUNT x >= n, = n or % n = 0."""
    c = r.commit
    if c is None or r.before or not r.flush or c.op not in ("ge", "eq", "gt"):
        return None
    left, right = c.args
    mod = None
    if left.op == "mod" and c.op == "eq" and right.op == "lit" and right.at["v"] == 0:
        left, mod = left.args
        if mod.op != "lit":
            return None
    if left.op not in ("s:sum", "s:count") or right.op != "lit" or left.at["life"] != "local":
        return None
    one = left.args[0]
    if not (one.op == "lit" and (left.op == "s:count" and one.t.kind != "bool" or one.at["v"] == 1)):
        return None
    n = mod.at["v"] if mod is not None else right.at["v"] + (c.op == "gt")
    return int(n) if isinstance(n, (int, float)) and n >= 1 else None


def time_bound(r: Resolved) -> E | None:
    """The input expression of a condition ``in.t >= out.x + ...`` that closes
    windows of time, where a key is a bucket of the same time."""
    c = r.commit
    if c is None or not r.flush or c.op not in ("ge", "gt"):
        return None
    t, bound = c.args
    if not mentions(t, "in") or mentions(t, "out") or states_of(c) or mentions(bound, "in") or not mentions(bound, "out"):
        return None
    used = {x.at["name"] for x in t.walk() if x.op == "in"}
    for k in r.keys:
        bucket = any(x.op in ("idiv", "truncate", "floor") for x in k.walk())
        if bucket and used <= {x.at["name"] for x in k.walk() if x.op == "in"}:
            return t
    return None


class Engine:
    """Runs programs over registered tables.

    ``order`` of a table names the columns of its order of arrival (with a
    unique tie-break); ``flush_at_end`` also emits groups that no condition has
    committed when a batch ends, where a stream would wait for more input.  A table's
    column ``site`` tells where its rows come from; ``site`` is the engine's own.
    With ``watch`` READ FROM FILES is a stream of the files as they come.
    """

    def __init__(self, spark: SparkSession, flush_at_end: bool = True, generate: int = 100, lateness: float | None = None, site: str | None = None, watch: bool = False) -> None:
        self.spark, self.flush_at_end, self.generate, self.lateness, self.site, self.watch = spark, flush_at_end, generate, lateness, site, watch
        self.tables: dict[str, tuple[DataFrame, list[str], set[str]]] = {}
        self.plans: dict[str, str] = {}
        self.datagrams: dict[str, DataFrame] = {}
        self.topics: dict[str, DataFrame] = {}

    def listen(self, protocol: str, datagrams: DataFrame) -> Engine:
        """Where LISTEN FOR a protocol takes its payloads from: a batch or stream
        with ``payload`` (and ``sender``, ``received``) columns."""
        self.datagrams[protocol] = datagrams
        return self

    def topic(self, name: str, messages: DataFrame) -> Engine:
        """Messages (``value`` binary) that stand for a Kafka topic, for batches and tests."""
        self.topics[name] = messages
        return self

    def notifications(self, program: str, function: str, **params: Any) -> DataFrame:
        """What NOTIFY sends: (name, start, params), one for each output of the
        function; the name defaults to the function's, params are its fields."""
        p = parse(program)
        f = next((f for f in p.functions if f.name == function), None)
        if f is None or not isinstance(f.op, Aggregate) or not f.op.notify:
            raise LanguageError(f"{function} does not notify")
        named = f.op.notify[0]
        if named.op == "lit" and named.at["v"] is None:
            named = E("lit", [], {"v": function})
        taken = {x.alias for x in f.op.fields}
        column = next(n for n in ("notification", "notification_name", "notification_name_1") if n not in taken)
        f.op.fields.append(Field(named, column))
        df = self.run(p, function, **params)
        fields = [c for c in df.columns if c != column]
        pairs = [x for c in fields for x in (F.lit(c), F.to_json(F.struct(F.col(f"`{c}`").alias("v"))))]
        start = F.col("start").cast("double") if "start" in fields else F.unix_micros(F.current_timestamp()) / 1e6
        return df.select(F.col(column).alias("name"), start.alias("start"), (F.create_map(*pairs) if pairs else F.create_map()).alias("params"))

    def table(self, name: str, df: DataFrame, order: list[str] | None = None, not_null: list[str] | None = None) -> Engine:
        known = set(df.columns) if not_null == ["*"] else set(not_null or [])
        self.tables[name] = (df, order or [], known)
        return self

    def run(self, program: str | Program, function: str | None = None, **params: Any) -> Any:
        """DataFrames of all functions by name, or of one."""
        p = parse(program) if isinstance(program, str) else program
        run = Run(self, p, params)
        if p.run_if is not None and not run.constant(p.run_if):
            return {} if function is None else None
        if function is not None:
            return run.output(function)
        return {f.name: run.output(f.name) for f in p.functions if not f.lazy}

    def query(self, operation: str, **params: Any) -> DataFrame:
        """The DataFrame of one operation."""
        p = parse(f"DEFINE result AS {operation}")
        return self.run(p, "result", **params)

    def expr(self, text: str, **params: Any) -> Any:
        """The value of a stateless expression."""
        return self.query(f"YIELD {text} AS value", **params).limit(1).collect()[0][0]


class Run:
    def __init__(self, engine: Engine, program: Program, params: dict[str, Any]) -> None:
        self.engine, self.program = engine, program
        self.functions = {f.name: f for f in program.functions}
        self.done: dict[tuple, DataFrame] = {}
        self.nullable: dict[str, set[str]] = {}
        self.params: dict[str, tuple[Any, T | None]] = {}
        unknown = set(params) - set(program.params)
        if unknown and program.params:
            raise LanguageError(f"unknown parameters: {', '.join(sorted(unknown))}")
        for n, p in program.params.items():
            v = params[n] if n in params else self.constant(p.default) if p.default is not None else None
            self.params[n] = (v, p.t)
        self.params |= {n: (v, None) for n, v in params.items() if n not in self.params}

    def constant(self, e: E) -> Any:
        x = Resolver(Aggregate([]), {}, self.params).typed(e, "select", True)
        return Clause(x).eval(Ctx({}))

    def output(self, name: str) -> DataFrame:
        df = self.function(name, False)
        return df.drop(ORD) if ORD in df.columns else df

    # -- sources
    def function(self, name: str, ordered: bool, chain: tuple[str, ...] = ()) -> DataFrame:
        name = name if name in self.functions or name in self.engine.tables else name.rsplit("/", 1)[-1]
        if name in chain:
            raise LanguageError(f"a batch cannot run a cycle: {' -> '.join((*chain, name))}")
        if name in self.functions:
            key = (name, ordered)
            if key not in self.done:
                self.done[key] = self.operation(self.functions[name], ordered, (*chain, name))
            return self.done[key]
        if name not in self.engine.tables:
            raise LanguageError(f"unknown function or table: {name}")
        df, order, known = self.engine.tables[name]
        self.nullable[name] = known
        if ordered:
            if not order:
                raise LanguageError(f"the order of arrival of {name} is needed: register it with order=[...]")
            df = df.withColumn(ORD, F.struct(*[F.col(c) for c in order]))
        return df

    def operation(self, f: Function, ordered: bool, chain: tuple[str, ...]) -> DataFrame:
        op = f.op
        if isinstance(op, Read):
            from tidegauge.sources.external import read

            return read(self.engine.spark, op, self, self.engine.watch)
        if isinstance(op, Listen):
            from tidegauge.sources.protocols import DECODERS, decoded

            if op.protocol not in DECODERS:
                raise LanguageError(f"unknown protocol: {op.protocol}")
            if op.protocol not in self.engine.datagrams:
                raise LanguageError(f"LISTEN FOR {op.protocol.upper()}: name its datagrams with Engine.listen")
            return decoded(self.engine.datagrams[op.protocol], op.protocol)
        return self.aggregate(op, ordered, chain, f.name)

    def parents(self, op: Aggregate, ordered: bool, chain: tuple[str, ...]) -> tuple[DataFrame, set[str]]:
        if not op.parents:
            df = self.engine.spark.range(self.engine.generate if op.every is not None else 1)
            every = float(self.constant(op.every)) if op.every is not None else 0.0
            df = df.withColumn(ORD, F.struct("id")).withColumn("__tick", F.col("id") * F.lit(every)).drop("id")
            return df, set()
        dfs, known = [], None
        for n, p in enumerate(op.parents):
            if isinstance(p, str):
                dfs.append(self.at_site(self.function(str(p), ordered, chain), p))
                k = self.nullable.get(p, set())
            else:
                dfs.append(self.operation(Function(f"_{n}", p), ordered, chain))
                k = set()
            known = k if known is None else known & k
        if len(dfs) == 1:
            return dfs[0], known
        names = [set(d.columns) for d in dfs]
        common = [c for c in dfs[0].columns if all(c in n for n in names) and c != ORD]
        if ordered:
            kinds = {d.schema[ORD].dataType.simpleString() for d in dfs}
            if len(kinds) > 1:
                dfs = [d.withColumn(ORD, F.struct(F.to_json(ORD).alias("j"))) for d in dfs]
            common.append(ORD)
        df = dfs[0].select(*common)
        for d in dfs[1:]:
            df = df.unionByName(d.select(*common))
        return df, known

    def at_site(self, df: DataFrame, p: str) -> DataFrame:
        """ON SITE: the rows of a parent whose site fits."""
        if not isinstance(p, Sited):
            return df
        if "site" not in df.columns:
            raise LanguageError(f"{p} ON SITE: {p} has no column site")
        if p.site:
            return df.filter(F.col("site").rlike(f"^{fnmatch.translate(p.site)}$"))
        if self.engine.site is None:
            raise LanguageError("ON THIS SITE: name the site with Engine(site=...)")
        return df.filter(F.col("site") == self.engine.site)

    # -- plans
    def aggregate(self, op: Aggregate, ordered: bool, chain: tuple[str, ...], name: str) -> DataFrame:
        df, known = self.parents(op, False, chain)
        inputs = {c.name: of_spark(c).nullable(c.name not in known) for c in df.schema if c.name not in (ORD, "__tick")}
        r = Resolver(op, inputs, self.params, self.program.globals).run()
        kind = self.kind(op, r)
        self.engine.plans[name] = kind
        if df.isStreaming and kind in ("running", "blocks", "chained"):
            kind = self.engine.plans[name] = "machine"
        needs = ordered or kind in ("running", "machine", "blocks", "chained") or kind == "grouped" and self.picks(r)
        if needs and op.parents:
            df, _ = self.parents(op, True, chain)
        if not needs and ORD in df.columns:
            df = df.drop(ORD)
        result = {"map": self.map, "running": self.running, "grouped": self.grouped, "blocks": self.blocks, "chained": self.chained, "machine": self.machine}[kind](r, df, needs)
        return self.finish(r, result, ordered)

    def kind(self, op: Aggregate, r: Resolved) -> str:
        states = [s for e in [*(e for _, e in r.fields), r.where, r.commit] for s in states_of(e)]
        select = [s for _, e in r.fields for s in states_of(e)]
        exprs = [e for e in [*(e for _, e in r.fields), r.where, r.commit] if e is not None]
        if not r.sort and (chained.lagged(r) or chained.changing(r) or chained.islands(r) and all(self.aggregated(s, r) for s in select)):
            return "chained"
        recursive = any(mentions(e, "previous", "global_last", "global", "mapadd") for e in exprs)
        trivial = r.commit is None or r.commit.op == "lit" and r.commit.at["v"] is True
        if recursive or r.sort or mentions(r.where, *[s.op for s in states if s.op == "s:top"]) and states:
            return "machine"
        if trivial and not r.before and not states:
            return "map"
        windows = all(stateful.REGISTRY[s.op].window is not None and self.windowed(s) for s in states)
        kept = all(s.at["life"] == "global" or not r.flush for s in states)
        if trivial and not r.before and windows and kept:
            return "running"
        aggs = all(self.aggregated(s, r) for s in select)
        if not trivial and aggs and not states_of(r.where) and all(s.at["life"] == "local" for s in select):
            if r.keys and time_bound(r) is not None:
                return "grouped"
            if count_block(r) is not None and not states_of(r.where):
                return "blocks"
        return "machine"

    @staticmethod
    def windowed(s: E) -> bool:
        if s.op == "s:every":
            return bool(s.at.get("tumbling"))
        if s.op == "s:largest":
            return len(s.args) == 3 and not s.at.get("down")
        return s.op != "s:recall"

    @staticmethod
    def aggregated(s: E, r: Resolved) -> bool:
        inner = [x for a in s.args for x in states_of(a)]
        if s.op == "s:distinct":
            return True
        if stateful.REGISTRY[s.op].agg is None:
            return False
        return all(x.op == "s:distinct" for x in inner) and not any(mentions(a, "out") and any(states_of(dict(r.fields)[o.at["name"]]) for o in a.walk() if o.op == "out") for a in s.args)

    @staticmethod
    def picks(r: Resolved) -> bool:
        """Whether an aggregate of the operation depends on the order of arrival."""
        keys = {k.key() for k in r.keys}
        for _, e in r.fields:
            if any(s.op in ("s:first", "s:last", "s:group", "s:largest", "s:sample", "s:distinct") and not counted(e, s) for s in states_of(e)):
                return True
            if rests(e, keys, r):
                return True
        return False

    def map(self, r: Resolved, df: DataFrame, ordered: bool) -> DataFrame:
        cs = Columns({})
        if r.where is not None:
            df = df.filter(cs.col(r.where))
        return self.project(r, df, cs)

    def project(self, r: Resolved, df: DataFrame, cs: Columns) -> DataFrame:
        """The fields in order, each under a hidden name until all are there."""
        for n, e in r.fields:
            df, c = self.split(df, e, cs)
            df = df.withColumn(f"__f_{n}", c)
            cs.out[n] = f"__f_{n}"
        return df

    def split(self, df: DataFrame, e: E, cs: Columns) -> tuple[DataFrame, Column]:
        """SPLIT anywhere in an expression makes a row of each part."""
        for k, s in enumerate(x for x in e.walk() if x.op == "split"):
            name = f"__g{len(df.columns)}_{k}"
            sep, text = (cs.col(a) for a in s.args)
            parts = F.split(text, F.lit(_quote(s.args[0].at["v"])) if s.args[0].op == "lit" else F.concat(F.lit("\\Q"), sep, F.lit("\\E")))
            df = df.withColumn(name, F.explode(parts))
            s.op, s.args, s.at = "in", [], {"name": name}
        return df, cs.col(e)

    def running(self, r: Resolved, df: DataFrame, ordered: bool) -> DataFrame:
        cs = Columns({})
        keys = [cs.col(k) for k in r.keys]
        if r.where is not None:
            df = self.window_states(r.where, df, cs, keys)
            df = df.filter(cs.col(r.where))
        return self.waves(r, df, cs, keys)

    def waves(self, r: Resolved, df: DataFrame, cs: Columns, keys: list[Column]) -> DataFrame:
        """Fields and states as soon as what they need is there, all that are ready
        at once: one window operator a wave instead of one a function."""
        fields, states = list(r.fields), [s for _, e in r.fields for s in states_of(e)]
        while fields:
            ready = [(n, e) for n, e in fields if self.ready(e, cs)]
            if ready:
                df = df.withColumns({f"__f_{n}": cs.col(e) for n, e in ready})
                cs.out |= {n: f"__f_{n}" for n, _ in ready}
                fields = [f for f in fields if f[0] not in cs.out]
                continue
            now = [s for s in states if id(s) not in cs.states and all(self.ready(a, cs) for a in s.args)]
            columns = {}
            for s in now:
                w = Win(keys if s.at["life"] == "local" else [], [F.col(ORD)])
                columns[f"__s{len(cs.states) + len(columns)}"] = stateful.REGISTRY[s.op].window(s, w, *[cs.col(a) for a in s.args])
            cs.states |= dict(zip(map(id, now), columns))
            df = df.withColumns(columns)
        return df

    @staticmethod
    def ready(e: E, cs: Columns) -> bool:
        """Whether every field and state of the expression has a column."""
        if e.op.startswith("s:"):
            return id(e) in cs.states
        if e.op == "out":
            return e.at["name"] in cs.out
        return all(Run.ready(a, cs) for a in e.args)

    def window_states(self, e: E, df: DataFrame, cs: Columns, keys: list[Column]) -> DataFrame:
        for s in states_of(e):
            w = Win(keys if s.at["life"] == "local" else [], [F.col(ORD)])
            name = f"__s{len(cs.states)}"
            df = df.withColumn(name, stateful.REGISTRY[s.op].window(s, w, *[cs.col(a) for a in s.args]))
            cs.states[id(s)] = name
        return df

    def grouped(self, r: Resolved, df: DataFrame, ordered: bool) -> DataFrame:
        cs = Columns({})
        if r.where is not None:
            df = df.filter(cs.col(r.where))
        closing = None
        if df.isStreaming:
            from tidegauge.streaming.windows import watermarked

            df, extra = watermarked(r, df, cs, self.engine.lateness)
            return self.fold(r, df, cs, [cs.col(k) for k in r.keys], ordered, extra)
        if not self.engine.flush_at_end:
            t = time_bound(r)
            closing = df.agg(F.max(cs.col(t)).alias("m")).collect()[0].m
        out = self.fold(r, df, cs, [cs.col(k) for k in r.keys], ordered)
        if closing is not None:
            # What the last input would still have closed.
            t, bound = r.commit.args
            c = Columns(dict(cs.out))
            out = out.filter(scalar.REGISTRY[r.commit.op].col(r.commit, F.lit(closing), c.col(bound)))
        return out

    def fold(self, r: Resolved, df: DataFrame, cs: Columns, keys: list[Column], ordered: bool, extra: list[Column] | None = None) -> DataFrame:
        """One row per group: partial aggregates of every state, then the fields."""
        names = [f"__k{i}" for i in range(len(keys))]
        df = df.withColumns(dict(zip(names, keys))) if keys else df
        by_key = {k.key(): n for k, n in zip(r.keys, names)}
        order = F.col(ORD) if ORD in df.columns else F.lit(0)
        pre = Columns({})
        aggs: list[Column] = []
        plans: list[tuple[str, E]] = []
        inputs = {}
        for n, e in r.fields:
            # Fields without state may feed states of later fields.
            if not states_of(e) and not any(x.op == "out" and x.at["name"] not in pre.out for x in e.walk()):
                df = df.withColumn(f"__p_{n}", pre.col(e))
                pre.out[n] = f"__p_{n}"
            plans.append((n, e))
        for n, e in plans:
            for s in states_of(e):
                if s.op == "s:distinct":
                    if counts_distinct(e, s):
                        continue
                    name = f"__d{len(cs.states)}"
                    w = Win([F.col(k) for k in names], [order])
                    df = df.withColumn(name, stateful.REGISTRY[s.op].window(s, w, pre.col(s.args[0])))
                    pre.states[id(s)] = cs.states[id(s)] = name
                    if s is e:
                        aggs.append(F.max_by(F.col(name), order).alias(name))
                    continue
                name = f"__s{len(cs.states)}"
                if s.op == "s:count" and s.args[0].op == "s:distinct":
                    c = F.count_distinct(pre.col(s.args[0].args[0]))
                elif s.op == "s:group" and ranked(e, s):
                    c = F.collect_list(pre.col(s.args[0]))
                else:
                    c = stateful.REGISTRY[s.op].agg(s, order, *[pre.col(a) for a in s.args])
                aggs.append(c.alias(name))
                cs.states[id(s)] = name
            for x in bare(e):
                name = by_key.get(x.key())
                if name is None and x.op in ("in", "out"):
                    src = pre.col(x) if x.op == "in" else None
                    if x.op == "out":
                        continue
                    name = inputs.get(x.at["name"])
                    if name is None:
                        name = inputs[x.at["name"]] = f"__i{len(inputs)}"
                        aggs.append(F.max_by(src, order).alias(name))
        if ordered and ORD in df.columns:
            aggs.append(F.max(ORD).alias(ORD))
        by = [*names, *(extra or [])]
        out = df.groupBy(*by).agg(*aggs) if aggs else df.select(*by).distinct()

        def final(e: E) -> E:
            if e.key() in by_key:
                return E("in", [], {"name": by_key[e.key()]}, e.t)
            if e.op == "in":
                return E("in", [], {"name": inputs[e.at["name"]]}, e.t)
            if e.op.startswith("s:"):
                return e
            return E(e.op, [final(a) for a in e.args], e.at, e.t)

        for n, e in plans:
            out = out.withColumn(f"__f_{n}", cs.col(final(e)))
            cs.out[n] = f"__f_{n}"
        return out

    def blocks(self, r: Resolved, df: DataFrame, ordered: bool) -> DataFrame:
        """Every n inputs of a key; an incomplete last block is not committed."""
        cs = Columns({})
        n = count_block(r)
        if r.where is not None:
            df = df.filter(cs.col(r.where))
        keys = [cs.col(k) for k in r.keys]
        w = Win(keys, [F.col(ORD)])
        df = df.withColumn("__block", F.floor((F.row_number().over(w.ordered) - 1) / n))
        size = F.count(F.lit(1)).over(w.by(F.col("__block")))
        # A block is committed by its n-th input, whether or not the batch flushes at its end.
        df = df.withColumn("__size", size).filter(F.col("__size") == n)
        blocked = Resolved(r.fields, None, [*r.keys, E("in", [], {"name": "__block"}, T("i64"))], None, False, True, None, [], r.start, r.factors, r.docs)
        return self.fold(blocked, df, cs, [*keys, F.col("__block")], ordered)

    def chained(self, r: Resolved, df: DataFrame, ordered: bool) -> DataFrame:
        """What looks one input back: see ``plans.chained``."""
        cs = Columns({})
        changed, run = chained.changing(r), chained.islands(r)
        exprs = [*(e for _, e in r.fields), *([r.where] if r.where is not None else []), *r.keys, *([run] if run is not None else [])]
        used = sorted({x.at["name"] for e in exprs for x in e.walk() if x.op == "in"})
        if r.where is not None and not states_of(r.where):
            df = df.filter(cs.col(r.where))
        rows = df.select(*[F.col(f"`{c}`") for c in used], ORD)
        if changed is not None and r.keys:
            rows = self.project(r, rows, cs)
            w = Win([cs.col(k) for k in r.keys], [F.col(ORD)])
            return self.differing(rows, F.lag(cs.out[changed]).over(w.ordered), cs.out[changed])
        cut = chained.blocks(rows, ORD)
        if cut is None:
            if changed is not None or run is not None:
                return self.machine(r, rows, ordered)
            return self.running(r, rows, ordered)
        if changed is not None:
            cut = self.project(r, cut, cs)
            cut = chained.before(cut, ORD, F.col(cs.out[changed]), "__before")
            return self.differing(cut, F.col("__before"), cs.out[changed])
        if run is not None:
            x = cs.col(run)
            cut = chained.before(cut, ORD, x, "__before")
            cut, most = chained.numbered(cut, ORD, F.coalesce(x != F.col("__before"), F.lit(False)), "__island")
            # The last run is open: no input has ended it.
            key = E("in", [], {"name": "__island"}, T("i64"))
            whole = Resolved(r.fields, None, [key], None, False, True, None, [], r.start, r.factors, r.docs)
            return self.fold(whole, cut.filter(F.col("__island") < most), cs, [F.col("__island")], ordered)
        for s in [s for e in [r.where, *(e for _, e in r.fields)] for s in states_of(e)]:
            name = f"__s{len(cs.states)}"
            cut = chained.before(cut, ORD, cs.col(s.args[1]), name)
            cs.states[id(s)] = name
        if r.where is not None:
            cut = cut.filter(cs.col(r.where))
        return self.project(r, cut, cs)

    @staticmethod
    def differing(rows: DataFrame, before: Column, now: str) -> DataFrame:
        """Rows whose value is not the one before, or not known to be."""
        return rows.withColumn("__same", before == F.col(now)).filter(~F.coalesce("__same", F.lit(False))).drop("__same", "__before")

    def machine(self, r: Resolved, df: DataFrame, ordered: bool) -> DataFrame:
        """The commit machine over rows sorted by arrival within each key."""
        if df.isStreaming:
            from tidegauge.streaming.commits import commit_stream

            return commit_stream(r, df, ordered)
        split = [(n, e) for n, e in r.fields if any(x.op == "split" for x in e.walk())]
        if split:
            raise LanguageError("SPLIT needs an operation of its own before recursive or grouped ones")
        exprs = [*(e for _, e in r.fields), *([r.where] if r.where else []), *([r.commit] if r.commit else [])]
        states = [s for e in exprs for s in states_of(e)]
        spans = not r.keys or any(s.at["life"] == "global" for s in states) or any(mentions(e, "global_last", "global") for e in exprs) or mentions(r.commit, "in") or r.sort is not None
        used = sorted({x.at["name"] for e in [*exprs, *r.keys, *((r.sort[2] + ([r.sort[1]] if r.sort[1] is not None else [])) if r.sort else [])] for x in e.walk() if x.op in ("in", "sorted")})
        types = {n: of_spark(df.schema[n]) for n in used}
        ord_type = df.schema[ORD].dataType
        schema = S.StructType([S.StructField(f"__f_{n}", spark_type(e.t)) for n, e in r.fields] + [S.StructField(ORD, ord_type)])
        if spans:
            rows = df.select(*[f"`{c}`" for c in used], ORD).repartition(1).sortWithinPartitions(ORD)
        else:
            cs = Columns({})
            names = [f"__k{i}" for i in range(len(r.keys))]
            rows = df.withColumns(dict(zip(names, [cs.col(k) for k in r.keys]))).repartition(*names).sortWithinPartitions(*names, ORD).select(*[f"`{c}`" for c in used], ORD, *names)
        at_end = self.engine.flush_at_end and r.commit is not None and not (r.commit.op == "lit") and r.flush and time_bound(r) is not None
        out_types = [(n, e.t) for n, e in r.fields]
        keyed = not spans

        def run(batches: Iterator[Any]) -> Iterator[Any]:
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            m = Machine(r)
            kinds = [to_arrow_type(f.dataType) for f in schema.fields]
            key: Any = None

            def read() -> Iterator[dict]:
                for batch in batches:
                    lists = {c: [from_spark(v, types[c]) for v in batch[c].to_pylist()] for c in used}
                    orders = batch[ORD].to_pylist()
                    keys = list(zip(*[batch[c].to_pylist() for c in batch.schema.names if c.startswith("__k")])) if keyed else [None] * batch.num_rows
                    for i in range(batch.num_rows):
                        row = {c: lists[c][i] for c in used}
                        row[ORD] = orders[i]
                        row["__key"] = keys[i]
                        yield row

            stream = sorting(read(), *r.sort) if r.sort else read()
            buffer: list[list] = []

            def record(out: dict, order: Any) -> None:
                buffer.append([*(to_spark(out[n], t) for n, t in out_types), order])

            def batch_of() -> Any:
                columns = [pa.array([b[i] for b in buffer], k) for i, k in enumerate(kinds)]
                buffer.clear()
                return pa.RecordBatch.from_arrays(columns, schema.names)

            last: Any = None
            for row in stream:
                if keyed and not same(row["__key"], key):
                    # Keys come one after the other: a key that is over leaves no state behind.
                    if at_end:
                        for out in m.rest():
                            record(out, last)
                    m.groups.clear()
                    m.last.clear()
                    key = row["__key"]
                last = row[ORD]
                for out in m.step(row):
                    record(out, last)
                if len(buffer) >= 5000:
                    yield batch_of()
            if at_end:
                for out in m.rest():
                    record(out, last)
            if buffer:
                yield batch_of()

        return rows.mapInArrow(run, schema)

    def finish(self, r: Resolved, df: DataFrame, ordered: bool) -> DataFrame:
        """Public fields under their names, with type, units and doc in the metadata."""
        columns = []
        for n, e in r.fields:
            if n.startswith("_"):
                continue
            meta = {"lang_type": str(e.t)} if e.t.kind not in ("opaque", "time", "void", "map") else {}
            if n in r.factors:
                meta["factor"] = True
            columns.append(F.col(f"`__f_{n}`").alias(n, metadata=meta | r.docs.get(n, {})))
        if ordered and ORD in df.columns:
            columns.append(F.col(ORD))
        return df.select(*columns)


def same(a: Any, b: Any) -> bool:
    if a is None or b is None:
        return a is b
    return len(a) == len(b) and all(x == y or x is y or x != x and y != y for x, y in zip(a, b))


def bare(e: E) -> Iterator[E]:
    """Nodes of an expression outside of its states, operators before operands
    (a whole key expression comes before its parts)."""
    if e.op.startswith("s:"):
        return
    yield e
    for a in e.args:
        yield from bare(a)


def rests(e: E, keys: set[str], r: Resolved) -> bool:
    """Whether the expression needs the last input of a group."""
    if e.key() in keys or e.op.startswith("s:"):
        return False
    if e.op == "in":
        return True
    return any(rests(a, keys, r) for a in e.args)


def counted(e: E, s: E) -> bool:
    return counts_distinct(e, s) or s.op == "s:group" and ranked(e, s)


def ranked(e: E, s: E) -> bool:
    """GROUP x of which only percentiles are taken: its order does not matter."""
    users = [x for x in e.walk() if any(a is s for a in x.args)]
    return bool(users) and all(u.op == "percentile" and u.args[1] is s for u in users) and s.at.get("nulls") != "keep"


def counts_distinct(e: E, d: E) -> bool:
    """COUNT DISTINCT x, which a plain aggregate does."""
    return any(x.op == "s:count" and x.args[0] is d for x in e.walk())


def _quote(s: str) -> str:
    import re

    return re.escape(s)
