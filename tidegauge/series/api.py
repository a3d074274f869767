"""Clients' requests answered by DataFrames: tables, columns, time series,
Graphite's find and render.  Transport is left to whatever serves them."""

from __future__ import annotations

import fnmatch
import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import __version__
from tidegauge.series.alert import alert
from tidegauge.series.resample import possible_values, resample

MAX_SERIES = 1000


def _matches(value: Column, pattern: str) -> Column:
    """Whether a string is matched by a glob."""
    if not re.search(r"[*?\[]", pattern):
        return value == pattern
    body = fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
    return value.rlike(f"(?s)^(?:{body})\\z")


class Api:
    """``tables`` maps a name to (DataFrame, factors); each has a field ``start``."""

    def __init__(self, tables: dict[str, tuple[DataFrame, list[str]]]) -> None:
        self.tables = tables
        self.alerts: dict[str, list[dict]] = {}
        self.changes: dict[str, list[DataFrame]] = {}

    # JSON-RPC methods
    def version(self) -> str:
        return __version__

    def get_tables(self, prefix: str = "") -> dict[str, str]:
        return {n: "" for n in sorted(self.tables) if n.startswith(prefix)}

    def get_columns(self, tables: list[str]) -> dict[str, dict[str, Any]]:
        out = {}
        for n in tables:
            df, factors = self.tables[n]
            out[n] = {
                f.name: {"type": f.dataType.simpleString(), "units": (f.metadata or {}).get("units"), "doc": (f.metadata or {}).get("doc", ""), "factor": f.name in factors}
                for f in df.schema
            }
        return out

    def get_timeseries(self, table: str, since: float, until: float, num_points: int, select: list[str], consolidation: str = "avg", factors: list[str] | None = None, where: list[dict] | None = None) -> DataFrame:
        from tidegauge.series.resample import simple_filter

        df, _ = self.tables[table]
        df = df.filter(simple_filter(where or []))
        stop = "stop" if "stop" in df.columns else None
        return resample(df, since, until, num_points, {c: consolidation for c in select}, factors, stop=stop)

    def set_alerts(self, alerts: dict[str, list[dict]]) -> None:
        """Specs of a table's alerts; ``changes`` has the notifications of each."""
        for t, specs in alerts.items():
            if t not in self.tables:
                raise KeyError(t)
            self.changes[t] = [alert(self.tables[t][0], s) for s in specs]
            self.alerts[t] = specs

    def call(self, request: str) -> str:
        """One JSON-RPC request; a DataFrame answer goes out as rows, at most ``MAX_SERIES`` series."""
        q = json.loads(request)
        methods = {"version": self.version, "get-tables": self.get_tables, "get-columns": self.get_columns, "get-timeseries": self.get_timeseries, "set-alerts": self.set_alerts}
        try:
            p = q.get("params", {})
            r = methods[q["method"]](**p) if isinstance(p, dict) else methods[q["method"]](*p)
            if isinstance(r, DataFrame):
                points = int(p["num_points"])
                rows = r.limit(points * MAX_SERIES + 1).collect()
                if len(rows) > points * MAX_SERIES:
                    raise ValueError("too many series: name fewer factors")
                r = [x.asDict() for x in rows]
            return json.dumps({"id": q.get("id"), "result": r})
        except Exception as e:  # noqa: BLE001
            return json.dumps({"id": q.get("id"), "error": f"{type(e).__name__}: {e}"})

    # Graphite
    def find(self, query: str) -> list[dict[str, Any]]:
        """Nodes under a glob: table . factor values . numeric field.

        An error if more than ``MAX_SERIES`` values of a factor match under a node."""
        parts = query.split(".")
        level = [("", n, False) for n in self.tables]
        out: list[tuple[str, str, bool]] = []
        for depth, pattern in enumerate(parts):
            out = [(p, n, leaf) for p, n, leaf in level if fnmatch.fnmatchcase(n, pattern)]
            if depth + 1 < len(parts):
                level = [(f"{p}.{n}" if p else n, c, leaf) for p, n, _ in out for c, leaf in self.children(f"{p}.{n}" if p else n, parts[depth + 1])]
        return [{"text": n, "id": f"{p}.{n}" if p else n, "leaf": leaf, "expandable": not leaf, "allowChildren": not leaf} for p, n, leaf in out]

    def children(self, path: str, pattern: str = "*") -> list[tuple[str, bool]]:
        name, *given = path.split(".")
        df, factors = self.tables[name]
        if len(given) < len(factors):
            for f, v in zip(factors, given):
                df = df.filter(F.col(f).cast("string") == v)
            factor = factors[len(given)]
            named = df.select(F.coalesce(F.col(factor).cast("string"), F.lit("None")).alias(factor))
            values = possible_values(named.filter(_matches(F.col(factor), pattern)), factor).limit(MAX_SERIES + 1).collect()
            if len(values) > MAX_SERIES:
                raise ValueError(f"more than {MAX_SERIES} values of {factor}: name them more closely")
            return [(r[0], False) for r in values]
        if len(given) > len(factors):
            return []
        return [(f.name, True) for f in df.schema if f.dataType.simpleString() in ("double", "bigint", "int", "float") and f.name not in (*factors, "start", "stop")]

    def render(self, target: str, since: float, until: float, max_points: int = 300) -> DataFrame:
        """Series (target, t, value) for a path whose parts may be globs."""
        name, *rest = target.split(".")
        df, factors = self.tables[name]
        field = rest[len(factors)]
        for f, pattern in zip(factors, rest):
            df = df.filter(_matches(F.col(f).cast("string"), pattern))
        r = resample(df, since, until, max_points, {field: "avg"}, factors, stop="stop" if "stop" in df.columns else None)
        label = F.concat_ws(".", F.lit(name), *[F.col(f).cast("string") for f in factors], F.lit(field))
        return r.select(label.alias("target"), "t", F.col(field).alias("value"))
