"""The commit machine: filter, group, update, commit, flush, one input at a time.

Used where no window or aggregate expresses an operation: conditions on earlier
output, commits that one group's input triggers in others, recursive fields,
and series functions without a closed form.  It holds one ``Group`` per key; a
flushed group is dropped.

Semantics per input: the pure filter, the key, the stateful filter (a group is
only kept once an input passes), the update of every field in order, the commit
condition.  AFTER emits the group with this input, BEFORE the group as it was
without it (nothing if it was the first), and the input then starts the group
anew.  A condition that mentions the input is also tried on all other groups.
"""

from __future__ import annotations

import pickle
from bisect import insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from tidegauge.functions import scalar, stateful
from tidegauge.functions.stateful import hashable
from tidegauge.lang.tree import E
from tidegauge.plans.resolve import Resolved, mentions, states_of


@dataclass
class Ctx:
    """What an expression may look at."""

    row: dict
    out: dict = field(default_factory=dict)
    previous: dict | None = None
    global_last: dict | None = None
    sorted: dict = field(default_factory=dict)
    states: dict = field(default_factory=dict)
    globals: dict = field(default_factory=dict)


@dataclass
class Group:
    states: dict = field(default_factory=dict)
    out: dict | None = None
    before: dict | None = None


def compiled(e: E) -> Callable[[Ctx], Any]:
    """A closure of the expression."""
    op = e.op
    if op == "lit":
        v = e.at["v"]
        return lambda c: v
    if op in ("in", "out"):
        n = e.at["name"]
        return (lambda c: c.row[n]) if op == "in" else (lambda c: c.out[n])
    if op == "previous":
        n = e.at["name"]
        return lambda c: c.previous[n] if c.previous is not None else None
    if op == "global_last":
        n = e.at["name"]
        return lambda c: c.global_last[n] if c.global_last is not None else None
    if op == "sorted":
        n, which = e.at["name"], e.at["which"]
        return lambda c: c.sorted[which][n]
    if op == "global":
        n = e.at["name"]
        return lambda c: c.globals.setdefault(n, {})
    if op.startswith("s:"):
        k = e.at["number"]
        return lambda c: c.states[k].result()
    args = [compiled(a) for a in e.args]
    if op == "imm":
        inner, a = e.at["inner"], args[0]
        return lambda c: stateful.over_array(inner, a(c))
    if op == "random":
        import random

        return lambda c: random.random()
    if op == "mapadd":

        def add(c: Ctx) -> Any:
            m, k, v = (a(c) for a in args)
            m[k] = v
            return v

        return add
    f = scalar.REGISTRY[op]
    py = f.py
    if f.lazy:
        return lambda c: py(e, *[a(c) for a in args])
    if len(args) == 1:
        a = args[0]
        return lambda c: None if (v := a(c)) is None else py(e, v)

    def strict(c: Ctx) -> Any:
        v = [a(c) for a in args]
        return None if None in v and any(x is None for x in v) else py(e, *v)

    return strict


class Clause:
    """An expression with its states in order of evaluation."""

    def __init__(self, e: E) -> None:
        self.e = e
        self.nodes = states_of(e)
        self.args = [[compiled(a) for a in n.args] for n in self.nodes]
        self.eval = compiled(e)

    def update(self, c: Ctx, local: dict, everywhere: dict) -> Any:
        for n, args in zip(self.nodes, self.args):
            home = local if n.at["life"] == "local" else everywhere
            k = n.at["number"]
            s = home.get(k)
            if s is None:
                s = home[k] = stateful.REGISTRY[n.op].state(n)
            c.states[k] = s
            s.update([a(c) for a in args])
        return self.eval(c)


class Machine:
    def __init__(self, r: Resolved) -> None:
        self.r = r
        self.fields = [(n, Clause(e)) for n, e in r.fields]
        self.where = Clause(r.where) if r.where is not None else None
        self.keys = [compiled(k) for k in r.keys]
        self.commit = Clause(r.commit) if r.commit is not None else None
        self.cross = r.commit is not None and mentions(r.commit, "in")
        self.groups: dict[Any, Group] = {}
        self.everywhere: dict = {}
        self.last: dict[Any, dict] = {}
        self.global_last: dict | None = None
        self.globals: dict = {}
        scopes = [x for e in [*(e for _, e in r.fields), r.where, r.commit] if e is not None for x in e.walk()]
        self.remembers = any(x.op == "previous" for x in scopes)

    def context(self, row: dict, key: Any) -> Ctx:
        return Ctx(row, {}, self.last.get(key) if self.remembers else None, self.global_last, globals=self.globals)

    def compute(self, g: Group, c: Ctx) -> dict:
        c.out = {}
        for n, f in self.fields:
            c.out[n] = f.update(c, g.states, self.everywhere)
        return c.out

    def emit(self, key: Any, out: dict) -> dict:
        if self.remembers:
            self.last[key] = out
        self.global_last = out
        return out

    def step(self, row: dict) -> Iterator[dict]:
        c = Ctx(row, globals=self.globals)
        stateful_where = self.where is not None and bool(self.where.nodes or mentions(self.where.e, "previous", "global_last"))
        if self.where is not None and not stateful_where and self.where.eval(c) is not True:
            return
        key = tuple(hashable(k(c)) for k in self.keys)
        g = self.groups.get(key)
        fresh = g is None
        if fresh:
            g = Group()
        c = self.context(row, key)
        if stateful_where and self.where.update(c, g.states, self.everywhere) is not True:
            # What the filter itself remembers of a key must outlive its rejections.
            if not fresh or any(n.at["life"] == "local" for n in self.where.nodes):
                self.groups[key] = g
            return
        self.groups[key] = g
        g.before = g.out
        out = g.out = self.compute(g, c)
        fires = self.commit is None or self.commit.update(c, g.states, self.everywhere) is True
        if fires:
            shown = g.before if self.r.before else out
            if shown is not None:
                yield self.emit(key, shown)
            if self.r.flush:
                if self.r.before:
                    g.states, g.before = {}, None
                    c = self.context(row, key)
                    g.out = self.compute(g, c)
                    if self.commit is not None:
                        self.commit.update(c, g.states, self.everywhere)
                else:
                    del self.groups[key]
        if self.cross:
            for k in list(self.groups):
                if k == key:
                    continue
                o = self.groups[k]
                if o.out is None:
                    continue
                x = self.context(row, k)
                x.out = o.out
                x.states = {**o.states, **self.everywhere}
                try:
                    due = self.commit.eval(x) is True
                except KeyError:
                    due = False
                if due:
                    yield self.emit(k, o.out)
                    if self.r.flush:
                        del self.groups[k]

    def dump(self) -> bytes:
        """What must be kept between micro-batches."""
        return pickle.dumps((self.groups, self.everywhere, self.last, self.global_last, self.globals))

    def load(self, data: bytes) -> Machine:
        self.groups, self.everywhere, self.last, self.global_last, self.globals = pickle.loads(data)
        return self

    def rest(self) -> Iterator[dict]:
        """Groups that were never committed, for batches that flush at their end."""
        for g in list(self.groups.values()):
            if g.out is not None:
                yield g.out
        self.groups.clear()


class SortBuffer:
    """The last n rows, in order: gives out the smallest once full, or while UNTIL
    holds; what is left at the end stays in it."""

    def __init__(self, n: int, until: E | None, by: list[E]) -> None:
        self.n = n
        self.keys = [compiled(b) for b in by]
        self.stop = compiled(until) if until is not None else None
        self.rows: list[tuple] = []
        self.count = 0

    def full(self, row: dict) -> bool:
        if len(self.rows) >= self.n or not self.rows or self.stop is None:
            return len(self.rows) >= self.n
        ends = {"sort_first": min(self.rows, key=lambda x: x[1])[2], "sort_smallest": self.rows[0][2], "sort_greatest": self.rows[-1][2]}
        return self.stop(Ctx(row, sorted=ends)) is True

    def push(self, row: dict) -> Iterator[dict]:
        self.count += 1
        insort(self.rows, (tuple(k(Ctx(row)) for k in self.keys), self.count, row), key=lambda x: x[:2])
        while self.full(row):
            yield self.rows.pop(0)[2]

    def dump(self) -> tuple:
        return self.rows, self.count

    def load(self, kept: tuple) -> None:
        self.rows, self.count = kept


def sorting(rows: Iterator[dict], n: int, until: E | None, by: list[E]) -> Iterator[dict]:
    buffer = SortBuffer(n, until, by)
    for row in rows:
        yield from buffer.push(row)
