"""Stateful functions: result type, state machine, and Spark forms where they exist.

``State`` objects follow arrival order one input at a time; the generic commit
operator and array operands use them.  ``window`` gives the running value as a
window expression, ``agg`` the value over a whole group.  Unless told to keep
nulls, a state skips inputs whose main operand is null; a kept null makes the
result of an aggregate null.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from tidegauge.functions.scalar import div, div_col, numeric, wrapped
from tidegauge.lang.tree import E, LanguageError
from tidegauge.lang.types import BOOL, FLOAT, T, arr, is_arr, is_int, is_num, spark_type, wrap

LN2 = math.log(2)


@dataclass(frozen=True)
class Win:
    """Windows of one lifespan: its partition columns and the order of arrival."""

    keys: list[Column]
    order: list[Column]

    def by(self, *more: Column):
        return Window.partitionBy(*([*self.keys, *more] or [F.lit(0)]))

    @property
    def ordered(self):
        return self.by().orderBy(*self.order)

    @property
    def running(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, n: int, skip: int = 0):
        return self.ordered.rowsBetween(-n - skip + 1, -skip)


@dataclass(frozen=True)
class Sf:
    typed: Callable[[E], T]
    state: Callable[[E], State]
    main: int = 0
    window: Callable[..., Column | None] | None = None
    agg: Callable[..., Column | None] | None = None


REGISTRY: dict[str, Sf] = {}


class State:
    """``add`` sees the operands of inputs that are not skipped, ``value`` is asked after."""

    def __init__(self, e: E) -> None:
        self.e, self.poisoned, self.seen, self.skipped = e, False, False, False

    def update(self, v: list[Any]) -> None:
        sf = REGISTRY[self.e.op]
        self.skipped = False
        if v[sf.main] is None:
            if self.e.at.get("nulls") != "keep":
                self.skipped = True
                return
            if self.e.op in FOLDS:
                self.poisoned = True
                return
        self.seen = True
        self.add(*v)

    def add(self, *v: Any) -> None:
        raise NotImplementedError

    def result(self) -> Any:
        if self.skipped and self.e.op in PER_INPUT:
            return False if self.e.t.kind == "bool" else None
        return None if self.poisoned else self.value()

    def value(self) -> Any:
        raise NotImplementedError


# -- folds ------------------------------------------------------------------------


class Fold(State):
    start: Any = None

    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.x = self.start

    def add(self, v: Any) -> None:
        self.x = v if self.x is None else self.step(self.x, v)

    def step(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def value(self) -> Any:
        return self.x


def folded(step: Callable, start: Any = None) -> type[Fold]:
    return type("Folded", (Fold,), {"step": lambda self, a, b: step(a, b), "start": start})


class Sum(State):
    """Integers wrap at their width; floats use compensated summation."""

    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.s, self.c = 0, 0.0

    def add(self, v: Any) -> None:
        if isinstance(v, (bool, int)) and is_int(self.e.t):
            self.s = wrap(self.s + int(v), self.e.t)
            return
        v = float(v)
        t = self.s + v
        if math.isfinite(t):
            self.c += (self.s - t) + v if abs(self.s) >= abs(v) else (v - t) + self.s
        self.s = t

    def value(self) -> Any:
        return self.s + self.c if self.e.t.kind == "float" else self.s if self.seen or not self.e.args[0].t.null else None


class Avg(State):
    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.v: float = 0.0
        self.c, self.n = 0.0, 0

    def add(self, v: Any) -> None:
        y = float(v) - self.c
        t = self.v + y
        self.c = (t - self.v) - y
        self.v, self.n = t, self.n + 1

    def value(self) -> Any:
        return self.v / self.n if self.n else None


class Count(State):
    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.n = 0

    def add(self, v: Any) -> None:
        self.n += int(v) if self.e.args[0].t.kind == "bool" else 1

    def value(self) -> Any:
        return self.n


class Group(State):
    """Latest first."""

    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.v: list = []

    def add(self, v: Any) -> None:
        self.v.append(v)

    def value(self) -> Any:
        return self.v[::-1]


class Distinct(State):
    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.old: set = set()
        self.new = False

    def add(self, v: Any) -> None:
        k = hashable(v)
        self.new = k not in self.old
        self.old.add(k)

    def value(self) -> Any:
        return self.new


class Histogram(State):
    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.h = [0] * (int(e.args[3].at["v"]) + 2)

    def add(self, v: float, lo: float, hi: float, n: int) -> None:
        k = 0 if v < lo else n + 1 if v >= hi else 1 + int((v - lo) / ((hi - lo) / n))
        self.h[min(k, n + 1)] += 1

    def value(self) -> Any:
        return list(self.h)


def hashable(v: Any) -> Any:
    if isinstance(v, dict):
        return tuple((k, hashable(x)) for k, x in v.items())
    return tuple(map(hashable, v)) if isinstance(v, (list, tuple)) else v


def operand(e: E) -> T:
    """The operand's type, that of the items for an immediate fold of an array."""
    t = e.args[0].t
    return t.args[0] if e.at.get("life") == "immediate" and is_arr(t) else t


def _num(e: E) -> T:
    t = operand(e)
    if not (is_num(t) or t.kind == "bool"):
        raise LanguageError(f"{e.op[2:].upper()}: not a number but {t}")
    return T("i64", (), t.null) if t.kind in ("bool", "void") else t


def _bool(e: E) -> T:
    t = operand(e)
    if t.kind not in ("bool", "void"):
        raise LanguageError(f"{e.op[2:].upper()}: not a boolean but {t}")
    return T("bool", (), t.null)


def _keeping(e: E, c: Column, x: Column, over: Callable) -> Column:
    """A fold that keeps nulls is null once it has seen one."""
    if e.at.get("nulls") != "keep":
        return c
    return F.when(~over(F.bool_or(x.isNull())), c)


def fold(name: str, typed: Callable, state: Callable, col: Callable[[E, Column], Column]) -> None:
    def window(e: E, w: Win, x: Column) -> Column:
        return _keeping(e, col(e, x).over(w.running), x, lambda c: c.over(w.running))

    def agg(e: E, o: Column, x: Column) -> Column:
        return _keeping(e, col(e, x), x, lambda c: c)

    REGISTRY["s:" + name] = Sf(typed, state, 0, window, agg)


def _sum_col(e: E, x: Column) -> Column:
    return F.sum(x.cast("bigint") if e.args[0].t.kind == "bool" else x)


fold("min", operand, folded(lambda a, b: min(b, a)), lambda e, x: F.min(x))
fold("max", operand, folded(lambda a, b: max(b, a)), lambda e, x: F.max(x))
REGISTRY["s:sum"] = Sf(
    _num, Sum, 0,
    lambda e, w, x: wrapped(_keeping(e, _sum_col(e, x).over(w.running), x, lambda c: c.over(w.running)), e.t),
    lambda e, o, x: wrapped(_keeping(e, _sum_col(e, x), x, lambda c: c), e.t),
)
fold("avg", lambda e: _num(e) and FLOAT.nullable(operand(e).null), Avg, lambda e, x: F.avg(x.cast("double")))
fold("and", _bool, folded(lambda a, b: a and b), lambda e, x: F.bool_and(x))
fold("or", _bool, folded(lambda a, b: a or b), lambda e, x: F.bool_or(x))
fold("bitand", _num, folded(lambda a, b: a & b), lambda e, x: F.bit_and(x))
fold("bitor", _num, folded(lambda a, b: a | b), lambda e, x: F.bit_or(x))
fold("bitxor", _num, folded(lambda a, b: a ^ b), lambda e, x: F.bit_xor(x))


def _skips(e: E) -> bool:
    return e.at.get("nulls") != "keep"


def _pick(by: Callable) -> Callable:
    def agg(e: E, o: Column, x: Column) -> Column:
        return by(x, F.when(x.isNotNull(), o)) if _skips(e) else by(x, o)

    return agg


REGISTRY["s:first"] = Sf(operand, folded(lambda a, b: a), 0, lambda e, w, x: F.first(x, ignorenulls=_skips(e)).over(w.running), _pick(F.min_by))
REGISTRY["s:last"] = Sf(operand, folded(lambda a, b: b), 0, lambda e, w, x: F.last(x, ignorenulls=_skips(e)).over(w.running), _pick(F.max_by))


def _count(e: E, x: Column) -> Column:
    if operand(e).kind == "bool":
        return F.count_if(x)
    return F.count(x) if e.args[0].t.null and _skips(e) else F.count(F.lit(1))


fold("count", lambda e: T("u32", (), e.at.get("nulls") == "keep"), Count, _count)
REGISTRY["s:count"] = Sf(
    lambda e: T("u32" if False else "i64", (), e.at.get("nulls") == "keep"), Count, 0, REGISTRY["s:count"].window, REGISTRY["s:count"].agg
)


def _group_agg(e: E, o: Column, x: Column) -> Column:
    rows = F.collect_list(F.when(x.isNotNull(), F.struct(o.alias("o"), x.alias("v"))) if _skips(e) else F.struct(o.alias("o"), x.alias("v")))
    return F.transform(F.reverse(F.array_sort(rows)), lambda s: s["v"])


REGISTRY["s:group"] = Sf(
    lambda e: arr(operand(e)), Group, 0,
    lambda e, w, x: F.reverse(F.collect_list(x).over(w.running)) if _skips(e) else F.transform(F.reverse(F.collect_list(F.struct(x.alias("v"))).over(w.running)), lambda s: s["v"]),
    _group_agg,
)
REGISTRY["s:distinct"] = Sf(
    lambda e: BOOL.nullable(False), Distinct, 0,
    lambda e, w, x: (F.row_number().over(w.by(x).orderBy(*w.order)) == 1) & (x.isNotNull() | F.lit(not _skips(e))),
)


def _hist_agg(e: E, o: Column, *a: Column) -> Column:
    return _hist(e, a, lambda c: c)


def _hist(e: E, a: tuple[Column, ...], over: Callable) -> Column:
    x, lo, hi = (c.cast("double") for c in a[:3])
    n = int(e.args[3].at["v"])
    b = F.call_function("width_bucket", x, lo, hi, F.lit(n).cast("bigint"))
    return F.array(*[over(F.count_if(b == k)).cast("bigint") for k in range(n + 2)])


REGISTRY["s:histogram"] = Sf(lambda e: T("vec", (T("i64"), int(e.args[3].at["v"]) + 2)), Histogram, 0, lambda e, w, *a: _hist(e, a, lambda c: c.over(w.running)), _hist_agg)


# -- series -------------------------------------------------------------------------


def const(e: E) -> Any:
    if e.op == "cast":
        return const(e.args[0])
    if e.op != "lit":
        raise LanguageError("a constant is needed here")
    return e.at["v"]


class Lag(State):
    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.b: deque = deque(maxlen=int(const(e.args[0])) + 1)

    def add(self, k: int, v: Any) -> None:
        self.b.append(v)

    def value(self) -> Any:
        return self.b[0] if len(self.b) == self.b.maxlen else None


def skipping(e: E, w: Win, x: Column, build: Callable[[Win], Column]) -> Column:
    """A series function over the inputs that are not null; null inputs show the
    value of the last one before them."""
    if not e.args[REGISTRY[e.op].main].t.null or not _skips(e):
        return build(w)
    own = build(Win([*w.keys, x.isNull()], w.order))
    return F.last(F.when(x.isNotNull(), F.struct(own.alias("v"))), ignorenulls=True).over(w.running)["v"]


REGISTRY["s:lag"] = Sf(
    lambda e: e.args[1].t.nullable(), Lag, 1,
    lambda e, w, k, x: skipping(e, w, x, lambda u: F.lag(x, int(const(e.args[0]))).over(u.ordered)),
)


class SeasonAvg(State):
    """Average of the values 1..k seasons ago; those before the first count as 0."""

    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.p, self.k = int(const(e.args[0])), int(const(e.args[1]))
        self.b: deque = deque([0.0] * (self.p * self.k + 1), maxlen=self.p * self.k + 1)

    def add(self, p: int, k: int, v: Any) -> None:
        self.b.append(float(v))

    def value(self) -> Any:
        if not self.seen:
            return None
        return sum(self.b[-1 - self.p * i] for i in range(1, self.k + 1)) / self.k


def _season_win(e: E, w: Win, p: Column, k: Column, x: Column) -> Column:
    pp, kk = int(const(e.args[0])), int(const(e.args[1]))

    def build(u: Win) -> Column:
        if pp == 1:
            return F.coalesce(F.sum(x.cast("double")).over(u.last(kk, 1)), F.lit(0.0)) / kk
        total = F.lit(0.0)
        for i in range(1, kk + 1):
            total = total + F.coalesce(F.lag(x.cast("double"), i * pp).over(u.ordered), F.lit(0.0))
        return total / kk

    return skipping(e, w, x, build)


REGISTRY["s:season_moveavg"] = Sf(lambda e: FLOAT, SeasonAvg, 2, _season_win)


class Smooth(State):
    x: float | None = None

    def add(self, alpha: float, v: Any) -> None:
        self.x = float(v) if self.x is None else self.x * (1 - alpha) + float(v) * alpha

    def value(self) -> Any:
        return self.x


class Holt(State):
    """Damped level and trend, both from 0; the forecast of the next value."""

    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.l = self.b = 0.0
        self.phi = 1.0

    def add(self, alpha: float, beta: float, phi: float, v: Any) -> None:
        guess = self.l + phi * self.b
        level = alpha * float(v) + (1 - alpha) * guess
        self.b = beta * (level - self.l) + (1 - beta) * phi * self.b
        self.l, self.phi = level, phi

    def value(self) -> Any:
        return self.l + self.phi * self.b


class HoltWinter(State):
    """Damped level and trend with an additive season of n values."""

    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.l = self.b = 0.0
        self.phi, self.i = 1.0, 0
        self.s = [0.0] * int(const(e.args[3]))

    def add(self, alpha: float, beta: float, gamma: float, n: int, phi: float, v: Any) -> None:
        v, season, guess = float(v), self.s[self.i], self.l + phi * self.b
        level = alpha * (v - season) + (1 - alpha) * guess
        self.s[self.i] = gamma * (v - guess) + (1 - gamma) * season
        self.b = beta * (level - self.l) + (1 - beta) * phi * self.b
        self.l, self.phi, self.i = level, phi, (self.i + 1) % n

    def value(self) -> Any:
        return self.l + self.phi * self.b + self.s[self.i]


REGISTRY["s:smooth"] = Sf(lambda e: FLOAT, Smooth, 1)
REGISTRY["s:holt"] = Sf(lambda e: FLOAT, Holt, 3)
REGISTRY["s:holt_winter"] = Sf(lambda e: FLOAT, HoltWinter, 5)


class FitMulti(State):
    """Least squares without intercept on the last n observations p apart, for the current one."""

    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.p, self.n = int(const(e.args[0])), int(const(e.args[1]))
        self.b: deque = deque(maxlen=self.p * self.n + 1)

    def add(self, p: int, n: int, v: Any, *preds: Any) -> None:
        self.b.append([float(v), *[float(x or 0) for x in preds]])

    def value(self) -> Any:
        import numpy as np

        past = np.array([self.b[-1 - self.p * i] for i in range(1, self.n + 1) if self.p * i < len(self.b)])
        if not len(past):
            return 0.0
        try:
            k = np.linalg.lstsq(past[:, 1:], past[:, 0], rcond=None)[0]
        except np.linalg.LinAlgError:
            return 0.0
        return float(np.array(self.b[-1][1:]) @ k)


REGISTRY["s:fit_multi"] = Sf(lambda e: FLOAT, FitMulti, 2)


class Derive(State):
    """Difference per time; a kept null starts anew."""

    last: tuple | None = None
    out: float | None = None

    def add(self, v: Any, t: Any) -> None:
        if v is None:
            self.last = self.out = None
            return
        self.out = div(float(v - self.last[0]), float(t - self.last[1])) if self.last else None
        self.last = (v, t)

    def value(self) -> Any:
        return self.out


def _derive_win(e: E, w: Win, x: Column, t: Column) -> Column:
    def build(u: Win) -> Column:
        prev, then = F.lag(x.cast("double")).over(u.ordered), F.lag(t.cast("double")).over(u.ordered)
        return div_col(x.cast("double") - prev, t.cast("double") - then)

    return skipping(e, w, x, build)


REGISTRY["s:derive"] = Sf(lambda e: FLOAT, Derive, 0, _derive_win)


class Hysteresis(State):
    ok = True

    def add(self, v: float, accept: float, most: float) -> None:
        bound = most if self.ok else accept
        self.ok = v <= bound if most >= accept else v >= bound

    def value(self) -> Any:
        return self.ok


def _hysteresis_win(e: E, w: Win, v: Column, accept: Column, most: Column) -> Column:
    """Values beyond both bounds decide; between them the last decision holds."""
    up = most >= accept
    good = F.when(up, v <= F.least(accept, most)).otherwise(v >= F.greatest(accept, most))
    bad = F.when(up, v > F.greatest(accept, most)).otherwise(v < F.least(accept, most))
    return F.coalesce(F.last(F.when(good, True).when(bad, False), ignorenulls=True).over(w.running), F.lit(True))


REGISTRY["s:hysteresis"] = Sf(lambda e: BOOL.nullable(e.args[0].t.null), Hysteresis, 0, _hysteresis_win)


class OneOutOf(State):
    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.n, self.out = -1, None

    def add(self, k: int, v: Any) -> None:
        self.n += 1
        self.out = v if self.n % int(k) == 0 else None

    def value(self) -> Any:
        return self.out


REGISTRY["s:one_out_of"] = Sf(
    lambda e: e.args[1].t.nullable(), OneOutOf, 1,
    lambda e, w, k, x: F.when((F.row_number().over(w.by(x.isNull()).orderBy(*w.order)) - 1) % int(const(e.args[0])) == 0, x),
)


class Every(State):
    last: float | None = None
    out: Any = None

    def add(self, d: float, v: Any, t: float) -> None:
        if self.e.at.get("tumbling"):
            w = math.floor(t / d)
            self.out = v if self.last is not None and w != self.last else None
            self.last = w
        else:
            hit = self.last is None or t >= self.last + d
            self.out = v if hit else None
            self.last = t if hit else self.last

    def value(self) -> Any:
        return self.out


def _every_win(e: E, w: Win, d: Column, x: Column, t: Column) -> Column | None:
    if not e.at.get("tumbling"):
        return None
    slot = F.floor(t / d)
    return F.when(slot != F.lag(slot).over(w.by(x.isNull()).orderBy(*w.order)), x)


REGISTRY["s:every"] = Sf(lambda e: e.args[1].t.nullable(), Every, 1, _every_win)


class Remember(State):
    """Exact: true if the value was seen within d (REMEMBER renews on each hit)."""

    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.at: dict = {}
        self.hit, self.swept = False, None

    def add(self, fpr: float, d: float, v: Any, t: float) -> None:
        k = hashable(v)
        then = self.at.get(k)
        self.hit = then is not None and t - then <= d
        if not self.hit or self.e.op == "s:remember":
            self.at[k] = t
        if self.swept is None or t - self.swept > d:
            self.at = {x: s for x, s in self.at.items() if t - s <= d}
            self.swept = t

    def value(self) -> Any:
        return self.hit


def _remember_win(e: E, w: Win, fpr: Column, d: Column, x: Column, t: Column) -> Column | None:
    if e.op == "s:recall":
        return None
    then = F.lag(t.cast("double")).over(w.by(x).orderBy(*w.order))
    return F.coalesce(x.isNotNull() & (t - then <= d), F.lit(False))


for _n in ("remember", "recall"):
    REGISTRY["s:" + _n] = Sf(lambda e: BOOL.nullable(e.args[2].t.null), Remember, 2, _remember_win)


# -- selections -----------------------------------------------------------------------


class Rev:
    """Sorts the other way round."""

    __slots__ = ("v",)

    def __init__(self, v: Any) -> None:
        self.v = v

    def __lt__(self, other: Rev) -> bool:
        return other.v < self.v


class Largest(State):
    """The n largest by BY (by arrival without), less the ``but`` most extreme."""

    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.n, self.but, self.count = int(const(e.args[0])), int(const(e.args[1])), 0
        self.b: list = []

    def add(self, n: int, but: int, v: Any, *by: Any) -> None:
        from bisect import insort

        self.count += 1
        down = self.e.at.get("down")
        key = tuple(by) if by else (self.count,)
        order = Rev(key) if down else key
        insort(self.b, (order, self.count, v), key=lambda x: (x[0], x[1]) if not down else _RevKey(x))
        if len(self.b) > self.n:
            del self.b[0]

    def value(self) -> Any:
        if len(self.b) < self.n and not self.e.at.get("up_to") or len(self.b) <= self.but:
            return None
        return [x[2] for x in self.b[: len(self.b) - self.but]]


class _RevKey:
    __slots__ = ("x",)

    def __init__(self, x: tuple) -> None:
        self.x = x

    def __lt__(self, o: _RevKey) -> bool:
        return self.x[0] < o.x[0] or not (o.x[0] < self.x[0]) and self.x[1] > o.x[1]


def _sized(e: E, items: Column) -> Column:
    n, but = int(const(e.args[0])), int(const(e.args[1]))
    size = F.size(items)
    cut = F.slice(items, 1, F.greatest(size - but, F.lit(0)))
    return F.when(size > but if e.at.get("up_to") else size >= n, cut)


def _largest_win(e: E, w: Win, n: Column, but: Column, x: Column, *by: Column) -> Column | None:
    if by or e.at.get("down"):
        return None
    k = int(const(e.args[0]))
    if not _skips(e) or not e.args[2].t.null:
        items = F.transform(F.collect_list(F.struct(x.alias("v"))).over(w.last(k)), lambda s: s["v"])
        return _sized(e, items)
    return _sized(e, skipping(e, w, x, lambda u: F.collect_list(x).over(u.last(k))))


def _largest_agg(e: E, o: Column, n: Column, but: Column, x: Column, *by: Column) -> Column:
    k, down = int(const(e.args[0])), e.at.get("down")
    row = F.struct(*[c.alias(f"b{i}") for i, c in enumerate(by)], o.alias("o"), x.alias("v"))
    # A bounded heap per group, kept through partial aggregation: extremes first.
    best = InternalFunction.collect_top_k(F.when(x.isNotNull(), row) if _skips(e) else row, k, bool(down))
    return _sized(e, F.transform(F.reverse(best), lambda s: s["v"]))


REGISTRY["s:largest"] = Sf(lambda e: arr(e.args[2].t).nullable(), Largest, 2, _largest_win, _largest_agg)


class Sample(State):
    """Reservoir of n inputs, repeatable for a given order."""

    def __init__(self, e: E) -> None:
        import random

        super().__init__(e)
        self.r, self.n, self.count = random.Random(e.at.get("seed", 1)), int(const(e.args[0])), 0
        self.b: list = []

    def add(self, n: int, v: Any) -> None:
        self.count += 1
        if len(self.b) < self.n:
            self.b.append(v)
        elif (k := self.r.randrange(self.count)) < self.n:
            self.b[k] = v

    def value(self) -> Any:
        return list(self.b) if self.b else None


def _sample_agg(e: E, o: Column, n: Column, x: Column) -> Column:
    rows = F.collect_list(F.when(x.isNotNull(), F.struct(F.xxhash64(o).alias("r"), x.alias("v"))) if _skips(e) else F.struct(F.xxhash64(o).alias("r"), x.alias("v")))
    kept = F.slice(F.array_sort(rows), 1, int(const(e.args[0])))
    return F.when(F.size(kept) > 0, F.transform(kept, lambda s: s["v"]))


REGISTRY["s:sample"] = Sf(lambda e: arr(e.args[1].t).nullable(), Sample, 1, None, _sample_agg)


class Past(State):
    """Values of the last d seconds in order of time; tumbling gives the whole
    last window at the first input of the next."""

    def __init__(self, e: E) -> None:
        import random

        super().__init__(e)
        self.b: list = []
        self.out: list | None = None
        self.slot: float | None = None
        self.r = random.Random(1)

    def add(self, d: float, v: Any, t: float) -> None:
        from bisect import insort

        if self.e.at.get("tumbling"):
            slot = math.trunc(t / d)
            if self.slot is not None and slot != self.slot:
                self.out, self.b = [x[1] for x in self.b], []
            else:
                self.out = None
            self.slot = slot
            insort(self.b, (t, v), key=lambda x: x[0])
            return
        insort(self.b, (t, v), key=lambda x: x[0])
        k = 0
        while k < len(self.b) and t - self.b[k][0] >= d:
            k += 1
        del self.b[:k]
        self.out = [x[1] for x in self.b]

    def value(self) -> Any:
        n = self.e.at.get("sample")
        if self.out is None or n is None or len(self.out) <= n:
            return self.out
        keep = sorted(self.r.sample(range(len(self.out)), n))
        return [self.out[k] for k in keep]


REGISTRY["s:past"] = Sf(lambda e: arr(e.args[1].t).nullable(), Past, 1)


class Top(State):
    """Heavy hitters by space saving: ``over`` (10 n by default) items are tracked;
    a new one replaces the lightest and takes over its weight as error.  Weights
    halve every d/2.  Only items are named whose sure weight reaches the weight
    of rank n + 1 (and lies ``sigmas`` deviations above the mean)."""

    def __init__(self, e: E) -> None:
        super().__init__(e)
        self.n = int(const(e.args[0]))
        self.most = int(e.at.get("over") or 10 * self.n)
        self.w: dict = {}
        self.now: Any = None
        self.t0: float | None = None

    def add(self, n: int, x: Any, by: Any, t: float | None = None) -> None:
        d = self.e.at.get("span")
        w = float(by)
        if d and t is not None:
            self.t0 = t if self.t0 is None else self.t0
            w *= math.exp(LN2 * (t - self.t0) / (d / 2))
            if w > 1e100:
                scale = 1e-100
                self.w = {k: [a * scale, b * scale, v] for k, (a, b, v) in self.w.items()}
                self.t0 = t
                w = float(by)
        k = hashable(x)
        self.now = k
        if k in self.w:
            self.w[k][0] += w
        elif len(self.w) < self.most:
            self.w[k] = [w, 0.0, x]
        else:
            least = min(self.w, key=lambda q: self.w[q][0])
            old = self.w.pop(least)[0]
            self.w[k] = [old + w, old, x]

    def best(self) -> list:
        rows = sorted(self.w.items(), key=lambda r: -r[1][0])
        bar = rows[self.n][1][0] if len(rows) > self.n else 0.0
        s = self.e.at.get("sigmas")
        if s:
            v = [r[1][0] for r in rows]
            m = sum(v) / len(v)
            bar = max(bar, m + s * math.sqrt(sum((x - m) ** 2 for x in v) / len(v)))
        return [(k, x) for k, (w, err, x) in rows[: self.n] if w - err >= bar]

    def value(self) -> Any:
        out = self.e.at["out"]
        if not self.w:
            return [] if out == "list" else False if out == "is" else None
        best = self.best()
        if out == "list":
            return [x for _, x in best]
        keys = [k for k, _ in best]
        if out == "is":
            return self.now in keys
        return keys.index(self.now) + 1 if self.now in keys else None


REGISTRY["s:top"] = Sf(
    lambda e: {"list": arr(e.args[1].t), "is": BOOL.nullable(False), "rank": T("i64")}[e.at["out"]], Top, 1
)

#: What these say of an input is nothing (or false) where the input was skipped.
PER_INPUT = {"s:distinct", "s:one_out_of", "s:every", "s:remember", "s:recall"}
FOLDS = {"s:min", "s:max", "s:sum", "s:avg", "s:and", "s:or", "s:bitand", "s:bitor", "s:bitxor", "s:count"}
IMMEDIATE = FOLDS | {"s:first", "s:last", "s:group", "s:distinct"}


def over_array(e: E, items: list | None) -> Any:
    """An immediate function: its state run over the items of an array."""
    if items is None:
        return None
    inner = E(e.op, [E("lit", [], {"v": None}, e.args[0].t.args[0])], dict(e.at), e.t)
    s = REGISTRY[e.op].state(inner)
    for v in items:
        s.update([v])
    return s.result()


def over_array_col(e: E, a: Column) -> Column | None:
    """The same inside generated code, for the common folds."""
    op, item = e.op[2:], e.args[0].t.args[0]
    kept = F.filter(a, lambda x: x.isNotNull())
    ok = F.when(F.size(kept) == F.size(a), True) if e.at.get("nulls") == "keep" else F.lit(True)
    some = F.size(kept) > 0
    if op == "min":
        r = F.array_min(kept)
    elif op == "max":
        r = F.array_max(kept)
    elif op == "sum":
        zero = F.lit(0.0) if item.kind == "float" else F.lit(0).cast("bigint")
        kind = "double" if item.kind == "float" else "bigint"
        r = wrapped(F.when(some, F.aggregate(kept, zero, lambda s, x: s + x.cast(kind))), e.t)
    elif op == "avg":
        r = F.when(some, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.greatest(F.size(kept), F.lit(1)))
    elif op == "and":
        r = F.when(some, F.forall(kept, lambda x: x))
    elif op == "or":
        r = F.when(some, F.exists(kept, lambda x: x))
    elif op == "count":
        r = F.size(F.filter(kept, lambda x: x)).cast("bigint") if item.kind == "bool" else F.size(kept).cast("bigint")
    elif op == "first":
        r = F.get(kept if _skips(e) else a, F.lit(0))
        ok = F.lit(True)
    elif op == "last":
        r = F.try_element_at(kept if _skips(e) else a, F.lit(-1))
        ok = F.lit(True)
    elif op == "group":
        return F.reverse(kept if _skips(e) else a)
    else:
        return None
    return F.when(ok, r) if e.at.get("nulls") == "keep" else r


__all__ = ["FOLDS", "IMMEDIATE", "REGISTRY", "Sf", "State", "Win", "numeric", "over_array", "over_array_col", "spark_type"]
