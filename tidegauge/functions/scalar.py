"""Stateless functions: result type, Python meaning, Spark expression.

Every function has a Python meaning (used by the generic commit operator and as
an Arrow-batched UDF where Spark has no expression); most have a Spark
expression that stays inside generated code.  Null operands give null unless a
function says otherwise.
"""

from __future__ import annotations

import math
import re
import struct
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidegauge.lang.tree import E, LanguageError
from tidegauge.lang.types import (
    BOOL,
    CHAR,
    FLOAT,
    INTS,
    STRING,
    T,
    arr,
    is_arr,
    is_int,
    is_num,
    join,
    signed,
    spark_type,
    wrap,
)

INF = float("inf")


@dataclass(frozen=True)
class Fn:
    typed: Callable[[E], T]
    py: Callable[..., Any] | None = None
    col: Callable[..., Column] | None = None
    lazy: bool = False  # nulls reach the function


REGISTRY: dict[str, Fn] = {}


def fn(name: str, typed: Any, py: Any = None, col: Any = None, lazy: bool = False) -> None:
    REGISTRY[name] = Fn(typed if callable(typed) else (lambda e, t=typed: t), py, col, lazy)


def same(e: E) -> T:
    return e.args[0].t


def widest(e: E) -> T:
    t = e.args[0].t
    for a in e.args[1:]:
        t = join(t, a.t)
    return t


def numeric(e: E) -> T:
    t = widest(e)
    if not (is_num(t) or t.kind in ("bool", "ip4", "eth", "opaque", "time")):
        raise LanguageError(f"{e.op}: not a number but {t}")
    return T("i64", (), t.null) if t.kind == "void" else t


def wrapped(c: Column, t: T) -> Column:
    """Two's complement wrap-around of an integer column at its declared width."""
    if not is_int(t):
        return c.cast(spark_type(t))
    s, w = INTS[t.kind]
    if w == 64 and s == "i":
        return c.cast("bigint")
    if w > 56:
        m = F.lit(1 << w if w < 127 else 10**37).cast("decimal(38,0)")
        return c.cast("decimal(38,0)") if w == 128 else F.pmod(c.cast("decimal(38,0)"), m).cast(spark_type(t))
    m = 1 << w
    r = F.pmod(c.cast("bigint"), F.lit(m))
    if s == "i":
        r = F.when(r >= m // 2, r - m).otherwise(r)
    return r.cast(spark_type(t))


def _wide(c: Column, t: T) -> Column:
    """The operand in the domain its operation is computed in."""
    if t.kind == "float":
        return c.cast("double")
    return c.cast("decimal(38,0)") if is_int(t) and INTS[t.kind][1] > 56 and t.kind != "i64" else c.cast("bigint") if is_int(t) else c


def arith(op: Callable) -> Callable:
    def col(e: E, *cs: Column) -> Column:
        return wrapped(op(*[_wide(c, e.t) for c in cs]), e.t)

    return col


def arith_py(op: Callable) -> Callable:
    def py(e: E, *v: Any) -> Any:
        r = op(*v)
        return wrap(int(r), e.t) if is_int(e.t) else r

    return py


# -- arithmetic
fn("add", numeric, arith_py(lambda a, b: a + b), arith(lambda a, b: a + b))
fn("sub", lambda e: signed(numeric(e)), arith_py(lambda a, b: a - b), arith(lambda a, b: a - b))


def _mul_t(e: E) -> T:
    a, b = e.args
    if "string" in (a.t.kind, b.t.kind):
        return STRING
    return numeric(e)


def _mul_py(e: E, a: Any, b: Any) -> Any:
    if e.t.kind == "string":
        return a * max(0, b) if isinstance(a, str) else b * max(0, a)
    return wrap(a * b, e.t) if is_int(e.t) else float(a) * b


def _mul_col(e: E, a: Column, b: Column) -> Column:
    if e.t.kind == "string":
        s, n = (a, b) if e.args[0].t.kind == "string" else (b, a)
        return F.repeat(s, F.greatest(n.cast("int"), F.lit(0)))
    return arith(lambda x, y: x * y)(e, a, b)


fn("mul", _mul_t, _mul_py, _mul_col)


def div(a: float, b: float) -> float | None:
    """x/0 is infinite, 0/0 null."""
    if b == 0:
        return None if a == 0 or math.isnan(a) else math.copysign(INF, a) * math.copysign(1, b)
    return a / b


def div_col(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.when(a == 0, F.lit(None)).otherwise(a * F.lit(INF))).otherwise(a / F.when(b != 0, b))


fn("div", FLOAT, lambda e, a, b: div(float(a), float(b)), lambda e, a, b: div_col(a, b))


def _idiv(e: E, a: Any, b: Any) -> Any:
    if is_int(e.t):
        if b == 0:
            return None
        q = abs(a) // abs(b)
        return wrap(q if (a < 0) == (b < 0) else -q, e.t)
    r = div(float(a), float(b))
    return None if r is None else float(math.trunc(r)) if math.isfinite(r) else r


def _idiv_col(e: E, a: Column, b: Column) -> Column:
    if is_int(e.t):
        x, y = _wide(a, e.t), _wide(b, e.t)
        y = F.when(y != 0, y)
        return wrapped((x - x % y) / y, e.t) if INTS[e.t.kind][1] > 56 and e.t.kind != "i64" else wrapped(_div_sql(x, y), e.t)
    q = div_col(a, b)
    return F.when(q >= 0, F.floor(q).cast("double")).otherwise(F.ceil(q).cast("double")) if True else q


def _div_sql(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


fn("idiv", numeric, _idiv, _idiv_col)
fn(
    "mod", numeric,
    lambda e, a, b: None if b == 0 else (wrap(int(math.fmod(a, b)) if abs(a) < 1 << 53 else (abs(a) % abs(b)) * (-1 if a < 0 else 1), e.t) if is_int(e.t) else math.fmod(a, b)),
    lambda e, a, b: (lambda x, y: wrapped(x % F.when(y != 0, y), e.t))(_wide(a, e.t), _wide(b, e.t)),
)


def _pow(e: E, a: Any, b: Any) -> Any:
    try:
        r = a**b if is_int(e.t) and b >= 0 else float(a) ** float(b)
    except (ZeroDivisionError, OverflowError):
        return INF
    if isinstance(r, complex) or isinstance(r, float) and math.isnan(r):
        return None
    return wrap(int(r), e.t) if is_int(e.t) else r


def _pow_col(e: E, a: Column, b: Column) -> Column:
    r = F.pow(a.cast("double"), b.cast("double"))
    r = F.when(~F.isnan(r), r)
    return wrapped(F.round(r), e.t) if is_int(e.t) else r


fn("pow", numeric, _pow, _pow_col)
fn("neg", lambda e: signed(numeric(e)), arith_py(lambda a: -a), arith(lambda a: -a))
fn("abs", same, lambda e, a: abs(a), lambda e, a: F.abs(a))
fn("sq", same, arith_py(lambda a: a * a), arith(lambda a: a * a))
fn("reldiff", FLOAT, lambda e, a, b: 0.0 if a == b == 0 else abs(a - b) / max(abs(a), abs(b)),
   lambda e, a, b: F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.abs(a - b).cast("double") / F.nullif(F.greatest(F.abs(a), F.abs(b)).cast("double"), F.lit(0.0))))


def _trunc(e: E, x: Any, s: Any) -> Any:
    r = None if s == 0 else math.floor(x / s) * s if not (isinstance(x, int) and isinstance(s, int)) else x // s * s
    return r if r is None else int(r) if is_int(e.t) else float(r)


def _trunc_col(e: E, x: Column, s: Column) -> Column:
    if is_int(e.t) and is_int(e.args[1].t):
        return (x - F.pmod(x, F.nullif(s, F.lit(0)))).cast(spark_type(e.t))
    s = s.cast("double")
    r = F.floor(x.cast("double") / F.nullif(s, F.lit(0.0))) * s
    return r.cast(spark_type(e.t))


fn("truncate", lambda e: FLOAT if e.args[1].t.kind == "float" and not is_int(e.args[0].t) else same(e), _trunc, _trunc_col)
for _n, _py in (("ceil", math.ceil), ("floor", math.floor)):
    fn(_n, same, lambda e, a, f=_py: a if is_int(e.t) or not math.isfinite(a) else float(f(a)),
       lambda e, a, f=getattr(F, _n): a if is_int(e.t) else f(a).cast("double"))
fn("round", same, lambda e, a: a if is_int(e.t) or not math.isfinite(a) else float(math.floor(abs(a) + 0.5)) * (1 if a >= 0 else -1),
   lambda e, a: a if is_int(e.t) else F.round(a))


def _float(f: Callable, guard: Callable = lambda x: True) -> Callable:
    def py(e: E, a: Any) -> Any:
        if not guard(a):
            return None
        try:
            return f(float(a))
        except (ValueError, OverflowError):
            return None if f is not math.exp else INF

    return py


fn("exp", FLOAT, _float(math.exp), lambda e, a: F.exp(a.cast("double")))
for _n, _py, _c in (("log", math.log, F.log), ("log10", math.log10, F.log10)):
    fn(_n, FLOAT, lambda e, a, f=_py: -INF if a == 0 else None if a < 0 else f(a),
       lambda e, a, f=_c: F.when(a == 0, F.lit(-INF)).otherwise(f(a.cast("double"))))
fn("sqrt", FLOAT, _float(math.sqrt, lambda x: x >= 0), lambda e, a: F.when(a >= 0, F.sqrt(a.cast("double"))))
for _n in ("cos", "sin", "tan", "acos", "asin", "atan", "cosh", "sinh", "tanh"):
    fn(_n, FLOAT, _float(getattr(math, _n)), lambda e, a, f=getattr(F, _n): f(a.cast("double")))
fn("pi", FLOAT, lambda e: math.pi, lambda e: F.lit(math.pi))
fn("random", FLOAT, None, lambda e: F.rand())
fn("now", FLOAT, lambda e: time.time(), lambda e: F.unix_micros(F.current_timestamp()) / 1e6)
fn("age", FLOAT, lambda e, a: time.time() - a, lambda e, a: F.unix_micros(F.current_timestamp()) / 1e6 - a)


def xxhash(v: Any, t: T, seed: int = 42) -> int:
    """The 64-bit hash that Spark's ``xxhash64`` gives a value of the type's column."""
    import xxhash as xx

    d = spark_type(t)
    if v is None:
        return seed
    if is_arr(t):
        for x in v:
            seed = xxhash(x, t.args[0], seed)
        return seed
    if t.kind in ("tup", "rec"):
        kinds = t.args if t.kind == "tup" else [x for _, x in t.args]
        for x, k in zip(v if t.kind == "tup" else [v[n] for n, _ in t.args], kinds):
            seed = xxhash(x, k, seed)
        return seed
    if isinstance(d, S.BooleanType | S.ShortType | S.IntegerType):
        data = struct.pack("<i", int(v))
    elif isinstance(d, S.LongType):
        data = struct.pack("<q", int(v))
    elif isinstance(d, S.DoubleType):
        data = struct.pack("<d", v + 0.0 if v == v else math.nan)
    elif isinstance(d, S.DecimalType):
        n = int(v)
        data = n.to_bytes((n + (n < 0)).bit_length() // 8 + 1, "big", signed=True)
    else:
        data = v.encode() if isinstance(v, str) else bytes(v)
    h = xx.xxh64_intdigest(data, seed & (1 << 64) - 1)
    return h - (h >> 63 << 64)


fn("hash", T("i64"), lambda e, a: xxhash(a, e.args[0].t), lambda e, a: F.when(a.isNotNull(), F.xxhash64(a)))


# -- bits
def _shift(e: E, a: int, n: int) -> int:
    return wrap(a << n if n >= 0 else a >> -n, e.t)


def _shift_col(sign: int) -> Callable:
    def col(e: E, a: Column, n: Column) -> Column:
        n, x = n.cast("int") * sign, a.cast("bigint")
        return wrapped(F.when(n >= 0, F.call_function("shiftleft", x, F.greatest(n, F.lit(0)))).otherwise(F.call_function("shiftright", x, F.greatest(-n, F.lit(0)))), e.t)

    return col


fn("bitand2", numeric, lambda e, a, b: a & b, lambda e, a, b: wrapped(a.cast("bigint").bitwiseAND(b.cast("bigint")), e.t))
fn("bitor2", numeric, lambda e, a, b: a | b, lambda e, a, b: wrapped(a.cast("bigint").bitwiseOR(b.cast("bigint")), e.t))
fn("bitxor2", numeric, lambda e, a, b: a ^ b, lambda e, a, b: wrapped(a.cast("bigint").bitwiseXOR(b.cast("bigint")), e.t))
fn("shl", same, _shift, _shift_col(1))
fn("shr", same, lambda e, a, n: _shift(e, a, -n), _shift_col(-1))


# -- comparison and logic
def _cmp(op: Callable) -> tuple[Callable, Callable]:
    return (lambda e, a, b: op(a, b)), (lambda e, a, b: op(a, b))


for _n, _o in (
    ("gt", lambda a, b: a > b), ("ge", lambda a, b: a >= b), ("lt", lambda a, b: a < b), ("le", lambda a, b: a <= b),
    ("eq", lambda a, b: a == b), ("ne", lambda a, b: a != b),
):

    def _cmp_t(e: E) -> T:
        try:
            t = widest(e)
        except TypeError as x:
            raise LanguageError(f"cannot compare {e.args[0].t} and {e.args[1].t}") from x
        return T("bool", (), t.null)

    fn(_n, _cmp_t, *_cmp(_o))


def _bools(e: E) -> T:
    for a in e.args:
        if a.t.kind not in ("bool", "void", "opaque"):
            raise LanguageError(f"{e.op.upper()}: not a boolean but {a.t}")
    return T("bool", (), any(a.t.null for a in e.args))


fn("and", _bools, lambda e, a, b: False if a is False or b is False else None if a is None or b is None else True, lambda e, a, b: a & b, True)
fn("or", _bools, lambda e, a, b: True if a or b else None if a is None or b is None else False, lambda e, a, b: a | b, True)
fn("not", _bools, lambda e, a: not a, lambda e, a: ~a)


def _isnull_t(e: E) -> T:
    return BOOL.nullable(False)


fn("isnull", _isnull_t, lambda e, a: a is None, lambda e, a: a.isNull(), True)


def _coalesce(e: E) -> T:
    t = widest(e)
    return t.nullable(all(a.t.null for a in e.args))


fn("coalesce", _coalesce, lambda e, *v: next((x for x in v if x is not None), None), lambda e, *c: F.coalesce(*[x.cast(spark_type(e.t)) for x in c]), True)


def _extreme(pick: Callable, col: Callable) -> tuple:
    return (lambda e, *v: pick(v)), (lambda e, *c: F.when(_all_known(c), col(*[x.cast(spark_type(e.t)) for x in c])))


def _all_known(cs: tuple[Column, ...]) -> Column:
    out = cs[0].isNotNull()
    for c in cs[1:]:
        out = out & c.isNotNull()
    return out


fn("least", widest, *_extreme(min, F.least))
fn("greatest", widest, *_extreme(max, F.greatest))


# -- strings
fn("concat", STRING, lambda e, a, b: a + b, lambda e, a, b: F.concat(a, b))
fn("length", T("u32"), lambda e, a: len(a.encode()) if isinstance(a, str) else len(a), lambda e, a: F.size(a) if is_arr(e.args[0].t) else F.octet_length(a))
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_UP = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
fn("lower", STRING, lambda e, a: a.translate(_LOW), lambda e, a: F.translate(a, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
fn("upper", STRING, lambda e, a: a.translate(_UP), lambda e, a: F.translate(a, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
fn("startswith", BOOL, lambda e, a, b: a.startswith(b), lambda e, a, b: a.startswith(b))
fn("endswith", BOOL, lambda e, a, b: a.endswith(b), lambda e, a, b: a.endswith(b))


def like_regex(e: E) -> str:
    p, out, k = e.at["pattern"], [], 0
    while k < len(p):
        c = p[k]
        if c == "\\" and k + 1 < len(p):
            k += 1
            out.append(re.escape(p[k]))
        else:
            out.append(".*" if c == "%" else "." if c == "_" else re.escape(c))
        k += 1
    return "".join(out)


fn("like", BOOL, lambda e, a: re.fullmatch(like_regex(e), a, re.S | (0 if e.at["sensitive"] else re.I)) is not None,
   lambda e, a: a.like(e.at["pattern"]) if e.at["sensitive"] else a.ilike(e.at["pattern"]))


def _sub(e: E, s: str, a: int, b: int) -> str:
    n = len(s)
    a, b = (x + n if x < 0 else x for x in (a, b))
    a, b = max(0, min(a, n)), max(0, min(b, n))
    return s[a:b] if a < b else ""


def _sub_col(e: E, s: Column, a: Column, b: Column) -> Column:
    n = F.length(s)

    def clamp(x: Column) -> Column:
        x = F.when(x < 0, x + n).otherwise(x)
        return F.least(F.greatest(x.cast("int"), F.lit(0)), n)

    lo, hi = clamp(a), clamp(b)
    return F.substring(s, lo + 1, F.greatest(hi - lo, F.lit(0)))


fn("substring", STRING, _sub, _sub_col)


def _index_col(e: E, s: Column, c: Column) -> Column:
    if e.at.get("end"):
        at = F.instr(F.reverse(s), e.args[1].at["v"]) if e.args[1].op == "lit" else F.locate(c, F.reverse(s))
        return F.when(at > 0, F.length(s) - at).otherwise(F.lit(-1))
    return F.call_function("instr", s, c) - 1


fn("index", T("i32"), lambda e, s, c: s.rfind(c) if e.at.get("end") else s.find(c), _index_col)
fn("chr", CHAR, lambda e, a: chr(a & 255), lambda e, a: F.chr(a.cast("bigint").bitwiseAND(F.lit(255).cast("bigint"))))
fn("basename", STRING, lambda e, s: s.rsplit("/", 1)[-1], lambda e, s: F.element_at(F.split(s, "/"), -1))


def _uuid(e: E, v: int) -> str:
    h = f"{int(v):032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


fn("uuid_of_u128", STRING, _uuid)
fn("split", STRING)  # a generator: the planner makes rows of it


# -- time
_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def format_time(e: E | None, fmt: str, t: float) -> str:
    d = datetime.fromtimestamp(math.floor(t), timezone.utc)
    dow = (d.weekday() + 1) % 7
    table = {
        "Y": f"{d.year:04d}", "m": f"{d.month:02d}", "d": f"{d.day:02d}", "H": f"{d.hour:02d}", "M": f"{d.minute:02d}",
        "S": f"{d.second + (t - math.floor(t)):05.2f}", "j": str(d.timetuple().tm_yday - 1), "u": str(dow), "n": "\n", "t": "\t", "%": "%",
        "p": "AM" if d.hour < 12 else "PM", "I": f"{d.hour % 12 or 12:02d}", "y": f"{d.year % 100:02d}", "a": _DAYS[dow][:3], "A": _DAYS[dow],
        "b": _MONTHS[d.month - 1][:3], "B": _MONTHS[d.month - 1], "F": f"{d:%Y-%m-%d}", "T": f"{d:%H:%M:%S}", "s": str(int(t)),
    }
    return re.sub(r"%(.)", lambda m: table.get(m[1], m[0]), fmt)


_CLOCKS = {"midnight": 0, "noon": 12, "teatime": 16}


def parse_time(e: E | None, s: str, now: float | None = None) -> float | None:
    """Formats in order: clock times of today, now, epoch seconds, DD.MM.YYYY,
    MM/DD/YYYY, MMDDYYYY, ISO dates with an optional time.  UTC."""
    s = s.strip()
    now = time.time() if now is None else now
    today = math.floor(now / 86400) * 86400
    if m := re.fullmatch(r"(\d{1,2}):(\d{2}) ?([ap]m)?", s, re.I):
        h = int(m[1]) % 12 + (12 if m[3].lower() == "pm" else 0) if m[3] else int(m[1])
        return float(today + h * 3600 + int(m[2]) * 60)
    if s.lower() in _CLOCKS:
        return float(today + _CLOCKS[s.lower()] * 3600)
    if s.lower() == "now":
        return now
    patterns = ((r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})", "dmy"), (r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})", "mdy"), (r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})(?:[ T](?P<h>\d{1,2}):(?P<n>\d{2})(?::(?P<s>\d{1,2}(?:\.\d*)?))?)?", "iso"))
    if m := re.fullmatch(r"(\d{2})(\d{2})(\d{4})", s):
        mo, da, ye = map(int, m.groups())
        if mo <= 12:
            return _epoch(ye, mo, da, 0)
    if re.fullmatch(r"\d+(?:\.\d*)?", s):
        return float(s)
    for p, _ in patterns:
        if m := re.fullmatch(p, s):
            g = m.groupdict()
            # Seconds are read to the nearest whole one.
            secs = int(g.get("h") or 0) * 3600 + int(g.get("n") or 0) * 60 + math.floor(float(g.get("s") or 0) + 0.5)
            return _epoch(int(g["y"]), int(g["m"]), int(g["d"]), secs)
    return None


def _epoch(y: int, m: int, d: int, secs: float) -> float | None:
    try:
        return datetime(y, m, d, tzinfo=timezone.utc).timestamp() + secs
    except ValueError:
        return None


#: Directives that one pattern letter group of the column's formatter gives.
_PATTERNS = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "y": "yy", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
    "I": "hh", "p": "a", "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM",
}


def _format_time_col(e: E, fmt: Column, t: Column) -> Column | None:
    """In generated code for a literal format of these directives, in sessions that keep UTC."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if e.args[0].op != "lit" or spark is None or spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z"):
        return None
    pattern, fixed = "", ""
    for directive, text in [*re.findall(r"%(.)|([^%]+)", e.args[0].at["v"], re.S), ("", "")]:
        if directive in _PATTERNS or not (directive or text):
            pattern += ("'" + fixed.replace("'", "''") + "'" if fixed else "") + _PATTERNS.get(directive, "")
            fixed = ""
        elif text or directive in "nt%":
            fixed += text or {"n": "\n", "t": "\t", "%": "%"}[directive]
        else:
            return None
    return F.date_format(F.timestamp_micros(F.floor(t) * 1_000_000), pattern)


def _parse_time_col(e: E, s: Column) -> Column | None:
    """A literal that does not look at the clock is parsed once."""
    if e.args[0].op != "lit" or e.args[0].at["v"] is None:
        return None
    a, b = (parse_time(e, e.args[0].at["v"], now) for now in (0.0, 1e9 + 12_345))
    return F.lit(a).cast("double") if a == b else None


fn("format_time", STRING, format_time, _format_time_col)
fn("parse_time", FLOAT, parse_time, _parse_time_col)


# -- arrays and structures
fn("vec", lambda e: T("vec", (widest(e).nullable(any(a.t.null for a in e.args)), len(e.args)), False) if e.args else arr(T("void")),
   lambda e, *v: list(v), lambda e, *c: F.array(*[x.cast(spark_type(e.t.args[0])) for x in c]) if c else F.array(), True)
fn("tup", lambda e: T("tup", tuple(a.t for a in e.args), False), lambda e, *v: tuple(v), lambda e, *c: F.struct(*[x.alias(f"_{i}") for i, x in enumerate(c)]), True)
fn("rec", lambda e: T("rec", tuple((n, a.t) for n, a in zip(e.at["names"], e.args)), False),
   lambda e, *v: dict(zip(e.at["names"], v)), lambda e, *c: F.struct(*[x.alias(n) for n, x in zip(e.at["names"], c)]), True)


def _get_t(e: E) -> T:
    k, x = e.args
    t = x.t
    if t.kind == "tup":
        if k.op != "lit" or not 0 <= k.at["v"] < len(t.args):
            raise LanguageError(f"no such item of {t}")
        return t.args[k.at["v"]]
    if t.kind == "rec":
        for n, ft in t.args:
            if k.op == "lit" and n == k.at["v"]:
                return ft
        raise LanguageError(f"no field {k.at.get('v')} in {t}")
    if t.kind in ("vec", "arr"):
        return t.args[0].nullable()
    if t.kind == "map":
        return t.args[0].nullable()
    if t.kind == "string":
        return CHAR
    raise LanguageError(f"GET: cannot take an item of {t}")


def _get_py(e: E, k: Any, x: Any) -> Any:
    kind = e.args[1].t.kind
    if kind in ("rec", "map"):
        return x.get(k)
    if kind == "tup":
        return x[k]
    return x[k] if 0 <= k < len(x) else None


def _get_col(e: E, k: Column, x: Column) -> Column:
    t = e.args[1].t
    if t.kind == "tup":
        return x.getField(f"_{e.args[0].at['v']}")
    if t.kind == "rec":
        return x.getField(e.args[0].at["v"])
    if t.kind == "map":
        return F.try_element_at(x, k)
    if t.kind == "string":
        return F.substring(x, k.cast("int") + 1, F.lit(1))
    return F.get(x, k.cast("int"))


fn("get", _get_t, _get_py, _get_col)


def _in_t(e: E) -> T:
    t = e.args[1].t
    if not (t.kind in ("string", "cidr4", "cidr6", "cidr", "void") or is_arr(t)):
        raise LanguageError(f"IN: cannot look into {t}")
    return T("bool", (), e.args[0].t.null or t.null or is_arr(t) and t.args[0].null)


def in_cidr(ip: Any, net: Any) -> bool:
    a, m = (net["ip"], net["mask"]) if isinstance(net, dict) else net
    if isinstance(ip, bytes) and len(ip) == 4 and not isinstance(a, bytes):
        ip = int.from_bytes(ip, "big")
    if isinstance(a, bytes) and len(a) == 4 and isinstance(ip, int):
        a = int.from_bytes(a, "big")
    if isinstance(ip, bytes) != isinstance(a, bytes) or isinstance(ip, bytes) and len(ip) != len(a):
        return False
    bits = 8 * len(ip) if isinstance(ip, bytes) else 32
    x, y = (int.from_bytes(v, "big") if isinstance(v, bytes) else v for v in (ip, a))
    return x >> (bits - m) == y >> (bits - m)


def _in_py(e: E, x: Any, of: Any) -> Any:
    t = e.args[1].t
    if of is None or x is None:
        return False if of is not None and is_arr(t) and not len(of) else None
    if t.kind == "string":
        return x in of
    if t.kind.startswith("cidr"):
        return in_cidr(x, of)
    if is_arr(t) and t.args[0].kind.startswith("cidr"):
        hits = [None if c is None else in_cidr(x, c) for c in of]
        return True if True in hits else None if None in hits else False
    of = [tuple(v) if isinstance(v, list) else v for v in of]
    return True if x in [v for v in of if v is not None] else None if None in of else False


def _cidr_ends(net: tuple) -> tuple[Any, Any]:
    ip, m = net
    if isinstance(ip, bytes):
        bits, v = 8 * len(ip), int.from_bytes(ip, "big")
    else:
        bits, v = 32, ip
    host = (1 << (bits - m)) - 1
    lo, hi = v & ~host, v | host
    return (lo.to_bytes(bits // 8, "big"), hi.to_bytes(bits // 8, "big")) if isinstance(ip, bytes) else (lo, hi)


def _one_cidr(x: Column, xt: T, net: E, col: Column) -> Column:
    if net.op == "lit":
        lo, hi = _cidr_ends(net.at["v"])
        if isinstance(lo, int) and xt.kind != "ip4":
            lo, hi = (v.to_bytes(4, "big") for v in (lo, hi))
        if isinstance(lo, bytes):
            return (F.octet_length(x) == len(lo)) & (x >= F.lit(bytearray(lo))) & (x <= F.lit(bytearray(hi)))
        return x.between(F.lit(lo), F.lit(hi))
    shift = F.lit(32) - col["mask"]
    return F.call_function("shiftright", x, shift) == F.call_function("shiftright", col["ip"], shift)


def _in_col(e: E, x: Column, of: Column) -> Column:
    a, b = e.args
    if b.t.kind == "string":
        return F.contains(of, x)
    if b.t.kind.startswith("cidr"):
        return _one_cidr(x, a.t, b, of)
    if b.op == "vec" and b.args and b.args[0].t.kind.startswith("cidr"):
        out = None
        for n in b.args:
            c = _one_cidr(x, a.t, n, of)
            out = c if out is None else out | c
        return out
    if b.op == "vec" and all(n.op == "lit" for n in b.args) and b.args:
        values = [n.at["v"] for n in b.args]
        hit = x.isin([v for v in values if v is not None])
        return hit | F.lit(None).cast("boolean") if None in values else hit
    t = join(a.t, b.t.args[0])
    inside = F.array_contains(of.cast(spark_type(arr(t))), x.cast(spark_type(t)))
    return F.when(F.size(of) == 0, F.lit(False)).otherwise(inside)


fn("member", _in_t, _in_py, _in_col, True)


def nearest_rank(p: float, n: int) -> int:
    return int(math.floor(p / 100 * (n - 1) + 0.5))


def _pct_t(e: E) -> T:
    p, a = e.args
    if not is_arr(a.t):
        raise LanguageError(f"PERCENTILE: not an array but {a.t}")
    item = a.t.args[0].nullable()
    return arr(item) if is_arr(p.t) else item


def _pct_py(e: E, p: Any, a: list) -> Any:
    v = sorted(x for x in a if x is not None)
    if not v:
        return None
    return [v[nearest_rank(q, len(v))] for q in p] if isinstance(p, list) else v[nearest_rank(p, len(v))]


def _pct_col(e: E, p: Column, a: Column) -> Column:
    v = F.array_sort(F.filter(a, lambda x: x.isNotNull()))

    def one(q: Column) -> Column:
        return F.get(v, F.round(q.cast("double") / 100 * (F.size(v) - 1)).cast("int"))

    return F.when(F.size(v) > 0, F.transform(p, one)) if is_arr(e.args[0].t) else one(p)


fn("percentile", _pct_t, _pct_py, _pct_col)


def fit(e: E | None, v: list) -> float | None:
    """Linear regression of the last item from those before it."""
    import numpy as np

    if len(v) < 2 or any(x is None for x in v):
        return None
    if not isinstance(v[0], (tuple, dict)):
        past = v[:-1]
        if len(past) < 2:
            return float(past[0])
        return float(past[-1] + (past[-1] - past[0]) / (len(past) - 1))
    rows = [list(x.values()) if isinstance(x, dict) else list(x) for x in v]
    a = np.array(rows, float)
    origin = a[0]
    past = a[:-1] - origin
    try:
        k = np.linalg.lstsq(past[:, 1:], past[:, 0], rcond=None)[0]
    except np.linalg.LinAlgError:
        return None
    return float(origin[0] + (a[-1, 1:] - origin[1:]) @ k)


def _fit_col(e: E, a: Column) -> Column | None:
    if e.args[0].t.args[0].kind in ("tup", "rec"):
        return None
    n = F.size(a) - 1
    last, first = F.get(a, n - 1).cast("double"), F.get(a, F.lit(0)).cast("double")
    return F.when(n >= 2, last + (last - first) / (n - 1)).when(n == 1, first)


fn("fit", FLOAT, fit, _fit_col)
_BARS = " ▁▂▃▄▅▆▇█"


def sparkline(e: E | None, v: list) -> str:
    top = max((x for x in v if x is not None), default=0)
    return "".join(_BARS[0 if not x or not top else max(1, min(8, math.ceil(x / top * 8)))] for x in v)


fn("sparkline", STRING, sparkline)


def _peek_t(e: E) -> T:
    if e.args[0].t.kind == "string" or is_arr(e.args[0].t):
        return e.at["to"].nullable(e.args[0].t.kind == "string" or e.args[0].t.args[0].null)
    raise LanguageError(f"PEEK: neither a string nor a vector but {e.args[0].t}")


def _peek_py(e: E, x: Any) -> Any:
    width = INTS[e.at["to"].kind][1]
    if isinstance(x, str):
        b, size = x.encode("latin-1", "replace"), 8
    else:
        b, size = x, INTS[e.args[0].t.args[0].kind][1] if is_int(e.args[0].t.args[0]) else 8
        if any(v is None for v in x):
            return None
    need = -(-width // size)
    if len(b) < need:
        return None
    b = list(b)[-need:] if e.at["big"] and not isinstance(x, str) else list(b)[:need]
    if e.at["big"]:
        b.reverse()
    return wrap(sum((v & ((1 << size) - 1)) << (size * k) for k, v in enumerate(b)), e.at["to"])


fn("peek", _peek_t, _peek_py)


# -- network
def _edge(last: bool) -> tuple[Callable, Callable]:
    def py(e: E, net: Any) -> Any:
        net = (net["ip"], net["mask"]) if isinstance(net, dict) else net
        return _cidr_ends(net)[last]

    def col(e: E, net: Column) -> Column | None:
        if e.args[0].op == "lit":
            v = _cidr_ends(e.args[0].at["v"])[last]
            return F.lit(bytearray(v)) if isinstance(v, bytes) else F.lit(v).cast("bigint")
        if e.args[0].t.kind != "cidr4":
            return None
        host = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - net["mask"]) - 1
        base = net["ip"].bitwiseAND(F.bitwise_not(host))
        return base + host if last else base

    return py, col


_CIDR_IP = {"cidr4": "ip4", "cidr6": "ip6", "cidr": "ip"}
fn("begin_of", lambda e: T(_CIDR_IP[e.args[0].t.kind]), *_edge(False))
fn("end_of", lambda e: T(_CIDR_IP[e.args[0].t.kind]), *_edge(True))
fn("ipfamily", T("u8"), lambda e, x: 4 if not isinstance(x, bytes) or len(x) == 4 else 6,
   lambda e, x: F.lit(4) if e.args[0].t.kind == "ip4" else F.when(F.octet_length(x) == 4, 4).otherwise(6))

#: Ranges (first, last, code) of 4- or 16-byte addresses, sorted; none is shipped.
COUNTRIES: list[tuple[bytes, bytes, str]] = []


def country(e: E | None, ip: Any) -> str | None:
    from bisect import bisect_right

    b = ip if isinstance(ip, bytes) else int(ip).to_bytes(4, "big")
    table = e.at.get("ranges", COUNTRIES) if e is not None else COUNTRIES
    starts = [r[0] for r in table if len(r[0]) == len(b)]
    rows = [r for r in table if len(r[0]) == len(b)]
    k = bisect_right(starts, b) - 1
    return rows[k][2] if k >= 0 and b <= rows[k][1] else None


fn("countrycode", STRING, country)


def _variant(e: E, name: str) -> str | None:
    import os

    return (e.at.get("variants") or {}).get(name) or os.environ.get(f"VARIANT_{name}")


fn("variant", STRING, _variant)


def _force_py(e: E, a: Any) -> Any:
    if a is None:
        raise ValueError("FORCE: null")
    return a


fn("force", lambda e: e.args[0].t.nullable(False), _force_py, lambda e, a: F.when(a.isNotNull(), a).otherwise(F.raise_error(F.lit("FORCE: null")).cast(spark_type(e.t))), True)
fn("mapadd", lambda e: e.args[2].t, None)


# -- casts
def show(v: Any, t: T) -> str:
    if v is None:
        return "NULL"
    if t.kind == "bool":
        return "true" if v else "false"
    if t.kind == "float":
        return f"{v:.12g}" if math.isfinite(v) else {INF: "inf", -INF: "-inf"}.get(v, "nan")
    if t.kind in ("ip4", "ip6", "ip"):
        import ipaddress

        return str(ipaddress.ip_address(v))
    if t.kind == "eth":
        h = f"{v:012x}"
        return ":".join(h[k : k + 2] for k in range(0, 12, 2))
    if t.kind.startswith("cidr"):
        a, m = (v["ip"], v["mask"]) if isinstance(v, dict) else v
        return f"{show(a, T('ip'))}/{m}"
    if is_arr(t):
        return "[" + ";".join(show(x, t.args[0]) for x in v) + "]"
    if t.kind == "tup":
        return "(" + ";".join(show(x, y) for x, y in zip(v, t.args)) + ")"
    return str(v)


def cast_py(e: E | None, v: Any, to: T | None = None, of: T | None = None) -> Any:
    import ipaddress

    to, of = to or e.at["to"], of or e.args[0].t
    if v is None:
        return None
    k = to.kind
    try:
        if k in INTS:
            if isinstance(v, str):
                v = int(v.strip(), 0) if re.match(r"\s*[+-]?0[xob]", v) else int(v.strip())
                return v if wrap(v, to) == v else None
            if isinstance(v, bytes):
                v = int.from_bytes(v, "big")
            return wrap(int(v), to)
        if k == "float":
            return float(v)
        if k == "bool":
            return {"true": True, "false": False}.get(v.strip().lower()) if isinstance(v, str) else v != 0
        if k in ("string", "char"):
            return v if isinstance(v, str) else show(v, of)
        if k in ("ip4", "ip6", "ip"):
            if isinstance(v, str):
                a = ipaddress.ip_address(v.strip())
                if k == "ip4":
                    return int(a) if a.version == 4 else None
                return a.packed if k == "ip" or a.version == 6 else None
            if k == "ip4":
                return int(v) if not isinstance(v, bytes) else int.from_bytes(v, "big") if len(v) == 4 else None
            return v if isinstance(v, bytes) else int(v).to_bytes(16 if k == "ip6" else 4, "big")
        if k.startswith("cidr") and isinstance(v, str):
            n = ipaddress.ip_network(v.strip(), strict=False)
            return (int(n.network_address) if k == "cidr4" else n.network_address.packed, n.prefixlen)
        if k == "eth" and isinstance(v, str):
            return int(v.replace(":", ""), 16)
        if is_arr(to):
            return [cast_py(None, x, to.args[0], of.args[0] if is_arr(of) else of) for x in v]
        if k == "tup":
            return tuple(cast_py(None, x, t, o) for x, t, o in zip(v, to.args, of.args))
        return v
    except (ValueError, TypeError):
        if to.null:
            return None
        raise


def _cast_col(e: E, c: Column) -> Column | None:
    to, of = e.at["to"], e.args[0].t
    k = to.kind
    if of.kind == "void":
        return F.lit(None).cast(spark_type(to))
    if k in INTS:
        if of.kind in ("string", "char"):
            s, w = INTS[k]
            v = F.trim(c).try_cast("decimal(38,0)")
            lo, hi = (0, (1 << w) - 1) if s == "u" else (-(1 << (w - 1)), (1 << (w - 1)) - 1)
            if w == 128:
                return v
            ok = v.between(F.lit(lo).cast("decimal(38,0)"), F.lit(hi).cast("decimal(38,0)")) & ~F.contains(c, F.lit("."))
            v = F.when(ok, v).cast(spark_type(to))
            return v if to.null else F.when(c.isNotNull() & v.isNull(), F.raise_error(F.lit("CAST: not a number")).cast(spark_type(to))).otherwise(v)
        if of.kind == "float":
            whole = F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
            return wrapped(whole, to)
        if of.kind == "bool":
            return c.cast("int").cast(spark_type(to))
        if is_int(of) or of.kind in ("ip4", "eth"):
            return wrapped(c, to)
        return None
    if k == "float":
        return c.try_cast("double") if of.kind == "string" else c.cast("double") if is_num(of) or of.kind in ("bool", "opaque") else F.unix_micros(c.cast("timestamp")) / 1e6 if of.kind == "time" else None
    if k == "bool":
        return c != 0 if is_num(of) else c if of.kind == "bool" else F.when(F.lower(F.trim(c)) == "true", True).when(F.lower(F.trim(c)) == "false", False)
    if k in ("string", "char"):
        return c if of.kind in ("string", "char") else c.cast("string") if is_int(of) or of.kind in ("bool", "time", "opaque") else None
    if k == "ip4" and (is_int(of) or of.kind == "ip4"):
        return c.cast("bigint")
    if k == of.kind or is_arr(to) and is_arr(of) and is_num(to.args[0]) and is_num(of.args[0]):
        return c.cast(spark_type(to))
    return None


fn("cast", lambda e: e.at["to"].nullable(e.at["to"].null or e.args[0].t.null), cast_py, _cast_col)


# -- CASE
def _case_t(e: E) -> T:
    n = len(e.args)
    results = [e.args[k] for k in range(1, n, 2)] + ([e.args[-1]] if n % 2 else [])
    for k in range(0, n - 1, 2):
        if e.args[k].t.kind not in ("bool", "void"):
            raise LanguageError(f"CASE: condition is not a boolean but {e.args[k].t}")
    t = results[0].t
    for r in results[1:]:
        t = join(t, r.t)
    return t.nullable(t.null or not n % 2)


def _case_py(e: E, *v: Any) -> Any:
    for k in range(0, len(v) - 1, 2):
        if v[k]:
            return v[k + 1]
    return v[-1] if len(v) % 2 else None


def _case_col(e: E, *c: Column) -> Column:
    t = spark_type(e.t)
    out = F.when(c[0], c[1].cast(t))
    for k in range(2, len(c) - 1, 2):
        out = out.when(c[k], c[k + 1].cast(t))
    return out.otherwise(c[-1].cast(t)) if len(c) % 2 else out


fn("case", _case_t, _case_py, _case_col, True)
