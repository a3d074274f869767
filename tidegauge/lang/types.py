"""Value types of the language and their Spark counterparts.

A type is a ``T``: a kind, its parameters and a nullability.  Integers keep
their declared width; arithmetic wraps at it (64-bit columns use Spark's own
bigint, which raises on overflow instead).  128-bit integers are decimals of 38
digits.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import types as S

WIDTHS = (8, 16, 24, 32, 40, 48, 56, 64, 128)
INTS = {f"{s}{w}": (s, w) for s in "ui" for w in WIDTHS}


@dataclass(frozen=True)
class T:
    kind: str
    args: tuple = ()
    null: bool = True

    def nullable(self, yes: bool = True) -> T:
        return replace(self, null=yes)

    def __str__(self) -> str:
        q = "?" if self.null else ""
        if self.kind in ("vec", "arr"):
            return f"{self.args[0]}[{self.args[1] if self.kind == 'vec' else ''}]{q}"
        if self.kind == "tup":
            return "(" + ";".join(map(str, self.args)) + ")" + q
        if self.kind == "rec":
            return "{" + ";".join(f"{n}:{t}" for n, t in self.args) + "}" + q
        return self.kind + q


BOOL, FLOAT, STRING, CHAR, VOID, I64 = (T(k) for k in ("bool", "float", "string", "char", "void", "i64"))
IP4, IP6, IP, ETH = (T(k) for k in ("ip4", "ip6", "ip", "eth"))


def arr(t: T) -> T:
    return T("arr", (t, None))


def is_int(t: T) -> bool:
    return t.kind in INTS


def is_num(t: T) -> bool:
    return is_int(t) or t.kind in ("float", "void")


def is_arr(t: T) -> bool:
    return t.kind in ("vec", "arr")


def signed(t: T) -> T:
    """A signed type that holds the unsigned one's values."""
    if t.kind[0] != "u" or not is_int(t):
        return t
    w = INTS[t.kind][1]
    wider = [x for x in WIDTHS if x > w]
    return T(f"i{wider[0] if wider else 128}", (), t.null)


def join(a: T, b: T) -> T:
    """The type that holds both (numbers widen, void takes the other)."""
    null = a.null or b.null
    if a.kind == "void":
        return b.nullable()
    if b.kind == "void":
        return a.nullable()
    if a.kind == "float" and is_num(b) or b.kind == "float" and is_num(a):
        return T("float", (), null)
    if is_int(a) and is_int(b):
        (sa, wa), (sb, wb) = INTS[a.kind], INTS[b.kind]
        if sa == sb:
            return T(f"{sa}{max(wa, wb)}", (), null)
        u, i = (wa, wb) if sa == "u" else (wb, wa)
        w = i if i > u else next((x for x in WIDTHS if x > u), 128)
        return T(f"i{w}", (), null)
    if is_arr(a) and is_arr(b):
        kind = "vec" if a.kind == b.kind == "vec" and a.args[1] == b.args[1] else "arr"
        return T(kind, (join(a.args[0], b.args[0]), a.args[1] if kind == "vec" else None), null)
    if a.kind == b.kind == "tup" and len(a.args) == len(b.args):
        return T("tup", tuple(join(x, y) for x, y in zip(a.args, b.args)), null)
    if {a.kind, b.kind} <= {"ip4", "ip6", "ip"} and a.kind != b.kind:
        return T("ip", (), null)
    if {a.kind, b.kind} == {"char", "string"}:
        return T("string", (), null)
    if a.kind == "bool" and is_num(b):
        return b.nullable(null)
    if b.kind == "bool" and is_num(a):
        return a.nullable(null)
    if a.kind == b.kind:
        return a.nullable(null)
    raise TypeError(f"no type holds both {a} and {b}")


def spark_type(t: T) -> S.DataType:
    k = t.kind
    if k in INTS:
        s, w = INTS[k]
        if w == 128 or k == "u64":
            return S.DecimalType(20 if w == 64 else 38, 0)
        bits = w + (s == "u")
        return S.ShortType() if bits <= 16 else S.IntegerType() if bits <= 32 else S.LongType()
    if is_arr(t):
        return S.ArrayType(spark_type(t.args[0]))
    if k == "tup":
        return S.StructType([S.StructField(f"_{i}", spark_type(x)) for i, x in enumerate(t.args)])
    if k == "rec":
        return S.StructType([S.StructField(n, spark_type(x)) for n, x in t.args])
    if k == "map":
        return S.MapType(spark_type(t.args[1]), spark_type(t.args[0]))
    if k.startswith("cidr"):
        ip = S.LongType() if k == "cidr4" else S.BinaryType()
        return S.StructType([S.StructField("ip", ip), S.StructField("mask", S.IntegerType())])
    return {
        "bool": S.BooleanType(), "float": S.DoubleType(), "string": S.StringType(), "char": S.StringType(),
        "void": S.StringType(), "ip4": S.LongType(), "ip6": S.BinaryType(), "ip": S.BinaryType(), "eth": S.LongType(),
    }[k]


def of_spark(f: S.StructField) -> T:
    """The type of a column: the one in its metadata, else the nearest."""
    if f.metadata and "lang_type" in f.metadata:
        from tidegauge.lang.parser import parse_type

        return parse_type(f.metadata["lang_type"])
    return of_data(f.dataType)


def of_data(d: S.DataType) -> T:
    if isinstance(d, S.ArrayType):
        return arr(of_data(d.elementType))
    if isinstance(d, S.StructType):
        if [x.name for x in d] == [f"_{i}" for i in range(len(d))]:
            return T("tup", tuple(of_data(x.dataType) for x in d))
        return T("rec", tuple((x.name, of_data(x.dataType)) for x in d))
    if isinstance(d, S.MapType):
        return T("map", (of_data(d.valueType), of_data(d.keyType)))
    if isinstance(d, S.DecimalType):
        return T("float") if d.scale else T("i64") if d.precision <= 18 else T("u64") if d.precision <= 20 else T("i128")
    return {
        "boolean": T("bool"), "double": T("float"), "float": T("float"), "string": T("string"), "binary": T("ip"),
        "tinyint": T("i8"), "smallint": T("i16"), "int": T("i32"), "bigint": T("i64"), "void": T("void"),
        "timestamp": T("time"), "timestamp_ntz": T("time"), "date": T("time"),
    }.get(d.simpleString(), T("opaque", (d.simpleString(),)))


def wrap(v: int, t: T) -> int:
    s, w = INTS[t.kind]
    v &= (1 << w) - 1
    return v - (1 << w) if s == "i" and v >> (w - 1) else v


def literal_type(v: Any) -> T:
    if v is None:
        return VOID
    if isinstance(v, bool):
        return BOOL.nullable(False)
    if isinstance(v, int):
        return T("i64", (), False) if -(1 << 63) <= v < 1 << 63 else T("u64" if 0 <= v < 1 << 64 else "i128", (), False)
    return {float: FLOAT, str: STRING}[type(v)].nullable(False)
