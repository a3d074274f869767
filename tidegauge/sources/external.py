"""External sources and sinks of the language: CSV, RowBinary, Kafka, ORC, Parquet.

Files are read with the declared schema, never inferred; lines that do not fit
are dropped.  Types without a Spark reader (addresses, vectors) are read as
strings and parsed by expressions or the language's own casts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidegauge.lang.tree import LanguageError, Read
from tidegauge.lang.types import INTS, T, is_arr, is_int, spark_type

# -- CSV ------------------------------------------------------------------------


def csv_options(o: dict[str, Any]) -> dict[str, str]:
    quote = o.get("quote", '"')
    out = {"sep": o.get("sep", ","), "header": "false", "mode": "DROPMALFORMED", "nullValue": o.get("null", ""), "quote": quote or "\u0000", "emptyValue": ""}
    if o.get("escape"):
        out["escape"] = o["escape"]
    return out


def raw_schema(columns: list[tuple[str, T]]) -> S.StructType:
    """What the reader parses itself; all else comes as text."""

    def kind(t: T) -> S.DataType:
        plain = t.kind in ("float", "string", "char") or is_int(t) and not isinstance(spark_type(t), S.DecimalType)
        return spark_type(t) if plain else S.StringType()

    return S.StructType([S.StructField(n, kind(t)) for n, t in columns])


#: Elements of a vector: quoted ones may hold separators and escaped quotes.
_ELEMENTS = r"""\s*(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^;,"'\s][^;,]*)"""
_CLICKHOUSE = r"""\s*(?:'(?:[^'\\]|\\.)*'|[^,'\s][^,]*)"""


def parse_text(c: Column, t: T, options: dict[str, Any] = {}) -> Column:
    from tidegauge.lang.tree import E
    from tidegauge.plans.planner import udf

    if t.kind == "bool":
        low = F.lower(F.trim(c))
        return F.when(low.isin("true", "1", "t"), True).when(low.isin("false", "0", "f"), False)
    if is_int(t):
        return F.trim(c).try_cast(spark_type(t))
    if is_arr(t):
        if t.args[0].kind == "char" and options.get("chars") == "string":
            return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))
        pattern = _CLICKHOUSE if options.get("clickhouse") else _ELEMENTS
        inner = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
        items = F.transform(F.regexp_extract_all(inner, F.lit(pattern), 0), lambda x: F.trim(x))
        bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"""^(['"])(.*)\1$""", "$2"), r"\\(.)", "$1")
        if t.args[0].kind in ("string", "char"):
            quote = "^'" if options.get("clickhouse") else "^['\"]"
            return F.transform(items, lambda x: F.when(x.rlike(quote), bare(x)).otherwise(x))
        return F.transform(items, lambda x: x.try_cast(spark_type(t.args[0])))
    text = E("in", [], {"name": "_"}, T("string"))
    return udf(E("cast", [text], {"to": t.nullable()}, t.nullable()), [c])


def typed(df: DataFrame, columns: list[tuple[str, T]], options: dict[str, Any] = {}) -> DataFrame:
    raw = {f.name: f.dataType for f in raw_schema(columns)}
    out = []
    for n, t in columns:
        c = F.col(f"`{n}`")
        c = c if raw[n] == spark_type(t) else parse_text(c, t, options)
        out.append(c.alias(n, metadata={"lang_type": str(t)} if t.kind != "map" else {}))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, columns: list[tuple[str, T]], options: dict[str, Any], stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if stream and options.get("delete") is not None:
        reader = reader.option("cleanSource", "delete")
    df = reader.schema(raw_schema(columns)).options(**csv_options(options)).csv(path)
    return typed(df, columns, options)


# -- RowBinary --------------------------------------------------------------------

_COLUMN = re.compile(r"[`'\"]?(\w+)[`'\"]?\s+([A-Za-z0-9]+(?:\([^()]*(?:\([^()]*\))?[^()]*\))?)")
# Names of the format's types, the language's, and struct codes.
_BINARY = {
    "UInt8": ("u8", "<B"), "UInt16": ("u16", "<H"), "UInt32": ("u32", "<I"), "UInt64": ("u64", "<Q"),
    "Int8": ("i8", "<b"), "Int16": ("i16", "<h"), "Int32": ("i32", "<i"), "Int64": ("i64", "<q"),
    "Float32": ("float", "<f"), "Float64": ("float", "<d"), "Date": ("u16", "<H"), "DateTime": ("u32", "<I"),
}


def names_and_types(text: str) -> list[tuple[str, T, str]]:
    """Columns of a ``columns format version: 1`` header: name, type, format's type."""
    out = []
    body = text.split("columns:", 1)[-1]
    for m in _COLUMN.finditer(body):
        name, kind = m[1], m[2]
        null = kind.startswith("Nullable(")
        base = kind[9:-1] if null else kind
        if base.startswith("FixedString"):
            t = T("ip6", (), null) if base == "FixedString(16)" else T("string", (), null)
        elif base.startswith("Array("):
            t = T("arr", (T("string"), None), null)
        else:
            t = T(_BINARY.get(base, ("string",))[0], (), null)
        out.append((name, t, kind))
    return out


def _varint(b: memoryview, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        x = b[at]
        at += 1
        v |= (x & 127) << shift
        if x < 128:
            return v, at
        shift += 7


def _value(b: memoryview, at: int, kind: str) -> tuple[Any, int]:
    if kind.startswith("Nullable("):
        null = b[at]
        return (None, at + 1) if null else _value(b, at + 1, kind[9:-1])
    if kind == "String":
        n, at = _varint(b, at)
        return bytes(b[at : at + n]).decode("utf-8", "replace"), at + n
    if kind.startswith("FixedString("):
        n = int(kind[12:-1])
        return bytes(b[at : at + n]), at + n
    if kind == "UUID":
        hi, lo = struct.unpack_from("<QQ", b, at)
        return f"{hi:016x}{lo:016x}", at + 16
    if kind.startswith("Array("):
        n, at = _varint(b, at)
        out = []
        for _ in range(n):
            v, at = _value(b, at, kind[6:-1])
            out.append(v)
        return out, at
    code = _BINARY[kind][1]
    return struct.unpack_from(code, b, at)[0], at + struct.calcsize(code)


def decode_rowbinary(data: bytes, kinds: list[str]) -> Iterator[list]:
    """Whole rows; an incomplete tail is left out."""
    b, at = memoryview(data), 0
    while at < len(b):
        row = []
        try:
            for k in kinds:
                v, at = _value(b, at, k)
                row.append(v)
        except (struct.error, IndexError):
            return
        yield row


def encode_rowbinary(rows: list[list], kinds: list[str]) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def one(v: Any, kind: str) -> bytes:
        if kind.startswith("Nullable("):
            return b"\1" if v is None else b"\0" + one(v, kind[9:-1])
        if kind == "String":
            x = v.encode()
            return varint(len(x)) + x
        if kind.startswith("FixedString("):
            return bytes(v).ljust(int(kind[12:-1]), b"\0")
        if kind == "UUID":
            return struct.pack("<QQ", int(v[:16], 16), int(v[16:], 16))
        if kind.startswith("Array("):
            return varint(len(v)) + b"".join(one(x, kind[6:-1]) for x in v)
        return struct.pack(_BINARY[kind][1], v)

    return b"".join(one(v, k) for r in rows for v, k in zip(r, kinds))


def rowbinary_rows(binary: DataFrame, columns: list[tuple[str, T, str]]) -> DataFrame:
    """Rows of a DataFrame with a binary ``content``; each file is one task's input."""
    kinds = [k for _, _, k in columns]
    types = [t for _, t, _ in columns]
    schema = S.StructType([S.StructField(n, spark_type(t)) for n, t, _ in columns])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidegauge.plans.planner import to_spark

        names = [n for n, _, _ in columns]
        for pdf in frames:
            for data in pdf["content"]:
                rows = []
                for r in decode_rowbinary(bytes(data), kinds):
                    rows.append([to_spark(v, t) for v, t in zip(r, types)])
                    if len(rows) >= 10_000:
                        yield frame(rows, names)
                        rows = []
                if rows:
                    yield frame(rows, names)

    def frame(rows: list[list], names: list[str]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    return binary.select("content").mapInPandas(run, schema)


# -- the READ operation -----------------------------------------------------------


def read(spark: SparkSession, op: Read, run: Any, stream: bool = False) -> DataFrame:
    where = run.constant(op.where)
    if op.kind == "kafka" and where in run.engine.topics:
        return decode_messages(run.engine.topics[where], op)
    if op.kind == "kafka":
        return kafka(spark, where, op, run)
    o = {k: run.constant(v) if k in ("preprocess", "delete") else v for k, v in op.options.items()}
    if o.get("preprocess") and not re.fullmatch(r"\s*(zcat|gzip -dc|gunzip -c|bzcat|zstdcat|cat)\s*", o["preprocess"]):
        raise LanguageError("PREPROCESS WITH: only decompression is done by the reader; stage other commands' output first")
    if op.fmt == "rowbinary":
        columns = names_and_types(o["names_and_types"])
        return rowbinary_rows(spark.read.format("binaryFile").load(where), columns)
    if o.get("delete") and not stream:
        raise LanguageError("THEN DELETE needs a stream: Engine(watch=True) reads files as they come")
    columns = op.columns or [(n, t) for n, t, _ in names_and_types(o["names_and_types"])]
    return read_csv(spark, where, columns, o, stream)


def kafka(spark: SparkSession, topic: str, op: Read, run: Any) -> DataFrame:
    """A stream of decoded messages; librdkafka's option names get Spark's prefix."""
    import json

    options = {k: str(run.constant(v)) for k, v in op.options.get("kafka", {}).items()}
    servers = options.pop("metadata.broker.list", options.pop("bootstrap.servers", "localhost:9092"))
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("startingOffsets", "latest")
    for k, v in options.items():
        reader = reader.option(f"kafka.{k}", v)
    if op.options.get("partitions") is not None:
        parts = run.constant(op.options["partitions"])
        reader = reader.option("assign", json.dumps({topic: parts if isinstance(parts, list) else [parts]}))
    else:
        reader = reader.option("subscribe", topic)
    return decode_messages(reader.load(), op)


def decode_messages(messages: DataFrame, op: Read) -> DataFrame:
    """Rows of messages with a binary ``value``, by the format of the operation."""
    if op.fmt == "rowbinary":
        return rowbinary_rows(messages.select(F.col("value").alias("content")), names_and_types(op.options["names_and_types"]))
    lines = messages.select(F.explode(F.split(F.col("value").cast("string"), "\r?\n")).alias("line")).filter(F.length("line") > 0)
    o = csv_options(op.options)
    o.pop("header"), o.update(mode="PERMISSIVE")
    parsed = lines.select(F.from_csv("line", raw_schema(op.columns).simpleString()[7:-1].replace(":", " "), o).alias("r")).select("r.*")
    return typed(parsed, op.columns, op.options)


# -- sinks -------------------------------------------------------------------------


def convert(spark: SparkSession, source: str, source_format: str, target: str, target_format: str, columns: list[tuple[str, T]] | None = None) -> None:
    """From one file format to another (csv, orc, parquet, json)."""
    if source_format == "csv":
        if not columns:
            raise LanguageError("CSV needs a schema")
        df = read_csv(spark, source, columns, {})
    else:
        df = spark.read.format(source_format).load(source)
    if target_format == "csv":
        df = df.select(*[F.col(c).cast("string") if not isinstance(df.schema[c].dataType, (S.NumericType, S.StringType, S.BooleanType)) else F.col(c) for c in df.columns])
    df.write.mode("overwrite").format(target_format).save(target)


__all__ = ["INTS", "convert", "decode_messages", "decode_rowbinary", "encode_rowbinary", "names_and_types", "read", "read_csv"]
