"""Datagrams of collectd, NetFlow v5 and the Graphite line protocol.

Decoders take whole payloads, so they run over landed files (``binaryFile``), a
message queue or a socket alike: ``decoded`` maps any DataFrame with a binary
``payload`` (and optionally ``sender``, ``received``) to rows, batch or stream.
Payloads that are cut short give the records they hold in full.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

# Schemas of the three listeners.
COLLECTD = (
    "host string, instance string, plugin string, start double, type_instance string, type_name string, "
    "value double, value2 double, value3 double, value4 double, value5 double"
)
NETFLOW = (
    "bytes bigint, dst bigint, dst_as int, dst_mask int, dst_port int, engine_id int, engine_type int, in_iface int, "
    "ip_proto int, ip_tos int, next_hop bigint, out_iface int, packets bigint, sampling_rate int, sampling_type int, "
    "seqnum bigint, source string, src bigint, src_as int, src_mask int, src_port int, start double, stop double, tcp_flags int"
)
GRAPHITE = "metric string, receipt_time double, sender string, start double, tags array<struct<_0:string,_1:string>>, value double"

# NetFlow v5: big-endian header and record.
_HEADER = struct.Struct(">HHIIIIBBH")
_FLOW = struct.Struct(">IIIHHIIIIHHBBBBHHBBH")


def netflow(payload: bytes, sender: str | None = None, received: float | None = None) -> Iterator[dict[str, Any]]:
    """Flows of one export packet; uptime counters become epoch seconds."""
    if len(payload) < _HEADER.size:
        return
    version, count, uptime, secs, nsecs, seq, kind, engine, sampling = _HEADER.unpack_from(payload)
    if version != 5:
        return
    boot = secs + nsecs / 1e9 - uptime / 1e3
    for k in range(count):
        at = _HEADER.size + k * _FLOW.size
        if at + _FLOW.size > len(payload):
            return
        src, dst, hop, inp, out, packets, octets, first, last, sport, dport, _, flags, proto, tos, sas, das, smask, dmask, _ = _FLOW.unpack_from(payload, at)
        wrap = lambda x: x - (1 << 32) if x > uptime else x
        yield {
            "bytes": octets, "dst": dst, "dst_as": das, "dst_mask": dmask, "dst_port": dport, "engine_id": engine, "engine_type": kind,
            "in_iface": inp, "ip_proto": proto, "ip_tos": tos, "next_hop": hop, "out_iface": out, "packets": packets,
            "sampling_rate": sampling & 0x3FFF, "sampling_type": sampling >> 14, "seqnum": seq, "source": sender, "src": src,
            "src_as": sas, "src_mask": smask, "src_port": sport, "start": boot + wrap(first) / 1e3, "stop": boot + wrap(last) / 1e3,
            "tcp_flags": flags,
        }


# Part types of the collectd binary protocol.
_HOST, _TIME, _PLUGIN, _PLUGIN_INSTANCE, _TYPE, _TYPE_INSTANCE, _VALUES, _TIME_HR = 0, 1, 2, 3, 4, 5, 6, 8
_COUNTER, _GAUGE, _DERIVE, _ABSOLUTE = 0, 1, 2, 3


def collectd(payload: bytes, sender: str | None = None, received: float | None = None) -> Iterator[dict[str, Any]]:
    """Metrics of one datagram: parts set the context, each values part is a row."""
    at: int = 0
    ctx: dict[str, Any] = {"host": None, "start": received, "plugin": None, "instance": None, "type_name": None, "type_instance": None}
    names = {_HOST: "host", _PLUGIN: "plugin", _PLUGIN_INSTANCE: "instance", _TYPE: "type_name", _TYPE_INSTANCE: "type_instance"}
    while at + 4 <= len(payload):
        kind, size = struct.unpack_from(">HH", payload, at)
        if size < 4 or at + size > len(payload):
            return
        body = payload[at + 4 : at + size]
        at += size
        if kind in names:
            ctx[names[kind]] = body.rstrip(b"\0").decode("utf-8", "replace") or None
        elif kind == _TIME and len(body) == 8:
            ctx["start"] = float(struct.unpack(">Q", body)[0])
        elif kind == _TIME_HR and len(body) == 8:
            ctx["start"] = struct.unpack(">Q", body)[0] / 2**30
        elif kind == _VALUES and len(body) >= 2:
            n = struct.unpack_from(">H", body)[0]
            if len(body) < 2 + 9 * n:
                continue
            codes, values = body[2 : 2 + n], []
            for k in range(n):
                raw = body[2 + n + 8 * k : 10 + n + 8 * k]
                values.append(struct.unpack("<d" if codes[k] == _GAUGE else ">q" if codes[k] == _DERIVE else ">Q", raw)[0])
            values = [float(v) for v in values[:5]] + [None] * (5 - min(n, 5))
            yield {**ctx, "value": values[0], **{f"value{k + 1}": values[k] for k in range(1, 5)}}


def graphite(payload: bytes, sender: str | None = None, received: float | None = None) -> Iterator[dict[str, Any]]:
    """Lines ``metric[;tag=value...] value [time]``; a missing or negative time is that of receipt."""
    for line in payload.decode("utf-8", "replace").splitlines():
        parts = line.split()
        if len(parts) not in (2, 3):
            continue
        try:
            value = float(parts[1])
            start = float(parts[2]) if len(parts) == 3 else -1.0
        except ValueError:
            continue
        name, *tags = parts[0].split(";")
        pairs = [dict(zip(("_0", "_1"), t.split("=", 1))) for t in tags if "=" in t]
        yield {"metric": name, "receipt_time": received, "sender": sender, "start": received if start < 0 else start, "tags": pairs, "value": value}


DECODERS = {"netflow": (netflow, NETFLOW), "collectd": (collectd, COLLECTD), "graphite": (graphite, GRAPHITE)}


def decoded(datagrams: DataFrame, protocol: str) -> DataFrame:
    """Rows of a batch or stream of datagrams."""
    decode, schema = DECODERS[protocol]
    names = [c.split()[0] for c in schema.replace("array<struct<_0:string,_1:string>>", "x").split(", ")]
    given = [c for c in ("payload", "sender", "received") if c in datagrams.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                if r["payload"] is not None:
                    rows.extend(decode(bytes(r["payload"]), r.get("sender"), r.get("received")))
            if rows:
                yield pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})

    return datagrams.select(*given).mapInPandas(run, schema)
