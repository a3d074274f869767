"""Queries of the general data problems over the monitoring tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import grid, intervals, panes, spikes, widen
from tidegauge.sources.monitoring import (
    SERIES,
    epoch_ms,
    readings,
    table,
    usable_messages,
    with_message,
)

GAP_MS = 30_000
DAY_MS = 86_400_000
#: What makes two flow rows of one message copies of each other.
FLOW_CONTENT = [
    "addr", "next_hop", "in_iface", "out_iface", "packets", "bytes", "first", "last", "port",
    "tcp_flags", "ip_proto", "ip_tos", "src_as", "dst_as", "src_mask", "dst_mask",
]
MESSAGE = ["source", "engine_id", "seqnum", "ts_sec", "ts_nsec"]


# -- 1: late and out-of-order events ------------------------------------------


def collectd_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per series and time, received at its least recv_time; its value
    is the first one of the row received first."""
    r = readings(table(spark, d, "collectd_metric"))
    first = F.min(F.struct("recv_time", "metric_id", F.get("values", F.lit(0)).alias("v")))
    return r.groupBy(*SERIES, "time").agg(F.min("recv_time").alias("received"), first.alias("_f")).select(
        F.lit("collectd").alias("stream"),
        F.col("host").alias("entity"),
        F.col("time").alias("event_time"),
        "received",
        F.when(~F.isnan("_f.v") & (F.abs("_f.v") < 1e30), F.col("_f.v")).cast("decimal(38,6)").alias("value"),
    )


def netflow_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per flow of a message (copies of a message and repeated rows
    count once), received with the message's first copy."""
    m = table(spark, d, "nf_msg")
    same = m.filter(F.col("source").isNotNull()).groupBy(*MESSAGE).agg(F.min("recv_time").alias("received"))
    keys = ["source", F.coalesce("engine_id", F.lit(-1)).alias("_e"), F.coalesce("seqnum", F.lit(-1)).alias("_q"), F.coalesce("ts_sec", F.lit(-1)).alias("_s"), F.coalesce("ts_nsec", F.lit(-1)).alias("_n")]
    got = same.select(*keys, "received")
    usable = usable_messages(m.filter(F.col("source").isNotNull()), *keys).join(got, ["source", "_e", "_q", "_s", "_n"])
    flows = table(spark, d, "nf_flow").filter(F.col("last").isNotNull())
    content = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in FLOW_CONTENT]).alias("_c")
    # What makes copies equal travels as one hash, and the rest of a record is the same for all of them.
    one = F.xxhash64("_e", "_q", "_s", "_n", "_c", "last", "boot_ms", "sys_uptime").alias("_copy")
    f = with_message(flows.select("msg_id", "last", "bytes", content), usable).select(
        "source", one, F.xxhash64("_c", "source", "_q").alias("_copy2"), epoch_ms("last").alias("at"), "received", "bytes"
    )
    f = f.groupBy("source", "_copy", "_copy2", "at").agg(F.min("received").alias("received"), F.max("bytes").alias("bytes"))
    return f.select(
        F.lit("netflow").alias("stream"),
        F.col("source").alias("entity"),
        (F.col("at") / 1000).alias("event_time"),
        "received",
        F.col("bytes").cast("decimal(38,6)").alias("value"),
    )


SPEC = panes.Slicing(size=300, slide=300, delay=30, cutoff=3600, tick=30)
STREAM = ["stream", "entity"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods whose published result must be corrected."""
    w = panes.windows(_all_records(spark, d), STREAM, SPEC)
    return w.filter(F.col("late_n") > 0).select("stream", "entity", "period_start")


def _all_records(spark: SparkSession, d: str) -> DataFrame:
    return collectd_records(spark, d).unionByName(netflow_records(spark, d))


def p1_windows(spark: SparkSession, d: str) -> DataFrame:
    w = panes.windows(_all_records(spark, d), STREAM, SPEC)
    return w.withColumns({c: F.col(c).cast("double") for c in ("first_total", "final_total")})


def p1_revisions(spark: SparkSession, d: str) -> DataFrame:
    return panes.revisions(_all_records(spark, d), STREAM, SPEC).withColumn("total", F.col("total").cast("double"))


def p1_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows of an hour every 300 s over the same panes."""
    spec = panes.Slicing(size=3600, slide=300, delay=30, cutoff=3600, tick=30)
    w = panes.windows(_all_records(spark, d), STREAM, spec)
    return w.select("stream", "entity", "period_start", "first_n", "final_n", "late_n", "dropped_n")


# -- 4: implausible spikes ------------------------------------------------------


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.spikes(readings(table(spark, d, "collectd_metric")), table(spark, d, "metric_type"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.confirmed(_flags(spark, d))


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


# -- 5: intervals ---------------------------------------------------------------


def activity(spark: SparkSession, d: str, watched: bool) -> DataFrame:
    """Spans (entity, start, end) in ms of flows by addr[0]; with ``watched`` only
    of the watched addresses (a fixed table, so the filter comes before the join
    with the messages)."""
    flows = table(spark, d, "nf_flow").select("msg_id", F.get("addr", F.lit(0)).alias("entity"), "first", "last")
    flows = flows.filter(F.col("entity").isNotNull() & F.col("first").isNotNull() & F.col("last").isNotNull())
    if watched:
        addresses = table(spark, d, "watched_addr").select(F.col("addr").alias("entity"))
        flows = flows.join(addresses, "entity", "left_semi")
    f = with_message(flows, usable_messages(table(spark, d, "nf_msg")))
    return f.select("entity", epoch_ms("first").alias("start"), epoch_ms("last").alias("end"))


CHUNK_MS = 6 * 3_600_000


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    g = intervals.gaps(activity(spark, d, True), CHUNK_MS)
    same_day = F.floor(F.col("gap_start") / DAY_MS) == F.floor(F.col("gap_end") / DAY_MS)
    return g.filter((F.col("gap_end") - F.col("gap_start") >= GAP_MS) & same_day).select(
        F.col("entity").alias("addr"), F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms")
    )


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(activity(spark, d, False), CHUNK_MS).select(
        F.col("entity").alias("addr"), F.col("period_start").alias("start_ms"), F.col("period_end").alias("end_ms")
    )


# -- 6: regular grid --------------------------------------------------------------


def _grid(spark: SparkSession, d: str, holes_only: bool) -> DataFrame:
    return grid.regular(
        readings(table(spark, d, "collectd_metric")), table(spark, d, "host_info"), holes_only=holes_only
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.missing_slots(_grid(spark, d, True)).select("host", "plugin_name", "slot_start")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, False)


def p6_slots(spark: SparkSession, d: str) -> DataFrame:
    """What readings alone say of the grid: every slot of every channel, with its mean
    where it has a value, and whether there was a reading."""
    g = _grid(spark, d, False)
    kind = F.when(F.col("state") == "observed", "observed").when(F.col("state").startswith("no_value"), "no_value").otherwise("missing")
    return g.select(*grid.CHANNEL, "utc_day", "slot_start", kind.alias("kind"), F.when(F.col("state") == "observed", F.col("value")).alias("value"))


# -- 7: wide tables ---------------------------------------------------------------


def _memory(spark: SparkSession, d: str) -> DataFrame:
    r = readings(table(spark, d, "collectd_metric")).filter(F.col("plugin_name") == "memory")
    return r.select(
        "host",
        F.round(F.col("time") * 1000).cast("bigint").alias("time_ms"),
        "attribute",
        F.get("values", F.lit(0)).alias("value"),
        "recv_time",
        "metric_id",
    )


ENTITY = ["host", "time_ms"]


def _memory_wide(spark: SparkSession, d: str, types: dict[str, str] | None = None) -> DataFrame:
    rows = _memory(spark, d)
    return widen.wide(rows, ENTITY, widen.dictionary(rows), ["recv_time", "metric_id"], types)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _memory_wide(spark, d).select(*ENTITY, F.explode("conflicts").alias("attribute"))


MEMORY_TYPES = {a: "bigint" for a in ("buffered", "cached", "free", "slab_recl", "used")}


def p7_wide(spark: SparkSession, d: str) -> DataFrame:
    w = _memory_wide(spark, d, MEMORY_TYPES)
    return w.withColumn("conflicts", F.array_join("conflicts", ","))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_windows, p1_revisions, p1_hourly, p4_found, p4_flags, p5_found, p5_periods, p6_found, p6_grid, p6_slots, p7_found, p7_wide,
    )
}


# -- SQL ----------------------------------------------------------------------------

_READINGS = """r AS (SELECT *, lower(trim(type_instance)) AS attribute FROM collectd_metric
 WHERE host IS NOT NULL AND plugin_name IS NOT NULL AND len("values") > 0 AND "time" IS NOT NULL
 AND abs(recv_time - "time") <= 86400)"""
_FLOWS = """m AS (SELECT msg_id, source, engine_id, seqnum, ts_sec, ts_nsec, sys_uptime,
 ts_sec * 1000 + ts_nsec // 1000000 - sys_uptime AS boot_ms, ts_sec // 86400 AS utc_day FROM nf_msg
 WHERE abs(recv_time - (ts_sec + ts_nsec / 1e9)) <= 86400),
f AS (SELECT f.*, m.* EXCLUDE (msg_id),
 boot_ms + "first" - CASE WHEN "first" > sys_uptime THEN 4294967296 ELSE 0 END AS start_ms,
 boot_ms + "last" - CASE WHEN "last" > sys_uptime THEN 4294967296 ELSE 0 END AS end_ms
 FROM nf_flow f JOIN m USING (msg_id))"""
_RECORDS = f"""{_READINGS}, {_FLOWS},
c AS (SELECT 'collectd' AS stream, host AS entity, "time" AS t, min(recv_time) AS got,
 arg_min("values"[1], struct_pack(a := recv_time, b := metric_id)) AS v
 FROM r GROUP BY host, plugin_name, plugin_instance, type_name, attribute, "time"),
g AS (SELECT source, engine_id, seqnum, ts_sec, ts_nsec, min(recv_time) AS got FROM nf_msg GROUP BY ALL),
n AS (SELECT DISTINCT 'netflow' AS stream, f.source AS entity, end_ms / 1000.0 AS t, got, f.seqnum, f.engine_id, f.ts_sec, f.ts_nsec,
 {", ".join(f'f."{c}"' for c in FLOW_CONTENT)} FROM f JOIN g ON f.source = g.source
 AND f.engine_id IS NOT DISTINCT FROM g.engine_id AND f.seqnum IS NOT DISTINCT FROM g.seqnum
 AND f.ts_sec = g.ts_sec AND f.ts_nsec = g.ts_nsec WHERE "last" IS NOT NULL),
u AS (SELECT stream, entity, t, got, CASE WHEN isfinite(v) THEN v::DECIMAL(38,6) END AS v FROM c
 UNION ALL SELECT stream, entity, t, got, bytes::DECIMAL(38,6) FROM n),
p AS (SELECT stream, entity, CAST(floor(t / 300) * 300 AS BIGINT) AS period_start, got, v FROM u),
e AS (SELECT *, greatest(0, ceil((got - (period_start + 330)) / 30.0)) AS epoch FROM p)"""

_SPIKES = f"""{_READINGS},
g AS (SELECT * FROM r WHERE type_name IN (SELECT type_name FROM metric_type WHERE ds_type = 'gauge')),
x AS (SELECT metric_id, host, plugin_name, plugin_instance, type_name, attribute, "time", unnest("values") AS v, unnest(range(len("values"))) AS pos FROM g),
y AS (SELECT x.*, (NOT isfinite(v) OR coalesce(v < min_value, false) OR coalesce(v > max_value, false)) AS bad
 FROM x JOIN metric_type t ON t.type_name = x.type_name AND t.value_pos = x.pos AND t.ds_type = 'gauge' WHERE v IS NOT NULL),
c AS (SELECT *, median(v) FILTER (WHERE NOT bad) OVER s AS med, min(v) FILTER (WHERE NOT bad) OVER s AS lo, max(v) FILTER (WHERE NOT bad) OVER s AS hi FROM y
 WINDOW s AS (PARTITION BY host, plugin_name, plugin_instance, type_name, attribute, pos)),
k AS (SELECT *, median(abs(v - med)) FILTER (WHERE NOT bad) OVER (PARTITION BY host, plugin_name, plugin_instance, type_name, attribute, pos) AS mad FROM c),
vary AS (SELECT DISTINCT host, plugin_name, plugin_instance, type_name, attribute FROM k WHERE lo < hi),
ch AS (SELECT *, CASE WHEN "values" IS NOT DISTINCT FROM lag("values") OVER o THEN 0 ELSE 1 END AS chg FROM g
 WINDOW o AS (PARTITION BY host, plugin_name, plugin_instance, type_name, attribute ORDER BY "time", metric_id)),
il AS (SELECT *, sum(chg) OVER (PARTITION BY host, plugin_name, plugin_instance, type_name, attribute ORDER BY "time", metric_id) AS island FROM ch),
rl AS (SELECT *, count(*) OVER (PARTITION BY host, plugin_name, plugin_instance, type_name, attribute, island) AS n FROM il)"""

SQL = {
    "p1_found": f"""WITH {_RECORDS} SELECT DISTINCT stream, entity, period_start FROM p
 WHERE got > period_start + 330 AND got <= period_start + 3900""",
    "p1_windows": f"""WITH {_RECORDS} SELECT stream, entity, period_start,
 count(*) FILTER (WHERE epoch = 0) AS first_n, (sum(v) FILTER (WHERE epoch = 0))::DOUBLE AS first_total,
 count(*) FILTER (WHERE epoch <= 119) AS final_n, (sum(v) FILTER (WHERE epoch <= 119))::DOUBLE AS final_total,
 count(*) FILTER (WHERE epoch BETWEEN 1 AND 119) AS late_n, count(*) FILTER (WHERE epoch > 119) AS dropped_n
 FROM e GROUP BY ALL""",
    "p1_revisions": f"""WITH {_RECORDS}, s AS (SELECT stream, entity, period_start, epoch, count(*) AS n, sum(v) AS total FROM e
 WHERE epoch <= 119 GROUP BY ALL)
 SELECT stream, entity, period_start, row_number() OVER w - 1 AS revision,
 CAST(period_start + 330 + epoch * 30 AS BIGINT) AS published_at,
 CAST(sum(n) OVER w AS BIGINT) AS n, (sum(total) OVER w)::DOUBLE AS total FROM s
 WINDOW w AS (PARTITION BY stream, entity, period_start ORDER BY epoch)""",
    "p1_hourly": f"""WITH {_RECORDS}, x AS (SELECT stream, entity, got, period_start - 300 * j AS period_start
 FROM p, range(12) t(j)), y AS (SELECT *, greatest(0, ceil((got - (period_start + 3630)) / 30.0)) AS epoch FROM x)
 SELECT stream, entity, period_start, count(*) FILTER (WHERE epoch = 0) AS first_n,
 count(*) FILTER (WHERE epoch <= 119) AS final_n, count(*) FILTER (WHERE epoch BETWEEN 1 AND 119) AS late_n,
 count(*) FILTER (WHERE epoch > 119) AS dropped_n FROM y GROUP BY ALL""",
    "p4_found": f"""WITH {_SPIKES}
SELECT metric_id FROM y WHERE bad
UNION SELECT metric_id FROM k WHERE NOT bad AND lo < hi AND abs(v - med) > 12 * mad
UNION SELECT metric_id FROM rl JOIN vary ON rl.host = vary.host AND rl.plugin_name = vary.plugin_name
 AND rl.plugin_instance IS NOT DISTINCT FROM vary.plugin_instance AND rl.type_name IS NOT DISTINCT FROM vary.type_name
 AND rl.attribute IS NOT DISTINCT FROM vary.attribute WHERE n >= 15""",
    "p4_flags": f"""WITH {_SPIKES},
h AS (SELECT k.*, CAST(floor((t."time" % 86400) / 3600) AS INT) AS hour FROM k JOIN r t USING (metric_id)),
w AS (SELECT *, list_sort(list(v) FILTER (WHERE NOT bad) OVER s) AS hv, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY host, plugin_name, plugin_instance, type_name, attribute, pos) AS cnt
 FROM h WINDOW s AS (PARTITION BY host, plugin_name, plugin_instance, type_name, attribute, pos, hour)),
z AS (SELECT *, v - med - coalesce(least(greatest(hv[CAST(ceil(len(hv) / 2.0) AS INT)] - med, -2 * mad), 2 * mad), 0) AS residual FROM w WHERE NOT bad AND lo < hi),
pk AS (SELECT *, (abs(residual) - 4 * mad) / mad AS e FROM z WHERE abs(residual) - 4 * mad > 0),
own AS (SELECT host, plugin_name, plugin_instance, type_name, attribute, pos, count(*) AS n, sum(e) AS se, sum(e * e) AS se2 FROM pk WHERE mad > 0 AND e <= 5 GROUP BY ALL),
al AS (SELECT sum(n) AS n, sum(se) / sum(n) AS m, greatest(sum(se2) / sum(n) - (sum(se) / sum(n)) ** 2, 1e-12) AS s2, (SELECT count(*) FROM z WHERE mad > 0) AS total FROM own),
sh AS (SELECT n AS all_n, m, n / total AS rate, least(greatest((1 - m * m / s2) / 2, -0.5), 0.3) AS shape FROM al),
cu AS (SELECT pk.*, coalesce(own.n, 0) AS n, all_n, CASE WHEN all_n IS NULL OR all_n < 30 THEN 4 * mad ELSE 4 * mad + mad * greatest(
 (coalesce(se, 0) + 10 * m) / (coalesce(own.n, 0) + 10) * (1 - shape) / shape * (((coalesce(own.n, 0) + 10) / (cnt + 10 / rate) / 1e-4) ** shape - 1), 0) END AS cutoff
 FROM pk CROSS JOIN sh LEFT JOIN own ON pk.host = own.host AND pk.plugin_name = own.plugin_name AND pk.plugin_instance IS NOT DISTINCT FROM own.plugin_instance
 AND pk.type_name = own.type_name AND pk.attribute IS NOT DISTINCT FROM own.attribute AND pk.pos = own.pos)
SELECT metric_id, 'implausible' AS rule, CAST(pos AS INT) AS pos, v, NULL::DOUBLE AS centre, NULL::DOUBLE AS scale, NULL::DOUBLE AS cutoff, NULL::VARCHAR AS fit FROM y WHERE bad
UNION ALL SELECT metric_id, 'tail', pos, v, med, mad, cutoff, CASE WHEN mad = 0 OR all_n IS NULL OR all_n < 30 THEN 'none' WHEN n >= 10 THEN 'series' ELSE 'pooled' END FROM cu
 WHERE CASE WHEN all_n IS NULL OR all_n < 30 THEN true ELSE abs(residual) > cutoff END
UNION ALL SELECT metric_id, 'stuck', NULL, NULL, NULL, NULL, n, NULL FROM rl JOIN vary ON rl.host = vary.host AND rl.plugin_name = vary.plugin_name
 AND rl.plugin_instance IS NOT DISTINCT FROM vary.plugin_instance AND rl.type_name IS NOT DISTINCT FROM vary.type_name
 AND rl.attribute IS NOT DISTINCT FROM vary.attribute WHERE n >= 15""",
    "p5_found": f"""WITH {_FLOWS}, s AS (SELECT addr[1] AS addr, start_ms, end_ms FROM f
 WHERE addr[1] IN (SELECT addr FROM watched_addr) AND start_ms IS NOT NULL AND end_ms >= start_ms),
 q AS (SELECT addr, start_ms, max(end_ms) OVER (PARTITION BY addr ORDER BY start_ms, end_ms
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
 SELECT addr, reach AS gap_start_ms, start_ms AS gap_end_ms FROM q
 WHERE start_ms - reach >= 30000 AND reach // 86400000 = start_ms // 86400000""",
    "p5_periods": f"""WITH {_FLOWS}, s AS (SELECT addr[1] AS addr, start_ms, end_ms FROM f
 WHERE addr[1] IS NOT NULL AND start_ms IS NOT NULL AND end_ms >= start_ms),
 q AS (SELECT *, max(end_ms) OVER (PARTITION BY addr ORDER BY start_ms, end_ms
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY addr ORDER BY start_ms, end_ms
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM q)
 SELECT addr, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY addr, k""",
    "p6_found": f"""WITH {_READINGS}, s AS (SELECT DISTINCT host, plugin_name, step_s,
 CAST(floor("time" / 86400) AS BIGINT) AS d, CAST(floor("time" / step_s) AS BIGINT) AS slot FROM r JOIN host_info USING (host)),
 g AS (SELECT *, lead(slot) OVER (PARTITION BY host, plugin_name, d ORDER BY slot) AS nxt FROM s)
 SELECT host, plugin_name, unnest(range(slot + 1, nxt)) * step_s AS slot_start FROM g WHERE nxt > slot + 1""",
    "p6_slots": f"""WITH {_READINGS}, x AS (SELECT host, plugin_name, plugin_instance, type_name, attribute, "time", step_s,
 unnest("values") AS v, unnest(range(len("values"))) AS pos FROM r JOIN host_info USING (host) WHERE step_s > 0),
 c AS (SELECT host, plugin_name, plugin_instance, type_name, attribute, pos, step_s, CAST(floor("time" / 86400) AS BIGINT) AS utc_day,
 CAST(floor("time" / step_s) AS BIGINT) AS slot, avg(v) FILTER (WHERE isfinite(v)) AS v FROM x GROUP BY ALL),
 e AS (SELECT host, plugin_name, utc_day, min(slot) AS lo, max(slot) AS hi FROM c GROUP BY ALL),
 ch AS (SELECT DISTINCT host, plugin_name, plugin_instance, type_name, attribute, pos, step_s, utc_day FROM c),
 s AS (SELECT ch.*, unnest(range(lo, hi + 1)) AS slot FROM ch JOIN e USING (host, plugin_name, utc_day))
 SELECT s.host, s.plugin_name, s.plugin_instance, s.type_name, s.attribute, s.pos, s.utc_day, s.slot * s.step_s AS slot_start,
 CASE WHEN c.slot IS NULL THEN 'missing' WHEN c.v IS NULL THEN 'no_value' ELSE 'observed' END AS kind, c.v AS value
 FROM s LEFT JOIN c ON s.host = c.host AND s.plugin_name = c.plugin_name AND s.plugin_instance IS NOT DISTINCT FROM c.plugin_instance
 AND s.type_name IS NOT DISTINCT FROM c.type_name AND s.attribute IS NOT DISTINCT FROM c.attribute AND s.pos = c.pos
 AND s.utc_day = c.utc_day AND s.slot = c.slot""",
    "p7_found": f"""WITH {_READINGS} SELECT host, CAST(round("time" * 1000) AS BIGINT) AS time_ms, attribute FROM r
 WHERE plugin_name = 'memory' AND isfinite("values"[1]) AND attribute IS NOT NULL
 GROUP BY ALL HAVING count(DISTINCT "values"[1]) > 1""",
    "p7_wide": f"""WITH {_READINGS}, c AS (SELECT host, CAST(round("time" * 1000) AS BIGINT) AS time_ms, attribute,
 arg_min("values"[1], struct_pack(a := recv_time, b := metric_id)) AS v, count(DISTINCT "values"[1]) > 1 AS differing FROM r
 WHERE plugin_name = 'memory' AND isfinite("values"[1]) AND attribute IS NOT NULL GROUP BY ALL)
 SELECT host, time_ms, {", ".join(f"TRY_CAST(trunc(max(v) FILTER (WHERE attribute = '{a}')) AS BIGINT) AS {a}" for a in sorted(MEMORY_TYPES))},
 coalesce(string_agg(attribute, ',' ORDER BY attribute) FILTER (WHERE differing), '') AS conflicts FROM c GROUP BY ALL""",
}
