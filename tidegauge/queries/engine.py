"""Queries in the stream language over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.plans.planner import Engine
from tidegauge.sources.monitoring import table


def engine(spark: SparkSession, d: str) -> Engine:
    """An engine with the driver's tables; time is seconds in a field ``start``."""
    e = Engine(spark)
    ev = table(spark, d, "events").withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    e.table("events", ev, ["start", "event_id"], ["*"])
    li = table(spark, d, "lineitem").withColumn("start", (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6))
    e.table("lineitem", li, ["start", "l_orderkey", "l_linenumber"], ["*"])
    orders = table(spark, d, "orders").withColumn("start", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6)
    e.table("orders", orders, ["start", "o_orderkey"], ["*"])
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        e.table(name, table(spark, d, name), [key], ["*"])
    e.table("nf_flow", table(spark, d, "nf_flow"), ["flow_id"])
    e.table("collectd", table(spark, d, "collectd_metric").withColumn("start", F.col("time")), ["recv_time", "metric_id"])
    e.table("documents", table(spark, d, "documents"), ["doc_id"])
    return e


def running_program(text: str, function: str = "result", **params) -> Callable[[SparkSession, str], DataFrame]:
    program = text if "DEFINE" in text else f"DEFINE result AS {text}"
    return lambda spark, d: engine(spark, d).run(program, function, **params)


START = "epoch_us(ts) / 1e6"
LSTART = "epoch_us(l_shipdate) / 1e6"
_E = f"e AS (SELECT *, {START} AS start FROM events)"
_L = f"l AS (SELECT *, {LSTART} AS start FROM lineitem)"

#: name -> (program, SQL or None)
PROGRAMS: dict[str, tuple[str, str | None]] = {
    "tumbling_hourly": (
        """FROM events SELECT MIN start AS start, event_type, COUNT event_id AS n, SUM value AS total, AVG value AS mean,
 MAX value AS largest GROUP BY event_type, start // 3600 COMMIT AFTER in.start > out.start + 1.1h""",
        f"""WITH {_E} SELECT min(start) AS start, event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean,
 max(value) AS largest FROM e GROUP BY event_type, trunc(start / 3600)""",
    ),
    "tumbling_weekly": (
        """FROM lineitem SELECT l_suppkey, start // 604800 AS week, SUM l_quantity AS qty, MAX l_extendedprice AS price
 GROUP BY l_suppkey, start // 604800 COMMIT AFTER in.start > (out.week + 2) * 604800""",
        f"""WITH {_L} SELECT l_suppkey, trunc(start / 604800) AS week, sum(l_quantity) AS qty, max(l_extendedprice) AS price
 FROM l GROUP BY ALL""",
    ),
    "map_arithmetic": (
        """FROM lineitem SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS _net, _net * (1 + l_tax) AS charge,
 l_orderkey // 7 AS q, l_orderkey % 7 AS r, -l_linenumber AS neg, (l_discount / l_tax) AS ratio, l_linenumber ^ 2 AS sq,
 TRUNCATE(l_quantity, 10) AS tens, RELDIFF(l_discount, l_tax) AS rel, MIN(l_discount, l_tax) AS low, SQRT l_quantity AS root,
 ROUND l_extendedprice AS rounded, ABS(l_tax - l_discount) AS gap, LOG l_quantity AS ln""",
        """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_orderkey // 7 AS q,
 l_orderkey % 7 AS r, -l_linenumber AS neg,
 CASE WHEN l_tax = 0 THEN CASE WHEN l_discount = 0 THEN NULL ELSE 'inf'::DOUBLE END ELSE l_discount / l_tax END AS ratio,
 l_linenumber * l_linenumber AS sq, floor(l_quantity / 10) * 10 AS tens,
 CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 ELSE abs(l_discount - l_tax) / greatest(l_discount, l_tax) END AS rel,
 least(l_discount, l_tax) AS low, sqrt(l_quantity) AS root, round(l_extendedprice) AS rounded, abs(l_tax - l_discount) AS gap,
 ln(l_quantity) AS ln FROM lineitem""",
    ),
    "map_strings": (
        """FROM part SELECT p_partkey, UPPER p_name AS up, LENGTH p_name AS len, SUBSTRING(p_name, 1, -1) AS mid, p_brand || "/" || p_type AS path,
 BASENAME (p_brand || "/" || p_type) AS base, INDEX(p_name, #\\a) AS at, p_name STARTS WITH "s" AS s, p_type ENDS WITH "L" AS l,
 "x" * p_size AS xs, string(p_size) AS size, i32?(p_brand) AS nothing""",
        """SELECT p_partkey, upper(p_name) AS up, strlen(p_name) AS len, substring(p_name, 2, length(p_name) - 2) AS mid, p_brand || '/' || p_type AS path,
 regexp_extract(p_brand || '/' || p_type, '([^/]*)$', 1) AS base, instr(p_name, 'a') - 1 AS at, starts_with(p_name, 's') AS s, ends_with(p_type, 'L') AS l,
 repeat('x', p_size) AS xs, p_size::VARCHAR AS size, try_cast(p_brand AS INT) AS nothing FROM part""",
    ),
    "filter_predicates": (
        """FROM customer SELECT c_custkey, c_name WHERE c_mktsegment LIKE "%il%" AND c_name NOT LIKE "%7_"
 AND c_nationkey IN [1;2;3;5;8;13;21] AND (c_acctbal > 1000 OR c_acctbal < 0) AND c_name CASE SENSITIVE LIKE "C%" """,
        """SELECT c_custkey, c_name FROM customer WHERE c_mktsegment ILIKE '%il%' AND NOT c_name ILIKE '%7_'
 AND c_nationkey IN (1,2,3,5,8,13,21) AND (c_acctbal > 1000 OR c_acctbal < 0) AND c_name LIKE 'C%'""",
    ),
    "case_coalesce": (
        """FROM collectd SELECT metric_id, COALESCE(host, plugin_name, "none") AS who, type_instance |? "-" AS inst,
 CASE WHEN num_values > 3 THEN "many" WHEN num_values > 1 THEN "some" ELSE "one" END AS size,
 IF num_values = 1 THEN values[0] AS single, values[7] IS NULL AS short, host IS NOT NULL AND plugin_name IS NULL AS odd""",
        """SELECT metric_id, coalesce(host, plugin_name, 'none') AS who, coalesce(type_instance, '-') AS inst,
 CASE WHEN num_values > 3 THEN 'many' WHEN num_values > 1 THEN 'some' ELSE 'one' END AS size,
 CASE WHEN num_values = 1 THEN "values"[1] END AS single, "values"[8] IS NULL AS short,
 host IS NOT NULL AND plugin_name IS NULL AS odd FROM collectd_metric""",
    ),
    "union_parents": (
        """DEFINE a AS FROM customer SELECT c_custkey AS id, c_acctbal AS balance, 1 AS kind;
 DEFINE b AS FROM supplier SELECT s_suppkey AS id, s_acctbal AS balance, s_name AS extra;
 DEFINE result AS FROM a, b SELECT * WHERE balance > 0""",
        """SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 0 UNION ALL
 SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0""",
    ),
    "subquery_star_minus": (
        """FROM (FROM orders SELECT * - o_orderdate - start, o_totalprice * 2 AS double) SELECT double, * - o_totalprice - o_orderstatus WHERE double > 1000""",
        """SELECT o_totalprice * 2 AS double, o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_totalprice * 2 > 1000""",
    ),
    "split_words": (
        """FROM (FROM part SELECT p_partkey, SPLIT(" ", p_name) AS word) SELECT p_partkey, word WHERE word <> "" """,
        """SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''""",
    ),
    "counter_per_key": (
        """DEFINE result AS FROM part SELECT p_brand, COUNT p_partkey AS n GROUP BY p_brand COMMIT AND KEEP ALL AFTER true""",
        """SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part""",
    ),
    "network_cidr": (
        """FROM nf_flow SELECT flow_id, ip4(addr[0]) AS src, BEGIN OF 10.0.0.0/8 AS lo, IPFAMILY ip4(addr[0]) AS family
 WHERE (ip4(addr[0]) IN 10.0.0.0/8 OR ip4(addr[1]) IN [100.64.0.0/10; 198.18.0.0/15]) |? false""",
        """SELECT flow_id, addr[1] AS src, 167772160 AS lo, 4 AS family FROM nf_flow
 WHERE addr[1] >> 24 = 10 OR addr[2] >> 22 = 401 OR addr[2] >> 17 = 25353""",
    ),
    "bits_casts": (
        """FROM nf_flow SELECT flow_id, tcp_flags & 2 AS syn, tcp_flags | 1 AS fin, tcp_flags # 31 AS flip, packets << 2 AS up, bytes >> 3 AS down,
 u8(bytes) AS low, i8(bytes) AS slow, float(packets) AS f, string(in_iface) AS s, u16?("77") AS k, u8(200) + u8(100) AS wrapped, bool(packets) AS b""",
        """SELECT flow_id, tcp_flags & 2 AS syn, tcp_flags | 1 AS fin, xor(tcp_flags, 31) AS flip, packets << 2 AS up, bytes >> 3 AS down,
 bytes % 256 AS low, CASE WHEN bytes % 256 >= 128 THEN bytes % 256 - 256 ELSE bytes % 256 END AS slow, packets::DOUBLE AS f, in_iface::VARCHAR AS s, 77 AS k, 44 AS wrapped, packets <> 0 AS b FROM nf_flow""",
    ),
    "time_functions": (
        """FROM events SELECT event_id, FORMAT_TIME("%Y-%m-%d %H:%M", start) AS minute, PARSE_TIME("2024-01-01") AS day, start - PARSE_TIME("01/01/2024") AS since""",
        f"""WITH {_E} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, 1704067200.0 AS day, start - 1704067200 AS since FROM e""",
    ),
    "running_lag": (
        """FROM events SELECT event_id, LAG value AS lag1, LAG(3, value) AS lag3, MOVEAVG(4, value) AS avg4, SEASON_MOVEAVG(2, 3, value) AS season,
 DERIVE(value, start) AS rate GROUP BY event_type KEEP""",
        f"""WITH {_E} SELECT event_id, lag(value) OVER w AS lag1, lag(value, 3) OVER w AS lag3,
 coalesce(sum(value) OVER (PARTITION BY event_type ORDER BY start, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) / 4 AS avg4,
 (coalesce(lag(value, 2) OVER w, 0) + coalesce(lag(value, 4) OVER w, 0) + coalesce(lag(value, 6) OVER w, 0)) / 3 AS season,
 (value - lag(value) OVER w) / nullif(start - lag(start) OVER w, 0) AS rate FROM e WINDOW w AS (PARTITION BY event_type ORDER BY start, event_id)""",
    ),
    "running_aggregates": (
        """FROM events SELECT event_id, SUM value AS s, COUNT (value > 10) AS big, MIN value AS lo, MAX value AS hi, AVG float(event_id) AS mean,
 FIRST value AS f, AND (value > 0) AS all_pos, OR (value > 50) AS any_big GROUP BY user_id KEEP""",
        f"""WITH {_E} SELECT event_id, sum(value) OVER w AS s, count(*) FILTER (WHERE value > 10) OVER w AS big, min(value) OVER w AS lo, max(value) OVER w AS hi,
 avg(event_id) OVER w AS mean, first(value) OVER w AS f, bool_and(value > 0) OVER w AS all_pos, bool_or(value > 50) OVER w AS any_big
 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "running_selections": (
        """FROM events SELECT event_id, LATEST 3 event_id AS last3, LATEST UP TO 2 event_id AS upto, DISTINCT event_type AS fresh,
 ONE OUT OF 5 event_id AS fifth, ONCE EVERY 1h TUMBLING event_id AS hourly, HYSTERESIS(value, 20, 60) AS ok, REMEMBER(0.01, 1h, event_type, start) AS seen GROUP BY user_id KEEP""",
        f"""WITH {_E} SELECT event_id, CASE WHEN count(*) OVER r >= 3 THEN list(event_id) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS 2 PRECEDING) END AS last3,
 list(event_id) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS 1 PRECEDING) AS upto,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY start, event_id) = 1 AS fresh,
 CASE WHEN (row_number() OVER w - 1) % 5 = 0 THEN event_id END AS fifth,
 CASE WHEN floor(start / 3600) <> lag(floor(start / 3600)) OVER w THEN event_id END AS hourly,
 coalesce(last_value(CASE WHEN value <= 20 THEN true WHEN value > 60 THEN false END IGNORE NULLS) OVER r, true) AS ok,
 coalesce(start - lag(start) OVER (PARTITION BY user_id, event_type ORDER BY start, event_id) <= 3600, false) AS seen
 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id), r AS (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "group_aggregates": (
        """FROM lineitem SELECT l_returnflag, start // 2592000 AS month, MIN l_quantity AS lo, MAX l_quantity AS hi, SUM l_linenumber AS s, AVG l_discount AS d,
 COUNT l_orderkey AS n, COUNT (l_tax > 0.04) AS taxed, COUNT DISTINCT l_suppkey AS suppliers, BITAND l_linenumber AS ba, BITOR l_linenumber AS bo, BITXOR l_linenumber AS bx,
 FIRST l_orderkey AS f, LAST l_orderkey AS l, AND (l_quantity > 1) AS a, OR (l_quantity > 49) AS o, HISTOGRAM(l_quantity, 0, 50, 5) AS h,
 90th PERCENTILE (GROUP l_quantity) AS p90, LARGEST 3 l_quantity BY l_quantity AS top3
 GROUP BY l_returnflag, start // 2592000 COMMIT AFTER in.start > (out.month + 2) * 2592000""",
        f"""WITH {_L} SELECT l_returnflag, trunc(start / 2592000) AS month, min(l_quantity) AS lo, max(l_quantity) AS hi, sum(l_linenumber) AS s, avg(l_discount) AS d,
 count(*) AS n, count(*) FILTER (WHERE l_tax > 0.04) AS taxed, count(DISTINCT l_suppkey) AS suppliers, bit_and(l_linenumber) AS ba, bit_or(l_linenumber) AS bo, bit_xor(l_linenumber) AS bx,
 first(l_orderkey ORDER BY start, l_orderkey, l_linenumber) AS f, last(l_orderkey ORDER BY start, l_orderkey, l_linenumber) AS l,
 bool_and(l_quantity > 1) AS a, bool_or(l_quantity > 49) AS o,
 [count(*) FILTER (WHERE l_quantity < 0)] || [count(*) FILTER (WHERE l_quantity >= 0 AND l_quantity < 10), count(*) FILTER (WHERE l_quantity >= 10 AND l_quantity < 20),
 count(*) FILTER (WHERE l_quantity >= 20 AND l_quantity < 30), count(*) FILTER (WHERE l_quantity >= 30 AND l_quantity < 40), count(*) FILTER (WHERE l_quantity >= 40 AND l_quantity < 50), count(*) FILTER (WHERE l_quantity >= 50)] AS h,
 list_sort(list(l_quantity))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS p90,
 CASE WHEN count(*) >= 3 THEN list_sort(list_slice(list_reverse_sort(list(l_quantity)), 1, 3)) END AS top3
 FROM l GROUP BY l_returnflag, trunc(start / 2592000)""",
    ),
    "count_windows": (
        """FROM events SELECT event_type, COUNT event_id AS n, SUM value AS s, LAST event_id AS l GROUP BY event_type COMMIT AFTER SUM 1 % 25 = 0""",
        f"""WITH {_E}, b AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY start, event_id) - 1) // 25 AS k FROM e)
 SELECT event_type, count(*) AS n, sum(value) AS s, max_by(event_id, (start, event_id)) AS l FROM b GROUP BY event_type, k HAVING count(*) = 25""",
    ),
    "stateful_where": (
        """FROM events SELECT event_id, value WHERE (LAG value < value) |? false""",
        f"""WITH {_E} SELECT event_id, value FROM (SELECT *, lag(value) OVER (ORDER BY start, event_id) AS p FROM e) WHERE p < value""",
    ),
    "changes": (
        """FROM events SELECT event_id, event_type COMMIT AFTER (CHANGED event_type |? true) AND KEEP""",
        f"""WITH {_E} SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY start, event_id) AS p FROM e) WHERE p IS NULL OR p <> event_type""",
    ),
    "islands": (
        """FROM events SELECT event_type, COUNT event_id AS n, FIRST event_id AS f COMMIT BEFORE COALESCE(in.event_type <> FIRST event_type, false)""",
        f"""WITH {_E}, c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY start, event_id) THEN 1 ELSE 0 END AS b FROM e),
 i AS (SELECT *, sum(b) OVER (ORDER BY start, event_id) AS k FROM c)
 SELECT any_value(event_type) AS event_type, count(*) AS n, min_by(event_id, (start, event_id)) AS f FROM i WHERE k < (SELECT max(k) FROM i) GROUP BY k""",
    ),
    "previous_recursion": (
        """FROM events SELECT event_id, value + (previous.total |? 0.) AS total, 1 + (global_last_out.n |? 0) AS n GROUP BY user_id""",
        f"""WITH {_E} SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY start, event_id) AS total, row_number() OVER (ORDER BY start, event_id) AS n FROM e""",
    ),
    "past_sliding": (
        """FROM events SELECT event_id, LENGTH (PAST 1h OF value AT TIME start) AS n, MAX (PAST 1h OF value AT TIME start) AS hi GROUP BY user_id KEEP""",
        f"""WITH {_E} SELECT a.event_id, count(*) AS n, max(b.value) AS hi FROM e a JOIN e b ON a.user_id = b.user_id AND b.start > a.start - 3600
 AND (b.start < a.start OR b.start = a.start AND b.event_id <= a.event_id) GROUP BY a.event_id""",
    ),
    "every_sliding_sessions": (
        """FROM events SELECT event_id, ONCE EVERY 1h event_id AS picked, RECALL(0.1, 2h, event_type, start) AS old GROUP BY user_id KEEP""",
        f"""WITH RECURSIVE {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS k,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY start, event_id) AS j FROM e),
 p AS (SELECT user_id, k, event_id, start AS last, true AS hit FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN o.start >= p.last + 3600 THEN o.start ELSE p.last END, o.start >= p.last + 3600
 FROM p JOIN o ON o.user_id = p.user_id AND o.k = p.k + 1),
 q AS (SELECT user_id, event_type, j, event_id, start AS first, false AS old FROM o WHERE j = 1
 UNION ALL SELECT o.user_id, o.event_type, o.j, o.event_id, CASE WHEN o.start - q.first <= 7200 THEN q.first ELSE o.start END, o.start - q.first <= 7200
 FROM q JOIN o ON o.user_id = q.user_id AND o.event_type = q.event_type AND o.j = q.j + 1)
 SELECT p.event_id, CASE WHEN hit THEN p.event_id END AS picked, old FROM p JOIN q USING (event_id)""",
    ),
    "smoothing": (
        """FROM events SELECT event_id, SMOOTH(0.3, value) AS s, SMOOTH(0.5, 0.3, 0.9, value) AS holt, SMOOTH(0.5, 0.3, 0.2, 6, 0.9, value) AS season, FIT (LATEST 5 value) AS f,
 FIT_MULTI(10, value, event_id, 1) AS m GROUP BY event_type KEEP""",
        f"""WITH RECURSIVE {_E}, o AS (SELECT event_id, event_type, value AS v, row_number() OVER w AS k, lag(value) OVER w AS v1, lag(value, 4) OVER w AS v4
 FROM e WINDOW w AS (PARTITION BY event_type ORDER BY start, event_id)),
 s AS (SELECT event_type, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::DOUBLE AS x, 0.0::DOUBLE AS hl, 0.0::DOUBLE AS hb, 0.0::DOUBLE AS wl, 0.0::DOUBLE AS wb,
 [0, 0, 0, 0, 0, 0]::DOUBLE[] AS ws FROM (SELECT DISTINCT event_type FROM o)
 UNION ALL SELECT event_type, k, event_id, x, level, 0.3 * (level - hl) + 0.7 * 0.9 * hb, wlevel, 0.3 * (wlevel - wl) + 0.7 * 0.9 * wb, ws[2:] || [0.2 * (v - wguess) + 0.8 * ws[1]]
 FROM (SELECT o.event_type, o.k, o.event_id, v, CASE WHEN x IS NULL THEN v ELSE x * 0.7 + v * 0.3 END AS x, hl, hb, 0.5 * v + 0.5 * (hl + 0.9 * hb) AS level,
 wl, wb, ws, wl + 0.9 * wb AS wguess, 0.5 * (v - ws[1]) + 0.5 * (wl + 0.9 * wb) AS wlevel FROM s JOIN o ON o.event_type = s.event_type AND o.k = s.k + 1)),
 m AS (SELECT b.event_id, count(*) AS n, regr_intercept(a.v, a.event_id - b.event_id) AS m, any_value(a.v * (a.event_id * b.event_id + 1) / (a.event_id * a.event_id + 1)) AS one
 FROM o b JOIN o a ON a.event_type = b.event_type AND a.k BETWEEN b.k - 10 AND b.k - 1 GROUP BY b.event_id)
 SELECT event_id, s.x AS s, hl + 0.9 * hb AS holt, wl + 0.9 * wb + ws[1] AS season, CASE WHEN v4 IS NOT NULL THEN v1 + (v1 - v4) / 3 END AS f,
 CASE WHEN m.n IS NULL THEN 0 WHEN m.n = 1 THEN one ELSE m.m END AS m FROM s JOIN o USING (event_id) LEFT JOIN m USING (event_id)""",
    ),
    "heavy_hitters": (
        """FROM events SELECT event_id, LIST TOP 2 event_type AS top, RANK OF event_type IN TOP 2 AS rank, IS event_type IN TOP 2 AS hit""",
        f"""WITH {_E}, o AS (SELECT event_id, event_type, row_number() OVER (ORDER BY start, event_id) AS k FROM e),
 t AS (SELECT event_type AS x, min(k) AS first FROM o GROUP BY ALL),
 c AS (SELECT event_id, event_type, k, x, first, sum(CASE WHEN event_type = x THEN 1 ELSE 0 END) OVER (PARTITION BY x ORDER BY k) AS n FROM o, t),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first) AS rank FROM c WHERE n > 0)
 SELECT event_id, list(x ORDER BY rank) FILTER (WHERE rank <= 2) AS top, max(rank) FILTER (WHERE x = event_type AND rank <= 2) AS rank,
 coalesce(bool_or(x = event_type AND rank <= 2), false) AS hit FROM r GROUP BY event_id""",
    ),
    "sort_buffer": (
        """FROM customer SORT LAST 16 BY c_acctbal, c_custkey SELECT c_custkey, c_acctbal, LAG c_custkey AS before KEEP""",
        """WITH RECURSIVE o AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) AS k FROM customer),
 b AS (SELECT 0::BIGINT AS k, []::STRUCT(v DOUBLE, i BIGINT)[] AS rows, NULL::STRUCT(v DOUBLE, i BIGINT) AS got
 UNION ALL SELECT k, CASE WHEN len(x) >= 16 THEN x[2:] ELSE x END, CASE WHEN len(x) >= 16 THEN x[1] END
 FROM (SELECT o.k, list_sort(list_append(rows, struct_pack(v := o.c_acctbal, i := o.c_custkey))) AS x FROM b JOIN o ON o.k = b.k + 1))
 SELECT got.i AS c_custkey, got.v AS c_acctbal, lag(got.i) OVER (ORDER BY k) AS before FROM b WHERE got IS NOT NULL""",
    ),
    "samples": (
        """FROM events SELECT event_type, LENGTH (SAMPLE(10, value)) AS n, SMALLEST 2 value BY value AS low, start // 86400 AS day GROUP BY event_type, start // 86400 COMMIT AFTER in.start > (out.day + 2) * 86400""",
        f"""WITH {_E} SELECT event_type, least(count(*), 10) AS n, CASE WHEN count(*) >= 2 THEN list_reverse_sort(list_slice(list_sort(list(value)), 1, 2)) END AS low, trunc(start / 86400) AS day FROM e GROUP BY event_type, trunc(start / 86400)""",
    ),
    "immediate_arrays": (
        """FROM collectd SELECT metric_id, SUM values AS s, MAX values AS hi, AVG values AS mean, COUNT values AS n, LAST values AS l, FIRST values AS f, 50th PERCENTILE values AS med""",
        """SELECT metric_id, CASE WHEN len(list_filter("values", lambda x: x IS NOT NULL)) > 0 THEN list_sum("values") END AS s, list_max("values") AS hi, list_avg("values") AS mean, len("values") AS n,
 "values"[-1] AS l, "values"[1] AS f, list_sort("values")[CAST(floor(0.5 * (len("values") - 1) + 0.5) AS INT) + 1] AS med FROM collectd_metric""",
    ),
}

QUERIES = {name: running_program(program) for name, (program, _) in PROGRAMS.items()}
SQL = {name: sql for name, (_, sql) in PROGRAMS.items() if sql}
