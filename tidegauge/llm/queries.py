"""Queries of the problems on identifier sets and corpora, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import frequent, kmv, mixing, quality, tokens
from tidegauge.session import durable
from tidegauge.sources.monitoring import table, usable_messages, with_message

# -- 2: most frequent items ---------------------------------------------------


def _flow_days(spark: SparkSession, d: str, *columns, **also) -> DataFrame:
    flows = table(spark, d, "nf_flow").select("msg_id", *columns)
    return with_message(flows, usable_messages(table(spark, d, "nf_msg"), *also.get("message", ())))


def _items(spark: SparkSession, d: str) -> DataFrame:
    f = _flow_days(spark, d, "addr", "port")
    return f.select("utc_day", F.explode(frequent.items_of({"addr": "addr", "port": "port"})).alias("x")).select(
        "utc_day", "x.field", "x.item"
    )


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return _flow_days(spark, d).groupBy("utc_day").agg(F.count(F.lit(1)).alias("total")).select(
        "utc_day", F.explode(F.array(F.lit("addr"), F.lit("port"))).alias("field"), "total"
    )


DAY_FIELD = ["utc_day", "field"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    most = frequent.most_items(table(spark, d, "nf_flow"), ["addr", "port"])
    return frequent.heavy(_items(spark, d), _totals(spark, d), DAY_FIELD, "item", 0.01, most).select(*DAY_FIELD, "item")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent items of each day and field, with counts and shares."""
    best = frequent.top_k(_items(spark, d), DAY_FIELD, "item", 100)
    return best.join(_totals(spark, d), DAY_FIELD).select(
        *DAY_FIELD, "item", "n", "rank", (F.col("n") / F.col("total")).alias("share")
    )


# -- 3: distinct counts ---------------------------------------------------------


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    """(utc_day, source, addr, counted, h): hashes of the peer's address and port."""
    f = _flow_days(
        spark, d,
        F.get("addr", F.lit(0)).alias("addr"),
        kmv.hashed(F.get("addr", F.lit(1))).alias("_a"),
        kmv.hashed(F.get("port", F.lit(1)).cast("bigint")).alias("_p"),
        message=["source"],
    )
    both = F.array(
        F.struct(F.lit("addr").alias("counted"), F.col("_a").alias("h")),
        F.struct(F.lit("port").alias("counted"), F.col("_p").alias("h")),
    )
    return f.select("utc_day", "source", "addr", F.explode(both).alias("x")).select(
        "utc_day", "source", "addr", "x.counted", "x.h"
    ).filter(F.col("h").isNotNull())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Counts below k are exact, so the threshold of 100 is decided exactly."""
    c = kmv.counts(_contacts(spark, d).filter(F.col("addr").isNotNull()), ["utc_day", "addr", "counted"])
    return c.filter(kmv.estimate(F.col("n"), F.col("kth")) >= 100).select("utc_day", "addr", "counted")


KEYS = ["utc_day", "source", "addr"]
SETS = [[k for i, k in enumerate(KEYS) if m >> i & 1] for m in range(1, 8)]


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct peers and peer ports for days, exporters, senders and all combinations,
    with 95 % bounds.  Map tasks sketch all groupings; one shuffle brings them together.

    Shuffled rows name their grouping and what they count by a byte."""
    contacts = _contacts(spark, d).withColumn("_c", (F.col("counted") == "port").cast("tinyint"))
    parts = kmv.partials(contacts, [*KEYS, "_c"], [[*s, "_c"] for s in SETS])
    n = kmv.counts_of(parts, ["_g", *KEYS, "_c"])
    names = F.array(*[F.lit(",".join(s)) for s in SETS])
    lo, hi = kmv.bounds(F.col("n"), F.col("kth"))
    return n.select(
        F.get(names, F.col("_g").cast("int")).alias("grouping"),
        *KEYS,
        F.when(F.col("_c") == 1, "port").otherwise("addr").alias("counted"),
        kmv.estimate(F.col("n"), F.col("kth")).alias("estimate"),
        lo.alias("lower"),
        hi.alias("upper"),
    )


def p3_merged(spark: SparkSession, d: str) -> DataFrame:
    """Counts of whole days put together from the sketches of exporters' days, and how
    they compare with counting: groups, and whether the true counts lie within the
    bounds for nine groups of ten at least (95 % are expected)."""
    contacts = _contacts(spark, d)
    days = kmv.sketches(contacts, ["utc_day", "source", "counted"])
    merged = {g: kmv.merge(days, [g, "counted"]) for g in ("utc_day", "source")}
    merged["utc_day,source"] = days
    out = None
    for name, sketch in merged.items():
        by = [*name.split(","), "counted"]
        # Null-safe by a hash of the group, which stands for it.
        key = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in by]).alias("_k")
        truth = contacts.select(key, "counted", "h").distinct().groupBy("_k", "counted").agg(F.count(F.lit(1)).alias("true_n"))
        lo, hi = kmv.bounds(F.size("kmv").cast("bigint"), F.element_at("kmv", -1))
        held = sketch.select(key, lo.alias("lo"), hi.alias("hi")).join(truth, "_k").select(
            F.lit(name).alias("grouping"), "counted", "true_n", F.col("true_n").between(F.col("lo"), F.col("hi")).cast("int").alias("in")
        )
        rows = held.groupBy("grouping", "counted").agg(F.count(F.lit(1)).alias("groups"), F.sum("true_n").alias("total"), (F.avg("in") >= 0.9).alias("held"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p3_exporters(spark: SparkSession, d: str) -> DataFrame:
    """Peers and peer ports that each exporter's days share with the day before:
    union, intersection and difference of mergeable sketches, with bounds."""
    keys = ["utc_day", "source", "counted"]
    s = kmv.sketches(_contacts(spark, d).filter(F.col("source").isNotNull()), keys)
    before = s.select((F.col("utc_day") + 1).alias("utc_day"), "source", "counted", F.col("kmv").alias("_b"))
    j = s.join(before, keys)
    both, both_lo, both_hi = kmv.intersection(F.col("kmv"), F.col("_b"))
    new, new_lo, new_hi = kmv.difference(F.col("kmv"), F.col("_b"))
    return j.select(
        *keys, kmv.size_of(kmv.union(F.col("kmv"), F.col("_b"))).alias("either"),
        both.alias("both"), both_lo.alias("both_lower"), both_hi.alias("both_upper"),
        new.alias("new"), new_lo.alias("new_lower"), new_hi.alias("new_upper"),
    )


# -- 8: tokens ------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), ["doc_id"])


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded bytes differ from their text (none)."""
    docs = table(spark, d, "documents")
    back = tokens.decode(tokens.encode(docs.select("doc_id", "text", F.col("text").alias("original")), ["doc_id", "original"]), ["doc_id", "original"])
    same = F.col("bytes") == F.coalesce(F.encode("original", "UTF-8"), F.lit(b""))
    return back.filter(~same).select("doc_id")


# -- 9: mixing --------------------------------------------------------------------


def _mixed(spark: SparkSession, d: str, reachable: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix, and the plan it follows."""
    targets = table(spark, d, "mix_target")
    counted = mixing.counted(table(spark, d, "documents"), targets)
    plan = durable(mixing.plan(counted, targets, reachable))
    return mixing.mix(counted, plan), plan


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the finished mix reports as short."""
    return mixing.report(*_mixed(spark, d)).filter("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mixed(spark, d))


def p9_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The report of the largest mix in which every source with documents has its weight."""
    return mixing.report(*_mixed(spark, d, reachable=True))


# -- 10: quality --------------------------------------------------------------------


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), quality.common_words(table(spark, d, "common_word")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(_stats(spark, d)).select("doc_id")


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_top, p3_found, p3_counts, p3_merged, p3_exporters, p8_ids, p8_roundtrip, p9_found, p9_mix, p9_report, p9_balanced, p10_found, p10_stats,
    )
}

_DAYS = """m AS (SELECT msg_id, source, ts_sec // 86400 AS utc_day FROM nf_msg
 WHERE abs(recv_time - (ts_sec + ts_nsec / 1e9)) <= 86400),
f AS (SELECT f.addr, f.port, m.utc_day, m.source FROM nf_flow f JOIN m USING (msg_id))"""
_ITEMS = f"""{_DAYS},
x AS (SELECT utc_day, 'addr' AS field, unnest(list_distinct(addr)) AS item FROM f
 UNION ALL SELECT utc_day, 'port', unnest(list_distinct(port)) FROM f),
c AS (SELECT utc_day, field, item, count(*) AS n FROM x WHERE item IS NOT NULL GROUP BY ALL),
t AS (SELECT utc_day, count(*) AS total FROM f GROUP BY ALL)"""

SQL = {
    "p2_found": f"WITH {_ITEMS} SELECT utc_day, field, item FROM c JOIN t USING (utc_day) WHERE n >= 0.01 * total",
    "p2_top": f"""WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY utc_day, field ORDER BY n DESC, item) AS rank FROM c)
 SELECT utc_day, field, item, n, rank, n / total AS share FROM r JOIN t USING (utc_day) WHERE rank <= 100""",
    "p3_found": f"""WITH {_DAYS}, x AS (SELECT utc_day, addr[1] AS addr, 'addr' AS counted, addr[2] AS v FROM f
 UNION ALL SELECT utc_day, addr[1], 'port', port[2] FROM f)
 SELECT utc_day, addr, counted FROM x WHERE addr IS NOT NULL GROUP BY ALL HAVING count(DISTINCT v) >= 100""",
    "p3_merged": f"""WITH {_DAYS}, x AS (SELECT utc_day, source, 'addr' AS counted, addr[2] AS v FROM f
 UNION ALL SELECT utc_day, source, 'port', port[2] FROM f),
 n AS (SELECT 'utc_day' AS grouping, counted, count(DISTINCT v) AS n FROM x WHERE v IS NOT NULL GROUP BY utc_day, counted
 UNION ALL SELECT 'source', counted, count(DISTINCT v) FROM x WHERE v IS NOT NULL GROUP BY source, counted
 UNION ALL SELECT 'utc_day,source', counted, count(DISTINCT v) FROM x WHERE v IS NOT NULL GROUP BY utc_day, source, counted)
 SELECT grouping, counted, count(*) AS groups, CAST(sum(n) AS BIGINT) AS total, true AS held FROM n GROUP BY ALL""",
    "p8_roundtrip": "SELECT doc_id FROM documents WHERE false",
}
