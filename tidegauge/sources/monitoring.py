"""Domain views of the monitoring tables: messages, flows and readings.

The terms follow the data description: a *usable* message was received within
a day of its export time; *boot* is the exporter's start in milliseconds since
the epoch; the uptime counters are unsigned 32-bit, so one that exceeds its
message's uptime stems from before a restart at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_S = 86_400
WRAP = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bigint_floor(x: Column, by: float = 1) -> Column:
    return F.floor(x / F.lit(by)).cast("bigint")


def is_usable() -> Column:
    return F.abs(F.col("recv_time") - (F.col("ts_sec") + F.col("ts_nsec") / F.lit(1e9))) <= F.lit(float(DAY_S))


def boot_ms() -> Column:
    return F.col("ts_sec") * 1000 + F.floor(F.col("ts_nsec") / F.lit(1_000_000)).cast("bigint") - F.col("sys_uptime")


def usable_messages(messages: DataFrame, *columns: str) -> DataFrame:
    """Usable messages with ``utc_day`` (of the export second) and ``boot_ms``."""
    return messages.filter(F.col("msg_id").isNotNull() & is_usable()).select(
        "msg_id",
        bigint_floor(F.col("ts_sec"), DAY_S).alias("utc_day"),
        boot_ms().alias("boot_ms"),
        "sys_uptime",
        *columns,
    )


def epoch_ms(counter: str) -> Column:
    """Milliseconds since the epoch of an uptime counter of a joined flow."""
    c = F.col(counter)
    return F.col("boot_ms") + c - F.when(c > F.col("sys_uptime"), F.lit(WRAP)).otherwise(F.lit(0))


def with_message(flows: DataFrame, messages: DataFrame) -> DataFrame:
    """Flows joined with their (unique) message; flows without one are left out.

    An equi-join on the message id: both sides grow, so neither is broadcast by
    hint; the planner may do so by measured size, and splits skewed keys.
    """
    return flows.filter(F.col("msg_id").isNotNull()).join(messages, "msg_id")


def readings(metrics: DataFrame) -> DataFrame:
    """Rows that count as readings, with ``attribute`` = lower(trim(type_instance))."""
    return metrics.filter(
        F.col("host").isNotNull()
        & F.col("plugin_name").isNotNull()
        & (F.size("values") > 0)
        & F.col("time").isNotNull()
        & (F.abs(F.col("recv_time") - F.col("time")) <= F.lit(float(DAY_S)))
    ).withColumn("attribute", F.lower(F.trim("type_instance")))


SERIES = ["host", "plugin_name", "plugin_instance", "type_name", "attribute"]


def series_hash(columns: list[str] = SERIES) -> list[Column]:
    """Two independent 64-bit hashes that stand for the (null-aware) series key.

    A null and an empty string differ; 128 bits make a collision practically
    impossible, and shuffles carry 16 bytes for five strings.
    """
    tagged = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return [F.xxhash64(*tagged).alias("s1"), F.xxhash64(F.lit(7919), *reversed(tagged)).alias("s2")]
