"""Session helpers shared by operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own session."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only
    where that is unset and the master is local (tests) a temporary one is
    taken, and removed at exit; on a cluster without a shared folder the lineage is
    kept whole.  Spark removes checkpoints that nothing refers to any more where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as it is here.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and sc.master.startswith("local["):
            shared = tempfile.mkdtemp(prefix="tidegauge-ckpt-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        if shared is None:
            return df
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
