"""Archives of functions' output, and replay of the past.

An archive is a Parquet or ORC table partitioned by a bucket of event time, so a
replay reads the partitions of its range only.  Replay picks, for a function,
the nearest archived ancestors that cover the range, and runs the program from
there; ``BEST AFTER`` widens the range read so that windows are warm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.lang.parser import parse
from tidegauge.lang.tree import Aggregate, LanguageError, Program
from tidegauge.plans.planner import Engine

BUCKET = "archive_bucket"


class Archive:
    def __init__(self, spark: SparkSession, root: str, bucket_s: int = 3600, fmt: str = "parquet") -> None:
        self.spark, self.root, self.bucket_s, self.fmt = spark, root.rstrip("/"), bucket_s, fmt

    def path(self, function: str) -> str:
        return f"{self.root}/{function.replace('/', '__')}"

    def write(self, function: str, df: DataFrame, start: str = "start", mode: str = "append") -> None:
        bucket = (F.floor(F.col(start) / self.bucket_s) * self.bucket_s).cast("bigint")
        df.withColumn(BUCKET, bucket).repartition(BUCKET).write.mode(mode).partitionBy(BUCKET).format(self.fmt).save(self.path(function))

    def has(self, function: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(function))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, function: str, since: float, until: float, start: str = "start", stop: str | None = None, longest: float = 0.0) -> DataFrame:
        """Rows with stop >= since and start <= until; ``longest`` bounds an interval's length."""
        lo = (since - longest) // self.bucket_s * self.bucket_s
        df = self.spark.read.format(self.fmt).load(self.path(function))
        df = df.filter((F.col(BUCKET) >= int(lo)) & (F.col(BUCKET) <= int(until)))
        return df.filter((F.col(stop or start) >= since) & (F.col(start) <= until)).drop(BUCKET)

    def expire(self, function: str, before: float) -> None:
        """Drop whole buckets older than a retention."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = fs_path(self.path(function))
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith(f"{BUCKET}=") and name.split("=")[1].lstrip("-").isdigit() and int(name.split("=")[1]) + self.bucket_s <= before:
                fs.delete(s.getPath(), True)


def sources(program: Program, function: str, archived: set[str]) -> set[str]:
    """The nearest archived ancestors from which the function can be recomputed."""
    by_name = {f.name: f for f in program.functions}

    def find(name: str, seen: tuple[str, ...]) -> set[str]:
        if name in archived:
            return {name}
        if name in seen or name not in by_name:
            raise LanguageError(f"nothing archived to replay {name} from")
        op = by_name[name].op
        if not isinstance(op, Aggregate) or not op.parents:
            raise LanguageError(f"nothing archived to replay {name} from")
        out: set[str] = set()
        for p in op.parents:
            if isinstance(p, Aggregate):
                for q in p.parents:
                    out |= find(q, (*seen, name))
            else:
                out |= find(p, (*seen, name))
        return out

    return find(function, ())


def replay(engine: Engine, archive: Archive, text: str, function: str, since: float, until: float, start: str = "start", stop: str | None = None, order: list[str] | None = None) -> DataFrame:
    """The function's output in the range, recomputed from what is archived."""
    program = parse(text)
    names = {f.name for f in program.functions} | set(engine.tables)
    archived = {n for n in names if archive.has(n)}
    best = max((f.best_after or 0.0 for f in program.functions), default=0.0)
    if function in archived:
        return archive.read(function, since, until, start, stop)
    for s in sources(program, function, archived):
        df = archive.read(s, since - best, until, start, stop)
        engine.table(s, df, order or [start])
        program.functions = [f for f in program.functions if f.name != s]
    out = engine.run(program, function)
    return out.filter((F.col(stop or start) >= since) & (F.col(start) <= until))
