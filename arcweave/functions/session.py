"""Written tables in the folder that all machines share: how iterative plans cut their lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a temporary folder on a single machine and an error on a cluster."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir")
    if not at and not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (at or "file://" + os.path.join(tempfile.gettempdir(), "arcweave-shared")).rstrip("/")


def place(spark: SparkSession, path: str):
    """File system and path of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, at = place(spark, path)
    system.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: survives lost executors, and its size is known to the planner."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def stored(df: DataFrame, name: str) -> DataFrame:
    """df itself if it is what written() gave, else written()."""
    return df if getattr(df, "_written_at", None) else written(df, name)


def written_with(df: DataFrame, name: str, flag: str | None = None) -> tuple[DataFrame, int]:
    """written(), and how many of its rows have the flag (or all): counted while they are written."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.when(F.col(flag), 1) if flag else F.lit(1)).alias("n")), name)
    return table, seen.get["n"]


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        system, at = place(df.sparkSession, df._written_at)
        system.delete(at, True)


def swept(spark: SparkSession) -> None:
    """Let the engine delete the shuffle files of finished plans: it does so when the driver collects their objects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def missing(df: DataFrame) -> bool:
    """Whether df has no rows; reads one at most."""
    return not df.limit(1).count()


class Levels:
    """A growing table as written parts, one for each round, so that a round writes its new rows only.

    Beyond `most` parts, the last ones are merged into one: all that together
    outweigh the part before them.  Each row is so rewritten a logarithmic
    number of times.  Merged parts are deleted a round later, when nothing
    reads them any more; what remains is deleted with the driver's JVM.
    """

    def __init__(self, name: str, merge: Callable[[DataFrame], DataFrame] = lambda df: df, most: int = 8):
        self.name, self.merge, self.most = name, merge, most
        self.parts: list[tuple[DataFrame, int]] = []
        self.old: list[DataFrame] = []

    def add(self, part: DataFrame, n: int) -> None:
        dropped(*self.old)
        self.old = []
        self.parts.append((part, n))
        if len(self.parts) > self.most:
            first, held = len(self.parts) - 2, self.parts[-1][1] + self.parts[-2][1]
            while first and self.parts[first - 1][1] <= held:
                first -= 1
                held += self.parts[first][1]
            self.old = [df for df, _ in self.parts[first:]]
            self.parts[first:] = [written_with(self.merge(self.union(first)), self.name)]

    def union(self, first: int = 0) -> DataFrame:
        out = self.parts[first][0]
        for df, _ in self.parts[first + 1 :]:
            out = out.union(df)
        return out

    def all(self) -> DataFrame:
        """The rows of all parts, merged."""
        return self.merge(self.union()) if len(self.parts) > 1 else self.parts[0][0]

    def count(self) -> int:
        return sum(n for _, n in self.parts)
