"""Session set-up and lineage cutting shared by every job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def build_session(app: str = "recallgrid", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow on. Cluster settings win where present."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a session on one machine (`local[...]`) that names none gets a folder
    of its own; anywhere else executors would not see each other's files there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[sc.applicationId]


#: Folders of sessions on one machine, by application.
_OWN: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of `df` in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, for written tables."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that no later job reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """The table that the rounds of a loop rewrite, as Parquet in the shared folder.

    A checkpoint passes on the estimated size of its plan; where each round joins
    the last one's result to itself, that estimate squares every time, until
    the planner does nothing but multiply. A written table has its files' size.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, scratch_path(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes `df`, which may read the last table, and reads it again; the one before the last goes."""
        return self.keep_counting(df, F.lit(False))[0]

    def keep_counting(self, df: DataFrame, still: Column) -> tuple[DataFrame, int]:
        """As `keep`; also how many rows `still` holds for, counted as they are written."""
        path, seen = f"{self.folder}/{self.n}", Observation()
        df.observe(seen, F.count_if(still).alias("n")).write.parquet(path)
        if self.n > 1:
            drop_folder(self.spark, f"{self.folder}/{self.n - 2}")
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores.

    A no-op wherever the scan already has that many splits, as on large tables.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
