"""Benchmark snapshots kept as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_history(spark: SparkSession, folder: str, schema: str, families: tuple[str, ...]) -> DataFrame:
    """Snapshots whose file name starts with one of `families`, oldest first."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    keep = F.lit(False)
    for f in families:
        keep = keep | name.startswith(f)
    return (
        spark.read.schema(schema).option("recursiveFileLookup", "true").json(folder)
        .withColumn("file", name).where(keep).orderBy("timestamp", "file")
    )
