"""JSON-line logs: events, access records, audit chain, operation audit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .schemas import EVENT_DDL


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed rows of the readable lines; others are skipped."""
    row = F.from_json(column, EVENT_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return (
        lines.withColumn("_row", row)
        .where(F.col("_row").isNotNull() & F.col("_row._corrupt_record").isNull() & F.col("_row.type").isNotNull())
        .select("_row.*").drop("_corrupt_record")
    )


def read_event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.jsonl / *.json file of a folder, day sub-folders included."""
    return parse_event_lines(
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").text(folder))


def read_event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return parse_event_lines(
        spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*")
        .option("maxFilesPerTrigger", files_per_trigger).text(folder))


def append_daily(events: DataFrame, folder: str, sec: str = "timestamp") -> None:
    """One JSON line per event under date=YYYY-MM-DD."""
    day = F.date_format(F.timestamp_seconds(F.col(sec)), "yyyy-MM-dd")
    events.withColumn("date", day).write.mode("append").partitionBy("date").json(folder)


def newest_first(log: DataFrame, key: str, limit: int, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Newest `limit` records per key, with how many older ones are not shown."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    total = log.groupBy(key).agg(F.greatest(F.lit(0), F.count("*") - limit).alias("not_shown"))
    return log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).join(total, key)


def chain(batch: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Adds `prev_hash` and `blob` per target in (ts, seq) order.

    Each row carries the SHA-256 of the blob before it, so a target's rows are
    sequential by definition. Rows stream through sorted partitions holding one
    hash at a time; nothing is gathered per target. `heads(target, last_blob)`
    continues chains that already exist. `batch` needs `body`, the row's text.
    """
    rows = batch if heads is None else batch.join(heads, "target", "left")
    if heads is None:
        rows = rows.withColumn("last_blob", F.lit(None).cast("string"))
    rows = rows.repartition("target").sortWithinPartitions("target", "ts", "seq")
    schema = "target string, ts long, seq long, body string, prev_hash string, blob string"

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        target, prev = None, None
        for pdf in batches:
            hashes, blobs = [], []
            for t, body, last in zip(pdf["target"], pdf["body"], pdf["last_blob"]):
                if t != target:
                    target = t
                    prev = hashlib.sha256(last.encode()).hexdigest() if isinstance(last, str) else None
                blob = f"{body}|{prev or ''}"
                hashes.append(prev)
                blobs.append(blob)
                prev = hashlib.sha256(blob.encode()).hexdigest()
            yield pd.DataFrame({"target": pdf["target"], "ts": pdf["ts"], "seq": pdf["seq"], "body": pdf["body"],
                                "prev_hash": hashes, "blob": blobs})

    return rows.select("target", "ts", "seq", "body", "last_blob").mapInPandas(link, schema)


def verify_chain(rows: DataFrame) -> DataFrame:
    """Per target: chained rows, and the first break.

    A row breaks the chain when its hash is not that of the blob before it, or
    when it has none although an earlier row had one. Rows without a hash before
    the first chained one are the legacy prefix.
    """
    slim = rows.select("target", "ts", "seq", "prev_hash", F.sha2("blob", 256).alias("own"))
    # segments by place, so a target of very many rows is many tasks; only each segment's last hash and counts meet
    cut = cut_lineage(slim.repartitionByRange("target", "ts", "seq").withColumn("segment", F.spark_partition_id()))
    place = F.struct("ts", "seq")
    heads = cut.groupBy("target", "segment").agg(F.count("*").alias("n"), F.max_by("own", place).alias("last"), F.count("prev_hash").alias("hashed"),
                                                 F.min_by(F.col("prev_hash").isNotNull(), place).alias("starts"))
    over = Window.partitionBy("target").orderBy("segment")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("starts").over(over).cast("long")  # the target's first row is of no chain
    heads = heads.select("target", "segment", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"), F.lag("last").over(over).alias("last_before"),
                         (F.coalesce(F.sum("hashed").over(earlier), first) - first).alias("chained_before"), first.alias("skipped"))
    w = Window.partitionBy("target", "segment").orderBy("ts", "seq")
    r = cut.join(heads, ["target", "segment"]).withColumn("idx", F.row_number().over(w) - 1 + F.col("rows_before"))
    r = r.withColumn("want", F.coalesce(F.lag("own").over(w), "last_before"))
    inside = F.count("prev_hash").over(w.rowsBetween(Window.unboundedPreceding, -1)) - F.when((F.col("rows_before") == 0) & (F.col("idx") > 0), F.col("skipped")).otherwise(0)
    entered = F.col("chained_before") + inside > 0
    broken = (F.col("idx") > 0) & (
        (F.col("prev_hash").isNotNull() & (F.col("prev_hash") != F.col("want")))
        | (F.col("prev_hash").isNull() & F.col("entered")))
    r = r.withColumn("entered", entered)
    return r.groupBy("target").agg(
        F.min(F.when(broken, F.col("idx"))).alias("first_break"),
        F.count(F.when((F.col("idx") > 0) & F.col("prev_hash").isNotNull(), 1)).alias("chained"),
        F.count("*").alias("n_rows"),
    ).withColumn("status", F.when(F.col("first_break").isNull(), "valid").otherwise("broken"))
