"""Scans and sinks of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranking import spread_rank


def live(chunks: DataFrame) -> DataFrame:
    """Both levels, without tombstones."""
    return chunks.where("level in (0, 1) and deleted_at is null")


def of_level(chunks: DataFrame, level: int) -> DataFrame:
    """One level. On a table partitioned by level this prunes partitions."""
    return chunks.where(F.col("level") == level)


def consolidation_eligible(chunks: DataFrame, now: int, min_age: int = 60) -> DataFrame:
    """Raw rows that no job has taken yet, with `rn`, their place in the stream from the oldest on."""
    ready = chunks.where(
        (F.col("level") == 0) & ~F.col("consolidated") & ~F.col("in_progress") & ~F.col("dormant")
        & F.col("deleted_at").isNull() & (F.lit(now) - F.col("timestamp") >= min_age))
    return spread_rank(ready, "stream", [F.col("timestamp"), F.col("id")], "rn")


def in_batches(ready: DataFrame, size: int = 200) -> DataFrame:
    """`ready` with `batch`: every `size` rows of a stream, oldest first, make one."""
    return ready.withColumn("batch", F.expr(f"(rn - 1) div {size}"))


def vector_dimensions(vectors: DataFrame, expected: int | None = None) -> DataFrame:
    """Rows per vector length, and whether the length is the configured one."""
    out = vectors.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
    return out.withColumn("accepted", F.lit(True) if expected is None else F.col("dims") == expected)


def upsert(snapshot: DataFrame, changes: DataFrame, key: str = "id",
           order: tuple[str, ...] = ("updated_at", "seq")) -> DataFrame:
    """New snapshot: the last change of a row replaces it, new rows are added.

    Only the changes are windowed; the snapshot is filtered by an anti join, so
    it is not re-sorted and its wide rows are not aggregated.
    """
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*snapshot.columns)
    return snapshot.join(last.select(key), key, "left_anti").unionByName(last)


def write_snapshot(chunks: DataFrame, path: str) -> None:
    """A full snapshot, partitioned so that level scans prune."""
    chunks.write.mode("errorifexists").partitionBy("level").parquet(path)


def decode_accounting(rows: DataFrame, payload_ddl: str) -> DataFrame:
    """Undecodable rows by the stage that failed, with the first bad row.

    `rows` has `seq` and `line`, an envelope `{"enc": bool, "payload": text}`.
    """
    env = rows.withColumn("env", F.from_json("line", "enc boolean, payload string, _corrupt_record string",
                                             {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad_env = F.col("env._corrupt_record").isNotNull() | F.col("env.payload").isNull()
    text = F.when(F.col("env.enc"), F.expr("cast(try_to_binary(env.payload, 'base64') as string)")).otherwise(
        F.col("env.payload"))
    body = F.from_json(text, payload_ddl + ", _bad string",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    staged = env.withColumn("text", text).withColumn("body", body).withColumn(
        "stage",
        F.when(bad_env, "envelope").when(F.col("text").isNull(), "decrypt")
        .when(F.col("body._bad").isNotNull() | F.col("body").isNull(), "payload").otherwise("ok"))
    return staged.groupBy("stage").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def per_stream_sample(vectors: DataFrame, chunks: DataFrame, n: int, seed: int) -> DataFrame:
    """A fixed-seed sample of `n` vectors per stream; the feature is the sample."""
    w = Window.partitionBy("stream").orderBy("draw", "id")
    return (
        vectors.join(chunks.select("id", "stream"), "id")
        .withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id"))))
        .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    )


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks.select("id"), "id", "left_anti")
