"""Listings, layers and pages over memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ranking import top_n

DAY = 86400


def newest_latents(latents: DataFrame, n: int) -> DataFrame:
    """Newest `n` per stream; what is beyond is what eviction drops."""
    return top_n(latents, ["stream"], [F.desc("sec"), F.desc("event_id")], n)


def unpromoted_latents(latents: DataFrame, n: int) -> DataFrame:
    return top_n(latents.where("not promoted"), ["stream"], [F.desc("score"), F.desc("event_id")], n)


def profile_layers(chunks: DataFrame, pins: DataFrame, feedback: DataFrame, now: int, *, most: int, stable: int, recent: int) -> DataFrame:
    """Pins, stable patterns, current focus and feedback of each stream, in order.
    `pins` and `feedback` have stream and id."""
    c = chunks.where("is_latest and not dormant and deleted_at is null").select("id", "stream", "level", "importance", "timestamp", "persistent")
    c = top_n(c, ["stream"], [F.desc(F.coalesce("importance", F.lit(0.0))), F.desc("timestamp"), F.col("id")], most)
    b = c.where("(level >= 1 and coalesce(importance, 0) >= 1.0) or persistent").drop("rank", "level")
    d = c.where(F.expr(f"timestamp >= {now - 7 * DAY} and not persistent")).drop("rank", "level")
    order = [F.desc(F.coalesce("importance", F.lit(0.0))), F.desc("timestamp"), F.col("id")]
    layer = lambda df, name: df.select("stream", F.lit(name).alias("layer"), "id", "rank")
    out = layer(top_n(b, ["stream"], order, stable), "stable").unionByName(layer(top_n(d, ["stream"], order, recent), "recent"))
    for df, name in ((pins, "pinned"), (feedback, "feedback")):
        w = Window.partitionBy("stream").orderBy("id")
        out = out.unionByName(layer(df.select("stream", "id").withColumn("rank", F.row_number().over(w)), name))
    return out


def top_contents(chunks: DataFrame, n: int) -> DataFrame:
    c = chunks.where("deleted_at is null").select("id", "stream", "importance", "timestamp")
    return top_n(c, ["stream"], [F.desc(F.coalesce("importance", F.lit(0.0))), F.desc("timestamp"), F.col("id")], n)


def page(chunks: DataFrame, number: int, per_page: int) -> DataFrame:
    """One page per stream: undated rows first, then by event date, newest first."""
    per_page = max(1, min(200, per_page))
    order = [F.desc_nulls_first("meta.event_date"), F.desc("timestamp"), F.col("id")]
    c = chunks.where("deleted_at is null").select("id", "stream", "timestamp", "meta")
    lo = (max(1, number) - 1) * per_page
    total = c.groupBy("stream").agg(F.count("*").alias("total"))
    return top_n(c, ["stream"], order, lo + per_page, "pos").where(F.col("pos") > lo).join(total, "stream").select("stream", "id", "pos", "total")
