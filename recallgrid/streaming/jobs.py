"""Stream jobs: metrics, triggers, gaps, ingest, budget, sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import stats
from ..operators.ranking import spread_sums
from ..operators.stats import budget_tier
from ..plans.lifecycle import check_sizes, prepare


def hourly_metrics(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The hourly search and store numbers of every stream as windows close."""
    e = events.withWatermark("ts", late).where("type in ('search', 'store')")
    s = "type = 'search'"
    return e.groupBy(F.window("ts", "1 hour"), "stream").agg(
        F.count_if(F.expr(s)).alias("search_count"), F.count_if(F.expr("type = 'store'")).alias("store_count"),
        F.count_if(F.expr(f"{s} and result_count = 0")).alias("zero_results"), F.count_if(F.expr(f"{s} and top1 > 0.65")).alias("hits"),
        F.round(F.coalesce(F.avg(F.expr(f"case when {s} then top1 end")), F.lit(0.0)), 6).alias("mean_top1_score")).select(
        F.unix_seconds("window.start").alias("start_sec"), "stream", "search_count", "store_count", "zero_results", "hits", "mean_top1_score")


def hourly_rows(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The wide hourly rows of the batch report, rates and `_global` costs among them, as windows close; `hour` is a window."""
    return stats.hourly_buckets(events.withWatermark("ts", late), hour=F.window("ts", "1 hour"))


def all_hourly_metrics(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(stream, metric, hour, value) of every closed hour."""
    rows = hourly_rows(events, late).withColumn("hour", F.unix_seconds("hour.start").cast("long"))
    return stats.hourly_metrics(rows.withColumn("hour", F.floor(F.col("hour") / 3600)))


def daily_from_hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Windows over windows: each closed day of a stream from its closed hours, in one stateful plan.

    Hours with data, searches, stores, the best hourly hit rate and the cost.
    """
    hours = hourly_rows(events, late)
    day = F.window(F.window_time("hour"), "1 day").alias("day")
    return hours.groupBy("stream", day).agg(
        F.count("*").alias("hours"), F.sum("search_count").alias("searches"), F.sum("store_count").alias("stores"),
        F.max("hit_rate").alias("best_hit_rate"), F.round(F.sum("consolidation_cost_usd"), 6).alias("usd")).select(
        F.unix_seconds("day.start").alias("start_sec"), "stream", "hours", "searches", "stores", "best_hit_rate", "usd")


def sliding_failures(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Failures by kind over the last hour, every five minutes."""
    f = events.withWatermark("ts", late).where("type = 'llm_failure'")
    return f.groupBy(F.window("ts", width, slide), "kind").agg(F.count("*").alias("n")).select(
        F.unix_seconds("window.start").alias("start_sec"), "kind", "n")


def gap_filled(searches: DataFrame, stores: DataFrame, seconds: int = 120, late: str = "10 minutes") -> DataFrame:
    """Zero-result searches joined to the stores that follow within `seconds`.

    A time bucket is part of the key, as in the batch form: a row meets those of
    two buckets in the state, not all that its stream has there.
    """
    bucket = lambda ts: F.floor(F.unix_seconds(ts) / max(1, seconds))
    a = searches.where("type = 'search' and result_count = 0").select(F.col("ts").alias("search_ts"), "stream", "event_id").withWatermark("search_ts", late)
    a = a.withColumn("bucket", F.explode(F.array(bucket("search_ts"), bucket("search_ts") + 1)))
    b = stores.where("type = 'store'").select(F.col("ts").alias("store_ts"), F.col("stream").alias("store_stream")).withWatermark("store_ts", late)
    b = b.withColumn("store_bucket", bucket("store_ts"))
    # whole seconds, as in the log
    lo, hi = F.date_trunc("second", "search_ts"), F.date_trunc("second", "store_ts")
    on = (F.col("stream") == F.col("store_stream")) & (F.col("bucket") == F.col("store_bucket")) & (F.col("store_ts") >= F.col("search_ts")) & (
        F.col("store_ts") <= F.col("search_ts") + F.expr(f"interval {seconds + 1} seconds"))
    return a.join(b, on).where((hi > lo) & (F.unix_seconds(hi) - F.unix_seconds(lo) <= seconds)).select("event_id", "stream", "search_ts", "store_ts")


def threshold_trigger(stores: DataFrame, threshold: int, cooldown: int) -> DataFrame:
    """(stream, sec, event_id) of every fire: pending rows reach `threshold` and
    `cooldown` seconds have passed since the last one. State is two numbers.

    `stores(stream, sec, event_id, n)`.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, last = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values(["sec", "event_id"])
        fired = []
        for sec, event_id, n in zip(rows["sec"], rows["event_id"], rows["n"]):
            pending += int(n)
            if pending >= threshold and (last < 0 or sec - last >= cooldown):
                fired.append((key[0], int(sec), int(event_id)))
                pending, last = 0, int(sec)
        state.update((pending, last))
        yield pd.DataFrame(fired, columns=["stream", "sec", "event_id"])

    return stores.groupBy("stream").applyInPandasWithState(
        fold, "stream string, sec long, event_id long", "pending long, last long", "append", GroupStateTimeout.NoTimeout)


def _fires(rows: list[tuple]) -> pd.DataFrame:
    stream, sec, event_id = zip(*rows) if rows else ((), (), ())
    return pd.DataFrame({"stream": pd.Series(stream, dtype=object), "sec": pd.Series(sec, dtype="int64"), "event_id": pd.Series(event_id, dtype="int64")})


class OrderedTrigger(StatefulProcessor):
    """The threshold rule over rows in time order, whichever batch brought them.

    Rows wait, packed by hour, until the watermark passes their hour; its timer
    folds that hour's rows in order. A task holds one hour of one stream.
    """

    def __init__(self, threshold: int, cooldown: int):
        self.threshold, self.cooldown = threshold, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour long", "rows binary")
        self.so_far = handle.getValueState("so_far", "pending long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for hour, part in pdf.groupby(pdf["sec"] // 3600):
                at = (int(hour),)
                before = bytes(self.waiting.getValue(at)[0]) if self.waiting.containsKey(at) else b""
                self.waiting.updateValue(at, (before + part[["sec", "event_id", "n"]].to_numpy(np.int64).tobytes(),))
                self.handle.registerTimer((int(hour) + 1) * 3_600_000)
        yield _fires([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = expiredTimerInfo.getExpiryTimeInMs() // 3_600_000
        pending, last = self.so_far.get() if self.so_far.exists() else (0, -1)
        fired = []
        for hour in sorted(k[0] for k in self.waiting.keys() if k[0] < closed):
            rows = np.frombuffer(bytes(self.waiting.getValue((hour,))[0]), np.int64).reshape(-1, 3)
            for sec, event_id, n in rows[np.lexsort((rows[:, 1], rows[:, 0]))].tolist():
                pending += n
                if pending >= self.threshold and (last < 0 or sec - last >= self.cooldown):
                    fired.append((key[0], sec, event_id))
                    pending, last = 0, sec
            self.waiting.removeKey((hour,))
        self.so_far.update((pending, last))
        yield _fires(fired)

    def close(self) -> None:
        pass


def ordered_trigger(stores: DataFrame, threshold: int, cooldown: int, late: str = "1 hour") -> DataFrame:
    """As `threshold_trigger`, in event time: fires of the hours that the watermark has closed. `stores(stream, ts, sec, event_id, n)`.

    Needs the RocksDB state store.
    """
    return stores.withWatermark("ts", late).groupBy("stream").transformWithStateInPandas(
        statefulProcessor=OrderedTrigger(threshold, cooldown), outputStructType="stream string, sec long, event_id long", outputMode="Append", timeMode="EventTime")


def ingest_stream(incoming: DataFrame, now: int, late: str = "1 day", max_content: int = 102400) -> DataFrame:
    """Arriving rows cleaned, redacted and labelled; repeats of an id dropped.
    `incoming` has the ingest columns and `ts`."""
    fresh = incoming.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return prepare(check_sizes(fresh, max_content).where("reject is null"), now)


def daily_budget(events: DataFrame, cap: float, late: str = "1 hour") -> DataFrame:
    """Running cost of each day and the tier it puts the service in; update mode."""
    c = events.withWatermark("ts", late).where("type = 'consolidation'")
    d = c.groupBy(F.window("ts", "1 day")).agg(F.round(F.sum("cost_usd"), 6).alias("usd"))
    return d.select(F.unix_seconds("window.start").alias("start_sec"), "usd", budget_tier(F.col("usd"), cap).alias("tier"))


def flush_groups(rows: DataFrame, max_items: int, max_tokens: int) -> DataFrame:
    """(items, tokens) of groups of `rows(id, tokens)` in id order: `max_items` rows at most, cut where the running sum passes a multiple of `max_tokens`.

    Running sums over ranges, so a batch of any size is grouped without a queue.
    """
    placed = spread_sums(rows.select("id", "tokens", F.lit(0).alias("all")), "all", [F.col("id")], {"upto": F.col("tokens")})
    return placed.groupBy(F.floor((F.col("pos") - 1) / max_items).alias("a"), F.floor((F.col("upto") - F.col("tokens")) / max_tokens).alias("b")).agg(
        F.count("*").alias("items"), F.sum("tokens").alias("tokens")).select("items", "tokens")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over everything there is now into a Parquet table. In update
    mode each batch's rows are kept with their batch number."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", path).start()
    else:
        q = w.outputMode(mode).foreachBatch(
            lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)).start()
    q.awaitTermination()


def run_flushes(stream: DataFrame, path: str, checkpoint: str, max_items: int, max_tokens: int) -> None:
    """Micro-batches cut into groups."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda df, n: flush_groups(df, max_items, max_tokens).withColumn("batch", F.lit(n)).write.mode("append").parquet(path)).start()
    q.awaitTermination()


def run_daily_sink(stream: DataFrame, path: str, checkpoint: str) -> None:
    """JSON lines by day."""
    day = F.date_format("ts", "yyyy-MM-dd")
    q = stream.withColumn("date", day).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).partitionBy(
        "date").format("json").option("path", path).outputMode("append").start()
    q.awaitTermination()
