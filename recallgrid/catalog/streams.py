"""2.M streaming and 2.O plug-ins."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from ..functions import plugins
from ..operators import annotate as an, listings, textjobs as tx
from ..operators.similarity import nearest
from ..plans import lifecycle as lc
from ..session import scratch_path
from ..sources import chunk_store
from ..sources.chunk_store import live
from ..sources.views import T0, Tables
from ..streaming import jobs
from .aggregates import BUCKETS
from .base import query
from .texts import FIRST_SQL, TRIM, any_sql, clean_sql
from .lifecycle import redact_sql


class StreamTables(Tables):
    """The same views over files read as a stream."""

    def raw(self, name: str):
        schema = self.spark.read.parquet(f"{self.path}/{name}.parquet").schema
        # a pattern, which matches a file as well as a folder of files: a plain path of a stream must be a folder
        return self.spark.readStream.schema(schema).parquet(f"{self.path}/{name}.parque[t]")


def streamed(t) -> StreamTables:
    return StreamTables(t.spark, t.path)


def ran(t, stream, name: str, mode: str = "append"):
    folder = scratch_path(t.spark, name)
    jobs.run_to_table(stream, f"{folder}/out", f"{folder}/state", mode)
    return t.spark.read.parquet(f"{folder}/out")


@query("M1_hourly_metrics_stream", "event_log", """
with w as (select sec // 3600 * 3600 as start_sec, stream, count(*) filter (where type = 'search') as search_count, count(*) filter (where type = 'store') as store_count,
  count(*) filter (where result_count = 0) as zero_results, count(*) filter (where top1 > 0.65) as hits, round(coalesce(avg(top1), 0), 6) as mean_top1_score
  from event_log where type in ('search', 'store') group by all)
select * from w where start_sec + 3600 <= (select epoch(max(ts)) - 3600 from event_log where type in ('search', 'store'))""")
def m1(t):
    """Windows the watermark has closed; the batch form is D4."""
    return ran(t, jobs.hourly_metrics(streamed(t).events), "metrics")


CLOSED = "(select epoch(max(ts)) - 3600 from event_log where type in ('search', 'store', 'consolidation'))"


@query("M1_all_metrics_stream", "event_log", f"with {BUCKETS} select stream, metric, hour, value from m where hour * 3600 + 3600 <= {CLOSED}")
def m1a(t):
    """All metrics of the batch report, rates and costs included, for the hours the watermark has closed."""
    return ran(t, jobs.all_hourly_metrics(streamed(t).events), "all-metrics")


@query("M1_daily_from_hourly_stream", "event_log", f"""
with {BUCKETS} select cast(hour // 24 * 86400 as bigint) as start_sec, stream, count(*) as hours, sum(search_count) as searches, sum(store_count) as stores,
  max(hit_rate) as best_hit_rate, round(sum(consolidation_cost_usd), 6) as usd from b group by 1, 2 having cast(hour // 24 * 86400 as bigint) + 86400 <= {CLOSED}""")
def m1d(t):
    """Days the watermark has closed, from the stream of closed hours."""
    return ran(t, jobs.daily_from_hourly(streamed(t).events), "daily-metrics")


TRIGGER = """st as (select stream, sec, event_id, chunk_count as n, row_number() over (partition by stream order by sec, event_id) as i from event_log where type = 'store'),
w as (select stream, i, sec, event_id, case when n >= 12 then 0 else n end as pending, case when n >= 12 then sec end as last, n >= 12 as fired from st where i = 1
  union all select st.stream, st.i, st.sec, st.event_id, case when x.f then 0 else w.pending + st.n end, case when x.f then st.sec else w.last end, x.f
  from w join st on st.stream = w.stream and st.i = w.i + 1, lateral (select w.pending + st.n >= 12 and (w.last is null or st.sec - w.last >= 43200) as f) x)"""


@query("M2_threshold_trigger", "event_log", f"with recursive {TRIGGER} select stream, sec, event_id from w where fired")
def m2(t):
    s = streamed(t).events.where("type = 'store'").select("stream", "sec", "event_id", F.col("chunk_count").alias("n"))
    return ran(t, jobs.threshold_trigger(s, 12, 43200), "trigger")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_rocks(spark, run):
    """`run()` with the state store that timers and keyed state need."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(conf, before)


@query("M2_ordered_trigger", "event_log", f"""
with recursive {TRIGGER} select stream, sec, event_id from w where fired and (sec // 3600 + 1) * 3600 <= (select epoch(max(ts)) - 3600 from event_log where type = 'store')""")
def m2o(t):
    """Fires in event time: the same for any cut of the input into batches."""
    s = streamed(t).events.where("type = 'store'").select("stream", "ts", "sec", "event_id", F.col("chunk_count").alias("n"))
    return on_rocks(t.spark, lambda: ran(t, jobs.ordered_trigger(s, 12, 43200), "ordered-trigger"))


@query("M3_micro_batches", "chunks", """
select count(*) as items, cast(sum(strlen(content) // 4 + 1) as bigint) as tokens, 0 as over_cap from chunks""")
def m3(t):
    """Every row is in exactly one group of at most 50 rows."""
    folder = scratch_path(t.spark, "flush")
    s = streamed(t).chunks.select("id", tx.byte_tokens(F.col("content")).alias("tokens"))
    jobs.run_flushes(s, f"{folder}/out", f"{folder}/state", 50, 20000)
    return t.spark.read.parquet(f"{folder}/out").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count_if(F.col("items") > 50).cast("int").alias("over_cap"))


@query("M4_sliding_failures", "event_log", """
with x as (select kind, sec // 300 * 300 - s.s * 300 as start_sec from event_log, range(0, 12) s(s) where type = 'llm_failure')
select start_sec, kind, count(*) as n from x where start_sec + 3600 <= (select epoch(max(ts)) - 600 from event_log where type = 'llm_failure') group by all""")
def m4(t):
    return ran(t, jobs.sliding_failures(streamed(t).events), "failures")


@query("M5_search_store_gap", "event_log", """
select event_id, stream from event_log s where type = 'search' and result_count = 0 and exists (
  select 1 from event_log t where t.type = 'store' and t.stream = s.stream and t.sec > s.sec and t.sec - s.sec <= 120)""")
def m5(t):
    """A stream-stream interval join; the batch form is C13."""
    return ran(t, jobs.gap_filled(streamed(t).events, streamed(t).events), "gaps").select("event_id", "stream").distinct()


@query("M6_ingest_stream", "chunks", f"""
select id, stream, md5({redact_sql(clean_sql('content'))}) as content_md5, case agent when 'mcp' then 'a2' when 'external_web' then 'b' when 'raw-transcript' then 'b' else 'a1' end as trust_level from chunks""")
def m6(t):
    """Every row arrives twice and is kept once, long ones too."""
    s = streamed(t)
    rows = lambda c: c.select("id", "content", F.lit("{}").alias("metadata"), "stream", F.col("source.agent").alias("agent"), F.timestamp_seconds("timestamp").alias("ts"))
    both = rows(s.chunks).union(rows(streamed(t).chunks))
    return ran(t, jobs.ingest_stream(both, T0, late="60 days", max_content=2**31 - 1), "ingest").select("id", "stream", F.md5("content").alias("content_md5"), "trust_level")


@query("M7_budget_gate", "event_log", """
select sec // 86400 * 86400 as start_sec, round(sum(cost_usd), 6) as usd, case when round(sum(cost_usd), 6) / 0.05 >= 1 then 'log_only' when round(sum(cost_usd), 6) / 0.05 >= 0.95 then 'associations_disabled'
  when round(sum(cost_usd), 6) / 0.05 >= 0.8 then 'reranker_disabled' else 'normal' end as tier from event_log where type = 'consolidation' group by 1""")
def m7(t):
    out = ran(t, jobs.daily_budget(streamed(t).events, 0.05), "budget", "update")
    return out.groupBy("start_sec").agg(F.max_by(F.struct("usd", "tier"), "batch").alias("s")).select("start_sec", "s.usd", "s.tier")


@query("M8_event_sink", "event_log", """
select strftime(make_timestamp(sec * 1000000), '%Y-%m-%d') as date, type, count(*) as n from event_log group by all""")
def m8(t):
    folder = scratch_path(t.spark, "sink")
    jobs.run_daily_sink(streamed(t).events.select("ts", "type", "stream", "query"), f"{folder}/out", f"{folder}/state")
    return t.spark.read.schema("type string, date string").json(f"{folder}/out").groupBy("date", "type").agg(F.count("*").alias("n"))


# ---- 2.O -----------------------------------------------------------------

SENT = "list_filter(list_transform(regexp_split_to_array(p, '[.!?]'), lambda x: " + TRIM.format("x") + "), lambda x: len(x) > 0)"


@query("O1_text_completion", "chunks", f"""
with c as (select stream, string_agg(content, chr(10) order by rank) as p from (select stream, content, row_number() over (partition by stream order by coalesce(importance, 0) desc, timestamp desc, id) as rank
  from chunks where deleted_at is null) where rank <= 3 group by stream), s as (select stream, p, {SENT} as ss from c)
select stream, md5(case when len(ss) <= 4 then p else ss[1] || '. ' || ss[2] || '. ' || ss[3] || '. ... ' || ss[-1] end) as reply_md5 from s""")
def o1(t):
    """A stream's top contents summed up by the default completer."""
    top = listings.top_contents(t.chunks, 3).join(t.chunks.select("id", "content"), "id")
    p = top.groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda s: s["content"]), "\n").alias("prompt"))
    return plugins.complete(p).select("stream", F.md5("reply").alias("reply_md5"))


@query("O2_classifier", "chunks", """
select id, case when contains(content, '|') then 'index' when len(content) > 5000 then 'article' else 'other' end as label from chunks""")
def o2(t):
    def rules(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "index" if "|" in x else "article" if len(x) > 5000 else "other")
    return plugins.classify(t.chunks.select("id", "content"), rules).select("id", "label")


@query("O3_extraction_plugin", "", f"""
with f as (select conv_id as transcript, turn as part, case when {FIRST_SQL.format('text')} = '' then text else {FIRST_SQL.format('text')} end as s from conversations where text <> '' and turn % 3 <> 2)
select transcript, part, md5(s) as content_md5, 0.9e0 as confidence from f""")
def o3(t):
    """A stand-in chat that answers with each turn's first sentence, and fails on some turns."""
    import re

    def chat(pdf: pd.DataFrame) -> pd.DataFrame:
        def first(text):
            m = re.match(r"(?s)(.*?[.?!])(?:[ \n\t]|\Z)", text)
            return m.group(1) if m else text
        ok = pdf["part"] % 3 != 2
        reply = [json.dumps({"facts": [{"content": first(x), "confidence": 0.9}]}) for x in pdf["text"]]
        return pdf.assign(status=[200 if o else 503 for o in ok], reply=reply)

    req = t.turns.where("text <> ''").select(F.col("conv_id").alias("transcript"), F.col("turn").alias("part"), "text")
    facts, _, _ = an.ingest_replies(plugins.extract(req, chat), 1000000)
    return facts.select("transcript", "part", F.md5("content").alias("content_md5"), "confidence")


@query("O4_blocked_top_k", "qvec vectors", """
select query_id, id, sim from (select *, row_number() over (partition by query_id order by sim desc, id) as rank from (
  select q.query_id, v.id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as sim from qvec q, vectors v)) where rank <= 10""")
def o4(t):
    """The block path, as for a query side too large to send to every task."""
    return nearest(t.query_vectors, t.vectors, 10, block_rows=64).select("query_id", "id", "sim")


@query("O5_grouped_sequential")
def o5(t):
    """Topic groups and how large they are."""
    g = lc.topic_groups(chunk_store.in_batches(chunk_store.consolidation_eligible(live(t.chunks), T0)), t.vectors, 0.3)
    return g.groupBy("stream", "batch", "grp").agg(F.count("*").alias("n"))
