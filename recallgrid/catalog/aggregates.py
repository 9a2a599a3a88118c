"""2.D aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import lexical, stats
from ..operators.links import outcomes_by_type
from ..operators.similarity import MAX_BROADCAST_ROWS
from ..plans import hybrid
from ..session import scratch_path
from ..sources.chunk_store import live
from ..sources.views import T0
from .base import query
from .joins import OUTCOMES, advisories, outcomes

LIVE = "deleted_at is null and is_latest"
HEALTH = f"""count(*) filter (where deleted_at is not null) as deleted,
  count(*) filter (where deleted_at is null and not is_latest) as superseded,
  count(*) filter (where {LIVE}) as memories, count(*) filter (where {LIVE} and level <= 0) as l0,
  count(*) filter (where {LIVE} and level > 0) as l1, count(*) filter (where {LIVE} and level <= 0 and not consolidated) as awaiting,
  count(*) filter (where {LIVE} and v.id is not null) as embedded, min(timestamp) filter (where {LIVE}) as oldest,
  max(timestamp) filter (where {LIVE}) as newest,
  count(*) filter (where {LIVE} and fact_type = 'preference_or_decision') as preferences,
  count(*) filter (where {LIVE} and fact_type = 'event') as event_facts,
  count(*) filter (where {LIVE} and not has_meta) as unclassified,
  count(*) filter (where {LIVE} and attributed_to = 'user') as by_user,
  count(*) filter (where {LIVE} and attributed_to = 'assistant') as by_assistant,
  count(*) filter (where {LIVE} and trust_level not in ('a2', 'b')) as trust_a1,
  count(*) filter (where {LIVE} and trust_level = 'a2') as trust_a2, count(*) filter (where {LIVE} and trust_level = 'b') as trust_b
  from chunks left join vectors v using (id)"""


@query("D1_stream_health", "chunks vectors", f"select stream, {HEALTH} group by stream")
def d1(t):
    return stats.stream_health(t.chunks, t.vectors)


@query("D2_streams_with_total", "chunks vectors", f"select coalesce(stream, '_total') as stream, {HEALTH} group by rollup (stream)")
def d2(t):
    return stats.health_with_total(t.chunks, t.vectors)


def _win(kind, name):
    return ", ".join(f"count(*) filter (where type = '{kind}' and age <= {d * 86400}) as {name}_{lab}"
                     for lab, d in (("24h", 1), ("7d", 7), ("30d", 30)))


NOW_D3 = T0 - 5 * 86400


@query("D3_activity_windows", "event_log", f"""
select stream, {_win('store', 'ingests')}, {_win('search', 'searches')},
  round(coalesce(sum(chunk_count) filter (where age <= 86400) * 1e0 / nullif(count(*) filter (where type = 'store' and age <= 86400), 0), 0), 6) as facts_per_ingest_24h,
  count(*) filter (where type = 'store' and age <= 86400 and chunk_count = 0) as empty_24h,
  round(coalesce(sum(chunk_count) filter (where age <= 604800) * 1e0 / nullif(count(*) filter (where type = 'store' and age <= 604800), 0), 0), 6) as facts_per_ingest_7d,
  count(*) filter (where type = 'store' and age <= 604800 and chunk_count = 0) as empty_7d,
  max(sec) filter (where type = 'store') as last_ingest, max(sec) filter (where type = 'search') as last_search
from (select *, {NOW_D3} - sec as age from event_log where sec <= {NOW_D3}) where type in ('store', 'search') group by stream""")
def d3(t):
    """Five days before the end, so future rows exist."""
    return stats.activity(t.events, NOW_D3)


BUCKETS = """b as (select case when type = 'consolidation' then '_global' else stream end as stream, sec // 3600 as hour,
  cast(count(*) filter (where type = 'search') as double) as search_count, cast(count(*) filter (where type = 'store') as double) as store_count,
  round(coalesce(avg(top1), 0), 6) as mean_top1_score,
  round(coalesce(count(*) filter (where result_count = 0) * 1e0 / nullif(count(*) filter (where type = 'search'), 0), 0), 6) as zero_result_rate,
  round(coalesce(count(*) filter (where top1 > 0.65) * 1e0 / nullif(count(*) filter (where type = 'search'), 0), 0), 6) as hit_rate,
  cast(count(*) filter (where type = 'consolidation') as double) as consolidation_count, round(coalesce(sum(cost_usd), 0), 6) as consolidation_cost_usd,
  count(*) filter (where top1 < 0.3) as very_low, count(*) filter (where top1 >= 0.3 and top1 < 0.5) as low,
  count(*) filter (where top1 >= 0.5 and top1 < 0.65) as medium, count(*) filter (where top1 >= 0.65 and top1 < 0.8) as high,
  count(*) filter (where top1 >= 0.8) as very_high
  from event_log where type in ('search', 'store', 'consolidation') group by 1, 2),
m as (select * from (unpivot (select stream, hour, search_count, store_count, mean_top1_score, zero_result_rate, hit_rate, consolidation_count, consolidation_cost_usd from b)
  on search_count, store_count, mean_top1_score, zero_result_rate, hit_rate, consolidation_count, consolidation_cost_usd into name metric value value))"""


@query("D4_hourly_metrics", "event_log", f"with {BUCKETS} select stream, metric, hour, value from m")
def d4(t):
    return stats.hourly_metrics(stats.hourly_buckets(t.events))


@query("D5_score_distribution", "event_log", f"""
with {BUCKETS} select stream, very_low, low, medium, high, very_high from (
  select *, row_number() over (partition by stream order by hour desc) as n from b) where n = 1""")
def d5(t):
    return stats.latest_distribution(stats.hourly_buckets(t.events))


@query("D6_latest_and_cumulative", "event_log", f"""
with {BUCKETS} select stream, metric, max_by(value, hour) as latest, round(sum(value), 6) as cumulative from m group by all""")
def d6(t):
    return stats.latest_and_sum(stats.hourly_metrics(stats.hourly_buckets(t.events)))


@query("D7_metric_trend", "event_log", f"""
with {BUCKETS} select stream, hour * 3600 as ts, value from m where metric = 'hit_rate' and hour >= {T0 // 3600 - 7 * 24}""")
def d7(t):
    return stats.trend(stats.hourly_metrics(stats.hourly_buckets(t.events)), "hit_rate", "7d", T0)


FEEDBACK = "fb as (select stream, value > 15 as useful, k % 5 as rank from event_log where type = 'feedback')"
UTIL = f"""u as (select stream, count(*) as n, round(avg(case when access_count > 0 then 1e0 else 0e0 end), 6) as recall_ratio,
  round(avg(case when access_count = 0 and {T0} - timestamp > 2592000 then 1e0 else 0e0 end), 6) as dead_share from chunks where deleted_at is null group by stream)"""
FRESH = f"""f as (select stream, count(*) filter (where days < 1) as under_1d, count(*) filter (where days >= 1 and days < 7) as d1_to_d7,
  count(*) filter (where days >= 7 and days < 30) as d7_to_d30, count(*) filter (where days >= 30) as over_30d
  from (select stream, greatest(0, {T0} - timestamp) // 86400 as days from chunks where deleted_at is null and access_count > 0) group by stream)"""
MRR = "r as (select stream, count(*) as n, round(avg(1e0 / (rank + 1)), 6) as mrr from fb where useful group by stream)"


def feedback(t):
    return t.events.where("type = 'feedback'").selectExpr("stream", "value > 15 as useful", "k % 5 as rank")


@query("D8_stream_summary", "event_log chunks", f"""
with {BUCKETS}, {FEEDBACK}, {UTIL}, {FRESH}, {MRR},
mm as (select stream, cast(sum(search_count) as bigint) as search_count, max_by(mean_top1_score, hour) as mean_top1_score,
  max_by(zero_result_rate, hour) as zero_result_rate, max_by(hit_rate, hour) as hit_rate, max_by(very_high, hour) as very_high from b group by stream)
select stream, coalesce(u.n, 0) as store_count, coalesce(recall_ratio, 0) as recall_ratio, coalesce(dead_share, 0) as dead_share,
  coalesce(search_count, 0) as search_count, coalesce(mean_top1_score, 0) as mean_top1_score, coalesce(zero_result_rate, 0) as zero_result_rate,
  coalesce(hit_rate, 0) as hit_rate, coalesce(very_high, 0) as very_high, coalesce(under_1d, 0) as under_1d, coalesce(d1_to_d7, 0) as d1_to_d7,
  coalesce(d7_to_d30, 0) as d7_to_d30, coalesce(over_30d, 0) as over_30d, coalesce(mrr, 0) as mrr, 0e0 as regret_rate
from u full outer join mm using (stream) left join f using (stream) left join r using (stream) where stream <> '_global'""")
def d8(t):
    return stats.summary(t.events, t.chunks, feedback(t), T0)


@query("D9_freshness_curve", "chunks", f"with {FRESH} select * from f")
def d9(t):
    return stats.freshness(t.chunks, T0)


@query("D10_utilisation", "chunks", f"with {UTIL} select * from u")
def d10(t):
    return stats.utilisation(t.chunks, T0)


@query("D10_hot_rows", "chunks", """
with h as (select stream, id, row_number() over (partition by stream order by access_count desc, id) as rn, access_count,
  count(*) over (partition by stream) as n from chunks where deleted_at is null)
select stream, id, rn from h where rn <= greatest(1, ceil(n * 0.1)) and access_count > 0""")
def d10h(t):
    return stats.hot_rows(t.chunks).select("stream", "id", "rn")


@query("D11_mean_reciprocal_rank", "event_log", f"with {FEEDBACK}, {MRR} select * from r")
def d11(t):
    return stats.reciprocal_rank(feedback(t))


@query("D12_memory_profile", "chunks vectors event_log", f"""
with c as (select * from chunks where deleted_at is null), q as (select * from event_log where type = 'search' and sec >= {T0 - 604800})
select stream, 'chunks' as item, cast(count(*) as double) as value from c group by all
union all select stream, 'embeddings', count(v.id) from c left join vectors v using (id) group by all
union all select stream, 'density', round(count(*) filter (where timestamp >= {T0 - 604800}) / 7e0, 6) from c group by all
union all select stream, 'topic:' || s, n from (select *, row_number() over (partition by stream order by n desc, s) as rn from (
  select stream, lower(subject) as s, count(*) as n from c where subject is not null group by all)) where rn <= 10
union all select stream, 'queries:' || case when len(string_split(query, ' ')) <= 3 then 'simple' else 'medium' end, count(*) from q group by stream, 2
union all select stream, 'queries_per_day', round(count(*) / 7e0, 6) from q group by stream""")
def d12(t):
    return stats.memory_profile(t.chunks, t.vectors, t.events, T0)


@query("D13_admin_stream_stats", "chunks graph_entities edges", """
with c as (select *, timestamp as updated_at from chunks),
m as (select stream, count(*) filter (where deleted_at is not null) as soft_deleted, count(*) filter (where deleted_at is null) as total,
  count(*) filter (where deleted_at is null and dormant) as dormant,
  count(*) filter (where deleted_at is null and level = 0 and not consolidated) as pending_l0,
  count(*) filter (where deleted_at is null and (not is_latest or supersedes_id is not null)) as contradictions,
  cast(sum(case when deleted_at is null then strlen(content) else 0 end) as bigint) as bytes, min(timestamp) filter (where deleted_at is null) as first_chunk,
  max(timestamp) filter (where deleted_at is null) as last_chunk, max(coalesce(last_implicit_boost, updated_at)) filter (where deleted_at is null) as last_access
  from c group by stream),
l as (select stream, string_agg(k || '=' || v, ',' order by k) as by_level from (select stream, 'L' || level as k, count(*) as v from c where deleted_at is null group by all) group by stream),
ty as (select stream, string_agg(k || '=' || v, ',' order by k) as by_type from (select stream, coalesce(fact_type, 'UNKNOWN') as k, count(*) as v from c where deleted_at is null group by all) group by stream),
ge as (select stream, count(*) as entities from graph_entities group by stream), gd as (select stream, count(*) as edges from edges group by stream)
select stream, coalesce(soft_deleted, 0) as soft_deleted, coalesce(total, 0) as total, dormant, pending_l0, contradictions, bytes, first_chunk, last_chunk, last_access,
  by_level, by_type, coalesce(entities, 0) as entities, coalesce(edges, 0) as edges
from m left join l using (stream) left join ty using (stream) full outer join ge using (stream) full outer join gd using (stream)""")
def d13(t):
    out = stats.admin_stats(t.chunks, t.graph_entities, t.edges)
    for c in ("by_level", "by_type"):
        out = out.withColumn(c, F.expr(f"array_join(transform(map_entries({c}), e -> concat(e.key, '=', e.value)), ',')"))
    return out


@query("D14_memory_quality", "chunks", """
with q as (select stream, count(*) as total, count(*) filter (where not has_meta) as no_meta, count(*) filter (where has_meta and subject is null) as no_subject,
  count(*) filter (where confidence < 0.5) as low_confidence, count(*) filter (where coalesce(agent, '') in ('raw-transcript', 'openclaw-memory')) as raw_transcripts,
  count(*) filter (where len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: len(w) > 0)) < 5) as short
  from chunks where is_latest group by stream),
s as (select *, cast(floor(round(((total - no_meta) / total * 0.4e0 + (total - no_subject - no_meta) / total * 0.3e0 + (1 - raw_transcripts / total) * 0.3e0) * 100, 6)) as bigint) as score from q)
select *, no_meta > total // 3 as advise_reprocess, raw_transcripts > total // 4 as advise_ingest, low_confidence > 10 as advise_consolidate,
  short > 10 as advise_noise, score >= 80 as good from s""")
def d14(t):
    return stats.quality(t.chunks)


@query("D14_quality_breakdown", "chunks", """
select stream, 'level' as by, 'L' || level as value, count(*) as n from chunks where is_latest group by all
union all select stream, 'source', coalesce(agent, 'unknown'), count(*) from chunks where is_latest group by all
union all select stream, 'type', coalesce(fact_type, 'UNKNOWN'), count(*) from chunks where is_latest group by all""")
def d14b(t):
    """Latest rows by level, source and type, all three from one scan."""
    return stats.quality_breakdown(t.chunks)


MECHANISMS = "'graph_walk', 'adjacent', 'temporal'"


def latents(t):
    return t.events.where("type = 'feedback'").selectExpr(
        "stream", "event_id", "concat('d', cast(user_id as string)) as source", "concat('d', cast(k as string)) as target",
        "value / 100 as score", f"element_at(array({MECHANISMS}), cast(k % 3 + 1 as int)) as mechanism", "value > 25 as promoted", "sec")


LATENTS = f"""lt as (select stream, event_id, 'd' || user_id as source, 'd' || k as target, value / 100 as score,
  [{MECHANISMS}][k % 3 + 1] as mechanism, value > 25 as promoted, sec from event_log where type = 'feedback')"""


@query("D15_mechanism_effectiveness", "event_log", f"with {LATENTS} select mechanism, count(*) as n from lt where score > 0.1 group by all")
def d15(t):
    """Every latent scored above .1 counts as consumed."""
    return latents(t).where("score > 0.1").groupBy("mechanism").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("D16_advisory_effectiveness", "event_log", f"""
with {OUTCOMES} select coalesce(advisory_type, '_all') as advisory_type, count(*) as total, count(*) filter (where followed) as followed,
  round(count(*) filter (where followed) / count(*), 6) as rate from ot group by rollup (advisory_type)""")
def d16(t):
    return stats.effectiveness(outcomes_by_type(outcomes(t), advisories(t)))


@query("D17_latent_stats", "event_log", f"""
with {LATENTS}, p as (select stream, count(*) as promotions from lt where promoted and score > 0.3 group by stream),
c as (select stream, count(*) as consumed from event_log where type = 'store' group by stream)
select stream, count(*) as total, count(*) filter (where promoted) as promoted, coalesce(promotions, 0) as promotions, coalesce(consumed, 0) as consumed,
  round(count(*) filter (where promoted) / count(*), 6) as rate from lt left join p using (stream) left join c using (stream) group by stream, promotions, consumed""")
def d17(t):
    x = latents(t)
    return stats.latent_stats(x, x.where("promoted and score > 0.3"), t.events.where("type = 'store'"))


def calls(t):
    return t.events.where("type = 'consolidation'").selectExpr(
        "sec div 86400 as day", "stream as workspace", "concat('m', cast(k % 6 as string)) as model", "k * 1000 as tokens")


def prices(t):
    return t.raw("region").selectExpr("concat('m', cast(r_regionkey as string)) as model", "(r_regionkey + 1) / 100e0 as usd_per_1k")


COSTS = """cl as (select sec // 86400 as day, stream as workspace, 'm' || (k % 6) as model, k * 1000 as tokens from event_log where type = 'consolidation'),
pr as (select 'm' || r_regionkey as model, (r_regionkey + 1) / 100e0 as usd_per_1k from region),
dc as (select day, coalesce(workspace, '_all') as workspace, round(sum(coalesce(tokens / 1000e0 * usd_per_1k, 0)), 6) as usd, cast(sum(tokens) as bigint) as tokens
  from cl left join pr using (model) group by grouping sets ((day, workspace), (day)))"""


@query("D18_daily_costs", "event_log", f"with {COSTS} select * from dc")
def d18(t):
    return stats.daily_costs(calls(t), prices(t))


@query("D19_cost_anomaly", "event_log", f"""
with {COSTS}, w as (select *, round(coalesce(avg(usd) over (partition by workspace order by day range between 7 preceding and 1 preceding), 0), 6) as mean7 from dc)
select day, workspace, usd, mean7, case when usd >= 6 then 'log_only' when usd / 6 >= 0.95 then 'associations_disabled' when usd / 6 >= 0.8 then 'reranker_disabled' else 'normal' end as tier,
  case when usd >= 6 then 'budget' when usd > mean7 * 3 then 'anomaly' else 'none' end as alert from w""")
def d19(t):
    return stats.cost_alerts(stats.daily_costs(calls(t), prices(t)), 6.0, 3.0).drop("tokens")


@query("D20_corpus_statistics", "chunks doc_tokens", """
select stream, token, count(distinct id) as df from (select c.stream, t.id, token from doc_tokens t join chunks c using (id)) group by all
union all select stream, '_docs', count(*) from chunks where deleted_at is null group by all""")
def d20(t):
    p = lexical.postings(live(t.chunks))
    docs = live(t.chunks).groupBy("stream").agg(F.count("*").alias("df")).withColumn("token", F.lit("_docs"))
    return p.groupBy("stream", "token").agg(F.count("*").alias("df")).unionByName(docs)


@query("D21_manifest_stats", "chunks vectors", """
select stream, count(*) as memories, count(v.id) as embeddings, count(distinct v.label) as clusters, max(timestamp) as last_update
from chunks left join vectors v using (id) where deleted_at is null group by stream""")
def d21(t):
    v = t.vectors.select("id", "label", F.lit(1).alias("v"))
    return live(t.chunks).select("id", "stream", "timestamp").join(v, "id", "left").groupBy("stream").agg(
        F.count("*").alias("memories"), F.count("v").alias("embeddings"), F.count_distinct("label").alias("clusters"),
        F.max("timestamp").alias("last_update"))


NOW_D22 = T0 - 86400 * 3


@query("D22_failures_last_hour", "event_log", f"""
with k as (select kind, count(*) as n from event_log where type = 'llm_failure' and sec > {NOW_D22 - 3600} and sec <= {NOW_D22} group by kind)
select * from k union all select '_total', coalesce(cast(sum(n) filter (where kind <> 'extraction_empty') as bigint), 0) from k""")
def d22(t):
    return stats.failures_last_hour(t.events, NOW_D22)


@query("D23_graph_counts", "graph_entities edges", """
select 'entities' as what, count(*) as n from graph_entities union all select 'edges', count(*) from edges""")
def d23(t):
    a = t.graph_entities.agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), "n")
    return a.unionByName(t.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


@query("D24_active_streams", "chunks", "select distinct stream from chunks where deleted_at is null")
def d24(t):
    return live(t.chunks).select("stream").distinct().orderBy("stream")


@query("D25_observation_merge", "", """
with o as (select conv_id as group_id, turn, case role when 'user' then 'preference' when 'assistant' then 'event' else 'fact' end as type, text as content,
  case turn % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' end as importance, case when turn % 3 <> 0 then (turn % 10) / 10e0 end as confidence,
  case when role = 'assistant' and turn > 1 then '2024-01-' || lpad((turn % 28 + 1)::varchar, 2, '0') end as raw,
  row_number() over (partition by conv_id order by turn) as pos from conversations),
v as (select group_id, max_by(type, (n, type)) as dominant from (select group_id, type, count(*) as n from o group by all) group by all)
select group_id, dominant, md5(string_agg(pos || '. ' || case importance when 'high' then '[!]' when 'medium' then '[*]' else '[.]' end || ' ' || content, chr(10) order by pos)) as content_md5,
  round(coalesce(avg(confidence), 0.7), 6) as confidence,
  case max(case importance when 'high' then 3 when 'medium' then 2 when 'low' then 1 end) when 3 then 1e0 when 2 then 0.5e0 when 1 then 0.1e0 end as importance,
  min_by(raw, pos) filter (where type = 'event' and raw is not null) as event_at_raw
from o join v using (group_id) group by group_id, dominant""")
def d25(t):
    """Each conversation as a reply with one observation per turn."""
    o = t.turns.selectExpr(
        "conv_id", "turn", "case role when 'user' then 'preference' when 'assistant' then 'event' else 'fact' end as type", "text as content",
        "case turn % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' end as importance",
        "case when turn % 3 <> 0 then (turn % 10) / 10e0 end as confidence",
        "case when role = 'assistant' and turn > 1 then concat('2024-01-', lpad(cast(turn % 28 + 1 as string), 2, '0')) end as event_at_raw")
    s = F.sort_array(F.collect_list(F.struct("turn", "type", "content", "importance", "confidence", "event_at_raw")))
    replies = o.groupBy(F.col("conv_id").alias("group_id")).agg(
        F.concat(F.lit("```json\n"), F.to_json(F.struct(s.alias("observations"))), F.lit("\n```")).alias("reply"))
    return stats.merge_observations(replies).withColumn("content_md5", F.md5("content")).drop("content")


@query("D26_association_health", "event_log", f"""
with {BUCKETS}, v as (select stream, count(*) as hours, count(*) filter (where value < 0.35) as below, round(avg(value), 6) as mean from m
  where metric = 'mean_top1_score' and hour >= {T0 // 3600 - 168} and hour <= {T0 // 3600} group by stream)
select *, case when below = hours and hours >= 24 and hours // 24 >= 7 then 'disabled' when (below = hours and hours >= 24) or below > hours // 2 then 'degraded' else 'healthy' end as health from v""")
def d26(t):
    return stats.association_health(stats.hourly_metrics(stats.hourly_buckets(t.events)), T0)


@query("D27_context_sufficiency", "lex_top chunks", """
with a as (select query_id, count(*) as n, count(distinct level) as levels, max(l.score) as top, min(l.score) as bottom from lex_top l join chunks using (id) group by query_id),
s as (select *, round(least(1, n / 20e0 * 0.4 + least(1, levels / 2e0) * 0.3 + case when top > 0 then bottom / top else 0 end * 0.3), 6) as score from a)
select *, case when score >= 0.7 then 'high' when score >= 0.4 then 'medium' else 'low' end as label from s""")
def d27(t):
    hits = hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index).join(t.chunks.select("id", "level"), "id")
    return stats.sufficiency(hits, 20)


@query("D28_entity_digest", "chunks chunk_entity", """
with x as (select id, importance, score, coalesce(name, 'General') as entity from chunks left join (select distinct id, name from chunk_entity) using (id) where deleted_at is null),
g as (select *, row_number() over (order by weight desc, entity) as section from (select entity, round(sum(coalesce(importance, 0)), 6) as weight from x group by entity))
select section, entity, weight, row_number() over (partition by entity order by coalesce(importance, 1) desc, score desc, id) as pos, id
from x join g using (entity) where section <= 8""")
def d28(t):
    d = stats.entity_digest(live(t.chunks), t.chunk_entity, 8)
    return d.withColumn("section", F.col("section").cast("long")).withColumn("pos", F.col("pos").cast("long"))


def truth(t):
    """Which live rows hold each passage.

    A row that does holds all inner words of the passage; only its first and
    last may be parts of words there. So rows are met on the passage's rarest
    inner word among the words that the index counted, and the texts of those
    with all inner words are looked at. A passage without inner words is looked
    for in every text.
    """
    b = t.queries.select("query_id", "text", tokens(F.col("text")).alias("w"))
    b = b.select("query_id", "text", F.expr("array_distinct(slice(w, 2, greatest(0, size(w) - 2)))").alias("inner")).where("text is not null")
    hybrid.ask_for(t.index, t.queries)
    number = t.index.term_df.where("field = 'content'").select("token", F.col("number").cast("int").alias("number"), "df")
    # a passage with a word that no text holds is in none
    words = b.where("size(inner) > 0").select("query_id", F.size("inner").alias("n"), F.explode("inner").alias("token")).join(number, "token")
    passages = words.groupBy("query_id", "n").agg(F.array_sort(F.collect_list("number")).alias("inner"), F.min(F.struct("df", "number")).alias("rarest"))
    passages = passages.where(F.size("inner") == F.col("n")).select("query_id", "inner", F.col("rarest.number").alias("key"))
    passages = F.broadcast(passages) if passages.count() <= MAX_BROADCAST_ROWS else passages
    rows = t.index.texts.select("id", "word", F.explode("word").alias("key")).join(passages, "key")
    found = rows.where(F.size(F.array_intersect("inner", "word")) == F.size("inner")).select("query_id", "id")
    path = scratch_path(t.spark, "candidates")
    found.write.parquet(path)  # a table, so that its size decides the join to the texts
    texts = live(t.chunks).select("id", "content")
    hit = texts.join(t.spark.read.schema(found.schema).parquet(path), "id").join(b.select("query_id", "text"), "query_id")
    short = b.where("size(inner) = 0").drop("inner")
    if not short.isEmpty():
        hit = hit.unionByName(texts.crossJoin(short))
    return hit.where(F.col("content").contains(F.col("text"))).selectExpr("query_id", "concat('c', cast(query_id % 4 as string)) as category", "id")


@query("D29_recall_at_k", "lex_top chunks", """
with tr as (select item_id as query_id, 'c' || (item_id % 4) as category, id from benchmark b, chunks c where deleted_at is null and contains(c.content, b.text)),
best as (select query_id, category, min(rank) as rank from tr left join lex_top using (query_id, id) group by all)
select category, count(*) as cases, round(avg(case when rank <= 1 then 1e0 else 0e0 end), 6) as recall_1, round(avg(case when rank <= 5 then 1e0 else 0e0 end), 6) as recall_5,
  round(avg(case when rank <= 10 then 1e0 else 0e0 end), 6) as recall_10 from best group by category""")
def d29(t):
    return stats.recall_at(hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index), truth(t), (1, 5, 10))


@query("D30_spread_gate", "vec_top", """
select *, case when spread > 0.4 then 'pass' when spread > 0.3 then 'warn' else 'fail' end as status from (
  select query_id, min(sim) as lo, max(sim) as hi, round(max(sim) - min(sim), 6) as spread from vec_top group by query_id)""")
def d30(t):
    return stats.spread_gate(hybrid.vector_search(t.query_vectors, t.vectors, t.chunks, 20), "query_id", "sim")
