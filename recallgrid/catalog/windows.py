"""2.E windows, top-k, listings; 2.N advisories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import advisories as adv, links, listings, ranking, stats
from ..plans import hybrid
from ..session import scratch_path
from ..sources import event_log
from ..sources.chunk_store import live
from ..sources.views import T0
from .aggregates import BUCKETS, FRESH, FEEDBACK, LATENTS, MRR, UTIL, advisories, feedback, latents, outcomes
from .base import query
from .joins import OUTCOMES, fused
from .oracle_views import VIEWS
from .scans import audit_batch

# candidate pool with its raw channels and chunk columns
VIEWS["pool"] = ("channels chunks", f"""
select query_id, id, lexical_raw, dense_raw, c.* exclude (id, score, content), exp(-greatest(0, ({T0} - timestamp) / 86400e0) / 30) as recency
from channels join chunks c using (id) where deleted_at is null""")
VIEWS["ranks"] = ("pool", """
select *, case when dense_raw > 0 then row_number() over (partition by query_id order by dense_raw desc, id) end as dense_rank,
  case when lexical_raw > 0 then row_number() over (partition by query_id order by lexical_raw desc, id) end as lexical_rank,
  case when recency > 0 then row_number() over (partition by query_id order by recency desc, id) end as recency_rank,
  case when max(dense_raw) over q > 0 then 0.35e0 else 0 end as wd, case when max(lexical_raw) over q > 0 then 0.35e0 else 0 end as wl, 0.08e0 as wr
from pool window q as (partition by query_id)""")
VIEWS["rrf"] = ("ranks", """
select *, round(coalesce(wd / (wd + wl + wr) / (60 + dense_rank), 0) + coalesce(wl / (wd + wl + wr) / (60 + lexical_rank), 0)
  + coalesce(wr / (wd + wl + wr) / (60 + recency_rank), 0), 8) as rrf from ranks""")
DECAY = f"exp(-(case when level = 0 then 0.05e0 else 0.03e0 end) * ({T0} - timestamp) / 86400e0)"
AUTH = "(case provenance when 'evidence' then 0.5e0 when 'cue' then 0.8e0 else 1e0 end * case trust_level when 'a1' then 1e0 when 'a2' then 0.92e0 else 0.8e0 end)"
VIEWS["fused"] = ("pool", f"""
select *, {DECAY} as decay, round((0.6e0 * coalesce(dense_raw / nullif(max(dense_raw) over q, 0), 0) + 0.4e0 * coalesce(lexical_raw / nullif(max(lexical_raw) over q, 0), 0)) * {DECAY} * {AUTH}, 6) as score
from pool window q as (partition by query_id)""")

WEIGHTS = {"dense": 0.35, "lexical": 0.35, "entity": 0.20, "recency": 0.08}


def signal_pool(t):
    """The candidate pool with its four raw channels; the entity one is off."""
    p = hybrid.enrich(fused(t), t.chunks).withColumn("dense", F.col("dense_raw")).withColumn("lexical", F.col("lexical_raw"))
    return p.withColumn("recency", scoring.recency(F.col("timestamp"), T0)).withColumn("entity", F.lit(0.0))


def rrf_pool(t):
    return ranking.rrf(signal_pool(t), {k: F.lit(v) for k, v in WEIGHTS.items()})


@query("E1_channel_ranks", "ranks", "select query_id, id, dense_rank, lexical_rank from ranks")
def e1(t):
    return fused(t).join(live(t.chunks).select("id"), "id", "left_semi").select(
        "query_id", "id", ranking.channel_rank("dense_raw").cast("long").alias("dense_rank"), ranking.channel_rank("lexical_raw").cast("long").alias("lexical_rank"))


@query("E2_rank_fusion", "rrf", "select query_id, id, rrf, row_number() over (partition by query_id order by rrf desc, id) as rank from rrf")
def e2(t):
    return hybrid.ranked(rrf_pool(t).withColumn("score", F.col("rrf"))).select("query_id", "id", "rrf", F.col("rank").cast("long").alias("rank"))


@query("E3_channel_normalisation", "lex_top", "select query_id, id, round(score / max(score) over (partition by query_id), 6) as lexical from lex_top")
def e3(t):
    h = hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index)
    return h.select("query_id", "id", F.round(ranking.max_normalised("score"), 6).alias("lexical"))


def fused_ranked(t):
    return hybrid.ranked(hybrid.weighted_fusion(hybrid.enrich(fused(t), t.chunks), T0))


@query("E4_guaranteed_pool", "fused vec_top", """
with r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from fused)
select query_id, id, rank from r where rank <= 15 or (query_id, id) in (select query_id, id from vec_top where rank <= 5)""")
def e4(t):
    """Head of 15, and the five nearest vectors wherever they rank."""
    sure = hybrid.vector_search(t.query_vectors, t.vectors, t.chunks, 5).select("query_id", "id", F.lit(True).alias("guaranteed"))
    r = fused_ranked(t).join(sure, ["query_id", "id"], "left")
    return ranking.pool_with_guarantee(r, 15).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("E5_top_k", "fused", """
select query_id, id, rank from (select query_id, id, case when query_id % 5 = 0 then row_number() over (partition by query_id order by timestamp, id)
  else row_number() over (partition by query_id order by score desc, id) end as rank from fused) where rank <= 10""")
def e5(t):
    """Every fifth query counts as temporal and is ordered by time."""
    p = hybrid.weighted_fusion(hybrid.enrich(fused(t), t.chunks), T0)
    temporal = F.col("query_id") % 5 == 0
    order = [F.when(temporal, F.col("timestamp")), F.when(~temporal, -F.col("score")), F.col("id")]
    return ranking.top_n(p, ["query_id"], order, 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("E7_prefix_twins", "lex_top chunks", """
with recursive p as (select l.query_id, l.id, l.rank, lower(left(content, 150)) as pr from lex_top l join chunks using (id)),
w as (select query_id, id, rank, pr, [pr] as kept, true as ok from p where rank = 1
  union all select p.query_id, p.id, p.rank, p.pr, case when x.twin then w.kept else list_append(w.kept, p.pr) end, not x.twin
  from w join p on p.query_id = w.query_id and p.rank = w.rank + 1,
  lateral (select len(list_filter(w.kept, lambda k: least(strlen(k), strlen(p.pr)) >= 30 and
    len(list_filter(range(1, 151), lambda i: i <= len(k) and i <= len(p.pr) and left(k, i) = left(p.pr, i))) * 1e0 / least(strlen(k), strlen(p.pr)) > 0.8)) > 0 as twin) x)
select query_id, id from w where ok""")
def e7(t):
    hits = hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index).join(t.chunks.select("id", ranking.twin_head()), "id")
    return ranking.drop_prefix_twins(hits).select("query_id", "id")


@query("E8_one_per_subject", "lex_top chunks", """
select query_id, id from (select l.query_id, l.id, subject, row_number() over (partition by query_id, lower(subject) order by rank) as n
  from lex_top l join chunks using (id)) where n = 1 or subject is null""")
def e8(t):
    hits = hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index).join(t.chunks.selectExpr("id", "meta.subject as subject"), "id")
    return ranking.one_per_subject(hits).select("query_id", "id")


@query("E9_token_budget", "lex_top chunks", """
select query_id, id, spent from (select query_id, id, rank, cast(sum(strlen(content) // 4 + 25) over (partition by query_id order by rank) as bigint) as spent
  from lex_top join chunks using (id)) where spent <= 3000 or rank = 1""")
def e9(t):
    hits = hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index).join(t.chunks.selectExpr("id", "octet_length(content) div 4 + 25 as cost"), "id")
    return ranking.within_budget(hits, F.col("cost"), 3000).select("query_id", "id", "spent")


OSC = f"""ad as (select stream, sec as ts, value - 15 as value from event_log where type = 'feedback' and sec >= {T0 - 21 * 86400}),
lg as (select *, lag(value >= 0) over (partition by stream order by ts, value) as pv from ad),
osc as (select stream, count(*) as points, cast(sum(case when pv <> (value >= 0) then 1 else 0 end) as bigint) as changes, round(avg(value), 6) as freeze_at
  from lg group by stream having count(*) >= 3 and sum(case when pv <> (value >= 0) then 1 else 0 end) >= 3)"""


def adjustments(t):
    return t.events.where("type = 'feedback'").selectExpr("stream", "sec as ts", "value - 15 as value")


@query("E10_oscillation", "event_log", f"with {OSC} select * from osc")
def e10(t):
    return adv.oscillation(adjustments(t), T0)


@query("E11_chain_verification", "event_log", """
with r as (select stream as target, event_id as seq, row_number() over (partition by stream order by sec, event_id) - 1 as idx,
  event_id % 997 = 0 as edited from event_log where type in ('consolidation', 'llm_failure')),
x as (select *, lag(edited) over (partition by target order by idx) as after_edit, count(*) over (partition by target) as n from r)
select target, min(idx) filter (where after_edit) as first_break, count(*) filter (where idx > 0) as chained, count(*) as n_rows,
  case when min(idx) filter (where after_edit) is null then 'valid' else 'broken' end as status from x group by target""")
def e11(t):
    """The written chain, with some rows edited afterwards."""
    folder = scratch_path(t.spark, "audit")
    event_log.chain(audit_batch(t)).write.parquet(folder)
    rows = t.spark.read.parquet(folder).withColumn("blob", F.when(F.col("seq") % 997 == 0, F.concat(F.lit("x"), "blob")).otherwise(F.col("blob")))
    return event_log.verify_chain(rows).withColumn("first_break", F.col("first_break").cast("long"))


@query("E12_latent_eviction", "event_log", f"""
with {LATENTS} select stream, event_id from (select *, row_number() over (partition by stream order by sec desc, event_id desc) as rn from lt) where rn <= 50""")
def e12(t):
    return listings.newest_latents(latents(t), 50).select("stream", "event_id")


@query("E13_latent_listing", "event_log", f"""
with {LATENTS} select 'newest' as list, stream, event_id, rn from (select *, row_number() over (partition by stream order by sec desc, event_id desc) as rn from lt) where rn <= 10
union all select 'unpromoted', stream, event_id, rn from (select *, row_number() over (partition by stream order by score desc, event_id desc) as rn from lt where not promoted) where rn <= 10""")
def e13(t):
    pick = lambda df, name: df.select(F.lit(name).alias("list"), "stream", "event_id", F.col("rank").cast("long").alias("rn"))
    return pick(listings.newest_latents(latents(t), 10), "newest").unionByName(pick(listings.unpromoted_latents(latents(t), 10), "unpromoted"))


@query("E14_profile_layers", "chunks ratings", f"""
with c as (select * from (select *, row_number() over (partition by stream order by coalesce(importance, 0) desc, timestamp desc, id) as rn from chunks
    where is_latest and not dormant and deleted_at is null) where rn <= 15),
b as (select stream, 'stable' as layer, id, row_number() over (partition by stream order by coalesce(importance, 0) desc, timestamp desc, id) as rank from c
  where (level >= 1 and coalesce(importance, 0) >= 1) or persistent),
r as (select stream, 'recent' as layer, id, row_number() over (partition by stream order by coalesce(importance, 0) desc, timestamp desc, id) as rank from c
  where timestamp >= {T0 - 7 * 86400} and not persistent)
select * from b where rank <= 5 union all select * from r where rank <= 4
union all select stream, 'pinned', id, row_number() over (partition by stream order by id) from chunks where tier = 'pinned' and deleted_at is null
union all select stream, 'feedback', id, row_number() over (partition by stream order by id) from chunks where id in (select chunk_id from ratings where harmful) and deleted_at is null""")
def e14(t):
    pins = live(t.chunks).where("get_json_object(metadata, '$.tier') = 'pinned'")
    fb = live(t.chunks).join(t.ratings.where("harmful").select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
    return listings.profile_layers(t.chunks, pins, fb, T0, most=15, stable=5, recent=4).withColumn("rank", F.col("rank").cast("long"))


@query("E15_top_contents", "chunks", """
select stream, id, rank from (select *, row_number() over (partition by stream order by coalesce(importance, 0) desc, timestamp desc, id) as rank from chunks where deleted_at is null) where rank <= 7""")
def e15(t):
    return listings.top_contents(t.chunks, 7).select("stream", "id", F.col("rank").cast("long").alias("rank"))


@query("E16_paginated_listing", "chunks", """
select stream, id, pos, total from (select *, row_number() over (partition by stream order by event_date desc nulls first, timestamp desc, id) as pos,
  count(*) over (partition by stream) as total from chunks where deleted_at is null) where pos > 10 and pos <= 20""")
def e16(t):
    return listings.page(t.chunks, 2, 10).withColumn("pos", F.col("pos").cast("long"))


@query("E17_hit_diagnostics", "lex_top vec_top fused", """
select 'lexical' as channel, query_id, id, rank from lex_top union all select 'vector', query_id, id, rank from vec_top
union all select 'fused', query_id, id, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from fused) where rank <= 20""")
def e17(t):
    parts = {"lexical": hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index), "vector": hybrid.vector_search(t.query_vectors, t.vectors, t.chunks, 20),
             "fused": fused_ranked(t).where("rank <= 20")}
    out = None
    for name, df in parts.items():
        p = df.select(F.lit(name).alias("channel"), "query_id", "id", F.col("rank").cast("long").alias("rank"))
        out = p if out is None else out.unionByName(p)
    return out


JAC = "len(list_intersect(string_split(l, ' '), string_split(n.q, ' '))) * 1e0 / len(list_distinct(list_concat(string_split(l, ' '), string_split(n.q, ' '))))"
REPEATED = f"""dq as (select stream, lower(trim(query)) as q, count(*) as n, min((sec, event_id)) as first from event_log where type = 'search' group by all),
nq as (select *, row_number() over (partition by stream order by first) as i from dq),
g as (select stream, i, q, n, [q] as leaders, q as leader from nq where i = 1
  union all select n.stream, n.i, n.q, n.n, case when x.hit is null then list_append(g.leaders, n.q) else g.leaders end, coalesce(x.hit, n.q)
  from g join nq n on n.stream = g.stream and n.i = g.i + 1, lateral (select list_filter(g.leaders, lambda l: {JAC} > 0.6)[1] as hit) x),
rep as (select stream, leader, cast(sum(n) as bigint) as n from g group by all having sum(n) >= 25)"""


@query("N1_repeated_queries", "event_log", f"with recursive {REPEATED} select * from rep")
def n1(t):
    s = t.events.where("type = 'search'").select("stream", "query", F.struct("sec", "event_id").alias("order"))
    return adv.repeated_queries(s, at_least=25)


def rare_feedback(t):
    return t.events.where("type = 'feedback' and value > 230").select("stream")


IGNORED = """ign as (select stream, count(*) as n from event_log where type = 'search' and top1 > 0.1 and result_count > 0
  and stream not in (select stream from event_log where type = 'feedback' and value > 230) group by stream having count(*) > 3)"""


@query("N2_ignored_searches", "event_log", f"with {IGNORED} select * from ign")
def n2(t):
    """Only feedback worth more than 230 counts here."""
    return adv.ignored_searches(t.events, rare_feedback(t), score=0.1)


STALE = f"""sc as (select id, stream, lower(subject) as subject, timestamp from chunks where deleted_at is null and subject is not null),
ss as (select stream, subject, max(timestamp) as newest from sc group by all having count(*) >= 2),
st as (select sc.stream, sc.subject, id, timestamp as updated from sc join ss using (stream, subject) where timestamp < {T0 - 20 * 86400} and newest > timestamp)"""


@query("N3_stale_facts", "chunks", f"with {STALE} select * from st")
def n3(t):
    return adv.stale_facts(t.chunks, T0, 20)


HEADS = """hd as (select stream, lower(subject) as subject, count(*) filter (where is_latest) as heads from chunks
  where deleted_at is null and subject is not null group by all having count(*) filter (where is_latest) >= 2)"""


@query("N4_several_heads", "chunks", f"with {HEADS} select * from hd")
def n4(t):
    return adv.several_heads(t.chunks)


def summary(t):
    return stats.summary(t.events, t.chunks, feedback(t), T0)


SUMMARY = f"""{BUCKETS}, {FEEDBACK}, {UTIL}, {FRESH}, {MRR},
mm as (select stream, cast(sum(search_count) as bigint) as search_count, max_by(mean_top1_score, hour) as mean_top1_score, max_by(zero_result_rate, hour) as zero_result_rate from b group by stream),
sm as (select stream, coalesce(u.n, 0) as store_count, coalesce(recall_ratio, 0) as recall_ratio, coalesce(dead_share, 0) as dead_share, coalesce(search_count, 0) as search_count,
  coalesce(mean_top1_score, 0) as mean_top1_score, coalesce(zero_result_rate, 0) as zero_result_rate from u full outer join mm using (stream) where stream <> '_global')"""


@query("N5_health_rules", "event_log chunks", f"""
with {SUMMARY}, hr as (select stream, 'dead_memory' as rule, 2 as priority from sm where dead_share > 0.3
  union all select stream, 'low_recall', 1 from sm where recall_ratio < 0.3 and store_count > 0
  union all select stream, 'zero_results', 2 from sm where zero_result_rate > 0.2 and search_count > 5
  union all select stream, 'no_scores', 3 from sm where mean_top1_score = 0 and search_count > 0)
select * from hr union all select stream, 'ok', 1 from sm where stream not in (select stream from hr)""")
def n5(t):
    return adv.health_rules(summary(t))


@query("N6_weight_suggestions", "event_log", f"""
with {OUTCOMES}, e as (select advisory_type, count(*) as total, count(*) filter (where followed) as followed, round(count(*) filter (where followed) / count(*), 6) as rate from ot group by all)
select *, case when rate < 0.2 then 'deprioritize' else 'promote' end as action from e where total >= 3 and (rate < 0.2 or rate > 0.5)""")
def n6(t):
    return adv.weight_suggestions(stats.effectiveness(links.outcomes_by_type(outcomes(t), advisories(t))))


COMBINED = f"""{REPEATED}, {IGNORED.replace('0.1 and', '0.5 and')}, {STALE}, {HEADS},
gp as (select stream, count(*) as n from event_log s where type = 'search' and result_count = 0 and exists (
  select 1 from event_log t where t.type = 'store' and t.stream = s.stream and t.sec > s.sec and t.sec - s.sec <= 120) group by stream),
al as (select stream, 'repeated_query' as advisory_type, leader as about, n, 2 as priority from rep union all select stream, 'search_ignored', '', n, 2 from ign
  union all select stream, 'gap_filled', '', n, 1 from gp union all select stream, 'stale_fact', '', count(*), 2 from st group by stream
  union all select stream, 'contradiction', subject, heads, 3 from hd),
cb as (select *, row_number() over (partition by stream order by priority desc, advisory_type, n desc, about) as rank from al)"""


def combined(t, most, rules=None):
    return adv.combined(t.chunks, t.events, rare_feedback(t), links.gap_filled(t.events), T0, repeat_at_least=25, stale_days=20, most=most, rules=rules).withColumn(
        "rank", F.col("rank").cast("long"))


@query("N8_combined_advisories", "event_log chunks", f"with recursive {COMBINED} select * from cb where rank <= 10")
def n8(t):
    return combined(t, 10)


@query("N8_advisories_switched", "event_log chunks", f"""
with recursive {COMBINED}, w as (select * exclude (rank), row_number() over (partition by stream order by rank) as rank from cb where advisory_type in ('stale_fact', 'gap_filled', 'contradiction'))
select * from w where rank <= 5""")
def n8s(t):
    """Two rules switched off, five advisories a stream."""
    return combined(t, 5, ("stale_fact", "gap_filled", "contradiction"))


@query("E18_advisory_list", "event_log chunks", f"with recursive {COMBINED} select stream, rank, advisory_type, priority from cb where rank <= 3")
def e18(t):
    """Advisories kept from an earlier run, listed by priority."""
    folder = scratch_path(t.spark, "advisories")
    combined(t, 10).write.parquet(folder)
    return t.spark.read.parquet(folder).where("rank <= 3").select("stream", "rank", "advisory_type", "priority")
