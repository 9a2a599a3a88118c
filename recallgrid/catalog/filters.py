"""2.B filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import contains_any, tokens
from ..operators import filters as flt, ranking
from ..plans import hybrid
from ..sources.chunk_store import live
from ..sources.views import T0
from .base import query


@query("B1_stream_filter", "chunks", "select id, stream from chunks where stream in ('s1', 's2')")
def b1(t):
    return flt.in_streams(t.chunks, ["s1", "s2"]).select("id", "stream")


def membership(t):
    """Who may read which stream: four shared ones, the others private by customer."""
    return t.raw("customer").selectExpr(
        "concat('s', cast(c_custkey % 20 as string)) as stream", "concat('u', cast(c_custkey % 20 as string)) as user",
        "case when c_custkey % 20 < 4 then 'shared' else 'private' end as kind").distinct()


@query("B2_scope_streams", "chunks", """
select id, stream from chunks where stream in (
  select 's' || (c_custkey % 20) from customer where c_custkey % 20 < 4 or c_custkey % 20 = 7)""")
def b2(t):
    return flt.readable(t.chunks, membership(t), "u7").select("id", "stream")


@query("B3_agent_filter", "chunks", """
select 'mcp' as rule, id from chunks where coalesce(agent, 'unknown') = 'mcp'
union all select 'not api', id from chunks where coalesce(agent, 'unknown') not in ('api', 'external_web')""")
def b3(t):
    a = flt.by_agent(t.chunks, include="mcp").selectExpr("'mcp' as rule", "id")
    return a.unionByName(flt.by_agent(t.chunks, exclude=["api", "external_web"]).selectExpr("'not api' as rule", "id"))


@query("B4_bitemporal_as_of", "chunks qs", f"""
select query_id, id from qs join chunks using (stream)
where (valid_from is null or valid_from <= {T0} - (query_id % 40) * 86400)
  and (valid_until is null or valid_until >= {T0} - (query_id % 40) * 86400)""")
def b4(t):
    """Every query asks about its own moment."""
    q = t.queries.selectExpr("query_id", "stream", f"{T0} - (query_id % 40) * 86400 as at")
    return q.join(t.chunks, "stream").where(flt.valid_at(F.col("at"))).select("query_id", "id")


@query("B5_head_of_chain", "chunks", "select id, version from chunks where is_latest and deleted_at is null")
def b5(t):
    return live(t.chunks).where("is_latest").select("id", F.col("version").cast("long").alias("version"))


@query("B6_fact_filters", "chunks", """
select id from chunks where has_meta and (fact_type = 'budget' or topic = 'budget') and confidence >= 0.3
union all select id || '!' from chunks where has_meta and fact_type = 'fact' and lower(subject) like '%subj1%'""")
def b6(t):
    a = t.chunks.where(flt.fact_filter("budget", None, 0.3)).select("id")
    return a.union(t.chunks.where(flt.fact_filter("fact", "SUBJ1")).select(F.concat("id", F.lit("!"))))


B7_RANGE = (1704110400, 1706702400)


@query("B7_event_date_range", "chunks", f"""
select id, event_ts, row_number() over (partition by stream order by timestamp desc, id) as rn from (
  select id, stream, timestamp, coalesce(cast(epoch(cast(event_date as date)) as bigint) + 43200, timestamp) as event_ts
  from chunks where deleted_at is null) where event_ts between {B7_RANGE[0]} and {B7_RANGE[1]}""")
def b7(t):
    """No query text: newest first."""
    d = live(t.chunks).withColumn("event_ts", flt.event_noon()).where(F.col("event_ts").between(*B7_RANGE))
    from pyspark.sql import Window
    w = Window.partitionBy("stream").orderBy(F.desc("timestamp"), "id")
    return d.select("id", "event_ts", F.row_number().over(w).cast("long").alias("rn"))


@query("B8_tombstone_filter", "chunks lex_top", """
select query_id, id from lex_top where id in (select id from chunks where deleted_at is null)""")
def b8(t):
    hits = hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index)
    return hits.join(live(t.chunks).select("id"), "id", "left_semi").select("query_id", "id")


@query("B9_decay_eligible", "chunks", "select id, score from chunks where not dormant and deleted_at is null and score > 0.01")
def b9(t):
    return t.chunks.where(flt.decay_eligible()).select("id", "score")


@query("B10_expired_tombstones", "chunks", f"select id, deleted_at from chunks where deleted_at <= {T0} - 30 * 86400")
def b10(t):
    return t.chunks.where(flt.expired(T0)).select("id", "deleted_at")


@query("B11_associable", "chunks", """
select id, stream from chunks where is_latest and deleted_at is null and strlen(content) >= 10
  and not regexp_matches(lower(coalesce(agent, '')), 'raw-transcript|openclaw|system|toolresult|tool_result|meta|debug')
  and not regexp_matches(lower(content), '^(toolresult|tool_result|\\{"tool|error:|system:)')""")
def b11(t):
    return t.chunks.where(flt.associable()).select("id", "stream")


@query("B12_memory_listing", "chunks chunk_entity", """
select id, case when via_shared then 'shared' else 'private' end as origin from (
  select c.id, bool_or(o.k = 1) as via_shared from chunks c, (values (1), (2)) o(k)
  where deleted_at is null and level = 0 and lower(content) like '%the%' and coalesce(agent, '') = 'api'
    and (o.k = 2 or doc_id % 2 = 0) and c.id in (select id from chunk_entity) group by c.id)""")
def b12(t):
    """Raw rows of one agent holding a word and any entity; a shared copy beats a private one."""
    base = live(t.chunks).where((F.col("level") == 0) & (F.col("source.agent") == "api") & F.lower("content").contains("the"))
    base = base.join(t.chunk_entity.select("id").distinct(), "id", "left_semi")
    copies = base.where("doc_id % 2 = 0").selectExpr("id", "'shared' as origin", "1 as pref").unionByName(
        base.selectExpr("id", "'private' as origin", "2 as pref"))
    return ranking.top_n(copies, ["id"], [F.col("pref")], 1).select("id", "origin")


def field_sql(tag: str, texts: str) -> str:
    """CTE text that ends in `{tag}x(query_id, id, score)`: BM25 over `texts(id, names)`."""
    return f"""{tag}t as (select id, unnest(list_filter(regexp_split_to_array(lower(names), '[^\\p{{L}}\\p{{N}}]+'), lambda t: len(t) > 0)) as token from {texts}),
{tag}s as (select n, (select count(*) from {tag}t) * 1e0 / n as avg_dl from doc_stats), {tag}tf as (select id, token, count(*) as tf from {tag}t group by all),
{tag}df as (select token, count(*) as df from {tag}tf group by token), {tag}dl as (select id, count(*) as dl from {tag}t group by id),
{tag}x as (select query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) as score
    from q_terms join {tag}tf using (token) join {tag}df using (token) join {tag}dl using (id), {tag}s group by all)"""


@query("B13_entity_filtered_search", "chunks qs bench_words dict chunk_entity dict_rel lex q_terms doc_stats", f"""
with names as (select c.id, coalesce(string_agg(distinct name, ' ' order by name), '') as names
    from chunks c left join chunk_entity e on e.id = c.id where deleted_at is null group by c.id),
rels as (select c.id, coalesce(string_agg(distinct e.subject || ' ' || relation || ' ' || object, ' '), '') as names
    from chunks c left join (select id, r.* from chunk_entity join dict_rel r on name = subject or name = object) e on e.id = c.id where deleted_at is null group by c.id),
{field_sql("e", "names")}, {field_sql("r", "rels")},
both_ as (select query_id, id, round(sum(score), 6) as score from (select * from lex union all select * from ex union all select query_id, id, score * 0.5e0 from rx) group by all),
want as (select item_id as query_id, name from bench_words join dict on alias = token where rn = 1)
select query_id, id, score, rank from (
  select b.*, row_number() over (partition by query_id order by score desc, id) as rank
  from both_ b where exists (select 1 from want w join chunk_entity e on e.name = w.name where w.query_id = b.query_id and e.id = b.id))
where rank <= 10""")
def b13(t):
    """Each query filtered by the entity its longest word names."""
    ent = t.bench_words.where("rn = 1").join(t.dict_alias, F.col("token") == F.col("alias")).select(
        F.col("item_id").alias("query_id"), F.col("name").alias("entity"))
    q = t.queries.join(ent, "query_id")
    return hybrid.entity_search(q, t.chunk_entity, 10, t.fielded_index).withColumn("rank", F.col("rank").cast("long"))


@query("B14_extraction_confidence", "chunks chunk_entity", """
select stream, case when confidence >= 0.5 then 'kept' else 'rejected' end as outcome, count(*) as n
from chunk_entity join chunks using (id) where has_meta group by all""")
def b14(t):
    e = t.chunk_entity.join(t.chunks.where("meta is not null").selectExpr("id", "stream", "meta.confidence as confidence"), "id")
    return e.groupBy("stream", flt.by_confidence(0.5).alias("outcome")).agg(F.count("*").alias("n"))


@query("B15_reprocess_candidates", "chunks", """
select id from chunks where deleted_at is null and level <= 1 and coalesce(agent, '') not in ('legacy-raw', 'knowledge_extraction', 'raw-transcript')
  and coalesce(agent, '') <> 'external_web'""")
def b15(t):
    return flt.reprocess_candidates(t.chunks, exclude=["external_web"]).select("id")


@query("B16_attribute_terms", "chunks q_terms", """
select distinct q.query_id, c.id from (select query_id, stream, list(token) as terms from q_terms where len(token) >= 7 group by all) q
join chunks c using (stream) where deleted_at is null and len(list_filter(terms, lambda t: contains(lower(content), t))) > 0""")
def b16(t):
    q = t.queries.select("query_id", "stream", F.filter(tokens(F.col("text")), lambda x: F.length(x) >= 7).alias("terms"))
    return q.join(live(t.chunks), "stream").where(contains_any(F.col("content"), F.col("terms"))).select("query_id", "id")


@query("B17_vector_floor", "vec_top", """
select query_id, id, round(sim / max(sim) over (partition by query_id), 6) as dense from vec_top where sim >= 0.3""")
def b17(t):
    v = hybrid.vector_search(t.query_vectors, t.vectors, t.chunks, 20).where("sim >= 0.3")
    return v.select("query_id", "id", F.round(ranking.max_normalised("sim"), 6).alias("dense"))
