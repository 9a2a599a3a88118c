"""2.F set operations, 2.I scoring stages, 2.J retrieval jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx, scoring
from ..functions.vectors import cosine, mean_vector_parts
from ..operators import advisories as adv, annotate, entities, filters as flt, graph, lexical, links, listings, merging, ranking, stats
from ..operators.similarity import nearest
from ..plans import hybrid, packs
from ..sources.chunk_store import live
from ..sources.views import T0
from .base import query
from .filters import B7_RANGE
from .joins import RELATED, RELATED1, anchors, fused, incoming, starts
from .oracle_views import TOK, VIEWS
from .texts import COMPLEXITY_SQL, COUNTING_SQL, H1_CTE, FIRST_SQL, THIRD_SQL, TRIM, WORDS, asked, lit, tx
from .windows import LATENTS, OSC, SUMMARY, adjustments, fused_ranked, latents, rrf_pool, signal_pool, summary


def long_rank(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


def bm25_cte(name: str, terms: str) -> str:
    """SQL of a BM25 hit list `name` over the terms table `terms(query_id, token, qtf)`."""
    return f"""{name}_tf as (select id, token, count(*) as tf from doc_tokens where token in (select token from {terms}) group by all),
{name}_df as (select token, count(*) as df from {name}_tf group by token),
{name} as (select query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) as score
  from {terms} join {name}_tf using (token) join {name}_df using (token) join doc_dl using (id), doc_stats group by all)"""


def top_cte(name: str, src: str, n: int, order: str = "score desc, id") -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by query_id order by {order}) as rank from {src}) where rank <= {n})"


LEXBASE = "q_terms doc_stats doc_dl doc_tokens lex"


# ---- 2.F -----------------------------------------------------------------

def expanded(t):
    """Queries with the next passage's longest word added."""
    w = t.bench_words.where("rn = 1").select((F.col("item_id") - 1).alias("query_id"), "token")
    return t.queries.join(w, "query_id", "left").withColumn("text", F.concat_ws(" ", "text", "token")).drop("token")


EXP_TERMS = f"""et as (select query_id, token, count(*) as qtf from (select query_id, unnest({TOK.format("text || coalesce(' ' || token, '')")}) as token
  from qs left join (select item_id - 1 as query_id, token from bench_words where rn = 1) using (query_id)) group by all)"""


@query("F1_expanded_query_merge", LEXBASE + " bench_words qs", f"""
with {EXP_TERMS}, {bm25_cte('ex', 'et')}, {top_cte('o', 'lex', 20)}, {top_cte('e', 'ex', 20)}
select query_id, id, max(score) as score from (select query_id, id, score from o union all select query_id, id, round(score * 0.5, 6) from e) group by all""")
def f1(t):
    hybrid.ask_for(t.index, t.queries, expanded(t))
    return merging.max_merge((hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index), 1.0), (hybrid.lexical_search(expanded(t), t.chunks, 20, index=t.index), 0.5))


@query("F2_multi_stream_merge", LEXBASE + " chunks", f"""
with m as (select lex.* from lex join chunks using (id) where stream in ('s1', 's2', 's3')), {top_cte('tp', 'm', 10)} select query_id, id, score from tp""")
def f2(t):
    """One grouped query over several streams."""
    return hybrid.lexical_search(t.queries, t.chunks, 10, index=t.index, where=F.col("stream").isin("s1", "s2", "s3")).select("query_id", "id", "score")


def sub_queries(t):
    """Each query's only sub-question is the passage after it."""
    return t.queries.where("query_id > 0").select((F.col("query_id") - 1).alias("query_id"), "text")


SUBTOP = """sl as (select l.query_id - 1 as query_id, id, score from lex_top l where l.query_id > 0)"""


@query("F3_sub_query_merge", "lex_top vec_top", f"""
with {SUBTOP}, sv as (select query_id - 1 as query_id, id, sim from vec_top where query_id > 0 and rank <= 10)
select 'lexical' as channel, query_id, id, max(score) as score from (select query_id, id, score from lex_top union all select * from sl) group by all
union all select 'vector', query_id, id, round(sum(score), 6) from (select query_id, id, sim as score from vec_top union all select query_id, id, sim * 0.5e0 from sv where sim >= 0.3) group by all""")
def f3(t):
    lex = merging.max_merge((hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index), 1.0), (hybrid.lexical_search(sub_queries(t), t.chunks, 20, index=t.index), 1.0))
    vec = hybrid.vector_search(t.query_vectors, t.vectors, t.chunks, 20).select("query_id", "id", F.col("sim").alias("score"))
    sub_vec = t.query_vectors.where("query_id > 0").withColumn("query_id", F.col("query_id") - 1)
    v = merging.add_sub_query_vectors(vec, hybrid.vector_search(sub_vec, t.vectors, t.chunks, 10))
    return lex.select(F.lit("lexical").alias("channel"), "query_id", "id", "score").unionByName(v.select(F.lit("vector").alias("channel"), "query_id", "id", "score"))


LANE = f"""rt as (select query_id, token, 1 as qtf from (select distinct query_id, token from q_terms) join doc_df using (token), doc_stats where df <= greatest(3, ceil(0.005 * n))),
{bm25_cte('ln', 'rt')}, {top_cte('lane', 'ln', 10)}"""


@query("F4_lane_injection", LEXBASE + " doc_df", f"""
with {LANE}, {top_cte('o', 'lex', 5)} select query_id, id, score, false as injected from o
union all select query_id, id, score, true from lane where (query_id, id) not in (select query_id, id from o)""")
def f4(t):
    return merging.inject(hybrid.lexical_search(t.queries, t.chunks, 5, index=t.index), hybrid.rare_term_lane(t.queries, t.chunks, index=t.index))


@query("F5_reranker_slice", LEXBASE + " doc_df", f"""
with {LANE}, {top_cte('o', 'lex', 20)}, f as (select o.*, (query_id, id) in (select query_id, id from lane) as in_lane from o),
c as (select *, sum(case when rank > 5 and in_lane then 1 else 0 end) over (partition by query_id order by rank) as k from f)
select query_id, id, rank from c where rank <= 5 or (in_lane and k <= 3)""")
def f5(t):
    lane = hybrid.rare_term_lane(t.queries, t.chunks, index=t.index).select("query_id", "id", F.lit(True).alias("in_lane"))
    r = hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index).join(lane, ["query_id", "id"], "left").fillna(False, ["in_lane"])
    return ranking.head_plus_lane(r, 5, 3).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("F6_association_pool", "edge_evidence edges qs vec_top lex_top event_log", f"""
with {RELATED}, {LATENTS},
a as (select query_id, id, graph as score, 'graph_walk' as mechanism, 0 as prio from rel where graph >= 0.5
  union all select query_id, id, sim, 'adjacent', 1 from vec_top union all select user_id % (select count(*) from qs), target, score, 'latent', 2 from lt join event_log using (event_id)),
b as (select * from a where (query_id, id) not in (select query_id, id from lex_top where rank <= 5)),
c as (select *, row_number() over (partition by query_id, id order by prio, score desc) as k from b)
select query_id, id, score, mechanism from (select *, row_number() over (partition by query_id order by score desc, id) as rank from c where k = 1) where rank <= 15""")
def f6(t):
    rel = graph.related_chunks(starts(t), t.edge_mentions, graph.evidence_rows(t.edge_mentions), hops=1).withColumnRenamed("graph", "score")  # two hops away is .25
    vec = hybrid.vector_search(t.query_vectors, t.vectors, t.chunks, 20).withColumnRenamed("sim", "score")
    n = t.queries.agg(F.count("*").alias("n")).scalar()
    lat = latents(t).join(t.events.select("event_id", "user_id"), "event_id").select((F.col("user_id") % n).alias("query_id"), F.col("target").alias("id"), "score")
    shown = hybrid.lexical_search(t.queries, t.chunks, 5, index=t.index)
    return merging.first_mechanism([("graph_walk", rel), ("adjacent", vec), ("latent", lat)], shown, 15).select("query_id", "id", "score", "mechanism")


@query("F7_dictionary_and_model_entities", "chunk_entity doc_tokens", """
with m as (select distinct id, token as name from doc_tokens where len(token) >= 13)
select id, name, 'dictionary' as origin from chunk_entity union select id, name, 'model' from m where (id, name) not in (select id, lower(name) from chunk_entity)""")
def f7(t):
    """Long words stand in for a model's findings."""
    model = lexical.token_rows(live(t.chunks)).where(F.length("token") >= 13).select("id", F.col("token").alias("name")).distinct()
    return merging.join_entity_lists(t.chunk_entity, model)


# ---- 2.I -----------------------------------------------------------------

@query("I1_pairwise_similarity", "chunks vectors", """
with v as (select v.id, stream, embedding from vectors v join chunks c using (id) where deleted_at is null)
select id, other_id, sim, rank from (select *, row_number() over (partition by id order by sim desc, other_id) as rank from (
  select a.id, b.id as other_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as sim from v a join v b on a.stream = b.stream and a.id <> b.id)
  where sim >= 0.1) where rank <= 3""")
def i1(t):
    v = t.vectors.join(live(t.chunks).select("id", "stream"), "id")
    return long_rank(nearest(v, v, 3, left_key="id", on=["stream"], min_sim=0.1, exclude_self=True))


@query("I2_time_decay", "fused", """
select query_id, id, round(decay, 6) as decay, round(decay + (1 - decay) * 0.5e0 * least(1, greatest(0, greatest(lexical_raw / 60, dense_raw))), 6) as relieved from fused""")
def i2(t):
    p = hybrid.enrich(fused(t), t.chunks)
    d = scoring.time_decay(F.col("timestamp"), F.col("level"), T0)
    return p.select("query_id", "id", F.round(d, 6).alias("decay"),
                    F.round(scoring.relieved(d, F.greatest(F.col("lexical_raw") / 60, F.col("dense_raw")), 0.5), 6).alias("relieved"))


@query("I3_authority_weight", "fused", """
select query_id, id, round(case provenance when 'evidence' then 0.5e0 when 'cue' then 0.8e0 else 1e0 end * case trust_level when 'a1' then 1e0 when 'a2' then 0.92e0 else 0.8e0 end
  * case when attributed_to = 'user' and fact_type in ('preference_or_decision', 'project_state') then 1.3e0
    when attributed_to = 'assistant' and fact_type in ('preference_or_decision', 'project_state') then 0.9e0 else 1e0 end, 6) as factor from fused""")
def i3(t):
    p = hybrid.enrich(fused(t), t.chunks)
    f = scoring.authority(F.col("provenance"), F.col("trust_level")) * scoring.attribution(F.col("meta.attributed_to"), F.col("meta.fact_type"), 1.3, 0.9)
    return p.select("query_id", "id", F.round(f, 6).alias("factor"))


@query("I4_weighted_fusion", "fused", "select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from fused")
def i4(t):
    return fused_ranked(t).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def adjust_sql(score="score", access=0.3, decay="decay"):
    return f"""round({score} * case when level = 1 then 1.5e0 else 1e0 end * case coalesce(tier, '') when 'core' then case when {decay} > 0 then 1 / {decay} else 1 end * 2
  when 'pinned' then case when {decay} < 0.8 and {decay} > 0 then 0.8e0 / {decay} else 1 end * 1.5e0 when 'ephemeral' then {decay} * 0.5e0 else 1 end
  * coalesce(importance, 1.0) * case when access_count > 0 then 1 + ln(1 + access_count) * {access}e0 else 1 end * case when fact_type = 'preference_or_decision' then 1.5e0 else 1 end, 12)"""


@query("I5_chunk_adjustments", "fused", f"select query_id, id, {adjust_sql()} as score from fused")
def i5(t):
    return hybrid.adjusted(fused_ranked(t), 0.3).select("query_id", "id", "score")


@query("I6_graph_boost", "fused edge_evidence edges qs chunks", f"""
with {RELATED1}, p as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from fused) where rank <= 30),
x as (select query_id, r.id, graph, row_number() over (partition by query_id order by graph desc, r.id) as k from rel r join chunks c on c.id = r.id
  where deleted_at is null and not dormant and (query_id, r.id) not in (select query_id, id from p))
select p.query_id, p.id, round(p.score * (1 + coalesce(graph, 0) * 0.3e0), 12) as score from p left join rel on rel.query_id = p.query_id and rel.id = p.id
union all select query_id, id, round(graph * 0.3e0, 12) from x where k <= 3""")
def i6(t):
    g = graph.related_chunks(starts(t), t.edge_mentions, graph.evidence_rows(t.edge_mentions), hops=1)
    return hybrid.graph_additions(fused_ranked(t).where("rank <= 30").drop("rank"), g, t.chunks).select("query_id", "id", "score")


@query("I7_surprise_importance", "chunks vectors", """
with m as (select c.id, greatest(0, max(round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6))) as sim from chunks c join vectors a using (id) join vectors b on b.id <> a.id
  where deleted_at is null and importance is null group by c.id)
select c.id, case when importance is not null then 'already_scored' when m.id is null then 'skipped' else 'scored' end as outcome,
  coalesce(importance, case when 1 - sim > 0.5 then 1.5 when 1 - sim > 0.2 then 1.0 when sim is not null then 0.7 end) as importance from chunks c left join m using (id) where deleted_at is null""")
def i7(t):
    """Rows without importance get it from how unlike every other vector they are."""
    c = live(t.chunks).select("id", "importance")
    new = c.where("importance is null").join(t.vectors, "id").select("id", "embedding")
    near = nearest(new, t.vectors, 1, left_key="id", exclude_self=True).select("id", F.greatest(F.lit(0.0), F.col("sim")).alias("sim"))
    r = c.join(near, "id", "left")
    out = F.when(F.col("importance").isNotNull(), "already_scored").when(F.col("sim").isNull(), "skipped").otherwise("scored")
    return r.select("id", out.alias("outcome"), F.coalesce("importance", F.when(F.col("sim").isNotNull(), scoring.importance_from_surprise(1 - F.col("sim")))).alias("importance"))


@query("I8_signal_channels", "pool", "select query_id, id, dense_raw as dense, lexical_raw as lexical, 0e0 as entity, round(recency, 6) as recency from pool")
def i8(t):
    return signal_pool(t).select("query_id", "id", "dense", "lexical", "entity", F.round("recency", 6).alias("recency"))


CONF = """nb as (select a.query_id, a.id, count(*) - 1 as n_close from rrf a join rrf b on b.query_id = a.query_id and abs(round(b.dense_raw * 1000000) - round(a.dense_raw * 1000000)) < 150000 group by all),
cf as (select rrf.* exclude (confidence), max(rrf.rrf) over (partition by rrf.query_id) as top, least(n_close, 2) / 2e0 as agreement from rrf join nb using (query_id, id)),
cc as (select *, round(0.5e0 * cf.rrf / top + 0.2e0 * case level when 0 then 1e0 when 1 then 0.7e0 else 0.4e0 end + 0.15e0 * recency + 0.15e0 * agreement, 6) as confidence from cf)"""


@query("I9_confidence_tier", "rrf", f"""
with {CONF} select query_id, id, agreement, confidence, case when confidence >= 0.75 then 'high' when confidence >= 0.45 then 'medium' else 'low' end as tier,
  case when near_tomb then least(confidence, 0.55e0) else confidence end as demoted from (select *, superseded_by is not null as near_tomb from cc)""")
def i9(t):
    """Rows that were superseded stand in for rows next to a tombstone."""
    p = packs.confidence(rrf_pool(t)).join(t.chunks.select("id", "superseded_by"), "id")
    return p.select("query_id", "id", "agreement", "confidence", "tier", packs.demoted(F.col("confidence"), F.col("superseded_by").isNotNull()).alias("demoted"))


def centroids(t):
    """Unit mean vector of every labelled cluster."""
    m = mean_vector_parts(t.vectors.select(F.col("label").alias("cluster"), "embedding"), ["cluster"])
    return m


CENT = """cn as (select label as cluster, list(m order by pos) as centroid from (select label, pos, avg(x) as m from (
  select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from vectors) group by all) group by label)"""


@query("I10_serendipity", "vec_top lex_top vectors qvec", f"""
with {CENT}, cx as (select query_id, v.embedding as cv from lex_top l join vectors v using (id) where rank <= 5),
qc as (select query_id, max_by(cluster, (s, -cluster)) as qcluster from (select query_id, cluster, round(list_cosine_similarity(q.embedding::double[], centroid), 6) as s from qvec q, cn) group by query_id),
s as (select t.query_id, t.id, t.sim, v.label as cluster, max(round(list_cosine_similarity(v.embedding::double[], cv::double[]), 6)) as rel from vec_top t join vectors v using (id) join cx using (query_id) group by all)
select query_id, id, round(greatest(0, rel) * (1 - greatest(0, sim)) * case when s.cluster = qcluster then 0 else least(1, greatest(0, 1 - round(list_cosine_similarity(a.centroid, b.centroid), 6))) end, 6) as serendipity
from s join qc using (query_id) join cn a on a.cluster = s.cluster join cn b on b.cluster = qcluster""")
def i10(t):
    from ..operators import association as assoc
    hits = hybrid.vector_search(t.query_vectors, t.vectors, t.chunks, 20).select("query_id", "id")
    ctx = hybrid.lexical_search(t.queries, t.chunks, 5, index=t.index).join(t.vectors.select("id", "embedding"), "id").select("query_id", "embedding")
    clusters = t.vectors.select("id", F.col("label").alias("cluster"))
    return assoc.serendipity(hits, t.query_vectors, ctx, t.vectors, clusters, centroids(t)).select("query_id", "id", F.col("score").alias("serendipity"))


@query("I11_beta_tally", "ratings", """
select chunk_id, round(1 + sum(usefulness / 4e0), 6) as alpha, round(1 + sum((4 - usefulness) / 4e0) + 4 * count(*) filter (where harmful), 6) as beta, count(*) as n_ratings,
  count(*) filter (where harmful) as harmful_count, max(rated_at) as last_rated_at from ratings where doc_id % 17 <> 3 group by chunk_id""")
def i11(t):
    """Some ratings are out of range and rejected."""
    bad = F.when(F.col("doc_id") % 17 == 3, 9).otherwise(F.col("usefulness"))
    return merging.beta_tally(t.ratings.withColumn("usefulness", bad))[0]


@query("I12_decay_suggestion", "event_log chunks", f"""
with {SUMMARY}, {OSC} select sm.stream, osc.stream is not null as frozen, case when osc.stream is not null then null when dead_share > 0.4 then -0.05e0 end as adjustment
from sm left join osc on osc.stream = sm.stream""")
def i12(t):
    return adv.decay_suggestion(summary(t), adv.oscillation(adjustments(t), T0))


@query("I13_fielded_bm25", LEXBASE + " chunks chunk_entity dict_rel doc_tokens", f"""
with names as (select c.id, coalesce(string_agg(distinct name, ' ' order by name), '') as names from chunks c left join chunk_entity e on e.id = c.id where deleted_at is null group by c.id),
rels as (select c.id, coalesce(string_agg(distinct e.subject || ' ' || relation || ' ' || object, ' ' order by e.subject || ' ' || relation || ' ' || object), '') as names
  from chunks c left join (select id, r.* from chunk_entity join dict_rel r on name = subject or name = object) e on e.id = c.id where deleted_at is null group by c.id),
{"".join(f'''{p}t as (select id, unnest({TOK.format('names')}) as token from {src}), {p}s as (select n, (select count(*) from {p}t) * 1e0 / n as avg_dl from doc_stats),
{p}tf as (select id, token, count(*) as tf from {p}t group by all), {p}df as (select token, count(*) as df from {p}tf group by token), {p}dl as (select id, count(*) as dl from {p}t group by id),
{p}x as (select query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) as score from q_terms join {p}tf using (token) join {p}df using (token) join {p}dl using (id), {p}s group by all),
''' for p, src in (('e', 'names'), ('r', 'rels')))}
u as (select query_id, id, round(sum(score), 6) as score from (select * from lex union all select query_id, id, score * 0.2e0 from ex union all select query_id, id, score * 0.2e0 from rx) group by all),
{top_cte('o', 'u', 10)} select query_id, id, score, rank from o""")
def i13(t):
    """Content, entity names and relation triples, weights 1, .2 and .2."""
    return long_rank(packs.fielded_search(t.queries, t.fielded_index, {"content": 1.0, "entities": 0.2, "relations": 0.2}, 10))


# ---- 2.J -----------------------------------------------------------------

@query("J1_lexical_search", "lex", f"with {top_cte('o', 'lex', 5)} select * from o")
def j1(t):
    return long_rank(hybrid.lexical_search(t.queries, t.chunks, 5, index=t.index))


@query("J1_bounded_search", "lex", f"with {top_cte('o', 'lex', 5)} select * from o")
def j1b(t):
    """The same hits by the way that bounds scores first."""
    return long_rank(hybrid.lexical_search(t.queries, t.chunks, 5, index=t.stored_index, bounded=True))


@query("J1_date_range_search", "lex chunks", f"""
with f as (select lex.* from lex join chunks c using (id) where coalesce(cast(epoch(cast(event_date as date)) as bigint) + 43200, timestamp) between {B7_RANGE[0]} and {B7_RANGE[1]}),
{top_cte('o', 'f', 10)} select * from o""")
def j1d(t):
    return long_rank(hybrid.lexical_search(t.queries, t.chunks, 10, index=t.index, dates=B7_RANGE))


@query("J1_agent_search", "lex chunks", f"""
with f as (select lex.* from lex join chunks c using (id) where coalesce(agent, 'unknown') not in ('api', 'mcp')), {top_cte('o', 'f', 10)} select * from o""")
def j1a(t):
    return long_rank(hybrid.lexical_search(t.queries, t.chunks, 10, index=t.index, exclude_agents=["api", "mcp"]))


@query("J2_vector_search", "qvec vectors chunks qs", f"""
with v as (select q.query_id, v.id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as sim from qvec q join qs using (query_id) join chunks c on c.stream = qs.stream
  join vectors v on v.id = c.id where c.deleted_at is null), {top_cte('o', 'v', 10, 'sim desc, id')} select * from o""")
def j2(t):
    q = t.query_vectors.join(t.queries.select("query_id", "stream"), "query_id")
    return long_rank(hybrid.vector_search(q, t.vectors, t.chunks, 10, by_stream=True))


def twins_sql(src: str) -> str:
    """Recursive CTE text that drops prefix twins of `src(query_id, id, rank, pr)`."""
    return f"""w as (select query_id, id, rank, pr, [pr] as kept, true as ok from {src} where rank = 1
  union all select p.query_id, p.id, p.rank, p.pr, case when x.twin then w.kept else list_append(w.kept, p.pr) end, not x.twin
  from w join {src} p on p.query_id = w.query_id and p.rank = w.rank + 1,
  lateral (select len(list_filter(w.kept, lambda k: least(strlen(k), strlen(p.pr)) >= 30 and
    len(list_filter(range(1, 151), lambda i: i <= len(k) and i <= len(p.pr) and left(k, i) = left(p.pr, i))) * 1e0 / least(strlen(k), strlen(p.pr)) > 0.8)) > 0 as twin) x)"""


J3_AT = T0 - 12 * 86400


def scoped_views(tag: str, lexical: str, vector: str) -> None:
    """The views from channels to `fused`, over narrowed hits."""
    swap = lambda body: body.replace("from lex_top", f"from lex_top_{tag}").replace("join vec_top", f"join vec_top_{tag}").replace("from channels", f"from channels_{tag}").replace("from pool", f"from pool_{tag}")
    VIEWS[f"lex_top_{tag}"] = ("lex lex_stream chunks", lexical)
    VIEWS[f"vec_top_{tag}"] = ("vec_hits qs chunks", vector)
    VIEWS[f"channels_{tag}"] = (f"lex_top_{tag} vec_top_{tag}", swap(VIEWS["channels"][1]))
    VIEWS[f"pool_{tag}"] = (f"channels_{tag} chunks", swap(VIEWS["pool"][1]))
    VIEWS[f"fused_{tag}"] = (f"pool_{tag}", swap(VIEWS["fused"][1]))


TOP20 = "select * exclude (rk) from (select query_id, id, {v}, row_number() over (partition by query_id order by {v} desc, id) as rk from {src}) where rk <= 20"
scoped_views("agent", TOP20.format(v="score", src="(select lex.* from lex join chunks c using (id) where coalesce(agent, 'unknown') <> 'raw-transcript')"),
             TOP20.format(v="sim", src="vec_hits join chunks c using (id) where coalesce(agent, 'unknown') <> 'raw-transcript'"))
scoped_views("stream", TOP20.format(v="score", src="lex_stream"), TOP20.format(v="sim", src="(select v.* from vec_hits v join qs using (query_id) join chunks c on c.id = v.id and c.stream = qs.stream)"))


@query("J3_hybrid_by_stream", "fused_stream chunks", f"""
with pl as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rk from fused_stream) where rk <= 30),
aj as (select * exclude (score), {adjust_sql(access=0.0)} as score from pl), fl as (select * from aj where is_latest),
{top_cte('o', '(select query_id, id, score from fl)', 10)} select * from o""")
def j3s(t):
    """Every question sees its own stream only, in both channels."""
    h = hybrid.hybrid_search(t.queries, t.query_vectors, t.chunks, t.vectors, T0, 10, index=t.index, prefix_dedup=False, by_stream=True)
    return h.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("J3_hybrid_search", "fused_agent chunks", f"""
with recursive pl as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rk from fused_agent) where rk <= 30),
aj as (select * exclude (score), {adjust_sql(access=0.0)} as score from pl),
fl as (select * from aj where (valid_from is null or valid_from <= {J3_AT}) and (valid_until is null or valid_until >= {J3_AT}) and is_latest),
rk as (select f.query_id, f.id, f.score, f.agent, lower(left(content, 150)) as pr, row_number() over (partition by f.query_id order by f.score desc, f.id) as rank from fl f join chunks c on c.id = f.id),
{twins_sql('rk')},
kp as (select rk.* from rk join w on w.query_id = rk.query_id and w.id = rk.id and w.ok),
{top_cte('o', '(select query_id, id, score from kp)', 10)} select * from o""")
def j3(t):
    """Both channels of all agents but one, fused, adjusted, as of a day, latest only, twins dropped."""
    h = hybrid.hybrid_search(t.queries, t.query_vectors, t.chunks, t.vectors, T0, 10, index=t.index, valid_at=J3_AT, exclude_agents=["raw-transcript"])
    return h.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("J3_hybrid_with_graph_and_lane", "fused chunks edge_evidence edges qs " + LEXBASE + " doc_df", f"""
with {RELATED1}, {LANE},
fr as (select *, row_number() over (partition by query_id order by score desc, id) as rk from fused),
pl as (select * from fr where rk <= 30 or (query_id, id) in (select query_id, id from lane)),
b as (select pl.* exclude (score, decay, rk), pl.decay, round(pl.score * (1 + coalesce(graph, 0) * 0.3e0), 12) as score from pl left join rel on rel.query_id = pl.query_id and rel.id = pl.id),
x as (select r.query_id, c.* exclude (score, content), 1e0 as decay, round(graph * 0.3e0, 12) as score, row_number() over (partition by r.query_id order by graph desc, r.id) as k from rel r join chunks c on c.id = r.id
  where deleted_at is null and not dormant and (r.query_id, r.id) not in (select query_id, id from pl)),
al as (select query_id, id, level, tier, importance, access_count, fact_type, subject, decay, score from b
  union all select query_id, id, level, tier, importance, access_count, fact_type, subject, decay, score from x where k <= 3),
aj as (select query_id, id, subject, {adjust_sql(access=0.0)} as score from al),
rk as (select *, row_number() over (partition by query_id order by score desc, id) as rank from aj),
su as (select *, row_number() over (partition by query_id, lower(subject) order by rank) as sn from rk),
{top_cte('o', '(select query_id, id, score from su where sn = 1 or subject is null)', 30)} select * from o""")
def j3g(t):
    """An enumeration query: graph rows and rare-term rows join, one row per subject, 30 hits."""
    g = graph.related_chunks(starts(t), t.edge_mentions, graph.evidence_rows(t.edge_mentions), hops=1)
    lane = hybrid.rare_term_lane(t.queries, t.chunks, index=t.index)
    h = hybrid.hybrid_search(t.queries, t.query_vectors, t.chunks, t.vectors, T0, 10, index=t.index, graph_scores=g, lane=lane, include_superseded=True,
                             enumerate_subjects=True, prefix_dedup=False, most=30)
    return h.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


VIEWS["lex_top_merged"] = (LEXBASE + " lex_top bench_words qs", f"""with {EXP_TERMS}, {bm25_cte('ex', 'et')}, {top_cte('e', 'ex', 20)}
select query_id, id, max(score) as score, 1 as rank from (select query_id, id, score from lex_top union all select query_id, id, round(score * 0.5, 6) from e
  union all select l.query_id - 1, id, score from lex_top l where l.query_id > 0) group by all""")
VIEWS["vec_top_merged"] = ("vec_top", """select query_id, id, round(sum(score), 6) as sim, 1 as rank from (select query_id, id, sim as score from vec_top
  union all select query_id - 1, id, sim * 0.5e0 from vec_top where query_id > 0 and rank <= 10 and sim >= 0.3) group by all""")
for _view, _body in (("channels", VIEWS["channels"][1]), ("pool", VIEWS["pool"][1]), ("fused", VIEWS["fused"][1])):
    for _name in ("lex_top", "vec_top", "channels", "pool"):
        _body = _body.replace(f"from {_name}", f"from {_name}_merged").replace(f"join {_name}", f"join {_name}_merged")
    VIEWS[f"{_view}_merged"] = ({"channels": "lex_top_merged vec_top_merged", "pool": "channels_merged chunks", "fused": "pool_merged"}[_view], _body)


@query("J3_hybrid_by_class", "fused_merged chunks asked", f"""
with recursive {H1_CTE}, ru as (select query_id, {COMPLEXITY_SQL} as complexity, {COUNTING_SQL} as counting from k),
pl as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rk from fused_merged) where rk <= 30),
aj as (select pl.* exclude (score), complexity, {adjust_sql(access=0.0).replace("case when level = 1 then 1.5e0 else 1e0 end", "case when counting then case when level = 1 then 0.7e0 else 1.5e0 end when level = 1 then 1.5e0 else 1e0 end")} as score from pl join ru using (query_id)),
fl as (select * from aj where is_latest and (complexity <> 'temporal' or coalesce(cast(epoch(cast(event_date as date)) as bigint) + 43200, timestamp) between {B7_RANGE[0]} and {B7_RANGE[1]})),
rk as (select f.query_id, f.id, f.score, f.complexity, f.subject, f.timestamp, lower(left(c.content, 150)) as pr,
  row_number() over (partition by f.query_id order by case when complexity = 'temporal' then f.timestamp end, f.score desc, f.id) as rank from fl f join chunks c on c.id = f.id),
{twins_sql('rk')},
kp as (select rk.* from rk join w on w.query_id = rk.query_id and w.id = rk.id and w.ok),
su as (select *, row_number() over (partition by query_id, case when complexity = 'aggregation' then lower(subject) end order by rank) as sn from kp),
o as (select query_id, id, score, complexity, row_number() over (partition by query_id order by case when complexity = 'temporal' then timestamp end, score desc, id) as rank
  from su where sn = 1 or complexity <> 'aggregation' or subject is null)
select query_id, id, score, rank, complexity from o where rank <= case when complexity = 'aggregation' then 30 else 10 end""")
def j3c(t):
    """Every question by the rules of its class, in one plan; expanded and cut-up questions merged into the channels."""
    notes = annotate.annotate_queries(asked(t)).select("query_id", "complexity", "counting")
    dates = notes.where("complexity = 'temporal'").select("query_id", F.lit(B7_RANGE[0]).cast("long").alias("date_from"), F.lit(B7_RANGE[1]).cast("long").alias("date_to"))
    sub_vec = t.query_vectors.where("query_id > 0").withColumn("query_id", F.col("query_id") - 1)
    h = hybrid.hybrid_search(t.queries, t.query_vectors, t.chunks, t.vectors, T0, 10, index=t.index, rules=hybrid.class_rules(notes, 10, dates=dates),
                             expanded=expanded(t), parts=sub_queries(t), part_vectors=sub_vec)
    return h.join(notes.select("query_id", "complexity"), "query_id").select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"), "complexity")


@query("J4_lexical_fallback", "lex_top chunks", f"""
with n as (select l.query_id, l.id, round(l.score / max(l.score) over (partition by l.query_id) * exp(-(case when level = 0 then 0.05e0 else 0.03e0 end) * ({T0} - timestamp) / 86400e0), 6) as score
  from lex_top l join chunks c using (id)), {top_cte('o', 'n', 30)} select * from o""")
def j4(t):
    return hybrid.lexical_only(t.queries, t.chunks, T0, index=t.index).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("J5_rare_term_lane", LEXBASE + " doc_df", f"with {LANE} select query_id, id, score, rank from lane")
def j5(t):
    return long_rank(hybrid.rare_term_lane(t.queries, t.chunks, index=t.index))


def query_names(t):
    return entities.entity_matches(t.queries, t.dict_alias, "text", "query_id").select("query_id", "name").distinct()


STOP = "[" + ", ".join(lit(w) for w in lx.ATTRIBUTE_STOPWORDS) + "]"


@query("J6_direct_lookup", "qs q_terms dict chunk_entity chunks", f"""
with asked as (select * from qs), {H1_CTE}, nm as (select distinct query_id, name from q_terms join dict on alias = token),
fq as (select query_id from k where query_type = 'factual' and query_id in (select query_id from nm)),
tm as (select query_id, list(distinct token) as terms from q_terms q where len(token) >= 3 and not list_contains({STOP}, token)
  and not exists (select 1 from nm where nm.query_id = q.query_id and contains(lower(name), token)) group by query_id),
cd as (select *, row_number() over (partition by query_id order by id) as n from (select distinct nm.query_id, e.id from nm join fq using (query_id) join chunk_entity e on e.name = nm.name)),
ht as (select cd.query_id, cd.id, timestamp from cd join chunks c using (id) join tm using (query_id) where n <= 64 and not dormant and deleted_at is null
  and len(list_filter(terms, lambda x: contains(lower(content), x))) > 0),
{top_cte('o', 'ht', 10, 'timestamp desc, id')} select query_id, id, rank from o""")
def j6(t):
    return packs.direct_lookup(t.queries, query_names(t), t.chunk_entity, t.chunks).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("J7_signal_breakdown", "rrf", """
select query_id, id, dense_raw, dense_rank, lexical_raw, lexical_rank, round(recency, 6) as recency_raw, recency_rank, rrf from rrf""")
def j7(t):
    p = rrf_pool(t)
    return p.select("query_id", "id", F.col("dense").alias("dense_raw"), F.col("dense_rank").cast("long").alias("dense_rank"), F.col("lexical").alias("lexical_raw"),
                    F.col("lexical_rank").cast("long").alias("lexical_rank"), F.round("recency", 6).alias("recency_raw"), F.col("recency_rank").cast("long").alias("recency_rank"), "rrf")


@query("J8_ambient_snippets", "chunks doc_stats doc_dl doc_tokens", rf"""
with u as (select conv_id as query_id, max_by(text, turn) as text from conversations where role = 'user' and text <> '' group by conv_id),
ct as (select query_id, token, count(*) as qtf from (select query_id, unnest({TOK.format('text')}) as token from u) group by all),
{bm25_cte('cl', 'ct')}, {top_cte('tp', 'cl', 20)},
p as (select t.query_id, t.id, t.score as lexical, level, content, exp(-greatest(0, ({T0} - timestamp) / 86400e0) / 30) as recency, t.rank as lr from tp t join chunks c using (id)),
r as (select *, round(coalesce(0.35e0 / 0.43e0 / (60 + case when lexical > 0 then lr end), 0) + 0.08e0 / 0.43e0 / (60 + row_number() over (partition by query_id order by recency desc, id)), 8) as rrf,
  count(*) over (partition by query_id) - 1 as near from p),
c as (select *, round(0.5e0 * rrf / max(rrf) over (partition by query_id) + 0.2e0 * case level when 0 then 1e0 when 1 then 0.7e0 else 0.4e0 end + 0.15e0 * recency
  + 0.15e0 * case when near = 0 then 0e0 when near = 1 then 0.5e0 else 1e0 end, 6) as confidence from r),
t5 as (select *, case when confidence >= 0.75 then 'high' when confidence >= 0.45 then 'medium' else 'low' end as tier from (select *, row_number() over (partition by query_id order by rrf desc, id) as k from c) where k <= 5),
s1 as (select *, {TRIM.format('content')} as cc from t5 where tier <> 'low'), s2 as (select *, case when {FIRST_SQL.format('cc')} = '' then cc else {FIRST_SQL.format('cc')} end as s from s1),
s3 as (select *, {THIRD_SQL} as snippet from s2), s4 as (select * from s3 where not regexp_matches(snippet, {lit(tx.METAWORDS)}) and strlen(snippet) // 4 + 1 <= 200),
g as (select *, row_number() over w as pos, sum(strlen(snippet) // 4 + 1) over w as spent from s4 window w as (partition by query_id order by case tier when 'high' then 1 else 2 end, confidence desc, id))
select query_id, pos, id, tier, confidence, md5(snippet) as snippet_md5, null as marker from g where spent <= 1500
union all select query_id, 0, null, null, null, null, case when max(case when tier <> 'low' then 1 else 0 end) = 0 then 'all_low_tier' else 'below_threshold' end
  from (select u.query_id, tier from u left join t5 using (query_id)) where query_id not in (select query_id from g) group by query_id""")
def j8(t):
    a = packs.ambient(packs.last_user_turns(t.turns), t.chunks, T0, index=t.index)
    return a.select("query_id", F.col("pos").cast("long").alias("pos"), "id", "tier", "confidence", F.md5("snippet").alias("snippet_md5"), "marker")


def profile_lines(t):
    """Top contents of every stream as its profile text."""
    top = listings.top_contents(t.chunks, 3)
    return top.join(t.chunks.select("id", "content"), "id").select("stream", F.col("rank").alias("pos"), "content")


def wt(c):
    return f"cast(floor(len({WORDS.format(c)}) * 1.3e0) as bigint)"


PACK = f"""ch as (select *, '- [' || coalesce(event_date, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d')) || '] ' || content || chr(10) as line from chunks where deleted_at is null),
rl as (select l.query_id, 'relevant' as section, l.id, row_number() over (partition by l.query_id order by l.score desc, l.id) as rank, {wt('line')} as cost, 2000 as lim from lex_stream l join ch on ch.id = l.id qualify rank <= 10),
nw as (select stream, id, line, row_number() over (partition by stream order by timestamp desc, id) as rank from ch where is_latest and not dormant qualify rank <= 15),
rc as (select query_id, 'recent' as section, nw.id, rank, {wt('line')} as cost, 1200 as lim from qs join nw using (stream)),
ln as (select *, cast(sum(cost) over (partition by query_id, section order by rank) as bigint) as spent from (select * from rl union all select * from rc))"""


@query("J9_context_pack", "chunks lex_stream qs", f"with {PACK} select query_id, section, id, rank, spent from ln where spent <= lim")
def j9(t):
    lines, _ = packs.context_pack(t.queries, t.chunks, profile_lines(t), index=t.index)
    return lines.select("query_id", "section", "id", F.col("rank").cast("long").alias("rank"), "spent")


@query("J9_context_pack_summary", "chunks lex_stream qs", f"""
with {PACK}, tc as (select stream, content, row_number() over (partition by stream order by coalesce(importance, 0) desc, timestamp desc, id) as pos from chunks where deleted_at is null qualify pos <= 3),
pf as (select stream, string_agg(content, chr(10) order by pos) as text from tc group by stream),
pc as (select stream, len({WORDS.format('text')}) > 615 as cut, case when len({WORDS.format('text')}) > 615 then cast(floor(615 * 1.3e0) as bigint) else {wt('text')} end as profile_tokens from pf),
s as (select query_id, cast(sum(case when spent <= lim then cost else 0 end) as bigint) as line_tokens, count(*) filter (where spent <= lim) as n_lines,
  max(case when section = 'relevant' and spent > lim then 1 else 0 end) + max(case when section = 'recent' and spent > lim then 1 else 0 end) as cuts from ln group by query_id)
select query_id, coalesce(profile_tokens, 0) as profile_tokens, coalesce(line_tokens, 0) as line_tokens, coalesce(n_lines, 0) as n_lines,
  round(greatest(0, least(1, (2 + case when cut is not null then 1 else 0 end) / 3e0 - (coalesce(cast(cut as int), 0) + coalesce(cuts, 0)) * 0.1e0)), 6) as coverage
from qs left join pc using (stream) left join s using (query_id)""")
def j9s(t):
    return packs.context_pack(t.queries, t.chunks, profile_lines(t), index=t.index)[1]


@query("J10_manual_boost", "chunks ratings", """
select id, case when r.chunk_id is not null then 1.5e0 else importance end as importance, case when r.chunk_id is not null then 1e0 else score end as score
from chunks left join (select distinct chunk_id from ratings where usefulness > 0) r on r.chunk_id = id""")
def j10m(t):
    """Rows that somebody found useful are boosted by hand."""
    chosen = t.ratings.where("usefulness > 0").select(F.col("chunk_id").alias("id"))
    return packs.boost_importance(t.chunks, chosen).select("id", "importance", "score")


@query("J10_search_effects", "lex_top chunks", f"""
with recursive h as (select query_id, id, rank, {T0} - query_id * 30000 as ts from lex_top), n as (select id, count(*) as seen from h group by id),
hd as (select id, ts, row_number() over (partition by id order by ts) as k from (select distinct id, ts from h where rank <= 3)),
w as (select hd.id, k, case when last_implicit_boost is null or ts - last_implicit_boost >= 86400 then ts else last_implicit_boost end as last,
    case when last_implicit_boost is null or ts - last_implicit_boost >= 86400 then 1 else 0 end as boosts from hd join chunks c on c.id = hd.id where k = 1
  union all select w.id, hd.k, case when last is null or ts - last >= 86400 then ts else last end, boosts + case when last is null or ts - last >= 86400 then 1 else 0 end from w join hd on hd.id = w.id and hd.k = w.k + 1),
l as (select id, max_by(boosts, k) as boosts from w group by id)
select c.id, case when boosts > 0 then round(least(1.5, coalesce(importance, 1.0) + 0.1e0 * boosts), 6) else importance end as importance,
  case when seen > 0 then 1e0 else score end as score, access_count + coalesce(seen, 0) as access_count from chunks c left join n using (id) left join l using (id)""")
def j10(t):
    hits = hybrid.lexical_search(t.queries, t.chunks, 20, index=t.index).withColumn("ts", T0 - F.col("query_id") * 30000)
    return packs.apply_search_effects(t.chunks, hits).select("id", "importance", "score", "access_count")
