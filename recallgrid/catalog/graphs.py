"""2.K entity graph, clustering, discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as assoc, clustering, entities, graph, lexical, links, merging, resolution
from ..plans import hybrid
from ..session import scratch_path
from ..sources.chunk_store import live
from ..sources.views import T0
from .base import query
from .joins import anchors, person_names, starts
from .oracle_views import TOK, VIEWS
from .retrieval import CENT, centroids
from .windows import latents


@query("K1_dictionary_entities", "chunk_entity", "select * from chunk_entity")
def k1(t):
    return entities.extract_entities(live(t.chunks), t.dict_alias)


def mentions(t):
    return person_names(t).withColumn("mention_id", F.col("entity_id")).withColumn("chunk_id", F.col("entity_id"))


@query("K2_entity_resolution", "chunks", r"""
with recursive p as (select id, stream, timestamp as ts, array_to_string(string_split(content, ' ')[1:case when doc_id % 3 = 0 then 1 else 2 end], ' ') as name from chunks),
m as (select *, lower(trim(name)) as key from p where trim(name) <> ''),
n as (select stream, key, min(ts) as ts, md5(stream || '|Person|' || key) as eid, min(name) as name,
  ' ' || array_to_string(list_filter(regexp_split_to_array(key, '\s+'), lambda w: len(w) > 0), ' ') || ' ' as f from m group by stream, key),
al as (select eid, other from (select a.eid, b.eid as other, row_number() over (partition by a.eid order by b.ts, b.eid) as k from n a join n b on a.stream = b.stream and a.eid <> b.eid
  and (b.ts, b.eid) < (a.ts, a.eid) and (contains(a.f, b.f) or contains(b.f, a.f))) where k = 1),
w as (select eid, eid as root from n union all select w.eid, al.other from w join al on al.eid = w.root),
r as (select w.eid, w.root from w where not exists (select 1 from al where al.eid = w.root))
select m.id as mention_id, r.root as entity_id, n.name as canonical from m join r on r.eid = md5(m.stream || '|Person|' || m.key) join n on n.eid = r.root""")
def k2(t):
    """Person names: the first one or two words of every row."""
    return resolution.resolve(mentions(t)).select("mention_id", "entity_id", "canonical")


FOUND = """fe as (select stream, x.subject as source, x.object as target, relation, c.id as chunk_id from (select distinct id, subject, relation, object from chunk_entity join dict_rel on name = subject or name = object) x join chunks c using (id))"""


@query("K3_edge_upsert", "edge_evidence chunk_entity dict_rel chunks", f"""
with {FOUND}, kn as (select stream, source, target, relation, chunk_id from edge_evidence)
select stream, source, target, relation, count(*) as evidence from (select * from kn union select * from fe) group by all""")
def k3(t):
    """Edges seen in text join the known ones; half arrive with an untidy label."""
    rel = entities.dictionary_relations(t.chunk_entity, t.dict_relation).join(t.chunks.select("id", "stream", "doc_id"), "id")
    found = rel.select("stream", F.col("subject").alias("source"), F.col("object").alias("target"),
                       F.when(F.col("doc_id") % 2 == 0, " USES ").otherwise("uses").alias("relation"), F.col("id").alias("chunk_id"))
    return resolution.edge_table(resolution.upsert_edges(t.edge_evidence, found))


@query("K4_graph_build", "chunk_entity dict_rel chunks dict", f"""
with {FOUND}, en as (select c.stream, name, count(distinct id) as n from chunk_entity join chunks c using (id) group by c.stream, name, entity_type)
select 'entity' as kind, stream, name as a, '' as b, n from en
union all select 'edge', stream, source, target, count(distinct chunk_id) from fe group by all""")
def k4(t):
    """Extract, resolve and connect in one job over all live rows."""
    found = t.chunk_entity.join(t.chunks.select("id", "stream", "timestamp"), "id")
    r = resolution.resolve(found.select(F.concat_ws("|", "id", "name").alias("mention_id"), "stream", "entity_type", "name",
                                        F.col("timestamp").alias("created_at"), F.col("id").alias("chunk_id")))
    en = resolution.entity_table(r).select(F.lit("entity").alias("kind"), "stream", F.col("canonical").alias("a"), F.lit("").alias("b"), F.col("n_chunks").alias("n"))
    rel = entities.dictionary_relations(t.chunk_entity, t.dict_relation).join(t.chunks.select("id", "stream"), "id")
    ev = rel.select("stream", F.col("subject").alias("source"), F.col("object").alias("target"), "relation", F.col("id").alias("chunk_id"))
    ed = resolution.edge_table(ev.distinct()).select(F.lit("edge").alias("kind"), "stream", F.col("source").alias("a"), F.col("target").alias("b"), F.col("evidence").alias("n"))
    return en.unionByName(ed)


@query("K5_entity_cards", "graph_entities edge_evidence edges", """
with ec as (select source as entity_id, chunk_id from edge_evidence union select target, chunk_id from edge_evidence),
n as (select entity_id, count(*) as chunks from ec group by all),
l as (select source as entity_id, 'out:' || relation || ':' || target as link from edges union select target, 'in:' || relation || ':' || source from edges)
select entity_id, name, entity_type, coalesce(chunks, 0) as chunks, link from graph_entities left join n using (entity_id) left join l using (entity_id)""")
def k5(t):
    return resolution.entity_cards(t.graph_entities, graph.evidence_table(t.edge_evidence), t.edges)


@query("K6_chunk_removal", "edge_evidence chunks", """
with gone as (select id as chunk_id from chunks where deleted_at is not null or stream in ('s1', 's2')),
ec as (select * from (select source as entity_id, chunk_id from edge_evidence union select target, chunk_id from edge_evidence) where chunk_id not in (select chunk_id from gone)),
al as (select distinct entity_id from ec),
ev as (select * from edge_evidence where chunk_id not in (select chunk_id from gone) and source in (select entity_id from al) and target in (select entity_id from al))
select 'entity' as kind, entity_id as a, '' as b, count(*) as n from ec group by all union all select 'edge', source, target, count(*) from ev group by all""")
def k6(t):
    gone = t.chunks.where("deleted_at is not null or stream in ('s1', 's2')").select(F.col("id").alias("chunk_id"))
    ev, ec = resolution.without_chunks(t.edge_evidence, graph.evidence_table(t.edge_evidence), gone)
    a = ec.groupBy("entity_id").agg(F.count("*").alias("n")).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("a"), F.lit("").alias("b"), "n")
    return a.unionByName(ev.groupBy("source", "target").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "n"))


def walk_round(hop: int) -> str:
    """SQL of one hop of every walk; the drawn threshold is a fixed hash of the step."""
    prev = f"w{hop - 1}"
    return f"""c{hop} as (select {prev}.*, sym.other, weight, sum(weight) over (partition by query_id, walk) as total,
  sum(weight) over (partition by query_id, walk order by other rows between unbounded preceding and current row) as cum,
  (({prev}.walk + walk * 3 + {hop}) * 2654435761) % 1000 / 1000e0 as draw from {prev} join sym on sym.node = {prev}.cur where done = {hop - 1} and not list_contains(path, other)),
p{hop} as (select query_id, walk, min(other) as step from c{hop} where round(cum, 9) >= round(draw * total, 9) group by all),
w{hop} as (select query_id, seed, walk, coalesce(step, cur) as cur, case when step is null then path else list_append(path, step) end as path,
  case when step is null then done else {hop} end as done from {prev} left join p{hop} using (query_id, walk))"""


@query("K7_weak_tie_walk", "edges qs", f"""
with sym as (select node, other, 1e0 / greatest(1, min(evidence)) as weight from (select source as node, target as other, evidence from edges union all select target, source, evidence from edges) group by all),
w0 as (select query_id, 'S' || (query_id + 1) as seed, walk, 'S' || (query_id + 1) as cur, ['S' || (query_id + 1)] as path, 0 as done from qs, (values (0), (1)) v(walk)),
{walk_round(1)}, {walk_round(2)}, {walk_round(3)} select query_id, seed, walk, cur as terminal, done as hops from w3""")
def k7(t):
    return assoc.weak_tie_walks(starts(t), t.edges)


@query("K8_stream_kmeans", "chunks vectors", """
with n as (select stream, count(*) as n from vectors join chunks using (id) where is_latest and deleted_at is null group by stream having count(*) >= 3)
select stream, n as rows, cast(least(n, greatest(2, least(50, ceil(sqrt(n / 2e0))))) as bigint) as clusters from n""")
def k8(t):
    """Rows and clusters of every stream; the assignment itself has its own test."""
    a, c = clustering.cluster_streams(t.vectors, t.chunks)
    return a.groupBy("stream").agg(F.count("*").alias("rows")).join(c.groupBy("stream").agg(F.count("*").alias("clusters")), "stream")


QC = """qc as (select query_id, max_by(cluster, (s, -cluster)) as qcluster from (select query_id, cluster, round(list_cosine_similarity(q.embedding::double[], centroid), 6) as s from qvec q, cn) group by query_id)"""


@query("K9_query_cluster", "vectors qvec", f"with {CENT}, {QC} select * from qc")
def k9(t):
    return assoc.query_cluster(t.query_vectors, centroids(t))


SAP = f"""{CENT}, {QC}, cx as (select query_id, v.embedding as cv from lex_top l join vectors v using (id) where rank <= 5),
mc as (select query_id, list(m order by pos) as mean from (select query_id, pos, avg(x) as m from (select query_id, unnest(cv)::double as x, generate_subscripts(cv, 1) as pos from cx) group by all) group by query_id),
nc as (select *, row_number() over (partition by query_id order by s desc, cluster) as k from (select query_id, cluster, round(list_cosine_similarity(mean, centroid), 6) as s from mc join qc using (query_id), cn where cluster <> qcluster) where s > 0.0),
cd as (select query_id, v.id, round(list_cosine_similarity(v.embedding::double[], mean), 6) as relevance, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) as obviousness
  from nc join qs using (query_id) join qvec q using (query_id) join mc using (query_id) join chunks c on c.stream = qs.stream join vectors v on v.id = c.id and v.label = nc.cluster
  where k <= 5 and is_latest and deleted_at is null and coalesce(agent, '') <> 'raw-transcript' and strlen(content) >= 10),
sap as (select *, round(relevance * (1 - obviousness), 6) as score from cd where relevance >= 0.05 and obviousness <= 0.6)"""


def context(t):
    return hybrid.lexical_search(t.queries, t.chunks, 5, index=t.index).join(t.vectors.select("id", "embedding"), "id").select("query_id", "embedding")


def clusters(t):
    return t.vectors.select("id", F.col("label").alias("cluster"))


def stream_query_vectors(t):
    return t.query_vectors.join(t.queries.select("query_id", "stream"), "query_id")


def adjacent(t):
    return assoc.adjacent_possible(stream_query_vectors(t), context(t), t.chunks, t.vectors, clusters(t), centroids(t), 6, relevance_min=0.05, cluster_min=0.0)


@query("K10_adjacent_possible", "vectors qvec lex_top chunks qs", f"""
with {SAP} select query_id, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as rank from sap) where rank <= 6""")
def k10(t):
    return adjacent(t).select("query_id", "id", "score")


def discovered(t):
    return assoc.discover_latents(t.chunks, t.vectors, clusters(t), centroids(t), t.edges, graph.evidence_table(t.edge_evidence), min_score=0.02)


LATENT_SQL = f"""{CENT}, sym as (select node, other, 1e0 / greatest(1, min(evidence)) as weight from (select source as node, target as other, evidence from edges union all select target, source, evidence from edges) group by all),
ec as (select source as entity_id, chunk_id from edge_evidence union select target, chunk_id from edge_evidence),
ok as (select id, stream, label as cluster from chunks join vectors using (id) where is_latest and deleted_at is null and id in (select chunk_id from ec)),
fi as (select * from (select *, row_number() over (partition by stream, cluster order by md5(id), id) as r from ok) where r = 1),
se as (select * from (select *, row_number() over (partition by stream order by cluster) as s from fi) where s <= 10),
st as (select id, entity_id from (select se.id, entity_id, row_number() over (partition by se.id order by entity_id) as k from se join ec on chunk_id = se.id) where k <= 3),
w0 as (select id || '|' || entity_id as query_id, entity_id as seed, walk, entity_id as cur, [entity_id] as path, 0 as done from st, (values (0), (1)) v(walk)),
{walk_round(1)}, {walk_round(2)}, {walk_round(3)},
hi as (select distinct split_part(query_id, '|', 1) as source, chunk_id as target from w3 join ec on cur = entity_id),
tg as (select c.id as target, stream, coalesce(label, 0) as cluster from chunks c left join vectors using (id)
  where is_latest and deleted_at is null and coalesce(agent, '') <> 'raw-transcript' and strlen(content) >= 10),
la as (select se.stream, source, hi.target, greatest(0, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6)) as r,
    coalesce(least(1, greatest(0, 1 - round(list_cosine_similarity(x.centroid, y.centroid), 6))), 0.5) as distance
  from hi join se on se.id = source join tg on tg.target = hi.target and tg.stream = se.stream join vectors a on a.id = source join vectors b on b.id = hi.target
  left join cn x on x.cluster = tg.cluster left join cn y on y.cluster = se.cluster where source <> hi.target and tg.cluster <> se.cluster),
lt as (select stream, source, target, score from (select *, row_number() over (partition by stream, target order by score desc, source) as k
  from (select stream, source, target, round(r * (1 - r) * distance, 6) as score from la) where score >= 0.02) where k = 1)"""


@query("K11_latent_discovery", "chunks vectors edge_evidence edges", f"with {LATENT_SQL} select * from lt")
def k11(t):
    """Walks from seed rows to rows of other clusters."""
    return discovered(t)


@query("K13_association_job")
def k13(t):
    """Walks, adjacent clusters, time neighbours and latents, one row per (query, row)."""
    qv, ctx, cl, cn = stream_query_vectors(t), context(t), clusters(t), centroids(t)
    shown = hybrid.lexical_search(t.queries, t.chunks, 10, index=t.index)
    ec = graph.evidence_table(t.edge_evidence)
    walked = assoc.weak_tie_walks(starts(t), t.edges).join(ec, F.col("terminal") == F.col("entity_id")).select("query_id", F.col("chunk_id").alias("id")).distinct()
    from ..operators.filters import associable
    ok = t.chunks.where(associable()).select("id")
    near = links.temporal_neighbours(anchors(t), t.chunks, cl, t.vectors, 24, 6).select("query_id", "id")
    score = lambda cand: assoc.serendipity(cand, t.query_vectors, ctx, t.vectors, cl, cn).where("score >= 0.02")
    lat = discovered(t).withColumn("sec", F.lit(T0)).withColumn("event_id", F.xxhash64("source", "target"))
    late = assoc.latent_candidates(lat, qv, t.vectors, min_sim=0.1)
    return merging.first_mechanism([("graph_walk", score(walked.join(ok, "id", "left_semi"))), ("adjacent_possible", score(adjacent(t).select("query_id", "id"))),
                                    ("temporal", score(near)), ("discovery", late)], shown, 3).select("query_id", "id", "score", "mechanism")
