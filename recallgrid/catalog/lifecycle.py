"""2.L memory life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import graph, lexical, links, textjobs as tx
from ..operators.similarity import nearest
from ..plans import lifecycle as lc
from ..sources import chunk_store
from ..sources.chunk_store import live
from ..sources.views import T0
from .base import query
from .joins import PAIRS, incoming, pair_sql
from .texts import PHONE_SQL, TYPE_SQL, clean_sql, flags_sql
from ..functions import scoring


def arrivals(t):
    """Every document arrives with its markup from a page, some far too long."""
    p = t.pages.select(F.col("page_id").alias("doc_id"), "html")
    return t.chunks.join(p, "doc_id", "left").select(
        "id", F.concat("content", F.coalesce(F.concat(F.lit("\n"), "html"), F.lit(""))).alias("content"), F.lit("{}").alias("metadata"), "stream", F.col("source.agent").alias("agent"))


def redact_sql(c: str) -> str:
    phones = f"regexp_replace(regexp_replace({c}, {PHONE_SQL}), {PHONE_SQL})"
    return f"regexp_replace(regexp_replace({phones}, '{lx.EMAIL}', '[EMAIL]', 'g'), '{lx.ELEVEN_DIGITS}', '[ID]', 'g')"


ARRIVE = "ar as (select c.id, c.stream, c.agent, c.content || coalesce(chr(10) || html, '') as content from chunks c left join pages p on p.page_id = c.doc_id)"


@query("LC1_ingest", "chunks vectors", f"""
with {ARRIVE}, x as (select id, stream, coalesce(agent, 'api') as agent, content as raw, {redact_sql(clean_sql('content'))} as content from ar where strlen(content) <= 20000),
m as (select a.id, greatest(0, max(round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6))) as sim from vectors a join vectors b on a.id <> b.id group by a.id)
select x.id, stream, md5(content) as content_md5, {TYPE_SQL} as fact_type, len({flags_sql('raw')}) as injection_findings,
  case agent when 'api' then 'a1' when 'mcp' then 'a2' else 'b' end as trust_level,
  case when 1 - sim > 0.5 then 1.5e0 when 1 - sim > 0.2 then 1.0e0 when sim is not null then 0.7e0 end as importance from x left join m using (id)""")
def lc1(t):
    keep = [F.col("id"), F.col("stream"), F.md5("content").alias("content_md5"), F.col("fact_type"), F.col("injection_findings").cast("long").alias("injection_findings"), F.col("trust_level")]
    return lc.ingest(arrivals(t), t.vectors, t.vectors, T0, max_content=20000, keep=keep)[0]


@query("LC1_ingest_rejects", "chunks", f"with {ARRIVE} select id, stream, 'content_too_large' as reject from ar where strlen(content) > 20000")
def lc1r(t):
    return lc.check_sizes(arrivals(t), 20000).where("reject is not null").select("id", "stream", "reject")


def proposals(t):
    """Each vector's nearest latest row of its stream is what it would replace."""
    near = links.contradiction_candidates(incoming(t), t.chunks, t.vectors, 0.1, n=1)
    return near.join(t.chunks.select(F.col("id").alias("new_id"), F.col("trust_level").alias("new_trust")), "new_id").select("new_id", F.col("id").alias("old_id"), "new_trust")


RANK = "case {} when 'a1' then 3 when 'a2' then 2 else 1 end"
PROP = f"""pp as (select x.new_id, x.id as old_id, n.trust_level as new_trust, o.trust_level as old_trust, o.stream as old_stream, o.version as old_version, coalesce(o.root_memory_id, o.id) as root
  from ({pair_sql('sim >= 0.1', 1)}) x join chunks n on n.id = x.new_id join chunks o on o.id = x.id),
ap as (select * from (select *, row_number() over (partition by old_id order by new_id) as k from pp where {RANK.format('new_trust')} >= {RANK.format('old_trust')}) where k = 1)"""


@query("LC2_supersede", "chunks vectors", f"""
with {PROP} select c.id, is_latest and ap.new_id is null as is_latest, coalesce(ap.new_id, superseded_by) as superseded_by,
  case when ap.new_id is not null then {T0} else timestamp end as updated_at from chunks c left join ap on ap.old_id = c.id""")
def lc2(t):
    return lc.supersede(t.chunks, proposals(t), T0)[0].select("id", "is_latest", "superseded_by", "updated_at")


@query("LC2_supersede_links", "chunks vectors", f"with {PROP} select new_id, old_id, root as root_memory_id, old_version + 1 as version from ap")
def lc2l(t):
    return lc.supersede(t.chunks, proposals(t), T0)[1]


@query("LC2_trust_guard_blocked", "chunks vectors", f"""
with {PROP} select old_stream, old_id, old_trust, new_id, new_trust, 'contradiction' as context from pp where {RANK.format('new_trust')} < {RANK.format('old_trust')}""")
def lc2b(t):
    return lc.supersede(t.chunks, proposals(t), T0)[2]


@query("LC3_extend", "chunks vectors", f"with {PROP} select new_id, old_id, root as root_memory_id from pp")
def lc3(t):
    return lc.extend(t.chunks, proposals(t))


RELATION = "['updates', 'none', 'extends', 'none'][({}) % 4 + 1]"


def labels(t, pairs):
    """A stand-in for a model's verdict on each pair."""
    n = F.expr("cast(substring(new_id, 2) as bigint) + cast(substring(id, 2) as bigint)")
    return pairs.select("new_id", "id", F.element_at(F.array(*[F.lit(x) for x in ("updates", "none", "extends", "none")]), (n % 4 + 1).cast("int")).alias("relation"))


@query("LC4_relation_apply", "chunks vectors", f"""
with c as ({pair_sql('sim >= 0.1', 5)}), l as (select *, {RELATION.format("substr(new_id, 2)::bigint + substr(id, 2)::bigint")} as relation from c)
select new_id, id as old_id, relation from (select *, row_number() over (partition by new_id order by rank) as k from l where relation <> 'none') where k = 1""")
def lc4(t):
    cand = links.contradiction_candidates(incoming(t), t.chunks, t.vectors, 0.1)
    return lc.first_actionable(cand.select("new_id", "id", "rank"), labels(t, cand))


@query("LC5_topic_groups")
def lc5(t):
    """Order-dependent leader grouping; checked against a plain loop on a fixture."""
    return lc.topic_groups(chunk_store.in_batches(chunk_store.consolidation_eligible(t.chunks, T0)), t.vectors)


@query("LC6_consolidation")
def lc6(t):
    merged, _, _ = lc.consolidate(t.chunks, t.vectors, T0)
    return merged.select("id", "stream", "level", "valid_from", "valid_until", F.md5("content").alias("content_md5"), F.size("source_ids").alias("n_sources"))


@query("LC6_consolidation_report")
def lc6r(t):
    return lc.consolidate(t.chunks, t.vectors, T0)[2]


@query("LC7_quality_gate", "chunks vectors", """
with p as (select c.id, round(list_cosine_similarity(mv.embedding::double[], sv.embedding::double[]), 6) as sim from (select id, unnest(source_ids) as src from chunks where level = 1) c
  join vectors mv on mv.id = c.id join vectors sv on sv.id = c.src),
m as (select id, round(avg(sim), 9) as mean_sim from p group by id)
select c.id, mean_sim, coalesce(mean_sim >= 0.05, true) as passed from chunks c left join m using (id) where level = 1""")
def lc7(t):
    return lc.quality_gate(t.chunks.where("level = 1"), t.vectors, t.vectors, 0.05)


SUBJ = """sg as (select *, row_number() over (partition by stream, subject order by timestamp, id) as pos, count(*) over (partition by stream, subject) as n from (
  select stream, lower(subject) as subject, id, timestamp, event_date, content from chunks where is_latest and deleted_at is null and subject is not null))"""


@query("LC8_subject_groups", "chunks", f"""
with {SUBJ} select stream, subject, id, pos, md5(pos || '. [' || coalesce(event_date, 'unknown date') || '] [id:' || id || '] ' || content) as line_md5 from sg where n >= 2""")
def lc8(t):
    return lc.subject_groups(t.chunks).select("stream", "subject", "id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("line_md5"))


def merge_replies(t, groups):
    """A stand-in for a model: the merged fact is the newest row, the oldest contradicts it."""
    g = groups.groupBy("stream", "subject").agg(F.max_by("content", "pos").alias("merged_fact"), F.min_by("id", "pos").alias("old"))
    reply = F.to_json(F.struct("merged_fact", F.lit("experience").alias("fact_type"), F.array(F.struct(F.col("old").alias("old_uuid"), F.lit("older").alias("reason"))).alias("contradictions")))
    return g.select("stream", "subject", reply.alias("reply"))


MERGE = f"""{SUBJ}, mg as (select stream, subject, max_by(content, pos) as fact, min_by(id, pos) as old, string_agg(id, ',' order by id) as src, 'dream:' || md5(stream || '|' || subject) as id from sg where n >= 2 group by all),
sh as (select mg.old, mg.id as new_id from mg join chunks c on c.id = mg.old where trust_level <> 'a1')"""


@query("LC9_merge_rows", "chunks", f"with {MERGE} select id, stream, subject, md5(fact) as content_md5, src as sources, 'experience' as fact_type, 'a2' as trust_level from mg")
def lc9(t):
    g = lc.subject_groups(t.chunks)
    m, _, _ = lc.apply_merges(t.chunks, merge_replies(t, g), g, T0)
    return m.select("id", "stream", "subject", F.md5("content").alias("content_md5"), F.array_join("source_ids", ",").alias("sources"), "fact_type", "trust_level")


@query("LC9_merge_closes", "chunks", f"""
with {MERGE} select c.id, is_latest and new_id is null as is_latest, case when new_id is not null then {T0} else valid_until end as valid_until, coalesce(new_id, superseded_by) as superseded_by
from chunks c left join sh on sh.old = c.id""")
def lc9c(t):
    g = lc.subject_groups(t.chunks)
    _, after, _ = lc.apply_merges(t.chunks, merge_replies(t, g), g, T0)
    return after.select("id", "is_latest", "valid_until", "superseded_by")


DECAYED = f"""b as (select *, case when level = 0 then 0.99e0 else 0.995e0 end as base, greatest(0, {T0} - coalesce(last_decay, timestamp)) / 3600e0 as hours from chunks),
n as (select *, round(score * pow(case when access_count > 0 then least(0.9999e0, base + 0.5e0 * (least(access_count, 200) / 200e0) * (1 - base)) else base end, hours), 9) as ns from b),
o as (select *, case when not (not dormant and deleted_at is null and score > 0.01) then 'skipped' when persistent then 'persistent' when access_count >= 50 then 'promoted'
  when ns < 0.01 then 'dormant' else 'decayed' end as outcome from n)"""


@query("LC10_decay", "chunks", f"""
with {DECAYED} select id, outcome, case when outcome = 'decayed' then ns else score end as score, dormant or outcome = 'dormant' as dormant, persistent or outcome = 'promoted' as persistent from o""")
def lc10(t):
    return lc.decay(t.chunks, T0).select("id", "outcome", "score", "dormant", "persistent")


@query("LC10_decay_report", "chunks", f"with {DECAYED} select outcome, count(*) as n from o group by all")
def lc10r(t):
    return lc.decay(t.chunks, T0).groupBy("outcome").agg(F.count("*").alias("n"))


def tables(t):
    return {"chunks": t.chunks, "postings": lexical.postings(t.chunks).select("id", "token", "tf"), "vectors": t.vectors.select("id", "embedding"),
            "entity_chunk": graph.evidence_table(t.edge_evidence)}


EC = "ec as (select source as entity_id, chunk_id from edge_evidence union select target, chunk_id from edge_evidence)"
POST = r"""pt as (select distinct id, token from (select id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda t: len(t) > 0)) as token from chunks))"""


@query("LC11_soft_delete", "chunks vectors edge_evidence ratings", f"""
with del as (select distinct chunk_id as id from ratings where harmful), {EC}, {POST}
select 'chunks' as surface, count(*) filter (where deleted_at is null and id not in (select id from del)) as n from chunks
union all select 'postings', count(*) from pt where id not in (select id from del) union all select 'vectors', count(*) from vectors where id not in (select id from del)
union all select 'entity_chunk', count(*) from ec where chunk_id not in (select id from del)""")
def lc11(t):
    """Harmful rows are deleted; live rows left on every surface."""
    out = lc.soft_delete(tables(t), t.ratings.where("harmful").select(F.col("chunk_id").alias("id")), T0)
    n = None
    for name, df in out.items():
        d = df.where("deleted_at is null") if name == "chunks" else df
        p = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("surface"), "n")
        n = p if n is None else n.unionByName(p)
    return n


@query("LC12_retention_purge", "chunks vectors edge_evidence", f"""
with gone as (select id from chunks where deleted_at <= {T0} - 10 * 86400), {EC}, {POST}
select 'left' as what, 'chunks' as surface, count(*) as n from chunks where id not in (select id from gone) union all select 'left', 'postings', count(*) from pt where id not in (select id from gone)
union all select 'left', 'vectors', count(*) from vectors where id not in (select id from gone) union all select 'left', 'entity_chunk', count(*) from ec where chunk_id not in (select id from gone)
union all select 'residue', s, 0 from (values ('chunks'), ('postings'), ('vectors'), ('entity_chunk')) v(s)""")
def lc12(t):
    ids = lc.expired_ids(t.chunks, T0, 10)
    after = lc.purge(tables(t), ids)
    out = lc.residue(after, ids).withColumn("what", F.lit("residue"))
    for name, df in after.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("surface"), "n", F.lit("left").alias("what")))
    return out


@query("LC13_namespace_purge", "chunks vectors", """
select 'dry_run' as what, count(*) as n from chunks where stream = 's3' union all select 'chunks_left', count(*) from chunks where stream <> 's3'
union all select 'vectors_left', count(*) from vectors where id not in (select id from chunks where stream = 's3')""")
def lc13(t):
    ids = lc.namespace_ids(t.chunks, "s3")
    after = lc.purge({"chunks": t.chunks, "vectors": t.vectors}, ids)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(ids, "dry_run").unionByName(count(after["chunks"], "chunks_left")).unionByName(count(after["vectors"], "vectors_left"))


@query("LC14_bulk_updates", "chunks ratings", """
with h as (select distinct chunk_id as id from ratings where harmful)
select id, cast(null as double) as importance, importance is not null or last_implicit_boost is not null as was_reset, dormant or h.id is not null as dormant,
  case when h.id is not null then 'ephemeral' else tier end as tier from chunks left join h using (id)""")
def lc14(t):
    """Importance reset for all; harmful rows made dormant and ephemeral."""
    bad = t.ratings.where("harmful").select(F.col("chunk_id").alias("id")).distinct()
    _, hit = lc.reset_importance(t.chunks)
    c, _ = lc.reset_importance(t.chunks.withColumn("was_reset", hit))
    c = lc.set_tier(lc.set_flag(c, bad, "dormant"), bad.withColumn("tier", F.lit("ephemeral")))
    return c.select("id", "importance", "was_reset", "dormant", F.get_json_object("metadata", "$.tier").alias("tier"))


@query("LC15_stuck_recovery", "chunks", """
select id, in_progress as was, in_progress and deleted_at is not null as in_progress from chunks where in_progress""")
def lc15(t):
    return lc.recover_stuck(t.chunks.withColumn("was", F.col("in_progress"))).where("was").select("id", "was", "in_progress")


@query("LC16_reprocess_outcome", "chunks vectors", f"""
with x as (select new_id, id, sim, s1, s2 from (select *, row_number() over (partition by new_id order by sim desc, id) as rank from ({PAIRS}) where sim >= 0.1) where rank = 1),
a as (select c.id as new_id, x.id, sim, s1, s2, c.fact_type, {RELATION.format("substr(c.id, 2)::bigint + substr(x.id, 2)::bigint")} as relation from chunks c join vectors v using (id) left join x on x.new_id = c.id),
b as (select *, case when id is null then 'store' when coalesce(lower(s1) = lower(s2), false) and sim >= 0.15 then 'skip' when fact_type <> 'fact' and sim >= 0.12 and relation = 'updates' then 'supersede'
  when fact_type <> 'fact' and sim >= 0.12 and relation = 'extends' then 'extend' else 'store' end as action from a)
select new_id, action, case when action <> 'store' then id end as old_id from b""")
def lc16(t):
    new = incoming(t)
    near = links.contradiction_candidates(new, t.chunks, t.vectors, 0.1, n=1)
    old = t.chunks.select("id", F.col("meta.subject").alias("old_subject"))
    top = new.select("new_id", "subject").join(t.chunks.select(F.col("id").alias("new_id"), "meta.fact_type"), "new_id").join(
        near.select("new_id", "id", "sim"), "new_id", "left").join(old, "id", "left")
    return lc.reprocess_actions(top, labels(t, near), threshold=0.15, screen=0.12)


@query("LC16_mark_reprocessed", "chunks", """
select id, case when agent = 'external_web' then 'legacy-raw' else agent end as agent, case when agent = 'external_web' then round(coalesce(importance, 1.0) * 0.3e0, 6) else importance end as importance from chunks""")
def lc16m(t):
    return lc.mark_reprocessed(t.chunks, t.chunks.where("source.agent = 'external_web'").select("id")).select("id", "source.agent", "importance")


RATED = """rt as (select r.*, case when doc_id % 6 = 0 then 'elsewhere' else 's' || ((doc_id // 8) % 20) end as stream, case when doc_id % 17 = 3 then 9 else usefulness end as u from ratings r)"""


def rated(t):
    """Ratings with a stream, wrong for some, and out of range for others."""
    s = F.when(F.col("doc_id") % 6 == 0, "elsewhere").otherwise(F.expr("concat('s', cast((doc_id div 8) % 20 as string))"))
    return t.ratings.withColumn("stream", s).withColumn("usefulness", F.when(F.col("doc_id") % 17 == 3, 9).otherwise(F.col("usefulness")))


@query("LC17_rating_apply", "chunks ratings", f"""
with {RATED}, g as (select chunk_id as id, sum(u / 4e0) as da, sum((4 - u) / 4e0) + 4 * count(*) filter (where harmful) as db, count(*) as dn, count(*) filter (where harmful) as dh from rt where stream <> 'elsewhere' and u <= 4 group by 1)
select id, round(1 + coalesce(da, 0), 6) as alpha, round(1 + coalesce(db, 0), 6) as beta, coalesce(dn, 0) as n_ratings, coalesce(dh, 0) as harmful_count from chunks left join g using (id)""")
def lc17(t):
    return lc.apply_ratings(t.chunks, rated(t))[0].select("id", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "n_ratings", "harmful_count")


@query("LC17_rating_rejects", "chunks ratings", f"""
with {RATED} select case when u > 4 then 'invalid' else 'not_found_in_stream' end as reason, count(*) as n from rt where u > 4 or stream = 'elsewhere' group by all""")
def lc17r(t):
    return lc.apply_ratings(t.chunks, rated(t))[2].groupBy("reason").agg(F.count("*").alias("n"))
