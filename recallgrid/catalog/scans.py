"""2.A scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links
from ..operators.entities import dictionary_relations
from ..operators.term_index import TermIndex
from ..plans import hybrid
from ..session import scratch_path
from ..sources import bench_history, chunk_store, dictionary, event_log
from ..sources.views import T0
from .base import query
from .oracle_views import TOK

SCAN_COLS = "id, stream, level, timestamp, md5(content) as content_md5"


@query("A1_live_chunk_scan", "chunks", f"select {SCAN_COLS} from chunks where level in (0,1) and deleted_at is null")
def a1(t):
    return chunk_store.live(t.chunks).selectExpr(*[c.strip() for c in SCAN_COLS.split(",")])


@query("A2_level_scan", "chunks", "select id, stream, timestamp from chunks where level = 1")
def a2(t):
    return chunk_store.of_level(t.chunks, 1).select("id", "stream", "timestamp")


@query("A3_consolidation_eligible", "chunks", f"""
select id, stream, rn from (
  select id, stream, row_number() over (partition by stream order by timestamp, id) as rn from chunks
  where level = 0 and not consolidated and not in_progress and not dormant and deleted_at is null
    and {T0} - timestamp >= 60)""")
def a3(t):
    return chunk_store.consolidation_eligible(t.chunks, T0).select("id", "stream", F.col("rn").cast("long").alias("rn"))


@query("A4_vector_dimensions", "vectors", """
select cast(len(embedding) as bigint) as dims, count(*) as n, len(embedding) = 64 as accepted from vectors group by all""")
def a4(t):
    return chunk_store.vector_dimensions(t.vectors, 64).withColumn("dims", F.col("dims").cast("long"))


def event_lines(t):
    """The event log as text lines, every 101st torn in half."""
    line = F.to_json(F.struct(F.col("sec").alias("timestamp"), "type", "stream", "query", "top1", "result_count",
                              "chunk_count", "kind", "cost_usd"))
    torn = F.expr("substring(line, 1, cast(length(line) / 2 as int))")
    return t.events.withColumn("line", line).select(
        "event_id", F.when(F.col("event_id") % 101 == 0, torn).otherwise(F.col("line")).alias("value"))


@query("A5_event_log_source", "event_log", """
select type, stream, count(*) as n, min(sec) as first_sec, max(sec) as last_sec
from event_log where event_id % 101 <> 0 group by type, stream""")
def a5(t):
    """Lines are written, then read back as a log folder."""
    folder = scratch_path(t.spark, "event-log")
    event_lines(t).select("value").write.mode("append").option("compression", "none").text(folder + "/log.json")
    return event_log.parse_event_lines(t.spark.read.text(folder + "/log.json")).groupBy("type", "stream").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_sec"), F.max("timestamp").alias("last_sec"))


@query("A6_event_log_sink", "event_log", """
select strftime(make_timestamp(sec * 1000000), '%Y-%m-%d') as date, type, count(*) as n from event_log group by all""")
def a6(t):
    folder = scratch_path(t.spark, "event-sink")
    event_log.append_daily(t.events.select(F.col("sec").alias("timestamp"), "type", "stream", "query"), folder)
    return (t.spark.read.schema("type string, date string").json(folder)
            .groupBy("date", "type").agg(F.count("*").alias("n")))


@query("A7_chunk_upsert", "chunks", """
select id, case when doc_id % 10 = 0 then score / 4 when doc_id % 15 = 0 then score / 2 else score end as score,
  case when doc_id % 10 = 0 then timestamp + 200 when doc_id % 15 = 0 then timestamp + 100 else timestamp end as updated_at
from chunks union all select 'n' || doc_id, score, timestamp from chunks where doc_id % 25 = 1""")
def a7(t):
    base = t.chunks.select("doc_id", "id", "score", "updated_at")
    first = base.where("doc_id % 15 = 0").selectExpr("id", "score / 2 as score", "updated_at + 100 as updated_at", "1 as seq")
    second = base.where("doc_id % 10 = 0").selectExpr("id", "score / 4 as score", "updated_at + 200 as updated_at", "2 as seq")
    new = base.where("doc_id % 25 = 1").selectExpr("concat('n', cast(doc_id as string)) as id", "score", "updated_at", "3 as seq")
    return chunk_store.upsert(base.select("id", "score", "updated_at"), first.unionByName(second).unionByName(new))


@query("A8_decode_accounting", "chunks", """
select case when doc_id % 50 = 7 then 'envelope' when doc_id % 50 = 13 then 'payload' when doc_id % 50 = 21 then 'decrypt'
  else 'ok' end as stage, count(*) as n, min(doc_id) as first_seq from chunks group by 1""")
def a8(t):
    body = F.to_json(F.struct("id", "stream", "level"))
    text = F.when(F.col("doc_id") % 50 == 13, F.substring(body, 1, 9)).otherwise(body)
    enc = (F.col("doc_id") % 50 == 21) | (F.col("doc_id") % 50 == 22)
    stored = F.when(F.col("doc_id") % 50 == 21, F.lit("*not base64*")).when(enc, F.base64(text.cast("binary"))).otherwise(text)
    line = F.to_json(F.struct(enc.alias("enc"), stored.alias("payload")))
    rows = t.chunks.select(F.col("doc_id").alias("seq"),
                           F.when(F.col("doc_id") % 50 == 7, F.substring(line, 1, 12)).otherwise(line).alias("line"))
    return chunk_store.decode_accounting(rows, "id string, stream string, level int")


@query("A9_entity_dictionary", "", """
with a as (select lower('acct ' || s_nationkey) as alias, s_name as name, 'Organization' as entity_type, s_suppkey as seq from supplier
  union all select lower('acct ' || c_nationkey), c_name, 'Person', 100000000 + c_custkey from customer
  union all select lower(c_name), c_name, 'Person', 100000000 + c_custkey from customer)
select alias, name, entity_type from (select *, row_number() over (partition by alias order by seq, name) as n from a) where n = 1""")
def a9(t):
    """Account names as dictionary entries with clashing aliases."""
    s, c = t.raw("supplier"), t.raw("customer")
    a = s.selectExpr("lower(concat('acct ', s_nationkey)) as alias", "s_name as name", "'Organization' as entity_type", "s_suppkey as seq")
    a = a.unionByName(c.selectExpr("lower(concat('acct ', c_nationkey)) as alias", "c_name as name", "'Person' as entity_type",
                                   "100000000 + c_custkey as seq"))
    a = a.unionByName(c.selectExpr("lower(c_name) as alias", "c_name as name", "'Person' as entity_type", "100000000 + c_custkey as seq"))
    return dictionary.first_alias_wins(a).select("alias", "name", "entity_type")


@query("A9_dictionary_file", "", """
with e as (select s_suppkey as k, s_name as name, 'acct ' || s_nationkey as nick, 'tier ' || (s_suppkey % 3) as role from supplier),
a as (select lower(name) as alias, name, 2 * k as seq from e union all select lower(nick), name, 2 * k + 1 from e),
f as (select alias, name from (select *, row_number() over (partition by alias order by seq, name) as n from a) where n = 1)
select 'alias' as kind, alias as a, name as b from f union all select 'role', name, role from e
union all select 'expansion', name, w from e, (values ('vendor'), ('contract')) v(w) where k % 2 = 0""")
def a9f(t):
    """Account names written as a dictionary file, and read again with roles and expansions."""
    folder = scratch_path(t.spark, "dictionary")
    block = """concat_ws('\\n', '[[entity]]', concat('canonical = "', s_name, '"'), 'type = "Organization"', concat('aliases = ["acct ', s_nationkey, '"]'),
      concat('role = "tier ', s_suppkey % 3, '"'), case when s_suppkey % 2 = 0 then 'expand_with = ["vendor", "contract"]' end)"""
    t.raw("supplier").orderBy("s_suppkey").selectExpr(f"{block} as value").coalesce(1).write.text(folder)
    d = dictionary.read_dictionary(t.spark, folder)
    out = d["alias"].selectExpr("'alias' as kind", "alias as a", "name as b")
    return out.unionByName(d["role"].selectExpr("'role' as kind", "name as a", "role as b")).unionByName(d["expansion"].selectExpr("'expansion' as kind", "name as a", "term as b"))


@query("A11_access_log", "event_log", """
select stream, actor, ts, rn, not_shown from (
  select stream, user_id as actor, sec as ts,
    row_number() over (partition by stream order by sec desc, event_id desc) as rn,
    greatest(0, count(*) over (partition by stream) - 20) as not_shown
  from event_log where type in ('search', 'store')) where rn <= 20""")
def a11(t):
    """Appended to the access log, then listed newest first."""
    folder = scratch_path(t.spark, "access")
    (t.events.where("type in ('search', 'store')")
     .selectExpr("stream", "user_id as actor", "type as op", "sec as ts", "event_id as seq").write.mode("append").parquet(folder))
    log = event_log.newest_first(t.spark.read.parquet(folder), "stream", 20)
    return log.selectExpr("stream", "actor", "ts", "cast(rn as bigint) as rn", "not_shown")


AUDIT_BODY = "concat_ws(':', type, stream, cast(sec as string), cast(event_id as string))"


def audit_batch(t):
    return t.events.where("type in ('consolidation', 'llm_failure')").selectExpr(
        "stream as target", "sec as ts", "event_id as seq", f"{AUDIT_BODY} as body")


@query("A12_audit_append", "event_log", """
with recursive b as (select stream as target, sec as ts, event_id as seq,
    type || ':' || stream || ':' || sec || ':' || event_id as body,
    row_number() over (partition by stream order by sec, event_id) as rn
  from event_log where type in ('consolidation', 'llm_failure')),
c as (select target, ts, seq, rn, cast(null as varchar) as prev_hash, body || '|' as blob from b where rn = 1
  union all select b.target, b.ts, b.seq, b.rn, sha256(c.blob), b.body || '|' || sha256(c.blob)
  from c join b on b.target = c.target and b.rn = c.rn + 1)
select target, seq, prev_hash from c""")
def a12(t):
    return event_log.chain(audit_batch(t)).select("target", "seq", "prev_hash")


@query("A13_stream_vector_sample", "chunks vectors", """
select kind, stream, id from (
  select 'sample' as kind, c.stream, v.id, row_number() over (partition by c.stream order by md5('42:' || v.id), v.id) as rn
  from vectors v join chunks c on c.id = v.id) where rn <= 5
union all select 'orphan', null, v.id from vectors v where not exists (select 1 from chunks c where c.id = v.id)""")
def a13(t):
    """Sample written as JSON lines and read back, beside the orphans."""
    folder = scratch_path(t.spark, "vector-sample")
    chunk_store.per_stream_sample(t.vectors, t.chunks, 5, 42).select("stream", "id", "embedding").write.json(folder)
    sample = t.spark.read.schema("stream string, id string").json(folder).selectExpr("'sample' as kind", "stream", "id")
    return sample.unionByName(chunk_store.orphan_vectors(t.vectors, t.chunks).selectExpr("'orphan' as kind", "cast(null as string) as stream", "id"))


@query("A14_benchmark_history", "event_log", """
select strftime(make_timestamp(sec * 1000000), '%Y-%m-%d') as day, max(sec) as timestamp, count(*) as cases, round(avg(top1), 6) as mean_top1
from event_log where type = 'search' group by 1""")
def a14(t):
    """Daily search quality kept as snapshot files, then read as a history."""
    folder = scratch_path(t.spark, "bench")
    snaps = t.events.where("type = 'search'").groupBy(
        F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd").alias("day")).agg(
        F.max("sec").alias("timestamp"), F.count("*").alias("cases"), F.round(F.avg("top1"), 6).alias("mean_top1"))
    snaps.write.json(folder)
    return bench_history.read_history(
        t.spark, folder, "day string, timestamp bigint, cases bigint, mean_top1 double", ("part-", "snapshot-")).drop("file")


@query("A15_operation_audit", "chunks", """
select strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') as date, stream, count(*) as ops, cast(sum(strlen(content)) as bigint) as bytes
from chunks group by all""")
def a15(t):
    folder = scratch_path(t.spark, "op-audit")
    event_log.append_daily(t.chunks.selectExpr("timestamp", "'store' as op", "stream", "source.agent as agent", "id",
                                               "octet_length(content) as len"), folder)
    return t.spark.read.schema("stream string, len bigint, date string").json(folder).groupBy("date", "stream").agg(
        F.count("*").alias("ops"), F.sum("len").alias("bytes"))


@query("A16_lexical_index", "doc_tokens", """
select token, count(distinct id) as df, count(*) as cf from doc_tokens group by token""")
def a16(t):
    """The index is written anew; frequencies come from its postings."""
    folder = scratch_path(t.spark, "index")
    p = TermIndex.create(chunk_store.live(t.chunks), folder).postings
    return p.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


#: The rows of a table after the changes of `changed_index`: some reworded, some gone, some come late.
CHANGED = """now as (select * replace (case when doc_id % 17 = 0 then content || ' reworded since' else content end as content)
  from chunks where deleted_at is null and doc_id % 13 <> 0)"""


def changed_index(t):
    """An index that grew by batches: late rows and reworded ones, removals, a removed row that came back, two segments folded."""
    rows = chunk_store.live(t.chunks)
    reworded = rows.withColumn("content", F.when(F.col("doc_id") % 17 == 0, F.concat("content", F.lit(" reworded since"))).otherwise(F.col("content")))
    index = TermIndex.create(rows.where("doc_id % 10 <> 3"), scratch_path(t.spark, "changed-index"))
    index.apply(reworded.where("doc_id % 10 = 3 or doc_id % 17 = 0"))
    index.apply(removed=rows.where("doc_id % 13 = 0 or doc_id % 11 = 0"))
    index.fold(1, 2)
    index.apply(reworded.where("doc_id % 11 = 0 and doc_id % 13 <> 0"))
    return index


@query("A16_index_after_changes", "chunks", f"""
with {CHANGED}, w as (select id, unnest({TOK.format('content')}) as token from now)
select token, count(distinct id) as df, count(*) as cf from w group by token""")
def a16c(t):
    """Frequencies of a changed index: `df` from the batches' sums, `cf` from the postings that are left."""
    index = changed_index(t)
    cf = index.postings.groupBy("token").agg(F.sum("tf").alias("cf"))
    return index.term_df.select("token", "df").join(cf, "token", "full_outer")


@query("A16_search_after_changes", "chunks q_terms", f"""
with {CHANGED}, w as (select id, unnest({TOK.format('content')}) as token from now), tf as (select id, token, count(*) as tf from w group by all),
df as (select token, count(*) as df from tf group by token), dl as (select id, count(*) as dl from w group by id),
st as (select count(*) as n, (select count(*) from w) * 1e0 / count(*) as avg_dl from now),
s as (select query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) as score
  from q_terms join tf using (token) join df using (token) join dl using (id), st group by all)
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 5""")
def a16s(t):
    return hybrid.lexical_search(t.queries, t.chunks, 5, index=changed_index(t)).withColumn("rank", F.col("rank").cast("long"))


@query("A16_parity_after_changes", "chunks", f"""
with {CHANGED}, m as (select id from chunks where deleted_at is null and doc_id % 13 = 0)
select 0::bigint as orphans, (select count(*) from m) as missing, round(100e0 * (select count(*) from m) / (select count(*) from chunks where deleted_at is null), 6) as drift_pct,
  (select count(*) from m) = 0 as in_sync, coalesce((select string_agg(id, ',') from now where false), '') as orphan_sample""")
def a16p(t):
    return links.parity_report(changed_index(t).docs, chunk_store.live(t.chunks))


@query("A17_entity_and_relation_tags", "chunk_entity dict_rel", """
select 'entity' as kind, id, name as a, entity_type as b, '' as c from chunk_entity
union all select distinct 'relation', id, subject, relation, object from chunk_entity join dict_rel on name = subject or name = object""")
def a17(t):
    """Names and triples of every row, stored as two tables and read back."""
    folder = scratch_path(t.spark, "tags")
    t.chunk_entity.write.parquet(folder + "/entity")
    names = t.spark.read.parquet(folder + "/entity")
    dictionary_relations(names, t.dict_relation).write.parquet(folder + "/relation")
    rel = t.spark.read.parquet(folder + "/relation")
    return names.selectExpr("'entity' as kind", "id", "name as a", "entity_type as b", "'' as c").unionByName(
        rel.selectExpr("'relation' as kind", "id", "subject as a", "relation as b", "object as c"))
