"""DuckDB text of the derived views, used as CTE preludes of the oracle SQL."""

from __future__ import annotations

T0 = 1706659200

# name -> (views it reads, body)
VIEWS: dict[str, tuple[str, str]] = {
    "chunks": ("", f"""
select doc_id, 'd' || doc_id as id, text as content,
  's' || ((doc_id // 8) % 20) as stream,
  case when doc_id % 4 = 0 then 1 else 0 end as level,
  {T0} - (doc_id % 90) * 43200 as timestamp,
  1e0 - (doc_id % 100) / 100e0 as score,
  (doc_id * 7) % 60 as access_count,
  doc_id % 50 = 0 as persistent, doc_id % 41 = 0 as dormant,
  doc_id % 4 = 1 as consolidated, doc_id % 97 = 0 as in_progress,
  case when doc_id % 23 = 0 then {T0} - (doc_id % 90) * 43200 + (doc_id % 40) * 86400 end as deleted_at,
  case when doc_id % 5 <> 0 then {T0} - (doc_id % 90) * 43200 end as valid_from,
  case when doc_id % 3 = 0 then {T0} - (doc_id % 90) * 43200 + 2592000 end as valid_until,
  case when doc_id % 8 in (1,2,3) then 'd' || (doc_id - 1) end as supersedes_id,
  case when doc_id % 8 in (0,1,2) then 'd' || (doc_id + 1) end as superseded_by,
  doc_id % 8 not in (0,1,2) as is_latest,
  case when doc_id % 8 < 4 then doc_id % 8 + 1 else 1 end as version,
  case when doc_id % 8 in (1,2,3) then 'd' || (doc_id - doc_id % 8) end as root_memory_id,
  case doc_id % 5 when 0 then 'a1' when 1 then 'a2' when 2 then 'b' when 3 then 'b' else 'a1' end as trust_level,
  case doc_id % 7 when 0 then 'evidence' when 1 then 'cue' else 'claim' end as provenance,
  doc_id % 6 <> 5 as has_meta,
  case doc_id % 6 when 0 then 'preference_or_decision' when 1 then 'project_state' when 2 then 'fact'
    when 3 then 'event' when 4 then 'experience' end as fact_type,
  case when doc_id % 6 <> 5 and doc_id % 7 <> 0 then 'subj' || (doc_id % 37) end as subject,
  case when doc_id % 6 <> 5 and doc_id % 4 <> 3
    then strftime(date '2024-01-01' + cast(doc_id % 60 as integer), '%Y-%m-%d') end as event_date,
  case when doc_id % 6 <> 5 then (doc_id % 11) / 10e0 end as confidence,
  case when doc_id % 6 <> 5 and doc_id % 9 = 0 then 'budget' end as topic,
  case when doc_id % 6 <> 5 then case doc_id % 3 when 0 then 'user' when 1 then 'assistant' end end as attributed_to,
  case doc_id % 5 when 0 then 'api' when 1 then 'mcp' when 2 then 'external_web' when 3 then 'raw-transcript' end as agent,
  case when doc_id % 5 <> 4 then 'sess' || ((doc_id // 4) % 100) end as session,
  case doc_id % 5 when 0 then 0.7e0 when 1 then 1.0e0 when 2 then 1.5e0 end as importance,
  case when doc_id % 6 <> 0 then {T0} - (doc_id % 90) * 43200 + (doc_id % 7) * 43200 end as last_decay,
  case when doc_id % 3 = 0 then {T0} - (doc_id % 48) * 3600 end as last_implicit_boost,
  case doc_id % 10 when 0 then 'core' when 1 then 'pinned' when 2 then 'ephemeral' end as tier,
  case when doc_id % 4 = 0 and doc_id > 1 then ['d' || (doc_id - 1), 'd' || (doc_id - 2)] else [] end as source_ids
from documents"""),
    "vectors": ("", "select 'd' || vec_id as id, vec_id, embedding, label from embeddings"),
    "event_log": ("", """
select *, cast(epoch(date_trunc('second', ts)) as bigint) as sec,
  's' || (user_id % 20) as stream,
  cast(json_extract_string(props, '$.k') as bigint) as k,
  case event_type when 'view' then 'search' when 'purchase' then 'store' when 'click' then 'feedback'
    when 'error' then 'llm_failure' when 'signup' then 'consolidation' end as type,
  case when event_type = 'view' then value / 500e0 end as top1,
  case when event_type = 'view' then cast(json_extract_string(props, '$.k') as bigint) % 10 end as result_count,
  case when event_type = 'purchase' then cast(json_extract_string(props, '$.k') as bigint) % 5 end as chunk_count,
  case when event_type = 'view' then 'topic ' || (cast(json_extract_string(props, '$.k') as bigint) % 12)
    || ' status ' || (user_id % 5) end as query,
  case when event_type = 'error' then ['extraction','extraction_empty','ner','embedding','consolidation']
    [cast(json_extract_string(props, '$.k') as bigint) % 5 + 1] end as kind,
  case when event_type = 'signup' then value / 100000e0 end as cost_usd
from events"""),
    "ratings": ("", f"""
select 'd' || doc_id as chunk_id, doc_id, 4 * quality as usefulness, toxic = 1 as harmful,
  {T0}::bigint * 1000 + doc_id as rated_at from labels"""),
    "qs": ("", "select item_id as query_id, text, 's' || (item_id % 20) as stream from benchmark"),
    "qvec": ("", """
select item_id as query_id, embedding from benchmark join embeddings on item_id = vec_id"""),
    "edge_evidence": ("", """
select distinct 'S' || l_suppkey as source, 'P' || l_partkey as target, 'uses' as relation, 'g' as stream,
  'd' || (l_orderkey % (select count(*) from documents)) as chunk_id from lineitem"""),
    "edges": ("edge_evidence", """
select stream, source, target, relation, count(*) as evidence from edge_evidence group by all"""),
    "graph_entities": ("", """
select 'S' || s_suppkey as entity_id, s_name as name, 'Organization' as entity_type, 'g' as stream from supplier
union all select 'P' || p_partkey, p_name, 'Technology', 'g' from part"""),
    "doc_tokens": ("", r"""
select id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda t: len(t) > 0)) as token
from chunks where deleted_at is null"""),
}
VIEWS["doc_tokens"] = ("chunks", VIEWS["doc_tokens"][1])
TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: len(t) > 0)"
VIEWS.update({
    # dictionary: the longest word of a passage names an entity, the next one is its alias
    "bench_words": ("", f"""
select item_id, token, row_number() over (partition by item_id order by len(token) desc, token) as rn
from (select distinct item_id, unnest({TOK.format('text')}) as token from benchmark)"""),
    "dict": ("bench_words", """
select alias, name, entity_type from (
  select w.token as alias, n.token as name,
    ['Person', 'Technology', 'Organization'][w.item_id % 3 + 1] as entity_type,
    row_number() over (partition by w.token order by w.item_id, w.rn) as k
  from bench_words w join bench_words n on n.item_id = w.item_id and n.rn = 1 where w.rn <= 2) where k = 1"""),
    "chunk_entity": ("doc_tokens dict", """
select distinct id, name, entity_type from doc_tokens join dict on token = alias"""),
    "dict_rel": ("bench_words", """
select distinct a.token as subject, 'uses' as relation, b.token as object
from bench_words a join bench_words b on b.item_id = a.item_id + 1 and a.rn = 1 and b.rn = 1"""),
    "q_terms": ("qs", f"""
select query_id, stream, token, count(*) as qtf from (
  select query_id, stream, unnest({TOK.format('text')}) as token from qs) group by all"""),
    "doc_stats": ("chunks doc_tokens", """
select n, (select count(*) from doc_tokens) * 1e0 / n as avg_dl
from (select count(*) as n from chunks where deleted_at is null)"""),
    "doc_tf": ("doc_tokens q_terms", """
select id, token, count(*) as tf from doc_tokens where token in (select token from q_terms) group by all"""),
    "doc_df": ("doc_tf", "select token, count(*) as df from doc_tf group by token"),
    "doc_dl": ("doc_tokens", "select id, count(*) as dl from doc_tokens group by id"),
    "lex": ("q_terms doc_stats doc_tf doc_df doc_dl chunks", """
select query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
  / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) as score
from q_terms join doc_tf using (token) join doc_df using (token) join doc_dl using (id), doc_stats group by all"""),
    "lex_stream": ("q_terms doc_stats doc_tf doc_df doc_dl chunks", """
select query_id, d.id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
  / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) as score
from q_terms q join doc_tf d using (token) join doc_df using (token) join doc_dl l on l.id = d.id
  join chunks c on c.id = d.id and c.stream = q.stream, doc_stats group by all"""),
    "vec_hits": ("qvec vectors chunks", """
select q.query_id, v.id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as sim
from qvec q, vectors v join chunks c on c.id = v.id and c.deleted_at is null"""),
    "lex_top": ("lex", """
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from lex) where rank <= 20"""),
    "vec_top": ("vec_hits", """
select query_id, id, sim, rank from (select *, row_number() over (partition by query_id order by sim desc, id) as rank from vec_hits) where rank <= 20"""),
    "channels": ("lex_top vec_top", """
select query_id, id, coalesce(l.score, 0) as lexical_raw, coalesce(v.sim, 0) as dense_raw
from lex_top l full outer join vec_top v using (query_id, id)"""),
})


def with_views(names: str, body: str) -> str:
    """`WITH` the named views and what they read, in order, before `body`."""
    ordered: list[str] = []

    def add(n: str) -> None:
        if n in ordered:
            return
        for dep in VIEWS[n][0].split():
            add(dep)
        ordered.append(n)

    for n in names.split():
        add(n)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1].strip()})" for n in ordered)
    b = body.strip()
    low = b.lower()
    if low.startswith("with recursive"):
        return f"with recursive {ctes},\n{b[len('with recursive'):].strip()}"
    if low.startswith("with "):
        return f"with {ctes},\n{b[5:].strip()}"
    return f"with {ctes}\n{b}"
