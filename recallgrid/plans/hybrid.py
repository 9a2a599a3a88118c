"""Retrieval jobs: a table of queries in, ranked hits out, one plan per batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring
from ..operators import filters, lexical, merging, ranking
from ..operators.term_index import TermIndex
from ..operators.similarity import nearest
from ..sources.chunk_store import live


def lexical_search(queries: DataFrame, chunks: DataFrame, k: int, *, by_stream: bool = False,
                   where: Column | None = None, agent: str | None = None,
                   exclude_agents: Sequence[str] = (), dates: tuple[int, int] | None = None, index: TermIndex | None = None,
                   bounded: bool = False) -> DataFrame:
    """Top `k` by BM25. Filters act before ranking; statistics stay global.

    With `index`, the stored index of the live chunks, no text is read, and
    `dates`, bounds of the event date, are looked up there. `bounded` takes the
    way that bounds scores first: more jobs, fewer postings, for large indexes.
    """
    base = live(chunks)
    keys = ("query_id", "stream") if by_stream else ("query_id",)
    terms = lexical.query_terms(queries, keys=keys)
    docs = base if where is None else base.where(where)
    docs = docs if dates is None else docs.where(filters.event_noon().between(*dates))
    docs = filters.by_agent(docs, agent, exclude_agents)
    narrowed = where is not None or agent is not None or bool(exclude_agents)
    if index is not None:
        if bounded and not narrowed and not by_stream and dates is None:
            return index.top(terms, k)
        among = docs.select("id") if narrowed else None
        if dates is not None:
            dated = index.docs.where(F.col("event_date").between(*dates)).select("id")
            among = dated if among is None else among.join(dated, "id", "left_semi")
        return index.best(terms, k, by_stream, among=among)
    hits = lexical.bm25(terms, docs, by_stream=by_stream, stats_docs=base if narrowed or dates is not None else None)
    return ranking.top_n(hits, ["query_id"], [F.desc("score"), F.col("id")], k)


def ask_for(index: TermIndex | None, *batches: DataFrame | None) -> None:
    """Has `index` count the words of several batches of questions in one pass over the texts."""
    if index is not None:
        index.need(reduce(DataFrame.unionByName, (lexical.query_terms(q).select("token") for q in batches if q is not None)))


def entity_search(queries: DataFrame, chunk_entity: DataFrame, k: int, index: TermIndex, relations: float = 0.5) -> DataFrame:
    """Content, entity and relation words, boosts 1, 1 and `relations`, among rows tagged with the query's entity.

    `queries` carries `entity`, the name to filter by; `index` has the fields.
    """
    both = index.search(lexical.query_terms(queries), weights={"content": 1.0, "entities": 1.0, "relations": relations})
    allowed = queries.select("query_id", F.col("entity").alias("name")).join(
        chunk_entity.select("id", "name"), "name").select("query_id", "id").distinct()
    return ranking.top_n(both.join(allowed, ["query_id", "id"], "left_semi"), ["query_id"],
                         [F.desc("score"), F.col("id")], k)


def vector_search(query_vectors: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int, *,
                  agent: str | None = None, exclude_agents: Sequence[str] = (), by_stream: bool = False,
                  few_queries: bool = True) -> DataFrame:
    """Top `k` by cosine among vectors of live rows, narrowed before scoring.

    `few_queries` states that the batch of questions is small enough to send to
    every task (see `nearest`, which refuses a larger one).
    """
    alive = filters.by_agent(live(chunks), agent, exclude_agents)
    if by_stream:
        return nearest(query_vectors, vectors.join(alive.select("id", "stream"), "id"), k, on=["stream"], small_left=few_queries)
    return nearest(query_vectors, vectors.join(alive.select("id"), "id", "left_semi"), k, small_left=few_queries)


def fuse_channels(lexical_hits: DataFrame, vector_hits: DataFrame, floor: float = 0.0) -> DataFrame:
    """Union of both channels; a missing side is 0. Adds the max-normalised scores."""
    v = vector_hits.where(F.col("sim") >= floor) if floor > 0 else vector_hits
    both = lexical_hits.select("query_id", "id", F.col("score").alias("lexical_raw")).join(
        v.select("query_id", "id", F.col("sim").alias("dense_raw")), ["query_id", "id"], "full_outer")
    both = both.fillna(0.0, ["lexical_raw", "dense_raw"])
    return (both.withColumn("lexical", ranking.max_normalised("lexical_raw"))
            .withColumn("dense", ranking.max_normalised("dense_raw")))


HIT_COLUMNS = ["stream", "level", "timestamp", "is_latest", "valid_from", "valid_until", "trust_level", "provenance",
               "importance", "access_count", "dormant", "metadata", "meta", "source"]


def enrich(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One join to the chunk table for every attribute later stages need."""
    return hits.join(live(chunks).select("id", *HIT_COLUMNS), "id")


def weighted_fusion(hits: DataFrame, now: int, w_dense: float = 0.6, w_lexical: float = 0.4, relief: float = 0.0,
                    boost: float = 1.0, damp: float = 1.0) -> DataFrame:
    """Weighted channels times decay, authority and attribution. `hits` is enriched."""
    decay = scoring.time_decay(F.col("timestamp"), F.col("level"), now)
    out = hits.withColumn("decay", scoring.relieved(decay, F.greatest("lexical", "dense"), relief))
    score = ((w_dense * F.col("dense") + w_lexical * F.col("lexical")) * F.col("decay")
             * scoring.authority(F.col("provenance"), F.col("trust_level"))
             * scoring.attribution(F.col("meta.attributed_to"), F.col("meta.fact_type"), boost, damp))
    return out.withColumn("score", F.round(score, 6))


def graph_additions(pool: DataFrame, graph_scores: DataFrame, chunks: DataFrame, factor: float = 0.3, most: int = 3,
                    scope: DataFrame | None = None) -> DataFrame:
    """Boosts pool rows the graph reaches; adds up to `most` rows it alone reaches.

    `chunks` holds the rows that may be added; with `scope(query_id, stream)`
    only those of the query's own stream are.
    """
    g = graph_scores.select("query_id", "id", "graph")
    boosted = pool.join(g, ["query_id", "id"], "left").withColumn(
        "score", F.round(F.col("score") * (1 + F.coalesce("graph", F.lit(0.0)) * factor), 12)).drop("graph")
    alone = enrich(g.join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti"), chunks).where(~F.col("dormant"))
    if scope is not None:
        alone = alone.join(scope, ["query_id", "stream"], "left_semi")
    best = ranking.top_n(alone, ["query_id"], [F.desc("graph"), F.col("id")], most).drop("rank")
    extra = (best.withColumn("score", F.round(F.col("graph") * factor, 12)).drop("graph")
             .withColumn("lexical", F.lit(0.0)).withColumn("dense", F.lit(0.0)).withColumn("decay", F.lit(1.0))
             .withColumn("lexical_raw", F.lit(0.0)).withColumn("dense_raw", F.lit(0.0)))
    return boosted.unionByName(extra, allowMissingColumns=True)


def adjusted(pool: DataFrame, access_weight: float = 0.0, counting: bool | Column = False) -> DataFrame:
    """Level, tier, importance, access and preference factors."""
    s = F.col("score") * scoring.level_boost(F.col("level"), counting)
    s = scoring.chunk_adjusted(s, F.get_json_object("metadata", "$.tier"), F.col("decay"), F.col("importance"),
                               F.col("access_count"), F.col("meta.fact_type"), access_weight)
    return pool.withColumn("score", F.round(s, 12))


def ranked(pool: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("id"))
    return pool.withColumn("rank", F.row_number().over(w))


def hybrid_search(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, vectors: DataFrame, now: int,
                  k: int = 10, *, graph_scores: DataFrame | None = None, lane: DataFrame | None = None,
                  valid_at: int | None = None, include_superseded: bool = False, fact_type: str | None = None,
                  subject: str | None = None, min_confidence: float | None = None, agent: str | None = None,
                  exclude_agents: Sequence[str] = (), enumerate_subjects: bool = False, prefix_dedup: bool = True,
                  access_weight: float = 0.0, floor: float = 0.0, most: int | None = None, by_stream: bool = False,
                  few_queries: bool = True, index: TermIndex | None = None, rules: DataFrame | None = None,
                  expanded: DataFrame | None = None, parts: DataFrame | None = None, part_vectors: DataFrame | None = None) -> DataFrame:
    """Lexical and vector channels, fused, adjusted, filtered and cut to `k`.

    Agents, and with `by_stream` each query's own stream, narrow every channel,
    the lane and the graph's additions before anything is ranked, so hits of
    others never take a place. After the pool: validity, head of chain, facts,
    prefix twins, subjects. `lane(query_id, id)` marks rows kept beyond the
    pool. `most` is the result length where it is not `k`.

    `rules` (see `class_rules`) has a row for each question: its result length,
    whether hits come oldest first, one per subject, raw rows before summaries,
    and bounds of the event date. All questions still are one plan. Hits of
    `expanded` questions count half, those of the `parts` a question was cut
    into in full, and `part_vectors` add to the vector channel.
    """
    scope = queries.select("query_id", "stream") if by_stream else None
    if by_stream and "stream" not in query_vectors.columns:
        query_vectors = query_vectors.join(scope, "query_id")
    ask_for(index, queries, expanded, parts)
    lex = lexical_search(queries, chunks, 2 * k, by_stream=by_stream, agent=agent, exclude_agents=exclude_agents, index=index)
    vec = vector_search(query_vectors, vectors, chunks, 2 * k, agent=agent, exclude_agents=exclude_agents, by_stream=by_stream,
                        few_queries=few_queries)
    more = [(q, w) for q, w in ((expanded, 0.5), (parts, 1.0)) if q is not None]
    if more:
        lex = merging.max_merge((lex, 1.0), *((lexical_search(q, chunks, 2 * k, by_stream=by_stream, agent=agent, exclude_agents=exclude_agents, index=index), w) for q, w in more))
    if part_vectors is not None:
        found = vector_search(part_vectors, vectors, chunks, k, agent=agent, exclude_agents=exclude_agents, by_stream=by_stream, few_queries=few_queries)
        vec = merging.add_sub_query_vectors(vec.select("query_id", "id", F.col("sim").alias("score")), found).withColumnRenamed("score", "sim")
    fused = ranked(weighted_fusion(enrich(fuse_channels(lex, vec, floor), chunks), now))
    if lane is None:
        pool = fused.where(F.col("rank") <= 3 * k)
    else:
        fused = fused.join(lane.select("query_id", "id", F.lit(True).alias("guaranteed")), ["query_id", "id"], "left")
        pool = ranking.pool_with_guarantee(fused, 3 * k).drop("guaranteed")
    pool = pool.drop("rank")
    if graph_scores is not None:
        pool = graph_additions(pool, graph_scores, filters.by_agent(chunks, agent, exclude_agents), scope=scope)
    if rules is None:
        pool = adjusted(pool, access_weight)
    else:
        pool = adjusted(pool.join(rules, "query_id"), access_weight, counting=F.col("counting"))
        day = filters.event_noon()
        pool = pool.where((F.col("date_from").isNull() | (day >= F.col("date_from"))) & (F.col("date_to").isNull() | (day <= F.col("date_to"))))
    if valid_at is not None:
        pool = pool.where(filters.valid_at(F.lit(valid_at)))
    if not include_superseded:
        pool = pool.where("is_latest")
    if fact_type is not None or subject is not None or min_confidence is not None:
        pool = pool.where(filters.fact_filter(fact_type, subject, min_confidence))
    pool = ranked(pool) if rules is None else ranked_by_rule(pool)
    if prefix_dedup:
        texts = live(chunks).select("id", ranking.twin_head())
        pool = ranking.drop_prefix_twins(pool.join(texts, "id"), order="rank").drop("content")
    if enumerate_subjects:
        pool = ranking.one_per_subject(pool.withColumn("subject", F.col("meta.subject"))).drop("subject")
    if rules is None:
        return ranking.top_n(pool.drop("rank"), ["query_id"], [F.desc("score"), F.col("id")], most or k)
    # of rows that are not one per subject each counts as a subject of its own
    subject = F.when(F.col("per_subject"), F.col("meta.subject"))
    pool = ranking.one_per_subject(pool.withColumn("subject", subject)).drop("subject")
    return ranked_by_rule(pool.drop("rank")).where(F.col("rank") <= F.col("most"))


def class_rules(annotated: DataFrame, k: int, enumerated: int = 30, dates: DataFrame | None = None) -> DataFrame:
    """(query_id, oldest_first, most, per_subject, counting, date_from, date_to) of annotated questions.

    Temporal questions read as a timeline; enumerations give one row per subject
    and are longer. `dates(query_id, date_from, date_to)` are bounds in seconds.
    """
    kind = F.col("complexity")
    rules = annotated.select("query_id", (kind == "temporal").alias("oldest_first"), F.when(kind == "aggregation", enumerated).otherwise(k).alias("most"),
                             (kind == "aggregation").alias("per_subject"), "counting")
    if dates is None:
        return rules.withColumns({c: F.lit(None).cast("long") for c in ("date_from", "date_to")})
    return rules.join(dates, "query_id", "left")


def ranked_by_rule(pool: DataFrame) -> DataFrame:
    """By score, or oldest first where the question's rule says so."""
    first = F.when(F.col("oldest_first"), F.col("timestamp"))
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(first, F.desc("score"), F.col("id"))))


def lexical_only(queries: DataFrame, chunks: DataFrame, now: int, k: int = 10, index: TermIndex | None = None) -> DataFrame:
    """Fallback without vectors: normalised score times decay, cut to the pool."""
    hits = lexical_search(queries, chunks, 2 * k, index=index).withColumn("lexical", ranking.max_normalised("score"))
    hits = enrich(hits.select("query_id", "id", "lexical"), chunks)
    s = F.col("lexical") * scoring.time_decay(F.col("timestamp"), F.col("level"), now)
    return ranking.top_n(hits.withColumn("score", F.round(s, 6)), ["query_id"], [F.desc("score"), F.col("id")], 3 * k)


def rare_terms(queries: DataFrame, chunks: DataFrame, floor: int = 3, ratio: float = 0.005, index: TermIndex | None = None) -> DataFrame:
    """(query_id, token, df) of the query words few documents hold."""
    base = live(chunks)
    words = lexical.query_terms(queries).select("query_id", "token")
    if index is not None:
        index.need(words)
    n = base.agg(F.count("*").alias("n")).scalar() if index is None else index.totals.where("field = 'content'").select("n").scalar()
    df = index.term_df.where("field = 'content'") if index is not None else (lexical.postings(base).join(words.select("token").distinct(), "token", "left_semi")
          .groupBy("token").agg(F.count("*").alias("df")))
    cut = F.greatest(F.lit(floor).cast("long"), F.ceil(n * ratio))
    return words.join(df, "token").where(F.col("df") <= cut).select("query_id", "token", "df")


def rare_term_lane(queries: DataFrame, chunks: DataFrame, cap: int = 10, index: TermIndex | None = None) -> DataFrame:
    """Best `cap` rows per query by its rare words alone."""
    rare = rare_terms(queries, chunks, index=index).select("query_id", "token").withColumn("qtf", F.lit(1))
    if index is not None:
        return index.best(rare, cap)
    hits = lexical.bm25(rare, live(chunks))
    return ranking.top_n(hits, ["query_id"], [F.desc("score"), F.col("id")], cap)
