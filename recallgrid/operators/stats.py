"""Per-stream statistics over chunks, events and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import spread_rank

DAY = 86400
METRICS = ["search_count", "store_count", "mean_top1_score", "zero_result_rate", "hit_rate",
           "consolidation_count", "consolidation_cost_usd"]


def _n(cond: Column | str, name: str) -> Column:
    return F.count_if(F.expr(cond) if isinstance(cond, str) else cond).alias(name)


def health_columns() -> list[Column]:
    """Counts of a stream. Breakdowns cover latest live rows and sum to their number."""
    live = "deleted_at is null and is_latest"
    who = f"{live} and lower(meta.attributed_to)"
    return [
        _n("deleted_at is not null", "deleted"),
        _n("deleted_at is null and not is_latest", "superseded"),
        _n(live, "memories"),
        _n(f"{live} and level <= 0", "l0"), _n(f"{live} and level > 0", "l1"),
        _n(f"{live} and level <= 0 and not consolidated", "awaiting"),
        _n(f"{live} and embedded", "embedded"),
        F.min(F.expr(f"case when {live} then timestamp end")).alias("oldest"),
        F.max(F.expr(f"case when {live} then timestamp end")).alias("newest"),
        _n(f"{live} and meta.fact_type = 'preference_or_decision'", "preferences"),
        _n(f"{live} and meta.fact_type = 'event'", "event_facts"),
        _n(f"{live} and meta is null", "unclassified"),
        _n(f"{who} = 'user'", "by_user"), _n(f"{who} = 'assistant'", "by_assistant"),
        _n(f"{live} and coalesce(trust_level, 'a1') not in ('a2', 'b')", "trust_a1"),
        _n(f"{live} and trust_level = 'a2'", "trust_a2"), _n(f"{live} and trust_level = 'b'", "trust_b"),
    ]


def _with_embedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    ids = vectors.select("id", F.lit(True).alias("embedded"))
    slim = chunks.select("id", "stream", "level", "timestamp", "deleted_at", "is_latest", "consolidated", "meta", "trust_level")
    return slim.join(ids, "id", "left").fillna(False, ["embedded"])


def stream_health(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return _with_embedded(chunks, vectors).groupBy("stream").agg(*health_columns())


def health_with_total(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every stream and the `_total` row in one pass."""
    return _with_embedded(chunks, vectors).rollup("stream").agg(*health_columns()).withColumn(
        "stream", F.coalesce("stream", F.lit("_total")))


def activity(events: DataFrame, now: int) -> DataFrame:
    """Ingests and searches of the last day, week and month; future rows are skipped."""
    e = events.where(F.col("sec") <= now).withColumn("age", F.lit(now) - F.col("sec"))
    cols = []
    for kind, name in (("store", "ingests"), ("search", "searches")):
        for label, days in (("24h", 1), ("7d", 7), ("30d", 30)):
            cols.append(_n(f"type = '{kind}' and age <= {days * DAY}", f"{name}_{label}"))
    for label, days in (("24h", 1), ("7d", 7)):
        recent = f"type = 'store' and age <= {days * DAY}"
        facts = F.sum(F.expr(f"case when {recent} then chunk_count else 0 end"))
        cols.append(F.round(F.coalesce(facts / F.nullif(F.count_if(F.expr(recent)), F.lit(0)), F.lit(0.0)), 6).alias(f"facts_per_ingest_{label}"))
        cols.append(_n(f"{recent} and chunk_count = 0", f"empty_{label}"))
    cols.append(F.max(F.expr("case when type = 'store' then sec end")).alias("last_ingest"))
    cols.append(F.max(F.expr("case when type = 'search' then sec end")).alias("last_search"))
    return e.where("type in ('store', 'search')").groupBy("stream").agg(*cols)


def hourly_buckets(events: DataFrame, hour: Column | None = None) -> DataFrame:
    """One wide row per (stream, hour). Consolidations count under `_global`. `hour`, a window of event time, stands for the hour's number."""
    e = events.where("type in ('search', 'store', 'consolidation')").withColumn(
        "stream", F.when(F.col("type") == "consolidation", "_global").otherwise(F.col("stream"))).withColumn(
        "hour", F.expr("sec div 3600") if hour is None else F.col("ts"))
    s = "type = 'search'"
    n = F.count_if(F.expr(s))
    rate = lambda c: F.round(F.coalesce(F.count_if(F.expr(c)) / F.nullif(n, F.lit(0)), F.lit(0.0)), 6)
    top = f"{s} and top1"
    return e.groupBy("stream", F.col("hour") if hour is None else hour.alias("hour")).agg(
        n.cast("double").alias("search_count"),
        F.count_if(F.expr("type = 'store'")).cast("double").alias("store_count"),
        F.round(F.coalesce(F.avg(F.expr(f"case when {s} then top1 end")), F.lit(0.0)), 6).alias("mean_top1_score"),
        rate(f"{s} and result_count = 0").alias("zero_result_rate"),
        rate(f"{top} > 0.65").alias("hit_rate"),
        F.count_if(F.expr("type = 'consolidation'")).cast("double").alias("consolidation_count"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("consolidation_cost_usd"),
        _n(f"{top} < 0.3", "very_low"), _n(f"{top} >= 0.3 and top1 < 0.5", "low"),
        _n(f"{top} >= 0.5 and top1 < 0.65", "medium"), _n(f"{top} >= 0.65 and top1 < 0.8", "high"),
        _n(f"{top} >= 0.8", "very_high"))


def hourly_metrics(buckets: DataFrame) -> DataFrame:
    """(stream, metric, hour, value), long."""
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    return buckets.select("stream", "hour", F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, value)"))


def latest_and_sum(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("stream", "metric").agg(
        F.max_by("value", "hour").alias("latest"), F.round(F.sum("value"), 6).alias("cumulative"))


def latest_distribution(buckets: DataFrame) -> DataFrame:
    b = buckets.groupBy("stream").agg(F.max_by(F.struct("very_low", "low", "medium", "high", "very_high"), "hour").alias("d"))
    return b.select("stream", "d.*")


def period_hours(period: str) -> int:
    """`7d` or `24h` in hours."""
    n, unit = int(period[:-1]), period[-1].lower()
    if unit not in "dh":
        raise ValueError(f"unknown period {period}")
    return n * 24 if unit == "d" else n


def trend(metrics: DataFrame, metric: str, period: str, now: int) -> DataFrame:
    lo = now // 3600 - period_hours(period)
    return metrics.where((F.col("metric") == metric) & (F.col("hour") >= lo)).select(
        "stream", (F.col("hour") * 3600).alias("ts"), "value").orderBy("stream", "ts")


def freshness(chunks: DataFrame, now: int) -> DataFrame:
    """Accessed live rows by whole days of age."""
    d = chunks.where("deleted_at is null and access_count > 0").withColumn(
        "days", F.expr(f"greatest(0, {now} - timestamp) div {DAY}"))
    return d.groupBy("stream").agg(_n("days < 1", "under_1d"), _n("days >= 1 and days < 7", "d1_to_d7"),
                                   _n("days >= 7 and days < 30", "d7_to_d30"), _n("days >= 30", "over_30d"))


def utilisation(chunks: DataFrame, now: int) -> DataFrame:
    c = chunks.where("deleted_at is null")
    return c.groupBy("stream").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.expr("case when access_count > 0 then 1e0 else 0e0 end")), 6).alias("recall_ratio"),
        F.round(F.avg(F.expr(f"case when access_count = 0 and {now} - timestamp > {30 * DAY} then 1e0 else 0e0 end")), 6).alias("dead_share"))


def hot_rows(chunks: DataFrame) -> DataFrame:
    """The most accessed tenth of each stream, at least one row, never unread ones."""
    c = chunks.where("deleted_at is null").select("stream", "id", "access_count")
    n = c.groupBy("stream").agg(F.count("*").alias("n"))
    c = spread_rank(c.where("access_count > 0"), "stream", [F.desc("access_count"), F.col("id")], "rn").join(n, "stream")
    return c.where((F.col("rn") <= F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") * 0.1))) & (F.col("access_count") > 0))


def reciprocal_rank(feedback: DataFrame) -> DataFrame:
    """`feedback(stream, useful, rank)`, ranks from 0."""
    return feedback.where("useful and rank is not null").groupBy("stream").agg(
        F.count("*").alias("n"), F.round(F.avg(1 / (F.col("rank") + 1)), 6).alias("mrr"))


def summary(events: DataFrame, chunks: DataFrame, feedback: DataFrame, now: int) -> DataFrame:
    """The small per-stream aggregates side by side."""
    b = hourly_buckets(events)
    m = b.groupBy("stream").agg(
        F.sum("search_count").cast("long").alias("search_count"),
        F.max_by("mean_top1_score", "hour").alias("mean_top1_score"),
        F.max_by("zero_result_rate", "hour").alias("zero_result_rate"),
        F.max_by("hit_rate", "hour").alias("hit_rate"),
        F.max_by("very_high", "hour").alias("very_high"))
    u = utilisation(chunks, now).withColumnRenamed("n", "store_count")
    out = u.join(m, "stream", "full_outer").join(freshness(chunks, now), "stream", "left").join(
        reciprocal_rank(feedback).select("stream", "mrr"), "stream", "left")
    return out.where("stream <> '_global'").na.fill(0).withColumn("regret_rate", F.lit(0.0))


def simple_query_class(query: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: F.length(w) > 0))
    return F.when(words <= 3, "simple").when(words <= 8, "medium").when(
        F.lower(query).rlike("how|why|compare"), "complex").otherwise("medium")


def memory_profile(chunks: DataFrame, vectors: DataFrame, events: DataFrame, now: int, topics: int = 10) -> DataFrame:
    """Density, query rate, embedding count and hottest subjects of each stream, long."""
    lo = now - 7 * DAY
    c = chunks.where("deleted_at is null")
    base = c.join(vectors.select("id", F.lit(1).alias("v")), "id", "left").groupBy("stream").agg(
        F.count("*").cast("double").alias("chunks"), F.count("v").cast("double").alias("embeddings"),
        F.round(F.count_if(F.col("timestamp") >= lo) / 7, 6).alias("density"))
    out = base.select("stream", F.expr("stack(3, 'chunks', chunks, 'embeddings', embeddings, 'density', density) as (item, value)"))
    t = c.where("meta.subject is not null").groupBy("stream", F.lower("meta.subject").alias("s")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("stream").orderBy(F.desc("n"), "s")
    t = t.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= topics).select(
        "stream", F.concat(F.lit("topic:"), "s").alias("item"), F.col("n").cast("double").alias("value"))
    q = events.where((F.col("type") == "search") & (F.col("sec") >= lo))
    kinds = q.groupBy("stream", simple_query_class(F.col("query")).alias("k")).agg(F.count("*").cast("double").alias("value"))
    kinds = kinds.select("stream", F.concat(F.lit("queries:"), "k").alias("item"), "value")
    rate = q.groupBy("stream").agg(F.round(F.count("*") / 7, 6).alias("value")).select("stream", F.lit("queries_per_day").alias("item"), "value")
    return out.unionByName(t).unionByName(kinds).unionByName(rate)


def admin_stats(chunks: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals, maps by level and type, pending work, bytes, activity, graph size."""
    live = chunks.where("deleted_at is null")
    main = chunks.groupBy("stream").agg(
        _n("deleted_at is not null", "soft_deleted"), _n("deleted_at is null", "total"),
        _n("deleted_at is null and dormant", "dormant"),
        _n("deleted_at is null and level = 0 and not consolidated", "pending_l0"),
        _n("deleted_at is null and (not is_latest or supersedes_id is not null)", "contradictions"),
        F.sum(F.expr("case when deleted_at is null then octet_length(content) else 0 end")).alias("bytes"),
        F.min(F.expr("case when deleted_at is null and timestamp > 0 then timestamp end")).alias("first_chunk"),
        F.max(F.expr("case when deleted_at is null and timestamp > 0 then timestamp end")).alias("last_chunk"),
        F.max(F.expr("case when deleted_at is null then coalesce(last_implicit_boost, updated_at, 0) end")).alias("last_access"))
    levels = live.groupBy("stream", F.concat(F.lit("L"), F.col("level").cast("string")).alias("k")).agg(F.count("*").alias("v"))
    levels = levels.groupBy("stream").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("by_level"))
    types = live.groupBy("stream", F.coalesce("meta.fact_type", F.lit("UNKNOWN")).alias("k")).agg(F.count("*").alias("v"))
    types = types.groupBy("stream").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("by_type"))
    out = main.join(levels, "stream", "left").join(types, "stream", "left")
    ge = entities.groupBy("stream").agg(F.count("*").alias("entities"))
    gd = edges.groupBy("stream").agg(F.count("*").alias("edges"))
    return out.join(ge, "stream", "full_outer").join(gd, "stream", "full_outer").na.fill(0, ["entities", "edges", "total", "soft_deleted"])


def quality(chunks: DataFrame) -> DataFrame:
    """Quality score of the latest rows of each stream and what to do about it."""
    c = chunks.where("is_latest").withColumn("agent", F.coalesce("source.agent", F.lit("unknown"))).withColumn(
        "words", F.size(F.filter(F.split("content", r"\s+"), lambda w: F.length(w) > 0)))
    q = c.groupBy("stream").agg(
        F.count("*").alias("total"), _n("meta is null", "no_meta"), _n("meta is not null and meta.subject is null", "no_subject"),
        _n("meta.confidence < 0.5", "low_confidence"),
        _n("agent in ('raw-transcript', 'openclaw-memory')", "raw_transcripts"), _n("words < 5", "short"))
    has, subj = (F.col("total") - F.col("no_meta")) / F.col("total"), (F.col("total") - F.col("no_subject") - F.col("no_meta")) / F.col("total")
    score = F.floor(F.round((has * 0.4 + subj * 0.3 + (1 - F.col("raw_transcripts") / F.col("total")) * 0.3) * 100, 6))
    q = q.withColumn("score", score.cast("long"))
    return (q.withColumn("advise_reprocess", F.col("no_meta") > F.expr("total div 3"))
            .withColumn("advise_ingest", F.col("raw_transcripts") > F.expr("total div 4"))
            .withColumn("advise_consolidate", F.col("low_confidence") > 10)
            .withColumn("advise_noise", F.col("short") > 10).withColumn("good", F.col("score") >= 80))


def quality_breakdown(chunks: DataFrame) -> DataFrame:
    """(stream, by, value, n): latest rows of each stream by level, by source agent and by fact type."""
    kinds = F.array(F.struct(F.lit("level").alias("by"), F.concat(F.lit("L"), F.col("level").cast("string")).alias("value")),
                    F.struct(F.lit("source").alias("by"), F.coalesce("source.agent", F.lit("unknown")).alias("value")),
                    F.struct(F.lit("type").alias("by"), F.coalesce("meta.fact_type", F.lit("UNKNOWN")).alias("value")))
    return chunks.where("is_latest").select("stream", F.inline(kinds)).groupBy("stream", "by", "value").agg(F.count("*").alias("n"))


def effectiveness(outcomes: DataFrame) -> DataFrame:
    """Followed advisories overall (`_all`) and by type."""
    r = outcomes.rollup("advisory_type").agg(F.count("*").alias("total"), _n("followed", "followed_n"))
    return r.select(F.coalesce("advisory_type", F.lit("_all")).alias("advisory_type"), "total",
                    F.col("followed_n").alias("followed"), F.round(F.col("followed_n") / F.col("total"), 6).alias("rate"))


def latent_stats(latents: DataFrame, promotions: DataFrame, consumed: DataFrame) -> DataFrame:
    """Totals over the latent table and its two append-only logs, per stream."""
    a = latents.groupBy("stream").agg(F.count("*").alias("total"), _n("promoted", "promoted"))
    b = promotions.groupBy("stream").agg(F.count("*").alias("promotions"))
    c = consumed.groupBy("stream").agg(F.count("*").alias("consumed"))
    out = a.join(b, "stream", "left").join(c, "stream", "left").na.fill(0)
    return out.withColumn("rate", F.round(F.col("promoted") / F.col("total"), 6))


def daily_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """USD and tokens per day and workspace, with a row per day over all (`_all`)."""
    c = calls.join(prices, "model", "left").withColumn(
        "usd", F.coalesce(F.col("tokens") / 1000 * F.col("usd_per_1k"), F.lit(0.0)))
    per = c.groupBy("day", "workspace").agg(F.sum("usd").alias("usd"), F.sum("tokens").alias("tokens"))
    both = per.unionByName(per.groupBy("day").agg(F.sum("usd").alias("usd"), F.sum("tokens").alias("tokens")).withColumn("workspace", F.lit("_all")))
    return both.select("day", "workspace", F.round("usd", 6).alias("usd"), "tokens")


def budget_tier(usd: Column, cap: float) -> Column:
    used = usd / cap if cap > 0 else F.lit(0.0)
    return (F.when(used >= 1.0, "log_only").when(used >= 0.95, "associations_disabled")
            .when(used >= 0.80, "reranker_disabled").otherwise("normal"))


def cost_alerts(daily: DataFrame, cap: float, multiplier: float) -> DataFrame:
    """Tier of every day, and whether it costs more than `multiplier` times the mean
    of the days present among the seven before."""
    w = Window.partitionBy("workspace").orderBy("day").rangeBetween(-7, -1)
    d = daily.withColumn("mean7", F.round(F.coalesce(F.avg("usd").over(w), F.lit(0.0)), 6))
    return d.withColumn("tier", budget_tier(F.col("usd"), cap)).withColumn(
        "alert", F.when(F.col("usd") >= cap, "budget").when(F.col("usd") > F.col("mean7") * multiplier, "anomaly").otherwise("none"))


def failures_last_hour(events: DataFrame, now: int) -> DataFrame:
    """Failures by kind over the last hour; empty extractions stay out of `_total`."""
    f = events.where((F.col("type") == "llm_failure") & (F.col("sec") > now - 3600) & (F.col("sec") <= now))
    k = f.groupBy("kind").agg(F.count("*").alias("n"))
    return k.unionByName(k.where("kind <> 'extraction_empty'").agg(F.sum("n").alias("n")).select(F.lit("_total").alias("kind"), F.coalesce("n", F.lit(0).cast("long")).alias("n")))


OBSERVATIONS = "observations array<struct<type:string,content:string,importance:string,confidence:double,event_at_raw:string>>"


def merge_observations(replies: DataFrame) -> DataFrame:
    """`replies(group_id, reply)`: JSON observations merged into one row each.

    Rows whose reply is unreadable or empty are dropped.
    """
    body = F.regexp_replace(F.trim("reply"), r"^```(json)?\s*|\s*```$", "")
    r = replies.select("group_id", F.from_json(body, OBSERVATIONS)["observations"].alias("obs")).where("size(obs) > 0")
    o = r.select("group_id", F.posexplode("obs").alias("pos", "o")).select(
        "group_id", "pos", F.lower("o.type").alias("type"), "o.content", "o.importance", "o.confidence", "o.event_at_raw")
    mark = F.when(F.col("importance") == "high", "[!]").when(F.col("importance") == "medium", "[*]").otherwise("[.]")
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), mark, F.lit(" "), "content")
    rank = F.when(F.col("importance") == "high", 3).when(F.col("importance") == "medium", 2).when(
        F.col("importance").isNotNull(), 1)
    value = F.when(F.col("imp") == 3, 1.0).when(F.col("imp") == 2, 0.5).when(F.col("imp") == 1, 0.1)
    votes = o.groupBy("group_id", "type").agg(F.count("*").alias("n")).groupBy("group_id").agg(
        F.max_by("type", F.struct("n", "type")).alias("dominant"))
    merged = o.groupBy("group_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"]), "\n").alias("content"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.7)), 6).alias("confidence"), F.max(rank).alias("imp"),
        F.min_by("event_at_raw", F.when((F.col("type") == "event") & F.col("event_at_raw").isNotNull(), F.col("pos"))).alias("event_at_raw"))
    return merged.join(votes, "group_id").select("group_id", "dominant", "content", "confidence", value.alias("importance"), "event_at_raw")


def association_health(metrics: DataFrame, now: int, metric: str = "mean_top1_score", floor: float = 0.35) -> DataFrame:
    """Health by the last 168 hourly mean scores of each stream."""
    hi = now // 3600
    v = metrics.where((F.col("metric") == metric) & (F.col("hour") >= hi - 168) & (F.col("hour") <= hi))
    a = v.groupBy("stream").agg(F.count("*").alias("hours"), F.count_if(F.col("value") < floor).alias("below"), F.round(F.avg("value"), 6).alias("mean"))
    all_low = (F.col("below") == F.col("hours")) & (F.col("hours") >= 24)
    return a.withColumn("health", F.when(all_low & (F.expr("hours div 24") >= 7), "disabled").when(
        all_low | (F.col("below") > F.expr("hours div 2")), "degraded").otherwise("healthy"))


def sufficiency(hits: DataFrame, wanted: int) -> DataFrame:
    """How well a result list answers: coverage, level diversity, bottom over top."""
    a = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("level").alias("levels"),
                                     F.max("score").alias("top"), F.min("score").alias("bottom"))
    s = (F.col("n") / wanted * 0.4 + F.least(F.lit(1.0), F.col("levels") / 2) * 0.3
         + F.when(F.col("top") > 0, F.col("bottom") / F.col("top")).otherwise(0.0) * 0.3)
    a = a.withColumn("score", F.round(F.least(F.lit(1.0), s), 6))
    return a.withColumn("label", F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low"))


def entity_digest(chunks: DataFrame, chunk_entity: DataFrame, sections: int, untagged: str = "General") -> DataFrame:
    """Rows under each entity, sections by summed importance, rows by importance then score."""
    c = chunks.select("id", "importance", "score")
    t = c.join(chunk_entity.select("id", "name").distinct(), "id", "left").withColumn("entity", F.coalesce("name", F.lit(untagged)))
    top = t.groupBy("entity").agg(F.round(F.sum(F.coalesce("importance", F.lit(0.0))), 6).alias("weight")).orderBy(
        F.desc("weight"), "entity").limit(sections)
    top = top.withColumn("section", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("weight"), "entity")))
    w = Window.partitionBy("entity").orderBy(F.desc(F.coalesce("importance", F.lit(1.0))), F.desc("score"), "id")
    return t.join(top, "entity").withColumn("pos", F.row_number().over(w)).select("section", "entity", "weight", "pos", "id")


def recall_at(hits: DataFrame, truth: DataFrame, ks: tuple[int, ...], category: str = "category") -> DataFrame:
    """Share of cases with a true row among the first k, by category.
    `truth(query_id, category, id)`."""
    found = truth.join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    best = found.groupBy("query_id", category).agg(F.min("rank").alias("rank"))
    return best.groupBy(category).agg(F.count("*").alias("cases"), *[
        F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks])


def spread_gate(scores: DataFrame, key: str, score: str = "score") -> DataFrame:
    a = scores.groupBy(key).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.round(F.max(score) - F.min(score), 6).alias("spread"))
    return a.withColumn("status", F.when(F.col("spread") > 0.40, "pass").when(F.col("spread") > 0.30, "warn").otherwise("fail"))
