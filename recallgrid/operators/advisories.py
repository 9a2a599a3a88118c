"""Rule jobs that tell a stream's owner what to look at."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .ranking import top_n

DAY = 86400
HIGH, MEDIUM, LOW = 3, 2, 1


def _words(query: Column) -> Column:
    return F.array_distinct(F.filter(F.split(query, r"\s+"), lambda w: F.length(w) > 0))


def similar_queries(distinct: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Pairs (stream, q, earlier) whose word sets overlap by more than `threshold`.

    Exact set-similarity join on prefixes: with words ordered rarest first, two
    sets above the threshold share a word among the first |set| - ceil(t |set|) + 1,
    so common words never become join keys unless a set is made of them.
    `distinct(stream, q, first)` has one row per query text, `first` sortable.
    """
    w = distinct.select("stream", "q", "first", F.explode("words").alias("word"))
    freq = w.groupBy("stream", "word").agg(F.count("*").alias("f"))
    ordered = w.join(freq, ["stream", "word"]).groupBy("stream", "q", "first").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("f", "word"))), lambda s: s["word"]).alias("ws"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    pre = ordered.withColumn("n", F.size("ws")).withColumn("key", F.explode(F.slice("ws", F.lit(1), keep.cast("int"))))
    a = pre.select("stream", "key", "q", "first", F.col("ws").alias("wa"), "n")
    b = pre.select("stream", "key", F.col("q").alias("earlier"), F.col("first").alias("earlier_first"), F.col("ws").alias("wb"), F.col("n").alias("m"))
    c = a.join(b, ["stream", "key"]).where(
        (F.col("earlier_first") < F.col("first")) & (F.least("n", "m") > threshold * F.greatest("n", "m")))
    inter = F.size(F.array_intersect("wa", "wb"))
    return c.where(inter / (F.col("n") + F.col("m") - inter) > threshold).select(
        "stream", "q", "earlier", "first", "earlier_first").distinct()


def repeated_queries(searches: DataFrame, threshold: float = 0.6, at_least: int = 3) -> DataFrame:
    """Searches grouped with the first earlier group they resemble.

    A query opens a group when no earlier group's opener resembles it. Openers
    are found in rounds over the pair table: a query with no undecided or opening
    earlier neighbour opens; one with an opening earlier neighbour joins.
    `searches(stream, query, order)`.
    """
    q = searches.withColumn("q", F.lower(F.trim("query"))).where("q <> ''")
    distinct = q.groupBy("stream", "q").agg(F.min("order").alias("first"), F.count("*").alias("n"))
    distinct = cut_lineage(distinct.withColumn("words", _words(F.col("q"))))
    pairs = cut_lineage(similar_queries(distinct.select("stream", "q", "words", "first"), threshold))
    state = cut_lineage(distinct.select("stream", "q", F.lit(None).cast("boolean").alias("opens")))
    while not state.where("opens is null").isEmpty():
        known = state.select("stream", F.col("q").alias("earlier"), "opens")
        seen = pairs.join(known, ["stream", "earlier"]).groupBy("stream", "q").agg(
            F.max(F.coalesce(F.col("opens"), F.lit(False))).alias("near_opener"),
            F.max(F.col("opens").isNull()).alias("near_open_question"))
        nxt = state.join(seen, ["stream", "q"], "left").select("stream", "q", F.coalesce(
            "opens", F.when(F.coalesce("near_opener", F.lit(False)), False).when(
                F.coalesce("near_open_question", F.lit(False)), None).otherwise(True)).alias("opens"))
        state = cut_lineage(nxt)
    openers = state.where("opens").select("stream", F.col("q").alias("earlier"))
    joined = pairs.join(openers, ["stream", "earlier"]).groupBy("stream", "q").agg(
        F.min_by("earlier", "earlier_first").alias("leader"))
    members = distinct.join(state.where("not opens").select("stream", "q"), ["stream", "q"], "left_semi").join(
        joined, ["stream", "q"]).select("stream", "leader", "n")
    own = distinct.join(state.where("opens").select("stream", "q"), ["stream", "q"], "left_semi").select("stream", F.col("q").alias("leader"), "n")
    groups = own.unionByName(members).groupBy("stream", "leader").agg(F.sum("n").alias("n"))
    return groups.where(F.col("n") >= at_least)


def ignored_searches(events: DataFrame, feedback: DataFrame, more_than: int = 3, score: float = 0.5) -> DataFrame:
    """Streams with good searches and no feedback at all."""
    good = events.where((F.col("type") == "search") & (F.col("top1") > score) & (F.col("result_count") > 0))
    return good.groupBy("stream").agg(F.count("*").alias("n")).where(F.col("n") > more_than).join(
        feedback.select("stream").distinct(), "stream", "left_anti")


def stale_facts(chunks: DataFrame, now: int, days: int) -> DataFrame:
    """Rows not updated for `days` while their subject has newer ones."""
    c = chunks.where("deleted_at is null and meta.subject is not null").select(
        "id", "stream", F.lower("meta.subject").alias("subject"), "timestamp", F.coalesce("updated_at", "timestamp").alias("updated"))
    s = c.groupBy("stream", "subject").agg(F.max("timestamp").alias("newest"), F.count("*").alias("n")).where("n >= 2")
    return c.join(s, ["stream", "subject"]).where(
        (F.col("updated") < now - days * DAY) & (F.col("newest") > F.col("updated"))).select("stream", "subject", "id", "updated")


def several_heads(chunks: DataFrame) -> DataFrame:
    """Subjects with two or more latest rows."""
    c = chunks.where("deleted_at is null and meta.subject is not null")
    return c.groupBy("stream", F.lower("meta.subject").alias("subject")).agg(
        F.count_if("is_latest").alias("heads")).where("heads >= 2")


def health_rules(summary: DataFrame) -> DataFrame:
    """Rule rows per stream, or one `ok` row where nothing fires."""
    rule = lambda name, prio, cond: F.when(F.expr(cond), F.struct(F.lit(name).alias("rule"), F.lit(prio).alias("priority")))
    fired = F.filter(F.array(
        rule("dead_memory", MEDIUM, "dead_share > 0.30"),
        rule("low_recall", LOW, "recall_ratio < 0.3 and store_count > 0"),
        rule("zero_results", MEDIUM, "zero_result_rate > 0.20 and search_count > 5"),
        rule("no_scores", HIGH, "mean_top1_score = 0 and search_count > 0")), lambda x: x.isNotNull())
    ok = F.array(F.struct(F.lit("ok").alias("rule"), F.lit(LOW).alias("priority")))
    s = summary.where("store_count > 0 or search_count > 0").withColumn("r", F.explode(F.when(F.size(fired) > 0, fired).otherwise(ok)))
    return s.select("stream", "r.rule", "r.priority")


def weight_suggestions(effectiveness: DataFrame) -> DataFrame:
    e = effectiveness.where("advisory_type <> '_all' and total >= 3")
    return e.withColumn("action", F.when(F.col("rate") < 0.2, "deprioritize").when(F.col("rate") > 0.5, "promote")).where("action is not null")


def combined(chunks: DataFrame, events: DataFrame, feedback: DataFrame, gaps: DataFrame, now: int, *, repeat_at_least: int = 3,
             stale_days: int = 30, most: int = 10, rules: Collection[str] | None = None) -> DataFrame:
    """All rules of a stream as rows, high priority first, `most` per stream; with `rules`, only those named."""
    cols = ["stream", "advisory_type", "about", "n", "priority"]
    row = lambda df, kind, about, n, prio: df.select("stream", F.lit(kind).alias("advisory_type"), about.alias("about"), n.cast("long").alias("n"), F.lit(prio).alias("priority"))
    searches = events.where("type = 'search'").select("stream", "query", F.struct("sec", "event_id").alias("order"))
    rep = row(repeated_queries(searches, at_least=repeat_at_least), "repeated_query", F.col("leader"), F.col("n"), MEDIUM)
    ign = row(ignored_searches(events, feedback), "search_ignored", F.lit(""), F.col("n"), MEDIUM)
    gap = row(gaps.groupBy("stream").agg(F.count("*").alias("n")), "gap_filled", F.lit(""), F.col("n"), LOW)
    stale = row(stale_facts(chunks, now, stale_days).groupBy("stream").agg(F.count("*").alias("n")), "stale_fact", F.lit(""), F.col("n"), MEDIUM)
    heads = row(several_heads(chunks), "contradiction", F.col("subject"), F.col("heads"), HIGH)
    found = {"repeated_query": rep, "search_ignored": ign, "gap_filled": gap, "stale_fact": stale, "contradiction": heads}
    out = reduce(DataFrame.unionByName, (df.select(*cols) for name, df in found.items() if rules is None or name in rules))
    return top_n(out, ["stream"], [F.desc("priority"), F.col("advisory_type"), F.desc("n"), F.col("about")], most)


def oscillation(adjustments: DataFrame, now: int, days: int = 21) -> DataFrame:
    """Streams whose decay suggestions changed sign three times or more lately.
    `adjustments(stream, ts, value)`."""
    a = adjustments.where(F.col("ts") >= now - days * DAY).withColumn("up", F.col("value") >= 0)
    w = Window.partitionBy("stream").orderBy("ts", "value")
    a = a.withColumn("changed", F.when(F.lag("up").over(w) != F.col("up"), 1).otherwise(0))
    s = a.groupBy("stream").agg(F.count("*").alias("points"), F.sum("changed").alias("changes"), F.round(F.avg("value"), 6).alias("freeze_at"))
    return s.where("points >= 3 and changes >= 3")


def decay_suggestion(summary: DataFrame, frozen: DataFrame) -> DataFrame:
    """Decay factor change per stream; none while it oscillates."""
    f = frozen.select("stream", F.lit(True).alias("frozen"))
    s = F.when(F.col("frozen"), None).when((F.col("dead_share") > 0.40) & (F.col("regret_rate") < 0.05), -0.05).when(
        F.col("regret_rate") > 0.10, 0.05)
    return summary.join(f, "stream", "left").select("stream", F.coalesce("frozen", F.lit(False)).alias("frozen"), s.cast("double").alias("adjustment"))
