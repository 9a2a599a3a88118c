"""Unions of result lists with a rule for rows that occur twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import top_n


def max_merge(*lists: tuple[DataFrame, float]) -> DataFrame:
    """Best weighted score per (query_id, id) over the lists."""
    out = None
    for df, weight in lists:
        p = df.select("query_id", "id", F.round(F.col("score") * weight, 6).alias("score"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def add_sub_query_vectors(base: DataFrame, sub_hits: DataFrame, floor: float = 0.3, share: float = 0.5) -> DataFrame:
    """Sub-query neighbours add `share` of their similarity to a row's score."""
    extra = sub_hits.where(F.col("sim") >= floor).select("query_id", "id", (F.col("sim") * share).alias("score"))
    both = base.select("query_id", "id", "score").unionByName(extra)
    return both.groupBy("query_id", "id").agg(F.round(F.sum("score"), 6).alias("score"))


def inject(hits: DataFrame, lane: DataFrame) -> DataFrame:
    """Hits and the lane rows not among them, marked."""
    cols = ["query_id", "id", "score"]
    new = lane.select(*cols).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return hits.select(*cols, F.lit(False).alias("injected")).unionByName(new.select(*cols, F.lit(True).alias("injected")))


def first_mechanism(pools: Sequence[tuple[str, DataFrame]], shown: DataFrame, n: int) -> DataFrame:
    """Candidates of several mechanisms without what is shown; for a row found
    twice the earlier mechanism counts; best `n` by score."""
    out = None
    for prio, (name, df) in enumerate(pools):
        p = df.select("query_id", "id", "score", F.lit(name).alias("mechanism"), F.lit(prio).alias("prio"))
        out = p if out is None else out.unionByName(p)
    out = out.join(shown.select("query_id", "id"), ["query_id", "id"], "left_anti")
    w = Window.partitionBy("query_id", "id").orderBy("prio", F.desc("score"))
    out = out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "prio")
    return top_n(out, ["query_id"], [F.desc("score"), F.col("id")], n)


def join_entity_lists(dictionary: DataFrame, model: DataFrame) -> DataFrame:
    """Dictionary entities and the model's others; a name known to the dictionary stays its."""
    known = dictionary.select("id", F.lower("name").alias("key")).distinct()
    new = model.withColumn("key", F.lower("name")).join(known, ["id", "key"], "left_anti").drop("key")
    return dictionary.select("id", "name", F.lit("dictionary").alias("origin")).distinct().unionByName(
        new.select("id", "name", F.lit("model").alias("origin")).distinct())


def valid_rating(max_chars: int = 500) -> Column:
    """Usefulness 0 to 4 and a justification of 1 to `max_chars` characters; a
    harmful mark needs one that is not blank."""
    n = F.length(F.coalesce("justification", F.lit("")))
    ok = F.col("usefulness").between(0, 4) & (n > 0) & (n <= max_chars)
    return F.coalesce(ok & (~F.col("harmful") | (F.length(F.trim("justification")) > 0)), F.lit(False))


def beta_tally(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tally per chunk from the prior 1, 1; rejected ratings)."""
    good = ratings.where(valid_rating())
    t = good.groupBy("chunk_id").agg(
        F.round(1 + F.sum(F.col("usefulness") / 4), 6).alias("alpha"),
        F.round(1 + F.sum((4 - F.col("usefulness")) / 4) + 4 * F.count_if("harmful"), 6).alias("beta"),
        F.count("*").alias("n_ratings"), F.count_if("harmful").alias("harmful_count"), F.max("rated_at").alias("last_rated_at"))
    return t, ratings.where(~valid_rating())
