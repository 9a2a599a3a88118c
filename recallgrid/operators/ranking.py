"""Ranks, fusion, pools, and cuts over (query, hit) tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

RRF_K = 60


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First `n` rows per key in `order`; the window limit acts before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def spread_sums(df: DataFrame, key: str, order: Sequence[Column], sums: Mapping[str, Column], rank: str = "pos") -> DataFrame:
    """Exact 1-based rank and running sums within `key`, for groups too large for one task.

    Rows are cut into ranges of (key, order); what a row has is its place and
    its sums in its range plus those of the key in the ranges before. The cut is
    checkpointed, so both uses see the same ranges.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    cut = cut_lineage(df.select("*", *(v.alias(f"_own_{c}") for c, v in sums.items())).repartitionByRange(n, F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    all_ = {rank: F.lit(1).cast("long"), **{c: F.col(f"_own_{c}") for c in sums}}
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(key, "_part").agg(*(F.sum(v).alias(f"_all_{c}") for c, v in all_.items()))
    before = parts.select(key, "_part", *(F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in all_))
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.select("*", *(F.sum(v).over(inside).alias(f"_at_{c}") for c, v in all_.items())).join(before, [key, "_part"])
    return placed.select(*(F.col(c) for c in df.columns), *((F.col(f"_at_{c}") + F.col(f"_before_{c}")).alias(c) for c in all_))


def spread_rank(df: DataFrame, key: str, order: Sequence[Column], rank: str = "pos") -> DataFrame:
    """Exact 1-based rank within `key` for groups too large for one task."""
    return spread_sums(df, key, order, {}, rank)


def channel_rank(score: str, key: str = "query_id", id_col: str = "id") -> Column:
    """1-based rank by score, null for scores of zero or below."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.col(id_col))
    return F.when(F.col(score) > 0, F.row_number().over(w))


def max_normalised(score: str, key: str = "query_id") -> Column:
    """Score over the channel's best in the query, 0 where the best is not positive."""
    m = F.max(score).over(Window.partitionBy(key))
    return F.when(m > 0, F.coalesce(F.col(score), F.lit(0.0)) / m).otherwise(F.lit(0.0))


def rrf(pool: DataFrame, channels: dict[str, Column], key: str = "query_id", k: int = RRF_K) -> DataFrame:
    """Adds `<channel>_rank` and `rrf`. A channel that is zero for a whole query
    gives its weight to the others."""
    w = Window.partitionBy(key)
    out = pool
    for c in channels:
        out = out.withColumn(f"{c}_rank", channel_rank(c, key))
        out = out.withColumn(f"_{c}_w", F.when(F.max(F.abs(c)).over(w) > 0, channels[c]).otherwise(F.lit(0.0)))
    total = sum((F.col(f"_{c}_w") for c in channels), F.lit(0.0))
    score = sum((
        F.when(F.col(f"{c}_rank").isNotNull() & (total > 0),
               F.col(f"_{c}_w") / total / (k + F.col(f"{c}_rank"))).otherwise(F.lit(0.0))
        for c in channels), F.lit(0.0))
    return out.withColumn("rrf", F.round(score, 8)).drop(*[f"_{c}_w" for c in channels])


def pool_with_guarantee(ranked: DataFrame, size: int, guaranteed: str = "guaranteed") -> DataFrame:
    """Head of the ranking plus every guaranteed row beyond it."""
    return ranked.where((F.col("rank") <= size) | F.coalesce(F.col(guaranteed), F.lit(False)))


def head_plus_lane(ranked: DataFrame, head: int, cap: int, key: str = "query_id") -> DataFrame:
    """First `head` rows, then up to `cap` lane rows below them, in rank order."""
    tail_lane = (F.col("rank") > head) & F.col("in_lane")
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(F.when(tail_lane, 1).otherwise(0)).over(w)
    return ranked.withColumn("_n", seen).where((F.col("rank") <= head) | (tail_lane & (F.col("_n") <= cap))).drop("_n")


def one_per_subject(ranked: DataFrame, subject: str = "subject", key: str = "query_id") -> DataFrame:
    """Best row per lower-cased subject; rows without a subject stay."""
    w = Window.partitionBy(key, F.lower(subject)).orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | F.col(subject).isNull()).drop("_n")


def within_budget(ranked: DataFrame, cost: Column, budget: int, key: str = "query_id") -> DataFrame:
    """Rows while the running cost fits; the first row always stays."""
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("spent", F.sum(cost).over(w)).where((F.col("spent") <= budget) | (F.col("rank") == 1))


def twin_head(text: str = "content") -> Column:
    """The part of a text that `drop_prefix_twins` compares: where texts are joined to hits, no more of them need move."""
    return F.substring(text, 1, 150).alias(text)


def drop_prefix_twins(pool: DataFrame, key: str = "query_id", order: str = "rank") -> DataFrame:
    """Drops a row whose lower-cased first 150 characters share more than 80 % of
    the shorter text with a row kept above it. Texts under 30 bytes never match.

    Order-dependent, so it runs as grouped map over one query's candidate pool,
    whose size the caller has already cut (three times the result length).
    """
    pool = cut_lineage(pool)  # read twice: what made it would run twice
    slim = pool.select(key, "id", order, F.lower(twin_head()).alias("print"))
    schema = slim.select(key, "id").schema

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[str, int]] = []
        rows = []
        for r in pdf.sort_values(order).itertuples(index=False):
            text = getattr(r, "print")
            size = len(text.encode())
            twin = False
            for other, other_size in kept:
                shorter = min(size, other_size)
                if shorter < 30:
                    continue
                common = next((i for i, (a, b) in enumerate(zip(text, other)) if a != b), min(len(text), len(other)))
                if common / shorter > 0.8:
                    twin = True
                    break
            if not twin:
                kept.append((text, size))
                rows.append((getattr(r, key), r.id))
        return pd.DataFrame(rows, columns=[key, "id"])

    kept = slim.groupBy(key).applyInPandas(keep, schema)
    return pool.join(kept, [key, "id"], "left_semi")
