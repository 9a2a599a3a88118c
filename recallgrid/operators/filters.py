"""Row filters. All are plain predicates, so they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Agents and content openings that mark operational rows.
OPERATIONAL_AGENTS = ["raw-transcript", "openclaw", "system", "toolresult", "tool_result", "meta", "debug"]
OPERATIONAL_OPENINGS = ["toolresult", "tool_result", '{"tool', "error:", "system:"]


def in_streams(df: DataFrame, streams: Sequence[str] | None) -> DataFrame:
    return df if streams is None else df.where(F.col("stream").isin(list(streams)))


def readable(df: DataFrame, membership: DataFrame, user: str, scope: str = "all") -> DataFrame:
    """Rows of the streams a user may read: shared ones, own ones, or both."""
    m = membership
    if scope == "shared":
        m = m.where("kind = 'shared'")
    elif scope == "private":
        m = m.where((F.col("kind") == "private") & (F.col("user") == user))
    else:
        m = m.where((F.col("kind") == "shared") | (F.col("user") == user))
    return df.join(m.select("stream").distinct(), "stream", "left_semi")


def by_agent(df: DataFrame, include: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Exact agent, or all but some; rows without an agent survive excludes."""
    agent = F.coalesce(F.col("source.agent"), F.lit("unknown"))
    if include is not None:
        df = df.where(agent == include)
    return df.where(~agent.isin(list(exclude))) if exclude else df


def valid_at(at: Column) -> Column:
    """Validity contains `at`, both ends included, open where null."""
    lo, hi = F.col("valid_from"), F.col("valid_until")
    return (lo.isNull() | (lo <= at)) & (hi.isNull() | (hi >= at))


def fact_filter(fact_type: str | None = None, subject: str | None = None, min_confidence: float | None = None) -> Column:
    """Type or topic, subject part, confidence; rows without meta fail."""
    ok = F.col("meta").isNotNull()
    if fact_type is not None:
        ok = ok & ((F.col("meta.fact_type") == fact_type) | F.coalesce(F.col("meta.topic") == fact_type, F.lit(False)))
    if subject is not None:
        ok = ok & F.coalesce(F.lower("meta.subject").contains(subject.lower()), F.lit(False))
    if min_confidence is not None:
        ok = ok & (F.col("meta.confidence") >= min_confidence)
    return ok


def event_noon(event_date: str = "meta.event_date", timestamp: str = "timestamp") -> Column:
    """Noon UTC of the event date, else the row's own time."""
    day = F.expr(f"try_to_date({event_date}, 'yyyy-MM-dd')")
    return F.coalesce(F.unix_date(day).cast("long") * 86400 + 43200, F.col(timestamp))


def decay_eligible(min_score: float = 0.01) -> Column:
    return ~F.col("dormant") & F.col("deleted_at").isNull() & (F.col("score") > min_score)


def expired(now: int, days: int = 30) -> Column:
    return F.col("deleted_at").isNotNull() & (F.col("deleted_at") <= now - days * 86400)


def associable() -> Column:
    """Latest, live, not operational, and long enough to mean something."""
    agent = F.lower(F.coalesce(F.col("source.agent"), F.lit("")))
    text = F.lower("content")
    ok = F.col("is_latest") & F.col("deleted_at").isNull() & (F.octet_length("content") >= 10)
    for a in OPERATIONAL_AGENTS:
        ok = ok & ~agent.contains(a)
    for p in OPERATIONAL_OPENINGS:
        ok = ok & ~text.startswith(p)
    return ok


def by_confidence(threshold: float, column: str = "confidence") -> Column:
    return F.when(F.col(column) >= threshold, "kept").otherwise("rejected")


# Agents whose rows came out of an earlier reprocessing.
REPROCESSED_AGENTS = ["legacy-raw", "knowledge_extraction", "raw-transcript"]


def reprocess_candidates(chunks: DataFrame, force: bool = False, include: Sequence[str] = (),
                         exclude: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Rows of levels 0 and 1 not yet reprocessed, by source, oldest first when limited."""
    agent = F.coalesce(F.col("source.agent"), F.lit(""))
    df = chunks.where((F.col("level") <= 1) & F.col("deleted_at").isNull())
    if not force:
        df = df.where(~agent.isin(REPROCESSED_AGENTS))
    if include:
        df = df.where(agent.isin(list(include)))
    if exclude:
        df = df.where(~agent.isin(list(exclude)))
    return df if limit is None else df.orderBy("timestamp", "id").limit(limit)
