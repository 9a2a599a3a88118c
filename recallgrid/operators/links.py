"""Joins between memory tables: chains, neighbours in time, gaps, repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import cosine
from ..session import cut_lineage
from ..sources.chunk_store import live
from .components import components
from .filters import associable
from .ranking import spread_rank, top_n
from .similarity import nearest


def _heads(chunks: DataFrame) -> DataFrame:
    return live(chunks).where("is_latest").select("id", "stream", F.lower("meta.subject").alias("subject"))


def contradiction_candidates(incoming: DataFrame, chunks: DataFrame, vectors: DataFrame, threshold: float = 0.70,
                             n: int = 5, same_subject: bool = False, screen: bool = False) -> DataFrame:
    """Latest live rows of the same stream close to each incoming row.

    `incoming` has new_id, stream, subject, embedding. With `same_subject` the
    subjects must be equal (both missing is equal); with `screen` a missing
    subject on either side passes.
    """
    known = _heads(chunks).join(vectors.select("id", "embedding"), "id")
    new = incoming.withColumn("subject", F.lower("subject"))
    if same_subject:
        key = F.coalesce(F.concat(F.lit("="), F.col("subject")), F.lit("none"))
        return nearest(new.withColumn("skey", key), known.withColumn("skey", key), n, left_key="new_id",
                       on=["stream", "skey"], min_sim=threshold, exclude_self=True)
    return nearest(new, known, n, left_key="new_id", on=["stream"], loose=["subject"] if screen else [],
                   min_sim=threshold, exclude_self=True)


def bump_duplicates(chunks: DataFrame, duplicates: DataFrame, now: int) -> DataFrame:
    """Access count grows by the number of incoming rows that repeat a chunk."""
    bumps = duplicates.groupBy("id").agg(F.count("*").alias("bump"))
    return chunks.join(bumps, "id", "left").withColumn(
        "access_count", F.col("access_count") + F.coalesce("bump", F.lit(0))).withColumn(
        "updated_at", F.when(F.col("bump").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))).drop("bump")


def temporal_neighbours(anchors: DataFrame, chunks: DataFrame, clusters: DataFrame, vectors: DataFrame,
                        hours: int, n: int, min_cos: float = 0.15) -> DataFrame:
    """Rows within `hours` of any anchor of a query, in a cluster no anchor has.

    `anchors(query_id, stream, chunk_id)`. The interval join has an equi key:
    stream and a time bucket as wide as the window.
    """
    width = hours * 3600
    a = anchors.join(chunks.select(F.col("id").alias("chunk_id"), F.col("timestamp").alias("anchor_ts")), "chunk_id")
    a = a.join(clusters.select(F.col("id").alias("chunk_id"), F.col("cluster").alias("anchor_cluster")), "chunk_id")
    a = a.join(vectors.select(F.col("id").alias("chunk_id"), F.col("embedding").alias("anchor_vec")), "chunk_id", "left")
    own = a.groupBy("query_id").agg(F.collect_set("anchor_cluster").alias("own"), F.collect_set("chunk_id").alias("shown"))
    a = a.join(own, "query_id").withColumn(
        "bucket", F.explode(F.expr(f"sequence(anchor_ts div {width} - 1, anchor_ts div {width} + 1)")))
    c = chunks.where(associable()).select("id", "stream", "timestamp", F.expr(f"timestamp div {width}").alias("bucket"))
    c = c.join(clusters.select("id", "cluster"), "id").join(vectors.select("id", "embedding"), "id", "left")
    near = a.join(c, ["stream", "bucket"]).where(
        (F.abs(F.col("timestamp") - F.col("anchor_ts")) <= width)
        & ~F.array_contains("own", F.col("cluster")) & ~F.array_contains("shown", F.col("id")))
    # the cosine test is against every anchor, the time test against the near ones
    best = near.groupBy("query_id", "id", "cluster").agg(
        F.min(F.abs(F.col("timestamp") - F.col("anchor_ts"))).alias("delta"), F.first("embedding").alias("embedding"))
    all_anchors = a.select("query_id", "chunk_id", "anchor_vec").distinct()
    best = best.join(all_anchors, "query_id").withColumn(
        "cos", F.when(F.col("embedding").isNotNull() & F.col("anchor_vec").isNotNull(),
                      cosine(F.col("anchor_vec"), F.col("embedding"))))
    best = best.groupBy("query_id", "id", "cluster", "delta").agg(F.max("cos").alias("max_cos"))
    best = best.where(F.col("max_cos").isNull() | (F.col("max_cos") >= min_cos))
    best = best.withColumn("score", F.round(1 - F.col("delta") / width, 6))
    return top_n(best, ["query_id"], [F.desc("score"), F.col("id")], n)


def co_occurring(refs: DataFrame, chunks: DataFrame, hours: int, n: int) -> DataFrame:
    """Rows of the reference's session or within `hours` of it, same stream.

    `refs(query_id, id)`. The OR is a union of two equi joins made distinct.
    """
    width = max(1, hours * 3600)
    base = live(chunks).select("id", "stream", "timestamp", "dormant", F.col("source.session").alias("session"))
    r = refs.select("query_id", "id").join(base.drop("dormant"), "id").select(
        "query_id", F.col("id").alias("ref_id"), "stream", F.col("timestamp").alias("ref_ts"),
        F.col("session").alias("ref_session"))
    c = base.where("not dormant").drop("dormant")
    by_session = r.join(c, (r["stream"] == c["stream"]) & (r["ref_session"] == c["session"]))
    rb = r.withColumn("b", F.explode(F.expr(f"sequence(ref_ts div {width} - 1, ref_ts div {width} + 1)")))
    cb = c.withColumn("b", F.expr(f"timestamp div {width}"))
    by_time = rb.join(cb, (rb["stream"] == cb["stream"]) & (rb["b"] == cb["b"])
                      & (F.abs(cb["timestamp"] - rb["ref_ts"]) <= hours * 3600))
    cols = ["query_id", "ref_id", "ref_ts", "ref_session", "id", "timestamp", "session"]
    both = by_session.select(*cols).union(by_time.select(*cols)).where("id <> ref_id").distinct()
    both = both.withColumn("delta", F.col("timestamp") - F.col("ref_ts")).withColumn(
        "same_session", F.coalesce(F.col("session") == F.col("ref_session"), F.lit(False)))
    total = both.groupBy("query_id").agg(F.count("*").alias("total"))
    first = top_n(both, ["query_id"], [F.desc("same_session"), F.abs("delta"), F.col("id")], n)
    return first.join(total, "query_id").select("query_id", "id", "delta", "same_session", "rank", "total")


def gap_filled(events: DataFrame, seconds: int = 120) -> DataFrame:
    """Zero-result searches followed within `seconds` by a store of the stream."""
    s = events.where("type = 'search' and result_count = 0").withColumn(
        "b", F.explode(F.expr(f"array(sec div {seconds}, sec div {seconds} + 1)")))
    st = events.where("type = 'store'").select("stream", F.col("sec").alias("store_sec"), F.expr(f"sec div {seconds}").alias("b"))
    hit = (s["stream"] == st["stream"]) & (s["b"] == st["b"]) & (st["store_sec"] > s["sec"]) & (
        st["store_sec"] - s["sec"] <= seconds)
    return s.join(st, hit, "left_semi").drop("b").distinct()


def uncovered_groups(members: DataFrame, merged: DataFrame) -> DataFrame:
    """Groups no live merged row fully covers. `members(subject, id)`,
    `merged(subject, merged_id, source_ids)`."""
    size = members.groupBy("subject").agg(F.count("*").alias("n"))
    src = merged.select("subject", "merged_id", F.explode(F.array_distinct("source_ids")).alias("id"))
    covered = (members.join(src, ["subject", "id"]).groupBy("subject", "merged_id").agg(F.count("*").alias("have"))
               .join(size, "subject").where("have = n").select("subject").distinct())
    return size.join(covered, "subject", "left_anti")


def entity_stream_repair(entities: DataFrame, entity_chunk: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each entity's stream by its chunks: the one stream they share, else orphan or mixed."""
    seen = entity_chunk.join(chunks.select(F.col("id").alias("chunk_id"), F.col("stream").alias("cs")), "chunk_id").groupBy(
        "entity_id").agg(F.min("cs").alias("lo"), F.max("cs").alias("hi"))
    e = entities.join(seen, "entity_id", "left")
    return e.select(
        "entity_id", "stream",
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("stream")).alias("new_stream"),
        F.when(F.col("lo").isNull(), "orphan").when(F.col("lo") != F.col("hi"), "mixed")
        .when(F.col("lo") == F.col("stream"), "correct").otherwise("repaired").alias("category"))


def edge_stream_repair(edges: DataFrame, repaired: DataFrame) -> DataFrame:
    """An edge takes the stream its two ends agree on."""
    r = repaired.select("entity_id", "new_stream", "category")
    a = r.select(F.col("entity_id").alias("source"), F.col("new_stream").alias("ss"), F.col("category").alias("sc"))
    b = r.select(F.col("entity_id").alias("target"), F.col("new_stream").alias("ts"), F.col("category").alias("tc"))
    ok = F.col("sc").isin("correct", "repaired") & F.col("tc").isin("correct", "repaired")
    return edges.join(a, "source", "left").join(b, "target", "left").select(
        "source", "target",
        F.when(F.col("sc").isNull() | F.col("tc").isNull(), "dangling").when(~ok, "unresolved")
        .when(F.col("ss") != F.col("ts"), "cross_stream").otherwise("consistent").alias("category"))


def index_parity(index_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts of rows on both sides and of those whose id the other side lacks, as (metric, value) rows."""
    i, c = index_ids.select("id"), chunks.select("id")
    parts = [i.agg(F.count("*").alias("value")).select(F.lit("index_count").alias("metric"), "value"),
             c.agg(F.count("*").alias("value")).select(F.lit("table_count").alias("metric"), "value"),
             i.join(c, "id", "left_anti").agg(F.count("*").alias("value")).select(F.lit("only_in_index").alias("metric"), "value"),
             c.join(i, "id", "left_anti").agg(F.count("*").alias("value")).select(F.lit("only_in_table").alias("metric"), "value")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parity_report(index_ids: DataFrame, chunks: DataFrame, sample: int = 10) -> DataFrame:
    """One row: rows with ids on either side only, the drift in per cent of the table, whether both agree, and the first orphan ids as a sample."""
    sides = index_ids.select("id", F.lit(1).alias("i"), F.lit(0).alias("c")).union(chunks.select("id", F.lit(0), F.lit(1)))
    both = cut_lineage(sides.groupBy("id").agg(F.sum("i").alias("i"), F.sum("c").alias("c")))  # an id that comes twice counts twice
    none = lambda own, other: F.coalesce(F.sum(F.when(F.col(other) == 0, F.col(own))), F.lit(0))
    counts = both.agg(none("i", "c").alias("orphans"), none("c", "i").alias("missing"), F.coalesce(F.sum("c"), F.lit(0)).alias("table_count"))
    first = both.where("c = 0").select("id", "i").orderBy("id").limit(sample).agg(F.flatten(F.collect_list(F.expr("array_repeat(id, cast(i as int))"))).alias("ids"))
    first = first.select(F.array_join(F.slice(F.array_sort("ids"), 1, sample), ",").alias("orphan_sample"))
    drift = F.round(100.0 * (F.col("orphans") + F.col("missing")) / F.greatest("table_count", F.lit(1)), 6)
    return counts.crossJoin(first).select("orphans", "missing", drift.alias("drift_pct"), (F.col("orphans") + F.col("missing") == 0).alias("in_sync"), "orphan_sample")


def person_aliases(entities: DataFrame) -> DataFrame:
    """For each Person, the oldest Person of its stream whose name is a run of
    words of its own, or the other way round.

    No pairs are formed: the oldest bearer of every exact name and of every run
    of words is kept, and an entity looks up its runs in the first table and its
    whole name in the second. `entities(entity_id, entity_type, stream, name, created_at)`.
    """
    p = entities.where("entity_type = 'Person'").withColumn(
        "words", F.filter(F.split(F.lower(F.trim("name")), r"\s+"), lambda w: F.length(w) > 0)).where("size(words) > 0")
    p = p.withColumn("full", F.array_join("words", " ")).withColumn("who", F.struct("created_at", "entity_id"))
    runs = p.select("stream", "entity_id", "full", "who", F.explode(F.expr(
        "flatten(transform(sequence(1, size(words)), i -> transform(sequence(i, size(words)), j -> "
        "array_join(slice(words, i, j - i + 1), ' '))))")).alias("run")).distinct()
    exact = p.groupBy("stream", F.col("full").alias("run")).agg(F.min("who").alias("oldest"))
    holder = runs.groupBy("stream", F.col("run").alias("full")).agg(F.min("who").alias("oldest"))
    a = runs.join(exact, ["stream", "run"]).select("stream", "entity_id", "oldest")
    b = p.join(holder, ["stream", "full"]).select("stream", "entity_id", "oldest")
    best = a.union(b).groupBy("stream", "entity_id").agg(F.min("oldest").alias("o"))
    return best.where("o.entity_id <> entity_id").select("stream", "entity_id", F.col("o.entity_id").alias("alias_of"))


def version_roots(chunks: DataFrame) -> DataFrame:
    """(id, root_id, steps, cyclic): the start of every version chain.

    Pointers are doubled each round, so a chain of length L takes log2(L) joins.
    A pointer to a missing row ends the chain there. Rows still moving once a
    pass has seen every row lie on a cycle.
    """
    rows = chunks.select("id", F.col("supersedes_id").alias("up"))
    known = rows.select(F.col("id").alias("up"))
    cur = rows.join(known.withColumn("there", F.lit(True)), "up", "left").select(
        "id", F.when(F.col("there"), F.col("up")).alias("up"))
    cur = cut_lineage(cur.select("id", F.coalesce("up", "id").alias("at"),
                                 F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"),
                                 F.col("up").isNotNull().alias("moving")))
    n = max(1, cur.count())
    for _ in range(n.bit_length() + 1):
        if cur.where("moving").isEmpty():
            break
        nxt = cur.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("s2"),
                         F.col("moving").alias("m2"))
        done = cur.where("not moving")
        moved = cur.where("moving").drop("moving").join(nxt, "at").select(
            "id", F.col("at2").alias("at"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("m2").alias("moving"))
        cur = cut_lineage(done.unionByName(moved))
    return cur.select("id", F.when(~F.col("moving"), F.col("at")).alias("root_id"),
                      F.when(~F.col("moving"), F.col("steps")).alias("steps"), F.col("moving").alias("cyclic"))


def version_chain(starts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(start_id, id, pos): all rows of each start's chain from its root on, oldest first.

    Rows on a cycle, or leading into one, have no root: their chain is every row
    tied to the cycle, once, from its smallest id on. A position is counted once
    per chain, before chains meet their starts.
    """
    roots = cut_lineage(version_roots(chunks))
    loops = roots.where("cyclic").select("id")
    ties = chunks.select("id", F.col("supersedes_id").alias("up")).join(loops, "id").select(F.col("id").alias("a"), F.col("up").alias("b"))
    named = components(ties, loops.select(F.col("id").alias("node")))
    placed = roots.where("not cyclic").select("id", "root_id", "steps").unionByName(
        named.select(F.col("node").alias("id"), F.concat(F.lit("cycle:"), "root").alias("root_id"), F.lit(0).cast("long").alias("steps")))
    members = cut_lineage(spread_rank(placed, "root_id", [F.col("steps"), F.col("id")]))
    s = starts.select(F.col("id").alias("start_id")).join(members.select(F.col("id").alias("start_id"), "root_id"), "start_id")
    return s.join(members.select("root_id", "id", "pos"), "root_id").select("start_id", "id", "pos")


def outcomes_by_type(outcomes: DataFrame, advisories: DataFrame) -> DataFrame:
    """Outcome log with the advisory's type, `unknown` when it is gone."""
    return outcomes.join(advisories.select("advisory_id", "advisory_type"), "advisory_id", "left").fillna(
        "unknown", ["advisory_type"])


def backfill_valid_from(chunks: DataFrame, event_date: str = "event_date") -> DataFrame:
    """`valid_from` at midnight of the event date, with the outcome per row."""
    day = F.expr(f"unix_date(try_to_date({event_date}, 'yyyy-MM-dd'))").cast("long") * 86400
    out = F.when(F.col(event_date).isNull(), "no_date").when(day.isNull() | (day < 0), "unparseable").when(
        F.col("valid_from") == day, "already_correct").otherwise("updated")
    return chunks.withColumn("outcome", out).withColumn(
        "valid_from", F.when(F.col("outcome") == "updated", day).otherwise(F.col("valid_from")))
