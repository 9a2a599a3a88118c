"""Jobs that keep the memory tables: each reads one snapshot and gives the next."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring
from ..operators import annotate, filters, merging, textjobs
from ..operators.ranking import spread_rank, top_n
from ..operators.similarity import nearest
from ..session import cut_lineage
from ..sources.chunk_store import consolidation_eligible, in_batches, live

DAY = 86400
MAX_CONTENT_BYTES = 102400
MAX_METADATA_BYTES = 10240


# ---- ingest --------------------------------------------------------------

def check_sizes(incoming: DataFrame, max_content: int = MAX_CONTENT_BYTES, max_metadata: int = MAX_METADATA_BYTES) -> DataFrame:
    """Adds `reject`: why a row is refused, or null."""
    return incoming.withColumn("reject", F.when(F.octet_length("content") > max_content, "content_too_large").when(
        F.octet_length("metadata") > max_metadata, "metadata_too_large").when(F.col("stream").isNull(), "no_stream"))


def prepare(incoming: DataFrame, now: int, blocklist: list[str] | None = None) -> DataFrame:
    """Accepted rows as chunk rows: cleaned, redacted, labelled, with defaults.

    One projection, so it runs the same over a table and over a stream.
    `incoming` has id, content, metadata, stream, agent.
    """
    clean, _ = textjobs.strip_html(F.col("content"))
    agent = F.coalesce("agent", F.lit("api"))
    made = incoming.withColumn("_body", textjobs.redact(clean, blocklist)).withColumn("_low", F.lower("content"))
    return made.select(
        "id", F.col("_body").alias("content"), textjobs.redact(F.col("metadata"), blocklist).alias("metadata"), "stream",
        F.lit(0).alias("level"), F.lit(1.0).alias("score"), F.lit(now).cast("long").alias("timestamp"),
        F.lit(now).cast("long").alias("valid_from"), F.lit(True).alias("is_latest"), F.lit(1).cast("long").alias("version"),
        F.size(textjobs.injection_flags(F.col("content"), F.col("_low"))).alias("injection_findings"),
        annotate.fact_type(F.col("_body")).alias("fact_type"), annotate.trust_level(agent).alias("trust_level"), agent.alias("agent"))


def ingest(incoming: DataFrame, new_vectors: DataFrame, known_vectors: DataFrame, now: int, blocklist: list[str] | None = None,
           max_content: int = MAX_CONTENT_BYTES, keep: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """(chunk rows with importance by surprise, rejects with the reason).

    `keep` are the columns of a row that are wanted, `id` among them (default: all);
    a row meets the vectors' results with these only.
    """
    checked = check_sizes(incoming, max_content)
    rows = prepare(checked.where("reject is null"), now, blocklist)
    rows = rows.select(*keep) if keep else rows
    near = nearest(new_vectors, known_vectors, 1, left_key="id", exclude_self=True).select("id", F.greatest(F.lit(0.0), F.col("sim")).alias("sim"))
    rows = rows.join(near, "id", "left").withColumn("importance", F.when(
        F.col("sim").isNotNull(), scoring.importance_from_surprise(1 - F.col("sim")))).drop("sim")
    return rows, checked.where("reject is not null").select("id", "stream", "reject")


# ---- versions ------------------------------------------------------------

def supersede(chunks: DataFrame, proposals: DataFrame, now: int, context: str = "contradiction") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks after, links of the new rows, blocked attempts).

    `proposals(new_id, old_id, new_trust)`. A new row closes an old one when its
    trust ranks no lower; of several for one old row the first by id does.
    """
    old = chunks.select(F.col("id").alias("old_id"), F.col("stream").alias("old_stream"), F.col("trust_level").alias("old_trust"),
                        F.col("version").alias("old_version"), F.coalesce("root_memory_id", "id").alias("root"))
    p = proposals.join(old, "old_id").withColumn(
        "allowed", annotate.trust_rank(F.col("new_trust")) >= annotate.trust_rank(F.col("old_trust")))
    first = top_n(p.where("allowed"), ["old_id"], [F.col("new_id")], 1)
    links = first.select("new_id", "old_id", F.col("root").alias("root_memory_id"), (F.col("old_version") + 1).alias("version"))
    closed = first.select(F.col("old_id").alias("id"), F.col("new_id").alias("closed_by"))
    after = chunks.join(closed, "id", "left").withColumn("is_latest", F.col("is_latest") & F.col("closed_by").isNull()).withColumn(
        "superseded_by", F.coalesce("closed_by", "superseded_by")).withColumn(
        "updated_at", F.when(F.col("closed_by").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))).drop("closed_by")
    blocked = p.where("not allowed").select("old_stream", "old_id", F.coalesce("old_trust", F.lit("a1")).alias("old_trust"), "new_id",
                                            F.coalesce("new_trust", F.lit("a1")).alias("new_trust"), F.lit(context).alias("context"))
    return after, links, blocked


def extend(chunks: DataFrame, proposals: DataFrame) -> DataFrame:
    """(new_id, root_memory_id): the new row joins the old row's chain."""
    roots = chunks.select(F.col("id").alias("old_id"), F.coalesce("root_memory_id", "id").alias("root_memory_id"))
    return proposals.join(roots, "old_id").select("new_id", "old_id", "root_memory_id")


def first_actionable(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """For each new row the best candidate labelled `updates` or `extends`.
    `candidates(new_id, id, rank)`, `labels(new_id, id, relation)`."""
    a = candidates.join(labels, ["new_id", "id"]).where("relation in ('updates', 'extends')")
    return top_n(a.select("new_id", "id", "relation", F.col("rank").alias("pos")), ["new_id"], [F.col("pos")], 1).select(
        "new_id", F.col("id").alias("old_id"), "relation")


# ---- consolidation -------------------------------------------------------

def topic_groups(batch: DataFrame, vectors: DataFrame, threshold: float = 0.20) -> DataFrame:
    """(stream, batch, id, grp): rows of a batch joined to the most similar running centroid.

    Each row depends on the ones before, so a batch is one task. Batches hold a
    fixed number of rows (`in_batches`); all batches of all streams run at once.
    Rows without a vector form group -1.
    """
    rows = batch.select("stream", "batch", "id", "timestamp").join(vectors.select("id", "embedding"), "id", "left")

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp", "id"])
        cents, sizes, out = [], [], []
        for e in pdf["embedding"]:
            if e is None:
                out.append(-1)
                continue
            v = np.asarray(e, dtype=np.float64)
            sims = [round(float(c @ v / (np.linalg.norm(c) * np.linalg.norm(v) or 1.0)), 9) for c in cents]
            g = int(np.argmax(sims)) if sims else -1
            if g >= 0 and sims[g] >= threshold:
                sizes[g] += 1
                cents[g] = (cents[g] * (sizes[g] - 1) + v) / sizes[g]
            else:
                g = len(cents)
                cents.append(v)
                sizes.append(1)
            out.append(g)
        return pd.DataFrame({"stream": pdf["stream"], "batch": pdf["batch"], "id": pdf["id"], "grp": np.asarray(out, dtype=np.int32)})

    return rows.groupBy("stream", "batch").applyInPandas(lead, "stream string, batch long, id string, grp int")


def consolidate(chunks: DataFrame, vectors: DataFrame, now: int, *, min_rows: int = 3, batch: int = 200, threshold: float = 0.20,
                compressor=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged rows, chunks with their sources marked, report).

    `compressor` turns a text column into its summary; by default the first
    three sentences and the last.
    """
    slim = chunks.select("id", "stream", "timestamp", "level", "consolidated", "in_progress", "dormant", "deleted_at")  # texts join after the grouping
    groups = cut_lineage(topic_groups(in_batches(consolidation_eligible(slim, now), batch), vectors, threshold))
    sized = groups.withColumn("n", F.count("*").over(Window.partitionBy("stream", "batch", "grp")))
    used = sized.where(F.col("n") >= min_rows)
    text = used.join(chunks.select("id", "timestamp", "content"), "id")
    s = F.sort_array(F.collect_list(F.struct("timestamp", "id", "content")))
    g = text.groupBy("stream", "batch", "grp").agg(s.alias("s"), F.min("timestamp").alias("valid_from"), F.max("timestamp").alias("valid_until"))
    ids = F.transform("s", lambda x: x["id"])
    joined = F.array_join(F.transform("s", lambda x: x["content"]), "\n")
    body = textjobs.redact(joined)
    merged = g.select(
        F.concat(F.lit("L1:"), F.md5(F.concat_ws("|", F.lit("g"), "stream", F.array_join(ids, ",")))).alias("id"),
        (compressor or textjobs.compress)(body).alias("content"), "stream", F.lit(1).alias("level"), F.lit(1.0).alias("score"),
        F.lit(now).cast("long").alias("timestamp"), "valid_from", "valid_until", ids.alias("source_ids"))
    done = used.select("id", F.lit(True).alias("taken"))
    after = chunks.join(done, "id", "left").withColumn("consolidated", F.col("consolidated") | F.coalesce("taken", F.lit(False))).drop("taken")
    report = sized.agg(F.count_if(F.col("n") >= min_rows).alias("consolidated"), F.count_if(F.col("n") < min_rows).alias("skipped"))
    return merged, after, report


def quality_gate(merged: DataFrame, merged_vectors: DataFrame, vectors: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(id, mean_sim, passed): mean cosine of a merged row's vector to its sources'.
    A row with nothing to compare passes. `merged` has id and source_ids."""
    from ..functions.vectors import cosine
    pairs = merged.select("id", F.explode("source_ids").alias("src")).join(
        merged_vectors.select("id", F.col("embedding").alias("mv")), "id").join(
        vectors.select(F.col("id").alias("src"), F.col("embedding").alias("sv")), "src")
    m = pairs.groupBy("id").agg(F.round(F.avg(cosine(F.col("mv"), F.col("sv"))), 9).alias("mean_sim"))
    return merged.select("id").join(m, "id", "left").withColumn("passed", F.coalesce(F.col("mean_sim") >= threshold, F.lit(True)))


def subject_groups(chunks: DataFrame, at_least: int = 2) -> DataFrame:
    """Latest rows with a subject, numbered oldest first within (stream, subject)."""
    c = live(chunks).where("is_latest and meta.subject is not null").select(
        "stream", F.lower("meta.subject").alias("subject"), "id", "timestamp", "meta.event_date", "content")
    n = c.groupBy("stream", "subject").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    g = c.join(n, ["stream", "subject"])
    # a subject with very many rows is numbered in ranges, without its texts
    pos = spread_rank(g.select("id", "timestamp", F.struct("stream", "subject").alias("of")), "of", [F.col("timestamp"), F.col("id")])
    g = g.join(pos.select("id", "pos"), "id")
    return g.withColumn("line", F.format_string("%d. [%s] [id:%s] %s", "pos", F.coalesce("event_date", F.lit("unknown date")), "id", "content"))


MERGE_REPLY = "merged_fact string, fact_type string, contradictions array<struct<old_uuid:string,reason:string>>"


def apply_merges(chunks: DataFrame, replies: DataFrame, groups: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged rows, chunks after, blocked): `replies(stream, subject, reply)` applied.

    The merged row is persistent and trusted `a2`; contradicted latest rows of the
    stream are closed unless they are trusted more. `groups` is `subject_groups`.
    """
    r = replies.withColumn("r", F.from_json("reply", MERGE_REPLY)).where("r.merged_fact is not null").select("stream", "subject", "r.*").withColumn(
        "id", F.concat(F.lit("dream:"), F.md5(F.concat_ws("|", "stream", "subject"))))
    src = groups.groupBy("stream", "subject").agg(F.sort_array(F.collect_list("id")).alias("source_ids"))
    kind = F.when(F.col("fact_type").isin("preference_or_decision", "project_state", "experience"), F.col("fact_type")).otherwise("fact")
    merged = r.join(src, ["stream", "subject"]).select(
        "id", F.col("merged_fact").alias("content"), "stream", "subject", F.lit(1).alias("level"), F.lit(1.0).alias("score"),
        F.lit(now).cast("long").alias("timestamp"), "source_ids", kind.alias("fact_type"), F.lit(True).alias("persistent"), F.lit("a2").alias("trust_level"))
    c = r.select("stream", F.col("id").alias("new_id"), F.explode("contradictions.old_uuid").alias("old_id"))
    ok = chunks.where("is_latest").select(F.col("id").alias("old_id"), "stream")
    after, links, blocked = supersede(chunks, c.join(ok, ["old_id", "stream"]).select("new_id", "old_id", F.lit("a2").alias("new_trust")), now, "merge")
    closed = links.select(F.col("old_id").alias("id"), F.lit(True).alias("shut"))
    after = after.join(closed, "id", "left").withColumn("valid_until", F.when(F.col("shut"), F.lit(now)).otherwise(F.col("valid_until"))).drop("shut")
    return merged, after, blocked


# ---- decay and removal ---------------------------------------------------

def decay(chunks: DataFrame, now: int, *, l0: float = 0.990, l1: float = 0.995, dormant_below: float = 0.01, dampening: float = 0.5,
          cap: int = 200, promote_at: int = 50) -> DataFrame:
    """Snapshot after one decay run, with `outcome` per row."""
    base = F.when(F.col("level") == 0, F.lit(l0)).otherwise(F.lit(l1))
    eased = F.least(F.lit(0.9999), base + dampening * (F.least(F.col("access_count"), F.lit(cap)) / cap) * (1 - base))
    hours = F.greatest(F.lit(0), F.lit(now) - F.coalesce("last_decay", "timestamp")) / 3600
    new = F.round(F.col("score") * F.pow(F.when(F.col("access_count") > 0, eased).otherwise(base), hours), 9)
    out = F.when(~filters.decay_eligible(dormant_below), "skipped").when(F.col("persistent"), "persistent").when(
        F.col("access_count") >= promote_at, "promoted").when(new < dormant_below, "dormant").otherwise("decayed")
    c = chunks.withColumn("new_score", new).withColumn("outcome", out)
    return (c.withColumn("score", F.when(F.col("outcome") == "decayed", F.col("new_score")).otherwise(F.col("score")))
            .withColumn("last_decay", F.when(F.col("outcome") == "decayed", F.lit(now)).otherwise(F.col("last_decay")))
            .withColumn("dormant", F.col("dormant") | (F.col("outcome") == "dormant"))
            .withColumn("persistent", F.col("persistent") | (F.col("outcome") == "promoted")).drop("new_score"))


def soft_delete(tables: dict[str, DataFrame], ids: DataFrame, now: int) -> dict[str, DataFrame]:
    """Marks rows deleted and drops their postings, vectors and graph references.
    Rows deleted before keep their date. `tables`: chunks, postings, vectors, entity_chunk."""
    gone = ids.select("id").distinct()
    mark = gone.withColumn("hit", F.lit(True))
    out = dict(tables)
    out["chunks"] = tables["chunks"].join(mark, "id", "left").withColumn(
        "deleted_at", F.coalesce("deleted_at", F.when(F.col("hit"), F.lit(now).cast("long")))).drop("hit")
    out["postings"] = tables["postings"].join(gone, "id", "left_anti")
    out["vectors"] = tables["vectors"].join(gone, "id", "left_anti")
    out["entity_chunk"] = tables["entity_chunk"].join(gone.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_anti")
    return out


def purge(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Removes rows from every table for good."""
    gone = ids.select("id").distinct()
    return {name: df.join(gone.withColumnRenamed("id", key), key, "left_anti")
            for name, df in tables.items() for key in ["chunk_id" if "chunk_id" in df.columns else "id"]}


def residue(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(surface, n): what is left of purged rows; every count must be 0."""
    out = None
    for name, df in sorted(tables.items()):
        key = "chunk_id" if "chunk_id" in df.columns else "id"
        n = df.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("surface"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def expired_ids(chunks: DataFrame, now: int, days: int = 30) -> DataFrame:
    return chunks.where(filters.expired(now, days)).select("id")


def namespace_ids(chunks: DataFrame, stream: str) -> DataFrame:
    """Rows of a namespace; looking at them is the dry run of purging it."""
    return chunks.where(F.col("stream") == stream).select("id")


def reset_importance(chunks: DataFrame) -> tuple[DataFrame, Column]:
    """(snapshot, condition counting the rows it changed)."""
    hit = F.col("importance").isNotNull() | F.col("last_implicit_boost").isNotNull()
    return chunks.withColumn("importance", F.lit(None).cast("double")).withColumn("last_implicit_boost", F.lit(None).cast("long")), hit


def set_flag(chunks: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """Sets a boolean column on the named rows."""
    m = ids.select("id").distinct().withColumn("hit", F.lit(True))
    return chunks.join(m, "id", "left").withColumn(flag, F.col(flag) | F.coalesce("hit", F.lit(False))).drop("hit")


def set_tier(chunks: DataFrame, tiers: DataFrame) -> DataFrame:
    """`tiers(id, tier)` written into metadata, other keys kept."""
    t = tiers.select("id", F.col("tier").alias("new_tier"))
    m = F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>")
    put = F.to_json(F.map_concat(F.map_filter(m, lambda k, v: k != "tier"), F.create_map(F.lit("tier"), F.col("new_tier"))))
    return chunks.join(t, "id", "left").withColumn("metadata", F.when(F.col("new_tier").isNotNull(), put).otherwise(F.col("metadata"))).drop("new_tier")


def recover_stuck(chunks: DataFrame) -> DataFrame:
    """Live rows a job left in progress are free again."""
    return chunks.withColumn("in_progress", F.col("in_progress") & F.col("deleted_at").isNotNull())


# ---- reprocessing and ratings --------------------------------------------

def reprocess_actions(top: DataFrame, labels: DataFrame, threshold: float, screen: float = 0.5) -> DataFrame:
    """(new_id, action, old_id): skip a near copy of the same subject, supersede or
    extend where the label says so, else store.

    `top` is the nearest stored row per new row: new_id, id, sim, subject,
    old_subject, fact_type; id is null where there is none.
    """
    t = top.join(labels, ["new_id", "id"], "left")
    same = F.coalesce(F.lower("subject") == F.lower("old_subject"), F.lit(False))
    judged = (F.col("fact_type") != "fact") & (F.col("sim") >= screen)
    act = F.when(F.col("id").isNull(), "store").when(same & (F.col("sim") >= threshold), "skip").when(
        judged & (F.col("relation") == "updates"), "supersede").when(judged & (F.col("relation") == "extends"), "extend").otherwise("store")
    return t.select("new_id", act.alias("action"), F.when(act.isin("skip", "supersede", "extend"), F.col("id")).alias("old_id"))


def mark_reprocessed(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Sources of a reprocessing: another agent name, importance times .3."""
    m = ids.select("id").distinct().withColumn("hit", F.lit(True))
    c = chunks.join(m, "id", "left")
    tag = F.struct(F.lit("legacy-raw").alias("agent"), F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("channel"))
    return (c.withColumn("importance", F.when(F.col("hit"), F.round(F.coalesce("importance", F.lit(1.0)) * 0.3, 6)).otherwise(F.col("importance")))
            .withColumn("source", F.when(F.col("hit"), tag).otherwise(F.col("source"))).drop("hit"))


def apply_ratings(chunks: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with tallies, accepted events, rejected with reason).
    `ratings` has chunk_id, stream, usefulness, harmful, justification, rated_at."""
    known = chunks.select(F.col("id").alias("chunk_id"), F.col("stream").alias("chunk_stream"))
    r = ratings.join(known, "chunk_id", "left").withColumn("reason", F.when(~merging.valid_rating(), "invalid").when(
        F.col("chunk_stream").isNull() | (F.col("chunk_stream") != F.col("stream")), "not_found_in_stream"))
    good = r.where("reason is null").drop("reason", "chunk_stream")
    tally, _ = merging.beta_tally(good)
    t = tally.select(F.col("chunk_id").alias("id"), (F.col("alpha") - 1).alias("da"), (F.col("beta") - 1).alias("db"),
                     F.col("n_ratings").alias("dn"), F.col("harmful_count").alias("dh"))
    c = chunks.join(t, "id", "left")
    for col, d in (("alpha", "da"), ("beta", "db"), ("n_ratings", "dn"), ("harmful_count", "dh")):
        c = c.withColumn(col, F.col(col) + F.coalesce(d, F.lit(0)))
    return c.drop("da", "db", "dn", "dh"), good, r.where("reason is not null").drop("chunk_stream")
