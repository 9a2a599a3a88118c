"""Rows a query did not ask for: serendipity, adjacent clusters, walks, latents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import cosine, mean_vector_parts
from ..session import cut_lineage
from .filters import associable
from .graph import symmetric
from .ranking import spread_sums, top_n
from .similarity import nearest


def query_cluster(query_vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(query_id, qcluster): the cluster whose centroid is nearest, smallest number on ties.
    With a `stream` on both sides only that stream's clusters are looked at."""
    on = ["stream"] if "stream" in query_vectors.columns and "stream" in centroids.columns else []
    best = nearest(query_vectors, centroids.withColumnRenamed("centroid", "embedding"), 1, right_key="cluster", on=on)
    return best.select("query_id", F.col("cluster").alias("qcluster"))


def centroid_distances(pairs: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds `distance` to rows with `cluster` and `qcluster`: 0 for the same, .5 for unknown ones."""
    a = centroids.select("cluster", F.col("centroid").alias("ca"))
    b = centroids.select(F.col("cluster").alias("qcluster"), F.col("centroid").alias("cb"))
    keys = pairs.select("cluster", "qcluster").distinct().join(a, "cluster", "left").join(b, "qcluster", "left")
    d = F.when(F.col("cluster") == F.col("qcluster"), 0.0).when(F.col("ca").isNull() | F.col("cb").isNull(), 0.5).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - cosine(F.col("ca"), F.col("cb")))))
    return pairs.join(keys.select("cluster", "qcluster", d.alias("distance")), ["cluster", "qcluster"])


def serendipity(candidates: DataFrame, query_vectors: DataFrame, context: DataFrame, vectors: DataFrame, clusters: DataFrame,
                centroids: DataFrame) -> DataFrame:
    """(query_id, id, relevance, obviousness, distance, score) of `candidates(query_id, id)`.

    Relevance is the best cosine to a context vector, obviousness the cosine to
    the query; a candidate of the query's own cluster scores 0.
    """
    c = candidates.select("query_id", "id").distinct().join(vectors.select("id", "embedding"), "id").join(clusters.select("id", "cluster"), "id", "left")
    c = c.join(query_vectors.select("query_id", F.col("embedding").alias("qv")), "query_id").join(query_cluster(query_vectors, centroids), "query_id")
    c = c.withColumn("obviousness", F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("qv")))).drop("qv")
    r = c.join(context.select("query_id", F.col("embedding").alias("cv")), "query_id").withColumn("r", cosine(F.col("embedding"), F.col("cv")))
    r = r.groupBy("query_id", "id", "cluster", "qcluster", "obviousness").agg(F.greatest(F.lit(0.0), F.max("r")).alias("relevance"))
    r = centroid_distances(r.fillna(-1, ["cluster"]), centroids)
    return r.withColumn("score", F.round(F.col("relevance") * (1 - F.col("obviousness")) * F.col("distance"), 6))


def context_centroid(context: DataFrame) -> DataFrame:
    return mean_vector_parts(context.select("query_id", "embedding"), ["query_id"])


def adjacent_possible(query_vectors: DataFrame, context: DataFrame, chunks: DataFrame, vectors: DataFrame, clusters: DataFrame,
                      centroids: DataFrame, n: int, relevance_min: float = 0.3, obviousness_max: float = 0.6, near: int = 5,
                      cluster_min: float = 0.2) -> DataFrame:
    """Rows of the clusters next to a query's context that are relevant and not obvious.

    `query_vectors(query_id, stream, embedding)`; only rows of the query's stream.
    """
    mean = context_centroid(context)
    qc = query_cluster(query_vectors.drop("stream"), centroids)
    # one more than needed, as the query's own cluster is left out
    around = nearest(mean.withColumnRenamed("centroid", "embedding"), centroids.withColumnRenamed("centroid", "embedding"), near + 1, right_key="cluster")
    around = around.join(qc, "query_id").where((F.col("cluster") != F.col("qcluster")) & (F.col("sim") > cluster_min))
    close = top_n(around.select("query_id", "cluster", "sim"), ["query_id"], [F.desc("sim"), F.col("cluster")], near).select("query_id", "cluster")
    rows = chunks.where(associable()).select("id", "stream").join(clusters.select("id", "cluster"), "id").join(vectors.select("id", "embedding"), "id")
    q = query_vectors.select("query_id", "stream", F.col("embedding").alias("qv")).join(close, "query_id").join(mean, "query_id")
    c = q.join(rows, ["stream", "cluster"]).withColumn("relevance", cosine(F.col("embedding"), F.col("centroid"))).withColumn(
        "obviousness", cosine(F.col("embedding"), F.col("qv")))
    c = c.where((F.col("relevance") >= relevance_min) & (F.col("obviousness") <= obviousness_max)).withColumn(
        "score", F.round(F.col("relevance") * (1 - F.col("obviousness")), 6))
    return top_n(c.select("query_id", "id", "cluster", "relevance", "obviousness", "score"), ["query_id"], [F.desc("score"), F.col("id")], n)


#: Neighbours of a node in one block: what a draw reads of a hub.
DRAW_BLOCK = 1024


def weak_tie_walks(seeds: DataFrame, edges: DataFrame, hops: int = 3, walks: int = 2, most_hops: int = 20) -> DataFrame:
    """(query_id, seed, walk, terminal, hops): all walks of all seeds, one round per hop.

    A step goes to an unvisited neighbour with chance inverse to the edge's
    evidence; a fixed hash of the step number draws, over neighbours in id order.
    `seeds(query_id, entity_id)`, `edges` with `evidence`.

    A hop sums the weights of the neighbours of the nodes that walks stand on,
    hubs in ranges, in id order. A draw then finds its block by the sums at the
    blocks' ends, and its neighbour in that block only; neighbours visited before
    are taken off both. So a walk reads one block of a hub, not its edges.
    """
    sym = symmetric(edges).groupBy("node", "other").agg(F.min("evidence").alias("evidence")).select(
        "node", "other", (F.lit(1.0) / F.greatest(F.lit(1), F.col("evidence"))).alias("weight"))
    sym = cut_lineage(sym)  # read once per hop
    walk = ["query_id", "seed", "walk"]
    cur = seeds.select("query_id", F.col("entity_id").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    cur = cut_lineage(cur.withColumn("at", F.col("seed")).withColumn("path", F.array("seed")).withColumn("done", F.lit(0)))
    for hop in range(1, hops + 1):
        step = F.col("walk") * hops + hop
        draw = F.pmod((F.col("walk") + step).cast("long") * 2654435761, F.lit(1000)) / 1000.0
        live = cur.where((step <= most_hops) & (F.col("done") == hop - 1))
        near = sym.join(live.select(F.col("at").alias("node")).distinct(), "node", "left_semi")
        near = spread_sums(near, "node", [F.col("other")], {"cum": F.col("weight")})
        near = cut_lineage(near.withColumn("block", F.floor((F.col("pos") - 1) / DRAW_BLOCK)).drop("pos"))
        blocks = near.groupBy("node", "block").agg(F.max("cum").alias("upto"), F.max("other").alias("last"), F.count("*").alias("n"))
        total = blocks.groupBy("node").agg(F.max("upto").alias("total"))
        seen = live.select(*walk, F.col("at").alias("node"), F.explode("path").alias("other")).join(near, ["node", "other"]).groupBy(*walk).agg(
            F.collect_list(F.struct("other", "weight", "block")).alias("seen"))  # as long as a path at most
        none = F.array().cast("array<struct<other:string,weight:double,block:bigint>>")
        asked = live.join(seen, walk, "left").withColumn("seen", F.coalesce("seen", none)).join(total, F.col("at") == F.col("node")).drop("node")

        def off(keep: Callable[[Column], Column]) -> Column:
            """Weight of the visited neighbours for which `keep` holds."""
            return F.aggregate(F.filter("seen", keep), F.lit(0.0), lambda s, v: s + v["weight"])

        asked = cut_lineage(asked.withColumn("goal", F.round(draw * (F.col("total") - off(lambda v: F.lit(True))), 9)))
        left = F.col("n") - F.size(F.filter("seen", lambda v: v["block"] == F.col("block")))
        reach = F.round(F.col("upto") - off(lambda v: v["other"] <= F.col("last")), 9) >= F.col("goal")
        block = asked.join(blocks, F.col("at") == F.col("node")).where((left > 0) & reach).groupBy(*walk).agg(F.min("block").alias("block"))
        there = asked.join(block, walk).join(near.withColumnRenamed("node", "at"), ["at", "block"]).where(~F.array_contains("path", F.col("other")))
        chosen = there.where(F.round(F.col("cum") - off(lambda v: v["other"] <= F.col("other")), 9) >= F.col("goal")).groupBy(*walk).agg(F.min("other").alias("to"))
        cur = cut_lineage(cur.join(chosen, walk, "left").select(
            *walk, F.coalesce("to", "at").alias("at"),
            F.when(F.col("to").isNotNull(), F.concat("path", F.array("to"))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("to").isNotNull(), hop).otherwise(F.col("done")).alias("done")))
    return cur.select(*walk, F.col("at").alias("terminal"), F.col("done").alias("hops"))


def discover_latents(chunks: DataFrame, vectors: DataFrame, clusters: DataFrame, centroids: DataFrame, edges: DataFrame,
                     entity_chunk: DataFrame, min_score: float = 0.1, most_seeds: int = 10, per_chunk: int = 3) -> DataFrame:
    """New (stream, source, target, score): from a seed row per cluster along its
    entities to rows of other clusters.

    Seeds are the first row of each (stream, cluster) by hash, `most_seeds` per
    stream; `per_chunk` entities of a seed are walked from.
    """
    ok = chunks.where("is_latest and deleted_at is null").select("id", "stream").join(clusters.select("id", "cluster"), "id").join(
        entity_chunk.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
    first = top_n(ok, ["stream", "cluster"], [F.md5("id"), F.col("id")], 1).drop("rank")
    seeds = top_n(first, ["stream"], [F.col("cluster")], most_seeds).drop("rank")
    ent = entity_chunk.select(F.col("chunk_id").alias("id"), "entity_id")
    starts = top_n(seeds.join(ent, "id"), ["id"], [F.col("entity_id")], per_chunk)
    walks = weak_tie_walks(starts.select(F.col("id").alias("query_id"), "entity_id"), edges)
    hit = walks.join(entity_chunk, F.col("terminal") == F.col("entity_id")).select(F.col("query_id").alias("source"), F.col("chunk_id").alias("target")).distinct()
    src = seeds.select(F.col("id").alias("source"), "stream", F.col("cluster").alias("qcluster"))
    # a row of no cluster counts as one of cluster 0
    tgt = chunks.where(associable()).select(F.col("id").alias("target"), "stream").join(
        clusters.select(F.col("id").alias("target"), "cluster"), "target", "left").fillna(0, ["cluster"])
    c = hit.join(src, "source").join(tgt, ["target", "stream"]).where("source <> target and cluster <> qcluster")
    c = c.join(vectors.select(F.col("id").alias("source"), F.col("embedding").alias("sv")), "source").join(
        vectors.select(F.col("id").alias("target"), F.col("embedding").alias("tv")), "target")
    c = c.withColumn("r", F.greatest(F.lit(0.0), cosine(F.col("sv"), F.col("tv"))))
    c = centroid_distances(c.drop("sv", "tv"), centroids)
    c = c.withColumn("score", F.round(F.col("r") * (1 - F.col("r")) * F.col("distance"), 6)).where(F.col("score") >= min_score)
    # a target is found once per stream, by its best source
    return top_n(c.select("stream", "source", "target", "score"), ["stream", "target"], [F.desc("score"), F.col("source")], 1).drop("rank")


def latent_candidates(latents: DataFrame, query_vectors: DataFrame, vectors: DataFrame, n: int = 50, min_sim: float = 0.4) -> DataFrame:
    """Targets of a stream's newest latents close to the query: score times similarity."""
    newest = top_n(latents, ["stream"], [F.desc("sec"), F.desc("event_id")], n).drop("rank")
    c = newest.join(vectors.select(F.col("id").alias("target"), "embedding"), "target").join(
        query_vectors.select("query_id", "stream", F.col("embedding").alias("qv")), "stream")
    c = c.withColumn("sim", cosine(F.col("embedding"), F.col("qv"))).where(F.col("sim") > min_sim)
    return c.groupBy("query_id", F.col("target").alias("id")).agg(F.round(F.max(F.col("score") * F.col("sim")), 6).alias("score"))
