"""Cosine k-means of every stream at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import dot
from ..session import cut_lineage
from .ranking import spread_rank

# Centroids up to this many numbers are sent to every task (64 MB of doubles).
MAX_BROADCAST_NUMBERS = 8 << 20


def _seeds(rows: DataFrame, k_max: int) -> DataFrame:
    """Initial centroids: every n/k-th row of a stream in id order."""
    n = rows.groupBy("stream").agg(F.count("*").alias("n")).where("n >= 3")
    k = F.least(F.col("n"), F.greatest(F.lit(2), F.least(F.lit(k_max), F.ceil(F.sqrt(F.col("n") / 2))))).cast("int")
    n = n.withColumn("k", k).withColumn("step", F.expr("greatest(1, n div k)"))
    pos = spread_rank(rows.select("stream", "id"), "stream", [F.col("id")]).withColumn("pos", F.col("pos") - 1).join(n, "stream")
    picked = pos.where((F.col("pos") % F.col("step") == 0) & (F.expr("pos div step") < F.col("k"))).select(
        "stream", "id", F.expr("cast(pos div step as int)").alias("cluster"))
    return rows.join(picked, ["stream", "id"]).select("stream", "cluster", F.col("embedding").cast("array<double>").alias("centroid"))


def _assign_broadcast(rows: DataFrame, cents: pd.DataFrame) -> DataFrame:
    def unit(values) -> np.ndarray:
        m = np.vstack(values).astype(np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    # stream → its cluster numbers and, by vector length, which of them have it and their unit centroids
    table = {}
    for stream, part in cents.sort_values("cluster").groupby("stream"):
        dims = part["centroid"].map(len).to_numpy()
        table[stream] = (part["cluster"].to_numpy(), {d: (np.flatnonzero(dims == d), unit(part["centroid"].to_numpy()[dims == d])) for d in np.unique(dims)})
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.full(len(pdf), -1, dtype=np.int32)
            for stream, ix in pdf.groupby("stream").indices.items():
                if stream not in shared.value:
                    continue
                ids, by_length = shared.value[stream]
                rows_ = pdf["embedding"].to_numpy()[ix]
                dims = np.array([len(v) for v in rows_])
                for d in np.unique(dims):
                    sims = np.zeros((int((dims == d).sum()), len(ids)))
                    if d in by_length:
                        at, m = by_length[d]
                        sims[:, at] = np.round(unit(rows_[dims == d]) @ m.T, 9)
                    out[ix[dims == d]] = ids[np.argmax(sims, axis=1)]
            keep = out >= 0
            yield pd.DataFrame({"stream": pdf["stream"][keep], "id": pdf["id"][keep], "cluster": out[keep]})

    return rows.mapInPandas(nearest, "stream string, id string, cluster int")


def assign(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(stream, id, cluster): most similar centroid of the row's stream, smallest number on ties."""
    size = centroids.agg(F.sum(F.size("centroid"))).head()[0] or 0
    if size <= MAX_BROADCAST_NUMBERS:
        return _assign_broadcast(rows, centroids.toPandas())
    c = centroids.withColumn("cn", F.sqrt(dot(F.col("centroid"), F.col("centroid"))))
    both = F.col("cn") * F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    # the cosine, to 9 places, as in the other path; rows and centroids of another length are as far as can be
    cosine = F.when((both > 0) & (F.size("embedding") == F.size("centroid")), dot(F.col("embedding"), F.col("centroid")) / both).otherwise(0.0)
    s = rows.join(c, "stream").withColumn("s", F.round(cosine, 9))
    return s.groupBy("stream", "id").agg(F.max_by("cluster", F.struct("s", -F.col("cluster"))).alias("cluster"))


def centroids_of(rows: DataFrame, assigned: DataFrame, before: DataFrame) -> DataFrame:
    """Unit mean of every cluster's rows; a cluster left empty keeps its centroid."""
    m = rows.join(assigned, ["stream", "id"]).select("stream", "cluster", F.posexplode("embedding").alias("pos", "v"))
    m = m.groupBy("stream", "cluster", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    m = m.groupBy("stream", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    n = F.sqrt(dot(F.col("c"), F.col("c")))
    m = m.select("stream", "cluster", F.when(n > 0, F.transform("c", lambda v: v / n)).otherwise(F.col("c")).alias("new"))
    return before.join(m, ["stream", "cluster"], "left").select("stream", "cluster", F.coalesce("new", "centroid").alias("centroid"))


def cluster_streams(vectors: DataFrame, chunks: DataFrame, max_clusters: int = 50, max_iterations: int = 100) -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids) keyed by stream and cluster.

    k is the root of half the stream's rows, 2 to `max_clusters`; streams under
    three rows are skipped. Rounds stop when no row moves. Every round is one
    pass over the vectors, whichever stream they belong to.
    """
    live = chunks.where("is_latest and deleted_at is null").select("id", "stream")
    rows = cut_lineage(vectors.select("id", "embedding").join(live, "id"))
    cents = cut_lineage(_seeds(rows, max_clusters))
    rows = rows.join(cents.select("stream").distinct(), "stream", "left_semi")
    assigned = None
    for _ in range(max_iterations):
        nxt = cut_lineage(assign(rows, cents))
        if assigned is not None:
            moved = nxt.join(assigned.withColumnRenamed("cluster", "was"), ["stream", "id"]).where("cluster <> was")
            if moved.isEmpty():
                break
        assigned = nxt
        cents = cut_lineage(centroids_of(rows, assigned, cents))
    return assigned, cents
