"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Rounds, drop_folder


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): smallest node id each node is connected to.

    Every round a node takes the smallest root among itself and its neighbours,
    then the root of its root, so long chains collapse quickly. Roots only get
    smaller, so the rounds end; they go on until no root changes.
    """
    spark = pairs.sparkSession
    links, rounds = Rounds(spark, "links"), Rounds(spark, "components")
    e = links.keep(pairs.selectExpr("a", "b").union(pairs.selectExpr("b as a", "a as b")).distinct())
    cur = rounds.keep(nodes.select("node", F.col("node").alias("was"), F.col("node").alias("root")))
    while True:
        seen = e.join(cur.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = cur.join(seen, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("r", "root")).alias("root"))
        # only roots that have another root themselves are looked up, so a root of many nodes, done, is not a key of this join
        jump = step.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("rr"))
        cur, moved = rounds.keep_counting(step.join(jump, "root", "left").select("node", "was", F.coalesce("rr", "root").alias("root")), F.col("was") != F.col("root"))
        if not moved:
            drop_folder(spark, links.folder)
            return cur.select("node", "root")
