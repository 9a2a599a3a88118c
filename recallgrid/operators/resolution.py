"""Which entity a name means, and the edges between entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .annotate import relation_label
from .components import components
from .links import person_aliases


def resolve(mentions: DataFrame) -> DataFrame:
    """(mention_id, entity_id) of `mentions(mention_id, stream, entity_type, name, created_at, chunk_id)`.

    Equal lower-cased names of a stream are one entity; Person names that are
    runs of each other's words merge. The id is a hash of stream, type and the
    oldest name, so a rerun gives the same ids.
    """
    m = mentions.withColumn("key", F.lower(F.trim("name"))).where("key <> ''")
    names = m.groupBy("stream", "entity_type", "key").agg(F.min("created_at").alias("created_at"), F.min("name").alias("name")).withColumn(
        "entity_id", F.md5(F.concat_ws("|", "stream", "entity_type", "key")))
    names = cut_lineage(names)
    alias = person_aliases(names.select("entity_id", "entity_type", "stream", F.col("key").alias("name"), "created_at"))
    comp = components(alias.select(F.col("entity_id").alias("a"), F.col("alias_of").alias("b")), names.select(F.col("entity_id").alias("node")))
    oldest = names.join(comp, F.col("entity_id") == F.col("node")).groupBy("root").agg(
        F.min_by(F.struct("entity_id", "name"), F.struct("created_at", "entity_id")).alias("o"))
    final = comp.join(oldest, "root").select(F.col("node").alias("name_id"), F.col("o.entity_id").alias("entity_id"), F.col("o.name").alias("canonical"))
    return m.drop("entity_id").withColumn("name_id", F.md5(F.concat_ws("|", "stream", "entity_type", "key"))).join(final, "name_id").select(
        "mention_id", "chunk_id", "stream", "entity_type", "name", "entity_id", "canonical")


def entity_table(resolved: DataFrame) -> DataFrame:
    """One row per entity with its aliases and evidence."""
    return resolved.groupBy("stream", "entity_id", "entity_type", "canonical").agg(
        F.sort_array(F.collect_set("name")).alias("aliases"), F.count_distinct("chunk_id").alias("n_chunks"))


def upsert_edges(known: DataFrame, found: DataFrame) -> DataFrame:
    """(stream, source, target, relation, chunk_id): evidence rows of every edge,
    old and new, the relation canonical, nothing twice. One row per piece of
    evidence keeps a hub edge from becoming one huge list. `known` rows are
    different already, so only the new ones are compared."""
    new = found.withColumn("relation", relation_label(F.col("relation")))
    cols = ["stream", "source", "target", "relation", "chunk_id"]
    return known.select(*cols).unionByName(new.select(*cols).distinct().join(known, cols, "left_anti"))


def edge_table(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("stream", "source", "target", "relation").agg(F.count("*").alias("evidence"))


def entity_cards(entities: DataFrame, entity_chunk: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per entity and neighbour: evidence count and `direction:relation:id`
    (null where there is none). Rows, not a list, so a hub stays spread."""
    n = entity_chunk.groupBy("entity_id").agg(F.count("*").alias("chunks"))
    out = edges.select(F.col("source").alias("entity_id"), F.concat_ws(":", F.lit("out"), "relation", "target").alias("link"))
    back = edges.select(F.col("target").alias("entity_id"), F.concat_ws(":", F.lit("in"), "relation", "source").alias("link"))
    links = out.unionByName(back).distinct()
    return entities.join(n, "entity_id", "left").join(links, "entity_id", "left").select(
        "entity_id", "name", "entity_type", F.coalesce("chunks", F.lit(0)).alias("chunks"), "link")


def without_chunks(evidence: DataFrame, entity_chunk: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge evidence, entity evidence) after `removed(chunk_id)` rows are gone.
    An entity left with none goes, and every edge at it."""
    ec = entity_chunk.join(removed, "chunk_id", "left_anti")
    alive = ec.select("entity_id").distinct()
    ev = evidence.join(removed, "chunk_id", "left_anti")
    ev = ev.join(alive.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(
        alive.withColumnRenamed("entity_id", "target"), "target", "left_semi")
    return ev, ec
