"""Entity dictionaries: TOML files or tables of aliases."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def first_alias_wins(aliases: DataFrame) -> DataFrame:
    """(alias, name, entity_type, seq): the first definition of an alias stays."""
    w = Window.partitionBy("alias").orderBy("seq", "name")
    return aliases.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_dictionary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A hand-kept TOML file as `alias`, `relation`, `synonym`, `role` and `expansion` tables.

    Lists under a type name are plain entities, `[[entity]]` blocks carry
    aliases, a role and words that a question about them is expanded with,
    `relations` holds `subject|relation|object` lines and `groups` lists of synonyms.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    doc = tomllib.loads(text)
    alias, relation, synonym, role, expansion = [], [], [], [], []
    for kind, value in doc.items():
        if kind == "relations":
            relation += [tuple(p.strip() for p in line.split("|")) for line in value if line.count("|") == 2]
        elif kind == "groups":
            synonym += [(g, t.lower()) for g, terms in enumerate(value) for t in terms]
        elif kind == "entity":
            for e in value:
                if e.get("role"):
                    role.append((e["canonical"], e["role"]))
                expansion += [(e["canonical"], w) for w in e.get("expand_with", [])]
                for a in [e["canonical"], *e.get("aliases", [])]:
                    alias.append((a.lower(), e["canonical"], e.get("type", "Concept"), len(alias)))
        elif isinstance(value, list):
            alias += [(v.lower(), v, kind, len(alias) + n) for n, v in enumerate(value)]
    return {
        "alias": first_alias_wins(spark.createDataFrame(
            alias, "alias string, name string, entity_type string, seq int")),
        "relation": spark.createDataFrame(relation, "subject string, relation string, object string"),
        "synonym": spark.createDataFrame(synonym, "group_id int, term string"),
        "role": spark.createDataFrame(role, "name string, role string"),
        "expansion": spark.createDataFrame(expansion, "name string, term string"),
    }


def expanded_queries(found: DataFrame, queries: DataFrame, expansion: DataFrame) -> DataFrame:
    """`queries(query_id, text)` with the words added that their entities, `found(query_id, name)`, are expanded with."""
    more = found.join(expansion, "name").groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("term")), " ").alias("more"))
    return queries.join(more, "query_id", "left").withColumn("text", F.concat_ws(" ", "text", "more")).drop("more")
