"""Dictionary entities and relations in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import tokens

#: Rows of a dictionary up to which it is sent to every task; texts meet a larger one by a shuffle of their words.
SENT = 100_000


def _sent(dictionary: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(dictionary) if rows <= SENT else dictionary


def entity_matches(docs: DataFrame, aliases: DataFrame, text: str = "content", key: str = "id") -> DataFrame:
    """(key, pos, len, alias, name, entity_type): whole-word alias matches in a
    document, leftmost first, the longest at a position, none overlapping.

    The text meets the dictionary on an alias's first word, so only possible
    starts are looked at. The overlap rule runs over one document's matches.
    """
    dic = aliases.select("alias", "name", "entity_type", tokens(F.col("alias")).alias("words")).where(F.size("words") > 0)
    dic = dic.withColumn("first", F.col("words")[0])
    size = dic.agg(F.max(F.size("words")).alias("longest"), F.count("*").alias("n")).head()
    longest = size.longest or 1
    toks = docs.select(key, tokens(F.col(text)).alias("toks"))
    if longest == 1:
        whole = toks.select(key, F.posexplode("toks").alias("pos", "first")).join(_sent(dic, size.n), "first")
    else:  # each position carries its word and the few that follow, never the whole text
        starts = toks.select(key, F.posexplode(F.expr(
            f"transform(toks, (w, i) -> struct(w as first, slice(toks, i + 1, {longest}) as ahead))")).alias("pos", "at"))
        starts = starts.select(key, "pos", "at.first", "at.ahead").join(_sent(dic, size.n), "first")
        whole = starts.where(F.expr("slice(ahead, 1, size(words)) = words"))
    whole = whole.select(
        key, F.struct("pos", (-F.size("words")).alias("neg_len"), "alias", "name", "entity_type").alias("m"))
    kept = whole.groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("ms")).select(
        key, F.expr("""aggregate(ms, struct(0 as upto, slice(ms, 1, 0) as kept),
          (s, m) -> if(m.pos >= s.upto, struct(m.pos - m.neg_len as upto, concat(s.kept, array(m)) as kept), s),
          s -> s.kept)""").alias("ms"))
    return kept.select(key, F.explode("ms").alias("m")).select(
        key, F.col("m.pos").alias("pos"), (-F.col("m.neg_len")).alias("len"), "m.alias", "m.name", "m.entity_type")


def extract_entities(docs: DataFrame, aliases: DataFrame, text: str = "content", key: str = "id") -> DataFrame:
    """Distinct (key, name, entity_type) found in each document."""
    return entity_matches(docs, aliases, text, key).select(key, "name", "entity_type").distinct()


def dictionary_relations(found: DataFrame, relations: DataFrame, key: str = "id") -> DataFrame:
    """Triples whose subject or object was found: two equi joins, not an OR join."""
    names = found.select(key, "name")
    s = names.join(relations, names["name"] == relations["subject"])
    o = names.join(relations, names["name"] == relations["object"])
    cols = [key, "subject", "relation", "object"]
    return s.select(*cols).union(o.select(*cols)).distinct()


def names_of(found: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, entity_names, relation_triples) of the rows in which a name was found: the different names `found(id, name)` and the triples at them, as text."""
    triple = F.concat_ws(" ", "subject", "relation", "object")
    at_name = relations.select(F.explode(F.array("subject", "object")).alias("name"), triple.alias("triple")).groupBy("name").agg(F.collect_set("triple").alias("triples"))
    rows = found.select("id", "name").join(_sent(at_name, relations.limit(SENT + 1).count()), "name", "left")
    triples = F.array_distinct(F.flatten(F.collect_list("triples")))
    return rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("entity_names"),
                                  F.array_join(F.sort_array(triples), " ").alias("relation_triples"))
