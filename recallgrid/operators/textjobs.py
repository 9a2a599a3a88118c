"""Jobs over tables of text: an annotated table out, and what a report groups by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as lx
from .entities import entity_matches


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: F.length(w) > 0)


# ---- queries -------------------------------------------------------------

def without_operators(text: Column) -> Column:
    return F.translate(text, lx.OPERATOR_CHARACTERS, " " * len(lx.OPERATOR_CHARACTERS))


def stem(word: Column) -> Column:
    """Word without its inflection ending, null where none applies."""
    low = F.lower(word)
    ends = F.array(*[F.lit(s) for s in lx.SUFFIXES])
    first = F.get(F.filter(ends, lambda s: low.endswith(s) & (F.octet_length(low) > F.octet_length(s) + 2)), F.lit(0))
    return F.substring(low, F.lit(1), F.length(low) - F.length(first))


def resolve_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """`text` with the names of aliases found in it appended, unless it has them."""
    found = entity_matches(queries, aliases, text="text", key="query_id").select("query_id", "name").distinct()
    extra = (found.join(queries.select("query_id", "text"), "query_id")
             .where(~F.lower("text").contains(F.lower("name")))
             .groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("extra")))
    return queries.join(extra, "query_id", "left").withColumn(
        "text", F.concat("text", F.coalesce(F.concat(F.lit(" "), F.col("extra")), F.lit("")))).drop("extra")


def expand_synonyms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, pos, token, origin): the query's own words, then words of every
    synonym group it touches, up to three times its length (200 at least).

    A group is touched by an equal term, an equal word, or an equal stem of four
    letters or more. `synonyms(group_id, pos, term)`.
    """
    own = queries.select("query_id", F.posexplode(_words(F.col("text"))).alias("pos", "word")).withColumn("token", F.lower("word"))
    own = own.groupBy("query_id", "token").agg(F.min_by(F.struct("pos", "word"), "pos").alias("f")).select(
        "query_id", "token", "f.pos", "f.word")
    terms = synonyms.select("group_id", F.col("pos").alias("term_pos"), F.lower("term").alias("low"), "term")
    words = terms.select("group_id", "term_pos", F.posexplode(_words(F.col("term"))).alias("word_pos", "gword")).withColumn("low", F.lower("gword"))
    keys = terms.select("group_id", F.concat(F.lit("="), "low").alias("key")).union(
        words.select("group_id", F.concat(F.lit("="), "low"))).union(
        words.select("group_id", F.explode(F.transform(F.array_compact(F.array("low", stem(F.col("low")))), lambda x: F.concat(F.lit("~"), x))))).distinct()
    asked = own.select("query_id", F.concat(F.lit("="), "token").alias("key")).union(
        own.select("query_id", F.explode(F.array_compact(F.array("token", stem(F.col("token"))))).alias("s")).where(
            F.octet_length("s") >= 4).select("query_id", F.concat(F.lit("~"), "s"))).distinct()
    touched = asked.join(keys, "key").select("query_id", "group_id").distinct()
    added = touched.join(words, "group_id").join(own.select("query_id", F.col("token").alias("low")), ["query_id", "low"], "left_anti")
    first = added.groupBy("query_id", "low").agg(F.min(F.struct("group_id", "term_pos", "word_pos", "gword")).alias("f"))
    rows = own.select("query_id", F.lit("own").alias("origin"), F.struct(F.lit(-1).cast("long").alias("g"), F.col("pos").cast("long").alias("t"), F.lit(0).cast("long").alias("w")).alias("o"),
                      F.col("word").alias("token")).unionByName(first.select(
                          "query_id", F.lit("synonym").alias("origin"),
                          F.struct(F.col("f.group_id").cast("long").alias("g"), F.col("f.term_pos").cast("long").alias("t"), F.col("f.word_pos").cast("long").alias("w")).alias("o"),
                          F.col("f.gword").alias("token")))
    size = queries.select("query_id", F.greatest(F.octet_length("text") * 3, F.lit(200)).alias("cap"))
    w = Window.partitionBy("query_id").orderBy("o")
    run = rows.join(size, "query_id").withColumn("used", F.sum(F.octet_length("token") + 1).over(
        w.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("pos", F.row_number().over(w))
    return run.where((F.col("origin") == "own") | (F.col("used") <= F.col("cap"))).select("query_id", "pos", "token", "origin")


def with_stems(tokens: DataFrame) -> DataFrame:
    """Every word, and after it its stem where it has one."""
    return tokens.select("query_id", "pos", F.posexplode(F.array_compact(F.array(
        F.col("token"), F.when(stem(F.col("token")) != F.col("token"), stem(F.col("token")))))).alias("form", "token"), "origin")


# ---- cleaning ------------------------------------------------------------

def strip_html(text: Column) -> tuple[Column, Column]:
    """(clean text, had tags). Text without markup is left alone."""
    marked = reduce(lambda a, b: a | b, [text.contains(m) for m in ["<", "&amp;", "&lt;", "&gt;", "&quot;"]])
    stripped = F.regexp_replace(text, "<[^>]+>", "")
    out = stripped
    for entity, char in lx.HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = _trim(F.regexp_replace(out, r"(?U)\s{3,}", "  "))
    return F.when(marked, out).otherwise(text), marked & (F.length(stripped) != F.length(text))


def injection_flags(text: Column, low: Column) -> Column:
    """Array of the injection findings in `text`; `low` is its lower case, as a
    column of its own so that it is made once and not once per phrase."""
    named = F.array(*[F.when(low.contains(p), F.lit(f"{kind}: '{p}'")) for p, kind in lx.INJECTION_PATTERNS])
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x1f\x{200b}-\x{200f}\x{feff}]", ""))
    strange = F.when(odd > 5, F.concat(F.lit("suspicious control characters: "), odd.cast("string"), F.lit(" found")))
    return F.array_compact(F.concat(named, F.array(strange)))


def screen(table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, finding, source): findings in the raw text, in the cleaned one, or both."""
    clean, _ = strip_html(F.col(text))
    t = table.select(key, F.col(text).alias("_raw"), clean.alias("_clean"))
    t = t.select(key, "_raw", "_clean", F.lower("_raw").alias("_low_raw"), F.lower("_clean").alias("_low_clean"))
    t = t.select(key, injection_flags(F.col("_raw"), F.col("_low_raw")).alias("raw"),
                 injection_flags(F.col("_clean"), F.col("_low_clean")).alias("stripped"))
    both = t.select(key, "raw", "stripped", F.explode(F.array_union("raw", "stripped")).alias("finding"))
    return both.select(key, "finding", F.when(F.array_contains("raw", F.col("finding")) & F.array_contains("stripped", F.col("finding")), "both")
                       .when(F.array_contains("raw", F.col("finding")), "raw").otherwise("stripped").alias("source"))


def wrap_untrusted(key: Column, text: Column) -> Column:
    return F.concat(F.lit('[CHUNK id="'), key, F.lit('"]\n'), F.replace(text, F.lit("[/CHUNK]"), F.lit("[/ CHUNK]")), F.lit("\n[/CHUNK]"))


def strip_markers(text: Column) -> Column:
    """Text without the lines that only mark a block."""
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    keep = F.filter(lines, lambda x: ~_trim(x).rlike(r'^(\[/CHUNK\]|\[CHUNK id="(?s:.*)"\])$'))
    return F.array_join(keep, "\n")


PHONE_RE = rf"(?U)(?:{lx.PHONE_PREFIX}|(?<![A-Za-z0-9])){lx.PHONE}(?![A-Za-z0-9])"
EMAIL_RE = "(?U)" + lx.EMAIL
ID_RE = "(?U)" + lx.ELEVEN_DIGITS


def blocklist_pattern(words: list[str]) -> str:
    import re
    return "(?iu)" + "|".join(re.escape(w.lower()) for w in sorted(words, key=lambda w: (-len(w), w)))


def redact(text: Column, blocklist: list[str] | None = None) -> Column:
    """Phones, e-mails, eleven-digit numbers and listed words replaced by their kind."""
    out = F.regexp_replace(text, PHONE_RE, "[PHONE]")
    out = F.regexp_replace(out, EMAIL_RE, "[EMAIL]")
    out = F.regexp_replace(out, ID_RE, "[ID]")
    return F.regexp_replace(out, blocklist_pattern(blocklist), "[REDACTED]") if blocklist else out


def redactions(table: DataFrame, key: str, text: str, keep: list[str], blocklist: list[str] | None = None) -> DataFrame:
    """(key, keep..., kind, length): one row per thing found."""
    c = F.col(text)
    kinds = [("phone", PHONE_RE, c), ("email", EMAIL_RE, c), ("id", ID_RE, c)]
    if blocklist:
        kinds.append(("blocklist", blocklist_pattern(blocklist), F.regexp_replace(F.regexp_replace(c, PHONE_RE, "[PHONE]"), EMAIL_RE, "[EMAIL]")))
    def tagged(kind: str, rx: str, col: Column) -> Column:
        return F.transform(F.regexp_extract_all(col, F.lit(f"({rx})"), 1), lambda m: F.struct(
            F.lit(kind).alias("kind"), F.octet_length(m).cast("long").alias("length")))

    found = [tagged(*k) for k in kinds]
    return table.select(key, *keep, F.explode(F.concat(*found)).alias("r")).select(key, *keep, "r.kind", "r.length")


def redact_map(doc: Column, blocklist: list[str] | None = None) -> Column:
    """Keys and values of a map of strings, redacted."""
    values = F.transform_values(doc, lambda k, v: redact(v, blocklist))
    return F.transform_keys(values, lambda k, v: redact(k, blocklist))


# ---- snippets ------------------------------------------------------------

# Phrases that cite a memory; a snippet must hold none.
METAWORDS = (r"(?i)(according to (your|my|the) (memory|notes|records|background))"
             r"|(based on (your|my|the) (memory|notes|records|background|stored))"
             r"|(from (your|my|the) (memory|notes|records|background))"
             r"|(i (remember|recall) (that|seeing|reading))"
             r"|((your|my) memory (says|shows|indicates|tells|contains))")


def first_sentence(text: Column) -> Column:
    head = F.regexp_extract(text, r"(?s)^(.*?[.?!])(?:[ \n\t]|\z)", 1)
    return F.when(head == "", text).otherwise(head)


def third_person(text: Column) -> Column:
    out = text
    for a, b in reversed(lx.FIRST_PERSON):
        out = F.when(text.startswith(a), F.concat(F.lit(b), F.substring(text, F.lit(len(a) + 1), F.length(text)))).otherwise(out)
    return out


def snippet(text: Column, cap: int = 200) -> Column:
    """Third-person first sentence; null when it cites a memory or is too long."""
    out = third_person(first_sentence(_trim(text)))
    return F.when(~out.rlike(METAWORDS) & (byte_tokens(out) <= cap), out)


def conflicts(facts: DataFrame) -> DataFrame:
    """A sentence for each pair of neighbouring dated values that differ.
    `facts(stream, predicate, value, date, id)`."""
    w = Window.partitionBy("stream", "predicate").orderBy("date", "id")
    f = facts.withColumn("value_a", F.lag("value").over(w)).withColumn("date_a", F.lag("date").over(w))
    return f.where("value_a <> value").select("stream", "predicate", "id", F.format_string(
        "User has expressed conflicting preferences about %s — said %s on %s and %s on %s.", "predicate", "value_a", "date_a", "value", "date").alias("sentence"))


# ---- sizes ---------------------------------------------------------------

def byte_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4) + 1


def word_tokens(text: Column) -> Column:
    return F.floor(F.size(_words(text)) * F.lit(1.3))


def cut_to_tokens(text: Column, budget: int) -> Column:
    """First words within a token budget, with an ellipsis where cut."""
    most = int(budget / 1.3)
    words = _words(text)
    return F.when(F.size(words) <= most, text).otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("...")))


def transcript_parts(turns: DataFrame, size: int, key: str = "conv_id", block: int = 256) -> DataFrame:
    """(key, part, text): overlapping windows of `size` characters over each
    conversation's turns joined by line breaks, a tenth shared by neighbours.

    Nothing holds a whole conversation: turn offsets are running sums within
    blocks of turns plus block offsets, each turn is cut into the pieces the
    windows need, and a window only gathers its own pieces.
    """
    step = size - size // 10
    t = turns.select(key, "turn", F.concat("text", F.lit("\n")).alias("text")).withColumn("b", F.expr(f"turn div {block}"))
    t = t.withColumn("n", F.length("text"))
    sums = t.groupBy(key, "b").agg(F.sum("n").alias("bn"))
    wb = Window.partitionBy(key).orderBy("b")
    sums = sums.withColumn("base", F.sum("bn").over(wb) - F.col("bn")).withColumn("total", F.sum("bn").over(Window.partitionBy(key)) - 1)
    w = Window.partitionBy(key, "b").orderBy("turn")
    t = t.withColumn("off", F.sum("n").over(w) - F.col("n")).join(sums.select(key, "b", "base", "total"), [key, "b"])
    t = t.withColumn("off", F.col("off") + F.col("base"))
    last = F.when(F.col("total") <= size, F.lit(0)).otherwise(F.ceil((F.col("total") - size) / step)).cast("int")
    lo = F.greatest(F.lit(0), F.ceil((F.col("off") - size + 1) / step)).cast("int")
    hi = F.least(last, F.floor((F.col("off") + F.col("n") - 1) / step).cast("int"))
    p = t.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("part", F.explode(F.sequence("lo", "hi")))
    a = F.greatest(F.col("part") * step, F.col("off"))
    z = F.least(F.col("part") * step + size, F.col("off") + F.col("n"), F.col("total"))
    p = p.withColumn("piece", F.substring("text", (a - F.col("off") + 1).cast("int"), (z - a).cast("int"))).where(a < z)
    return p.groupBy(key, "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "piece"))), lambda s: s["piece"]), "").alias("text"))


def compress(text: Column) -> Column:
    """More than four sentences become the first three and the last."""
    clean = strip_markers(text)
    s = F.filter(F.transform(F.split(clean, "[.!?]"), _trim), lambda x: F.length(x) > 0)
    return F.when(F.size(s) <= 4, clean).otherwise(F.concat(F.array_join(F.slice(s, 1, 3), ". "), F.lit(". ... "), F.element_at(s, -1)))


def label_by_hash(docs: DataFrame, classify, text: str = "content") -> DataFrame:
    """Each distinct content is classified once and the label joined back.
    `classify` maps (hash, content) rows to (hash, label) rows."""
    h = docs.withColumn("hash", F.sha2(F.col(text), 256))
    labels = classify(h.groupBy("hash").agg(F.first(text).alias(text)))
    return h.join(labels, "hash", "left")
