"""Cross-site boilerplate lines: how many sites a line spreads over, by HyperLogLog.

Every line with a word is hashed; one sketch of its sites per line hash is
merged by aggregation. Lines whose estimate is near the threshold are counted
exactly, so the sketches' error decides nothing. Lines on MIN_SITES sites or more go
from every document that has a line of its own besides. A document in which no
line with a word would be left is a copy of a spread document and no page with
boilerplate: it stays whole, for near-duplicate removal to deal with.

Defined results: null text stays null and has no lines; a null site counts for
no line; blank lines always stay; a line that repeats inside a document goes
everywhere in it; equal texts get equal results; an empty table gives an empty
table. All other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import fresh, quoted

MIN_SITES = 10
#: log2 of the sketch's buckets: a standard error of 3.3 %. BAND is seven times that.
LG_K, BAND = 10, 0.25
WORD = r"[^\x20\x09-\x0D]"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(value: Column) -> list[Column]:
    """Two 64-bit hashes: at 10^13 different lines a clash of both is unlikely."""
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def _hashed(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """One row of (a, b, more) for each different line with a word of each row.

    `explode` would make Spark test the array's size first, and compute it twice for that.
    """
    line = docs.select(F.explode_outer(F.array_distinct(lines_of(F.col(text)))).alias("line"), *more).where(F.col("line").rlike(WORD))
    a, b = _key(F.col("line"))
    return line.withColumn("a", a).withColumn("b", b).drop("line")


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b): hashes of the lines on `min_sites` sites or more."""
    own = docs.select(F.col(quoted(text)).alias("text"), F.col(quoted(site)).alias("site")).where("text is not null and site is not null")
    spread = _hashed(own, "text", F.col("site")).groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    wide = cut_lineage(spread.where(F.col("sites") >= min_sites * (1 - BAND)))
    near = wide.where(F.col("sites") <= min_sites * (1 + BAND)).select("a", "b")
    # distinct first: it combines before the exchange, so a line on many rows reaches the join as a row per site
    exact = _hashed(own, "text", F.col("site")).distinct().join(near, ["a", "b"], "left_semi").groupBy("a", "b").count()
    return wide.where(F.col("sites") > min_sites * (1 + BAND)).select("a", "b").union(exact.where(F.col("count") >= min_sites).select("a", "b"))


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` with boilerplate lines out of `text`, and two more columns, `n_lines` and `n_removed`.

    If `docs` has columns of these names, the new ones get a leading underscore.
    """
    n_lines, n_removed, a, b, gone, cut = fresh(docs, "n_lines", "n_removed", "key_a", "key_b", "gone", "cut")
    body = F.col(quoted(text))
    common = cut_lineage(boilerplate(docs, text, site, min_sites).select(F.struct("a", "b").alias("line"), "a", "b"))
    ta, tb = _key(F.col("text"))
    own = docs.select(body.alias("text")).where("text is not null")
    # a row for each different text with such a line; cut, so that Spark can split the rows of one text in the join
    hits = cut_lineage(_hashed(own, "text", ta.alias(a), tb.alias(b)).join(common, ["a", "b"]).groupBy(a, b).agg(F.collect_set("line").alias(gone)))
    da, db = _key(body)
    joined = docs.withColumn(a, da).withColumn(b, db).join(hits.hint("shuffle_hash"), [a, b], "left")

    def goes(line: Column) -> Column:
        x, y = _key(line)
        return F.array_contains(F.col(gone), F.struct(x.alias("a"), y.alias("b")))

    lines = lines_of(body)
    kept = F.filter(lines, lambda v: ~goes(v))
    out = joined.withColumn(cut, F.when(F.col(gone).isNotNull(), kept))
    remove = F.col(cut).isNotNull() & F.exists(cut, lambda v: v.rlike(WORD))
    count = F.coalesce(F.size(F.when(body.isNotNull(), lines)), F.lit(0)).cast("long")
    return out.select(
        *(F.when(remove, F.array_join(cut, "\n")).otherwise(body).alias(c) if c == text else F.col(quoted(c)) for c in docs.columns),
        F.when(body.isNull(), 0).otherwise(count).cast("long").alias(n_lines),
        F.when(remove, count - F.size(cut)).otherwise(0).cast("long").alias(n_removed))


ORACLE = f"""
with row_lines as (select row_number() over () as r, doc_id, text, source, string_split(text, chr(10)) as ls from documents),
flat as (select r, source, unnest(ls) as line, generate_subscripts(ls, 1) as pos from row_lines),
wordy as (select *, regexp_matches(line, '[^ \\t\\n\\r\\x0b\\x0c]') as has_word from flat),
common as (select line from wordy where has_word group by line having count(distinct source) >= {MIN_SITES}),
marked as (select w.*, w.has_word and c.line is not null as goes from wordy w left join common c on w.line = c.line),
per as (select r, count(*) as n, count(*) filter (where goes) as n_goes, count(*) filter (where has_word and not goes) as n_own,
  string_agg(line, chr(10) order by pos) filter (where not goes) as kept from marked group by r)
select doc_id, case when n_goes > 0 and n_own > 0 then coalesce(kept, '') else text end as text,
  coalesce(n, 0)::bigint as n_lines, case when n_goes > 0 and n_own > 0 then n_goes else 0 end::bigint as n_removed
from row_lines left join per using (r)
"""
