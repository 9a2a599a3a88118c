"""Benchmark decontamination by winnowing.

Words are hashed, every K of them to one gram; of each W = SPAN - K + 1 grams
in a row the smallest hash (the leftmost of equals) is a fingerprint. Two texts
that share SPAN words in a row share a window of W grams, so they share its
fingerprint. Fingerprints of both sides meet in a join; a hit is extended, word
by word, by as many words on either side as a shared span around it can have,
and counts if SPAN words agree. Benchmark items shorter than SPAN words are one
gram of all their words (a window of one), joined to the documents' grams of
the same length.

Defined results: null text, and text without words, has no words and no hit;
null benchmark texts and items without words match nothing; an item without id
hits but is not listed; items with equal texts are all listed; repeated rows
get equal results; empty tables give no hits or an empty table. Texts are read
whole. Other columns pass through `drop_contaminated` and are not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import ascii_lower, fresh, quoted

SPAN, K = 13, 5
#: Fingerprint rows of the benchmark, each under 400 bytes, up to which they are sent to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 40_000
#: What lies between words, on lower-cased text, and the words of any case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A gram's place in its text, in the low bits; the high bits rank it.
PLACE = (1 << 31) - 1


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(ascii_lower(text), BETWEEN, -1), ""), lambda w: F.xxhash64(w))


def _over_runs(table: DataFrame, values: str, out: str, size: int, merge: Callable[[Column, Column], Column], overlap: bool) -> DataFrame:
    """`table` with `out`: `merge` over each `size` of `values` in a row, built from runs of 1, 2, 4, ... values.

    A pass joins an array with itself, shifted; that costs a fifth of slicing it
    at every place. With `overlap` the last two runs may cover a value twice.
    """
    def joined(left: str, right: str, by: int, name: str) -> str:
        nonlocal table
        table = table.withColumn(name, F.zip_with(left, F.slice(right, F.lit(by + 1), F.size(right)), merge))
        return name

    level, width, have, done = values, 1, None, 0
    while True:
        if not overlap and size & width:
            have = level if have is None else joined(have, level, done, f"{out}_{done + width}")
            done += width
        if 2 * width > size:
            break
        level, width = joined(level, level, width, f"{out}_run{2 * width}"), 2 * width
    if overlap:
        have = joined(level, level, size - width, f"{out}_{size}") if size > width else level
    n = F.size(values) - size + 1  # what follows lacks values
    table = table.withColumn(out, F.slice(have, F.lit(1), F.greatest(n, F.lit(0))))
    return table.drop(*(c for c in table.columns if c.startswith(f"{out}_")))


def _with_fingerprints(table: DataFrame, k: int, w: int, words: str = "words") -> DataFrame:
    """`table` plus `print`, an array of (at, gram, lead, around): the first word's place, from 1, the rank part of
    the gram's hash (33 bits; hits are compared word by word), and the gram with the words that a span around it can
    have, `lead` of them before it.
    """
    grams = _over_runs(table, words, "gram", k, lambda a, b: F.xxhash64(a, b), False)
    ranked = grams.withColumn("ranked", F.transform("gram", lambda g, i: g.bitwiseAND(~PLACE).bitwiseOR((i + 1).cast("long"))))
    least = _over_runs(ranked, "ranked", "least", w, lambda a, b: F.least(a, b), True).withColumn("least", F.array_distinct("least"))

    def one(v: Column) -> Column:  # nothing here may refer to a column that is dear to compute: it would be computed for each v
        at = v.bitwiseAND(PLACE).cast("int")
        lead = F.least(at, F.lit(w)) - 1
        return F.struct(at.alias("at"), v.bitwiseAND(~PLACE).alias("gram"), lead.alias("lead"), F.slice(words, at - lead, lead + k + w - 1).alias("around"))

    return least.withColumn("print", F.transform("least", one)).drop("gram", "ranked", "least")


def _opened(table: DataFrame, keep: list[str], name: str) -> DataFrame:
    """A row for each fingerprint. `explode` would make Spark test the array's size first, and compute it twice for that."""
    return table.select(*keep, F.explode_outer("print").alias(name)).where(F.col(name).isNotNull()).select(*keep, F.col(f"{name}.gram").alias("gram"), name)


def _hits(docs: DataFrame, items: DataFrame, k: int, w: int) -> DataFrame:
    """(a, b, start, end, item) of shared spans of k + w - 1 words or more; docs (a, b, words), items (item, words)."""
    mine = _opened(_with_fingerprints(docs, k, w), ["a", "b"], "d")
    theirs = cut_lineage(_opened(_with_fingerprints(items, k, w), ["item"], "q"))
    small = theirs.count() <= BROADCAST_ROWS
    met = mine.join(F.broadcast(theirs) if small else theirs, "gram")

    def agree(first: int, last: int, step: int) -> Column:
        """How many words, from `first` places after the grams' first word to `last`, are the same in a row."""
        if (last - first) * step < 0:
            return F.lit(0)
        same = F.transform(F.sequence(F.lit(first), F.lit(last), F.lit(step)), lambda i: F.coalesce(
            F.get(F.col("d.around"), F.col("d.lead") + i) == F.get(F.col("q.around"), F.col("q.lead") + i), F.lit(False)))
        return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")

    ends = met.where(agree(0, k - 1, 1) == k).withColumn("left", agree(-1, -(w - 1), -1)).withColumn("right", agree(k, k + w - 2, 1))
    return ends.where(F.col("left") + k + F.col("right") >= k + w - 1).select(
        "a", "b", (F.col("d.at") - F.col("left")).alias("start"), (F.col("d.at") + k + F.col("right")).alias("end"), "item")


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                  span: int = SPAN, k: int = K) -> DataFrame:
    """`key`, `n_words`, `n_hit`, `n_items`, `items` (sorted ids as text), `contaminated` for every row of `docs`."""
    a, b = _text_key(F.col("text"))
    own = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    words = own.where("text is not null").select(a.alias("a"), b.alias("b"), word_hashes(F.col("text")).alias("words"))
    asked = cut_lineage(items.select(items[item].cast("string").alias("item"), items[item_text].alias("text")).where("text is not null")
                        .withColumn("words", word_hashes(F.col("text"))).drop("text").where(F.size("words") > 0))
    lengths = [r[0] for r in asked.where(F.size("words") < span).select(F.size("words")).distinct().collect()]  # at most span - 1 numbers
    found = _hits(words, asked.where(F.size("words") >= span), k, span - k + 1)
    for n in sorted(lengths):
        found = found.unionByName(_hits(words, asked.where(F.size("words") == n), n, 1))
    per_text = found.groupBy("a", "b").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("ids"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), lambda s, v: F.struct(
        (s["n"] + F.greatest(F.lit(0), v["end"] - F.greatest(v["start"], s["reach"]))).alias("n"), F.greatest(s["reach"], v["end"]).alias("reach")))["n"]
    # cut, so that Spark can split the rows of one text in the join
    hit = cut_lineage(per_text.select("a", "b", covered.cast("long").alias("n_hit"), "ids"))
    counted = own.select("key", a.alias("a"), b.alias("b"), F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return counted.join(hit, ["a", "b"], "left").select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated."""
    a, b = fresh(docs, "text_a", "text_b")
    ka, kb = _text_key(F.col("text"))
    texts = docs.select(F.col(quoted(text)).alias("text"))
    bad = contamination(texts.where("text is not null").withColumn("key", F.struct(ka.alias("a"), kb.alias("b"))), items, "key", "text", **more).where(
        "contaminated").select(F.col("key.a").alias(a), F.col("key.b").alias(b)).distinct()
    da, db = _text_key(F.col(quoted(text)))
    return docs.withColumn(a, da).withColumn(b, db).join(cut_lineage(bad).hint("shuffle_hash"), [a, b], "left_anti").drop(a, b)


def _sql_words(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')")


ORACLE = f"""
with d as (select row_number() over () as r, doc_id, coalesce({_sql_words('text')}, []) as ws from documents),
i as (select cast(item_id as varchar) as item, {_sql_words('text')} as ws from benchmark where text is not null),
sized as (select item, ws, least(len(ws), {SPAN}) as n from i where len(ws) > 0),
asked as (select distinct item, n, array_to_string(ws[p:p + n - 1], ' ') as gram from sized, lateral (select unnest(range(1, len(ws) - n + 2)) as p)),
lens as (select distinct n from asked),
mine as (select r, n, p, array_to_string(ws[p:p + n - 1], ' ') as gram from d, lens, lateral (select unnest(range(1, cast(len(ws) - n + 2 as bigint))) as p)),
met as (select distinct r, mine.n, p, item from mine join asked using (n, gram)),
hit as (select r, count(distinct w) as n_hit from met, lateral (select unnest(range(p, p + n)) as w) group by r),
ids as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from met group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hit using (r) left join ids using (r)
"""
