"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The URLs that a rule judges are the labelled ones. The trees (Spark's own) learn
from at most PER_LABEL different ones for each verdict, smallest by hash; the
suffix statistics cover all URLs. Features: lengths, depth, digit ratios,
character entropy, parameter counts, host shape, and for the suffix (the last
two labels of the host) the number of its URLs, its mean depth and its mean
digit ratio; also the share of `block` among the labelled URLs of the suffix, of
the first part of the path, and of both together. A labelled URL's own fold (by
hash, so with all its copies) is left out of its shares, so none says its own label.

Defined results: a null URL, or one without `://`, has an empty host and path,
fits no rule and is judged by the trees; with URLs of one verdict only (or none) to learn
from, the rest get that verdict (or `allow`); repeated rows get equal results;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import ascii_lower, quoted, smallest_by_hash

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PER_LABEL, TREES, DEPTH, SEED = 5000, 20, 4, 7
LEXICAL = ("length", "host_length", "path_length", "depth", "digit_ratio", "host_digit_ratio", "entropy", "n_params", "query_length", "n_labels", "n_hyphens")
SUFFIX = ("suffix_count", "suffix_depth", "suffix_digits")
#: Shares of `block` by suffix, by first part of the path, by both.
RATES, FOLDS = ("suffix_rate", "first_rate", "pair_rate"), 5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): up to `/`, `?`, `#` or the end after the first `://`, A-Z lower-cased; then up to `?`, `#` or the end."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    parts = F.transform(F.array_remove(F.array_distinct(F.split(text, "")), ""), lambda c: -share(c) * F.log2(share(c)))
    return F.aggregate(F.array_sort(parts), F.lit(0.0), lambda a, v: a + v)


def _fold(url: Column) -> Column:
    """Copies of a URL are in one fold."""
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS))


def _rate(n: Column, blocked: Column, labelled: Column) -> Column:
    """Share of `block` among the labelled rows of other folds, drawn to one half where they are few. A row without a label has none to leave out."""
    def rest(counts: Column) -> Column:
        own = F.when(labelled, F.element_at(counts, _fold(F.col("url")).cast("int") + 1)).otherwise(0)
        return F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda a, v: a + v) - own, F.lit(0))
    return (rest(blocked) + 1.0) / (rest(n) + 2.0)


def with_features(pages: DataFrame, labelled: Column) -> DataFrame:
    """`pages(url, host, path, by, ...)` plus LEXICAL, `suffix`, SUFFIX and RATES; labels are read where `labelled` says so."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    lexical = pages.select(
        "*", F.length(url).alias("length"), F.length("host").alias("host_length"), F.length("path").alias("path_length"),
        F.size(F.filter(F.split("path", "/"), lambda v: v != "")).alias("depth"), _ratio(_digits(url), F.length(url)).alias("digit_ratio"),
        _ratio(_digits(F.col("host")), F.length("host")).alias("host_digit_ratio"), entropy(url).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda v: v != "")).alias("n_params"), F.length(query).alias("query_length"),
        F.size(F.split("host", r"\.")).alias("n_labels"), (F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit("")))).alias("n_hyphens"),
        F.substring_index("host", ".", -2).alias("suffix"), F.substring_index(F.substring_index("path", "/", 2), "/", -1).alias("first"))
    block = F.coalesce(F.col("by.verdict") == "block", F.lit(False))
    names = [f"{c}{k}" for c in ("n", "b") for k in range(FOLDS)]
    fold = [labelled & (_fold(F.col("url")) == k) for k in range(FOLDS)]
    counts = [F.count_if(f).alias(f"n{k}") for k, f in enumerate(fold)] + [F.count_if(f & block).alias(f"b{k}") for k, f in enumerate(fold)]
    # all statistics come from the table of pairs, so the rows themselves move once
    both = cut_lineage(lexical.groupBy("suffix", "first").agg(F.count("*").alias("rows"), F.sum("depth").alias("depths"), F.sum("digit_ratio").alias("digits"), *counts))

    def arrays(prefix: str, value) -> list[Column]:
        return [F.array(*(value(f"{c}{k}") for k in range(FOLDS))).alias(f"{prefix}_{c}") for c in ("n", "b")]

    suffixes = both.groupBy("suffix").agg(F.sum("rows").alias("all"), F.sum("depths").alias("depths"), F.sum("digits").alias("digits"), *(F.sum(c).alias(c) for c in names)).select(
        # means are rounded: sums of doubles depend on their order, and trees cut at such values
        "suffix", F.round(F.log1p("all"), 6).alias("suffix_count"), F.round(F.col("depths") / F.col("all"), 6).alias("suffix_depth"),
        F.round(F.col("digits") / F.col("all"), 6).alias("suffix_digits"), *arrays("suffix", F.col))
    firsts = both.groupBy("first").agg(*(F.sum(c).alias(c) for c in names)).select("first", *arrays("first", F.col))
    table = cut_lineage(both.select("suffix", "first", *arrays("pair", F.col)).join(suffixes, "suffix").join(firsts, "first"))
    rates = [F.round(_rate(F.col(f"{p}_n"), F.col(f"{p}_b"), labelled), 6).alias(f"{p}_rate") for p in ("suffix", "first", "pair")]
    out = lexical.join(table, ["suffix", "first"])
    return out.select(*lexical.columns, "suffix_count", "suffix_depth", "suffix_digits", *rates)


def _judged(pages: DataFrame, url: str, rules, *more: Column) -> DataFrame:
    """`more`, url, host, path and `by`, the rule that fits (null: none), of every row."""
    own = pages.select(*more, F.col(quoted(url)).alias("url"))
    host, path = split_url(F.col("url"))
    return own.withColumn("host", host).withColumn("path", path).withColumn("by", rule_of(F.col("host"), F.col("path"), rules))


def _learnt(described: DataFrame, labelled: Column, per_label: int) -> tuple[PipelineModel | None, set[float]]:
    """The trees, null without two verdicts to learn from, and the labels seen (1: block)."""
    inputs = VectorAssembler(inputCols=[*LEXICAL, *SUFFIX, *RATES], outputCol="features")
    rows = described.where(labelled).select(F.col("by.verdict").alias("verdict"), "url", *LEXICAL, *SUFFIX, *RATES)
    few = smallest_by_hash(rows, "verdict", F.xxhash64("url"), per_label)
    sample = cut_lineage(inputs.transform(few).select((F.col("verdict") == "block").cast("double").alias("label"), "features"))
    seen = {r[0] for r in sample.select("label").distinct().collect()}  # two values at most
    if len(seen) < 2:
        return None, seen
    return PipelineModel([inputs, GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32).fit(sample)]), seen


def _scored(rows: DataFrame, model: PipelineModel | None, seen: set[float]) -> DataFrame:
    """`rows` with `score`, the probability of `block`, and `said`, the verdict."""
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn("said", F.lit("block" if seen == {1.0} else "allow"))
    out = model.transform(rows).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return out.withColumn("said", F.when(F.col("score") > 0.5, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, per_label: int = PER_LABEL) -> DataFrame:
    """`key`, `host`, `path`, `rule`, `verdict`, `block_score` of every row of `pages`.

    The score is the trees' probability of `block`, null where they were not asked.
    """
    ruled = _judged(pages, url, rules, F.col(quoted(key)).alias("id"))
    judged = ruled.select("id", "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    labelled = F.col("by").isNotNull()
    described = with_features(ruled, labelled)
    model, seen = _learnt(described, labelled, per_label)
    by_method = _scored(described.where(~labelled), model, seen).select(
        "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.col("said").alias("verdict"), F.col("score").alias("block_score"))
    return judged.where("verdict is not null").unionByName(by_method).withColumnRenamed("id", key)


def held_out_accuracy(pages: DataFrame, url: str = "url", rules=RULES, per_label: int = PER_LABEL) -> tuple[int, float, float]:
    """(rows, share right, share of the commoner verdict) of a fifth of the different ruled URLs, by trees that learnt from the others."""
    ruled = _judged(pages, url, rules)
    out, has = _fold(F.col("url")) == 0, F.col("by").isNotNull()
    described = with_features(ruled, has & ~out)
    model, seen = _learnt(described, has & ~out, per_label)
    tested = _scored(described.where(has & out), model, seen).select("url", F.col("by.verdict").alias("verdict"), "said").distinct()
    r = tested.agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("verdict")).alias("right"), F.count_if(F.col("verdict") == "block").alias("block")).first()
    n = max(r.n, 1)
    return r.n, r.right / n, max(r.block, r.n - r.block) / n
