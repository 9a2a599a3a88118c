"""BM25 over text, for batches of queries; `term_index` has the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import tokens
from ..session import spread

# The published BM25 parameters.
K1 = 1.2
B = 0.75


def query_terms(queries: DataFrame, text: str = "text", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, token, qtf): a word said twice counts twice."""
    return (
        queries.select(*keys, F.explode(tokens(F.col(text))).alias("token"))
        .groupBy(*keys, "token").agg(F.count("*").alias("qtf"))
    )


def token_rows(docs: DataFrame, text: str = "content", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, position, token) of every document."""
    return docs.select(*keys, F.posexplode(tokens(F.col(text))).alias("position", "token"))


def postings(docs: DataFrame, text: str = "content", keys: tuple[str, ...] = ("id", "stream")) -> DataFrame:
    """(keys, dl, token, tf). All tokens of a row sit in one task, so the
    map-side combine already leaves one row per (document, token)."""
    d = spread(docs.select(*keys, text)).select(*keys, tokens(F.col(text)).alias("toks")).withColumn("dl", F.size("toks"))
    return (
        d.select(*keys, "dl", F.explode("toks").alias("token"))
        .groupBy(*keys, "dl", "token").agg(F.count("*").alias("tf"))
    )


def bm25(terms: DataFrame, docs: DataFrame, text: str = "content", by_stream: bool = False,
         stats_docs: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) for every document sharing a word with a query.

    Only words some query asks for leave the scan. Document statistics are those
    of `stats_docs` (default: the searched documents), as in an index whose
    filters act on hits and not on its counts. With `by_stream` the terms carry
    a `stream` and only documents of that stream match.
    """
    base = docs if stats_docs is None else stats_docs
    sized = base.select(F.size(tokens(F.col(text))).alias("dl"))
    n_docs = sized.agg(F.count("*").alias("n")).scalar()
    avg_dl = sized.agg(F.avg("dl").alias("a")).scalar()
    wanted = terms.select("token").distinct()

    def hits(d: DataFrame) -> DataFrame:
        x = spread(d.select("id", "stream", text)).select("id", "stream", tokens(F.col(text)).alias("toks")).withColumn("dl", F.size("toks"))
        # by document: counting words and summing scores per (query, document)
        # both find their rows in one partition, so this is the only large shuffle
        return (x.select("id", "stream", "dl", F.explode("toks").alias("token"))
                .join(wanted, "token", "left_semi").repartition("id")
                .groupBy("token", "id", "stream", "dl").agg(F.count("*").alias("tf")))

    tf = hits(docs)
    df = (tf if stats_docs is None else hits(stats_docs)).groupBy("token").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "token").withColumn(
        "idf", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    on = ["token", "stream"] if by_stream else ["token"]
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("dl") / avg_dl))
    return (
        tf.join(weighted, on).withColumn("part", part)
        .groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    )
