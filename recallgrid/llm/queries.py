"""One registered query per operator of this subpackage, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_log, decontaminate, hamming_join, language_id, line_dedup, pieces, pii, prefix_trie, quality, sharding, suffix_dedup, url_filter, whitening

N_SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without cross-site boilerplate, n_lines, n_removed."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).drop("source")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    out = language_id.predict(docs, model)
    return out.select("doc_id", language_id.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into 24 shards, sizes at most one row apart."""
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shuffle_shards(docs, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are similar by 0.8 or more."""
    out = hamming_join.near_duplicates(_table(spark, sf_dir, "documents"), k=2)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a 13-word window of the benchmark."""
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by rule or else by trees trained on the URLs that rules judge."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: counts and digest of the base kinds, and all spans."""
    found = pii.pii_spans(_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    return pieces.encode_table(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, base rules and compression bands of every whole text."""
    return quality.quality_metrics(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunk_bytes", "reason")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document inside 400-byte strings that start anywhere else too."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, rebuilt so that some begin alike."""
    turns = prefix_trie.branched(prefix_trie.placed_turns(_table(spark, sf_dir, "conversations")))
    nodes, ends = prefix_trie.trie(turns)
    sha = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return nodes.join(prefix_trie.digests(ends), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four whitened components of every usable vector, and how exact they are."""
    rows, model, error = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = F.array(*map(F.lit, model.explained.tolist() if model else [0.0]))
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader finds in every conversation rendered from its event log."""
    extra = spark.sql("select -1L as conv_id, k as turn, r as role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') v(k, r)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_log.digests(chat_log.format_log(chat_log.as_log(turns)))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_sharding, op4_near_dedup, op5_decontamination, op6_url_filter, op7_pii,
                                   op8_sentencepiece, op9_quality, op10_suffix_dedup, op11_prefix_trie, op12_embedding_whitening, op13_chat_formatting)}
ORACLE = {"op1_line_dedup": line_dedup.ORACLE, "op5_decontamination": decontaminate.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE,
          "op13_chat_formatting": chat_log.ORACLE}
