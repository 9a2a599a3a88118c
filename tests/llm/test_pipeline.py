"""The pipeline against plain versions of its stages."""

import corpus_pipeline
import sentencepiece
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recallgrid.llm import pieces, quality
from tests.conftest import SMALL

from . import plain


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    rows = [r for r in rows if quality.measure(r[1], press)[-1]]
    texts = plain.without_boilerplate([(t, s) for _, t, s in rows], 10)
    rows = [(i, t) for (i, _, _), t in zip(rows, texts)]
    rows = [r for r, v in zip(rows, plain.near_duplicates(rows, 5)) if v[3]]
    rows = [r for r, v in zip(rows, plain.contamination(rows, items)) if not v[5]]
    exact = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = {i: exact.encode(t) for i, t in rows}
    got = entry.queries()["pipeline"](spark, SMALL).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want) and 0 < len(want) < docs.count()


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, docs.where("false"), SMALL).count() == 0


def test_stages_take_any_column(spark):
    """Columns whose names need quotes, or clash, and types that Python workers may not read."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("a.b", F.col("doc_id") * 2).withColumn("key_a", F.lit("x")).withColumn(
        "wide", F.expr("named_struct('x y', make_ym_interval(1, cast(doc_id as int)))")).withColumn("digest", F.col("text"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert out.where("`a.b` = doc_id * 2 and key_a = 'x' and extract(month from wide.`x y`) = doc_id % 12").count() == out.count() > 0
