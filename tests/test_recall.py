"""Which texts hold a passage: the ground truth of D29."""

from recallgrid.catalog.aggregates import truth
from recallgrid.sources.views import Tables


def test_truth_equals_a_plain_search(spark, tmp_path):
    """Passages of any length, also without a whole word inside; those of one word were never found before."""
    texts = [None, "", "one red fox ran over the hill", "A red fox. A red fax.", "prered foxes ran", "the the the", "Red Fox ran over", "x red  fox ran", "fox", "hill the over ran fox red one"]
    passages = ["red fox ran", "red fox", "fox", "one red fox ran over the hill", "the the the the", "zebra fox ran", "red fox ran over", "e red fox ran o", "...", "the the the"]
    docs = [(i + 1, x, "en", "s", 0) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.query_id, r.id) for r in truth(Tables(spark, str(tmp_path))).collect()}
    assert found == {(q, f"d{i}") for q, p in enumerate(passages) for i, x, *_ in docs if x is not None and p in x}
