"""The maintained term index: changes, folding, bounds, skipping."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import entities, lexical, ranking, term_index
from recallgrid.operators.term_index import AskedWords, TermIndex
from recallgrid.plans import hybrid
from recallgrid.session import scratch_path

FIELDS = {"content": "content", "entities": "names"}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, f"s{int(i[1:]) % 3}", c, n, int(i[1:])) for i, (c, n) in rows.items()], "id string, stream string, content string, names string, event_date long")


def words(rng, n):
    return " ".join(rng.choice(["common", "often", f"w{rng.randrange(30)}", f"rare{rng.randrange(400)}"]) for _ in range(n))


def state(index):
    got = lambda df: sorted(map(str, df.collect()))
    return (got(index.postings.select("token", "field", "slot", "id", "stream", "dl", "tf")), got(index.term_df), got(index.totals.select("field", "n", F.round("avg_dl", 9))),
            got(index.docs.select("id", "stream", "event_date", F.array_sort("words"))))


def test_changes_equal_a_fresh_index(spark):
    rng = random.Random(3)
    rows = {f"d{i}": (words(rng, rng.randrange(0, 30)), rng.choice(["", None, "ada lovelace", "ada"])) for i in range(60)}
    index = TermIndex.create(docs_of(spark, rows), scratch_path(spark, "t"), FIELDS)
    for step in range(3):
        changed = {f"d{rng.randrange(80)}": (words(rng, 12), "grace") for _ in range(9)}
        gone = {f"d{rng.randrange(90)}" for _ in range(6)} - set(changed)
        removed = spark.createDataFrame([(g,) for g in gone] * 2, "id string")
        index.apply(docs_of(spark, changed), removed, FIELDS) if step else index.apply(removed=removed, fields=FIELDS)
        rows = {k: v for k, v in (rows | (changed if step else {})).items() if k not in gone}
    fresh = state(TermIndex.create(docs_of(spark, rows), scratch_path(spark, "t"), FIELDS))
    assert state(index) == fresh and len(index.segments) == 4
    index.fold(1, 2)
    assert state(index) == fresh and len(index.segments) == 3
    index.fold()
    assert state(index) == fresh and len(index.segments) == 1
    # a batch that broke off before its manifest row changes nothing
    index._commit = lambda *_: None
    index.apply(removed=spark.createDataFrame([("d1",), ("d2",)], "id string"), fields=FIELDS)
    assert state(TermIndex(spark, index.folder)) == fresh


@pytest.mark.parametrize("lead", [1, 4096])
def test_bounded_search_equals_the_full_one(spark, monkeypatch, lead):
    monkeypatch.setattr(term_index, "LEAD", lead)
    monkeypatch.setattr(term_index, "BLOCK", 8)
    rng = random.Random(lead)
    index = TermIndex.create(docs_of(spark, {f"d{i}": (words(rng, rng.randrange(1, 40)), "") for i in range(300)}), scratch_path(spark, "t"))
    index.apply(docs_of(spark, {f"d{i}": (words(rng, 50), "") for i in range(290, 330)}), spark.createDataFrame([("d3",)], "id string"))
    queries = spark.createDataFrame([(q, words(rng, n)) for q, n in enumerate([1, 2, 5, 9, 30, 60])] + [(7, "common often"), (8, "nowhere"), (9, "rare1 common")], "query_id long, text string")
    terms = lexical.query_terms(queries)
    for k in (1, 5):
        full = ranking.top_n(index.search(terms), ["query_id"], [F.desc("score"), F.col("id")], k)
        assert sorted(map(str, index.top(terms, k).select("query_id", "id", "score", "rank").collect())) == sorted(map(str, full.select("query_id", "id", "score", "rank").collect()))


def scanned(df):
    """Rows that the plan's scans gave out."""
    df.collect()

    def walk(node):
        name, below = node.nodeName(), node.children()
        here = 0
        if "AdaptiveSparkPlan" in name:
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Scan parquet"):
            here = node.metrics().apply("numOutputRows").value()
        return here + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_scan_skips_other_words(spark):
    """The words of a question reach the scan: of sorted postings it reads the pages that can hold them."""
    text = F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("n", F.lit(i)), F.lit(5000))) for i in range(40)))
    rows = spark.range(20_000).select(F.col("id").alias("n")).select(F.concat(F.lit("d"), "n").alias("id"), F.lit("s").alias("stream"), text.alias("content"))
    index = TermIndex.create(rows, scratch_path(spark, "t"))
    held = index.postings.count()
    plan = index._asked(index.postings, ["w77", "w78"])
    assert 0 < scanned(plan) < held / 10 and plan.count() == index.postings.where("token in ('w77', 'w78')").count()


@pytest.mark.parametrize("rows, questions, at_once", [(64, 3, 2), (4096, 16384, 1024)])
def test_best_in_cells_equals_the_full_search(spark, monkeypatch, rows, questions, at_once):
    """Cells of any size give the same rows, with ties, streams, fields and a narrower set of rows."""
    monkeypatch.setattr(term_index, "CELL_ROWS", rows)
    monkeypatch.setattr(term_index, "CELL_QUERIES", questions)
    monkeypatch.setattr(term_index, "AT_ONCE", at_once)
    rng = random.Random(8)
    made = {f"d{i}": (words(rng, rng.randrange(0, 30)), words(rng, 3)) for i in range(150)}
    made |= {f"d{1000 + i}": ("w1 w2 w3", "") for i in range(9)}  # equal scores
    index = TermIndex.create(docs_of(spark, made), scratch_path(spark, "t"), FIELDS)
    asked = [(q, words(rng, 4), f"s{q % 3}") for q in range(7)] + [(7, "w1 w2", "s1"), (8, "nowhere", "s1")]
    queries = spark.createDataFrame(asked, "query_id long, text string, stream string")
    some = index.docs.where("id like '%1%'").select("id")
    for by_stream, weights, among in [(False, {"content": 1.0}, None), (True, {"content": 1.0}, None), (False, {"content": 1.0, "entities": 0.5}, None), (False, {"content": 1.0}, some)]:
        terms = lexical.query_terms(queries, keys=("query_id", "stream") if by_stream else ("query_id",))
        hits = index.search(terms, by_stream, weights)
        hits = hits if among is None else hits.join(among, "id", "left_semi")
        full = ranking.top_n(hits, ["query_id"], [F.desc("score"), F.col("id")], 5)
        found = index.best(terms, 5, by_stream, weights, among)
        assert found.select("query_id", "id", "score", "rank").orderBy("query_id", "rank").collect() == full.select("query_id", "id", "score", "rank").orderBy("query_id", "rank").collect()


def test_scores_round_as_in_spark(spark):
    halves = [i / 1e6 + j / 1e6 * 0.5 for i in range(4139370, 4139380) for j in range(2078740, 2078760)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in halves], "v double").select(F.round("v", 6)).collect()]
    assert term_index._rounded(np.array(halves)).tolist() == want


def test_pairs_of_row_and_question_stay_in_their_task(tables):
    """A search shuffles postings and the best of each cell, never a row for each pair."""
    found = hybrid.lexical_search(tables.queries, tables.chunks, 2, index=tables.index)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()


def test_asked_words_equal_the_stored_index(spark):
    """Only the words asked for are kept, later ones are added, and statistics stay those of all rows and words."""
    rng = random.Random(5)
    docs = docs_of(spark, {f"d{i}": (words(rng, rng.randrange(0, 30)), rng.choice(["", None, "ada lovelace w1"])) for i in range(120)})
    stored, asked = TermIndex.create(docs, scratch_path(spark, "t"), FIELDS), AskedWords(docs, scratch_path(spark, "t"), FIELDS)
    weights = {"content": 1.0, "entities": 0.5}
    for texts in (["w1 common", "rare1 w2 w2"], ["w1 ada", "nowhere", "often rare2"]):
        terms = lexical.query_terms(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))
        found, want = (index.best(terms, 7, weights=weights).collect() for index in (asked, stored))
        assert sorted(map(str, found)) == sorted(map(str, want))
    assert sorted(map(str, asked.totals.collect())) == sorted(map(str, stored.totals.collect()))
    assert {r[0] for r in asked.postings.select("token").distinct().collect()} <= {"w1", "common", "rare1", "w2", "ada", "nowhere", "often", "rare2"}


def test_a_search_of_tables_sorts_no_index(tables):
    """Searches count the asked words only; before, each first wrote and sorted all postings."""
    assert isinstance(tables.index, AskedWords) and isinstance(tables.fielded_index, AskedWords)
    hybrid.lexical_search(tables.queries, tables.chunks, 2, index=tables.index).collect()
    asked = lexical.query_terms(tables.queries).select("token").distinct().count()
    assert tables.index.postings.select("token").distinct().count() <= asked < tables.stored_index.term_df.count()


@pytest.mark.parametrize("sent", [term_index.SENT, 1])
def test_a_text_stays_one_row_and_is_counted_once(spark, monkeypatch, sent):
    """Words of several batches are counted in one pass; before, each batch was a pass of its own and every (text, word) a shuffled row."""
    monkeypatch.setattr(term_index, "SENT", sent)
    docs = docs_of(spark, {"d0": ("w1 w2 w1", "ada"), "d1": ("w9", ""), "d2": ("", None), "d3": ("W2 w3", "w1")})
    asked = AskedWords(docs, scratch_path(spark, "t"), FIELDS)
    one, two = (spark.createDataFrame([(1, text)], "query_id long, text string") for text in ("w1 ada", "w2 w8"))
    hybrid.ask_for(asked, one, None, two)
    rows = {r.id: (r.lengths, len(r.word)) for r in asked._read("texts").collect()}
    assert rows == {"d0": ([3, 1], 3), "d1": ([1, 0], 0), "d2": ([0, 0], 0), "d3": ([2, 1], 2)}
    stored = TermIndex.create(docs, scratch_path(spark, "t"), FIELDS)
    for queries in (one, two):
        found, want = (i.best(lexical.query_terms(queries), 3, weights={"entities": 0.5, "content": 1.0}).collect() for i in (asked, stored))
        assert found and sorted(map(str, found)) == sorted(map(str, want))
    assert len(asked.counts) == 1
    plan = asked.best(lexical.query_terms(one), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "lengths" in plan and "token" not in plan


def test_prefix_twins_move_heads_of_texts(tables):
    """Of a text joined to hits only the compared head is shuffled; before, the whole text was."""
    long = "x" * 1000
    head = tables.spark.createDataFrame([(1, long)], "id long, content string").select(ranking.twin_head()).first()
    assert head.content == long[:150]


@pytest.mark.parametrize("sent", [term_index.SENT, 1])
def test_fields_of_another_table_meet_as_counts(spark, monkeypatch, sent):
    """Fields beside the texts give the counts and hits of a table joined before."""
    monkeypatch.setattr(term_index, "SENT", sent)
    docs = docs_of(spark, {"d0": ("w1 w2 w1", "ada w1"), "d1": ("w9", None), "d2": ("", None), "d3": ("W2 w3", "w1"), "d4": ("w1", "")})
    beside = docs.where("names is not null").select("id", "names")
    apart = AskedWords(docs.drop("names"), scratch_path(spark, "t"), {"entities": "names", "content": "content"}, beside)
    whole = AskedWords(docs, scratch_path(spark, "t"), FIELDS)
    terms = lexical.query_terms(spark.createDataFrame([(1, "w1 ada w2"), (2, "w9")], "query_id long, text string"))
    found, want = (sorted(map(str, i.best(terms, 4, weights={"content": 1.0, "entities": 0.5}).collect())) for i in (apart, whole))
    assert found == want
    for table in ("texts", "term_df", "totals"):
        got, should = (sorted(map(str, i._read(table).collect())) for i in (apart, whole))
        assert got == should or (sent == 1 and table != "totals")  # numbers of words are dealt anew there


def test_names_in_texts_shuffle_neither_texts_nor_their_words(tables):
    """The dictionary goes to the texts; before, every word of every text went to it, and whole texts to their names."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    spark = tables.spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = entities.entity_matches(tables.chunks, spark.createDataFrame([("ada l", "Ada", "Person")], "alias string, name string, entity_type string"))
        assert plan(found).count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "entity_names" not in tables.fielded_index.rows.columns and "Join" not in plan(tables.fielded_index.rows)


def test_names_and_triples_as_text(spark):
    found = spark.createDataFrame([("d1", "b"), ("d1", "a"), ("d1", "a"), ("d2", "c"), ("d3", "x")], "id string, name string")
    relations = spark.createDataFrame([("a", "uses", "b"), ("c", "uses", "a"), ("a", "uses", "a"), (None, "uses", "c")], "subject string, relation string, object string")
    got = {r.id: (r.entity_names, r.relation_triples) for r in entities.names_of(found, relations).collect()}
    assert got == {"d1": ("a b", "a uses a a uses b c uses a"), "d2": ("c", "c uses a uses c"), "d3": ("x", "")}


def test_postings_stay_where_they_are_when_ids_are_deleted(spark, monkeypatch):
    """Few deleted ids go to every task, whatever the planner thinks of their size; before, all postings were shuffled to meet them."""
    rng = random.Random(5)
    index = TermIndex.create(docs_of(spark, {f"d{i}": (words(rng, 9), "") for i in range(40)}), scratch_path(spark, "t"))
    index.apply(removed=spark.createDataFrame([("d1",), ("d2",)], "id string"))
    monkeypatch.setattr(term_index, "GONE", 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda: index.postings._jdf.queryExecution().toString()
        assert "SortMergeJoin" not in plan() and index.postings.select("id").distinct().count() == 38
        monkeypatch.setattr(term_index, "GONE", 1)
        assert "SortMergeJoin" in plan() and index.postings.select("id").distinct().count() == 38
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_of_a_row_are_counted_where_it_is(spark):
    """Each (field, token) once a row, with the words of its field; texts without words and missing ones are rows too."""
    rows = {"d1": ("b a b", "ada"), "d2": ("", None), "d3": (None, "a a"), "d4": ("...", "")}
    index = TermIndex.create(docs_of(spark, rows), scratch_path(spark, "t"), FIELDS)
    got = sorted((r.id, r.field, r.token, r.dl, r.tf) for r in index.postings.collect())
    assert got == [("d1", "content", "a", 3, 1), ("d1", "content", "b", 3, 2), ("d1", "entities", "ada", 1, 1), ("d3", "entities", "a", 2, 2)]
    assert {r.id: (r.lengths, len(r.words)) for r in index.docs.collect()} == {
        "d1": ({"content": 3, "entities": 1}, 3), "d2": ({"content": 0, "entities": 0}, 0), "d3": ({"content": 0, "entities": 2}, 1), "d4": ({"content": 0, "entities": 0}, 0)}
