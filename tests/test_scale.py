"""Nothing is cut: long chains, cycles, streams of many batches, decoys before the cut; and where files may go."""

import types

import pytest
from pyspark.sql import functions as F

from recallgrid import session
from recallgrid.operators import graph, links
from recallgrid.operators.components import components
from recallgrid.operators.similarity import nearest
from recallgrid.plans import hybrid, lifecycle as lc, packs
from recallgrid.sources import chunk_store
from recallgrid.streaming import jobs


NOW = 1706659200


def test_long_chains_and_cycles_come_whole(spark):
    rows = [(f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(120)] + [("x1", "x3"), ("x2", "x1"), ("x3", "x2"), ("tail", "x1"), ("lone", "gone")]
    chunks = spark.createDataFrame(rows, "id string, supersedes_id string")
    got = links.version_chain(chunks, chunks).collect()
    chain = lambda start: [r.id for r in sorted((r for r in got if r.start_id == start), key=lambda r: r.pos)]
    assert chain("c119") == chain("c000") == [f"c{i:03d}" for i in range(120)]
    assert chain("x2") == chain("tail") == ["tail", "x1", "x2", "x3"] and chain("lone") == ["lone"]
    assert len(got) == 120 * 120 + 4 * 4 + 1


def test_components_run_to_the_fix_point(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    got = components(spark.createDataFrame(path, "a long, b long"), spark.range(201).withColumnRenamed("id", "node")).collect()
    assert {r.root for r in got} == {0} and len(got) == 201


def test_every_row_of_a_stream_is_in_a_batch(spark, tables):
    one = tables.chunks.withColumn("stream", F.lit("s")).withColumn("level", F.lit(0)).withColumn("consolidated", F.lit(False)).withColumn(
        "in_progress", F.lit(False)).withColumn("dormant", F.lit(False)).withColumn("deleted_at", F.lit(None).cast("long"))
    ready = chunk_store.in_batches(chunk_store.consolidation_eligible(one, NOW), 30)
    sizes = {r.batch: r.n for r in ready.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    total = ready.count()
    assert len(sizes) == -(-total // 30) > 3 and sum(sizes.values()) == total and max(sizes.values()) == 30
    _, after, report = lc.consolidate(one, tables.vectors, NOW, batch=30)
    assert sum(report.head()) == total


def test_decoys_of_others_take_no_place(spark, tables):
    base = tables.chunks.where("deleted_at is null").limit(1)
    text = "zebra quartz nimbus"

    def row(i, stream, agent):
        return base.withColumn("id", F.lit(i)).withColumn("content", F.lit(text)).withColumn("stream", F.lit(stream)).withColumn(
            "is_latest", F.lit(True)).withColumn("source", F.col("source").withField("agent", F.lit(agent)))

    decoys = row("d", "other", "mcp").drop("id").crossJoin(spark.range(80).select(F.format_string("a%03d", "id").alias("id"))).select(*base.columns)
    chunks = decoys.unionByName(row("z1", "mine", "api")).unionByName(row("z2", "mine", "mcp"))
    vectors = chunks.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    queries = spark.createDataFrame([(1, text, "mine")], "query_id long, text string, stream string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")

    def ids(**more):
        h = hybrid.hybrid_search(queries, asked, chunks, vectors, NOW, 5, prefix_dedup=False, **more)
        return [r.id for r in h.orderBy("rank").collect()]

    assert sorted(ids(by_stream=True)) == ["z1", "z2"]
    assert ids(agent="api") == ["z1"] == ids(exclude_agents=["mcp"]) == ids(by_stream=True, agent="api")
    graph = chunks.select(F.lit(1).cast("long").alias("query_id"), "id", F.lit(0.9).alias("graph"))
    assert set(ids(by_stream=True, graph_scores=graph)) == {"z1", "z2"}


def test_a_left_side_called_small_must_be(spark, monkeypatch):
    from recallgrid.operators import similarity

    monkeypatch.setattr(similarity, "MAX_BROADCAST_ROWS", 3)
    v = spark.range(5).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(ValueError, match="small_left"):
        nearest(v, v, 1, left_key="id", small_left=True)


def test_no_local_folder_on_a_cluster():
    def fake(master, named):
        conf = types.SimpleNamespace(get=lambda key, default=None: named)
        return types.SimpleNamespace(sparkContext=types.SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: conf))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("yarn", None))
    with pytest.raises(ValueError):
        session.shared_folder(fake("local-cluster[2,1,1024]", None))
    assert session.shared_folder(fake("yarn", "hdfs://here/x/")) == "hdfs://here/x"
    assert session.shared_folder(fake("local[4]", None)).startswith("/tmp/spark-")




def test_related_rows_need_no_distinct_evidence(spark, monkeypatch):
    """One hop from the questions' entities reads the evidence as it is; before, the whole graph was made distinct first."""
    rows = [("S1", "P1", "d1"), ("S1", "P1", "d1"), ("S2", "P1", "d2"), ("S3", "P2", "d3"), ("S1", "P3", "d4"), ("S3", "P2", "d3")]
    raw = spark.createDataFrame(rows, "source string, target string, chunk_id string").selectExpr("*", "'uses' as relation", "1L as evidence")
    starts = spark.createDataFrame([(1, "S1"), (2, "P2")], "query_id long, entity_id string")
    want = {(1, "d1", 1.0), (1, "d4", 1.0), (1, "d2", 0.5), (2, "d3", 1.0)}
    for sent in (graph.SENT, 0):
        monkeypatch.setattr(graph, "SENT", sent)
        found = graph.related_chunks(starts, raw, graph.evidence_rows(raw), hops=1)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sorted(map(tuple, graph.related_chunks(starts, raw.distinct(), graph.evidence_table(raw), hops=1).collect())) == sorted(want)


def test_two_hops_by_bits_need_no_distinct_evidence(spark, monkeypatch):
    """Queries of several blocks of bits, evidence that comes twice, both joins; before, repeated rows needed a distinct graph and every pair met once an entity."""
    rows = [(f"S{i % 9}", f"P{i * 7 % 23}", f"d{i % 40}") for i in range(60)] * 2
    raw = spark.createDataFrame(rows, "source string, target string, chunk_id string").selectExpr("*", "'uses' as relation", "1L as evidence")
    starts = [(q, e) for q in range(150) for e in ([f"S{q % 11}"] if q % 3 else [f"P{q % 23}", f"S{q % 9}"])]
    near = {}
    for s, p, _ in rows:
        near.setdefault(s, set()).add(p), near.setdefault(p, set()).add(s)
    want = {}
    for q, e in starts:
        hop1 = near.get(e, set())
        hop2 = set().union(*(near[v] for v in hop1)) - hop1 - {e} if hop1 else set()
        for w, reached in ((1.0, {e}), (0.5, hop1), (0.25, hop2)):
            for s, p, d in rows:
                if s in reached or p in reached:
                    want[q, d] = max(want.get((q, d), 0), w)
    asked = spark.createDataFrame(starts, "query_id long, entity_id string")
    monkeypatch.setattr(graph, "WORDS", 1)
    for sent in (graph.SENT, 0):
        monkeypatch.setattr(graph, "SENT", sent)
        got = graph.related_chunks(asked, raw, graph.evidence_rows(raw)).collect()
        assert {(r.query_id, r.id): r.graph for r in got} == want and len(got) == len(want)


def test_gaps_meet_by_time_not_by_stream_alone(spark):
    """A stream's searches meet the stores of two time buckets; before, all of the stream's. Edges of buckets, whole seconds and times before 1970 among them."""
    secs = [-250.5, -130.2, -120.0, -10.9, 0.0, 0.4, 0.9, 1.0, 119.9, 120.0, 120.5, 121.0, 240.99, 241.0, 359.0, 360.0]
    rows = [(i, s, f"s{i % 2}", kind, 0) for i, (s, kind) in enumerate((s, kind) for s in secs for kind in ("search", "store", "search", "store", "store"))]
    events = spark.createDataFrame(rows, "event_id long, at double, stream string, type string, result_count int").withColumn("ts", F.timestamp_micros((F.col("at") * 1000000).cast("long")))
    found = jobs.gap_filled(events, events)
    whole = lambda s: int(s // 1)
    want = sorted((i, s, t) for i, s, st, k, _ in rows if k == "search" for _, t, st2, k2, _ in rows if k2 == "store" and st == st2 and 0 < whole(t) - whole(s) <= 120)
    got = found.select("event_id", F.unix_micros("search_ts") / 1e6, F.unix_micros("store_ts") / 1e6).collect()
    assert sorted((a, round(b, 3), round(c, 3)) for a, b, c in got) == want and want
    join = next(line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line)
    assert "store_bucket" in join.split("Inner")[0]


@pytest.mark.parametrize("n", [1, 3])
def test_vectors_without_clusters_meet_in_coarse_blocks(spark, monkeypatch, n):
    """Where no pair of blocks can be left out, a row is sent to a few large blocks; before, to every small one. Ties by id, no row twice."""
    import numpy as np
    from recallgrid.operators import similarity

    rng = np.random.default_rng(4)
    vecs = np.round(rng.normal(size=(240, 24)), 2)
    vecs[200:] = vecs[:40]  # ties
    rows = [(f"d{i}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    calls = []
    every = similarity._every_pair
    monkeypatch.setattr(similarity, "_every_pair", lambda *a: calls.append(a[4]) or every(*a))
    got = nearest(v, v, n, left_key="id", exclude_self=True, block_rows=8).collect()
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    want = {(f"d{i}", f"d{j}") for i in range(240) for j in sorted((j for j in range(240) if j != i), key=lambda j: (-sims[i, j], f"d{j}"))[:n]}
    assert calls and calls[0] > 8
    assert {(r.id, r.other_id) for r in got} == want and len(got) == 240 * n


def test_whole_texts_are_not_shuffled_for_snippets(spark, tables):
    """A text is cut to its snippet before it meets its hits; before, all texts were shuffled whole, twice."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = packs.ambient(packs.last_user_turns(tables.turns), tables.chunks, NOW, index=tables.index)
        nodes = [got._jdf.queryExecution().executedPlan()]
        for node in nodes:
            nodes.extend(node.children().apply(i) for i in range(node.children().size()))
        dealt = [{n.output().apply(i).name() for i in range(n.output().size())} for n in nodes if n.nodeName() == "Exchange"]
        assert any("snippet" in names for names in dealt) and not any("content" in names for names in dealt)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
