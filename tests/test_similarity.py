"""Nearest neighbours, clustering and grouping against plain numpy loops."""

import numpy as np
from pyspark.sql import functions as F

from recallgrid.operators import association, clustering, similarity
from recallgrid.operators.similarity import nearest
from recallgrid.plans import lifecycle as lc

NOW = 1706659200


def cos(a, b):
    d = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(a @ b / d), 6) if d and len(a) == len(b) else 0.0


def vectors(n, dim=6, seed=1):
    g = np.random.default_rng(seed)
    return [(f"v{i}", f"s{i % 3 if i % 4 else 0}", None if i % 5 == 0 else f"x{i % 2}", g.normal(size=dim).tolist()) for i in range(n)]


DDL = "id string, stream string, subject string, embedding array<double>"


def brute(left, right, n, floor, loose):
    out = {}
    for lid, ls, lsub, lv in left:
        hits = [(-cos(np.array(lv), np.array(rv)), rid) for rid, rs, rsub, rv in right
                if rs == ls and rid != lid and (not loose or lsub is None or rsub is None or lsub == rsub)]
        out[lid] = [(i, -s) for s, i in sorted(hits) if -s >= floor][:n]
    return out


def as_dict(df, key="id", other="other_id"):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append((r[other], r["sim"]))
    return out


def test_both_paths_equal_brute_force(spark):
    rows = vectors(60)
    df = spark.createDataFrame(rows, DDL)
    for loose in ([], ["subject"]):
        want = {k: v for k, v in brute(rows, rows, 3, 0.1, bool(loose)).items() if v}
        for small in (True, False):
            got = nearest(df, df, 3, left_key="id", on=["stream"], loose=loose, min_sim=0.1, exclude_self=True,
                          small_left=small, block_rows=7)
            assert as_dict(got) == want


def test_blocks_left_out_hold_no_neighbour(spark, monkeypatch):
    """Clustered vectors: most pairs of blocks are never sent, and the result is that of all pairs."""
    monkeypatch.setattr(similarity, "PIVOT_BLOCKS", 1)
    g = np.random.default_rng(5)
    centres = g.normal(size=(12, 8)) * 4
    rows = [(f"v{i}", f"s{i % 2 if i % 3 else 0}", f"x{i % 2}", (centres[i % 12] + g.normal(size=8) * 0.2).tolist()) for i in range(300)]
    rows += [("zero", "s0", "x0", [0.0] * 8), ("short", "s0", "x1", [1.0, 2.0])]
    asked = [r for r in rows if r[0] in ("zero", "short") or int(r[0][1:]) % 4 == 0]
    seen = []
    real = similarity.block_pairs
    monkeypatch.setattr(similarity, "block_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    df, few = spark.createDataFrame(rows, DDL), spark.createDataFrame(asked, DDL)
    for floor in (None, 0.1):
        got = nearest(few, df, 3, left_key="id", on=["stream"], min_sim=floor, exclude_self=True, block_rows=10)
        assert as_dict(got) == {k: v for k, v in brute(asked, rows, 3, -2 if floor is None else floor, False).items() if v}
    kept, total = seen[0].where("kept").count(), seen[0].count()
    assert 0 < kept < 0.5 * total


def test_closest_angle(spark):
    g = np.random.default_rng(6)
    p, q, x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in g.normal(size=(4, 400, 3)))
    far = lambda a, b: np.arccos(np.clip((a * b).sum(axis=1), -1, 1))
    rows = [tuple(map(float, r)) for r in zip(far(p, q), far(x, p), far(y, q), far(x, y))]
    df = spark.createDataFrame(rows, "apart double, l double, r double, real double")
    got = df.select("real", similarity.closest_angle(F.col("apart"), F.col("l"), F.col("l"), F.col("r"), F.col("r")).alias("least")).collect()
    assert all(r.least <= r.real + 1e-9 for r in got) and any(r.least > 0.9 * r.real for r in got)


def test_zero_and_mismatched_vectors_score_zero(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [2.0, 0.0])], "id string, embedding array<double>")
    got = {r["id"]: r["sim"] for r in nearest(q, v, 5).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 1.0}


def chunk_rows(spark, rows):
    return spark.createDataFrame([(i, s, True, None) for i, s, _, _ in rows], "id string, stream string, is_latest boolean, deleted_at long")


def plain_kmeans(vs, k, rounds=100):
    x = [v / np.linalg.norm(v) for v in vs]
    step = max(1, len(vs) // k)
    cents = [vs[min(i * step, len(vs) - 1)] for i in range(k)]
    was = None
    for _ in range(rounds):
        a = [int(np.argmax([round(float(v @ (c / np.linalg.norm(c))), 9) for c in cents])) for v in x]
        if a == was:
            break
        was = a
        for c in range(k):
            mine = [v for v, g in zip(vs, a) if g == c]
            if mine:
                m = np.mean(mine, axis=0)
                cents[c] = m / np.linalg.norm(m)
    return was


def test_kmeans_of_all_streams_equals_one_by_one(spark, monkeypatch):
    rows = vectors(48, seed=4) + [("z1", "tiny", None, [1.0] * 6), ("z2", "tiny", None, [2.0] * 6)]
    vec = spark.createDataFrame(rows, DDL).select("id", "embedding")
    want = {}
    for s in ("s0", "s1", "s2"):
        mine = sorted((i, np.array(v)) for i, st, _, v in rows if st == s)
        k = min(len(mine), max(2, min(50, int(np.ceil(np.sqrt(len(mine) / 2))))))
        for (i, _), c in zip(mine, plain_kmeans([v for _, v in mine], k)):
            want[i] = c
    for limit in (clustering.MAX_BROADCAST_NUMBERS, 0):
        monkeypatch.setattr(clustering, "MAX_BROADCAST_NUMBERS", limit)
        a, c = clustering.cluster_streams(vec, chunk_rows(spark, rows))
        assert {r["id"]: r["cluster"] for r in a.collect()} == want
        assert c.where("stream = 'tiny'").count() == 0


def test_topic_groups_follow_the_running_centroid(spark):
    rows = vectors(30, dim=3, seed=9)
    batch = spark.createDataFrame([(i, s, n // 2, 0) for n, (i, s, _, _) in enumerate(rows)] + [("lone", "s0", 0, 0)], "id string, stream string, timestamp long, batch long")
    vec = spark.createDataFrame(rows, DDL).select("id", "embedding")
    got = {r["id"]: r["grp"] for r in lc.topic_groups(batch, vec, 0.3).collect()}
    want = {"lone": -1}
    for s in ("s0", "s1", "s2"):
        cents, sizes = [], []
        for _, i, v in sorted((n // 2, i, v) for n, (i, st, _, v) in enumerate(rows) if st == s):
            v = np.array(v)
            sims = [cos(c, v) for c in cents]
            if sims and max(sims) >= 0.3:
                g = int(np.argmax(sims))
                sizes[g] += 1
                cents[g] = (cents[g] * (sizes[g] - 1) + v) / sizes[g]
            else:
                g = len(cents)
                cents.append(v)
                sizes.append(1)
            want[i] = g
    assert got == want


def test_consolidation_merges_groups_of_three(spark, tables):
    merged, after, report = lc.consolidate(tables.chunks, tables.vectors, NOW, threshold=-1.0)
    ready = {r["id"]: r for r in tables.chunks.where(
        "level = 0 and not consolidated and not in_progress and not dormant and deleted_at is null").select("id", "stream", "timestamp").collect()}
    with_vec = {r["id"] for r in tables.vectors.select("id").collect()}
    groups = {}
    for r in ready.values():
        if NOW - r["timestamp"] >= 60:
            groups.setdefault((r["stream"], r["id"] in with_vec), []).append(r)
    big = [g for g in groups.values() if len(g) >= 3]
    rows = merged.collect()
    assert sorted(sorted(r["source_ids"]) for r in rows) == sorted(sorted(x["id"] for x in g) for g in big)
    spans = {frozenset(r["source_ids"]): (r["valid_from"], r["valid_until"]) for r in rows}
    for g in big:
        ts = [x["timestamp"] for x in g]
        assert spans[frozenset(x["id"] for x in g)] == (min(ts), max(ts))
    used = {i for r in rows for i in r["source_ids"]}
    marked = {r["id"] for r in after.where("consolidated").select("id").collect()}
    before = {r["id"] for r in tables.chunks.where("consolidated").select("id").collect()}
    assert marked == before | used
    assert report.head()["consolidated"] == len(used)


def test_latent_discovery_on_a_small_graph(spark):
    ids = ["a", "b", "c", "d"]
    emb = {"a": [1.0, 0.0], "b": [0.8, 0.6], "c": [0.0, 1.0], "d": [0.6, 0.8]}
    chunks = spark.createDataFrame([(i, "s", True, None, "some longer text", ("api", None, None)) for i in ids],
                                   "id string, stream string, is_latest boolean, deleted_at long, content string, source struct<agent:string,session:string,channel:string>")
    vec = spark.createDataFrame(list(emb.items()), "id string, embedding array<double>")
    cl = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "id string, cluster int")
    cn = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster int, centroid array<double>")
    edges = spark.createDataFrame([("g", "E1", "E2", "uses", 1)], "stream string, source string, target string, relation string, evidence long")
    ec = spark.createDataFrame([("E1", "a"), ("E1", "b"), ("E2", "c"), ("E2", "d")], "entity_id string, chunk_id string")
    got = association.discover_latents(chunks, vec, cl, cn, edges, ec, min_score=0.01).collect()
    first = lambda names: min(names, key=lambda i: __import__("hashlib").md5(i.encode()).hexdigest())
    seeds = {first(["a", "b"]): 0, first(["c", "d"]): 1}
    want = {}
    for s, c in seeds.items():
        for tgt in ids:
            # one hop reaches the other entity and the walk ends there
            if (tgt in ("c", "d")) == (c == 0):
                r = max(0.0, cos(np.array(emb[s]), np.array(emb[tgt])))
                score = round(r * (1 - r) * 1.0, 6)
                if score >= 0.01:
                    want[(s, tgt)] = score
    assert {(r["source"], r["target"]): r["score"] for r in got} == want
