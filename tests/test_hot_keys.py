"""One key with a third of all rows or more: walks from hubs, chains of one target, against plain loops."""

import hashlib
import random

from pyspark.sql import functions as F

from recallgrid.operators import association
from recallgrid.operators.ranking import spread_sums
from recallgrid.sources import event_log


def plain_walk(sym, seed, walk, hops=3):
    at, path, done = seed, [seed], 0
    for hop in range(1, hops + 1):
        step = walk * hops + hop
        draw = (walk + step) * 2654435761 % 1000 / 1000
        near = [(o, w) for o, w in sorted(sym.get(at, {}).items()) if o not in path]
        if step > 20 or not near:
            break
        total, cum = sum(w for _, w in near), 0.0
        for o, w in near:
            cum += w
            if round(cum, 9) >= round(draw * total, 9):
                at, path, done = o, [*path, o], hop
                break
    return at, done


def test_walks_over_a_hub(spark, monkeypatch):
    monkeypatch.setattr(association, "DRAW_BLOCK", 7)
    rng = random.Random(4)
    edges = [("hub", f"n{i:03d}", rng.randrange(1, 6)) for i in range(120)]
    edges += [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}", rng.randrange(0, 9)) for _ in range(150)] + [("a", "b", 1)]
    edges = [(a, b, e) for a, b, e in edges if a != b]
    sym = {}
    for a, b, e in edges:
        for x, y in ((a, b), (b, a)):
            sym.setdefault(x, {})[y] = max(sym.get(x, {}).get(y, 0), 1 / max(1, e))
    seeds = [(q, s) for q, s in enumerate(["hub", "a", "b", "n000", "n007", "n119", "nobody"])]
    df = spark.createDataFrame([("g", a, b, "r", e) for a, b, e in edges], "stream string, source string, target string, relation string, evidence long")
    got = association.weak_tie_walks(spark.createDataFrame(seeds, "query_id long, entity_id string"), df, walks=4).collect()
    assert {(r.query_id, r.walk): (r.terminal, r.hops) for r in got} == {(q, w): plain_walk(sym, s, w) for q, s in seeds for w in range(4)}


def test_chain_of_one_hot_target(spark):
    rows = [("hot" if i % 3 else f"t{i % 7}", i // 2, i, f"body {i}") for i in range(900)]
    chained = event_log.chain(spark.createDataFrame(rows, "target string, ts long, seq long, body string")).collect()
    edited = {402, 644}
    broken = [(r.target, r.ts, r.seq, r.prev_hash if r.seq != 88 else None, ("x" if r.seq in edited else "") + r.blob) for r in chained]
    df = spark.createDataFrame(broken, "target string, ts long, seq long, prev_hash string, blob string").repartition(5)
    want = {}
    for t in {r[0] for r in broken}:
        own, entered, breaks, n = sorted((r for r in broken if r[0] == t), key=lambda r: r[1:3]), False, [], 0
        for i, r in enumerate(own):
            if i and (r[3] is not None and r[3] != hashlib.sha256(own[i - 1][4].encode()).hexdigest() or r[3] is None and entered):
                breaks.append(i)
            n += i > 0 and r[3] is not None
            entered |= i > 0 and r[3] is not None
        want[t] = (min(breaks, default=None), n, len(own))
    got = {r.target: (r.first_break, r.chained, r.n_rows) for r in event_log.verify_chain(df).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) >= 2


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [("k" if i % 2 else f"k{i % 5}", i, rng.randrange(9)) for i in range(500)]
    got = spread_sums(spark.createDataFrame(rows, "key string, at long, n long"), "key", [F.desc("at")], {"run": F.col("n")}).collect()
    for k in {r[0] for r in rows}:
        run = 0
        for place, (_, at, n) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]), 1):
            run += n
            assert [(r.pos, r.run) for r in got if r.key == k and r["at"] == at] == [(place, run)]


def test_trigger_fires_alike_however_rows_arrive(spark, tmp_path):
    """In one file, or in files whose rows overlap by half an hour: the same fires, those of a plain loop."""
    from recallgrid.catalog.streams import on_rocks
    from recallgrid.streaming import jobs

    rng = random.Random(7)
    rows = [(f"s{rng.choice([0, 0, 0, 1, 2])}", rng.randrange(12 * 3600), i, rng.randrange(5)) for i in range(600)] + [("s9", 15 * 3600, 999, 0)]
    want = []
    for stream in sorted({r[0] for r in rows}):
        pending, last = 0, -1
        for _, sec, event, n in sorted((r for r in rows if r[0] == stream and r[1] < 14 * 3600), key=lambda r: r[1:3]):
            pending += n
            if pending >= 12 and (last < 0 or sec - last >= 3600):
                want.append((stream, sec, event))
                pending, last = 0, sec
    schema = "stream string, sec long, event_id long, n long"
    for parts in (1, 5):
        folder = str(tmp_path / f"in{parts}")
        part = [min(parts - 1, max(0, (r[1] + rng.randrange(-1800, 1800)) * parts // (13 * 3600))) for r in rows]
        for p in range(parts):
            mine = [r for r, at in zip(rows, part) if at == p]
            spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(folder)
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_seconds("sec"))
        out = str(tmp_path / f"out{parts}")
        on_rocks(spark, lambda: jobs.run_to_table(jobs.ordered_trigger(s, 12, 3600), f"{out}/rows", f"{out}/state"))
        assert sorted(map(tuple, spark.read.parquet(f"{out}/rows").collect())) == sorted(want)


def test_many_stars_of_one_family_are_few_pairs(spark):
    """A family's members have many smallest nodes, one a bucket: each member is linked once, not once a bucket."""
    from recallgrid.llm.hamming_join import _contracted
    from recallgrid.operators.components import components

    stars = [(100 + i, low) for i in range(40) for low in range(10)] + [(500, 400), (501, 500), (501, 400)]
    pairs = _contracted(spark.createDataFrame(stars, "a long, b long"))
    got = {r.node: r.root for r in components(pairs, pairs.selectExpr("explode(array(a, b)) as node").distinct()).collect()}
    assert got == {**{n: 0 for n in [*range(10), *range(100, 140)]}, **{n: 400 for n in (400, 500, 501)}}
    assert pairs.count() == 40 + 9 + 2 < len(stars)
