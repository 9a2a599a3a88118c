"""Literal cases of single rules."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import advisories, annotate, filters, links, ranking, resolution, textjobs as tx
from recallgrid.plans import lifecycle as lc, packs
from recallgrid.sources import dictionary, event_log

NOW = 1706659200
DAY = 86400


@pytest.mark.parametrize("new", [None, "a1", "a2", "b"])
def test_trust_matrix(spark, new):
    rank = {None: 3, "a1": 3, "a2": 2, "b": 1}
    olds = [None, "a1", "a2", "b"]
    chunks = spark.createDataFrame([(f"o{i}", "s", o, True, 1, None, None, 0) for i, o in enumerate(olds)],
                                   "id string, stream string, trust_level string, is_latest boolean, version long, root_memory_id string, superseded_by string, updated_at long")
    prop = spark.createDataFrame([(f"n{i}", f"o{i}", new) for i in range(4)], "new_id string, old_id string, new_trust string")
    after, made, blocked = lc.supersede(chunks, prop, NOW)
    applied = {r["old_id"] for r in made.collect()}
    assert applied == {f"o{i}" for i, o in enumerate(olds) if rank[new] >= rank[o]}
    assert {r["id"] for r in after.where("not is_latest").collect()} == applied
    assert {r["old_id"] for r in blocked.collect()} == {f"o{i}" for i in range(4)} - applied
    assert all(r["version"] == 2 and r["root_memory_id"] == r["old_id"] for r in made.collect())


def test_release_window(spark):
    ages = [29, 30, 31, 45, 90]
    c = spark.createDataFrame([(str(a), NOW - a * DAY) for a in ages], "id string, deleted_at long")
    assert sorted(r["id"] for r in lc.expired_ids(c, NOW).collect()) == ["30", "31", "45", "90"]


def test_purge_leaves_nothing(spark):
    t = {"chunks": spark.createDataFrame([("x",), ("y",)], "id string"), "vectors": spark.createDataFrame([("x",)], "id string"),
         "entity_chunk": spark.createDataFrame([("E", "x"), ("E", "y")], "entity_id string, chunk_id string")}
    ids = spark.createDataFrame([("x",)], "id string")
    after = lc.purge(t, ids)
    assert [r["n"] for r in lc.residue(after, ids).collect()] == [0, 0, 0]
    assert after["chunks"].count() == 1 and after["entity_chunk"].count() == 1 and after["vectors"].count() == 0
    assert lc.residue(t, ids).where("n = 0").count() == 0


def test_soft_delete_is_idempotent(spark):
    one = lambda ddl, rows: spark.createDataFrame(rows, ddl)
    t = {"chunks": one("id string, deleted_at long", [("x", None), ("y", 5)]), "postings": one("id string", [("x",)]),
         "vectors": one("id string", [("x",)]), "entity_chunk": one("entity_id string, chunk_id string", [("E", "x")])}
    ids = one("id string", [("x",), ("y",)])
    once = lc.soft_delete(t, ids, NOW)
    twice = lc.soft_delete(once, ids, NOW + 9)
    assert {r["id"]: r["deleted_at"] for r in twice["chunks"].collect()} == {"x": NOW, "y": 5}
    assert once["postings"].count() == once["vectors"].count() == once["entity_chunk"].count() == 0


def test_person_alias_and_resolution(spark):
    rows = [("1", "Person", "s", "Anna", 10), ("2", "Person", "s", "Anna Kowalska", 20), ("3", "Person", "s", "Joanna Kowalska", 30),
            ("4", "Place", "s", "Anna", 5), ("5", "Person", "t", "Anna", 1)]
    e = spark.createDataFrame(rows, "entity_id string, entity_type string, stream string, name string, created_at long")
    assert [(r["entity_id"], r["alias_of"]) for r in links.person_aliases(e).collect()] == [("2", "1")]
    m = e.withColumn("mention_id", F.col("entity_id")).withColumn("chunk_id", F.col("entity_id"))
    got = {r["mention_id"]: r["entity_id"] for r in resolution.resolve(m).collect()}
    assert got["1"] == got["2"] and len({got[i] for i in "1345"}) == 4


def test_components_of_a_long_chain(spark):
    n = 40
    pairs = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(n - 1)], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(n)] + [("z",)], "node string")
    got = {r["node"]: r["root"] for r in resolution.components(pairs, nodes).collect()}
    assert set(got.values()) == {"n00", "z"} and got["n39"] == "n00"


def test_relation_labels(spark):
    d = spark.createDataFrame([("works_at",), (" USES ",), ("works_at_tantrum",), ("",)], "raw string")
    assert [r[0] for r in d.select(annotate.relation_label(F.col("raw"))).collect()] == ["works_at", "uses", "related_to", "related_to"]


def test_rank_fusion_gives_an_empty_channels_weight_away(spark):
    p = spark.createDataFrame([(1, "a", 0.9, 0.0), (1, "b", 0.5, 0.0), (1, "c", 0.5, 0.0)], "query_id int, id string, dense double, lexical double")
    got = {r["id"]: (r["dense_rank"], r["lexical_rank"], r["rrf"]) for r in ranking.rrf(p, {"dense": F.lit(0.35), "lexical": F.lit(0.35)}).collect()}
    assert got == {"a": (1, None, round(1 / 61, 8)), "b": (2, None, round(1 / 62, 8)), "c": (3, None, round(1 / 63, 8))}


def test_prefix_twins(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(1, "a", 1, base + " today"), (1, "b", 2, base + " again"), (1, "c", 3, "short text"), (1, "d", 4, "short text"), (1, "e", 5, "something else entirely, long enough to count")]
    p = spark.createDataFrame(rows, "query_id int, id string, rank int, content string")
    assert sorted(r["id"] for r in ranking.drop_prefix_twins(p).collect()) == ["a", "c", "d", "e"]


def test_dates_against_an_anchor(spark):
    cases = {"2026-04-01": "2026-04-01", "5.03.2024": "2024-03-05", "2024/3/7": "2024-03-07", "3 days ago": "2026-05-08", "2 weeks ago": "2026-04-27",
             "2 months ago": "2026-03-11", "last friday": "2026-05-08", "last monday": "2026-05-04", "w zeszłym tygodniu": "2026-05-04",
             "w zeszłą środę": "2026-05-06", "last month": "2026-04-01", "jutro": "2026-05-12", "march 5": "2026-03-05", "12 grudnia": "2025-12-12",
             "december 24, 2022": "2022-12-24", "31 feb": None, "31.02.2024": None, "soon": None}
    d = spark.createDataFrame([(k, dt.date(2026, 5, 11)) for k in cases], "raw string, anchor date")
    got = {r["raw"]: r["resolved"] and str(r["resolved"]) for r in annotate.resolve_dates(d, "raw", "anchor").collect()}
    assert got == cases


def test_validity_is_inclusive(spark):
    rows = [("open", None, None), ("touch_lo", 100, None), ("touch_hi", 1, 100), ("before", 1, 99), ("after", 101, None)]
    c = spark.createDataFrame(rows, "id string, valid_from long, valid_until long")
    assert sorted(r["id"] for r in c.where(filters.valid_at(F.lit(100))).collect()) == ["open", "touch_hi", "touch_lo"]


def test_oscillation(spark):
    rows = [("s", NOW - 4 * DAY + i, v) for i, v in enumerate([0.05, -0.05, 0.05, -0.05])] + [("t", NOW, 1.0), ("t", NOW - 1, -1.0)]
    rows += [("u", NOW - 30 * DAY + i, v) for i, v in enumerate([1.0, -1.0, 1.0, -1.0])]
    got = advisories.oscillation(spark.createDataFrame(rows, "stream string, ts long, value double"), NOW).collect()
    assert [(r["stream"], r["changes"], r["freeze_at"]) for r in got] == [("s", 3, 0.0)]


def test_hash_chain(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    batch = spark.createDataFrame([("t", i, i, f"body{i}") for i in range(5)], "target string, ts long, seq long, body string")
    heads = spark.createDataFrame([("t", "earlier")], "target string, last_blob string")
    rows = event_log.chain(batch, heads).orderBy("seq").collect()
    prev = "earlier"
    for r in rows:
        assert r["prev_hash"] == sha(prev)
        prev = r["blob"]
    ddl = "target string, ts long, seq long, body string, prev_hash string, blob string"
    clean = [tuple(r) for r in rows]
    legacy = [("old", 0, 0, "b", None, "L0"), ("old", 1, 1, "b", None, "L1"), ("old", 2, 2, "b", sha("L1"), "L2")]
    gap = [("gap", 0, 0, "b", None, "G0"), ("gap", 1, 1, "b", sha("G0"), "G1"), ("gap", 2, 2, "b", None, "G2")]
    bad = [("bad", *r[1:5], ("edited" if r[2] == 2 else r[5])) for r in clean]
    got = {r["target"]: (r["status"], r["first_break"]) for r in event_log.verify_chain(spark.createDataFrame(clean + legacy + gap + bad, ddl)).collect()}
    assert got == {"t": ("valid", None), "old": ("valid", None), "gap": ("broken", 2), "bad": ("broken", 3)}


def test_repeated_queries_equal_a_plain_loop(spark):
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [("s" if i % 3 else "t", " ".join(rnd.sample(words, rnd.randint(1, 5))), i) for i in range(120)]
    got = {(r["stream"], r["leader"]): r["n"] for r in advisories.repeated_queries(spark.createDataFrame(rows, "stream string, query string, order long"), at_least=1).collect()}
    want = {}
    for stream in "st":
        groups = []
        for s, q, _ in rows:
            if s != stream:
                continue
            for g in groups:
                a, b = set(g[0].split()), set(q.split())
                if len(a & b) / len(a | b) > 0.6:
                    g[1] += 1
                    break
            else:
                groups.append([q, 1])
        want.update({(stream, q): n for q, n in groups})
    assert got == want


def test_version_roots_see_cycles_and_missing_rows(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x")]
    got = {r["id"]: (r["root_id"], r["steps"], r["cyclic"]) for r in links.version_roots(spark.createDataFrame(rows, "id string, supersedes_id string")).collect()}
    assert got == {"a": ("a", 0, False), "b": ("a", 1, False), "c": ("a", 2, False), "d": ("d", 0, False), "x": (None, None, True), "y": (None, None, True)}


def test_redaction(spark):
    cases = {
        "call +48 600 700 800 now": "call [PHONE] now", "600-700-800,601-701-801": "[PHONE],[PHONE]", "id 12345678901.": "id [ID].",
        "x600700800": "x600700800", "6007008001": "6007008001", "a.b+c@mail.example.com!": "[EMAIL]!", "Secret word": "[REDACTED] word",
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in d.select("t", tx.redact(F.col("t"), ["secret"])).collect()} == cases
    m = spark.createDataFrame([({"a@b.com": "600 700 800", "k": "v"},)], "m map<string,string>").select(tx.redact_map(F.col("m")).alias("m")).head()["m"]
    assert m == {"[EMAIL]": "[PHONE]", "k": "v"}


def test_transcript_parts_over_many_blocks(spark):
    rnd = random.Random(3)
    turns = [(c, i, "w" * rnd.randint(0, 37)) for c in range(3) for i in range(40 * (c + 1))]
    got = {(r["conv_id"], r["part"]): r["text"] for r in tx.transcript_parts(spark.createDataFrame(turns, "conv_id long, turn long, text string"), 100, block=7).collect()}
    want = {}
    for c in range(3):
        text, start, n = "\n".join(t for k, _, t in turns if k == c), 0, 0
        while start < len(text):
            want[(c, n)] = text[start:start + 100]
            if start + 100 >= len(text):
                break
            start, n = start + 90, n + 1
    assert got == want


def test_boosts_cool_down(spark):
    hits = [("a", 0, None), ("a", 10, None), ("a", 100, None), ("a", 150, None), ("a", 200, None), ("b", 50, 0), ("b", 99, 0)]
    got = {r["id"]: (r["boosts"], r["last_boost"]) for r in packs.cooled_boosts(spark.createDataFrame(hits, "id string, ts long, last long"), 100).collect()}
    assert got == {"a": (3, 200)}


def test_event_log_files(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "e.jsonl").write_text('{"timestamp": 5, "type": "search", "stream": "s", "top1": 0.5}\n{"timestamp": 6, "ty\n\n')
    (tmp_path / "skip.txt").write_text('{"timestamp": 1, "type": "search"}')
    rows = event_log.read_event_log(spark, str(tmp_path)).collect()
    assert [(r["timestamp"], r["type"], r["top1"]) for r in rows] == [(5, "search", 0.5)]


def test_dictionary_file(spark, tmp_path):
    f = tmp_path / "d.toml"
    f.write_text('Person = ["Anna"]\nrelations = ["Anna|uses|Spark", "broken"]\ngroups = [["a", "B"]]\n[[entity]]\ncanonical = "Spark"\ntype = "Technology"\naliases = ["anna", "spk"]\n')
    d = dictionary.read_dictionary(spark, str(f))
    assert {(r["alias"], r["name"]) for r in d["alias"].collect()} == {("anna", "Anna"), ("spark", "Spark"), ("spk", "Spark")}
    assert [tuple(r) for r in d["relation"].collect()] == [("Anna", "uses", "Spark")]
    assert {tuple(r) for r in d["synonym"].collect()} == {(0, "a"), (0, "b")}


def test_entities_take_the_leftmost_longest(spark):
    from recallgrid.operators.entities import entity_matches
    dic = spark.createDataFrame([("new york", "New York", "Place"), ("york city hall", "Hall", "Place"), ("new", "New", "Concept"), ("hall", "Hall2", "Place")], "alias string, name string, entity_type string")
    docs = spark.createDataFrame([("1", "In New York City Hall, new hall")], "id string, content string")
    assert [r["name"] for r in entity_matches(docs, dic).orderBy("pos").collect()] == ["New York", "Hall2", "New", "Hall2"]


def test_streams_do_not_leak_and_tombstones_stay_out(tables):
    from recallgrid.plans import hybrid
    chunks = {r["id"]: r for r in tables.chunks.select("id", "stream", "deleted_at").collect()}
    q = {r["query_id"]: r["stream"] for r in tables.queries.collect()}
    for r in hybrid.lexical_search(tables.queries, tables.chunks, 10, by_stream=True).collect():
        assert chunks[r["id"]]["stream"] == q[r["query_id"]] and chunks[r["id"]]["deleted_at"] is None


def test_total_row_is_the_sum(tables):
    from recallgrid.operators import stats
    rows = stats.health_with_total(tables.chunks, tables.vectors).collect()
    total = next(r for r in rows if r["stream"] == "_total")
    for c in ("deleted", "superseded", "memories", "l0", "l1", "embedded"):
        assert total[c] == sum(r[c] for r in rows if r["stream"] != "_total")
        assert total["memories"] == total["trust_a1"] + total["trust_a2"] + total["trust_b"]


def test_operator_characters_never_fail_a_search(spark, tables):
    from recallgrid.plans import hybrid
    q = spark.createDataFrame([(1, 'what-is "the" (meaning)? +of: ~x^2 && || [a] {b}')], "query_id long, text string")
    clean = q.withColumn("text", tx.without_operators(F.col("text")))
    a = hybrid.lexical_search(q, tables.chunks, 5).collect()
    assert a == hybrid.lexical_search(clean, tables.chunks, 5).collect()


def test_dictionary_file_with_roles_and_expansions(spark, tmp_path):
    text = """technology = ["Spark"]
relations = ["Ada|likes|Spark", "broken"]
groups = [["meal", "Dinner"]]
[[entity]]
canonical = "Ada Lovelace"
type = "Person"
aliases = ["ada", "spark"]
role = "founder"
expand_with = ["engine", "notes"]
[[entity]]
canonical = "Bob"
"""
    (tmp_path / "d.toml").write_text(text)
    d = dictionary.read_dictionary(spark, str(tmp_path / "d.toml"))
    assert {(r.alias, r.name) for r in d["alias"].collect()} == {("spark", "Spark"), ("ada lovelace", "Ada Lovelace"), ("ada", "Ada Lovelace"), ("bob", "Bob")}
    assert [tuple(r) for r in d["role"].collect()] == [("Ada Lovelace", "founder")]
    assert sorted(r.term for r in d["expansion"].collect()) == ["engine", "notes"]
    found = spark.createDataFrame([(1, "Ada Lovelace"), (2, "Bob")], "query_id long, name string")
    asked = spark.createDataFrame([(1, "who is ada"), (2, "bob"), (3, "none")], "query_id long, text string")
    out = {r.query_id: r.text for r in dictionary.expanded_queries(found, asked, d["expansion"]).collect()}
    assert out == {1: "who is ada engine notes", 2: "bob", 3: "none"}
