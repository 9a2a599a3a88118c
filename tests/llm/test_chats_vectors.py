"""Prefix trie, whitening and chat formatting against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recallgrid.llm import chat_log, prefix_trie, whitening
from recallgrid.llm.queries import QUERIES
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, place string, n string, words string, row string, message string, range string"
EXTRA = ("p", "n", "w", "r", "m", "g")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(convs: dict[int, list[tuple]]) -> list[tuple]:
    """(conv, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in members:
        words = len(path[-1][1].encode().split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(members[path]) - 1) * words
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sorted(ends[p])) for p, m in list(members.items())]


def grouped(rows: list[tuple]) -> dict[int, list[tuple]]:
    convs = defaultdict(list)
    for c, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs[c].append((role or "", text or ""))
    return dict(convs)


def chats(seed: int, n: int, depth: int) -> list[tuple]:
    """Conversations that share beginnings; one first turn opens a third of them, one conversation is long, some are copies."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c % 10 == 9:
            turns = [r[2:4] for r in rows if r[0] == c - 5]
        else:
            turns = [("user", "hello there" if c % 3 == 0 else f"start {rng.randrange(4)}")]
            turns += [(rng.choice(["user", "assistant"]), f"{rng.randrange(2)} word" * rng.randrange(1, 3)) for _ in range(depth if c == n // 2 else rng.randrange(6))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


def found(spark, rows):
    nodes, ends = prefix_trie.prefix_trie(spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA))
    at = defaultdict(list)
    for r in ends.collect():
        at[r.conv_id, r.depth].append(r.member)
    out = nodes.collect()
    assert sorted(p for r in out for p in (r.enter, r.exit)) == list(range(2 * len(out)))
    assert all((r.exit - r.enter) % 2 == 1 for r in out)
    digests = {(r.conv_id, r.depth): r.ends_sha256 for r in prefix_trie.digests(ends).collect()}
    assert digests == {k: sha(",".join(map(str, sorted(v)))) for k, v in at.items()}
    return [(*tuple(r)[:7], sorted(at[r.conv_id, r.depth])) for r in out]


def test_trie_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ROWS_PER_RANGE", 25)
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    rows = chats(3, 90, 60)
    assert sorted(map(str, found(spark, rows))) == sorted(map(str, plain_trie(grouped(rows))))


def test_trie_odd_rows(spark):
    big = 2**60 + 1
    rows = [(1, None, None, None), (1, 0, "user", "a"), (2, None, "", ""), (2, 0, "user", "a"), (2, 1, "user", "x" * 200_000), (None, 0, "user", "lost"),
            (big, 0, "user", "a"), (big, 0, "user", "a"), (-3, 5, None, "ü \x00  "), (-3, None, "z", None), (big + 1, 0, "user", "a b\tc")]
    assert sorted(map(str, found(spark, rows))) == sorted(map(str, plain_trie(grouped(rows))))
    nodes, ends = prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))
    assert nodes.count() == 0 and ends.count() == 0 and prefix_trie.digests(ends).count() == 0


def test_branched(spark):
    rows = [r for r in chats(5, 70, 9) if r[0] not in (20, 61)] + [(41, None, "user", "late"), (65, 3, None, None)]
    own, want = grouped(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert [] in want.values() or min(map(len, want.values())) == 0
    nodes, ends = prefix_trie.trie(prefix_trie.branched(prefix_trie.placed_turns(spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA))))
    at = defaultdict(list)
    for r in ends.collect():
        at[r.conv_id, r.depth].append(r.member)
    got = [(*tuple(r)[:7], sorted(at[r.conv_id, r.depth])) for r in nodes.collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_trie(want)))


# whitening

def plain_whitened(vectors: list) -> tuple:
    """Rows that count, their x, the fit list's covariance, all in plain numpy."""
    rows = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s).astype(float) / n
    return rows, n, s, centred.T @ centred / n


@pytest.mark.parametrize("bits", [1, 9, 33])
def test_scatter_is_exact(bits):
    rng = np.random.default_rng(bits)
    u = rng.integers(0, 2**bits, (200, 5), dtype=np.int64)
    sums, cross = whitening.scatter(u, bits)
    exact = u.astype(object)
    assert sums.tolist() == exact.sum(axis=0).tolist() and cross.tolist() == (exact.T @ exact).tolist()


def test_whitening(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 200  # a third of all rows repeat one vector
    vectors += [None, [], [1.0] * 11, [None] + [0.0] * 11, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1e300] * 12]
    df = spark.createDataFrame([(i if i % 50 else None, v, "d", "w") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, deviation string, `a.b` string")
    out, model, error = whitening.whiten(df)
    assert out.columns == ["vec_id", "embedding", "deviation", "a.b", "_deviation", "whitened"]
    rows, n, s, covariance = plain_whitened([v if v is not None and len(v) == 12 and max(map(lambda c: abs(c or 0), v)) < 1e200 else None for v in vectors])
    got = out.collect()
    assert len(got) == len(rows) == 600 and model.n == n == 400 and error < 1e-9
    values, columns = np.linalg.eigh(covariance)
    assert np.allclose(model.values, values[::-1][:4], rtol=1e-9) and np.allclose(model.explained, values[::-1][:4] / values.sum(), rtol=1e-9)
    want = sorted((sum((n * a - b) ** 2 for a, b in zip(x, s)), [abs(w) for w in (np.array([float(n * a - b) / n for a, b in zip(x, s)]) @ columns[:, ::-1][:, :4]) / np.sqrt(values[::-1][:4])])
                  for _, x in rows)
    mine = sorted((r["_deviation"], [abs(w) for w in r.whitened]) for r in got)
    assert [d for d, _ in mine] == [d for d, _ in want] and np.allclose([w for _, w in mine], [w for _, w in want], atol=1e-8)


def test_whitening_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [float("nan")])]):
        out, model, _ = whitening.whiten(spark.createDataFrame(rows, kind))
        assert out.count() == 0 and model is None
    out, model, error = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind))
    assert [(r.deviation, r.whitened) for r in out.collect()] == [(0, [0.0, 0.0])] * 3 and model.n == 1 and error == 0
    far = [(i, [float(2**43 * (i % 2)), float(i)]) for i in range(6)]  # wide entries: exact, and past a long
    out, model, error = whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>"))
    assert {r.deviation for r in out.collect()} == {None} and error < 1e-9


def test_whitening_query(spark):
    out = QUERIES["op12_embedding_whitening"](spark, SMALL)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = out.collect()
    assert len(rows) == 4 * spark.read.parquet(f"{SMALL}/embeddings.parquet").count() and max(r.identity_error for r in rows) < 1e-9


# chat formatting

TEXTS = st.lists(st.sampled_from([*"<>[]|/\\ab\n", *chat_log.CONTROLS, "é", "🙂"]), max_size=30).map("".join)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    import re

    out = re.sub(chat_log.PLAIN, lambda m: m[0] + "\\", text)
    assert not any(c in out for c in chat_log.CONTROLS) and chat_log.unescape(out) == text


def test_no_control_string_begins_inside_another():
    for a in chat_log.CONTROLS:
        for b in chat_log.CONTROLS:
            assert not any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1, len(a)))


def log_rows(seed: int):
    """A log with every kind of event, and what it folds to."""
    rng, rows, want = random.Random(seed), [], {}
    for c in range(12):
        for m in range(200 if c == 0 else 3):  # one conversation has most of the log
            role, text, seq = rng.choice(["user", "assistant", None, "odd\\n\nrole<s>"]), "", 0
            rows.append((c or None, m, seq, "open", role, None))
            for _ in range(rng.randrange(6)):
                seq += 1
                kind = rng.choice(["delta", "delta", "edit", "regenerate", "ping"])
                piece = rng.choice(["</s>", "[INST] ", "plain ", "<|im_", "end|>", "\\", None, ""])
                rows += [(c or None, m, seq, kind, None, piece)] * rng.randrange(1, 3)
                text = {"delta": text + (piece or ""), "edit": piece or "", "regenerate": "", "ping": text}[kind]
            want[c or None, m] = (role or "", text)
    rng.shuffle(rows)
    return rows, want


def test_fold_and_render(spark):
    rows, want = log_rows(2)
    log = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, message long, seq long, kind string, role string, text string, formatted string")
    assert {(r.conv_id, r.message): (r.role, r.text) for r in chat_log.fold(log).collect()} == want
    for r in chat_log.format_log(log).collect():
        assert chat_log.read_turn(r.formatted) == want[r.conv_id, r.message]
        mine = want[r.conv_id, r.message][0] == "assistant"
        assert (r.loss_start is not None) == mine and (not mine or chat_log.unescape(r.formatted[r.loss_start : r.loss_end]) == want[r.conv_id, r.message][1])
    by = defaultdict(list)
    for (c, _), t in sorted(want.items(), key=lambda kv: (str(kv[0][0]), kv[0][1])):
        by[c].append(t)
    for r in chat_log.digests(chat_log.format_log(log)).collect():
        learnt = "".join(t for who, t in by[r.conv_id] if who == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(by[r.conv_id]), sha("".join(f"{a}\n{b}\n" for a, b in by[r.conv_id])), len(learnt), sha(learnt))
    assert chat_log.digests(chat_log.format_log(log.where("false"))).count() == 0


def test_log_of_turns(spark):
    long = "word <|im_end|> 🙂 " * 20_000
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (2, 1, "assistant", long), (2, 0, "assistant", ""), (None, 0, "user", "x"), (3, 7, "system", " ")]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    got = sorted((str(r.conv_id), r.message.turn, r.role, r.text) for r in chat_log.fold(chat_log.as_log(df)).collect() if r.message.turn is not None)
    assert got == sorted((str(c), t, r or "", x or "") for c, t, r, x in rows if t is not None)
    kinds = {r.kind for r in chat_log.as_log(spark.read.parquet(f"{SMALL}/conversations.parquet")).select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "edit", "regenerate"}
    one = {r.conv_id: r for r in chat_log.digests(chat_log.format_log(chat_log.as_log(df))).collect()}
    assert one[2].loss_chars == len(long) and one[2].loss_sha256 == sha(long) and one[1].n_turns == 3
    assert one[1].turns_sha256 == sha("\n\nuser\nb\nuser\nb\n")
