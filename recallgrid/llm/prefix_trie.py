"""Prefix trie of conversations by the Euler-tour technique.

Each distinct sequence of first d turns (role, text) is a node of depth d. A node
is named by its smallest member and its depth, which is unique. Every node has
an enter and an exit arc; the arcs make one list, the tour:

    enter(v) -> enter(first child), or exit(v) at a leaf
    exit(v)  -> enter(next sibling), or exit(parent) after the last one

The list is ranked distributedly. Nodes lie in ranges of (parent, depth, name),
about ROWS_PER_RANGE each, so children of one parent are neighbours and a
conversation's own tail is in one range. Each range joins its arcs to runs (local
pointer doubling in numpy), and pointer doubling over the runs, a join a round,
gives what follows every run in the whole list. With that each range knows
the position and the sums from each of its arcs on, and what lies between a
node's enter and exit arc is its subtree. Rounds grow with the logarithm of the
number of runs, not with the trie's depth.

Prefixes are compared by 128 bits: sums over the turns so far of hashes of
(place, role, text), taken in blocks of a conversation, so a conversation with a
third of all rows is many tasks, as is a node with a third of all children.

Defined results: null role or text is empty; null turns come first, turns of one
number are in order of the hashes of their role and text, repeated rows are turns
of their own; rows without a conversation id belong to none and are left out; a
conversation id is an integer; an empty table has no node, not even a root;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranking import spread_rank
from ..session import Rounds, cut_lineage

ROWS_PER_RANGE = 100_000
#: Turns of a conversation whose hashes one task adds up.
BLOCK = 4096
_ARC = "struct<conv_id:bigint,depth:bigint,leave:boolean>"


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, words): every turn's place from 1 on, two hashes of (role, text), words of the text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        words.alias("words"))
    ranked = spread_rank(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "place")
    return ranked.select("conv_id", F.col("place").cast("long").alias("place"), "a", "b", "words")


def with_roots(placed: DataFrame) -> DataFrame:
    """`placed` turns, a textless turn at place 0 for each conversation, and whether a turn is its conversation's last."""
    n = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    return rooted(placed.join(n, "conv_id"), n)


def rooted(turns: DataFrame, members: DataFrame) -> DataFrame:
    """`turns(conv_id, place, a, b, words, n)` and the roots of `members(conv_id, n)`."""
    zero = F.lit(0).cast("long")
    roots = members.select("conv_id", zero.alias("place"), zero.alias("a"), zero.alias("b"), zero.alias("words"), "n")
    return turns.select(*roots.columns).unionByName(roots).withColumn("last", F.col("place") == F.col("n")).drop("n")


def _key(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(i), depth, *sums) for i in (1, 2)]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, last): the key of the turns so far and of those before."""
    pieces = [F.xxhash64(F.lit(i), "place", "a", "b") for i in (1, 2)]
    halves = [h for p in pieces for h in (p.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(p, 32))]
    halves = [F.when(F.col("place") == 0, F.lit(0)).otherwise(h).cast("long").alias(f"h{i}") for i, h in enumerate(halves)]
    names = [f"h{i}" for i in range(len(halves))]
    cut = turns.select("*", *halves, F.expr(f"place div {BLOCK}").alias("block"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # conversations of one block, nearly all, have no row here
    blocks = cut.groupBy("conv_id", "block").agg(*(F.sum(h).alias(h) for h in names))
    offsets = blocks.select("conv_id", "block", *(F.sum(h).over(earlier).alias(f"o{h}") for h in names)).where("block > 0")
    run = cut.select("*", *(F.sum(h).over(so_far).alias(f"s{h}") for h in names)).join(offsets, ["conv_id", "block"], "left")
    sums = [F.col(f"s{h}") + F.coalesce(f"o{h}", F.lit(0)) for h in names]
    k1, k2 = _key(F.col("place"), sums)
    p1, p2 = (F.when(F.col("place") > 0, p) for p in _key(F.col("place") - 1, [s - F.col(h) for s, h in zip(sums, names)]))
    return run.select("conv_id", F.col("place").alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "words", "last")


def _ranges(nodes: DataFrame, n: int) -> DataFrame:
    """`nodes` in sorted ranges of (parent, depth, name); `range` has the number of each."""
    order = ["parent_conv_id", "depth", "conv_id"]
    laid = nodes.repartitionByRange(max(1, -(-n // ROWS_PER_RANGE)), *order).sortWithinPartitions(*order)
    return cut_lineage(laid.withColumn("range", F.spark_partition_id()))


class _Arcs:
    """The arcs of one sorted range: enter arcs 0 to n-1, exit arcs n to 2n-1, joined to runs."""

    def __init__(self, rows: pd.DataFrame, following: int | None):
        n = self.n = len(rows)
        self.conv, self.depth, kids, parent, first = (rows[c].to_numpy() for c in ("conv_id", "depth", "n_children", "parent_conv_id", "first_child"))
        last = rows["is_last"].to_numpy(bool)
        self.names, leaf, root = np.unique(self.conv), kids == 0, self.depth == 0
        self.width = int(self.depth.max()) + 3
        codes = self._codes(self.conv, self.depth)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        after = np.append(self.conv[1:], following if following is not None else 0)
        # of both kinds of arc: name and side of the next one, -2 for a depth that no arc has
        to_conv = np.concatenate([np.where(leaf, self.conv, first), np.where(last, parent, after)])
        to_depth = np.concatenate([np.where(leaf, self.depth, self.depth + 1), np.where(root, -2, np.where(last, self.depth - 1, self.depth))])
        to_leave = np.concatenate([leaf, last])
        at = self._found(to_conv, to_depth)
        nxt = np.where(at < 0, 2 * n, at + n * to_leave)
        self.to_conv, self.to_depth, self.to_leave = to_conv, to_depth, to_leave
        heads = np.ones(2 * n + 1, bool)
        heads[nxt] = False
        self.heads = np.flatnonzero(heads[: 2 * n])
        weight = (rows["n_convs"].to_numpy(np.int64) - 1) * rows["words"].to_numpy(np.int64)
        zeros = np.zeros(n + 1, np.int64)
        #: arcs, leaves and savings from each arc to the end of its run
        self.sums = np.stack([np.append(np.ones(2 * n, np.int64), 0), np.concatenate([leaf, zeros]), np.concatenate([weight, zeros])]).astype(np.int64)
        nxt, self.tail = np.append(nxt, 2 * n), np.arange(2 * n + 1)
        while (nxt < 2 * n).any():
            self.sums += self.sums[:, nxt]
            self.tail = np.where(nxt < 2 * n, self.tail[nxt], self.tail)
            nxt = nxt[nxt]

    def _codes(self, conv: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.names, conv) * self.width + depth

    def _found(self, conv: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Row of each (conv, depth), -1 where it is in another range."""
        inside = (depth >= 0) & (depth < self.width) & (self.names[np.minimum(np.searchsorted(self.names, conv), len(self.names) - 1)] == conv)
        codes = self._codes(np.where(inside, conv, self.names[0]), np.where(inside, depth, 0))
        at = np.minimum(np.searchsorted(self.codes, codes), self.n - 1)
        return np.where(inside & (self.codes[at] == codes), self.order[at], -1)

    def name(self, arcs: np.ndarray) -> list[tuple]:
        row = arcs % self.n
        return list(zip(self.conv[row].tolist(), self.depth[row].tolist(), (arcs >= self.n).tolist()))

    def runs(self) -> pd.DataFrame:
        end = self.tail[self.heads]
        to = zip(self.to_conv[end].tolist(), self.to_depth[end].tolist(), self.to_leave[end].tolist())
        out = pd.DataFrame({"at": self.name(self.heads), "next": [t if t[1] >= 0 else None for t in to]})
        for i, c in enumerate(("arcs", "leaves", "saved")):
            out[c] = self.sums[i, self.heads]
        return out

    def totals(self, runs: pd.DataFrame) -> np.ndarray:
        """Arcs, leaves and savings from each arc to the end of the list, given the same for the heads of runs."""
        known = {(a["conv_id"], a["depth"], a["leave"]): s for a, *s in zip(runs["at"], runs["arcs"], runs["leaves"], runs["saved"])}
        after = np.zeros((3, 2 * self.n + 1), np.int64)
        whole = np.array([known[h] for h in self.name(self.heads)], np.int64).T.reshape(3, -1)
        after[:, self.tail[self.heads]] = whole - self.sums[:, self.heads]
        return (self.sums + after[:, self.tail])[:, : 2 * self.n]


def _by_range(rows: pd.DataFrame, following: dict[int, int]) -> Iterator[tuple[int, pd.DataFrame, _Arcs]]:
    for number, part in rows.groupby("range", sort=True):
        part = part.sort_values(["parent_conv_id", "depth", "conv_id"], ignore_index=True)
        yield int(number), part, _Arcs(part, following.get(int(number)))


def ranked_runs(laid: DataFrame, following: dict[int, int]) -> DataFrame:
    """(range, at, arcs, leaves, saved): what lies from the head of each run to the end of the tour."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        for number, _, arcs in _by_range(pd.concat(held), following) if held else ():
            yield arcs.runs().assign(range=number)[["range", "at", "next", "arcs", "leaves", "saved"]]

    rounds = Rounds(laid.sparkSession, "runs")
    unfinished = F.col("next").isNotNull()
    cur, n = rounds.keep_counting(laid.mapInPandas(run, f"range int, at {_ARC}, next {_ARC}, arcs long, leaves long, saved long"), unfinished)
    while n:
        ahead = cur.select(F.col("at").alias("next"), F.col("next").alias("over"), *(F.col(c).alias(f"{c}_on") for c in ("arcs", "leaves", "saved")))
        cur, n = rounds.keep_counting(cur.join(ahead, "next", "left").select(
            "range", "at", F.col("over").alias("next"), *((F.col(c) + F.coalesce(f"{c}_on", F.lit(0))).alias(c) for c in ("arcs", "leaves", "saved"))), unfinished)
    return cur.drop("next")


def _following(laid: DataFrame) -> dict[int, int]:
    """Name of the first node after each range: as many numbers as there are ranges."""
    rows = sorted(laid.groupBy("range").agg(F.min(F.struct("parent_conv_id", "depth", "conv_id")).alias("head")).select("range", "head.conv_id").collect())
    return {a[0]: b[1] for a, b in zip(rows, rows[1:])}


def trie(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of `turns(conv_id, place, a, b, words, last)` with their roots.

    nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (words of last turns that members beyond the first
    repeat, summed over the subtree), enter and exit (positions in the tour,
    from 0). ends: conv_id, depth, member: the node where each conversation ends.
    """
    keyed = prefixes(turns)
    found = cut_lineage(keyed.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("words").alias("words"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2")))
    ends = keyed.where("last").select("k1", "k2", F.col("conv_id").alias("member")).join(
        found.select("k1", "k2", "conv_id", "depth"), ["k1", "k2"]).select("conv_id", "depth", "member")
    kids = found.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"), F.max("conv_id").alias("last_child"))
    # cut, so that the next join's sides come straight from an exchange: Spark can split a parent of very many children there
    parents = cut_lineage(found.join(kids, ["k1", "k2"], "left"))
    over = parents.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("last_child").alias("youngest"))
    nodes = parents.join(over, ["p1", "p2"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"), "n_convs", "words",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("first_child", "conv_id").alias("first_child"),
        F.coalesce(F.col("conv_id") == F.col("youngest"), F.lit(True)).alias("is_last"))
    n = found.count()
    laid = _ranges(nodes, n)
    following = _following(laid)
    runs = ranked_runs(laid, following)

    def finish(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part, arcs in _by_range(rows, following):
            from_enter, from_exit = np.split(arcs.totals(known), 2, axis=1)
            part["n_leaves"], part["saved_tokens"] = (from_enter - from_exit)[1:]
            part["enter"], part["exit"] = 2 * n - from_enter[0], 2 * n - from_exit[0]
            out.append(part)
        return pd.concat(out)[names]

    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, enter long, exit long"
    names = [f.split()[0] for f in schema.split(", ")]
    out = laid.groupBy("range").cogroup(runs.groupBy("range")).applyInPandas(finish, schema)
    return out.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id"))), ends


def prefix_trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`trie` of a table (conv_id, turn, role, text)."""
    return trie(with_roots(placed_turns(conversations)))


def branched(placed: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Turns with roots of conversations that begin like another one.

    Conversation c takes the first h turns of c - c % `group` (all if it has
    fewer, none if there is no such conversation), then its own after its first
    h; h = crc32 of c's decimal digits % `most`.
    """
    n = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    members = n.select("conv_id", "own", h, base)
    taken = F.least("h", F.coalesce("others", F.lit(0)))
    members = members.join(n.select(F.col("conv_id").alias("base"), F.col("own").alias("others")), "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    own = placed.join(members, "conv_id").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    # the first turns of a base go to `group` conversations at most
    first = placed.where(F.col("place") < most).withColumnRenamed("conv_id", "base").join(members, "base").where("place <= h")
    columns = ["conv_id", "place", "a", "b", "words", "n"]
    return rooted(own.select(*columns).unionByName(first.select(*columns)), members)


def digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of each node's `member` ids in ascending order, comma-joined.

    The digest of one node is sequential; ids are packed into texts of up to 4096
    before, and one node's texts stream through a task that holds one of them.
    """
    ids = F.array_join(F.array_sort(F.collect_list("member")), ",")
    packs = ends.groupBy("conv_id", "depth", F.shiftright("member", 12).alias("pack")).agg(ids.alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
                if (conv, depth) == at:
                    state.update(f",{ids}".encode())
                    continue
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (conv, depth), hashlib.sha256(ids.encode())
            yield _digest_batch(done)
        if at is not None:
            yield _digest_batch([(*at, state.hexdigest())])

    sorted_ = packs.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "pack").select("conv_id", "depth", "ids")
    return sorted_.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, sha = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha, pa.string())], ["conv_id", "depth", "ends_sha256"])


#: DuckDB: paths as lists, subtrees through the ancestors of every node. crc32 is worked out bit by bit.
ORACLE = r"""
with ordered as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as place
  from conversations where conv_id is not null),
convs as (
  select conv_id as c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 4 as h
  from (select distinct conv_id from ordered)),
grown as (
  select c, place, role, text from convs join ordered on conv_id = c - c % 20 and place <= h
  union all select c, place + 4, role, text from convs join ordered on conv_id = c and place > h),
paths as (
  select c, row_number() over w as depth, list({'r': role, 't': text}) over w as path, text from grown window w as (partition by c order by place)
  union all select c, 0, [], '' from convs),
nodes as (
  select path, depth, min(c) as conv_id, count(*) as n_convs, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) as words from paths group by path, depth),
named as (select p.c, p.depth, n.conv_id from paths p join nodes n using (path, depth)),
tree as (
  select n.*, p.conv_id as parent_conv_id from nodes n left join named p on p.c = n.conv_id and p.depth = n.depth - 1),
kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from tree where depth > 0 group by all),
below as (
  select a.conv_id, a.depth, sum(case when k.n_children is null then 1 else 0 end)::bigint as n_leaves, sum((t.n_convs - 1) * t.words)::bigint as saved_tokens
  from tree t join named a on a.c = t.conv_id and a.depth <= t.depth left join kids k on k.conv_id = t.conv_id and k.depth = t.depth group by all),
ends as (
  select n.conv_id, n.depth, string_agg(n.c::varchar, ',' order by n.c) as ids
  from named n join (select c, max(depth) as depth from paths group by c) l on l.c = n.c and l.depth = n.depth group by all)
select t.conv_id, t.depth, t.parent_conv_id, t.n_convs, coalesce(k.n_children, 0) as n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from tree t join below b using (conv_id, depth) left join kids k using (conv_id, depth) left join ends e using (conv_id, depth)
"""
