"""Exact substring dedup: bytes inside any string of MIN bytes that starts twice or more.

1. Anchors. In each text the smallest hash of GRAM bytes among the MIN - GRAM + 1
   grams of a string of MIN bytes owns that string (the leftmost of equals).
   Equal strings have equal owners at equal places, so every start position
   belongs to one anchor, and strings can be equal only if their anchors' grams
   are. Starts whose gram occurs once in the corpus need no further look.
2. Pieces. The starts of one anchor, with the bytes their strings reach, form a
   piece. Equal pieces meet by digest first: all their starts are repeated, and
   one of them stands for all. The others go to shards by gram; a gram of more
   than SHARD bytes is dealt over several shards.
3. Per shard: the suffix array of its pieces, by Larsson and Sadakane's
   refinement (prefix doubling that sorts only what is still tied) in numpy, and
   the common prefixes of neighbours by Kasai's bound, which is taken in strides
   so that numpy runs it in bulk. Neighbours that share MIN bytes are repeated.
4. Across shards: only grams dealt over several shards need it. Every shard
   writes the sorted digests of its different strings, cut into ranges of the
   digest; in each range the shards' runs are merged one after the other, each
   looked up in those before it by binary search.
5. Per text the runs of starts become runs of removed bytes.

Defined results: null is empty text; texts shorter than MIN lose nothing; a text
of MIN bytes or more that occurs twice goes whole, in every row; strings inside
one text count, overlapping or not; repeated rows are copies of each other; an
empty table gives an empty table; texts of any length are read whole; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import by_bytes

MIN, GRAM = 400, 96
#: Bytes of pieces in a shard (half of it on average), and of dealt pieces in a range: what one task holds at a time.
SHARD, RANGE = 1_000_000, 2_000_000


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on (polynomial, by doubling, then mixed)."""
    h, width, mult = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    out, done, at, power = None, 0, 0, mult
    while width <= size:  # h covers `width` bytes; joined as the bits of `size` ask
        if size & width:
            n = len(raw) - done - width + 1
            out = h[done : done + n].copy() if out is None else out[:n] * np.uint64(power) + h[done : done + n]
            done += width
        if 2 * width > size:
            break
        h = h[:-width] * np.uint64(power) + h[width:] if len(h) > width else h[:0]
        power, width = power * power % 2**64, 2 * width
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def owners(h: np.ndarray, window: int) -> np.ndarray:
    """For each `window` values in a row the place of the smallest, the leftmost of equals. By doubling."""
    n = len(h) - window + 1
    best, width = np.arange(len(h)), 1
    while 2 * width <= window:
        left, right = best[:-width], best[width:]
        best, width = np.where(h[right] < h[left], right, left), 2 * width
    left, right = best[:n], best[window - width : window - width + n]
    return np.where(h[right] < h[left], right, left)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first start, last start) of each anchor of a text; none if it is shorter than MIN."""
    if len(raw) < MIN:
        return (np.empty(0, np.int64),) * 3
    h = gram_hashes(np.frombuffer(raw, np.uint8))
    own = owners(h, MIN - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.append(first[1:], len(own)) - 1
    return h[own[first]].view(np.int64), first, last


def suffix_array(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of the suffixes of `text`, each up to `end`, where its piece ends; equal ones by place.

    Ranks start from 7 bytes packed in a word. A round doubles the length they
    cover, and sorts only groups that are still tied.
    """
    n = len(text)
    place = np.arange(n)
    packed = np.zeros(n, np.uint64)
    for i in range(7):
        inside = place + i < end
        value = np.zeros(n, np.uint64)
        value[inside] = text[place[inside] + i].astype(np.uint64) + np.uint64(1)
        packed = packed * np.uint64(257) + value
    order = np.argsort(packed, kind="stable")
    ranked = packed[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(fresh)  # a group's rank is the place of its first member
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    covered = 7
    longest = int((end - place).max())
    while covered < longest:
        size = np.diff(np.append(np.flatnonzero(fresh), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))  # places in the order that are not settled
        if not len(tied):
            break
        who = order[tied]
        nxt = who + covered
        inside = nxt < end[who]
        key = np.full(len(who), -1, np.int64)
        key[inside] = rank[nxt[inside]]
        own = rank[who]
        by = np.argsort(own * (n + 1) + key + 1, kind="stable")
        order[tied] = who[by]
        own, key = own[by], key[by]
        fresh[tied] = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
        head = np.flatnonzero(fresh)
        rank[order] = np.repeat(head, np.diff(np.append(head, n)))
        covered *= 2
    return order


def common_prefixes(text: np.ndarray, end: np.ndarray, order: np.ndarray, stride: int = 64) -> np.ndarray:
    """For each place in the order the length shared with the one before, MIN at most.

    Kasai: a suffix shares at least one byte less with its neighbour than the
    suffix one place earlier in the text does. Every `stride`-th place is
    compared in full first; places half a stride on start from that bound, and
    so on down to single places.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word |= padded[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    done_step = None
    step = stride
    while step >= 1:
        at = np.arange(0, n, step) if done_step is None else np.arange(step, n, done_step)
        have = np.zeros(len(at), np.int64) if done_step is None else np.maximum(shared[at - step] - step, 0)
        at_all = at
        other = before[at]
        limit = np.minimum(np.minimum(end[at] - at, np.where(other >= 0, end[other] - other, 0)), MIN)
        have = np.minimum(have, limit)
        live = np.flatnonzero((other >= 0) & (have < limit))
        while len(live):
            x = at[live] + have[live]
            y = other[live] + have[live]
            diff = word[x] ^ word[y]
            low = diff & (~diff + np.uint64(1))
            same = np.where(diff == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            have[live] = np.minimum(have[live] + same, limit[live])
            live = live[(same == 8) & (have[live] < limit[live])]
        shared[at_all] = have
        done_step, step = step, step // 2
    return shared[order]


def repeated_starts(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start in the piece, is repeated) of every start in the shard's pieces, in suffix order.

    Starts that share MIN bytes with a neighbour in the order are repeated.
    """
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), sizes)
    end = (begin + sizes)[piece]
    order = suffix_array(text, end)
    shared = common_prefixes(text, end, order)
    twin = shared >= MIN
    twin[:-1] |= shared[1:] >= MIN
    starts = end[order] - order >= MIN
    where = order[starts]
    return piece[where], where - begin[piece[where]], twin[starts]


def _runs(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of the runs of consecutive numbers in sorted `places`."""
    if len(places):
        cut = np.flatnonzero(np.diff(places) != 1)
        yield from zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.append(cut, len(places) - 1)].tolist())


def _digest(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text digest, size, sha256, anchors) of each text."""
    anchor = pa.struct([("gram", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    for batch in by_bytes(batches, "text"):
        raws = [(t or "").encode() for t in batch.column("text").to_pylist()]
        found = [anchors(r) for r in raws]
        ends = np.cumsum([0, *(len(f[0]) for f in found)])
        g, a, b = (np.concatenate([f[i] for f in found]) for i in range(3))
        rows = pa.StructArray.from_arrays([pa.array(g, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], fields=list(anchor))
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), pa.array([_digest(r) for r in raws], pa.binary()), pa.array([len(r) for r in raws], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in raws]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)],
            ["id", "digest", "size", "sha", "anchors"])


def _name_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, digest, gram, size, firsts): each different piece of a text by its digest, and where it starts there. A row is one text with its open anchors."""
    for batch in by_bytes(batches, "text", 1 << 20):
        out: list[tuple] = []
        for digest, text, open_ in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "open"))):
            raw = (text or "").encode()
            if _digest(raw) != digest:  # another text of the same key
                continue
            found: dict[bytes, tuple] = {}
            for o in open_:
                piece = raw[o["first"] : o["last"] + MIN]
                found.setdefault(_digest(piece), (o["gram"], len(piece), []))[2].append(o["first"])
            out += [(same, digest, *f) for same, f in found.items()]
        types = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["same", "digest", "gram", "size", "firsts"])


def _cut_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, dealt, same, piece): the bytes of the pieces that are taken from a text."""
    for batch in by_bytes(batches, "text", 1 << 20):
        out = [(t["at"], t["dealt"], t["same"], raw[t["first"] : t["first"] + t["size"]])
               for digest, text, taken in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "taken")))
               if _digest(raw := (text or "").encode()) == digest for t in taken]
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], ["at", "dealt", "same", "piece"])


#: A string of a dealt gram: its digest, the piece it stands in (by digest) and the start there.
_STRING = np.dtype([("string", "S16"), ("same", "S16"), ("start", "<i4")])


def _shard(rows: pd.DataFrame, n_ranges: int) -> pd.DataFrame:
    """Repeated runs of starts in a shard's pieces; for dealt grams also its different strings, sorted and packed, by range."""
    rows = rows.sort_values("same", kind="stable")  # the order rows come in decides nothing
    rows = rows.drop_duplicates("same")  # a repeated row of a text sends its pieces again
    pieces, same, dealt = rows["piece"].tolist(), rows["same"].tolist(), bool(rows["dealt"].iloc[0])
    piece, start, twin = repeated_starts(pieces)
    by = np.lexsort((start, piece))
    piece, start, twin = piece[by], start[by], twin[by]
    cut = np.searchsorted(piece, np.arange(len(pieces) + 1))
    out: list[tuple] = []
    for i in range(len(pieces)):
        out += [(same[i], a, b, None, None) for a, b in _runs(start[cut[i] : cut[i + 1]][twin[cut[i] : cut[i + 1]]])]
    if dealt:
        # a string that is repeated here needs one to stand for it: a twin elsewhere changes nothing here, but does there
        strings = np.empty(len(piece), _STRING)
        strings["string"] = [_digest(pieces[i][a : a + MIN]) for i, a in zip(piece.tolist(), start.tolist())]
        strings["same"], strings["start"] = np.array(same, "S16")[piece], start
        strings = strings[np.unique(strings["string"], return_index=True)[1]]
        lead = np.ndarray(len(strings), ">u4", strings["string"].tobytes(), strides=(16,)) if len(strings) else np.empty(0, ">u4")
        of = (lead.astype(np.uint64) * np.uint64(n_ranges)) >> np.uint64(32)
        edges = np.searchsorted(of, np.arange(n_ranges + 1, dtype=np.uint64))
        out += [(None, None, None, r, strings[a:b].tobytes()) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
    return pd.DataFrame(out, columns=["same", "first", "last", "range", "run"]).astype({"first": "Int32", "last": "Int32", "range": "Int64"})


def _across(rows: pd.DataFrame) -> pd.DataFrame:
    """Starts whose string is in two shards' runs of a range: each sorted run is looked up in the merged runs before it."""
    merged, hit = np.empty(0, _STRING), []
    for run in sorted(rows["run"]):
        run = np.frombuffer(run, _STRING)
        at = np.searchsorted(merged["string"], run["string"])
        inside = np.flatnonzero(at < len(merged))
        found = inside[merged["string"][at[inside]] == run["string"][inside]]
        hit += [run[found], merged[at[found]]]
        new = np.setdiff1d(np.arange(len(run)), found)
        merged = np.insert(merged, at[new], run[new])
    hits = np.unique(np.concatenate([np.empty(0, _STRING), *hit]))
    return pd.DataFrame({"same": [v.ljust(16, b"\0") for v in hits["same"].tolist()], "first": hits["start"], "last": hits["start"]})


def _cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n_removed, n_spans, sha): a text without the bytes its repeated starts cover."""
    for batch in by_bytes(batches, "text", 1 << 20):
        out = []
        for digest, text, runs in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "runs"))):
            if _digest((text or "").encode()) != digest:  # another text of the same key
                continue
            raw = np.frombuffer((text or "").encode(), np.uint8)
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, [r["a"] for r in runs], 1)
            np.add.at(edge, [r["b"] + MIN for r in runs], -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((digest, int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, types)], ["digest", "n_removed", "n_spans", "sha"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` and `cut`, whether anything goes, of every row of `docs`."""
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    rows = cut_lineage(own.mapInArrow(_anchor_rows, f"id {kind}, digest binary, size long, sha string, anchors array<struct<gram:bigint,first:int,last:int>>"))
    texts = cut_lineage(rows.where(F.col("size") >= MIN).groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.first("anchors").alias("anchors")))
    spread = texts.select("digest", F.inline("anchors"))
    # cut, so that Spark can split the anchors of one gram in the join
    often = cut_lineage(spread.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    open_ = spread.join(often, "gram").groupBy("digest").agg(F.collect_list(F.struct("gram", "first", "last")).alias("open"))
    asked = cut_lineage(open_.join(texts.select("digest", F.col("id").alias("rep"), "copies"), "digest"))
    with_text = cut_lineage(own.join(asked, own["id"].eqNullSafe(asked["rep"])).select("digest", "copies", "text", "open"))
    places = cut_lineage(with_text.select("digest", "text", "open").mapInArrow(_name_pieces, "same binary, digest binary, gram long, size long, firsts array<int>")
                         .dropDuplicates(["same", "digest"]))  # repeated rows name their pieces again
    home = F.min(F.struct("digest", F.element_at("firsts", 1).alias("first"))).alias("home")
    kinds = cut_lineage(places.groupBy("same").agg(F.first("gram").alias("gram"), F.first("size").alias("size"), F.sum(F.size("firsts")).alias("n"), home))
    weight = cut_lineage(kinds.groupBy("gram").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_kinds")).where("n_kinds > 1").select(
        "gram", "bytes", F.ceil(F.col("bytes") / SHARD).cast("long").alias("parts")))
    total, total_dealt = weight.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("bytes"))), F.lit(0))).first()
    n_shards, n_ranges = max(1, -(-2 * total // SHARD)), max(1, -(-total_dealt // RANGE))
    at = F.when(F.col("parts") > 1, F.xxhash64("gram", F.pmod(F.xxhash64("same"), "parts"))).otherwise(F.pmod(F.xxhash64("gram"), F.lit(n_shards)))
    # the bytes move once: of each different piece, from one text that holds it, to its shard
    taken = kinds.join(weight, "gram").select(F.col("home.digest").alias("digest"), F.struct(
        F.col("home.first").alias("first"), "size", "same", at.alias("at"), (F.col("parts") > 1).alias("dealt")).alias("piece"))
    taken = taken.groupBy("digest").agg(F.collect_list("piece").alias("taken"))
    sharded = with_text.select("digest", "text").join(taken, "digest").mapInArrow(_cut_pieces, "at long, dealt boolean, same binary, piece binary")
    found = cut_lineage(sharded.groupBy("dealt", "at").applyInPandas(lambda v: _shard(v, n_ranges), "same binary, first int, last int, range long, run binary"))
    across = found.where("run is not null").groupBy("range").applyInPandas(lambda v: _across(v[["run"]]), "same binary, first int, last int")
    whole = kinds.where("n > 1").select("same", F.lit(0).cast("int").alias("first"), (F.col("size") - MIN).cast("int").alias("last"))
    runs = found.where("run is null").select("same", "first", "last").union(across).union(whole)
    base = places.join(runs, "same").select("digest", "first", "last", F.explode("firsts").alias("base"))
    back = base.groupBy("digest").agg(F.collect_set(F.struct((F.col("base") + F.col("first")).alias("a"), (F.col("base") + F.col("last")).alias("b"))).alias("runs"))
    cut = with_text.where("copies = 1").select("digest", "text").join(back, "digest").mapInArrow(_cut_out, "digest binary, n_removed long, n_spans long, sha string")
    done = cut_lineage(cut.dropDuplicates(["digest"]).withColumnRenamed("sha", "cut_sha"))
    none = hashlib.sha256(b"").hexdigest()
    copied = texts.where("copies > 1").select("digest", F.lit(True).alias("copied"))
    changed = done.select("digest", F.lit(False).alias("copied"), "n_removed", "n_spans", "cut_sha").unionByName(copied, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    out = rows.select("id", "digest", "size", "sha").join(changed, "digest", "left").select(
        F.col("id").alias(key), F.col("size").alias("n_bytes"),
        F.when(F.col("copied"), F.col("size")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(F.col("copied"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(F.col("copied"), F.lit(none)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))
    return out.withColumn("cut", F.col("n_removed") > 0)
