"""MinHash near-duplicates by a multi-index Hamming join.

Each text's set of word shingles gets a signature of CHUNKS * SYMBOLS b-bit
MinHash values (b = 16). Two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 values differ, by pigeonhole, in at most ERRORS values
in some chunk. Every chunk is written out once for each way to leave ERRORS
values out, so such a pair meets in a bucket for certain. At a Jaccard
similarity of 0.8 a pair misses every bucket with probability 3e-6.

The buckets' stars join texts to families: all that a chain of buckets connects.
Equal sets are one member. A family is cut into blocks of about DOCS members
(long sets count as several); a task holds the full sets of one block, counts
all its intersections by matrix products, and gives out a link from each member
to the smallest that the block connects it to. Most families are one block and
done. Those of more than FEW are dealt anew while that halves the number of
components; then blocks, by component, meet pairwise, but for blocks of one and
the same component. So
every two members of a family that are not connected otherwise are compared on
their full sets, no pair is emitted but for links, and no task holds more than
two blocks. The work of the last step grows with the square of what stays
unconnected in a family, in equal tasks.

Defined results: null text, or text without words, has an empty set and is
linked with nothing; fewer words than a shingle are one shingle of them all; a
component is named by its smallest key (null keys name nothing: a component of
null keys only has a null name); keys are of any type that sorts; different texts
under one key are different members; repeated rows share set and component; an
empty table gives an empty table; texts are read whole; other columns, whatever
their names, pass through `keep_one` and are not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import components
from ..session import cut_lineage
from .common import by_bytes, fresh, quoted

CHUNKS, SYMBOLS, ERRORS = 12, 6, 1
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
#: Members of a block; a member counts once more for every ITEMS shingles it has.
DOCS, ITEMS = 512, 2048
#: Blocks of a family up to which they meet pairwise at once.
FEW = 16
#: Shingles whose columns are multiplied at once.
COLUMNS = 8192
#: Words whose hashes a worker keeps, some 200 bytes each.
KNOWN = 150_000
#: Words of default shingles, and the similarity as a fraction.
WORDS, SHARE = 5, (80, 100)


class _Words(dict):
    """64-bit hash of each word met; forgets all at KNOWN, so that the few workers of an executor stay small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """The multipliers of a well-known 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, met: dict) -> np.ndarray:
    """Sorted distinct hashes of the `k`-word shingles of the whole text; A-Z lower-cased."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(met.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signatures(sets: list[np.ndarray], n: int = CHUNKS * SYMBOLS, bits: int = 16) -> np.ndarray:
    """(set, value) of `n` MinHash values of 8 or 16 bits; no set may be empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), n), ">u2" if bits == 16 else "u1")
    for i, (a, b) in enumerate(zip(*_permutations(n))):
        least = np.minimum.reduceat(x * a + b, starts)
        out[:, i] = (least * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return out


def _own(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(quoted(text))
    return docs.select(F.col(quoted(key)).alias("id"), F.xxhash64(t).alias("th"), t.alias("text"))


def described(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, th, n, digest, sig): hash of the text, set size, 128-bit digest of the set and signature of every row; null for empty sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Words()
        for batch in by_bytes(batches, "text", 1 << 20):
            sets = [shingle_set(t, k, met) for t in batch.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full) if full else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())], ["id", "th", "n", "digest", "sig"])

    return _own(docs, key, text).mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, th long, n long, digest binary, sig binary")


def bucket_keys(sig: Column) -> Column:
    """A key for each chunk and each value left out of it."""
    out = []
    for c in range(CHUNKS):
        for leave in range(SYMBOLS):
            first = 2 * c * SYMBOLS + 1
            rest = F.concat(F.substring(sig, first, 2 * leave), F.substring(sig, first + 2 * leave + 2, 2 * (SYMBOLS - leave - 1)))
            out.append(F.xxhash64(F.lit(c * SYMBOLS + leave), rest))
    return F.array(*out)


def _with_sets(docs: DataFrame, key: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(digest, family, weight, blocks, items): the full set of each member in `wanted(digest, id, th, family, weight, blocks)`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Words()
        for batch in by_bytes(batches, "text", 1 << 20):
            sets = [shingle_set(t, k, met) for t in batch.column("text").to_pylist()]
            keep = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, batch.column("digest").to_pylist())], pa.bool_())
            items = pa.array([s.view(np.int64) for s, w in zip(sets, keep.to_pylist()) if w], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in names), items], [*names, "items"])

    names = ["digest", "family", "weight", "blocks"]
    own = _own(docs, key, text).withColumnRenamed("th", "own_th").withColumnRenamed("id", "own_id")
    rows = own.join(wanted, (F.col("own_th") == F.col("th")) & F.col("own_id").eqNullSafe(F.col("id"))).select(*names, "text")
    return rows.mapInArrow(run, "digest binary, family long, weight int, blocks int, items array<bigint>").dropDuplicates(["digest"])


def similar_pairs(sets: list[np.ndarray], share: tuple[int, int], first: int | None = None) -> np.ndarray:
    """(i, j) of the sets that are similar enough, i < j; with `first`, only those of the first so many with one of the others."""
    n, k = np.array(list(map(len, sets))), len(sets)
    _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[item] > 1  # an item of one set is in no intersection
    item, doc = (np.cumsum(count > 1) - 1)[item[shared]], np.repeat(np.arange(k), n)[shared]
    order = np.argsort(item)
    item, doc, m = item[order], doc[order], int((count > 1).sum())
    rows, columns = (slice(None), slice(None)) if first is None else (slice(0, first), slice(first, k))
    both = np.zeros((len(n[rows]), len(n[columns])), np.int64)
    for start in range(0, m, COLUMNS):
        a, b = np.searchsorted(item, [start, start + COLUMNS])
        has = np.zeros((k, min(COLUMNS, m - start)), np.float32)
        has[doc[a:b], item[a:b] - start] = 1
        both += (has[rows] @ has[columns].T).astype(np.int64)  # at most COLUMNS: exact
    close = share[1] * both >= share[0] * (n[rows][:, None] + n[columns] - both)
    found = np.argwhere(np.triu(close, 1) if first is None else close)
    return found + [0, first or 0]


def _joined(roots: list[bytes], sides: list[int], sets: list[np.ndarray], share: tuple[int, int]) -> list[tuple[bytes, bytes]]:
    """A link from each of `roots` that similar sets connect to a smaller one here, to the smallest of them."""
    first = sides.index(1) if 1 in sides else None
    if len(sets) < 2 or first == 0 or len(set(roots)) < 2:
        return []
    over: dict[bytes, bytes] = {}

    def top(a: bytes) -> bytes:
        while a in over:
            a = over[a]
        return a

    for i, j in similar_pairs(sets, share, first).tolist():
        if roots[i] != roots[j]:
            a, b = top(roots[i]), top(roots[j])
            if a != b:
                over[max(a, b)] = min(a, b)
    return [(a, top(a)) for a in over]


def _linked(rows: DataFrame, by: list[str], share: tuple[int, int]) -> DataFrame:
    """(a, b): links between roots within each block of `rows(root, side, items)` dealt by `by`; only between the two sides where there are two."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def links() -> list[tuple[bytes, bytes]]:
            return _joined(*map(list, zip(*held)), share) if held else []

        def table(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*pairs) if pairs else ((), ()))], ["a", "b"])

        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            ends, values = batch.column("items").offsets.to_numpy(), batch.column("items").values.to_numpy()
            block = zip(*(batch.column(c).to_pylist() for c in by))
            rest = zip(*(batch.column(c).to_pylist() for c in ("root", "side")))
            for i, (name, member) in enumerate(zip(block, rest)):
                if name != at:
                    out += links()
                    at, held = name, []
                held.append((*member, values[ends[i] : ends[i + 1]]))
            yield table(out)
            held = [(*m, s.copy()) for *m, s in held]  # lets the batch go
        yield table(links())

    dealt = rows.select(*by, "root", "side", "items").repartition(*by).sortWithinPartitions(*by, "side")
    return cut_lineage(dealt.mapInArrow(run, "a binary, b binary"))


def _blocks(weight: Column) -> Column:
    return F.ceil(weight / DOCS).cast("int")


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """`members(digest, ...)` with `root`: the smallest digest that `links` connect each to."""
    ends = links.select(F.explode_outer(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    root = components(links, ends)
    return members.join(root, members["digest"] == root["node"], "left").select(*(members[c] for c in members.columns), F.coalesce("root", "digest").alias("root"))


def _unsettled(placed: DataFrame) -> tuple[DataFrame, int]:
    """Members `placed(family, root, ...)` of families with several roots, and how many roots these are."""
    open_ = placed.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("family")
    left = cut_lineage(placed.join(open_, "family", "left_semi"))
    return left, left.select("root").distinct().count()


def _across(left: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links between blocks of `left(digest, family, weight, root, items)`, each two blocks of a family once."""
    sizes = left.groupBy("family", "root").agg(F.sum("weight").alias("size"))
    sizes = sizes.withColumn("own", F.col("size") * 2 >= DOCS)
    mixed = sizes.where("not own").groupBy("family").agg(_blocks(F.sum("size")).alias("mixed"))
    sizes = sizes.join(mixed, "family", "left")
    number = F.when(F.col("own"), F.pmod(F.xxhash64("digest"), _blocks(F.col("size")))).otherwise(F.pmod(F.xxhash64("root"), F.col("mixed")))
    block = F.concat_ws(":", F.when(F.col("own"), F.hex("root")).otherwise(F.lit("mixed")), number.cast("string"))
    placed = cut_lineage(left.join(sizes, ["family", "root"]).select("family", "digest", "root", "items", "own", block.alias("block")))
    names = placed.select("family", "block", F.when(F.col("own"), F.col("root")).alias("whole")).distinct()
    x, y = (names.select("family", F.col("block").alias(c), F.col("whole").alias(f"whole_{c}")) for c in "xy")
    pairs = x.join(y, "family").where("x <= y and coalesce(whole_x <> whole_y, true)").select("family", "x", "y")
    sides = [placed.withColumnRenamed("block", c).join(pairs.where(only), ["family", c]).withColumn("side", F.lit(i)) for i, (c, only) in enumerate(
        (("x", "true"), ("y", "x < y")))]
    return _linked(sides[0].unionByName(sides[1]), ["family", "x", "y"], share)


def _contracted(stars: DataFrame) -> DataFrame:
    """(a, b): pairs that connect what `stars(a, b)`, each node with the smallest of each of its buckets, do.

    A member of a large family has a smallest node in each bucket, many of them
    different. Linked with the least of these, as they are themselves, it needs
    one pair, and the pairs among the few smallest nodes are the same for many.
    """
    held = stars.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("lows"))  # a bucket each, so never many
    own = held.select("a", F.col("least").alias("b"))
    return cut_lineage(own.union(held.select(F.explode("lows").alias("a"), F.col("least").alias("b")).where("a <> b")).distinct())


def members_of(docs: DataFrame, key: str, text: str, k: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(rows, members): `described` rows, and (digest, least, root) of every different set; `least` is its smallest key."""
    rows = cut_lineage(described(docs, key, text, k))
    sets = cut_lineage(rows.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("least"), F.min(F.struct("th", "id")).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    # 64 bits name a member here: two sets of one name would only make a family larger
    node = F.xxhash64("digest")
    entries = sets.select(node.alias("node"), F.explode_outer(bucket_keys(F.col("sig"))).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("bucket", "low")
    stars = _contracted(entries.join(shared, "bucket").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    family = components(stars, stars.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    listed = sets.select("digest", "at.th", "at.id", node.alias("node"), (F.floor(F.col("n") / ITEMS) + 1).cast("int").alias("weight")).join(
        family.withColumnRenamed("root", "family"), "node").drop("node")
    wanted = listed.join(listed.groupBy("family").agg(_blocks(F.sum("weight")).alias("blocks")), "family")
    full = cut_lineage(_with_sets(docs, key, text, k, wanted))
    alone = F.col("digest").alias("root")
    by_hash = lambda n: F.pmod(F.xxhash64("digest", F.lit(n)), F.col("blocks")).alias("block")
    links = _linked(full.select("*", alone, F.lit(0).alias("side"), by_hash(0)), ["family", "block"], share)
    # what a block connected has one root there: links lead to it
    local = links.withColumnRenamed("a", "digest").withColumnRenamed("b", "root")
    large = full.where("blocks > 1").join(local, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    left, n = _unsettled(large)
    if n:
        # many blocks are dealt anew first, so that fewer roots meet in the end
        many, step, before = left.where(F.col("blocks") > FEW), 0, 2 * n
        few = left.where(F.col("blocks") <= FEW)
        n = 0 if many.isEmpty() else n
        while n and 2 * n <= before:
            step, before = step + 1, n
            links = links.union(_linked(many.select("*", F.lit(0).alias("side"), by_hash(step)), ["family", "block"], share))
            many, n = _unsettled(_rooted(many.drop("root"), links))
        links = links.union(_across(few.unionByName(many), share))
    return rows, cut_lineage(_rooted(sets.select("digest", "least"), links))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """`key`, `n_shingles`, `component`, `kept` for every row: the component's smallest key, and whether it is this row's."""
    rows, members = members_of(docs, key, text, k, share)
    named = members.join(members.groupBy("root").agg(F.min("least").alias("component")), "root").select("digest", "component")
    lone = rows.where("digest is null").select("id", "n", F.col("id").alias("component"))
    out = rows.where("digest is not null").join(named, "digest").select("id", "n", "component").unionByName(lone)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row of `docs`, all columns, of each component: that of the smallest key, null keys last, then of the smallest text hash.

    Of rows that are equal in both any one stays. Rows whose text has no word all stay.
    """
    own_id, own_th = fresh(docs, "kept_id", "kept_th")
    rows, members = members_of(docs, key, text, k, share)
    named = rows.where("digest is not null").select("id", "th", "digest").join(members.select("digest", "root"), "digest")
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "th")
    each = named.groupBy("id", "th").agg(F.first("root").alias("root"), F.count("*").alias("times"))
    each = cut_lineage(each.join(named.groupBy("root").agg(F.min(order).alias("best")), "root").select(
        F.col("id").alias(own_id), F.col("th").alias(own_th), "times", (order == F.col("best")).alias("stays")))
    same = F.col(quoted(key)).eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(quoted(text))) == F.col(own_th))
    out = docs.join(each.where("not stays").select(own_id, own_th), same, "left_anti")
    twice = each.where("stays and times > 1").select(own_id, own_th)
    if not twice.isEmpty():
        repeated = out.join(twice, same).dropDuplicates([own_id, own_th]).select(*(F.col(quoted(c)) for c in docs.columns))
        out = out.join(twice, same, "left_anti").unionByName(repeated)
    return out
