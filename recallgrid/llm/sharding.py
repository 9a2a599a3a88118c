"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Each partition puts its rows in random order (a local sort, no exchange).
2. How many rows partition p sends to shard s is drawn for all p and s at once,
   as it would come out in a uniform permutation of all rows: a tree over the
   partitions halves them again and again, and at each node the counts of the
   left half are drawn from the hypergeometric distribution given the node's.
   Rows then go to shards by their place in the local order.
3. Rows are exchanged by (shard, bucket of a second random number) and sorted
   there: the second permutation, in groups of about ROWS_PER_BUCKET rows.

Every permutation of the rows over the slots is equally likely, up to the 64-bit
numbers that stand for chance, and shard sizes are exact: at most one apart.
The partition layout is checkpointed once, so a lost executor changes nothing.

Defined results: rows are dealt, whatever they hold, so null, repeated, long and
empty texts are all the same; other columns pass through, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import fresh, let

ROWS_PER_BUCKET = 100_000


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _span(first: Column, last: Column, step: int) -> Column:
    """first, first + step, ... last; empty if `last` lies before `first`."""
    inside = first <= last if step > 0 else first >= last
    return F.when(inside, F.sequence(F.when(inside, first).otherwise(last), last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(good: Column, bad: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of good + bad are good, by inversion at `u`.

    Outcomes are listed from the mode outwards, with weights by the ratio of
    neighbours; those 12 standard deviations away weigh nothing in a double.
    """

    def body(v: Column) -> Column:
        g, b, n, x = (v[k] for k in "gbnx")
        total = (g + b).cast("double")
        mode = F.floor((n + 1) * (g + 1) / (total + 2)).cast("long")
        reach = (F.ceil(12 * F.sqrt(F.greatest(n * (g / total) * (b / total) * ((total - n) / F.greatest(total - 1, F.lit(1.0))), F.lit(0.0)))) + 30).cast("long")
        low = F.greatest(F.lit(0).cast("long"), n - b, mode - reach)
        high = F.least(g, n, mode + reach)
        first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

        def up(s: Column, k: Column) -> Column:  # from k - 1 to k
            w = s["w"] * ((g - k + 1) * 1.0 * (n - k + 1)) / (k * 1.0 * (b - n + k))
            return let(w, lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))

        def down(s: Column, k: Column) -> Column:  # from k + 1 to k
            w = s["w"] * ((k + 1) * 1.0 * (b - n + k + 1)) / ((g - k) * 1.0 * (n - k))
            return let(w, lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))

        above, below = _span(mode + 1, high, 1), _span(mode - 1, low, -1)
        mass = 1.0 + F.aggregate(above, first, up)["sum"] + F.aggregate(below, first, down)["sum"]

        def choose(left: Column) -> Column:
            """`left` of the mass is to be used up: by the mode, the outcomes above, those below."""

            def pick(step):
                def merge(s: Column, k: Column) -> Column:
                    nxt = step(s, k)
                    return let(nxt, lambda t: F.struct(t["w"].alias("w"), t["sum"].alias("sum"),
                                                       F.when((s["k"] < 0) & (t["sum"] > s["left"]), k).otherwise(s["k"]).alias("k"), s["left"].alias("left")))

                return merge

            def start(rest: Column) -> Column:
                return F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"), rest.alias("left"))

            def in_two(over: Column) -> Column:
                rest = left - 1.0 - over["sum"]
                return F.when(over["k"] >= 0, over["k"]).otherwise(
                    let(F.aggregate(below, start(rest), pick(down)), lambda under: F.when(under["k"] >= 0, under["k"]).otherwise(mode)))

            return F.when(left < 1.0, mode).otherwise(let(F.aggregate(above, start(left - 1.0), pick(up)), in_two))

        return F.when(g + b == 0, F.lit(0).cast("long")).otherwise(let(x * mass, choose))

    return let(F.struct(good.cast("long").alias("g"), bad.cast("long").alias("b"), drawn.cast("long").alias("n"), u.alias("x")), body)


def _left_half(columns: Column, drawn: Column, seed: int, node: Column) -> Column:
    """Of the counts in array `columns`, those of `drawn` rows drawn without replacement."""
    total = F.aggregate(columns, F.lit(0).cast("long"), lambda a, v: a + v)

    def one(s: Column, at: Column) -> Column:
        good = F.element_at(columns, at + 1)
        draw = hypergeometric(good, s["rest"] - good, s["left"], _unit(F.lit(seed), node, at))
        return let(draw, lambda k: F.struct((s["left"] - k).alias("left"), (s["rest"] - good).alias("rest"), F.concat(s["out"], F.array(k)).alias("out")))

    start = F.struct(drawn.cast("long").alias("left"), total.alias("rest"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(columns) - 1), start, one)["out"]


def communication_matrix(sizes: DataFrame, shard_sizes: list[int], n_partitions: int, seed: int = 0) -> DataFrame:
    """(p, row): for each partition of `sizes(p, n)` how many rows it sends to each shard.

    The list of partitions is as long as the scheduler's own list of tasks.
    """
    nodes = sizes.agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("parts")).select(
        F.lit(1).cast("long").alias("node"), "parts", F.lit(shard_sizes).cast("array<bigint>").alias("row"))
    for level in range(max(0, n_partitions - 1).bit_length()):
        half = F.floor(F.size("parts") / 2).cast("int")
        left = F.slice("parts", 1, half)
        rows = F.aggregate(left, F.lit(0).cast("long"), lambda a, v: a + v["n"])
        split = nodes.withColumn("half", half).withColumn("drawn", F.when(F.size("parts") > 1, _left_half(F.col("row"), rows, seed, F.col("node"))))
        two = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.slice("parts", 1, F.col("half")).alias("parts"), F.col("drawn").alias("row")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("slice(parts, half + 1, size(parts) - half)").alias("parts"),
                     F.zip_with("row", "drawn", lambda a, b: a - b).alias("row")))
        one = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("parts"), F.col("row")))
        nodes = split.select(F.inline_outer(F.when(F.size("parts") > 1, two).otherwise(one)))
        if level % 3 == 2:
            nodes = cut_lineage(nodes.repartition(min(2 ** (level + 1), 64), "node"))
    return nodes.select(F.col("parts")[0]["p"].alias("p"), "row")


def shuffle_shards(df: DataFrame, n_shards: int, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`df` with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    If `df` has columns of these names, the new ones get a leading underscore.
    """
    shard, slot, p, place, first, second, bucket, row, offset = fresh(df, "shard", "slot", "part", "place", "first", "second", "bucket", "counts", "offset")
    at = F.monotonically_increasing_id()
    local = (df.withColumn(place, at).withColumn(first, F.xxhash64(F.lit(seed), F.lit("first"), F.col(place)))
             .withColumn(second, F.xxhash64(F.lit(seed), F.lit("second"), F.col(place))).sortWithinPartitions(first, place))
    # partition in the upper 31 bits, place in the local order in the lower 33
    staged = cut_lineage(local.withColumn(place, at).drop(first).withColumn(p, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1)))
    sizes = cut_lineage(staged.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n")))
    total, n_partitions = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not total:
        return df.withColumn(shard, F.lit(0)).withColumn(slot, F.lit(0).cast("long")).where("false")
    even = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(sizes, even, n_partitions, seed).select(
        F.col("p").alias(p), F.expr("transform(row, (v, i) -> aggregate(slice(row, 1, i + 1), 0L, (a, x) -> a + x))").alias(row))
    matrix = cut_lineage(matrix)
    n_buckets = max(1, -(-total // (n_shards * rows_per_bucket)))
    sent = staged.join(matrix, p).withColumn(shard, F.size(F.filter(row, lambda v: v <= F.col(place)))).withColumn(
        bucket, F.shiftright(F.shiftrightunsigned(F.col(second), 32) * F.lit(n_buckets), 32))
    offsets = sent.groupBy(shard, bucket).agg(F.count("*").alias("n")).withColumn(
        offset, F.sum("n").over(Window.partitionBy(shard).orderBy(bucket)) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(second, p, place))
    return sent.withColumn(slot, rank - 1).join(offsets, [shard, bucket]).select(
        *(F.col(f"`{c}`") for c in df.columns), F.col(shard).cast("int").alias(shard), (F.col(slot) + F.col(offset)).cast("long").alias(slot))
