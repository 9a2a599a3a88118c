"""Exact nearest neighbours by cosine, without an all-pairs result.

For every left row the `n` most similar right rows are kept. Only those leave a
task. A left side that the caller states to be small is sent to every task and
the right side is read once with no shuffle. Any other is cut, like the right
side, into blocks of bounded size per scope; each block pair is one small matrix product, so a scope
holding a third of all rows spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..session import cut_lineage

# Left sides up to this many rows are broadcast (4096 x 1536 doubles = 50 MB).
MAX_BROADCAST_ROWS = 4096
BLOCK_ROWS = 2048
#: Bytes of the vectors of one block, and its rows at most, where vectors leave nothing out; matrices stay those of BLOCK_ROWS.
COARSE_BYTES, COARSE_ROWS = 32 << 20, 65536
#: Pivots: one for so many right blocks, and how many at most.
PIVOT_BLOCKS, MAX_PIVOTS = 4, 256


def _unit(rows: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows as an object array plus their lengths; zero rows stay zero."""
    out = np.empty(len(rows), dtype=object)
    dims = np.zeros(len(rows), dtype=np.int64)
    for i, r in enumerate(rows):
        v = np.asarray(r, dtype=np.float64)
        n = np.sqrt(v @ v)
        out[i] = v / n if n > 0 else v
        dims[i] = v.size
    return out, dims


def _cosines(lv, ld, rv, rd) -> np.ndarray:
    """Cosine of every left row with every right row; 0 where lengths differ."""
    sims = np.zeros((len(lv), len(rv)))
    for d in np.unique(ld):
        li, ri = np.flatnonzero(ld == d), np.flatnonzero(rd == d)
        if d and li.size and ri.size:
            sims[np.ix_(li, ri)] = np.vstack(lv[li]) @ np.vstack(rv[ri]).T
    return np.round(sims, 6)


def _allowed(left: pd.DataFrame, right: pd.DataFrame, on, loose, exclude_self) -> np.ndarray:
    ok = np.ones((len(left), len(right)), dtype=bool)
    for c in on:
        ok &= left[c].to_numpy(object)[:, None] == right[c].to_numpy(object)[None, :]
    for c in loose:
        a, b = left[c].to_numpy(object)[:, None], right[c].to_numpy(object)[None, :]
        ok &= (a == b) | pd.isna(left[c]).to_numpy()[:, None] | pd.isna(right[c]).to_numpy()[None, :]
    if exclude_self:
        ok &= left["left_id"].to_numpy(object)[:, None] != right["right_id"].to_numpy(object)[None, :]
    return ok


def _best(left_ids, right_ids, sims, ok, n, min_sim):
    """Top `n` right ids per left row among the allowed ones."""
    if min_sim is not None:
        ok = ok & (sims >= min_sim)
    out_l, out_r, out_s = [], [], []
    order_ids = np.argsort(right_ids, kind="stable")
    if n == 1:  # the first of the largest, in order of id
        best = order_ids[np.where(ok, sims, -np.inf)[:, order_ids].argmax(axis=1)]
        rows = np.flatnonzero(ok[np.arange(len(left_ids)), best])
        return _pairs(left_ids[rows], right_ids[best[rows]], sims[rows, best[rows]])
    for i in range(len(left_ids)):
        cand = order_ids[ok[i, order_ids]]
        if cand.size > n:
            s = sims[i, cand]
            kth = np.partition(s, cand.size - n)[cand.size - n]
            cand = cand[s >= kth]
        cand = cand[np.argsort(-sims[i, cand], kind="stable")][:n]
        out_l.extend([left_ids[i]] * cand.size)
        out_r.extend(right_ids[cand])
        out_s.extend(sims[i, cand])
    return _pairs(out_l, out_r, out_s)


def _pairs(left_ids=(), right_ids=(), sims=()) -> pd.DataFrame:
    """Object columns, so that an empty block still has the key types."""
    return pd.DataFrame({"left_id": pd.Series(list(left_ids), dtype=object), "right_id": pd.Series(list(right_ids), dtype=object),
                         "sim": np.asarray(sims, dtype=float)})


def nearest(left: DataFrame, right: DataFrame, n: int, *, left_key: str = "query_id", right_key: str = "id",
            on: Sequence[str] = (), loose: Sequence[str] = (), min_sim: float | None = None,
            exclude_self: bool = False, small_left: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(left_key, right_key, sim, rank): top `n` per left row, ties by right id.

    `on` columns must be equal (null never matches), `loose` columns must be
    equal or null on either side. Both inputs carry an `embedding` array.
    `small_left` states that the left side has MAX_BROADCAST_ROWS rows at most,
    as a batch of questions has; a larger one is then refused.
    """
    extra = [*on, *loose]
    lt = left.schema[left_key].dataType
    rt = right.schema[right_key].dataType
    lf = left.select(F.col(left_key).alias("left_id"), *extra, "embedding")
    # aliased, so that a table can be compared with itself
    rf = right.select(F.col(right_key).alias("right_id"), *[F.col(c).alias(c) for c in [*extra, "embedding"]])
    if on:
        lf, rf = lf.dropna(subset=list(on)), rf.dropna(subset=list(on))
    schema = T.StructType([T.StructField("left_id", lt), T.StructField("right_id", rt),
                           T.StructField("sim", T.DoubleType())])
    if small_left:
        head = lf.limit(MAX_BROADCAST_ROWS + 1).toPandas()
        if len(head) > MAX_BROADCAST_ROWS:
            raise ValueError(f"the left side has more than {MAX_BROADCAST_ROWS} rows; leave small_left out")
        parts = _against_small(head, rf, n, on, loose, min_sim, exclude_self, schema)
    else:
        parts = _by_blocks(lf, rf, n, on, loose, min_sim, exclude_self, schema, block_rows)
    w = Window.partitionBy("left_id").orderBy(F.desc("sim"), F.col("right_id"))
    same = left_key == right_key
    return (
        parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        .withColumnRenamed("left_id", left_key)
        .withColumnRenamed("right_id", "other_id" if same else right_key)
    )


def _against_small(head, rf, n, on, loose, min_sim, exclude_self, schema) -> DataFrame:
    lv, ld = _unit(head["embedding"].tolist())
    cols = head.drop(columns=["embedding"])
    shared = rf.sparkSession.sparkContext.broadcast((cols, lv, ld))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, vecs, dims = shared.value
        left_ids = left["left_id"].to_numpy(object)
        best = None
        for batch in batches:
            if batch.empty or left.empty:
                continue
            rv, rd = _unit(batch["embedding"].tolist())
            got = _best(left_ids, batch["right_id"].to_numpy(object), _cosines(vecs, dims, rv, rd),
                        _allowed(left, batch, on, loose, exclude_self), n, min_sim)
            if best is not None:
                got = pd.concat([best, got], ignore_index=True)
                got = got.sort_values(["sim", "right_id"], ascending=[False, True], kind="stable")
                got = got.groupby("left_id", sort=False).head(n)
            best = got
        if best is not None and len(best):
            yield best

    return rf.mapInPandas(scan, schema)


def _pivots(rf: DataFrame, most: int) -> np.ndarray:
    """Up to `most` unit vectors of one length, those of smallest id hash: a bounded sample on the driver."""
    rows = rf.select("embedding").where("size(embedding) > 0").orderBy(F.xxhash64(rf["right_id"])).limit(most).collect()
    units, dims = _unit([r[0] for r in rows])
    own = [u for u, d in zip(units, dims) if d == dims[0] and np.all(np.isfinite(u)) and u @ u > 0.5]
    return np.vstack(own) if own else np.zeros((0, 1))


def _celled(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """`df` with `cell`, the nearest pivot, and `angle` to it. Rows that no angle is defined for have cell -1."""

    @F.pandas_udf("cell int, angle double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        units, dims = _unit(vectors.tolist())
        cell, angle = np.full(len(units), -1, np.int32), np.zeros(len(units))
        own = np.array([i for i, (u, d) in enumerate(zip(units, dims)) if d == pivots.shape[1] and u @ u > 0.5], dtype=np.int64)
        if own.size:
            cos = np.vstack(units[own]) @ pivots.T
            cell[own] = cos.argmax(axis=1)
            angle[own] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
        return pd.DataFrame({"cell": cell, "angle": angle})

    return df.withColumn("at", place("embedding")).select("*", "at.cell", "at.angle").drop("at")


def _blocked(df: DataFrame, key: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with `block`, blocks(scope, cell, block, n, low, high)) of a celled table."""
    sizes = df.groupBy("scope", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("cut"))
    rows = cut_lineage(df.join(sizes, ["scope", "cell"]).withColumn("block", F.pmod(F.xxhash64(key), F.col("cut")).cast("int")).drop("cut"))
    return rows, rows.groupBy("scope", "cell", "block").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))


def closest_angle(apart: Column, l_low: Column, l_high: Column, r_low: Column, r_high: Column) -> Column:
    """Least angle between rows at l_low to l_high from one pivot and rows at r_low to r_high from another, `apart` from it."""
    near, far = F.greatest(F.lit(0.0), apart - l_high, l_low - apart), F.least(F.lit(np.pi), apart + l_high)
    return F.greatest(F.lit(0.0), near - r_high, r_low - far)


def block_pairs(left_blocks: DataFrame, right_blocks: DataFrame, pivots: np.ndarray, min_sim: float | None) -> DataFrame:
    """(scope, cell, block, r_cell, r_block, kept) of all pairs of blocks of a scope but those that met first.

    `left_blocks` has `reached`, the least n-th cosine of its rows so far, null if some row has fewer.
    """
    angles = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    spark = left_blocks.sparkSession
    apart = spark.createDataFrame([(i, j, float(angles[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "cell int, r_cell int, apart double")
    right = right_blocks.select("scope", F.col("cell").alias("r_cell"), F.col("block").alias("r_block"), F.col("low").alias("r_low"), F.col("high").alias("r_high"))
    pairs = left_blocks.join(right, "scope").join(F.broadcast(apart), ["cell", "r_cell"], "left")  # pivots squared: 65,536 rows at most
    best = F.cos(closest_angle(F.col("apart"), F.col("low"), F.col("high"), F.col("r_low"), F.col("r_high")))
    # cosines are rounded to six places; without an angle nothing is known
    enough = F.greatest(F.coalesce("reached", F.lit(-2.0)), F.lit(-2.0 if min_sim is None else min_sim)) - 1e-5
    met = (F.col("cell") == F.col("r_cell")) & (F.col("r_block") == F.col("first"))
    return pairs.where(~F.coalesce(met, F.lit(False))).select("scope", "cell", "block", "r_cell", "r_block", F.coalesce(best >= enough, F.lit(True)).alias("kept"))


def _every_pair(lf: DataFrame, rf: DataFrame, cell: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType, block_rows: int) -> DataFrame:
    nl = lf.groupBy("scope").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("nl"))
    nr = rf.groupBy("scope").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("nr"))
    sizes = nl.join(nr, "scope")
    lb = (lf.join(sizes, "scope").withColumn("lb", F.expr("cast(pmod(xxhash64(left_id), nl) as int)"))
          .withColumn("rb", F.explode(F.expr("sequence(0, nr - 1)"))).drop("nl", "nr"))
    rb = (rf.join(sizes, "scope").withColumn("rb", F.expr("cast(pmod(xxhash64(right_id), nr) as int)"))
          .withColumn("lb", F.explode(F.expr("sequence(0, nl - 1)"))).drop("nl", "nr"))

    keys = ["scope", "lb", "rb"]
    return lb.groupBy(*keys).cogroup(rb.groupBy(*keys)).applyInPandas(cell, schema)


def _coarse_rows(spark: SparkSession, dims: int, r_blocks: DataFrame, block_rows: int) -> int:
    """Rows of a block where every pair of blocks meets: large, so that few copies of a row are made, but enough blocks for all cores."""
    n = r_blocks.agg(F.sum("n")).head()[0] or 1
    cuts = int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))
    return int(max(block_rows, min(COARSE_ROWS, COARSE_BYTES // (8 * dims), -(-n // cuts))))


def _copies_in_coarse(l_blocks: DataFrame, r_blocks: DataFrame, rows: int) -> int:
    """Rows sent if every block of `rows` rows meets every other of its scope."""
    size = lambda blocks, name: blocks.groupBy("scope").agg(F.sum("n").alias(name))
    sent = F.col("l") * F.ceil(F.col("r") / rows) + F.col("r") * F.ceil(F.col("l") / rows)
    return size(l_blocks, "l").join(size(r_blocks, "r"), "scope").agg(F.sum(sent)).head()[0] or 0


def _copies_in_pairs(pairs: DataFrame, l_blocks: DataFrame, r_blocks: DataFrame) -> int:
    """Rows sent if the blocks of `pairs` meet."""
    mine = l_blocks.select("scope", "cell", "block", F.col("n").alias("l"))
    theirs = r_blocks.select("scope", F.col("cell").alias("r_cell"), F.col("block").alias("r_block"), F.col("n").alias("r"))
    return pairs.join(mine, ["scope", "cell", "block"]).join(theirs, ["scope", "r_cell", "r_block"]).agg(F.sum(F.col("l") + F.col("r"))).head()[0] or 0


def _by_blocks(lf, rf, n, on, loose, min_sim, exclude_self, schema, block_rows) -> DataFrame:
    scope = F.struct(*[F.col(c) for c in on]) if on else F.lit(0)
    lf, rf = lf.withColumn("scope", F.xxhash64(scope)), rf.withColumn("scope", F.xxhash64(scope))
    pivots = _pivots(rf, int(min(MAX_PIVOTS, -(-rf.count() // (PIVOT_BLOCKS * block_rows)))))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return _pairs()
        a, b = a.reset_index(drop=True), b.reset_index(drop=True)
        lv, ld = _unit(a["embedding"].tolist())
        rv, rd = _unit(b["embedding"].tolist())
        return _best(a["left_id"].to_numpy(object), b["right_id"].to_numpy(object), _cosines(lv, ld, rv, rd), _allowed(a, b, on, loose, exclude_self), n, min_sim)

    def tiled(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        for i in range(0, len(a), block_rows):
            parts = [cell(a[i : i + block_rows], b[j : j + block_rows]) for j in range(0, len(b), block_rows)]
            best = pd.concat([p for p in parts if len(p)] or [_pairs()], ignore_index=True)
            found.append(best.sort_values(["sim", "right_id"], ascending=[False, True], kind="stable").groupby("left_id", sort=False).head(n))
        return pd.concat(found, ignore_index=True) if found else _pairs()

    if len(pivots) < 2:  # a few blocks: there is nothing to leave out
        return _every_pair(lf, rf, cell, schema, block_rows)
    left, l_blocks = _blocked(_celled(lf, pivots), "left_id", block_rows)
    right, r_blocks = _blocked(_celled(rf, pivots), "right_id", block_rows)

    def met(pairs: DataFrame) -> DataFrame:
        keys = ["scope", "cell", "block", "r_cell", "r_block"]
        mine = left.join(pairs, ["scope", "cell", "block"])
        again = pairs.select(*(F.col(c).alias(c) for c in keys))  # columns of their own: both sides meet
        theirs = right.withColumnRenamed("cell", "r_cell").withColumnRenamed("block", "r_block").join(again, ["scope", "r_cell", "r_block"])
        return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(cell, schema)

    # one right block of the same pivot for each left block: as many copies of a row as blocks of a size meet
    cuts = r_blocks.groupBy("scope", "cell").agg(F.count("*").alias("cut"))
    l_blocks = l_blocks.join(cuts, ["scope", "cell"], "left").withColumn("first", F.pmod("block", "cut").cast("int")).drop("cut")
    first = cut_lineage(met(l_blocks.where("first is not null").select("scope", "cell", "block", F.col("cell").alias("r_cell"), F.col("first").alias("r_block"))))
    kth = first.withColumn("k", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("sim")))).where(F.col("k") == n).select("left_id", "sim")
    reached = left.select("scope", "cell", "block", "left_id").join(kth, "left_id", "left").groupBy("scope", "cell", "block").agg(
        F.when(F.count("sim") == F.count("*"), F.min("sim")).alias("reached"))
    pairs = cut_lineage(block_pairs(l_blocks.join(reached, ["scope", "cell", "block"]), r_blocks, pivots, min_sim))
    rows = _coarse_rows(rf.sparkSession, pivots.shape[1], r_blocks, block_rows)
    if _copies_in_coarse(l_blocks, r_blocks, rows) < _copies_in_pairs(pairs.where("kept"), l_blocks, r_blocks):
        own = lambda df: df.drop("cell", "angle", "block")
        return _every_pair(own(left), own(right), tiled, schema, rows)
    return first.unionByName(met(cut_lineage(pairs.where("kept").drop("kept"))))
