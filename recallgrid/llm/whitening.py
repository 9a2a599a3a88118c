"""Embedding whitening with exact cross-products from bit planes.

Every entry c becomes the integer x = floor(256 * c). The model is fitted on each
distinct x-vector once (the fit list):

1. One pass finds each dimension's least and greatest x. u = x - least has no
   sign and as many bits as the widest dimension needs; its bytes are what is
   made distinct and kept.
2. Bit-sliced scatter: bit p of dimension a over 64 rows is one 64-bit word.
   Sum(u_a * u_b) = sum over p, q of 2^(p+q) * popcount(plane(a, p) & plane(b, q)),
   an exact integer whatever the order of rows. Tasks add them up over their rows
   and give one row per pair of dimensions; limbs of 30 bits keep Spark's sums exact.
3. n * Sum(u_a * u_b) - Sum(u_a) * Sum(u_b) over n^2 is the covariance, centred
   as integers; only then it becomes floating point, for eigh.

The driver holds matrices of dimensions squared, never rows. A vector that a third
of all rows repeat is one row of the fit list from each task on.

Defined results: a vector that is null, holds a null, a NaN or an infinity, or an
entry outside +-2^52 / 256, is left out, as is one whose length is not the
commonest (the longer one of a tie); rows with one key or vector are rows of
their own; a null key passes; other columns pass through, whatever their names; an
eigenvalue under 1e-12 of the trace is no variance: its component is 0 for every
row, explains 0 and does not count in `identity_error`; with no row left, or
vectors of no entries, there is no component and no row. `deviation` is null
where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import fresh, quoted

SCALE, LIMIT = 256.0, float(1 << 52)
#: Rows sliced at once, a multiple of the 64 rows of a word.
SLICE = 4096
_LIMB = 30


def _rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries of all vectors one after the other as doubles, first entry of each, length of each; -1 for null)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    starts = vectors.offsets.to_numpy()
    size = np.diff(starts)
    if vectors.null_count:
        size = np.where(vectors.is_null().to_numpy(zero_copy_only=False), -1, size)
    return vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), starts[:-1], size


def integers(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows that count, their x-vectors): those of length `d` whose entries are all in range."""
    flat, starts, size = _rows(vectors)
    rows = np.flatnonzero(size == d)
    with np.errstate(over="ignore"):
        c = flat[starts[rows][:, None] + np.arange(d)] * SCALE
    good = (np.abs(c) < LIMIT).all(axis=1)  # false for nulls, NaN and infinities
    return rows[good], np.floor(c[good]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """n x-vectors of the fit list, sums per dimension, components as rows, eigenvalues, shares of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components): n * x - S is exact; one division, one projection."""
        scale = np.array([v**-0.5 if v > 0 else 0.0 for v in self.values])
        return self.centred(x).astype(np.float64) / self.n @ self.components.T * scale

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in Python's integers where 64 bits may not hold it or the sum of its squares."""
        most = (self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums.tolist()), default=0)) ** 2 * max(len(self.sums), 1)
        return self.n * (x if most < 2**63 else x.astype(object)) - self.sums

    def deviations(self, x: np.ndarray) -> list[int | None]:
        return [v if v < 2**63 else None for v in (self.centred(x) ** 2).sum(axis=1).tolist()]


def lengths_and_ranges(vectors: DataFrame) -> tuple[int, list[int], list[int]]:
    """Commonest length of `vectors(v)`, and each dimension's least and greatest x."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = {}, {}, {}
        for batch in batches:
            for d in np.unique(_rows(batch.column(0))[2]).tolist():
                if d > 0 and len(x := integers(batch.column(0), d)[1]):
                    count[d] = count.get(d, 0) + len(x)
                    low[d] = np.minimum(low.get(d, x[0]), x.min(axis=0))
                    high[d] = np.maximum(high.get(d, x[0]), x.max(axis=0))
        rows = [(d, j, count[d], int(low[d][j]), int(high[d][j])) for d in count for j in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], ["d", "j", "n", "low", "high"])

    found = cut_lineage(vectors.mapInArrow(run, "d long, j long, n long, low long, high long"))
    most = found.where("j = 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    if most is None:
        return 0, [], []
    ranges = found.where(F.col("d") == most.d).groupBy("j").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("j").collect()
    return most.d, [r.low for r in ranges], [r.high for r in ranges]


def fit_list(vectors: DataFrame, low: list[int], width: int) -> DataFrame:
    """(u): each distinct x-vector of `vectors(v)` once, less `low`, as bytes of `width` a number."""
    base = np.array(low, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = (integers(batch.column(0), len(base))[1] - base).astype(f"<u{width}")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in u], pa.binary())], ["u"])

    return vectors.mapInArrow(run, "u binary").groupBy("u").agg(F.lit(1).alias("_")).select("u")


def _unpacked(batch: pa.RecordBatch, d: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}").reshape(-1, d)


def bit_planes(u: np.ndarray, bits: int) -> np.ndarray:
    """(bit, dimension, word): bit p of dimension a of 64 rows in one word."""
    rows = np.zeros((-(-len(u) // 64) * 64, u.shape[1]), np.uint64)
    rows[: len(u)] = u
    shifted = (rows.T[None] >> np.arange(bits, dtype=np.uint64)[:, None, None]) & np.uint64(1)
    return np.ascontiguousarray(np.packbits(shifted.astype(np.uint8), axis=2, bitorder="little")).view(np.uint64)


def scatter(u: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the columns of `u` by weighted counts of common bits, exact Python integers past 62 bits."""
    planes, d = bit_planes(u, bits), u.shape[1]
    kind = np.int64 if 2 * bits + len(u).bit_length() < 63 else object
    sums, cross = np.zeros(d, kind), np.zeros((d, d), kind)
    for p in range(bits):
        sums = sums + np.bitwise_count(planes[p]).sum(axis=1, dtype=np.int64).astype(kind) * (1 << p)
        for q in range(p, bits):
            for a in range(d):
                common = np.bitwise_count(planes[p, a] & planes[q]).sum(axis=1, dtype=np.int64).astype(kind) * (1 << (p + q))
                cross[a] += common
                if p != q:
                    cross[:, a] += common
    return sums, cross


def cross_products(fit: DataFrame, d: int, bits: int, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums and cross-products of `fit(u)`, exact."""
    limbs = -(-(2 * bits + 64) // _LIMB)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                u = _unpacked(batch.slice(start, SLICE), d, width)
                s, c = scatter(u, bits)
                n, sums, cross = n + len(u), sums + s, cross + c
        if n:
            rows = [(-1, -1, n), *((-1, j, int(v)) for j, v in enumerate(sums)), *((a, b, int(cross[a, b])) for a in range(d) for b in range(a, d))]
            a, b, v = zip(*rows)
            cut = [pa.array([x >> _LIMB * i & (1 << _LIMB) - 1 for x in v], pa.int64()) for i in range(limbs)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *cut], ["a", "b", *names])

    names = [f"l{i}" for i in range(limbs)]
    parts = fit.mapInArrow(run, f"a long, b long, {', '.join(f'{c} long' for c in names)}")
    whole = {(r.a, r.b): sum(r[c] << _LIMB * i for i, c in enumerate(names)) for r in parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in names)).collect()}
    return whole[-1, -1], [whole[-1, j] for j in range(d)], [[whole[min(a, b), max(a, b)] for b in range(d)] for a in range(d)]


def fit(vectors: DataFrame, n_components: int = 4) -> tuple[Model | None, float]:
    """The model of `vectors(v array<double>)`, and the largest entry of its whitened covariance less the identity."""
    d, low, high = lengths_and_ranges(vectors)
    if not d:
        return None, 0.0
    bits = max(max(b - a for a, b in zip(low, high)).bit_length(), 1)
    width = next(w for w in (1, 2, 4, 8) if bits <= 8 * w)
    listed = cut_lineage(fit_list(vectors, low, width))
    n, u, cross = cross_products(listed, d, bits, width)
    covariance = np.array([[(n * cross[a][b] - u[a] * u[b]) / n**2 for b in range(d)] for a in range(d)])
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:n_components]
    values, components = values[order], columns.T[order]
    trace = sum(n * cross[a][a] - u[a] ** 2 for a in range(d)) / n**2
    values = np.where(values > 1e-12 * trace, values, 0.0)
    sign = np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])
    sums = np.array([s + n * m for s, m in zip(u, low)], object)
    sums = sums.astype(np.int64) if max(map(abs, sums.tolist())) < 2**62 else sums
    model = Model(n, sums, components * sign[:, None], values, values / trace if trace > 0 else values)
    return model, identity_error(listed, model, low, width)


def identity_error(listed: DataFrame, model: Model, low: list[int], width: int) -> float:
    """Measured over the fit list. x - S/n has mean 0 exactly, so products of whitened rows are of centred ones."""
    base, kept = np.array(low, np.int64), model.values > 0
    k = int(kept.sum())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = model.whitened(_unpacked(batch, len(base), width).astype(np.int64) + base)[:, kept]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k)), pa.array(np.tile(np.arange(k), k)), pa.array(total.ravel())], ["a", "b", "v"])

    parts = listed.mapInArrow(run, "a long, b long, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect()
    return max((abs(r.v / model.n - (r.a == r.b)) for r in parts), default=0.0)


def whiten(df: DataFrame, vector: str = "embedding", n_components: int = 4) -> tuple[DataFrame, Model | None, float]:
    """`df`'s rows whose vector counts, with `deviation` and `whitened` (an array); the model; its identity error."""
    entries = df[quoted(vector)].cast("array<double>")
    model, error = fit(df.select(entries.alias("v")), n_components)
    (out, deviation, whitened) = fresh(df, "out", "deviation", "whitened")

    def project(v: pa.Array) -> pa.Array:
        rows, x = integers(v, len(model.sums)) if model else (np.empty(0, np.int64), None)
        result = [None] * len(v)
        if len(rows):
            for i, far, w in zip(rows.tolist(), model.deviations(x), model.whitened(x).tolist()):
                result[i] = {"deviation": far, "whitened": w}
        return pa.array(result, pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))]))

    # as if not deterministic: else the filter would be pushed below and compute it again
    projected = F.arrow_udf(project, "struct<deviation: bigint, whitened: array<double>>").asNondeterministic()
    kept = df.withColumn(out, projected(entries)).where(F.col(out).isNotNull())
    own = [F.col(quoted(c)) for c in df.columns]
    return kept.select(*own, F.col(f"{out}.deviation").alias(deviation), F.col(f"{out}.whitened").alias(whitened)), model, error
