"""Vector column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a norm is zero or the lengths differ. Rounded to 6 places."""
    na, nb = norm(a), norm(b)
    ok = (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.round(F.when(ok, dot(a, b) / (na * nb)).otherwise(F.lit(0.0)), 6)


def mean_vector_parts(df, keys: list[str], vec: str = "embedding"):
    """Element-wise mean of `vec` per `keys`, as array<double> column `centroid`."""
    parts = (
        df.select(*keys, F.posexplode(vec).alias("pos", "val"))
        .groupBy(*keys, "pos").agg(F.avg(F.col("val").cast("double")).alias("m"))
    )
    return parts.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
