"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: The six bytes that end a word, \x09-\x0D and \x20.
SPACES = " \t\n\r\x0b\x0c"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each lengthened until no column of `df` has it (names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is. Texts of ASCII only take the fast function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, inside expressions where no column can be added."""
    return F.element_at(F.transform(F.array(value), use), 1)


def smallest_by_hash(rows: DataFrame, label: str, pick: Column, per_label: int) -> DataFrame:
    """At most `per_label` different rows of each value of `label`: those with the smallest `pick`, a 64-bit hash.

    `label` has few values (verdicts, languages); their numbers of different
    hashes, estimated by sketches, come to the driver. They give a bound on the
    hash that about four times `per_label` different rows of a label stay under,
    so what is sorted in the end does not grow with the table, its partitions or
    its copies. A label with too few rows under its bound is tried again with
    a larger one.
    """
    different = dict(rows.groupBy(label).agg(F.approx_count_distinct(pick)).collect())
    share = dict.fromkeys(different, 4)
    while True:
        bound = F.lit(None).cast("long")
        for value, n in different.items():
            most = 2**63 - 1 if n <= share[value] * per_label else -(2**63) + 2**64 * share[value] * per_label // n
            bound = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(most).cast("long")).otherwise(bound)
        few = cut_lineage(rows.withColumn("pick", pick).where(F.col("pick") <= bound).distinct())
        found = dict(few.groupBy(label).count().collect())
        short = [v for v, n in different.items() if found.get(v, 0) < per_label and n > share[v] * per_label]
        if not short:
            break
        share |= {v: 4 * share[v] for v in short}
    place = F.row_number().over(Window.partitionBy(label).orderBy("pick", *rows.columns))
    return few.withColumn("place", place).where(F.col("place") <= per_label).drop("place", "pick")


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices whose `column` holds about `budget` bytes; a longer value stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
