"""Tables that are folders of files, as large ones are."""

import os

import pytest

import __spark_entry__ as entry
from recallgrid.session import scratch_path

from .conftest import SMALL


@pytest.mark.parametrize("name, table", [("M3_micro_batches", "documents"), ("M6_ingest_stream", "documents"), ("M4_sliding_failures", "events")])
def test_streams_read_folders(spark, name, table):
    folder = scratch_path(spark, "folders")
    os.makedirs(folder)
    for f in os.listdir(SMALL):
        if f != f"{table}.parquet":
            os.symlink(f"{SMALL}/{f}", f"{folder}/{f}")
    spark.read.parquet(f"{SMALL}/{table}.parquet").repartition(3).write.parquet(f"{folder}/{table}.parquet")
    got = lambda path: sorted(map(str, entry.queries()[name](spark, path).collect()))
    assert got(folder) == got(SMALL) != []
