"""Intermediate tables belong to the block they are written in."""

import os

from pyspark.sql import functions as F

from tidewatch.operators.search import search
from tidewatch.session import checkpoint_dir, scratch_tables, written


def tables(spark):
    return set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))


def test_tables_go_with_their_block(spark):
    before = tables(spark)
    kept = written(spark.range(3), "kept")
    docs = spark.createDataFrame([("1", "river high"), ("2", "dry")], "tweetid string, text string")
    with scratch_tables(spark):
        inner = written(spark.range(5), "inner")
        with scratch_tables(spark):
            assert search(docs, "river", ["text"]).count() == 1 and inner.count() == 5
            assert len(tables(spark) - before) == 3
        assert inner.agg(F.sum("id")).first()[0] == 10 and len(tables(spark) - before) == 2
    assert kept.count() == 3 and len(tables(spark) - before) == 1


def test_tables_go_when_the_block_fails(spark):
    before = tables(spark)
    try:
        with scratch_tables(spark):
            written(spark.range(2), "lost")
            raise RuntimeError("stop")
    except RuntimeError:
        pass
    assert tables(spark) == before
