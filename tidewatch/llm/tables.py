"""Lineage cuts: intermediate results written as Parquet to the cluster's shared folder.

Files live under ``spark.checkpoint.dir``, which every executor and the driver share, so a lost
executor never takes an intermediate result with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import checkpoint_dir, owned


class Scratch:
    """A fresh shared folder for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/tidewatch-llm/{name}-{uuid.uuid4().hex}"
        self._made: list[Table] = []

    def write(self, df: DataFrame, result: bool = False) -> "Table":
        """A table of this folder; a ``result`` outlives the ``scratch_tables`` block it is written in."""
        path = f"{self.root}/t{len(self._made):03d}"
        if not result:
            owned(path)
        df.write.parquet(path)
        self._made.append(Table(self.spark, path, df.schema))
        return self._made[-1]

    def clear(self, *keep: "Table") -> None:
        """Drop what this folder holds besides ``keep``; nothing lazy may depend on it any more."""
        paths = {t.path for t in keep}
        for t in self._made:
            if t.path not in paths:
                t.drop()


class Table:
    """A written intermediate table; ``drop`` deletes exactly the folder it was written to."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm, jsc = self.spark._jvm, self.spark._jsc
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
