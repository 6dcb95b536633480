"""A table by key that micro-batches update in place (ST1): hash buckets, runs and a manifest per version.

A key belongs to one of a fixed number of buckets. Version N writes one run for each bucket that its rows touch, and a manifest
that lists the runs of every bucket, newest first. A bucket that has gathered `runs` runs is merged
into one by the version that would add the next. So a micro-batch reads the runs of the buckets it touches (keys alone,
but for buckets to be merged) and the last manifest, however many versions came before. A version that is
replayed starts from the manifest before it and writes the same files again; runs that no manifest needs any more
are deleted a version later.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import keyed as K

BUCKETS, RUNS = 32, 6
_MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("versions", T.ArrayType(T.LongType())),
                          T.StructField("schema", T.StringType()), T.StructField("buckets", T.IntegerType())])


class KeyedTable:
    """The table under `path` by `key`; one writer at a time, with growing version numbers."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS, runs: int = RUNS):
        self.spark, self.path, self.key, self.buckets, self.runs = spark, path.rstrip("/"), key, buckets, runs

    # --- manifests: one small row per bucket that has rows

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        p, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self._fs(f"{self.path}/manifest/{n}/_SUCCESS")[0]))

    def _manifest(self, version: int | None) -> tuple[dict[int, list[int]], T.StructType | None]:
        if version is None:
            return {}, None
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={version}").collect()
        if rows and rows[0]["buckets"] != self.buckets:
            raise ValueError(f"the table has {rows[0]['buckets']} buckets, not {self.buckets}")
        return {r["bucket"]: list(r["versions"]) for r in rows}, T.StructType.fromJson(json.loads(rows[0]["schema"])) if rows else None

    def _runs(self, held: dict[int, list[int]], schema: T.StructType) -> DataFrame:
        """Rows of the listed runs with their `_v`."""
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, versions in held.items() for v in versions]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumns({"_v": F.lit(0).cast("long"), "_b": F.lit(0)})
        rows = self.spark.read.schema(schema).parquet(*paths)
        at = F.col("_metadata.file_path")
        return rows.select("*", F.regexp_extract(at, r"/data/v=(\d+)/", 1).cast("long").alias("_v"), F.regexp_extract(at, r"/bucket=(\d+)/", 1).cast("int").alias("_b"))

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    # --- reading and writing

    def read(self) -> DataFrame:
        """The newest row of every key."""
        done = self.versions()
        held, schema = self._manifest(done[-1] if done else None)
        if schema is None:
            raise ValueError(f"no version of the table under {self.path}")
        return K.latest_per_key(self._runs(held, schema).drop("_b"), self.key, "_v").drop("_v")

    def upsert(self, rows: DataFrame, version: int) -> DataFrame:
        """Insert or replace rows (one per key) as `version`; (outcome, n) of the keys created and updated.

        Rows with a null key are a key of their own. The columns must be those of the earlier versions.
        """
        before = [v for v in self.versions() if v < version]
        held, schema = self._manifest(before[-1] if before else None)
        if schema is not None and schema != rows.schema:
            raise ValueError("the rows have other columns than the table; conform them first")
        staged = f"{self.path}/staged/v={version}"
        rows.withColumn("_b", self._bucket()).write.mode("overwrite").parquet(staged)
        new = self.spark.read.parquet(staged)
        touched = sorted(r[0] for r in new.select("_b").distinct().collect())  # at most `buckets` numbers
        full = {b for b in touched if len(held.get(b, [])) >= self.runs}
        old = self._runs({b: held[b] for b in touched if b in held}, rows.schema)
        known = old.select(F.col(self.key).alias("_k"), F.lit(True).alias("_e")).distinct()
        tally = new.join(known, F.col(self.key).eqNullSafe(F.col("_k")), "left").groupBy(
            F.when(F.col("_e"), "updated").otherwise("created").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
        out = new
        if full:
            whole = self._runs({b: held[b] for b in sorted(full)}, rows.schema)
            both = whole.unionByName(new.where(F.col("_b").isin(sorted(full))).withColumn("_v", F.lit(version).cast("long")))
            merged = K.latest_per_key(both, self.key, "_v").select(new.columns)
            out = new.where(~F.col("_b").isin(sorted(full))).unionByName(merged)
        tally = self.spark.createDataFrame(tally.collect(), "outcome string, n long")  # two rows at most
        # into plain folders: the bucket is no column of the rows
        out.withColumnRenamed("_b", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        now = {**held, **{b: [version] if b in full else [version, *held.get(b, [])] for b in touched}}
        text = rows.schema.json()
        self.spark.createDataFrame([(b, v, text, self.buckets) for b, v in now.items()], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/v={version}")
        self._forget(before[-2:], held, now, staged)
        return tally

    def _forget(self, before: list[int], held: dict, now: dict, staged: str) -> None:
        """Delete the staged rows, and the runs that were last used two versions ago."""
        needed = {(b, v) for m in (held, now) for b, versions in m.items() for v in versions}
        older, _ = self._manifest(before[0]) if len(before) == 2 else ({}, None)
        for path in [staged, *(f"{self.path}/data/v={v}/bucket={b}" for b, versions in older.items() for v in versions if (b, v) not in needed)]:
            p, fs = self._fs(path)
            fs.delete(p, True)
