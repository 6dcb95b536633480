"""Structured Streaming jobs (ST1-ST4) and the scheduled backfill (ST3).

Sinks are `foreachBatch` writers into Parquet tables under the shared checkpoint folder
(`spark.checkpoint.dir`). Each micro-batch owns one partition `seq=N` of every table it writes and
overwrites it, so a batch replayed after an executor or driver loss does not change the result.
No row is ever too late: aggregations keep mergeable partial results per micro-batch, and a frame
that gets new rows is split again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema
from tidewatch.functions.geo import geohash
from tidewatch.operators import keyed as K
from tidewatch.session import checkpoint_dir
from tidewatch.streaming.keyed_table import KeyedTable

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, schema_: T.StructType = EVENTS_SCHEMA,
                      max_files: int = 1) -> DataFrame:
    """A Parquet table of the driver directory as a file stream."""
    return (spark.readStream.schema(schema_).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def event_time(df: DataFrame, ts: str = "created_at"):
    """Event time as TIMESTAMP (watermarks and windows need it); an NTZ column is read as
    UTC wall clock without depending on the session zone."""
    from tidewatch.operators.aggs import ntz_to_instant

    return ntz_to_instant(F.col(ts)) if dict(df.dtypes).get(ts) == "timestamp_ntz" else F.col(ts)


def _write_seq(df: DataFrame, path: str, seq: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/seq={seq}")


def _read_seqs(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """A table of `seq=N` partitions with its `seq` column; no partition yet: no rows."""
    whole = T.StructType([*columns.fields, T.StructField("seq", T.LongType())])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def histogram_partials(posts: DataFrame, interval: str = "10 minutes", ts: str = "created_at") -> DataFrame:
    """ST4/A1+A2 of a part of the posts: per event-time window the counts and the probability sum."""
    p = F.col("flood_probability")
    return posts.groupBy(F.window(event_time(posts, ts), interval).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count(p).alias("n_p"), F.sum(p).alias("s_p")
    ).select(F.col("w.start").alias("key"), "n", "n_p", "s_p")


def merge_histogram(partials: DataFrame) -> DataFrame:
    """Partial histograms summed up (gap filling happens at read time with the batch operator)."""
    return partials.groupBy("key").agg(
        F.sum("n").alias("doc_count"), (F.sum("s_p") / F.nullif(F.sum("n_p"), F.lit(0))).alias("avg_flood_probability"))


def hotspot_partials(posts: DataFrame, precision: int = schema.HOTSPOT_PRECISION, interval: str = "1 day",
                     ts: str = "created_at") -> DataFrame:
    """ST4/A3 of a part of the posts: per (window, geohash cell) doc counts and bounds."""
    s = posts.withColumn("cell", geohash(F.col("location.lat"), F.col("location.lon"), precision))
    return s.groupBy(F.window(event_time(posts, ts), interval).alias("w"), "cell").agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.max("location.lat").alias("top_left_lat"), F.min("location.lon").alias("top_left_lon"),
        F.min("location.lat").alias("bottom_right_lat"), F.max("location.lon").alias("bottom_right_lon"),
    ).select(F.col("w.start").alias("window_start"), "cell", "doc_count", "top_left_lat", "top_left_lon",
             "bottom_right_lat", "bottom_right_lon")


def merge_hotspots(partials: DataFrame) -> DataFrame:
    return partials.groupBy("window_start", "cell").agg(
        F.sum("doc_count").alias("doc_count"), F.max("top_left_lat").alias("top_left_lat"),
        F.min("top_left_lon").alias("top_left_lon"), F.min("bottom_right_lat").alias("bottom_right_lat"),
        F.max("bottom_right_lon").alias("bottom_right_lon"))


def run_partials(stream: DataFrame, partials: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Run a stream to the end of its input (AvailableNow); each micro-batch writes its partial
    aggregates. There is no state and no watermark, so rows in any time order count."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_seq(partials(batch), path, batch_id)

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def ingest_stream(raw: DataFrame, table_path: str, rejects_path: str, checkpoint: str, gazetteer=None,
                  countries=None, key: str = "tweetid"):
    """ST1: stream of raw records -> normalize -> upsert into the post table; rejects to a
    second sink. Of several versions of a key the one of the later micro-batch wins, inside a
    micro-batch the one with the later created_at (then the larger record hash). The table is a
    `KeyedTable`: a micro-batch reads and writes the buckets it touches. Per micro-batch `outcomes`
    keeps the tally: keys created and updated, records failed."""
    from tidewatch.operators.normalize import normalize

    spark = raw.sparkSession
    table = KeyedTable(spark, table_path, key)

    def sink(batch: DataFrame, batch_id: int) -> None:
        ok, rej = normalize(batch, gazetteer, countries)
        rank = F.struct(F.col("created_at").alias("t"), F.xxhash64(F.to_json(F.struct(*ok.columns))).alias("h"))
        one = K.latest_per_key(ok.withColumn("_o", rank), key, "_o").select(*ok.columns)
        _write_seq(rej, rejects_path, batch_id)
        failed = spark.read.schema(rej.schema).parquet(f"{rejects_path}/seq={batch_id}").agg(F.lit("failed").alias("outcome"), F.count(F.lit(1)).alias("n"))
        _write_seq(table.upsert(one, batch_id).unionByName(failed).where("n > 0"), f"{table_path}/outcomes", batch_id)

    q = (raw.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_ingested(spark: SparkSession, table_path: str, key: str = "tweetid") -> DataFrame:
    """The post table after ingest: latest version of every key (upsert semantics)."""
    return KeyedTable(spark, table_path, key).read()


def read_outcomes(spark: SparkSession, table_path: str) -> DataFrame:
    """Records created, updated and failed over all micro-batches."""
    return spark.read.parquet(f"{table_path}/outcomes").groupBy("outcome").agg(F.sum("n").alias("n"))


def representative_frames(posts: DataFrame, terms: list[str], frame: str = schema.STREAM_FRAME,
                          id_col: str = "tweetid", text_col: str = "text") -> DataFrame:
    """ST2: the representative split per frame (tumbling `frame` window on created_at) x
    cluster terms; run per micro-batch in `foreachBatch` over closed frames, or in batch."""
    from tidewatch.operators.cluster import categorize

    framed = posts.withColumn("frame", F.window(event_time(posts), frame).start)
    return categorize(framed, ["frame", *terms], id_col, text_col)


def backfill_geotags(base: DataFrame, gazetteer: DataFrame, countries: DataFrame | None = None,
                     key: str = "tweetid", place: str = "place") -> tuple[DataFrame, DataFrame, DataFrame]:
    """ST3: rows missing a location -> those missing a probability are deleted; the others
    are geocoded from their place name (+ country); tagged rows are upserted.
    Returns (new table, deleted keys, updated rows)."""
    from tidewatch.operators.geojoin import country_of, geocode

    missing = base.filter(F.col("location").isNull())
    deleted = missing.filter(F.col("flood_probability").isNull()).select(key)
    todo = missing.filter(F.col("flood_probability").isNotNull())
    tagged = geocode(todo, gazetteer, place=place, out="_geo").filter(F.col("_geo").isNotNull())
    tagged = tagged.withColumn("location", F.col("_geo")).drop("_geo")
    if countries is not None:
        tagged = country_of(tagged, countries, key=key)
    tagged = tagged.select(*base.columns)
    kept = K.delete_by_id(base, deleted, key)
    merged, _ = K.upsert(kept, tagged, key)
    return merged, deleted, tagged


def run_representative_stream(posts: DataFrame, terms: list[str], out: str, checkpoint: str,
                              frame: str = schema.STREAM_FRAME, id_col: str = "tweetid", text_col: str = "text",
                              lateness_s: int = 15 * 60) -> None:
    """ST2 as a stream: each micro-batch is staged by frame (tumbling window on created_at);
    frames whose end is older than (latest event time - lateness) are split (C1 over the whole
    frame x terms); what is left when the input ends (AvailableNow) is split then. A frame that
    gets rows after its split is split again, and its newest split counts, so files may come
    in any time order. Needs one run at a time per `out`.

    Layout under `out`, all by seq: staged/ (rows, by day), frames/ (frames that got rows, and
    their latest event time), closed/ (frames split), flags/ (results). A micro-batch N has
    seq 2N; the flush at the end of a run has the odd number behind its last one.
    """
    from tidewatch.operators.cluster import categorize

    spark = posts.sparkSession
    et = event_time(posts)
    start = F.window(et, frame).start
    staged_cols = [start.alias("frame"), et.alias("created_at"), *terms, id_col, text_col]
    staged_schema = T.StructType([*posts.limit(0).select(*staged_cols).schema.fields, T.StructField("day", T.StringType())])
    frames_schema = T.StructType([T.StructField("frame", T.TimestampType()), T.StructField("latest", T.TimestampType())])
    closed_schema = T.StructType([T.StructField("frame", T.TimestampType())])
    end = F.col("frame") + F.expr(f"INTERVAL {_frame_seconds(frame)} SECONDS")
    day = F.date_format("frame", "yyyy-MM-dd").alias("day")

    def pending(seq: int) -> DataFrame:
        """Frames that got rows since they were last split."""
        got = _read_seqs(spark, f"{out}/frames", frames_schema).groupBy("frame").agg(F.max("seq").alias("last_in"))
        done = _read_seqs(spark, f"{out}/closed", closed_schema).filter(F.col("seq") < seq)  # not a replayed self
        done = done.groupBy("frame").agg(F.max("seq").alias("last_out"))
        return got.join(done, "frame", "left").filter("last_out is null or last_in > last_out").select("frame")

    def split(frames: DataFrame, seq: int) -> None:
        _write_seq(frames, f"{out}/todo", seq)
        now = spark.read.schema(closed_schema).parquet(f"{out}/todo/seq={seq}")
        staged = _read_seqs(spark, f"{out}/staged", staged_schema)
        staged = staged.join(now.select("frame", day), ["day", "frame"], "left_semi").drop("seq", "day")
        _write_seq(categorize(staged, ["frame", *terms], id_col, text_col), f"{out}/flags", seq)
        _write_seq(now, f"{out}/closed", seq)  # last: a crash before it repeats the split

    def sink(batch: DataFrame, batch_id: int) -> None:
        seq = 2 * batch_id
        batch.select(*staged_cols).withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{out}/staged/seq={seq}")
        rows = batch.groupBy(start.alias("frame")).agg(F.max(et).alias("latest"))
        _write_seq(rows, f"{out}/frames", seq)
        seen = _read_seqs(spark, f"{out}/frames", frames_schema)
        horizon = seen.agg(F.max("latest") - F.expr(f"INTERVAL {lateness_s} SECONDS")).scalar()
        split(pending(seq).filter(end <= horizon), seq)  # a scalar subquery, no join

    q = (posts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    # end of input: split every frame that still has unsplit rows
    last = _read_seqs(spark, f"{out}/frames", frames_schema).agg(F.max("seq")).head()[0]
    if last is not None and not pending(last + 1).isEmpty():
        split(pending(last + 1), last + 1)


def _frame_seconds(frame: str) -> int:
    n, unit = frame.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def read_representative_flags(spark: SparkSession, out: str) -> DataFrame:
    """Flags of all frames; of a frame that was split several times the newest split."""
    newest = spark.read.parquet(f"{out}/closed").groupBy("frame").agg(F.max("seq").alias("seq"))
    return spark.read.parquet(f"{out}/flags").join(newest, ["frame", "seq"], "left_semi").drop("seq")
