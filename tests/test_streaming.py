"""Streaming jobs agree with their batch counterparts (AvailableNow on the sf0.001 files)."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators import aggs as A
from tidewatch.sources.tables import posts, posts_from_events
from tidewatch.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_stream_histogram_equals_batch(spark):
    stream = posts_from_events(J.read_table_stream(spark, SF, "events"))
    out = J.scratch(spark, "t-hist")
    J.run_partials(stream, lambda b: J.histogram_partials(b, "1 hour"), f"{out}/t", f"{out}/c")
    got = {r["key"]: r["doc_count"] for r in J.merge_histogram(spark.read.parquet(f"{out}/t"))
           .select(F.col("key").cast("timestamp_ntz").alias("key"), "doc_count").collect()}
    batch = {r["key"]: r["doc_count"] for r in A.time_histogram(posts(spark, SF), "1h", gap_fill=False).collect()}
    assert got == batch


def test_representative_stream_equals_batch(spark):
    cols = ["created_at", "country", F.col("id_num").alias("event_id"), F.concat_ws(" ", "country", "props").alias("text")]
    stream = posts_from_events(J.read_table_stream(spark, SF, "events")).select(*cols)
    out = J.scratch(spark, "t-frames")
    J.run_representative_stream(stream, ["country"], out, f"{out}/c", id_col="event_id", text_col="text")
    got = {(r["event_id"]): (r["multiplicity"], r["representative"]) for r in J.read_representative_flags(spark, out).collect()}
    batch = J.representative_frames(posts(spark, SF).select(*cols), ["country"], id_col="event_id", text_col="text")
    want = {r["event_id"]: (r["multiplicity"], r["representative"]) for r in batch.collect()}
    assert got == want


def test_backfill(spark):
    gz = spark.createDataFrame([("Mercedes, TX", 26.1, -97.9)], "place string, lat double, lon double")
    base = spark.createDataFrame([
        ("1", (1.0, 2.0), 0.5, "x"), ("2", None, None, "Mercedes, TX"), ("3", None, 0.7, "mercedes, tx"), ("4", None, 0.2, "nowhere"),
    ], "tweetid string, location struct<lat:double,lon:double>, flood_probability double, place string")
    merged, deleted, updated = J.backfill_geotags(base, gz)
    assert [r["tweetid"] for r in deleted.collect()] == ["2"]
    got = {r["tweetid"]: r["location"] for r in merged.collect()}
    assert set(got) == {"1", "3", "4"} and got["3"]["lat"] == 26.1 and got["4"] is None


def test_text_places_geotag(spark):
    import json

    from tidewatch.operators.normalize import normalize

    gz = spark.createDataFrame([("Iowa", 42.0, -93.5), ("Texas", 31.0, -99.0), ("South Texas", 27.0, -98.0)],
                               "place string, lat double, lon double")
    recs = [
        {"id": 1, "text": "River flooding in Iowa tonight", "lang": "en", "annotations": {"flood_probability": 0.9},
         "coordinates": {"coordinates": [0.0, 0.0]}},
        {"id": 2, "text": "Rain in South Texas and Iowa", "lang": "en", "annotations": {"flood_probability": 0.9},
         "coordinates": {"coordinates": [-98.1, 27.1]}},
        {"id": 3, "text": "nothing here", "lang": "en", "annotations": {"flood_probability": 0.9}},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in recs], "raw string")
    ok, _ = normalize(df, gz, now=datetime(2024, 1, 1))
    got = {r["tweetid"]: (r["place"], r["location"]) for r in ok.collect()}
    assert got["1"][0] == "Iowa" and got["1"][1]["lat"] == 42.0          # one text place wins over the point
    assert got["2"][0] == "South Texas"                                   # longest match; nearest of two
    assert got["3"] == (None, None)                                       # nothing to geotag


def files_out_of_order(spark, path):
    """Three files read one by one, the middle one hours older than the first, sharing frames with the last."""
    import os
    import time

    t = lambda h, m: datetime(2024, 1, 1, h, m)
    parts = [[(1, t(9, 1), "river high", 0.5), (2, t(12, 0), "dry", None)],
             [(3, t(9, 2), "river high", 0.7), (4, t(3, 0), "old", 0.1)],
             [(5, t(9, 3), "river highs", 0.9), (6, t(12, 1), "dry", 0.3)]]
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "tweetid long, created_at timestamp_ntz, text string, flood_probability double")
        df.withColumn("country", F.lit("A")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stamps = sorted(os.path.getmtime(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
    assert len(set(stamps)) == 3
    return spark.read.parquet(path), spark.readStream.schema(spark.read.parquet(path).schema).option(
        "maxFilesPerTrigger", 1).parquet(path)


def test_rows_out_of_time_order_all_count(spark, tmp_path):
    all_rows, stream = files_out_of_order(spark, str(tmp_path / "in"))
    J.run_partials(stream, lambda b: J.histogram_partials(b, "1 hour"), str(tmp_path / "t"), str(tmp_path / "c"))
    got = {r["key"].hour: (r["doc_count"], r["avg_flood_probability"] and round(r["avg_flood_probability"], 9))
           for r in J.merge_histogram(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert got == {9: (3, 0.7), 12: (2, 0.3), 3: (1, 0.1)}

    out = str(tmp_path / "f")
    for _ in range(2):  # a second run without new input changes nothing
        J.run_representative_stream(stream, ["country"], out, f"{out}/c")
        flags = [(r["tweetid"], r["multiplicity"], r["representative"], round(r["centrality"], 6))
                 for r in J.read_representative_flags(spark, out).collect()]
        want = [(r["tweetid"], r["multiplicity"], r["representative"], round(r["centrality"], 6))
                for r in J.representative_frames(all_rows, ["country"]).collect()]
        assert sorted(flags) == sorted(want) and len(flags) == 6


def test_ingest_upserts_and_tally(spark, tmp_path):
    import json

    def rec(i, text, at="2024-01-01T00:00:00Z"):
        return json.dumps({"id": i, "text": text, "lang": "en", "created_at": at, "annotations": {"flood_probability": 0.9}})

    for rows in ([rec(1, "first"), rec(2, "a", "2024-01-01T00:00:00Z"), rec(2, "b", "2024-01-02T00:00:00Z"), "{broken"], [rec(1, "second"), rec(3, "c")]):
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        raw = spark.readStream.schema("value string").text(str(tmp_path / "in")).select(F.col("value").alias("raw"))
        J.ingest_stream(raw, str(tmp_path / "t"), str(tmp_path / "r"), str(tmp_path / "c"))
    got = {r["tweetid"]: r["text"] for r in J.read_ingested(spark, str(tmp_path / "t")).collect()}
    assert got == {"1": "second", "2": "b", "3": "c"}
    assert {r["outcome"]: r["n"] for r in J.read_outcomes(spark, str(tmp_path / "t")).collect()} == {
        "created": 3, "updated": 1, "failed": 1}


def test_rejects_come_from_the_read_stage_and_fields_from_one_lookup(spark):
    """The envelope's keys (JSON null included) win over the outer ones, field by field; rejects need no join."""
    from tidewatch.operators.normalize import normalize

    raw = ['{"annotations":{"flood_probability":0.5},"lang":"en","text":"outer","user":{"id":1,"name":"o"},"tweet":{"id":7,"text":"inner the","user":null}}',
           '{"id":8,"annotations":{"flood_probability":["yes",0.25]},"lang":"en","text":"outer the","user":{"id":1,"name":"o"},"tweet":"{\\"user\\":{\\"id\\":2}}"}',
           '{"id":9,"lang":"en","text":"the"}', 'no record', None, '{"id":10,"annotations":{"flood_probability":1},"lang":"xx","text":"q"}']
    ok, rejects = normalize(spark.createDataFrame([(r,) for r in raw], "raw string"))
    assert sorted((r["tweetid"], r["text"], r["user_id"], r["user_name"], r["flood_probability"]) for r in ok.collect()) == [
        ("7", "inner the", None, None, 0.5), ("8", "outer the", 2, None, 0.25)]
    assert sorted((str(r["raw"])[:8], r["reason"]) for r in rejects.collect()) == [
        ("None", "unparsable record"), ("no recor", "unparsable record"), ('{"id":10', "unsupported language: xx"), ('{"id":9,', "missing annotations")]
    assert "Join" not in rejects._jdf.queryExecution().optimizedPlan().toString()
