"""Registered streaming and scheduled-job queries (ST1-ST4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.geo import geohash_sql
from tidewatch.operators.aggs import instant_to_ntz
from tidewatch.plans.catalog import register
from tidewatch.plans.q_cluster import categorize_sql
from tidewatch.plans.q_ingest import NORMAL_SQL, gazetteer, raw_posts, sorted_post
from tidewatch.sources.tables import POSTS_SQL, posts, posts_from_events, table
from tidewatch.streaming import jobs as J
from tidewatch.streaming import sketches as SK

R = 6


@register(
    "stream_histogram_1h",
    f"""SELECT make_timestamp(epoch_us(created_at) - (((epoch_us(created_at) % 3600000000) + 3600000000) % 3600000000)) AS key,
       count(*) AS doc_count, round(avg(flood_probability), 6) AS avg_flood_probability
FROM {POSTS_SQL} p GROUP BY 1""",
)
def stream_histogram_1h(spark: SparkSession, sf: str) -> DataFrame:
    """ST4 (A1+A2 as a stream): hourly counts and mean probability from a file stream of
    events, as partial aggregates per micro-batch, run to the end of the input (AvailableNow)."""
    stream = posts_from_events(J.read_table_stream(spark, sf, "events"))
    out = J.scratch(spark, "stream-hist")
    J.run_partials(stream, lambda b: J.histogram_partials(b, "1 hour"), f"{out}/table", f"{out}/checkpoint")
    res = J.merge_histogram(spark.read.parquet(f"{out}/table"))
    return res.select(instant_to_ntz(F.col("key")).alias("key"), "doc_count",
                      F.round("avg_flood_probability", R).alias("avg_flood_probability"))


@register(
    "stream_hotspots_day",
    f"""SELECT date_trunc('day', created_at) AS window_start, {geohash_sql('lat', 'lon', 4)} AS cell, count(*) AS doc_count
FROM {POSTS_SQL} p GROUP BY 1, 2""",
)
def stream_hotspots_day(spark: SparkSession, sf: str) -> DataFrame:
    """ST4 (A3 as a stream): per day and geohash-4 cell doc counts."""
    stream = posts_from_events(J.read_table_stream(spark, sf, "events"))
    out = J.scratch(spark, "stream-hot")
    J.run_partials(stream, lambda b: J.hotspot_partials(b, 4, "1 day"), f"{out}/table", f"{out}/checkpoint")
    res = J.merge_hotspots(spark.read.parquet(f"{out}/table"))
    return res.select(instant_to_ntz(F.col("window_start")).alias("window_start"), "cell", "doc_count")


@register("stream_sketches_day", f"""
SELECT day, CAST(sum(c) AS BIGINT) AS n, true AS distinct_fits, true AS median_fits, list(country ORDER BY c DESC, country) AS countries
FROM (SELECT date_trunc('day', created_at) AS day, country, count(*) AS c FROM {POSTS_SQL} p GROUP BY 1, 2) GROUP BY day""")
def stream_sketches_day(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users, median probability and most frequent countries a day from sketches per micro-batch, held against the exact values."""
    stream = posts_from_events(J.read_table_stream(spark, sf, "events"))
    out = J.scratch(spark, "stream-sketch")
    J.run_partials(stream, SK.sketch_partials, f"{out}/table", f"{out}/checkpoint")
    est = SK.estimates(SK.merge_sketches(spark.read.parquet(f"{out}/table")), 100, (0.47, 0.53))
    est = est.select(instant_to_ntz(F.col("key")).alias("day"), "n", "n_distinct", "quantile_47", "quantile_53", "top")
    exact = posts(spark, sf).groupBy(F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")).agg(
        F.count_distinct("user_id").alias("users"), F.median("flood_probability").alias("median"))
    countries = F.transform(F.array_sort(F.transform("top", lambda x: F.struct((-x["count"]).alias("c"), x["item"].alias("item")))), lambda x: x["item"])
    return est.join(exact, "day").select("day", "n", (F.abs(F.col("n_distinct") - F.col("users")) <= 0.03 * F.col("users") + 1).alias("distinct_fits"),
                                         F.col("median").between(F.col("quantile_47"), F.col("quantile_53")).alias("median_fits"), countries.alias("countries"))


@register("stream_ingest_raw", NORMAL_SQL)
def stream_ingest_raw(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: raw records (derived from events, staged as JSON text files) ingested as a
    stream: normalize per micro-batch, upsert by id, rejects to a second sink."""
    from tidewatch.operators.geojoin import countries_from_nations

    out = J.scratch(spark, "ingest")
    raw_posts(spark, sf).select("raw").write.mode("overwrite").text(f"{out}/incoming")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 4).text(f"{out}/incoming") \
        .select(F.col("value").alias("raw"))
    J.ingest_stream(stream, f"{out}/table", f"{out}/rejects", f"{out}/checkpoint", gazetteer(spark, sf), countries_from_nations(table(spark, sf, "nation")))
    return sorted_post(J.read_ingested(spark, f"{out}/table"))


_FRAMES_SRC = f"""(SELECT make_timestamp(epoch_us(created_at) - (((epoch_us(created_at) % 900000000) + 900000000) % 900000000)) AS frame,
        country, id_num AS event_id, country || ' ' || props AS text
 FROM {POSTS_SQL} p) s"""


@register("representative_frames_events", categorize_sql(_FRAMES_SRC, ["frame", "country"], "event_id", "text"))
def representative_frames_events(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: representative split per 15-minute frame x country over event texts."""
    p = posts(spark, sf).select("created_at", "country", F.col("id_num").alias("event_id"),
                                F.concat_ws(" ", "country", "props").alias("text"))
    out = J.representative_frames(p, ["country"], id_col="event_id", text_col="text")
    return out.select(instant_to_ntz(F.col("frame")).alias("frame"), "country", "event_id", "text",
                      "multiplicity", F.round("centrality", R).alias("centrality"), "representative", "rank_key")


_BACKFILL_SQL = f"""
WITH b AS (SELECT p.tweetid, CASE WHEN p.country = 'error' THEN NULL ELSE p.lat END AS lat,
                  CASE WHEN p.country = 'error' THEN NULL ELSE p.lon END AS lon,
                  CASE WHEN p.country = 'error' AND p.id_num % 2 = 0 THEN NULL ELSE p.flood_probability END AS fp,
                  n.n_name AS place
           FROM {POSTS_SQL} p JOIN nation n ON n.n_nationkey = p.user_id % 25),
g AS (SELECT lower(n_name) AS pk, CAST(floor(n_nationkey / 10) * 24 - 60 + 12 AS DOUBLE) AS glat,
             CAST((n_nationkey % 10) * 36 - 180 + 18 AS DOUBLE) AS glon FROM nation)
SELECT b.tweetid, coalesce(b.lat, g.glat) AS lat, coalesce(b.lon, g.glon) AS lon
FROM b LEFT JOIN g ON lower(b.place) = g.pk
WHERE NOT (b.lat IS NULL AND b.fp IS NULL) AND (b.lat IS NOT NULL OR g.glat IS NOT NULL OR b.fp IS NOT NULL)
"""


@register("backfill_geotags_posts", _BACKFILL_SQL)
def backfill_geotags_posts(spark: SparkSession, sf: str) -> DataFrame:
    """ST3: posts without location: no probability -> deleted; others geocoded from place."""
    from tidewatch.plans.q_geo import _gaz

    nat = table(spark, sf, "nation").select("n_nationkey", "n_name")
    p = posts(spark, sf)
    p = p.join(nat, (p.user_id % 25) == nat.n_nationkey).select(
        "tweetid",
        F.when(F.col("country") == "error", F.lit(None)).otherwise(F.col("location")).alias("location"),
        F.when((F.col("country") == "error") & (F.col("id_num") % 2 == 0), F.lit(None).cast("double"))
        .otherwise(F.col("flood_probability")).alias("flood_probability"),
        F.col("n_name").alias("place"),
    )
    merged, _, _ = J.backfill_geotags(p, _gaz(spark, sf))
    return merged.select("tweetid", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))


@register("representative_stream_events", categorize_sql(_FRAMES_SRC, ["frame", "country"], "event_id", "text"))
def representative_stream_events(spark: SparkSession, sf: str) -> DataFrame:
    """ST2 as a stream: events staged per 15-minute frame, each frame split once it closes."""
    stream = posts_from_events(J.read_table_stream(spark, sf, "events"))
    stream = stream.select("created_at", "country", F.col("id_num").alias("event_id"),
                           F.concat_ws(" ", "country", "props").alias("text"))
    out = J.scratch(spark, "frames")
    J.run_representative_stream(stream, ["country"], out, f"{out}/checkpoint", id_col="event_id", text_col="text")
    res = J.read_representative_flags(spark, out)
    return res.select(instant_to_ntz(F.col("frame")).alias("frame"), "country", "event_id", "text",
                      "multiplicity", F.round("centrality", R).alias("centrality"), "representative", "rank_key")
