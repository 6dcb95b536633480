"""Parquet table access and the adapter views that map the driver tables onto posts.

Adapters are pure projections over a scan, so Catalyst prunes columns and
pushes filters through them into the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lat_milli() -> Column:
    """Latitude in thousandths of a degree, from integer arithmetic only (exact in every engine)."""
    base = (F.col("user_id") * 7919) % 12000 * 10 - 60000 + F.col("event_id") % 7
    return base + F.when(F.col("event_id") % 37 == 0, F.lit(10000)).otherwise(F.lit(0))


def _lon_milli() -> Column:
    return (F.col("user_id") * 104729) % 34000 * 10 - 170000 + F.col("event_id") % 11


def posts_from_events(events: DataFrame) -> DataFrame:
    """`events` seen as normalized posts.

    tweetid = event id as text; created_at = ts; flood_probability = min(value/500, 1);
    country = event_type; location from user/event ids (a point per user, jittered per
    event; every 37th event shifted 10 degrees north so thin cells exist);
    props (JSON text) is kept as the raw payload.
    """
    lat = _lat_milli().cast("double") / F.lit(1000.0)
    lon = _lon_milli().cast("double") / F.lit(1000.0)
    return events.select(
        F.col("event_id").cast("string").alias("tweetid"),
        F.col("event_id").alias("id_num"),
        F.col("ts").alias("created_at"),
        F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("flood_probability"),
        F.col("event_type").alias("country"),
        F.struct(lat.alias("lat"), lon.alias("lon")).alias("location"),
        F.col("user_id"),
        F.col("props"),
    )


# SQL text of the same adapter for DuckDB oracles (events -> posts).
POSTS_SQL = """
(SELECT CAST(event_id AS VARCHAR) AS tweetid,
        event_id AS id_num,
        ts AS created_at,
        least(value / CAST(500.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS flood_probability,
        event_type AS country,
        CAST(((user_id * 7919) % 12000 * 10 - 60000 + event_id % 7
              + CASE WHEN event_id % 37 = 0 THEN 10000 ELSE 0 END) AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS lat,
        CAST(((user_id * 104729) % 34000 * 10 - 170000 + event_id % 11) AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS lon,
        user_id,
        props
 FROM events)
"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_from_events(table(spark, sf_dir, "events"))


def posts_from_documents(documents: DataFrame, stemmed: bool = True) -> DataFrame:
    """`documents` seen as posts with text: tokens from the tokenizer (by the document's language, or
    words without English stop words if not `stemmed`), and a flood probability in [0, 1] derived from the id by integer arithmetic."""
    from tidewatch.functions.text import tokenize

    prob = ((F.col("doc_id") * 37) % 101).cast("double") / F.lit(100.0)
    return documents.select(
        F.col("doc_id").cast("string").alias("tweetid"),
        F.col("doc_id"),
        "text", "lang", "source",
        tokenize(F.col("text"), F.col("lang"), stemmed).alias("tokens"),
        prob.alias("flood_probability"),
    )


def doc_posts(spark: SparkSession, sf_dir: str, stemmed: bool = True) -> DataFrame:
    return posts_from_documents(table(spark, sf_dir, "documents"), stemmed)
