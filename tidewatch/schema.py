"""Normalized post schema and the defaults the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATION = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])

# Fixed output schema of a normalized post (unknown keys are dropped by `conform`).
POST_SCHEMA = T.StructType(
    [
        T.StructField("tweetid", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("flood_probability", T.DoubleType()),
        T.StructField("location", LOCATION),
        T.StructField("text", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_favourites_count", T.LongType()),
        T.StructField("user_followers_count", T.LongType()),
        T.StructField("user_friends_count", T.LongType()),
        T.StructField("user_listed_count", T.LongType()),
        T.StructField("user_statuses_count", T.LongType()),
        T.StructField("user_utc_offset", T.LongType()),
        T.StructField("user_created_at", T.StringType()),
        T.StructField("user_description", T.StringType()),
        T.StructField("user_lang", T.StringType()),
        T.StructField("user_location", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("user_profile_image_url", T.StringType()),
        T.StructField("user_time_zone", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("place", T.StringType()),
        T.StructField("representative", T.BooleanType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("media_urls", T.ArrayType(T.StringType())),
    ]
)

# Fixed values that results depend on (service defaults).
MIN_ENTRIES = 5                 # minimum docs for a hotspot / cluster
HOTSPOT_PRECISION = 4           # default geohash precision of hotspots
CLUSTER_PRECISION = 5           # default geohash precision of geo clusters
HISTOGRAM_INTERVAL = "10m"      # default time-histogram interval
CLUSTER_INTERVAL = "5m"         # default interval when clustering on created_at
PAGE_SIZE = 36                  # default rows per page
LANGUAGES = ("en", "fr", "es", "de")
SIMILARITY_THRESHOLD = 0.8      # near-duplicate threshold for the representative split
STREAM_FRAME = "15 minutes"     # representative re-marking frame
TERMS_SIZE = 10                 # default size of a terms aggregation
GRAPH_TOP_DOCS = 10             # the service's ranking size per graph expansion; a parameter here
KEYWORD_MAX_LEN = 256           # keyword sub-fields ignore longer values
ORDERABLE = ("created_at", "flood_probability", "country", "lang", "user_lang", "user_name", "user_time_zone")
FILTERABLE = {"flood_probability": ("gte",), "lang": ("exact",), "country": ("exact",), "representative": ("exact",)}
LOOKUPS = ("ne", "lt", "lte", "gt", "gte", "not", "in", "nin", "mod", "all", "size", "exists", "exact",
           "iexact", "contains", "icontains", "startswith", "istartswith", "endswith", "iendswith", "match")
SEARCH_FIELDS = ("text", "tokens", "place", "user_name", "user_location", "user_description")
