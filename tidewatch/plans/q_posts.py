"""Registered post queries: filters, ordering, paging, histograms, hotspots, terms, bounds."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.geo import geohash_sql
from tidewatch.operators import aggs as A
from tidewatch.operators import filters as FL
from tidewatch.plans.catalog import register
from tidewatch.plans.query import QuerySpec, run_query
from tidewatch.sources.tables import POSTS_SQL, posts, table

R = 6  # decimals kept for doubles on both sides of the oracle


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        "tweetid", "created_at", F.round("flood_probability", R).alias("flood_probability"), "country",
        F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"),
    )


def _hist_sql(where: str, step_s: int, with_avg: bool, source: str = POSTS_SQL, ts: str = "created_at") -> str:
    us = step_s * 1_000_000
    avg_in = ", avg(flood_probability) AS a" if with_avg else ""
    avg_out = ", round(c.a, 6) AS avg_flood_probability" if with_avg else ""
    return f"""
WITH p AS (SELECT * FROM {source} p WHERE {where}),
b AS (SELECT make_timestamp(epoch_us({ts}) - (((epoch_us({ts}) % {us}) + {us}) % {us})) AS key{', flood_probability' if with_avg else ''} FROM p),
c AS (SELECT key, count(*) AS doc_count{avg_in} FROM b GROUP BY key),
s AS (SELECT unnest(generate_series(min(key), max(key), INTERVAL '{step_s} seconds')) AS key FROM c)
SELECT s.key AS key, coalesce(c.doc_count, 0) AS doc_count{avg_out} FROM s LEFT JOIN c ON s.key = c.key
"""


BOX_DAY = {
    "created_at": "2024-01-05|2024-01-06",
    "top_left_lat": "60", "top_left_lon": "-120", "bottom_right_lat": "-10", "bottom_right_lon": "60",
}
BOX_DAY_WHERE = (
    "created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-06 23:59:59'"
    " AND lat BETWEEN -10 AND 60 AND lon BETWEEN -120 AND 60"
)


@register("prob_histogram_box_day", _hist_sql(BOX_DAY_WHERE, 600, True))
def prob_histogram_box_day(spark: SparkSession, sf: str) -> DataFrame:
    """F2 + F3 + A2: mean flood probability per 10 minutes inside a box over two days."""
    spec = QuerySpec.from_params({**BOX_DAY, "agg_floodprob": "1", "size": "0"})
    _, aggs = run_query(posts(spark, sf), spec)
    h = aggs["agg_floodprob"]
    return h.select("key", "doc_count", F.round("avg_flood_probability", R).alias("avg_flood_probability"))


@register("time_histogram_1h", _hist_sql("true", 3600, False))
def time_histogram_1h(spark: SparkSession, sf: str) -> DataFrame:
    """A1: gap-filled hourly counts over all posts."""
    return A.time_histogram(posts(spark, sf), "1h")


@register("time_histogram_10m_box", _hist_sql("lat BETWEEN 0 AND 45 AND lon BETWEEN -60 AND 20", 600, False))
def time_histogram_10m_box(spark: SparkSession, sf: str) -> DataFrame:
    """A1 (default 10m) over a box: sparse data, so most buckets are gap-filled zeros."""
    spec = QuerySpec.from_params({"top_left_lat": "45", "top_left_lon": "-60", "bottom_right_lat": "0",
                                  "bottom_right_lon": "20", "agg_timestamp": "1", "size": "0"})
    return run_query(posts(spark, sf), spec)[1]["agg_timestamp"]


@register(
    "orders_month_histogram",
    """
WITH c AS (SELECT date_trunc('month', o_orderdate) AS key, count(*) AS doc_count FROM orders GROUP BY 1),
s AS (SELECT unnest(generate_series(min(key), max(key), INTERVAL '1 month')) AS key FROM c)
SELECT s.key AS key, coalesce(c.doc_count, 0) AS doc_count FROM s LEFT JOIN c ON s.key = c.key
""",
)
def orders_month_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A1 with a calendar unit (1M) over the orders table."""
    return A.time_histogram(table(spark, sf, "orders"), "1M", ts="o_orderdate")


@register(
    "lineitem_week_histogram",
    """
WITH c AS (SELECT date_trunc('week', l_shipdate) AS key, count(*) AS doc_count FROM lineitem GROUP BY 1),
s AS (SELECT unnest(generate_series(min(key), max(key), INTERVAL '7 days')) AS key FROM c)
SELECT s.key AS key, coalesce(c.doc_count, 0) AS doc_count FROM s LEFT JOIN c ON s.key = c.key
""",
)
def lineitem_week_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A1 with weeks starting on Monday over the whole lineitem table."""
    return A.time_histogram(table(spark, sf, "lineitem"), "1w", ts="l_shipdate")


def _hotspot_sql(precision: int, where: str = "true", limit: int | None = None, min_entries: int = 5) -> str:
    return f"""
WITH p AS (SELECT * FROM {POSTS_SQL} p WHERE {where}),
c AS (SELECT {geohash_sql('lat', 'lon', precision)} AS key, count(*) AS doc_count,
             max(lat) AS tl_lat, min(lon) AS tl_lon, min(lat) AS br_lat, max(lon) AS br_lon
      FROM p GROUP BY 1)
SELECT key, doc_count, round((tl_lat + br_lat) / 2, 6) AS lat, round((tl_lon + br_lon) / 2, 6) AS lon
FROM c WHERE doc_count >= {min_entries} ORDER BY doc_count DESC, key ASC {f"LIMIT {limit}" if limit else ""}
"""


def _round_latlon(df: DataFrame) -> DataFrame:
    return df.select("key", "doc_count", F.round("lat", R).alias("lat"), F.round("lon", R).alias("lon"))


@register("hotspots_p4", _hotspot_sql(4))
def hotspots_p4(spark: SparkSession, sf: str) -> DataFrame:
    """A3 (+X8, A4, A5): geohash-4 hotspots with >= 5 posts, biggest first."""
    return _round_latlon(A.hotspots(posts(spark, sf), precision=4))


@register("hotspots_p2_box_top20", _hotspot_sql(2, "lat BETWEEN -40 AND 50 AND lon BETWEEN -170 AND 0", limit=20))
def hotspots_p2_box_top20(spark: SparkSession, sf: str) -> DataFrame:
    """A3 through Q1: precision 2, size 20, inside a box (L7 bucket trimming)."""
    spec = QuerySpec.from_params({"top_left_lat": "50", "top_left_lon": "-170", "bottom_right_lat": "-40",
                                  "bottom_right_lon": "0", "agg_hotspot": "1", "agg_hotspot__precision": "2",
                                  "agg_hotspot__size": "20", "size": "0"})
    return _round_latlon(run_query(posts(spark, sf), spec)[1]["agg_hotspot"])


@register("hotspots_p7", _hotspot_sql(7, min_entries=2))
def hotspots_p7(spark: SparkSession, sf: str) -> DataFrame:
    """A3 at a fine precision (7) with min entries 2: many small cells."""
    return _round_latlon(A.hotspots(posts(spark, sf), precision=7, min_entries=2))


@register(
    "terms_country",
    f"SELECT country AS key, count(*) AS doc_count FROM {POSTS_SQL} p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def terms_country(spark: SparkSession, sf: str) -> DataFrame:
    """Top-10 terms of a keyword field."""
    return A.terms_agg(posts(spark, sf), "country")


@register(
    "terms_part_type",
    "SELECT p_type AS key, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def terms_part_type(spark: SparkSession, sf: str) -> DataFrame:
    """A6 on another table (fewer distinct values than the size)."""
    return A.terms_agg(table(spark, sf, "part"), "p_type")


_Q1_PARAMS = {"flood_probability__gte": "0.3", "country": "click", "order_by": "-flood_probability", "size": "36"}
_Q1_SQL = f"""
SELECT tweetid, created_at, round(flood_probability, 6) AS flood_probability, country, lat, lon
FROM {POSTS_SQL} p
WHERE created_at IS NOT NULL AND flood_probability >= 0.3 AND country = 'click' AND length(country) <= 256
ORDER BY flood_probability DESC, created_at DESC, tweetid ASC
"""


@register("query_page1", _Q1_SQL + " LIMIT 36")
def query_page1(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 (F1, F4, F5, F9, L1, L2, L4): filtered, ordered first page of 36."""
    rows, _ = run_query(posts(spark, sf), QuerySpec.from_params(_Q1_PARAMS))
    return _flat(rows)


@register("query_page3", _Q1_SQL + " LIMIT 36 OFFSET 72")
def query_page3(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of the same query (offset paging)."""
    rows, _ = run_query(posts(spark, sf), QuerySpec.from_params({**_Q1_PARAMS, "offset": "72"}))
    return _flat(rows)


@register(
    "query_default_order",
    f"""SELECT tweetid, created_at, round(flood_probability, 6) AS flood_probability, country, lat, lon
FROM {POSTS_SQL} p WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at <= TIMESTAMP '2024-01-10 23:59:59'
ORDER BY created_at DESC, tweetid ASC LIMIT 36""",
)
def query_default_order(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 with a time phrase and the default order (created_at desc), default page size."""
    rows, _ = run_query(posts(spark, sf), QuerySpec.from_params({"created_at": "2024-01-10|2024-01-10"}))
    return _flat(rows)


@register(
    "lookup_filters",
    f"""SELECT tweetid, created_at, round(flood_probability, 6) AS flood_probability, country, lat, lon
FROM {POSTS_SQL} p
WHERE country IN ('view', 'signup') AND flood_probability < 0.05 AND tweetid LIKE '%7'
  AND starts_with(country, 'v') = false AND props LIKE '%k%' AND lat > -30""",
)
def lookup_filters(spark: SparkSession, sf: str) -> DataFrame:
    """In, lt, endswith, not-startswith (via ne on a derived flag), contains, gt."""
    df = posts(spark, sf)
    pred = (
        FL.lookup_filter("country", "in", "view,signup")
        & FL.lookup_filter("flood_probability", "lt", 0.05)
        & FL.lookup_filter("tweetid", "endswith", "7")
        & ~FL.lookup_filter("country", "startswith", "v")
        & FL.lookup_filter("props", "contains", "k")
    )
    return _flat(df.filter(pred & (F.col("location.lat") > -30)))


# every lookup name with a field, the value as a request has it, and its meaning in SQL
_LOOKUPS = {
    "ne": ("country", "view", "country <> 'view'"), "not": ("user_id", "7", "user_id <> 7"), "exact": ("user_id", "12", "user_id = 12"),
    "lt": ("flood_probability", "0.25", "flood_probability < 0.25"), "lte": ("id_num", "400", "id_num <= 400"),
    "gt": ("user_id", "90", "user_id > 90"), "gte": ("flood_probability", "1", "flood_probability >= 1"),
    "in": ("user_id", "3,5,8", "user_id IN (3, 5, 8)"), "nin": ("country", "view,signup", "country NOT IN ('view', 'signup')"),
    "mod": ("id_num", "7,3", "id_num % 7 = 3"), "all": ("labels", "view,odd", "country = 'view' AND user_id % 2 = 1"),
    "size": ("labels", "2", "true"), "exists": ("flood_probability", "true", "flood_probability IS NOT NULL"),
    "iexact": ("country", "VIEW", "country = 'view'"), "contains": ("props", "k", "contains(props, 'k')"),
    "icontains": ("country", "IG", "contains(country, 'ig')"), "startswith": ("user_id", "1", "starts_with(CAST(user_id AS VARCHAR), '1')"),
    "istartswith": ("country", "V", "starts_with(country, 'v')"), "endswith": ("tweetid", "7", "suffix(tweetid, '7')"),
    "iendswith": ("country", "EW", "suffix(country, 'ew')"), "match": ("country", "^(v|s)", "regexp_matches(country, '^(v|s)')"),
}


@register(
    "lookup_names",
    f"""WITH p AS (SELECT * FROM {POSTS_SQL} p WHERE created_at IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL)
""" + " UNION ALL ".join(f"SELECT '{name}' AS lookup, count(*) AS n, CAST(coalesce(sum(id_num), 0) AS BIGINT) AS ids FROM p WHERE {sql}"
                         for name, (_, _, sql) in _LOOKUPS.items()),
)
def lookup_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every lookup name as a request filter on text, numbers and arrays; the matching posts counted in one pass."""
    df = posts(spark, sf).withColumn("labels", F.array("country", F.when(F.col("user_id") % 2 == 1, "odd").otherwise("even")))
    types = dict(df.dtypes)
    preds = {name: FL.build_filter({f"{field}__{name}": value}, types) for name, (field, value, _) in _LOOKUPS.items()}
    each = F.array(*[F.named_struct(F.lit("lookup"), F.lit(name), F.lit("hit"), p) for name, p in preds.items()])
    hits = df.select("id_num", F.explode(each).alias("e"))
    return hits.groupBy(F.col("e.lookup").alias("lookup")).agg(F.count_if("e.hit").alias("n"), F.coalesce(
        F.sum(F.when(F.col("e.hit"), F.col("id_num"))), F.lit(0)).cast("long").alias("ids"))


# time phrases with a fixed clock, Wednesday 2024-01-17 10:30 UTC, and the ranges they stand for
_CLOCK = datetime(2024, 1, 17, 10, 30)
_PHRASES = {
    "today": ("2024-01-17 00:00:00", "2024-01-17 23:59:59"), "yesterday": ("2024-01-16 00:00:00", "2024-01-16 23:59:59"),
    "this week": ("2024-01-15 00:00:00", "2024-01-21 23:59:59"), "last week": ("2024-01-08 00:00:00", "2024-01-14 23:59:59"),
    "this month": ("2024-01-01 00:00:00", "2024-01-31 23:59:59"), "last month": ("2023-12-01 00:00:00", "2023-12-31 23:59:59"),
    "this year": ("2024-01-01 00:00:00", "2024-12-31 23:59:59"), "last year": ("2023-01-01 00:00:00", "2023-12-31 23:59:59"),
    "2024-01-03|2024-01-05": ("2024-01-03 00:00:00", "2024-01-05 23:59:59"), "2024-01-03|2024-01-04T12:15": ("2024-01-03 00:00:00", "2024-01-04 12:15:00"),
    "2 hours ago|now": ("2024-01-17 08:30:00", "2024-01-17 10:30:00"), "yesterday|now": ("2024-01-16 10:30:00", "2024-01-17 10:30:00"),
    "3 days ago|now": ("2024-01-14 10:30:00", "2024-01-17 10:30:00"), "1 week ago|yesterday": ("2024-01-10 10:30:00", "2024-01-16 10:30:00"),
}
_ZONED = {"Japan": ("today", "2024-01-16 15:00:00", "2024-01-17 14:59:59"), "America/Lima": ("2024-01-03|2024-01-05", "2024-01-03 05:00:00", "2024-01-06 04:59:59")}
_BOUNDS = {"created_at": ("2024-01-05T10:00", "created_at >= '2024-01-05 10:00:00' AND created_at <= '2024-01-05 10:01:00'"),
           "created_at__exact": ("2024-01-06", "created_at >= '2024-01-06 00:00:00' AND created_at <= '2024-01-06 00:01:00'"),
           "created_at__gt": ("2024-01-05T10:00:30", "created_at > '2024-01-05 10:00:30'"), "created_at__gte": ("2024-01-20", "created_at >= '2024-01-20 00:00:00'"),
           "created_at__lt": ("2024-01-05T10:00:00+02:00", "created_at < '2024-01-05 08:00:00'"), "created_at__lte": ("2024-01-05T10:00:00Z", "created_at <= '2024-01-05 10:00:00'")}


def _count_sql(name: str, where: str) -> str:
    return f"SELECT '{name}' AS phrase, count(*) AS n, CAST(coalesce(sum(id_num), 0) AS BIGINT) AS ids FROM {POSTS_SQL} p WHERE {where}"


@register("time_phrases", " UNION ALL ".join(
    [_count_sql(p, f"created_at >= '{a}' AND created_at <= '{b}'") for p, (a, b) in _PHRASES.items()]
    + [_count_sql(f"{p} in {z}", f"created_at >= '{a}' AND created_at <= '{b}'") for z, (p, a, b) in _ZONED.items()]
    + [_count_sql(f"{k}={v}", where) for k, (v, where) in _BOUNDS.items()] + [_count_sql("no parameters", "true"), _count_sql("unknown=1", "lat IS NOT NULL AND created_at IS NOT NULL")]))
def time_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Time phrases with a fixed clock, phrases in a zone, comparisons, no parameters and unknown ones; the
    matching posts counted in one pass."""
    df = posts(spark, sf)
    types = dict(df.dtypes)
    one = lambda params, **kw: FL.build_filter(params, types, now=_CLOCK.replace(tzinfo=timezone.utc), **kw)
    preds = {p: one({"created_at": p}) for p in _PHRASES} | {f"{p} in {z}": one({"created_at": p}, tz=z) for z, (p, _, _) in _ZONED.items()}
    preds |= {f"{k}={v}": one({k: v}) for k, (v, _) in _BOUNDS.items()} | {"no parameters": one({}), "unknown=1": one({"unknown": "1"})}
    each = F.array(*[F.named_struct(F.lit("phrase"), F.lit(name), F.lit("hit"), F.lit(True) if p is None else p) for name, p in preds.items()])
    hits = df.select("id_num", F.explode(each).alias("e"))
    return hits.groupBy(F.col("e.phrase").alias("phrase")).agg(F.count_if("e.hit").alias("n"), F.coalesce(
        F.sum(F.when(F.col("e.hit"), F.col("id_num"))), F.lit(0)).cast("long").alias("ids"))


@register("seconds_histogram", f"""
WITH c AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY 1)
SELECT count(*) AS buckets, CAST(sum(coalesce(n, 0)) AS BIGINT) AS docs, CAST(count(*) FILTER (WHERE n IS NULL) AS BIGINT) AS empty
FROM (SELECT unnest(range((SELECT min(s) FROM c), (SELECT max(s) FROM c) + 1)) AS s) LEFT JOIN c USING (s)""")
def seconds_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A1 by the second over the whole month: millions of buckets, nearly all of them empty."""
    h = A.time_histogram(posts(spark, sf), "1s")
    return h.agg(F.count("*").alias("buckets"), F.sum("doc_count").alias("docs"), F.count_if(F.col("doc_count") == 0).alias("empty"))


@register(
    "prob_gate_by_country",
    f"""SELECT country, count(*) AS doc_count FROM {POSTS_SQL} p
WHERE flood_probability > 0.6 AND flood_probability <= 1.0 GROUP BY country""",
)
def prob_gate_by_country(spark: SparkSession, sf: str) -> DataFrame:
    """0.6 < p <= 1 half-open gate, counted per country."""
    df = posts(spark, sf).filter(FL.probability_gate(0.6, 1.0))
    return df.groupBy("country").agg(F.count(F.lit(1)).alias("doc_count"))


@register(
    "bounds_by_country",
    f"""SELECT country, count(*) AS doc_count, max(lat) AS top_left_lat, min(lon) AS top_left_lon,
       min(lat) AS bottom_right_lat, max(lon) AS bottom_right_lon,
       round((max(lat) + min(lat)) / 2, 6) AS center_lat, round((min(lon) + max(lon)) / 2, 6) AS center_lon
FROM {POSTS_SQL} p GROUP BY country HAVING count(*) >= 5""",
)
def bounds_by_country(spark: SparkSession, sf: str) -> DataFrame:
    """A4 + A5 + F13: bounds and their centre per group, groups with >= 5 docs."""
    from tidewatch.functions.geo import bounds_center

    g = posts(spark, sf).groupBy("country").agg(F.count(F.lit(1)).alias("doc_count"), *A.geo_bounds_aggs())
    g = FL.min_entries(g, 5)
    c = bounds_center("top_left_lat", "top_left_lon", "bottom_right_lat", "bottom_right_lon")
    return g.select("*", F.round(c["lat"], R).alias("center_lat"), F.round(c["lon"], R).alias("center_lon"))


@register(
    "user_centroids",
    f"""SELECT user_id, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon
FROM {POSTS_SQL} p GROUP BY user_id""",
)
def user_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean coordinate of each user's posts."""
    g = posts(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("location.lat").alias("lat"), F.avg("location.lon").alias("lon"))
    return g.select("user_id", "n", F.round("lat", R).alias("lat"), F.round("lon", R).alias("lon"))


@register(
    "unlabelled_documents",
    """SELECT d.doc_id, d.lang, d.source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY d.doc_id""",
)
def unlabelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """rows missing a field (their label), oldest first."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality"))
    joined = docs.join(labels, "doc_id", "left")
    return FL.missing(joined, "quality", limit=None).orderBy("doc_id").select("doc_id", "lang", "source")


@register(
    "count_filtered",
    f"SELECT count(*) AS total_count FROM {POSTS_SQL} p WHERE flood_probability >= 0.5",
)
def count_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Result count of a filtered query."""
    from tidewatch.plans.query import result_count

    return result_count(FL.apply_filters(posts(spark, sf), {"flood_probability__gte": "0.5"}))
