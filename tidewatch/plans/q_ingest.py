"""Registered ingest and keyed-write queries (S2-S8, S12, S14, W3, A13, P-ops, C2-C4)."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions import records as RC
from tidewatch.operators import cluster as C
from tidewatch.operators import keyed as K
from tidewatch.operators.aggs import instant_to_ntz, ntz_to_instant, outcome_counts
from tidewatch.operators.normalize import normalize, renormalize
from tidewatch.plans.catalog import register
from tidewatch.plans.q_cluster import categorize_sql
from tidewatch.plans.q_geo import COUNTRIES_SQL, RING_SQL
from tidewatch.session import checkpoint_dir, written
from tidewatch.sources import ingest as IN
from tidewatch.sources.evolution import GrowingTable
from tidewatch.sources.tables import POSTS_SQL, posts, table

R = 6


def _order_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Order versions derived from lineitem: one version per line, the last line wins."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linenumber").alias("version"),
        F.col("l_linestatus").alias("o_orderstatus"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("o_totalprice"),
    )


_LATEST_SQL = """(SELECT o_orderkey, arg_max(o_orderstatus, (version, o_totalprice, o_orderstatus)) AS o_orderstatus,
        arg_max(o_totalprice, (version, o_totalprice, o_orderstatus)) AS o_totalprice
 FROM (SELECT l_orderkey AS o_orderkey, l_linenumber AS version, l_linestatus AS o_orderstatus,
              l_extendedprice * (1 - l_discount) AS o_totalprice FROM lineitem) v GROUP BY o_orderkey)"""


def _write_arrays(rows: DataFrame, files: str, order: str, path: str, most: int = 400_000) -> None:
    """One JSON array per value of `files`: its records in `order`, in the folder `files`=value. An array of more than about
    `most` records is cut into that many parts of the range of `order`, array files that hold it in name order; each is
    sorted and written by itself, so no task's sort grows with the rows."""
    largest = rows.groupBy(files).count().agg(F.max("count")).first()[0] or 0
    n = max(1, -(-largest // most))
    lines = rows.select(files, F.col(order).alias("at"), F.to_json(F.struct("*")).alias("value"))
    if n > 1:
        cuts = rows.groupBy(F.col(files).alias("_f")).agg(F.percentile_approx(order, [i / n for i in range(1, n)], 100 * n).alias("cuts"))  # one row a file
        lines = lines.join(F.broadcast(cuts), F.col(files).eqNullSafe(F.col("_f")))
        below = F.size(F.filter("cuts", lambda x: x < F.col("at")))
    else:
        below = F.lit(0)
    lines = lines.select(files, F.format_string("%06d", F.when(F.col("at").isNull(), 0).otherwise(below)).alias("part"), "at", "value")  # without a key: first
    parts = n * rows.select(files).distinct().count()
    w = Window.partitionBy(files, "part").orderBy("at", "value")
    text = F.concat(F.when(F.row_number().over(w) == 1, "[").otherwise(","), "value", F.when(F.lead("value").over(w).isNull(), "]").otherwise(""))
    lines = lines.repartition(parts, files, "part").withColumn("text", text).sortWithinPartitions(files, "part", "at", "value")
    lines.select(files, "part", F.col("text").alias("value")).write.partitionBy(files, "part").text(path)


@register(
    "load_json_orders",
    """SELECT o_orderkey % 4 AS file, pos, o_orderkey, o_orderstatus, round(CAST(o_totalprice AS DOUBLE), 4) AS o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS pos FROM orders) o WHERE pos >= 100 AND pos < 3100""",
)
def load_json_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A slice of the records of every array of a folder of JSON array files, read split by split."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/json-orders-{uuid.uuid4().hex[:12]}"
    _write_arrays(table(spark, sf, "orders").withColumn("file", F.col("o_orderkey") % 4), "file", "o_orderkey", path)
    raw = F.parse_json("raw")
    return IN.load_json(spark, path, 100, 3000, array=F.regexp_extract("file", "/file=([^/]*)/", 1)).select(
        (F.variant_get(raw, "$.o_orderkey", "bigint") % 4).alias("file"), "pos", F.variant_get(raw, "$.o_orderkey", "bigint").alias("o_orderkey"),
        F.variant_get(raw, "$.o_orderstatus", "string").alias("o_orderstatus"), F.round(F.variant_get(raw, "$.o_totalprice", "double"), 4).alias("o_totalprice"))


@register(
    "upsert_outcomes",
    f"""SELECT CASE WHEN o.o_orderkey IS NULL THEN 'created' ELSE 'updated' END AS outcome, count(*) AS n
FROM {_LATEST_SQL} u LEFT JOIN orders o ON u.o_orderkey = o.o_orderkey GROUP BY 1""",
)
def upsert_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """S4 + W3 + A13: upsert line-derived order versions (last line wins); tally outcomes."""
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    _, outcomes = K.upsert(base, _order_updates(spark, sf), "o_orderkey", order_col=["version", "o_totalprice", "o_orderstatus"])
    return outcome_counts(outcomes)


@register(
    "upsert_merged",
    f"""SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM (
  SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_LATEST_SQL} x)
  UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM {_LATEST_SQL} y) m""",
)
def upsert_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The merged table (replace-or-insert by key)."""
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    merged, _ = K.upsert(base, _order_updates(spark, sf), "o_orderkey", order_col=["version", "o_totalprice", "o_orderstatus"])
    return merged.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 6).alias("o_totalprice"))


@register(
    "delete_returned_orders",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN
  (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def delete_returned_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Delete by an id set computed by a previous step (anti join)."""
    ids = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.delete_by_id(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ids, "o_orderkey")


@register(
    "update_order_totals",
    """SELECT o.o_orderkey, o.o_orderstatus,
       round(CASE WHEN p.o_orderkey IS NOT NULL THEN p.total ELSE o.o_totalprice END, 6) AS o_totalprice
FROM orders o LEFT JOIN (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total
                         FROM lineitem GROUP BY 1) p ON o.o_orderkey = p.o_orderkey""",
)
def update_order_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Partial update - recomputed totals merged into orders, other columns unchanged."""
    li = table(spark, sf, "lineitem")
    patch = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("o_totalprice"))
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = K.update_fields(base, patch, "o_orderkey")
    return out.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 6).alias("o_totalprice"))


@register(
    "lookup_building_orders",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN
  (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def lookup_building_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Point lookup of an id set (semi join)."""
    ids = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return K.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ids, "o_custkey").drop("o_custkey")


@register(
    "archive_scan_orders",
    """SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders
WHERE strftime(o_orderdate, '%Y-%m') IN ('1995-03', '1995-04', '1995-05')
  AND o_orderdate >= TIMESTAMP '1995-03-10 00:00:00' AND o_orderdate < TIMESTAMP '1995-05-20 00:00:00'
  AND o_orderstatus = 'F'""",
)
def archive_scan_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Month-bucket + time-range + collection scan of an archive (orders by month)."""
    arch = table(spark, sf, "orders").withColumn("monthbucket", F.date_format("o_orderdate", "yyyy-MM"))
    out = IN.scan_archive(arch, datetime(1995, 3, 10), datetime(1995, 5, 20), collection="F", ts="o_orderdate",
                          collection_col="o_orderstatus")
    return out.select("o_orderkey", "o_orderdate", "o_orderstatus")


@register(
    "gate_raw_events",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events "
    "WHERE json_valid(props) AND value IS NOT NULL AND user_id IS NOT NULL",
)
def gate_raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """S3 + P2/P7: parse the JSON body, drop unparsable / missing annotation / missing
    coordinates rows, read a path from the parsed body."""
    ev = table(spark, sf, "events").select("event_id", F.col("props").alias("tweet"),
                                           F.col("value").alias("annotations"), F.col("user_id").alias("latlong"))
    g = IN.gate_raw(ev)
    return g.select("event_id", F.variant_get("tweet", "$.k", "bigint").alias("k"))


@register(
    "growing_orders",
    """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 >= 1 THEN o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 3 = 2 THEN o_custkey END AS who_id, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS who_rank FROM (
  SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
         o_orderstatus, o_custkey, o_orderpriority FROM orders)""",
)
def growing_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written in three versions of the schema (wider types, added fields, a nested one) and read as one table."""
    o, at = table(spark, sf, "orders"), F.col("o_orderkey") % 3
    grown = GrowingTable(spark, f"{checkpoint_dir(spark).rstrip('/')}/growing-{uuid.uuid4().hex[:12]}")
    grown.append(o.where(at == 0).select(F.col("o_orderkey").cast("int").alias("o_orderkey"), F.col("o_totalprice").cast("float").alias("o_totalprice")))
    grown.append(o.where(at == 1).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", "o_totalprice"))
    grown.append(o.where(at == 2).select("o_totalprice", "o_orderstatus", F.col("o_orderkey").cast("int").alias("o_orderkey"),
                                         F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("rank")).alias("who")))
    return grown.read().select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("who.id").alias("who_id"), F.col("who.rank").alias("who_rank"))


_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "timestamp": "TIMESTAMP"}
_POST_COLUMNS = [(f.name, f.dataType.simpleString()) for f in schema.POST_SCHEMA.fields if f.name != "location"]


def _null_columns(*given: str) -> str:
    """SQL of the post schema's columns but `given` and the location, all null."""
    return ", ".join(f"CAST(NULL AS {_SQL_TYPES[kind]}) AS {name}" for name, kind in _POST_COLUMNS if name not in given)


def _flat_post(df: DataFrame) -> DataFrame:
    """Posts with the location as two columns and the time as wall clock in UTC."""
    return df.select(*[instant_to_ntz(F.col(n)).alias(n) if kind == "timestamp" else F.col(n) for n, kind in _POST_COLUMNS],
                     F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))


@register("conform_posts", f"SELECT tweetid, created_at, flood_probability, country, lat, lon, "
          f"user_id, {_null_columns('tweetid', 'created_at', 'flood_probability', 'country', 'user_id')} FROM {POSTS_SQL} p")
def conform_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts restricted/cast to the fixed post schema (missing columns NULL)."""
    return _flat_post(IN.conform(posts(spark, sf)))


# a probability as Java writes a double: from 0.001 on plainly, below it as d.dddE-n
_JAVA_DOUBLE = """CASE WHEN {0} = 0 OR {0} >= 0.001 THEN CAST({0} AS VARCHAR) WHEN contains(CAST({0} AS VARCHAR), 'e')
  THEN regexp_replace(regexp_replace(CAST({0} AS VARCHAR), 'e-0?', 'E-'), '^(\\d)E', '\\1.0E')
  ELSE regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '^0\\.0*(\\d)(\\d*)$', '\\1.\\2'), '\\.$', '.0') || 'E-'
       || (length(regexp_extract(CAST({0} AS VARCHAR), '^0\\.(0*)', 1)) + 1) END""".format("flood_probability")


@register("geojson_posts", f"""
SELECT tweetid, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']}},"properties":{{"id_num":' || id_num
  || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || '","flood_probability":' || {_JAVA_DOUBLE} || ',"country":"' || country
  || '","user_id":' || user_id || ',"id":"' || tweetid || '"}}}}' AS feature FROM {POSTS_SQL} p""")
def geojson_posts(spark: SparkSession, sf: str) -> DataFrame:
    """One GeoJSON Feature per post."""
    return IN.to_geojson(posts(spark, sf).drop("props"))


def raw_posts(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """Raw nested posts derived from events (JSON text), in the shapes the normalizer
    accepts: an envelope in half of them, point / bounding box / place-name locations,
    scalar or [label, p] probabilities, ISO or platform timestamps, and some records
    that must be rejected (no annotations, unsupported language). With `parts` the events are dealt out
    while the rows are small: a file of few row groups would be parsed by few tasks."""
    ev = table(spark, sf, "events")
    if parts:
        ev = ev.repartition(parts, "event_id")
    nat = table(spark, sf, "nation").select("n_nationkey", "n_name")
    ev = ev.join(nat, (ev.user_id % 25) == nat.n_nationkey, "left")
    eid = F.col("event_id")
    lat = ((F.col("user_id") * 7919) % 12000).cast("double") / 100.0 - 60.0
    lon = ((F.col("user_id") * 104729) % 34000).cast("double") / 100.0 - 170.0
    p = (F.col("value") / 500.0).cast("string")
    prob = F.when(eid % 4 == 0, F.format_string('["yes", %s]', p)).when(eid % 4 == 1, F.lit('["no", 0.9]')).otherwise(p)
    ann = F.when(eid % 53 == 0, F.lit("")).otherwise(F.format_string(',"annotations":{"flood_probability":%s}', prob))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    plat = F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    from tidewatch.operators.aggs import ntz_to_instant

    ts_ms = (F.unix_micros(ntz_to_instant(F.col("ts"))) / 1000).cast("bigint").cast("string")
    created = F.when(eid % 3 == 0, plat).otherwise(iso)
    text = F.format_string("Flood %s near %s #%s @user%s http://x.example/%s", F.col("event_type"), F.col("n_name"),
                           F.col("event_type"), F.col("user_id"), eid)
    lang = F.when(eid % 41 == 0, F.lit("xx")).otherwise(F.lit("en"))
    geo = (F.when(eid % 5 == 0, F.format_string('"coordinates":{"type":"Point","coordinates":[%s,%s]}', lon, lat))
           .when(eid % 5 == 1, F.format_string('"place":{"name":"%s","full_name":"%s, X","country":"C%s","bounding_box":'
                                               '{"type":"Polygon","coordinates":[[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]}}',
                                               F.col("n_name"), F.col("n_name"), F.col("n_nationkey"),
                                               lon, lat, lon + 1, lat, lon + 1, lat + 1, lon, lat + 1))
           .otherwise(F.format_string('"user":{"id":%s,"name":"u%s","location":" %s "}', F.col("user_id"),
                                      F.col("user_id"), F.col("n_name"))))
    body = F.format_string('{"id":%s,"created_at":"%s","timestamp_ms":"%s","text":"%s","lang":"%s",%s,'
                           '"entities":{"hashtags":[{"text":"%s","indices":[0,1]}],'
                           '"media":[{"media_url":"http://m.example/%s.jpg","media_url_https":"https://m.example/%s.jpg"}]}}',
                           eid, created, ts_ms, text, lang, geo, F.col("event_type"), eid, eid)
    outer = F.when(eid % 2 == 0, F.format_string('{"tweetid":"%s","lang":"en"%s,"tweet":%s}', eid, ann, body)) \
        .otherwise(F.format_string('{"tweetid":"%s"%s,"tweet":%s}', eid, ann, F.concat(F.lit('"'), F.regexp_replace(body, '"', '\\\\"'), F.lit('"'))))
    return ev.select(eid.alias("event_id"), outer.alias("raw"))


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """Gazetteer from the nation table: each name at the centre of its grid rectangle."""
    nat = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    return nat.select(F.col("n_name").alias("place"),
                      ((F.floor(k / 10) * 24 - 60) + 12).cast("double").alias("lat"),
                      ((k % 10) * 36 - 180 + 18).cast("double").alias("lon"))


# the fields that the raw posts above must get, from the events themselves: the place is the nation named in the text, the
# location its gazetteer point, the country the first polygon around it
NORMAL_SQL = f"""
WITH e AS (SELECT event_id, ts, user_id, event_type, value / CAST(500.0 AS DOUBLE) AS p, user_id % 25 AS k FROM events WHERE event_id % 53 <> 0 AND event_id % 41 <> 0),
g AS (SELECT n_nationkey AS k, n_name, CAST(floor(n_nationkey / 10) * 24 - 60 + 12 AS DOUBLE) AS plat, CAST((n_nationkey % 10) * 36 - 180 + 18 AS DOUBLE) AS plon FROM nation),
c AS (SELECT * FROM {COUNTRIES_SQL} c),
hits AS (SELECT g.k, c.fid, c.name FROM g JOIN c ON true
         WHERE list_reduce(list_transform(c.rings, lambda r: CASE WHEN {RING_SQL} THEN 1 ELSE 0 END), lambda a, b: a + b, 0) % 2 = 1),
first AS (SELECT k, arg_min(name, fid) AS country FROM hits GROUP BY k)
SELECT CAST(event_id AS VARCHAR) AS tweetid, date_trunc('milliseconds', ts) AS created_at, CASE WHEN event_id % 4 = 1 THEN 0 ELSE p END AS flood_probability,
       plat AS lat, plon AS lon, 'Flood ' || event_type || ' near ' || n_name || ' #' || event_type || ' @user' || user_id || ' http://x.example/' || event_id AS text,
       CASE WHEN event_id % 5 > 1 THEN user_id END AS user_id, CASE WHEN event_id % 5 > 1 THEN 'u' || user_id END AS user_name,
       CASE WHEN event_id % 5 > 1 THEN ' ' || n_name || ' ' END AS user_location, country, 'en' AS lang, n_name AS place,
       list_sort(list_distinct(['flood', CASE event_type WHEN 'purchase' THEN 'purchas' ELSE event_type END, 'near', lower(n_name), event_type])) AS tokens,
       ['http://m.example/' || event_id || '.jpg', 'https://m.example/' || event_id || '.jpg'] AS media_urls,
       {_null_columns('tweetid', 'created_at', 'flood_probability', 'text', 'user_id', 'user_name', 'user_location', 'country', 'lang', 'place', 'tokens', 'media_urls')}
FROM e JOIN g USING (k) LEFT JOIN first USING (k)"""


def _normalized(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from tidewatch.operators.geojoin import countries_from_nations

    raw = raw_posts(spark, sf, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return normalize(raw, gazetteer(spark, sf), countries_from_nations(table(spark, sf, "nation")), now=datetime(2024, 2, 1))


def sorted_post(df: DataFrame) -> DataFrame:
    return _flat_post(df).withColumn("tokens", F.array_sort("tokens"))


@register("normalize_raw_posts", NORMAL_SQL)
def normalize_raw_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Normalize raw nested posts; ok rows."""
    return sorted_post(_normalized(spark, sf)[0])


@register("normalize_rejects", """
SELECT CASE WHEN event_id % 53 = 0 THEN 'missing annotations' ELSE 'unsupported language: xx' END AS reason, count(*) AS n
FROM events WHERE event_id % 53 = 0 OR event_id % 41 = 0 GROUP BY 1""")
def normalize_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """P13 rejects: records that cannot be normalized, with a reason (never an abort)."""
    return _normalized(spark, sf)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("renormalize_posts", NORMAL_SQL)
def renormalize_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Full scan + re-normalize of already-normalized rows (idempotent)."""
    from tidewatch.operators.geojoin import countries_from_nations

    ok, _ = _normalized(spark, sf)
    again, _ = renormalize(ok, gazetteer(spark, sf), countries_from_nations(table(spark, sf, "nation")), now=datetime(2024, 2, 1))
    return sorted_post(again)


@register("renormalize_tally", """
SELECT 'updated' AS outcome, count(*) AS n FROM events WHERE event_id % 53 <> 0 AND event_id % 41 <> 0 AND event_id % 2 = 0
UNION ALL SELECT 'created', count(*) FROM events WHERE event_id % 53 <> 0 AND event_id % 41 <> 0 AND event_id % 2 = 1
UNION ALL SELECT 'rows after', count(*) FROM events WHERE event_id % 53 <> 0 AND event_id % 41 <> 0""")
def renormalize_tally(spark: SparkSession, sf: str) -> DataFrame:
    """S8 with upsert and tally in one call: all posts normalized again into a table that holds half of them."""
    from tidewatch.operators.geojoin import countries_from_nations
    from tidewatch.operators.normalize import renormalize_into

    ok = written(_normalized(spark, sf)[0], "renormalize")
    half = ok.where(F.col("tweetid").cast("long") % 2 == 0)
    merged, tally = renormalize_into(half, ok, gazetteer(spark, sf), countries_from_nations(table(spark, sf, "nation")), stored=True, now=datetime(2024, 2, 1))
    return tally.unionByName(merged.agg(F.lit("rows after").alias("outcome"), F.count_distinct("tweetid").alias("n")))


@register("records_shaped", """
SELECT event_id, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'right' ELSE 'left' END AS n_a, 'e' || event_type AS n_b,
       event_type AS kind, CAST(user_id AS VARCHAR) AS who, ts + INTERVAL 9 HOUR AS in_japan, ts - INTERVAL 9 HOUR AS from_japan FROM events""")
def records_shaped(spark: SparkSession, sf: str) -> DataFrame:
    """Nested merge of two records, name-value pairs as a map (the last of a name), dropped keys, times in a zone."""
    ev = table(spark, sf, "events")
    names = F.struct(F.lit("left").alias("a"), F.concat(F.lit("e"), "event_type").alias("b"))
    left = F.struct(F.col("event_id").cast("string").alias("id"), names.alias("n"))
    half = F.when(F.col("event_id") % 2 == 0, "right")
    right = F.struct(F.lit(None).cast("string").alias("id"), F.when(half.isNotNull(), F.struct(half.alias("a"), F.lit(None).cast("string").alias("b"))).alias("n"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    ev = ev.select("event_id", "ts", left.alias("l"), right.alias("r"), F.array(
        pair("kind", F.lit("first")), pair("who", F.col("user_id")), pair("kind", F.col("event_type"))).alias("pairs"))
    both = RC.merge_nested(F.col("l"), F.col("r"), ev.schema["l"].dataType)
    ev = ev.withColumns({"m": both, "of": RC.pairs_to_map(F.col("pairs"), "name", "value")})
    out = ev.select("event_id", "m.id", F.col("m.n.a").alias("n_a"), F.col("m.n.b").alias("n_b"), F.col("of")["kind"].alias("kind"), F.col("of")["who"].alias("who"),
                    RC.to_zone(F.col("ts"), "Asia/Tokyo").alias("in_japan"), RC.from_zone(F.col("ts"), "Asia/Tokyo").alias("from_japan"), "l", "r")
    return RC.drop_keys(out, "l", "r", "not there")


# ------------------------------------------------------------------ C2-C4 flows on parts

@register("categorize_query_parts",
          categorize_sql("(SELECT 0 AS grp, * FROM part WHERE p_size >= 40 AND p_type = 'ECONOMY') s",
                         ["grp"], "p_partkey", "p_name").replace("SELECT d.grp,", "SELECT"))
def categorize_query_parts(spark: SparkSession, sf: str) -> DataFrame:
    """A filtered list categorized as one cluster."""
    from tidewatch.plans.flows import categorize_list

    p = table(spark, sf, "part").filter((F.col("p_size") >= 40) & (F.col("p_type") == "ECONOMY"))
    out = categorize_list(p, "p_partkey", "p_name")
    return out.withColumn("centrality", F.round("centrality", R))


_C3_SRC = """(SELECT p.*, s.p_type AS seg_p_type, s.p_size AS seg_p_size FROM part p JOIN (
   SELECT p_type, p_size FROM (
     SELECT p_type, p_size, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_size) AS rn
     FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 10)
     GROUP BY 1, 2) x WHERE rn <= 10 AND n >= 5) s ON p.p_type = s.p_type AND p.p_size = s.p_size) q"""


@register("categorize_clusters_parts",
          categorize_sql(_C3_SRC, ["seg_p_type", "seg_p_size"], "p_partkey", "p_name"))
def categorize_clusters_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Nested-terms segments (type > size), their docs, C1 inside each segment."""
    from tidewatch.plans.flows import categorize_clusters

    out = categorize_clusters(table(spark, sf, "part"), ["p_type", "p_size"], "p_partkey", "p_name", time_field="-")
    return out.select("seg_p_type", "seg_p_size", "p_partkey", "p_name", "multiplicity",
                      F.round("centrality", R).alias("centrality"), "representative", "rank_key")


@register(
    "mark_representative_parts",
    "SELECT p_partkey, representative FROM ("
    + categorize_sql("part", ["p_brand", "p_type"], "p_partkey", "p_name") + ") c",
)
def mark_representative_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The split written back onto the base table as a boolean flag."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    flags = C.categorize(parts, ["p_brand", "p_type"], "p_partkey", "p_name").select("p_partkey", "representative")
    return K.mark_flag(parts, flags, "p_partkey").select("p_partkey", "representative")


@register(
    "flatten_orders_nested",
    "SELECT o_orderkey, o_orderstatus AS info_status, round(o_totalprice, 6) AS info_money_total, "
    "o_orderpriority AS info_money_priority FROM orders",
)
def flatten_orders_nested(spark: SparkSession, sf: str) -> DataFrame:
    """A nested record flattened to parent_child columns."""
    from tidewatch.functions.records import flatten_struct

    o = table(spark, sf, "orders")
    nested = o.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.struct(
        F.round("o_totalprice", R).alias("total"), F.col("o_orderpriority").alias("priority")).alias("money")).alias("info"))
    return flatten_struct(nested)


@register("project_event_paths",
          "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def project_event_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Listed paths of a parsed JSON record as typed columns (absent path -> NULL)."""
    from tidewatch.functions.records import project_paths

    ev = table(spark, sf, "events").select(F.try_parse_json("props").alias("v"))
    return project_paths(ev, "v", ["k:bigint"], extra=["missing:string"])
