"""Registered geo-join queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import geojoin as GJ
from tidewatch.plans.catalog import register
from tidewatch.session import checkpoint_dir
from tidewatch.sources.ingest import GEOJSON_HEAD
from tidewatch.sources.tables import POSTS_SQL, posts, table

R = 6

# SQL form of the synthetic country layer (same rectangles as countries_from_nations)
_RECT = "[{{'lon': CAST({lo} AS DOUBLE), 'lat': CAST({la} AS DOUBLE)}}, {{'lon': CAST({lo} + {w} AS DOUBLE), 'lat': CAST({la} AS DOUBLE)}}, " \
        "{{'lon': CAST({lo} + {w} AS DOUBLE), 'lat': CAST({la} + {h} AS DOUBLE)}}, {{'lon': CAST({lo} AS DOUBLE), 'lat': CAST({la} + {h} AS DOUBLE)}}]"
_LO, _LA = "((n_nationkey % 10) * 36 - 180)", "(floor(n_nationkey / 10) * 24 - 60)"
COUNTRIES_SQL = f"""(SELECT CAST(n_nationkey AS INTEGER) AS fid, n_name AS name,
  CASE WHEN n_nationkey % 5 = 0
       THEN [{_RECT.format(lo=_LO + ' - 18', la=_LA + ' - 12', w=60, h=40)}, {_RECT.format(lo=_LO + ' - 8', la=_LA + ' - 4', w=8, h=8)}]
       ELSE [{_RECT.format(lo=_LO, la=_LA, w=36, h=24)}] END AS rings
 FROM nation)"""

RING_SQL = ("list_reduce(range(len(r)), lambda acc, i: CASE WHEN ((r[i + 1].lat > plat) != (r[CASE WHEN i = 0 THEN len(r) ELSE i END].lat > plat)) "
             "AND plon < (r[CASE WHEN i = 0 THEN len(r) ELSE i END].lon - r[i + 1].lon) * (plat - r[i + 1].lat) / "
             "(r[CASE WHEN i = 0 THEN len(r) ELSE i END].lat - r[i + 1].lat) + r[i + 1].lon THEN NOT acc ELSE acc END, false)")


@register(
    "country_of_posts",
    f"""WITH p AS (SELECT tweetid, lat AS plat, lon AS plon FROM {POSTS_SQL} p),
c AS (SELECT * FROM {COUNTRIES_SQL} c),
hits AS (SELECT p.tweetid, c.fid, c.name FROM p JOIN c ON true
         WHERE list_reduce(list_transform(c.rings, lambda r: CASE WHEN {RING_SQL} THEN 1 ELSE 0 END), lambda a, b: a + b, 0) % 2 = 1),
first AS (SELECT tweetid, arg_min(name, fid) AS country FROM hits GROUP BY tweetid)
SELECT p.tweetid, first.country FROM p LEFT JOIN first ON p.tweetid = first.tweetid""",
)
def country_of_posts(spark: SparkSession, sf: str) -> DataFrame:
    """J1 (+X15, W2): point in polygon (holes, overlaps: first feature wins), NULL at sea."""
    layer = GJ.countries_from_nations(table(spark, sf, "nation"))
    out = GJ.country_of(posts(spark, sf).select("tweetid", "location"), layer)
    return out.select("tweetid", "country")


def _gaz(spark: SparkSession, sf: str) -> DataFrame:
    nat = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    return nat.select(F.col("n_name").alias("place"), ((F.floor(k / 10) * 24 - 60) + 12).cast("double").alias("lat"),
                      ((k % 10) * 36 - 180 + 18).cast("double").alias("lon"))


_GAZ_SQL = """(SELECT lower(n_name) AS pk, CAST(floor(n_nationkey / 10) * 24 - 60 + 12 AS DOUBLE) AS lat,
        CAST((n_nationkey % 10) * 36 - 180 + 18 AS DOUBLE) AS lon FROM nation)"""


@register(
    "geocode_customers",
    f"""WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'nowhere' ELSE '  ' || upper(n_name) || ' ' END AS place
           FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, place, g.lat AS lat, g.lon AS lon
FROM c LEFT JOIN {_GAZ_SQL} g ON lower(regexp_replace(trim(place), '\\s+', ' ', 'g')) = g.pk""",
)
def geocode_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Place strings (untrimmed, upper-case, some unknown) -> gazetteer coordinates."""
    cust = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.when(F.col("c_acctbal") < 0, F.lit("nowhere")).otherwise(F.concat(F.lit("  "), F.upper("n_name"), F.lit(" ")))
    df = cust.select("c_custkey", place.alias("place"))
    out = GJ.geocode(df, _gaz(spark, sf))
    return out.select("c_custkey", "place", F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"))


# Vincenty's iteration on the ellipsoid, thirty rounds (candidates are never nearly opposite to a post and nearest to it)
_VINCENTY = """
u AS (SELECT *, atan((1 - 1 / 298.257223563) * tan(radians(lat))) AS u1, atan((1 - 1 / 298.257223563) * tan(radians(glat))) AS u2, radians(glon - lon) AS l0 FROM c),
v AS (SELECT *, list_reduce([l0] || list_transform(range(30), lambda x: l0), lambda lam, l: l + {step}) AS lam FROM u),
w AS (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
             sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v),
x AS (SELECT *, atan2(ss, cs) AS sg, 1 - pow(CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END, 2) AS c2 FROM w),
y AS (SELECT *, CASE WHEN c2 = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / c2 END AS cm, c2 * 0.00673949674227643 AS k FROM x),
d AS (SELECT *, 6356752.314245179 * (1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))) * (sg - k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        * ss * (cm + k / 4096 * (256 + k * (-128 + k * (74 - 47 * k))) * cs * (2 * cm * cm - 1))) AS dist FROM y)"""
_STEP = """(1 - {C}) / 298.257223563 * {sa} * ({sg} + {C} * {ss} * ({cm} + {C} * {cs} * (2 * {cm} * {cm} - 1)))"""


def _vincenty() -> str:
    ss = "sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2))"
    cs = "(sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam))"
    sa = f"(cos(u1) * cos(u2) * sin(lam) / greatest({ss}, 1e-300))"
    c2 = f"greatest(1 - pow({sa}, 2), 1e-300)"
    cm = f"({cs} - 2 * sin(u1) * sin(u2) / {c2})"
    C = f"(1 / 298.257223563 / 16 * {c2} * (4 + 1 / 298.257223563 * (4 - 3 * {c2})))"
    return _VINCENTY.format(step=_STEP.format(C=C, sa=sa, sg=f"atan2({ss}, {cs})", ss=ss, cm=cm, cs=cs))


@register(
    "nearest_place_posts",
    f"""WITH p AS (SELECT tweetid, lat, lon, user_id FROM {POSTS_SQL} p),
g AS (SELECT n_nationkey AS k, n_name AS place, CAST(floor(n_nationkey / 10) * 24 - 60 + 12 AS DOUBLE) AS glat,
             CAST((n_nationkey % 10) * 36 - 180 + 18 AS DOUBLE) AS glon FROM nation),
c AS (SELECT p.tweetid, x.i, g.place, g.glat, g.glon, p.lat, p.lon
      FROM p CROSS JOIN (VALUES (0, 0), (1, 7), (2, 13)) x(i, off) JOIN g ON g.k = (p.user_id + x.off) % 25),{{}}
SELECT tweetid, arg_min(place, (dist, i)) AS place FROM d WHERE dist < 20460000 GROUP BY tweetid""".format(_vincenty()),
)
def nearest_place_posts(spark: SparkSession, sf: str) -> DataFrame:
    """J3 (+X10): of three candidate places per post, the nearest to the post's location."""
    p = posts(spark, sf).select("tweetid", "user_id", "location")
    nat = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    cand_tab = nat.select(k.alias("k"), F.struct(F.col("n_name").alias("place"),
                                                  ((F.floor(k / 10) * 24 - 60) + 12).cast("double").alias("lat"),
                                                  ((k % 10) * 36 - 180 + 18).cast("double").alias("lon")).alias("c"))
    # candidate list per post: nations user_id, +7, +13 (mod 25), in that order
    tagged = p.select("tweetid", "location", F.posexplode(F.array(
        (F.col("user_id") % 25), ((F.col("user_id") + 7) % 25), ((F.col("user_id") + 13) % 25))).alias("i", "k"))
    joined = tagged.join(cand_tab, "k").groupBy("tweetid", "location").agg(
        F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cs"))
    joined = joined.withColumn("cands", F.transform("cs", lambda x: x["c"]))
    out = GJ.nearest_candidate(joined, "cands", "location")
    return out.select("tweetid", F.col("nearest.place").alias("place")).filter(F.col("place").isNotNull())


@register(
    "load_layer_regions",
    """WITH c AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS fid FROM nation)
SELECT CAST(fid AS INTEGER) AS fid, n_name AS name, 'R' || n_regionkey AS iso2, CAST(4 * (1 + n_nationkey % 3) AS BIGINT) AS points,
       CAST(n_nationkey * 10 + 2 AS DOUBLE) AS east FROM c""",
)
def load_layer_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A layer file (Polygon and MultiPolygon features) written from the nations and read back split by split."""
    k = F.col("n_nationkey")
    ring = F.transform(F.array(F.lit(0), F.lit(2), F.lit(2), F.lit(0)), lambda x, i: F.array((k * 10 + x).cast("double"), F.floor(i / 2).cast("double")))
    polygon, parts = F.to_json(F.array(ring)), F.array_repeat(F.array(ring), (k % 3 + 1).cast("int"))
    shape = F.when(k % 3 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":'), polygon, F.lit("}"))).otherwise(
        F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(parts), F.lit("}")))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"NAME":'), F.to_json(F.to_variant_object(F.array("n_name"))), F.lit(',"ISO2":"R'), F.col("n_regionkey").cast("string"),
                       F.lit('"},"geometry":'), shape, F.lit("}"))
    feature = F.regexp_replace(feature, r'"NAME":\[(.*?)\],"ISO2"', '"NAME":$1,"ISO2"')
    path = f"{checkpoint_dir(spark).rstrip('/')}/layer-{uuid.uuid4().hex[:12]}"
    lines = table(spark, sf, "nation").select(k.alias("at"), F.concat(F.when(k == 0, F.lit(GEOJSON_HEAD)).otherwise(","), feature).alias("value"))
    end = lines.agg(F.max("at").alias("m")).select((F.col("m") + 1).alias("at"), F.lit("]}").alias("value"))
    lines.unionByName(end).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    layer = GJ.load_countries(spark, path)
    points = F.flatten("rings")
    return layer.select("fid", "name", "iso2", F.size(points).cast("long").alias("points"), F.array_max(F.transform(points, lambda p: p["lon"])).alias("east"))


@register("country_names", "SELECT CAST(n_nationkey AS INTEGER) AS fid, n_name AS name FROM nation")
def country_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the layer in layer order."""
    return GJ.country_names(GJ.countries_from_nations(table(spark, sf, "nation")))


@register(
    "filter_layer_south",
    "SELECT CAST(n_nationkey AS INTEGER) AS fid, n_name AS name, 'N' || CAST(n_nationkey AS VARCHAR) AS iso2 "
    "FROM nation WHERE floor(n_nationkey / 10) * 24 - 60 < 0 AND n_nationkey % 5 <> 0",
)
def filter_layer_south(spark: SparkSession, sf: str) -> DataFrame:
    """A predicate over features (simple rectangles wholly or partly south of the equator)."""
    layer = GJ.countries_from_nations(table(spark, sf, "nation"))
    pred = (F.size("rings") == 1) & (F.array_min(F.transform(F.element_at("rings", 1), lambda p: p["lat"])) < 0)
    return GJ.filter_layer(layer, pred).select("fid", "name", "iso2")
