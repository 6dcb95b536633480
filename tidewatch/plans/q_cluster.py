"""Registered clustering queries: nested terms, geo cells x terms, cluster membership,
representative split (C1) and its flows (C3, C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.geo import geohash_sql, mean_point
from tidewatch.operators import cluster as C
from tidewatch.functions.text import NORMALIZE_STEPS
from tidewatch.plans.catalog import register
from tidewatch.sources.tables import POSTS_SQL, posts, table

R = 6

# DuckDB (RE2) form of the aggressive normalization; equal to the Spark chain on ASCII text.
NORMALIZE_SQL_STEPS = tuple(
    (p.replace("(?U)", "").replace("(?iU)", "(?i)").replace("(?idU)", "(?i)").replace(r"\u2019", r"\x{2019}"), r)
    for p, r in NORMALIZE_STEPS)


def normalize_sql(expr: str) -> str:
    out = expr
    for pat, rep in NORMALIZE_SQL_STEPS:
        out = f"regexp_replace({out}, '{pat.replace(chr(39), chr(39) * 2)}', '{rep}', 'g')"
    return out


def lcs_sql(a: str, b: str) -> str:
    """LCS length as a DuckDB expression (row-by-row DP with nested list_reduce)."""
    return (
        f"list_reduce(string_split({a}, ''), lambda prev, ca: list_reduce(range(1, length({b}) + 1), "
        f"lambda row, j: list_append(row, greatest(row[j], prev[j + 1], prev[j] + CASE WHEN ca = substr({b}, j, 1) THEN 1 ELSE 0 END)), [0]), "
        f"list_transform(range(length({b}) + 1), lambda x: 0))[length({b}) + 1]"
    )


def categorize_sql(source: str, keys: list[str], id_col: str, text_col: str) -> str:
    """Brute-force C1 in SQL: every ordered pair of the cluster (the oracle, small data only)."""
    k = ", ".join(keys)
    on = " AND ".join(f"x.{c} = y.{c}" for c in keys)
    return f"""
WITH d AS (SELECT {k}, {id_col} AS id, {text_col} AS txt, {normalize_sql(text_col)} AS nt FROM {source}),
pr AS (SELECT {', '.join('x.' + c for c in keys)}, x.id AS xid, y.id AS yid,
              CASE WHEN length(x.nt) + length(y.nt) = 0 THEN 1.0
                   ELSE 2.0 * ({lcs_sql('x.nt', 'y.nt')}) / (length(x.nt) + length(y.nt)) END AS sim
       FROM d x JOIN d y ON {on}),
g AS (SELECT {k}, xid, sum(sim) AS ssum,
             count(*) FILTER (WHERE yid > xid AND sim > 0.8) AS nm,
             count(*) FILTER (WHERE yid < xid AND sim > 0.8) AS nd
      FROM pr GROUP BY {k}, xid)
SELECT {', '.join('d.' + c for c in keys)}, d.id AS {id_col}, d.txt AS {text_col},
       CAST(greatest(g.nm, 1) AS BIGINT) AS multiplicity,
       CASE WHEN g.nd > 0 THEN 0.0 ELSE round(2 * g.ssum, 6) END AS centrality,
       (g.nd = 0) AS representative,
       CAST(greatest(g.nm, 1) * floor(round(CASE WHEN g.nd > 0 THEN 0 ELSE 2 * g.ssum END, 9)) AS BIGINT) AS rank_key
FROM d JOIN g ON {' AND '.join(f'd.{c} = g.{c}' for c in keys)} AND d.id = g.xid
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("centrality", F.round("centrality", R))


@register("categorize_parts", categorize_sql("part", ["p_brand", "p_type"], "p_partkey", "p_name"))
def categorize_parts(spark: SparkSession, sf: str) -> DataFrame:
    """C1 (+X1, X7, J4, A10, A11, L8): representative split of part names per (brand, type)."""
    parts = table(spark, sf, "part")
    return _rounded(C.categorize(parts, ["p_brand", "p_type"], "p_partkey", "p_name"))


@register("categorize_conversations")
def categorize_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """C1 over whole conversation turns, one cluster per conversation (id = turn)."""
    conv = table(spark, sf, "conversations")
    return _rounded(C.categorize(conv, ["conv_id"], "turn", "text"))


_SEG_SQL = """
WITH d AS (SELECT o_orderstatus, o_orderpriority FROM orders),
l1 AS (SELECT o_orderstatus, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, o_orderstatus LIMIT 10),
l2 AS (SELECT o_orderstatus, o_orderpriority, count(*) AS doc_count FROM d GROUP BY 1, 2),
r2 AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY doc_count DESC, o_orderpriority) AS rn
       FROM l2 WHERE o_orderstatus IN (SELECT o_orderstatus FROM l1))
SELECT o_orderstatus, o_orderpriority, doc_count FROM r2 WHERE rn <= 10 AND doc_count >= 5
"""


@register("segments_orders", _SEG_SQL)
def segments_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A7 (+A6, W1, F13): nested terms status > priority, top 10 per parent, leaves >= 5."""
    return C.cluster_segments(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


_SEG_TIME_SQL = """
WITH d AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS o_orderdate FROM orders),
l1 AS (SELECT o_orderpriority, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, o_orderpriority LIMIT 10),
l2 AS (SELECT o_orderpriority, o_orderdate, count(*) AS doc_count FROM d
       WHERE o_orderpriority IN (SELECT o_orderpriority FROM l1) GROUP BY 1, 2)
SELECT o_orderpriority, o_orderdate, doc_count FROM l2 WHERE doc_count >= 5
"""


@register("segments_orders_monthly", _SEG_TIME_SQL)
def segments_orders_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """A7 with a time level: priority > month histogram (all buckets kept), leaves >= 5."""
    return C.cluster_segments(table(spark, sf, "orders"), ["o_orderpriority", "o_orderdate"], interval="1M",
                              time_field="o_orderdate")


_GEO_SEG_SQL = f"""
WITH p AS (SELECT *, {geohash_sql('lat', 'lon', 5)} AS cell FROM {POSTS_SQL} p),
b AS (SELECT cell, max(lat) AS tl_lat, min(lon) AS tl_lon, min(lat) AS br_lat, max(lon) AS br_lon FROM p GROUP BY cell),
g AS (SELECT cell, country AS value, count(*) AS doc_count FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY doc_count DESC, value) AS rn FROM g)
SELECT r.cell, 'country' AS term, r.value, r.doc_count,
       round(CASE WHEN tl_lat = br_lat THEN tl_lat + 0.001 ELSE tl_lat END, 6) AS top_left_lat,
       round(CASE WHEN tl_lon = br_lon THEN tl_lon - 0.001 ELSE tl_lon END, 6) AS top_left_lon,
       round(CASE WHEN tl_lat = br_lat THEN br_lat - 0.001 ELSE br_lat END, 6) AS bottom_right_lat,
       round(CASE WHEN tl_lon = br_lon THEN br_lon + 0.001 ELSE br_lon END, 6) AS bottom_right_lon
FROM r JOIN b ON r.cell = b.cell WHERE rn <= 10 AND doc_count >= 5
"""


def _round_box(df: DataFrame) -> DataFrame:
    for c in ("top_left_lat", "top_left_lon", "bottom_right_lat", "bottom_right_lon"):
        df = df.withColumn(c, F.round(c, R))
    return df


@register("geo_segments_country", _GEO_SEG_SQL)
def geo_segments_country(spark: SparkSession, sf: str) -> DataFrame:
    """A8 (+X8, X9, A4): geohash-5 cells x top country values, >= 5 docs, widened boxes."""
    return _round_box(C.geo_cluster_segments(posts(spark, sf), ["country"], precision=5))


@register(
    "geo_segments_cells_only",
    f"""
WITH p AS (SELECT *, {geohash_sql('lat', 'lon', 4)} AS cell FROM {POSTS_SQL} p)
SELECT cell, CAST(NULL AS VARCHAR) AS term, CAST(NULL AS VARCHAR) AS value, count(*) AS doc_count,
       round(CASE WHEN max(lat) = min(lat) THEN max(lat) + 0.001 ELSE max(lat) END, 6) AS top_left_lat,
       round(CASE WHEN min(lon) = max(lon) THEN min(lon) - 0.001 ELSE min(lon) END, 6) AS top_left_lon,
       round(CASE WHEN max(lat) = min(lat) THEN min(lat) - 0.001 ELSE min(lat) END, 6) AS bottom_right_lat,
       round(CASE WHEN min(lon) = max(lon) THEN max(lon) + 0.001 ELSE max(lon) END, 6) AS bottom_right_lon
FROM p GROUP BY cell HAVING count(*) >= 5""",
)
def geo_segments_cells_only(spark: SparkSession, sf: str) -> DataFrame:
    """A8 with no extra term: cell-only segments (D5 extension)."""
    return _round_box(C.geo_cluster_segments(posts(spark, sf), [], precision=4))


@register(
    "cluster_members_orders",
    _SEG_SQL.replace("SELECT o_orderstatus, o_orderpriority, doc_count FROM r2 WHERE rn <= 10 AND doc_count >= 5",
                     ", seg AS (SELECT o_orderstatus, o_orderpriority FROM r2 WHERE rn <= 10 AND doc_count >= 5)")
    + """
SELECT seg.o_orderstatus AS seg_o_orderstatus, seg.o_orderpriority AS seg_o_orderpriority, count(*) AS n_docs,
       round(sum(o.o_totalprice), 6) AS total_price
FROM orders o JOIN seg ON o.o_orderstatus = seg.o_orderstatus AND o.o_orderpriority = seg.o_orderpriority
GROUP BY 1, 2""",
)
def cluster_members_orders(spark: SparkSession, sf: str) -> DataFrame:
    """J6 + A9: docs of each surviving segment (equi-join on the keys), counted per segment."""
    orders = table(spark, sf, "orders")
    segs = C.cluster_segments(orders, ["o_orderstatus", "o_orderpriority"])
    members = C.assign_clusters(orders, segs, ["o_orderstatus", "o_orderpriority"])
    return members.groupBy("seg_o_orderstatus", "seg_o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("o_totalprice"), 6).alias("total_price"))


_BOXES = _GEO_SEG_SQL.replace("SELECT r.cell, 'country' AS term", ", seg AS (SELECT r.cell, 'country' AS term").rstrip() + ")"


@register("geo_members_box", _BOXES.replace("round(CASE", "(CASE").replace(" END, 6)", " END)") + f"""
SELECT cell AS seg_cell, value AS seg_value, count(*) AS n_docs, CAST(sum(id_num) AS BIGINT) AS ids
FROM seg JOIN {POSTS_SQL} p ON p.country = seg.value AND lat BETWEEN bottom_right_lat AND top_left_lat AND lon BETWEEN top_left_lon AND bottom_right_lon
GROUP BY 1, 2""")
def geo_members_box(spark: SparkSession, sf: str) -> DataFrame:
    """J6 by box: the posts inside each segment's widened box, neighbours of another cell included."""
    p = posts(spark, sf)
    segments = C.geo_cluster_segments(p, ["country"], precision=5)
    members = C.assign_geo_clusters(p, segments, ["country"], 5, "box")
    return members.groupBy("seg_cell", "seg_value").agg(F.count("*").alias("n_docs"), F.sum("id_num").alias("ids"))


_TAGGED = f"""d AS (SELECT id_num, lat, lon, CASE WHEN user_id % 7 <> 0 THEN country END AS kind, CASE WHEN id_num % 11 <> 0 THEN
  list_filter([country, 'u' || (user_id % 3), CASE WHEN id_num % 2 = 0 THEN 'even' END, country], lambda x: x IS NOT NULL) END AS tags FROM {POSTS_SQL} p)"""


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    p = posts(spark, sf)
    tags = F.array("country", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")), F.when(F.col("id_num") % 2 == 0, "even"), "country")
    return p.select("id_num", "location", F.when(F.col("user_id") % 7 != 0, F.col("country")).alias("kind"),
                    F.when(F.col("id_num") % 11 != 0, F.filter(tags, lambda x: x.isNotNull())).alias("tags"))


@register("segments_tags", f"""WITH {_TAGGED},
l1 AS (SELECT kind, count(*) AS n FROM d WHERE kind IS NOT NULL GROUP BY 1 ORDER BY n DESC, kind LIMIT 3),
l2 AS (SELECT kind, tag AS tags, count(*) AS doc_count FROM (SELECT kind, unnest(list_distinct(tags)) AS tag FROM d) WHERE kind IN (SELECT kind FROM l1) GROUP BY 1, 2),
r2 AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_count DESC, tags) AS rn FROM l2)
SELECT kind, tags, doc_count FROM r2 WHERE rn <= 3 AND doc_count >= 5""")
def segments_tags(spark: SparkSession, sf: str) -> DataFrame:
    """A7 with nulls and an array: kind (null for some) > tags (null or repeated for some), the top three of each."""
    return C.cluster_segments(_tagged(spark, sf), ["kind", "tags"], size=3)


@register("geo_segments_tags", f"""WITH {_TAGGED},
p AS (SELECT *, {geohash_sql('lat', 'lon', 3)} AS cell FROM d),
f AS (SELECT cell, 'tags' AS term, unnest(list_distinct(tags)) AS value FROM p UNION ALL SELECT cell, 'kind', kind FROM p WHERE kind IS NOT NULL),
g AS (SELECT cell, term, value, count(*) AS doc_count FROM f GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY cell, term ORDER BY doc_count DESC, value) AS rn FROM g)
SELECT cell, term, value, doc_count FROM r WHERE rn <= 10 AND doc_count >= 5""")
def geo_segments_tags(spark: SparkSession, sf: str) -> DataFrame:
    """A8 with nulls and an array: geohash-3 cells by tags and by kind."""
    return C.geo_cluster_segments(_tagged(spark, sf), ["tags", "kind"], precision=3).select("cell", "term", "value", "doc_count")


@register("split_lists_parts", f"""WITH c AS ({categorize_sql("part", ["p_brand", "p_type"], "p_partkey", "p_name")})
SELECT CASE WHEN representative THEN 'representative' ELSE 'other' END AS list, p_brand, p_type, p_partkey,
       row_number() OVER (PARTITION BY representative, p_brand, p_type ORDER BY rank_key DESC, p_partkey) AS position FROM c""")
def split_lists_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The two lists of each cluster as they are ordered, with the place of each part in its list."""
    lists = C.split_lists(C.categorize(table(spark, sf, "part"), ["p_brand", "p_type"], "p_partkey", "p_name"), ["p_brand", "p_type"], "p_partkey")
    rows = [d.select(F.lit(name).alias("list"), "p_brand", "p_type", "p_partkey", F.monotonically_increasing_id().alias("at")) for name, d in zip(("representative", "other"), lists)]
    w = Window.partitionBy("list", "p_brand", "p_type").orderBy("at")
    return rows[0].unionByName(rows[1]).withColumn("position", F.row_number().over(w)).drop("at")


@register("mean_points_country", f"SELECT country, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM {POSTS_SQL} p GROUP BY 1, 2")
def mean_points_country(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of the coordinate lists of each country and day."""
    p = posts(spark, sf).groupBy("country", F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")).agg(
        F.collect_list(F.array("location.lon", "location.lat")).alias("points"))
    mean = mean_point("points")
    return p.select("country", "day", F.round(mean["lat"], R).alias("lat"), F.round(mean["lon"], R).alias("lon"))
