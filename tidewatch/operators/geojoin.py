"""Spatial and place joins.

J1 (point -> first containing polygon) is an equi-join on the leaves of a quadtree cover of the
layer (`operators.cover`): every point has one leaf, and the ray-casting test runs on the few edges that
matter there. No broadcast of the layer is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.geodesic import distances_m
from tidewatch.operators.cover import MAX_EDGES, MAX_POLYGONS, cell_of, contains, quadtree_cover


def country_of(points: DataFrame, countries: DataFrame, lat: str = "location.lat", lon: str = "location.lon",
               key: str = "tweetid", out: str = "country", max_polygons: int = MAX_POLYGONS, max_edges: int = MAX_EDGES) -> DataFrame:
    """Each point gets the name of the first polygon (smallest fid) containing it, else NULL.
    Rows are kept one by one, repeated keys included; the points are joined once, on their leaf of the
    layer's cover (one probe row a level that has leaves). Points without a location match nothing.

    countries(fid, name, iso2, rings array<array<struct<lon, lat>>>).
    """
    cover, levels = quadtree_cover(countries.select("fid", "name", "rings"), max_polygons, max_edges)
    la, lo = F.col(lat), F.col(lon)
    located = la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo)
    x, y = cell_of(la, lo, levels[-1])  # a cell of a coarser level holds the finest ones whose numbers begin like its own
    probes = [F.struct(F.lit(n).alias("lv"), F.shiftright(x, levels[-1] - n).alias("cx"), F.shiftright(y, levels[-1] - n).alias("cy")) for n in levels]
    pts = points.withColumn("_at", F.when(F.coalesce(located, F.lit(False)), F.array(*probes)))
    pts = pts.where("_at is not null").withColumn("_at", F.explode("_at"))
    inside = F.filter("_parts", lambda g: contains(g, la, lo))
    cover = cover.select(F.col("lv").alias("_lv"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("parts").alias("_parts"))
    joined = pts.join(cover, (F.col("_at.lv") == F.col("_lv")) & (F.col("_at.cx") == F.col("_cx")) & (F.col("_at.cy") == F.col("_cy")))
    found = joined.select(*points.columns, F.get(inside, F.lit(0))["name"].alias(out))
    rest = points.where(~F.coalesce(located, F.lit(False))).select("*", F.lit(None).cast("string").alias(out))
    return found.unionByName(rest)


def place_key(c) -> Column:
    """Normalized place key for gazetteer joins: trimmed, lower-cased, inner spaces collapsed."""
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(F.trim(col), r"\s+", " "))


def geocode(df: DataFrame, gazetteer: DataFrame, place: str = "place", out: str = "geo") -> DataFrame:
    """Place string -> struct(lat, lon) from a gazetteer(place, lat, lon); a miss gives NULL.

    Distinct place keys are looked up once and joined back (one row per gazetteer key:
    when the gazetteer repeats a key, its smallest coordinates win).
    """
    gz = gazetteer.select(place_key("place").alias("_pk"), F.struct("lat", "lon").alias("_g")) \
        .groupBy("_pk").agg(F.min("_g").alias(out))
    return df.withColumn("_pk", place_key(place)).join(gz, "_pk", "left").drop("_pk")


def nearest_candidate(df: DataFrame, candidates: str, ref: str, key: str = "tweetid", max_m: float = 20_460_000.0) -> DataFrame:
    """Among candidates array<struct<place, lat, lon>>, the nearest to `ref` (struct
    lat/lon) strictly within max_m on the ellipsoid, first on ties; with no ref, the first candidate.

    Works in-row: candidates of one record are a bounded array, so no shuffle is needed.
    """
    cand, r = F.col(candidates), F.col(ref)
    df = df.withColumn("_metres", distances_m(F.transform(cand, lambda c: F.struct(c["lat"].alias("lat"), c["lon"].alias("lon"))), r["lat"], r["lon"]))
    scored = F.transform(cand, lambda c, i: F.struct(F.get("_metres", i).alias("d"), i.alias("i"), c.alias("c")))
    best = F.array_min(F.filter(scored, lambda s: s["d"] < F.lit(max_m)))  # struct order: distance, then position
    pick = F.when(r.isNull(), F.element_at(cand, 1)).otherwise(best["c"])
    return df.withColumn("nearest", F.when(F.size(cand) > 0, pick)).drop("_metres")


def country_names(countries: DataFrame) -> DataFrame:
    """All names in layer order with their position."""
    return countries.select("fid", "name").orderBy("fid")


def filter_layer(countries: DataFrame, predicate: Column) -> DataFrame:
    """Keep features satisfying a predicate, all attributes preserved."""
    return countries.filter(predicate)


def load_countries(spark, path: str) -> DataFrame:
    """A GeoJSON FeatureCollection (properties NAME, ISO2; Polygon or MultiPolygon)
    -> countries(fid, name, iso2, rings). A MultiPolygon's parts become one ring list.

    Parsed as VARIANT with typed casts (schema inference would turn the mixed nesting
    depths of Polygon / MultiPolygon coordinates into strings). The file is read split by split; a
    feature is an element of the collection's list whose type says so, numbered in file order.
    """
    from tidewatch.sources.json_array import json_elements

    f = F.col("f")
    feats = json_elements(spark, path, level=2).select("file", "pos", F.try_parse_json("value").alias("f")) \
        .where(F.try_variant_get(f, "$.type", "string") == "Feature")
    first = feats.groupBy("file").agg(F.min("pos").alias("first"))
    feats = feats.join(first, "file").withColumn("fid", F.col("pos") - F.col("first"))
    gtype = F.try_variant_get(f, "$.geometry.type", "string")
    poly = F.try_variant_get(f, "$.geometry.coordinates", "array<array<array<double>>>")
    multi = F.try_variant_get(f, "$.geometry.coordinates", "array<array<array<array<double>>>>")
    rings = F.when(gtype == "MultiPolygon", F.flatten(multi)).otherwise(poly)
    rings = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return feats.select(F.col("fid").cast("int").alias("fid"),
                        F.try_variant_get(f, "$.properties.NAME", "string").alias("name"),
                        F.try_variant_get(f, "$.properties.ISO2", "string").alias("iso2"), rings.alias("rings"))


def countries_from_nations(nation: DataFrame) -> DataFrame:
    """A synthetic country layer from the nation table: nation k is a 36 x 24 degree
    rectangle on a 10-column grid (k mod 10, k div 10); every fifth nation is instead a
    larger 60 x 40 rectangle with an 8 x 8 hole, overlapping its neighbours, so first-match
    and holes are exercised."""
    k = F.col("n_nationkey")
    lon0 = (k % 10) * 36 - 180
    lat0 = F.floor(k / 10) * 24 - 60

    def rect(lo, la, w, h):
        return F.array(
            F.struct(lo.cast("double").alias("lon"), la.cast("double").alias("lat")),
            F.struct((lo + w).cast("double").alias("lon"), la.cast("double").alias("lat")),
            F.struct((lo + w).cast("double").alias("lon"), (la + h).cast("double").alias("lat")),
            F.struct(lo.cast("double").alias("lon"), (la + h).cast("double").alias("lat")),
        )

    outer = rect(lon0, lat0, F.lit(36), F.lit(24))
    big = rect(lon0 - 18, lat0 - 12, F.lit(60), F.lit(40))
    hole = rect(lon0 - 8, lat0 - 4, F.lit(8), F.lit(8))
    rings = F.when(k % 5 == 0, F.array(big, hole)).otherwise(F.array(outer))
    return nation.select(k.cast("int").alias("fid"), F.col("n_name").alias("name"),
                         F.concat(F.lit("N"), k.cast("string")).alias("iso2"), rings.alias("rings"))


def region_of(points: DataFrame, regions: DataFrame, **kw) -> DataFrame:
    """Region assignment is the same first-match polygon join with a region layer."""
    return country_of(points, regions, out="region", **kw)


# What separates words when matching place names (anything but letters,
# marks, digits, '_', and '.'/apostrophes inside a word).
_WORDCH = r"\p{L}\p{M}\p{N}_"


def match_key(c) -> Column:
    """Text normalized for place matching: lower-case words separated by single spaces
    (punctuation and whitespace runs -> one space; '.' and apostrophes kept inside words)."""
    col = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(F.lower(col), F.lit(f"[^{_WORDCH}.'\u2019]+"), F.lit(" "))
    t = F.regexp_replace(t, F.lit(f"(?<![{_WORDCH}])[.'\u2019]+|[.'\u2019]+(?![{_WORDCH}])"), F.lit(" "))
    return F.trim(F.regexp_replace(t, F.lit(" {2,}"), F.lit(" ")))


def place_trie(gazetteer: DataFrame) -> DataFrame:
    """The gazetteer(place, lat, lon) as prefix rows (start, names): names by their first two words (a one-word
    name by its word), each as (words, name, place, lat, lon). Names that are equal once normalized are one, with the smallest
    place and coordinates."""
    gz = gazetteer.select(match_key("place").alias("name"), F.struct("place", "lat", "lon").alias("g")).where("name <> ''") \
        .groupBy("name").agg(F.min("g").alias("g"))
    words = F.split("name", " ")
    return gz.select(F.substring_index("name", " ", 2).alias("start"), F.struct(
        F.size(words).alias("words"), "name", "g.place", "g.lat", "g.lon").alias("entry")).groupBy("start").agg(F.collect_list("entry").alias("names"))


def text_places(df: DataFrame, gazetteer: DataFrame, key: str, text: str = "text") -> DataFrame:
    """X14 (re-aimed): place names mentioned in the text -> (key, places array<struct<pos,
    place, lat, lon>>) in text order, for keys with a place.

    Names may have any number of words. Every word of a text probes the trie with itself and the next word; of a start that
    exists only its position leaves the probe, and the names under it are compared with the text's words, the longest first. A
    match inside a longer match is dropped (longest match wins). Rows that repeat a key with one text count once.
    """
    norm = df.select(F.col(key).alias("_k"), match_key(F.col(text)).alias("_t")).where("_t <> ''")
    # one pattern gives each word with its successor, overlapping, code-generated
    probe = norm.select("_k", F.xxhash64("_t").alias("_h"), F.posexplode(F.regexp_extract_all("_t", F.lit("(?:^| )(?=([^ ]+(?: [^ ]+)?))"), 1)).alias("pos", "two"))
    probe = probe.select("_k", "_h", "pos", F.explode(F.array_distinct(F.array("two", F.substring_index("two", " ", 1)))).alias("start"))
    trie = place_trie(gazetteer)
    starts = probe.join(trie.select("start"), "start", "left_semi").groupBy("_k", "_h").agg(F.collect_set(F.struct("pos", "start")).alias("at"))
    texts = norm.withColumn("_h", F.xxhash64("_t")).join(starts, ["_k", "_h"]).dropDuplicates(["_k", "_h"])
    texts = texts.select("_k", "_h", F.split("_t", " ").alias("_w"), F.explode("at").alias("a")).select("_k", "_h", "_w", "a.pos", "a.start")
    named = texts.join(trie, "start")
    fits = F.filter("names", lambda n: F.array_join(F.slice("_w", F.col("pos") + 1, n["words"]), " ") == n["name"])
    best = named.withColumn("m", F.array_max(fits)).where("m is not null")  # struct order: most words
    best = best.groupBy("_k", "_h", "pos").agg(F.max("m").alias("m"))  # of the word alone and the pair
    before = Window.partitionBy("_k", "_h").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("end", F.col("pos") + F.col("m.words")).withColumn("reach", F.max("end").over(before))
    best = best.where("reach is null or reach < end")  # not inside an earlier match
    per = best.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("pos", "m.place", "m.lat", "m.lon"))).alias("places"))
    return per.select(F.col("_k").alias(key), "places")
