"""Quadtree cover, place trie and ellipsoidal distance: brute force and published values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.geodesic import distance_m, distances_m, geodesic_m
from tidewatch.operators import geojoin as GJ
from tidewatch.operators.cover import quadtree_cover

LAYER = "fid int, name string, rings array<array<struct<lon:double,lat:double>>>"


def star(rnd, lon, lat, size, n):
    angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [(lon + size * rnd.uniform(0.4, 1) * math.cos(a), lat + size * rnd.uniform(0.4, 1) * math.sin(a)) for a in angles]


def first_inside(polygons, lon, lat):
    """Even-odd test of every point against every polygon in layer order, with the same arithmetic."""
    out = np.full(len(lon), -1)
    for fid, rings in polygons:
        odd = np.zeros(len(lon), bool)
        for ring in rings:
            for (blon, blat), (alon, alat) in zip([ring[-1], *ring[:-1]], ring) if len(ring) > 2 else ():
                if alat != blat:
                    odd ^= ((alat > lat) != (blat > lat)) & (lon < (blon - alon) * (lat - alat) / (blat - alat) + alon)
        out[(out < 0) & odd] = fid
    return out


def polygons_of_a_layer(rnd, n):
    out = []
    for fid in range(n):
        lon, lat, size = rnd.uniform(-185, 185), rnd.uniform(-88, 88), rnd.choice([0.5, 2, 2, 8])
        rings = [star(rnd, lon, lat, size, rnd.choice([3, 5, 12, 40]))]
        if rnd.random() < 0.3:
            rings.append(star(rnd, lon, lat, size / 3, 6))
        out.append((fid, rings))
    out.append((n, [[(-180.0, -90.0), (180.0, -90.0), (180.0, 0.0), (-180.0, 0.0)]]))  # half the world, behind the others
    out.append((n + 1, [[(0.0, 0.0), (1.0, 1.0)]]))  # no ring of three points
    out.append((n + 2, [star(rnd, 10, 50, 9, n // 4)]))  # a long border
    return out


@pytest.mark.parametrize("n, max_polygons, max_edges", [(3_000, 16, 64), (60, 2, 6)])
def test_first_polygon_equals_brute_force(spark, n, max_polygons, max_edges):
    rnd = random.Random(n)
    layer = polygons_of_a_layer(rnd, n)
    df = spark.createDataFrame([(f, f"P{f}", [[{"lon": x, "lat": y} for x, y in r] for r in rings]) for f, rings in layer], LAYER).repartition(4)
    corners = [p for _, rings in layer[:40] for p in rings[0]]
    pts = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(2_500)] + corners + [(180.0, 90.0), (-180.0, -90.0), (181.5, 10.0), (0.0, 0.0)]
    pts += [(rnd.uniform(0, 20), rnd.uniform(41, 59)) for _ in range(700)]
    lon, lat = (np.array([p[k] for p in pts]) for k in (0, 1))
    want = {i: None if f < 0 else f"P{f}" for i, f in enumerate(first_inside(layer, lon, lat))}
    rows = [(i, {"lat": float(b), "lon": float(a)}, "clash") for i, (a, b) in enumerate(pts)] + [(-1, None, "x"), (-2, {"lat": None, "lon": 1.0}, "x"), (0, {"lat": float(lat[0]), "lon": float(lon[0])}, "again")]
    points = spark.createDataFrame(rows, "tweetid int, location struct<lat:double,lon:double>, parts string")
    got = GJ.country_of(points, df, max_polygons=max_polygons, max_edges=max_edges)
    assert got.columns == ["tweetid", "location", "parts", "country"]
    got = got.collect()
    assert len(got) == len(rows) and {r["tweetid"]: r["country"] for r in got if r["tweetid"] >= 0} == want
    assert all(r["country"] is None for r in got if r["tweetid"] < 0)
    cover, levels = quadtree_cover(df, max_polygons, max_edges)
    big = cover.where(F.size("parts") > 0).selectExpr("lv", "size(parts) AS n", "aggregate(parts, 0, (a, p) -> a + size(p.edges)) AS e").agg(
        F.max(F.when(F.col("lv") < 18, F.col("n"))).alias("n"), F.max(F.when(F.col("lv") < 18, F.col("e"))).alias("e")).first()
    assert big["n"] <= max_polygons and big["e"] <= max_edges and len(levels) > 2
    assert cover.selectExpr("sum(pow(4.0D, -lv))").first()[0] == 1.0  # the leaves are the world, each part once


def test_cover_of_an_empty_layer(spark):
    pts = spark.createDataFrame([("a", (1.0, 2.0)), ("b", None)], "tweetid string, location struct<lat:double,lon:double>")
    got = GJ.country_of(pts, spark.createDataFrame([], LAYER)).collect()
    assert sorted((r["tweetid"], r["country"]) for r in got) == [("a", None), ("b", None)]


def places_by_brute_force(text, names):
    words = text.split()
    hits = [(i, len(n.split()), n) for i in range(len(words)) for n in names if words[i:i + len(n.split())] == n.split()]
    return [(i, n) for i, k, n in sorted(hits) if not any(o[1] > k and o[0] <= i and o[0] + o[1] >= i + k for o in hits)]


def test_place_names_of_any_length(spark):
    rnd = random.Random(14)
    names = sorted({" ".join(rnd.choices("abcd", k=rnd.choice([1, 2, 2, 3, 4, 6, 9]))) for _ in range(60)} - {"a", "b"})
    names += ["saint mary of the far lakes", "saint mary"]
    texts = [" ".join(rnd.choices("abcde", k=rnd.randint(0, 60))) for _ in range(80)]
    texts += ["We drove from Saint  Mary of the Far Lakes, to saint MARY!", "saint mary of the far", "", None]
    gz = spark.createDataFrame([(n.title(), float(i), -float(i)) for i, n in enumerate(names)], "place string, lat double, lon double")
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "a repeated row")]
    got = {r["id"]: [(p["pos"], p["place"].lower()) for p in r["places"]] for r in
           GJ.text_places(spark.createDataFrame(rows, "id int, text string, start string"), gz, "id").collect()}
    clean = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower())
    want = {i: places_by_brute_force(clean(t), names) for i, t in enumerate(texts)}
    assert got == {i: p for i, p in want.items() if p}
    assert got[80] == [(3, "saint mary of the far lakes"), (10, "saint mary")] and got[81] == [(0, "saint mary")]


# Published lines: degrees and metres.
LINES = [
    (40.6, -73.8, 51.6, -0.5, 5551759.400),
    (-30.0, 0.0, 29.9, 179.8, 19989832.827610),  # nearly opposite
    (-30.12345, 0.0, -30.12344, 0.00005, 4.944208),
    (-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777, 54972.271),
    (0.0, 0.0, 0.5, 179.5, 19936288.579),
    (0.0, 0.0, 0.0, 180.0, 20003931.458625), (0.0, 0.0, 0.0, 1.0, 111319.490793), (0.0, 0.0, 90.0, 0.0, 10001965.729313),
    (90.0, 5.0, 90.0, 77.0, 0.0), (10.0, 20.0, 10.0, 20.0, 0.0),
]


def test_published_lines_to_a_millimetre(spark):
    for lat1, lon1, lat2, lon2, metres in LINES:
        for turned in ((lat1, lon1, lat2, lon2), (lat2, lon2, lat1, lon1), (-lat1, 170 - lon1, -lat2, 170 - lon2)):
            assert abs(float(geodesic_m(*turned)) - metres) < 1e-3, turned
    rows = [(*map(float, r),) for r in LINES] + [(None, 0.0, 0.0, 0.0, 0.0), (91.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, m double")
    got = df.select("m", distance_m("a", "b", "c", "d").alias("x")).collect()
    assert all(abs(r["x"] - r["m"]) < 1e-3 for r in got[:-2]) and got[-1]["x"] is got[-2]["x"] is None


def test_distance_is_a_metric():
    rng = np.random.default_rng(10)
    a, b, c = (np.stack([rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400)]) for _ in range(3))
    ab, ba, bc, ac = geodesic_m(*a, *b), geodesic_m(*b, *a), geodesic_m(*b, *c), geodesic_m(*a, *c)
    assert np.abs(ab - ba).max() < 1e-6 and (ac <= ab + bc + 1e-6).all() and ab.max() < 20003932
    near = geodesic_m(a[0] * 0.9, a[1], -a[0] * 0.9 + 1e-4, a[1] + 180 - 1e-4)
    assert np.isfinite(near).all() and (near > 19.9e6).all()


def test_distances_of_lists(spark):
    df = spark.createDataFrame([(1, [(0.0, 1.0), (None, 2.0), (0.0, 0.0)], 0.0, 0.0), (2, None, 0.0, 0.0), (3, [], 1.0, 1.0), (4, [(1.0, 1.0)], None, 1.0)],
                               "i int, p array<struct<lat:double,lon:double>>, lat double, lon double")
    got = {r["i"]: r["d"] for r in df.select("i", distances_m("p", "lat", "lon").alias("d")).collect()}
    assert abs(got[1][0] - 111319.490793) < 1e-3 and got[1][1] is None and got[1][2] == 0.0
    assert got[2] is None and got[3] == [] and got[4] == [None]
