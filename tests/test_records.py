"""Record shaping (P3, P4, P8, P10, X17) and the writers."""

import json
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import records as RC


def test_flatten_and_project(spark):
    df = spark.createDataFrame([(1, (2, (3, "x")), (1.0, 2.0))],
                               "id int, a struct<b:int,c:struct<d:int,e:string>>, location struct<lat:double,lon:double>")
    out = RC.flatten_struct(df)
    assert out.columns == ["id", "a_b", "a_c_d", "a_c_e", "location"]
    v = spark.createDataFrame([('{"user": {"name": "n", "id": 5}, "text": "t"}',)], "raw string").select(F.parse_json("raw").alias("v"))
    r = RC.project_paths(v, "v", ["text:string", "user/name:string"], extra=["user/id:bigint", "nope:string"]).first()
    assert (r["text"], r["user_name"], r["user_id"], r["nope"]) == ("t", "n", 5, None)


def test_merge_nested_and_pairs(spark):
    dt = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("s", T.StructType([
        T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))])
    df = spark.createDataFrame([((1, (1, 2)), (None, (None, 9))), ((1, (1, 2)), (7, (None, None)))],
                               T.StructType([T.StructField("b", dt), T.StructField("o", dt)]))
    got = [r["m"] for r in df.select(RC.merge_nested(F.col("b"), F.col("o"), dt).alias("m")).collect()]
    assert got[0]["a"] == 1 and (got[0]["s"]["x"], got[0]["s"]["y"]) == (1, 9)
    assert got[1]["a"] == 7 and (got[1]["s"]["x"], got[1]["s"]["y"]) == (None, None)  # empty mapping replaces
    recs = spark.createDataFrame([([("k1", "a"), ("k2", "b"), ("k1", "c")],)], "r array<struct<key:string,val:string>>")
    assert recs.select(RC.pairs_to_map(F.col("r"), "key", "val").alias("m")).first()["m"] == {"k1": "c", "k2": "b"}


def test_zones(spark):
    df = spark.createDataFrame([("2018-06-24 12:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    r = df.select(RC.to_zone(F.col("ts"), "Japan").alias("jp"), RC.from_zone(F.col("ts"), "America/Lima").alias("utc")).first()
    assert r["jp"] == datetime(2018, 6, 24, 21, 0) and r["utc"] == datetime(2018, 6, 24, 17, 0)


def test_load_countries_geojson(spark, tmp_path):
    from tidewatch.operators.geojoin import country_of, load_countries

    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NAME": "Square", "ISO2": "SQ"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]}},
        {"type": "Feature", "properties": {"NAME": "Islands", "ISO2": "IS"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[20, 20], [21, 20], [21, 21], [20, 20]]],
                                                               [[[30, 30], [32, 30], [32, 32], [30, 32], [30, 30]]]]}},
    ]}
    p = tmp_path / "c.geojson"
    p.write_text(json.dumps(fc))
    layer = load_countries(spark, str(p))
    assert [r["name"] for r in layer.orderBy("fid").collect()] == ["Square", "Islands"]
    pts = spark.createDataFrame([("a", (5.0, 5.0)), ("b", (31.0, 31.0)), ("c", (50.0, 50.0))],
                                "tweetid string, location struct<lat:double,lon:double>")
    got = {r["tweetid"]: r["country"] for r in country_of(pts, layer).collect()}
    assert got == {"a": "Square", "b": "Islands", "c": None}


def test_writers(spark, tmp_path):
    from tidewatch.operators.graph import write_graph
    from tidewatch.sources.ingest import write_geojson

    def joined(path):
        return "".join(f.read_text() for f in sorted(path.glob("part-*")))

    posts = spark.createDataFrame([("1", (1.5, 2.5), "hi", None), ("2", None, None, None), ("2", None, None, None), ("3", (0.0, 1.0), "a\nb", "x")],
                                  "tweetid string, location struct<lat:double,lon:double>, text string, tweet string")
    write_geojson(posts.repartition(3), str(tmp_path / "gj"))
    doc = json.loads(joined(tmp_path / "gj"))
    assert doc["type"] == "FeatureCollection" and doc["crs"]["properties"]["name"] == "EPSG:4326"
    feats = doc["features"]
    assert [f["properties"]["id"] for f in feats] == ["1", "2", "2", "3"] and all(f["type"] == "Feature" for f in feats)
    assert feats[0]["geometry"] == {"type": "Point", "coordinates": [2.5, 1.5]} and feats[1]["geometry"] is None
    assert [f["properties"]["text"] for f in feats] == ["hi", None, None, "a\nb"]
    write_geojson(posts.limit(0), str(tmp_path / "none"))
    assert json.loads(joined(tmp_path / "none"))["features"] == []
    edges = spark.createDataFrame([(1, "flood", "rain", 5), (1, "flood", "river", 9), (2, "river", "bank", 3)],
                                  "level int, parent string, name string, size long")
    write_graph(edges, str(tmp_path / "g"))
    assert json.loads(joined(tmp_path / "g")) == [
        {"name": "river", "size": 9, "children": [{"name": "bank", "size": 3}]}, {"name": "rain", "size": 5, "children": []}]
