"""Geo joins, keyed writes, the normalizer on a raw nested post, ingest sources."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators import geojoin as GJ
from tidewatch.operators import keyed as K


def sq(lon0, lat0, w, h):
    lon0, lat0, w, h = float(lon0), float(lat0), float(w), float(h)
    return [{"lon": lon0, "lat": lat0}, {"lon": lon0 + w, "lat": lat0}, {"lon": lon0 + w, "lat": lat0 + h}, {"lon": lon0, "lat": lat0 + h}]


def test_point_in_polygon_first_match_and_holes(spark):
    layer = spark.createDataFrame([
        (0, "A", "AA", [sq(0, 0, 10, 10), sq(4, 4, 2, 2)]),   # square with a hole
        (1, "B", "BB", [sq(5, 5, 10, 10)]),                  # overlaps A (A wins where both)
    ], "fid int, name string, iso2 string, rings array<array<struct<lon:double,lat:double>>>")
    pts = spark.createDataFrame([("p1", 1.0, 1.0), ("p2", 5.0, 5.0), ("p3", 8.0, 8.0), ("p4", 12.0, 12.0),
                                 ("p5", 50.0, 50.0)], "tweetid string, lat double, lon double")
    pts = pts.select("tweetid", F.struct("lat", "lon").alias("location"))
    got = {r["tweetid"]: r["country"] for r in GJ.country_of(pts, layer).collect()}
    assert got == {"p1": "A", "p2": "B", "p3": "A", "p4": "B", "p5": None}


def test_geocode_and_nearest(spark):
    gz = spark.createDataFrame([("Mercedes, TX", 26.1, -97.9), ("Iowa", 42.0, -93.5)], "place string, lat double, lon double")
    df = spark.createDataFrame([("1", "  mercedes,   tx "), ("2", "Nowhere")], "tweetid string, place string")
    got = {r["tweetid"]: r["geo"] for r in GJ.geocode(df, gz).collect()}
    assert got["1"]["lat"] == 26.1 and got["2"] is None
    c = spark.createDataFrame([("1", [("far", 0.0, 0.0), ("near", 42.0, -93.0), ("near2", 42.0, -93.0)], (42.0, -93.5)),
                               ("2", [("first", 1.0, 1.0), ("second", 2.0, 2.0)], None)],
                              "tweetid string, c array<struct<place:string,lat:double,lon:double>>, r struct<lat:double,lon:double>")
    got = {r["tweetid"]: r["nearest"]["place"] for r in GJ.nearest_candidate(c, "c", "r").collect()}
    assert got == {"1": "near", "2": "first"}


def test_keyed_writes(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k long, s string, v double")
    upd = spark.createDataFrame([(2, "B1", 20.0, 1), (2, "B2", 21.0, 2), (4, "d", 4.0, 1)], "k long, s string, v double, ver int")
    merged, outcomes = K.upsert(base, upd.select("k", "s", "v", "ver"), "k", order_col="ver")
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a", 1.0), (2, "B2", 21.0), (3, "c", 3.0), (4, "d", 4.0)]
    assert sorted(tuple(r) for r in outcomes.collect()) == [(2, "updated"), (4, "created")]
    ids = spark.createDataFrame([(1,), (9,)], "k long")
    assert sorted(r["k"] for r in K.delete_by_id(base, ids, "k").collect()) == [2, 3]
    assert [r["k"] for r in K.lookup(base, ids, "k").collect()] == [1]
    patch = spark.createDataFrame([(3, None), (7, 70.0)], "k long, v double")
    got = sorted(tuple(r) for r in K.update_fields(base, patch, "k").collect())
    assert got == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", None)]
    flags = spark.createDataFrame([(1, False), (1, True), (2, False)], "k long, representative boolean")
    got = {r["k"]: r["representative"] for r in K.mark_flag(base, flags, "k").collect()}
    assert got == {1: True, 2: False, 3: None}


RAW = {
    "tweetid": "1007091004389359616",
    "created_at": "2018-06-14T02:45:30",
    "annotations": {"flood_probability": ["yes", 0.91]},
    "lang": "es",
    "tweet": {
        "id": 1007091004389359616, "id_str": "1007091004389359616",
        "created_at": "Thu Jun 14 02:45:30 +0000 2018", "timestamp_ms": "1528944330252",
        "text": "La lluvia de esta tarde es muy fuerte en el puerto y las calles están con agua #Bud",
        "lang": "es",
        "user": {"id": 7, "name": "Meteo", "location": "Los Cabos", "followers_count": 10},
        "coordinates": None,
        "place": {"name": "Los Cabos", "full_name": "Los Cabos, Baja California Sur", "country": "México",
                  "bounding_box": {"type": "Polygon", "coordinates": [[[-110.0, 22.8], [-109.4, 22.8], [-109.4, 23.6], [-110.0, 23.6]]]}},
        "entities": {"hashtags": [{"text": "Bud", "indices": [68, 72]}], "urls": []},
        "extended_entities": {"media": [{"media_url": "http://pbs.example/a.jpg", "media_url_https": "https://pbs.example/a.jpg"},
                                        {"media_url": "http://pbs.example/a.jpg", "media_url_https": "https://pbs.example/a.jpg"}]},
    },
}


def test_normalize_raw_post(spark):
    from tidewatch.operators.normalize import normalize

    bad = {"tweet": {"id": 1, "text": "x"}}
    df = spark.createDataFrame([(json.dumps(RAW),), (json.dumps(bad),), ("{not json",)], "raw string")
    ok, rej = normalize(df, now=datetime(2024, 1, 1))
    r = ok.first()
    assert r["tweetid"] == "1007091004389359616"
    assert r["created_at"] == datetime(2018, 6, 14, 2, 45, 30, 252000)  # envelope date is not ISO -> millis
    assert abs(r["location"]["lat"] - 23.2) < 1e-9 and abs(r["location"]["lon"] + 109.7) < 1e-9
    assert r["flood_probability"] == 0.91
    assert r["lang"] == "es" and r["country"] is None and r["place"] == "Los Cabos"
    assert "Bud" in r["tokens"] and sorted(r["media_urls"]) == ["http://pbs.example/a.jpg", "https://pbs.example/a.jpg"]
    assert sorted(x["reason"] for x in rej.collect()) == ["missing annotations", "unparsable record"]


def rec(i, text="The creek is over the road", **kw):
    return {"id": i, "text": text, "lang": "en", "created_at": "2024-01-02T03:04:05",
            "annotations": {"flood_probability": 0.5}, **kw}


def test_normalizer_reads_the_merged_record(spark):
    from tidewatch.operators.normalize import normalize

    env = rec(1, text="wet\\n#lluvia here", entities={"hashtags": [{"text": "one", "indices": [0, 1]}, {"text": "two", "indices": [2, 3]}]})
    env.pop("annotations")
    lines = [
        # outer author kept, envelope without one; both entity tags; a tag after a line break
        json.dumps({"annotations": {"flood_probability": 0.25}, "user": {"id": 7, "name": "outer"}, "tweet": env}).replace("\\\\n", "\\n"),
        # envelope (a JSON string) overrides the outer probability; an escaped accent in a tag, & in a URL
        json.dumps({"annotations": {"flood_probability": 0.25}, "tweet": json.dumps(
            rec(2, text="Es #Inundaci\u00f3n!", annotations={"flood_probability": ["yes", 0.75]},
                media=[{"media_url": "http://m.example/?a=1&b=2"}]))}),
        json.dumps(rec(3, country="Elsewhere", coordinates={"coordinates": [1.0, 1.0]})),
        json.dumps(rec(4, entities={"hashtags": [{"text": "bare"}]}, user=None, place=None)),
    ]
    layer = spark.createDataFrame([(0, "A", "AA", [sq(0, 0, 10, 10)])],
                                  "fid int, name string, iso2 string, rings array<array<struct<lon:double,lat:double>>>")
    ok, rej = normalize(spark.createDataFrame([(x,) for x in lines], "raw string"), countries=layer, now=datetime(2024, 1, 1), detect=False)
    got = {r["tweetid"]: r for r in ok.collect()}
    assert rej.count() == 0 and sorted(got) == ["1", "2", "3", "4"]
    assert (got["1"]["user_id"], got["1"]["user_name"], got["1"]["flood_probability"]) == (7, "outer", 0.25)
    assert {"one", "two", "lluvia"} <= set(got["1"]["tokens"])
    assert got["2"]["flood_probability"] == 0.75 and "Inundaci\u00f3n" in got["2"]["tokens"]
    assert got["2"]["media_urls"] == ["http://m.example/?a=1&b=2"]
    assert got["3"]["country"] == "Elsewhere"
    assert "bare" in got["4"]["tokens"]


def test_renormalize_changes_nothing(spark):
    from tidewatch.operators.normalize import normalize, renormalize

    gz = spark.createDataFrame([("Los Cabos", 23.0, -110.0)], "place string, lat double, lon double")
    lines = [json.dumps(RAW), json.dumps(rec(5, user={"id": 9, "name": "n", "location": "Los Cabos", "followers_count": 3}, representative=True)),
             json.dumps(rec(6, coordinates={"coordinates": [2.0, 3.0]}, entities={"media": [{"media_url": "http://m.example/1"}]}))]
    first, _ = normalize(spark.createDataFrame([(x,) for x in lines], "raw string"), gz, now=datetime(2024, 1, 1))
    again, rej = renormalize(first, gz, now=datetime(2025, 1, 1))
    by_id = lambda df: sorted(map(str, df.collect()))
    assert by_id(again) == by_id(first) and len(by_id(first)) == 3 and rej.count() == 0


def test_renormalize_plans_do_not_hold_the_first_normalization(spark, monkeypatch):
    from tidewatch.operators import normalize as N

    gz = spark.createDataFrame([("Los Cabos", 23.0, -110.0)], "place string, lat double, lon double")
    layer = spark.createDataFrame([(0, "A", "AA", [sq(0, 0, 10, 10)])],
                                  "fid int, name string, iso2 string, rings array<array<struct<lon:double,lat:double>>>")
    lines = [json.dumps(rec(5, user={"id": 9, "name": "n", "location": "Los Cabos"})), json.dumps(rec(6, coordinates={"coordinates": [2.0, 3.0]})),
             json.dumps(rec(7))]
    sizes, write = [], N.written
    monkeypatch.setattr(N, "written", lambda df, name: sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    first, _ = N.normalize(spark.createDataFrame([(x,) for x in lines], "raw string"), gz, layer, now=datetime(2024, 1, 1))
    again, _ = N.renormalize(first, gz, layer, now=datetime(2025, 1, 1))
    sizes.append(len(again._jdf.queryExecution().optimizedPlan().toString()))
    assert max(sizes) < 200_000, sizes
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(again) == rows(first) and {r["tweetid"]: r["country"] for r in again.collect()} == {"5": None, "6": "A", "7": None}
    table, _ = N.renormalize(write(first, "posts"), gz, layer, stored=True, now=datetime(2025, 1, 1))
    assert rows(table) == rows(first)


def test_country_of_repeated_keys_and_missing_points(spark):
    layer = spark.createDataFrame([(0, "S", "SS", [sq(0, -10, 10, 10)]), (1, "T", "TT", [sq(0, 1, 10, 10)])],
                                  "fid int, name string, iso2 string, rings array<array<struct<lon:double,lat:double>>>")
    pts = spark.createDataFrame([("k", -5.0, 5.0), ("k", 5.0, 5.0), ("k", None, None)], "tweetid string, lat double, lon double")
    got = GJ.country_of(pts.select("tweetid", F.struct("lat", "lon").alias("location")), layer)
    assert sorted((str(r["location"]["lat"]), r["country"]) for r in got.collect()) == [("-5.0", "S"), ("5.0", "T"), ("None", None)]


def test_load_json_slice(spark, tmp_path):
    from tidewatch.sources.ingest import load_json

    p = tmp_path / "posts.json"
    p.write_text(json.dumps([{"id": i} for i in range(10)]))
    got = [json.loads(r["raw"])["id"] for r in load_json(spark, str(p), start=3, n=4).orderBy("pos").collect()]
    assert got == [3, 4, 5, 6]


def test_scan_archive_months(spark):
    from tidewatch.sources.ingest import month_buckets, scan_archive

    assert month_buckets(datetime(2018, 11, 5), datetime(2019, 2, 1)) == ["2018-11", "2018-12", "2019-01", "2019-02"]
    df = spark.createDataFrame([("1", datetime(2018, 11, 30), "2018-11", 1), ("2", datetime(2018, 12, 2), "2018-12", 1),
                                ("3", datetime(2018, 12, 3), "2018-12", 2)],
                               "tweetid string, created_at timestamp, monthbucket string, collectionid int")
    assert [r["tweetid"] for r in scan_archive(df, datetime(2018, 12, 1), collection=1).collect()] == ["2"]
    assert sorted(r["tweetid"] for r in scan_archive(df, datetime(2018, 11, 1), collection=1).collect()) == ["1", "2"]
    got = sorted(r["tweetid"] for r in scan_archive(df, datetime(2018, 11, 1), datetime(2018, 12, 31), collection=1).collect())
    assert got == ["1", "2"]
