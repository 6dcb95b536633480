"""Post queries on the ten fixture posts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.timerange import MalformedValueError
from tidewatch.operators import aggs as A
from tidewatch.plans.query import InvalidSortError, QuerySpec, run_query

NOW = datetime(2018, 6, 25, 12, 0)


def ids(df):
    return [r["tweetid"] for r in df.collect()]


def test_default_order(fixture_posts):
    rows, aggs = run_query(fixture_posts, QuerySpec.from_params({}))
    assert ids(rows) == ["17", "14", "18", "19", "15", "13", "11", "10", "12", "16"]
    assert aggs == {}


def test_order_by_probability(fixture_posts):
    asc = [0.418, 0.505, 0.801, 0.865, 0.876, 0.881, 0.945, 0.988, 0.991, 0.999]
    rows, _ = run_query(fixture_posts, QuerySpec.from_params({"order_by": "flood_probability"}))
    assert [r["flood_probability"] for r in rows.collect()] == asc
    rows, _ = run_query(fixture_posts, QuerySpec.from_params({"order_by": "-flood_probability"}))
    assert [r["flood_probability"] for r in rows.collect()] == asc[::-1]
    with pytest.raises(InvalidSortError):
        QuerySpec.from_params({"order_by": "text"})


def test_search(fixture_posts):
    rows, _ = run_query(fixture_posts, QuerySpec.from_params({"search": "suitable living", "order_by": "-flood_probability"}))
    got = rows.collect()
    assert sorted(r["tweetid"] for r in got) == ["13", "15", "19"]
    scores = [r["score"] for r in got]
    assert scores == sorted(scores, reverse=True)
    rows, _ = run_query(fixture_posts, QuerySpec.from_params({"search": "texas home", "representative": "true"}))
    got = rows.collect()
    assert sorted(r["tweetid"] for r in got) == ["13", "14"]
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def test_time_filter(fixture_posts):
    rows, _ = run_query(fixture_posts, QuerySpec.from_params({"created_at": "2018-06-24|now"}, now=NOW))
    assert sorted(ids(rows)) == ["14", "17"]
    with pytest.raises(MalformedValueError):
        run_query(fixture_posts, QuerySpec.from_params({"created_at": "now"}, now=NOW))


def test_time_histograms(fixture_posts):
    h = A.time_histogram(fixture_posts, "10m").collect()
    assert len(h) == 181 and sum(r["doc_count"] for r in h) == 10
    h = A.time_histogram(fixture_posts, "1h").collect()
    assert len(h) == 31 and sum(r["doc_count"] for r in h) == 10
    _, aggs = run_query(fixture_posts, QuerySpec.from_params(
        {"created_at": "2018-06-24|now", "agg_timestamp": "1", "agg_timestamp__interval": "1h", "size": "0"}, now=NOW))
    h = aggs["agg_timestamp"].collect()
    assert [r["key"] for r in h] == [datetime(2018, 6, 24, 10), datetime(2018, 6, 24, 11)]
    assert sum(r["doc_count"] for r in h) == 2


def test_size_zero(fixture_posts):
    rows, aggs = run_query(fixture_posts, QuerySpec.from_params({"size": "0", "agg_floodprob": "1"}))
    assert rows is None and set(aggs) == {"agg_floodprob"}
    rows, aggs = run_query(fixture_posts, QuerySpec.from_params({"size": "0"}))
    assert rows is None and aggs == {}


def test_probability_histograms(fixture_posts):
    h = A.probability_histogram(fixture_posts, "10m").collect()
    assert len(h) == 181
    assert all((r["doc_count"] > 0) == (r["avg_flood_probability"] is not None) for r in h)
    assert len(A.probability_histogram(fixture_posts, "12h").collect()) == 3
    _, aggs = run_query(fixture_posts, QuerySpec.from_params(
        {"created_at__lt": "2018-06-24", "agg_floodprob": "1", "agg_floodprob__interval": "12h", "size": "0"}))
    assert len(aggs["agg_floodprob"].collect()) == 2


def test_hotspots(fixture_posts):
    box = {"top_left_lat": "27", "top_left_lon": "-99", "bottom_right_lat": "26", "bottom_right_lon": "-97"}
    _, aggs = run_query(fixture_posts, QuerySpec.from_params({**box, "size": "0"}))
    cells = A.hotspots(run_query(fixture_posts, QuerySpec.from_params(box))[0], precision=5, min_entries=2).collect()
    assert [(c["key"], c["doc_count"]) for c in cells] == [("9udku", 2)]
    cells = A.hotspots(fixture_posts, precision=2, min_entries=2).collect()
    assert [(c["key"], c["doc_count"]) for c in cells] == [("9u", 4), ("9z", 3)]
    rows, _ = run_query(fixture_posts, QuerySpec.from_params({"search": "extensive damage", "size": "100"}))
    cells = A.hotspots(rows, precision=2, min_entries=2).collect()
    assert len(cells) == 1


def test_geohash_values(fixture_posts):
    from tidewatch.functions.geo import geohash

    got = {r["tweetid"]: r["g"] for r in fixture_posts.select("tweetid", geohash(F.col("location.lat"), F.col("location.lon"), 5).alias("g")).collect()}
    assert got == {"10": "dnq82", "11": "9zhnh", "12": "9ze3y", "13": "9udke", "14": "9udkg", "15": "9udku",
                   "16": "gcw2j", "17": "kekh0", "18": "9zmwb", "19": "9udku"}


def test_terms_and_bounds(fixture_posts):
    t = A.terms_agg(fixture_posts, "country").collect()
    assert [(r["key"], r["doc_count"]) for r in t] == [("USA", 8), ("SA", 1), ("UK", 1)]
    tok = A.terms_agg(fixture_posts, "tokens", size=3).collect()
    assert tok[0]["doc_count"] >= tok[-1]["doc_count"]


def test_whitelists_and_size(fixture_posts):
    from tidewatch import schema
    from tidewatch.operators.filters import InvalidFilterError, build_filter

    cols = dict(fixture_posts.dtypes)
    assert build_filter({"lang": "en", "unknown_field": "x"}, cols, allowed=schema.FILTERABLE) is not None
    with pytest.raises(InvalidFilterError):
        build_filter({"text__contains": "flood"}, cols, allowed=schema.FILTERABLE)
    with pytest.raises(InvalidFilterError):
        build_filter({"flood_probability__lt": "0.5"}, cols, allowed=schema.FILTERABLE)
    assert QuerySpec.from_params({"size": "100000"}).size == 100000
    rows, _ = run_query(fixture_posts, QuerySpec.from_params({"flood_probability__gte": "0.9", "lang": "en"},
                                                             allowed_filters=schema.FILTERABLE))
    assert sorted(ids(rows)) == ["10", "11", "12", "14"]
