"""Lookup names on text, numbers and arrays; histograms without a limit on buckets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import aggs as A
from tidewatch.operators import filters as FL

ROWS = [(1, "Alpha", 2.5, 10, ["a", "b"], True), (2, "beta", 0.0, 7, ["b"], False), (3, None, None, None, None, None), (4, "x" * 300, 3.0, 17, [], True)]
# field, lookup, request value, ids that match
CASES = [
    ("name", "exact", "beta", {2}), ("name", "exact", "x" * 300, {4}), ("name", "iexact", "ALPHA", {1}), ("name", "ne", "beta", {1, 4}), ("name", "not", "beta", {1, 4}),
    ("name", "contains", "et", {2}), ("name", "icontains", "ALP", {1}), ("name", "startswith", "A", {1}), ("name", "istartswith", "B", {2}),
    ("name", "endswith", "a", {1, 2}), ("name", "iendswith", "PHA", {1}), ("name", "in", "beta,Alpha", {1, 2}), ("name", "nin", "beta", {1, 4}),
    ("name", "match", "^[a-b]", {2}), ("name", "exists", "true", {1, 2, 4}), ("name", "exists", "no", {3}), ("name", "gt", "b", {2, 4}),
    ("score", "exact", "2.5", {1}), ("score", "lt", "2.5", {2}), ("score", "lte", "2.5", {1, 2}), ("score", "gt", "2.5", {4}), ("score", "gte", "2.5", {1, 4}),
    ("score", "in", "0,3", {2, 4}), ("score", "nin", "0,3", {1}), ("score", "exists", "1", {1, 2, 4}), ("score", "mod", "2,1", {4}), ("score", "startswith", "2.", {1}),
    ("n", "mod", "10,7", {2, 4}), ("n", "in", "7,10", {1, 2}), ("n", "nin", [7], {1, 4}), ("n", "exists", "false", {3}), ("n", "ne", "7", {1, 4}), ("n", "endswith", "7", {2, 4}),
    ("tags", "exact", "b", {1, 2}), ("tags", "ne", "a", {2, 4}), ("tags", "in", "a,z", {1}), ("tags", "nin", "a,z", {2, 4}), ("tags", "all", "a,b", {1}),
    ("tags", "size", "0", {4}), ("tags", "contains", "b", {1, 2}), ("tags", "exists", "true", {1, 2, 4}), ("flag", "exact", "true", {1, 4}), ("flag", "ne", "yes", {2}),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(ROWS, "id int, name string, score double, n bigint, tags array<string>, flag boolean")
    return df.withColumns({"created_at": F.current_timestamp(), "location": F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))})


def test_every_lookup_by_type(rows):
    types = dict(rows.dtypes)
    each = [F.array_sort(F.collect_list(F.when(FL.build_filter({f"{f}__{name}": value}, types), F.col("id")))) for f, name, value, _ in CASES]
    got = rows.agg(*[c.alias(str(i)) for i, c in enumerate(each)]).first()
    assert {c: set(g) for c, g in zip([c[:2] for c in CASES], got)} == {c[:2]: c[3] for c in CASES}
    assert {c[1] for c in CASES} == set(schema.LOOKUPS)


@pytest.mark.parametrize("field, lookup, value", [("n", "exact", "x"), ("score", "in", "1,b"), ("n", "mod", "0,1"), ("n", "mod", "5"), ("n", "exists", "maybe"),
                                                  ("tags", "size", "many"), ("flag", "exact", "perhaps")])
def test_values_that_do_not_fit_are_refused(rows, field, lookup, value):
    with pytest.raises(FL.InvalidFilterError):
        FL.build_filter({f"{field}__{lookup}": value}, dict(rows.dtypes))


def test_keyword_length_is_a_choice(rows):
    assert rows.where(FL.term("name", "x" * 300)).count() == 1
    assert rows.where(FL.term("name", "x" * 300, max_len=schema.KEYWORD_MAX_LEN)).count() == 0
    assert rows.where(FL.term("name", "beta", max_len=schema.KEYWORD_MAX_LEN)).count() == 1


def test_histogram_of_millions_of_buckets(spark):
    ends = [dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 5, 0, 1), dt.datetime(2024, 2, 20, 12, 30, 59)]
    df = spark.createDataFrame([(t, float(i)) for i, t in enumerate(ends)] + [(None, 1.0)], "created_at timestamp, flood_probability double")
    h = A.probability_histogram(df, "1s")
    n = int((ends[2] - ends[0]).total_seconds()) + 1
    got = h.agg(F.count("*"), F.count_distinct("key"), F.sum("doc_count"), F.min("key"), F.max("key"), F.count("avg_flood_probability")).first()
    assert tuple(got) == (n, n, 3, ends[0], ends[2], 3) and n > 4_000_000
    assert h.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("interval, n", [("w", 105), ("M", 25), ("q", 9), ("y", 3), ("1d", 732)])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_calendar_buckets_have_no_gaps(spark, interval, n, kind):
    df = spark.createDataFrame([("2023-01-31 10:00:00",), ("2025-01-31 23:59:59",)], "t string").select(F.col("t").cast(kind).alias("created_at"))
    rows = A.time_histogram(df, interval).collect()
    keys = [r["key"] for r in rows]
    assert len(rows) == n and keys == sorted(set(keys)) and sum(r["doc_count"] for r in rows) == 2
    days = spark.sql(f"select explode(sequence(cast('2023-01-31' as {kind}), cast('2025-01-31' as {kind}), interval 1 day)) as d")
    start = days.select(A.bucket_start(F.col("d"), interval, kind == "timestamp_ntz").alias("k"))
    assert {r["k"] for r in start.distinct().collect()} == set(keys)


def test_no_buckets_without_rows(spark):
    assert A.time_histogram(spark.createDataFrame([], "created_at timestamp"), "1h").collect() == []
