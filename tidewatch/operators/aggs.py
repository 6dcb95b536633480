"""Aggregations over posts: gap-filled time histograms, hotspots, bounds, terms.

Every aggregation is a `groupBy` (partial aggregation before the shuffle, final after);
top-k uses `orderBy(...).limit(k)` which plans as TakeOrderedAndProject (no global sort).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions.geo import bounds_center, geohash

# Interval unit letters and their lengths in seconds (fixed units) or
# calendar truncation names (calendar units, which only allow a multiple of 1).
FIXED_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
CALENDAR_UNITS = {"w": "week", "M": "month", "q": "quarter", "y": "year"}
CALENDAR_STEP = {"week": ("DAY", 7), "month": ("MONTH", 1), "quarter": ("MONTH", 3), "year": ("MONTH", 12)}
#: Buckets made together when gaps are filled; the parts are dealt over all tasks.
BUCKET_PART = 4096


def parse_interval(interval: str) -> tuple[str, int | str]:
    """'10m' -> ('fixed', 600); '1M' -> ('calendar', 'month')."""
    m = re.fullmatch(r"\s*(\d*)\s*([smhdwMqy])\s*", interval)
    if not m:
        raise ValueError(f"bad interval: {interval!r}")
    n = int(m.group(1) or 1)
    unit = m.group(2)
    if unit in CALENDAR_UNITS:
        if n != 1:
            raise ValueError(f"calendar interval {unit!r} only supports a multiple of 1")
        return "calendar", CALENDAR_UNITS[unit]
    if n <= 0:
        raise ValueError("interval must be positive")
    return "fixed", n * FIXED_UNITS[unit]


_EPOCH_NTZ = "1970-01-01 00:00:00"


def _micros(ts: Column, ntz: bool) -> Column:
    """Microseconds since the epoch; for TIMESTAMP_NTZ without any session-zone shift."""
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), ts)
    return F.unix_micros(ts)


def _from_micros(us: Column, ntz: bool) -> Column:
    if ntz:
        return F.timestamp_add("MICROSECOND", us, F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))
    return F.timestamp_micros(us)


def bucket_start(ts: Column, interval: str, ntz: bool = False) -> Column:
    """Start of the epoch-aligned bucket holding `ts` (UTC for TIMESTAMP; wall-clock epoch
    for TIMESTAMP_NTZ, independent of the session zone); keeps the input type."""
    kind, size = parse_interval(interval)
    if kind == "calendar":
        return F.date_trunc(size, ts).cast("timestamp_ntz" if ntz else "timestamp")
    step = F.lit(int(size) * 1_000_000)
    us = _micros(ts, ntz)
    return _from_micros(us - F.pmod(us, step), ntz)


def bucket_range(span: DataFrame, interval: str, ntz: bool) -> DataFrame:
    """The starts `key` of all buckets between the ends of a one-row frame (lo, hi); none if they are null.

    Only the numbers of parts of BUCKET_PART buckets are listed in one row; the parts are spread, and each lists its own
    buckets, so there may be any number of them.
    """
    kind, size = parse_interval(interval)
    lo, hi = F.col("lo"), F.col("hi")
    if kind == "calendar":
        unit, step = CALENDAR_STEP[size]
        last = F.floor(F.timestamp_diff(unit, lo, hi) / F.lit(step))
    else:
        step = int(size) * 1_000_000
        last = F.floor((_micros(hi, ntz) - _micros(lo, ntz)) / F.lit(step))
    parts = span.where(lo.isNotNull()).select("lo", last.cast("long").alias("last"))
    parts = parts.select("lo", "last", F.explode(F.expr(f"sequence(0L, last div {BUCKET_PART})")).alias("part")).repartition("part")
    i = parts.select("lo", F.explode(F.expr(f"sequence(part * {BUCKET_PART}, least(last, part * {BUCKET_PART} + {BUCKET_PART - 1}))")).alias("i"))
    if kind == "calendar":
        return i.select(F.timestamp_add(unit, (F.col("i") * step).cast("int"), lo).alias("key"))
    return i.select(_from_micros(_micros(lo, ntz) + F.col("i") * F.lit(step), ntz).alias("key"))


def time_histogram(
    df: DataFrame,
    interval: str = schema.HISTOGRAM_INTERVAL,
    ts: str = "created_at",
    metric: str | None = None,
    gap_fill: bool = True,
) -> DataFrame:
    """A1 (and A2 with `metric`): count per bucket, ascending, empty buckets between the
    first and last non-empty bucket returned with 0 (and NULL mean).

    Output: key TIMESTAMP, doc_count BIGINT[, avg_<metric> DOUBLE].
    """
    ntz = dict(df.dtypes)[ts] == "timestamp_ntz"
    bucketed = df.filter(F.col(ts).isNotNull()).select(bucket_start(F.col(ts), interval, ntz).alias("key"), *([F.col(metric)] if metric else []))
    aggs = [F.count(F.lit(1)).alias("doc_count")]
    if metric:
        aggs.append(F.avg(metric).alias(f"avg_{metric}"))
    counts = bucketed.groupBy("key").agg(*aggs)
    if not gap_fill:
        return counts.orderBy("key")
    keys = bucket_range(counts.agg(F.min("key").alias("lo"), F.max("key").alias("hi")), interval, ntz)
    out = keys.join(counts, "key", "left").select(
        "key",
        F.coalesce(F.col("doc_count"), F.lit(0)).cast("bigint").alias("doc_count"),
        *([F.col(f"avg_{metric}")] if metric else []),
    )
    return out.orderBy("key")


def probability_histogram(df: DataFrame, interval: str = schema.HISTOGRAM_INTERVAL, ts: str = "created_at") -> DataFrame:
    """A2: A1 plus mean flood probability per bucket (NULL for empty buckets)."""
    return time_histogram(df, interval, ts, metric="flood_probability")


def geo_bounds_aggs(location: str = "location") -> list[Column]:
    """A4: top-left = (max lat, min lon), bottom-right = (min lat, max lon)."""
    return [
        F.max(f"{location}.lat").alias("top_left_lat"),
        F.min(f"{location}.lon").alias("top_left_lon"),
        F.min(f"{location}.lat").alias("bottom_right_lat"),
        F.max(f"{location}.lon").alias("bottom_right_lon"),
    ]


def hotspots(
    df: DataFrame,
    precision: int = schema.HOTSPOT_PRECISION,
    size: int | None = None,
    min_entries: int = schema.MIN_ENTRIES,
    location: str = "location",
) -> DataFrame:
    """A3: docs per geohash cell; cells with >= min_entries docs; biggest first, at most
    `size` of them if given; location = centre of the cell's doc bounds.

    Output: key, doc_count, lat, lon (centre).
    """
    cells = (
        df.filter(F.col(location).isNotNull())
        .select(geohash(F.col(f"{location}.lat"), F.col(f"{location}.lon"), precision).alias("key"), F.col(location))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("doc_count"), *geo_bounds_aggs(location))
    )
    centre = bounds_center("top_left_lat", "top_left_lon", "bottom_right_lat", "bottom_right_lon")
    cells = cells.filter(F.col("doc_count") >= F.lit(min_entries)).orderBy(F.desc("doc_count"), F.asc("key"))
    return (
        (cells if size is None else cells.limit(int(size)))
        .select("key", "doc_count", centre["lat"].alias("lat"), centre["lon"].alias("lon"))
    )


def terms_agg(df: DataFrame, column: str, size: int | None = schema.TERMS_SIZE) -> DataFrame:
    """Distinct value -> doc count, count desc then key asc, top `size`.

    Array columns count each distinct element once per doc.
    """
    dtype = dict(df.dtypes)[column]
    if dtype.startswith("array"):
        vals = df.select(F.explode(F.array_distinct(F.col(column))).alias("key"))
    else:
        vals = df.select(F.col(column).alias("key"))
    out = vals.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"))
    out = out.orderBy(F.desc("doc_count"), F.asc("key"))
    return out.limit(size) if size else out


def outcome_counts(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    """Created / updated / failed tallies."""
    return outcomes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_sorted(c) -> Column:
    """De-duplicated array in a deterministic (sorted) order."""
    return F.array_sort(F.array_distinct(c if isinstance(c, Column) else F.col(c)))


def ntz_to_instant(c: Column) -> Column:
    """TIMESTAMP_NTZ wall clock read as UTC -> TIMESTAMP, independent of the session zone."""
    return F.timestamp_micros(_micros(c, True))


def instant_to_ntz(c: Column) -> Column:
    """TIMESTAMP -> its UTC wall clock as TIMESTAMP_NTZ, independent of the session zone."""
    return _from_micros(F.unix_micros(c), True)
