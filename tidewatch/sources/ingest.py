"""Sources and sinks: JSON bulk load, archive scan, raw-record gate, GeoJSON export,
schema conformance (S1-S3, S8, S12, S14)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema
from tidewatch.functions.timerange import ts_literal
from tidewatch.sources.json_array import json_elements


def load_json(spark: SparkSession, path: str, start: int = 0, n: int | None = None,
              json_lines: bool = False, order_col: str | None = None, array: Column | None = None) -> DataFrame:
    """Records [start, start+n) of a JSON file as a `raw` JSON-text column plus `pos`.

    By default a file is one JSON array, which several tasks read split by split; positions count
    per file. `array`, a value made from the path in column `file`, tells which files are parts of one
    large array: positions then run on through them in name order. With `json_lines=True` it is JSON Lines; a slice then needs an explicit `order_col`
    inside the records.
    """
    if n is not None and n <= 0:
        raise ValueError("n must be positive")
    if json_lines:
        lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
        v = F.try_parse_json("value")
        if order_col is None:
            if start or n is not None:
                raise ValueError("slicing JSON Lines needs order_col")
            return lines.select(F.col("value").alias("raw"))
        pos = F.variant_get(v, f"$.{order_col}", "bigint")
        out = lines.select(pos.alias("pos"), F.col("value").alias("raw"))
    else:
        out = json_elements(spark, path)
        if array is not None:
            counts = out.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # one row a file
            before = Window.partitionBy(array).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
            counts = counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
            out = out.join(F.broadcast(counts), "file").withColumn("pos", F.col("pos") + F.col("before"))
        out = out.select("pos", F.to_json(F.parse_json("value")).alias("raw"))
    out = out.filter(F.col("pos") >= start)
    if n is not None:
        out = out.filter(F.col("pos") < start + n)
    return out


# Fixed value: archive columns projected by the scan.
ARCHIVE_COLUMNS = ("tweetid", "created_at", "ttype", "annotations", "geotags", "lang", "latlong", "mordecai_raw", "tweet")


def month_buckets(ts_from: datetime, ts_to: datetime | None) -> list[str]:
    """'yyyy-MM' buckets covering [from, to] (all months in range, not only the first)."""
    end = ts_to or ts_from
    out, y, m = [], ts_from.year, ts_from.month
    while (y, m) <= (end.year, end.month):
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def scan_archive(df: DataFrame, ts_from: datetime, ts_to: datetime | None = None, collection: int | None = None,
                 limit: int | None = None, ts: str = "created_at", bucket: str = "monthbucket",
                 collection_col: str = "collectionid", columns=None) -> DataFrame:
    """Month-bucket pruning + `ts >= from` (and `< to`) + collection equality + optional limit.

    On a Parquet archive partitioned by `bucket`, the bucket IN-list prunes directories and
    the time range is pushed into the reader. When `ts_to` is None all months from that of
    `ts_from` on are scanned.
    """
    ntz = dict(df.dtypes).get(ts) == "timestamp_ntz"
    months = (F.col(bucket).isin(month_buckets(ts_from, ts_to)) if ts_to is not None
              else F.col(bucket) >= f"{ts_from:%Y-%m}")
    pred = months & (F.col(ts) >= ts_literal(ts_from, ntz))
    if ts_to is not None:
        pred = pred & (F.col(ts) < ts_literal(ts_to, ntz))
    if collection is not None:
        pred = pred & (F.col(collection_col) == F.lit(collection))
    out = df.filter(pred)
    if columns:
        out = out.select(*[c for c in columns if c in out.columns])
    return out.limit(limit) if limit else out


def gate_raw(df: DataFrame, body: str = "tweet", annotations: str = "annotations", latlong: str = "latlong") -> DataFrame:
    """S3: drop rows whose JSON body does not parse, or with NULL annotations or lat/long;
    the body is replaced by its parsed (variant) form."""
    parsed = F.try_parse_json(F.col(body))
    return df.withColumn(body, parsed).filter(
        F.col(body).isNotNull() & F.col(annotations).isNotNull() & F.col(latlong).isNotNull())


def conform(df: DataFrame, target: T.StructType = schema.POST_SCHEMA) -> DataFrame:
    """Exactly the target's columns, cast to their types; missing columns are NULL,
    unknown columns dropped."""
    cols = []
    for f in target.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StructType)
                        else F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


# Fixed value: columns never exported as feature properties.
GEOJSON_EXCLUDE = ("location", "latlong", "geotags", "annotations", "tweet", "tweetid")


def to_geojson(df: DataFrame, id_col: str = "tweetid", location: str = "location") -> DataFrame:
    """One GeoJSON Feature (JSON text) per row: Point [lon, lat]; properties = every
    column plus `id`, minus location/latlong/geotags/annotations/tweet/tweetid. NULL properties
    are written as null, so all features of a layer have the same keys; a row without a
    location has a null geometry."""
    props = [F.col(c) for c in df.columns if c not in GEOJSON_EXCLUDE]
    lat, lon = F.col(f"{location}.lat"), F.col(f"{location}.lon")
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.when(lat.isNotNull() & lon.isNotNull(), point).alias("geometry"),
        F.struct(*props, F.col(id_col).alias("id")).alias("properties"),
    )
    return df.select(F.col(id_col), F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_json_list(items: DataFrame, json_col: str, order: list[Column], path: str, head: str = "[", foot: str = "]") -> None:
    """Write JSON texts as text files which, joined in name order, are one JSON document: `head`,
    the items in `order`, `foot`. Every item but the first starts with a comma; the first is
    found by an aggregate and the order by a range-partitioned sort, so no task holds the list."""
    keys = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    rows = items.select(*keys, F.col(json_col).alias("value"))
    rows = rows.groupBy(*names, "value").agg(F.count(F.lit(1)).alias("_n"))  # equal items differ by their number only
    first = F.struct(*names, "value")
    rows = rows.withColumn("_first", first.eqNullSafe(rows.agg(F.min(first)).scalar()))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    lines = rows.select(F.lit(1).alias("_part"), *names, "_k", F.when(F.col("_first") & (F.col("_k") == 1), F.col("value"))
                        .otherwise(F.concat(F.lit(","), F.col("value"))).alias("value"))
    ends = items.sparkSession.createDataFrame([(0, head), (2, foot)], "_part int, value string")
    lines = lines.unionByName(ends, allowMissingColumns=True)
    lines.orderBy("_part", *names, "value", "_k").select("value").write.mode("overwrite").text(path)


# Fixed value: the head of a feature collection.
GEOJSON_HEAD = '{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "features": ['


def write_geojson(df: DataFrame, path: str, id_col: str = "tweetid", location: str = "location") -> None:
    """S12 as files: joined in name order they are one valid FeatureCollection, ordered by id."""
    write_json_list(to_geojson(df, id_col, location), "feature", [F.col(id_col)], path, GEOJSON_HEAD, "]}")


def ensure_variant(c) -> Column:
    """JSON text -> variant (NULL when it does not parse)."""
    return F.try_parse_json(F.col(c) if isinstance(c, str) else c)
