"""User-level flows: categorize a list (C2), categorize by clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import cluster as C


def categorize_list(rows: DataFrame, id_col: str = "tweetid", text_col: str = "text") -> DataFrame:
    """The rows of a query, categorized as one cluster."""
    return C.categorize(rows, [], id_col, text_col)


def categorize_clusters(df: DataFrame, terms: list[str], id_col: str = "tweetid", text_col: str = "text",
                        interval: str = schema.CLUSTER_INTERVAL, precision: int = schema.CLUSTER_PRECISION,
                        time_field: str = "created_at",
                        min_entries: int = schema.MIN_ENTRIES, membership: str = "cell") -> DataFrame:
    """With `location` among the terms: geohash cells x each other term (A8); else
    nested terms (A7). Then the docs of every segment (J6) and C1 inside each segment."""
    if "location" in terms:
        others = [t for t in terms if t != "location"]
        segs = C.geo_cluster_segments(df, others, precision=precision, min_entries=min_entries)
        members = C.assign_geo_clusters(df, segs, others, precision, membership)
        keys = ["seg_cell", "seg_term", "seg_value"] if others else ["seg_cell"]
    else:
        segs = C.cluster_segments(df, terms, interval=interval, time_field=time_field, min_entries=min_entries)
        members = C.assign_clusters(df, segs, terms, interval=interval, time_field=time_field)
        keys = [f"seg_{t}" for t in terms]
    return C.categorize(members, keys, id_col, text_col)
