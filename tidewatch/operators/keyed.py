"""Keyed writes as joins.

A table here is any DataFrame keyed by a column; "writing" returns the new version
lazily (persist it by writing a new version directory, never over the one being read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(updates: DataFrame, key: str, order_col) -> DataFrame:
    """Last write wins - one row per key, the one with the largest `order_col`
    (a column name or a list of names compared in order, for a total order on ties).

    `max_by` over a struct is a partial (map-side) aggregation, so a key with many
    versions is reduced before the shuffle.
    """
    cols = [c for c in updates.columns if c != key]
    order = F.struct(*[F.col(c) for c in ([order_col] if isinstance(order_col, str) else order_col)])
    latest = updates.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    return latest.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert(base: DataFrame, updates: DataFrame, key: str, order_col=None) -> tuple[DataFrame, DataFrame]:
    """Whole-row replace-or-insert by key -> (merged, outcomes(key, outcome)).

    outcome is 'updated' when the key existed, else 'created'. Updates are de-duplicated
    first (W3) when `order_col` is given.
    """
    if order_col:
        updates = latest_per_key(updates, key, order_col)
    updates = updates.select(*base.columns)
    merged = base.join(updates.select(key), key, "left_anti").unionByName(updates)
    existed = base.select(key).withColumn("_e", F.lit(True))
    outcomes = updates.select(key).join(existed, key, "left").select(
        key, F.when(F.col("_e"), F.lit("updated")).otherwise(F.lit("created")).alias("outcome"))
    return merged, outcomes


def delete_by_id(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Remove keyed rows (anti join)."""
    return base.join(ids.select(key), key, "left_anti")


def update_fields(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Merge the patch's columns into existing rows; other columns unchanged; keys
    not in base are ignored. A patch value of NULL sets NULL (presence is per row). Of several
    patch rows for one key the largest (by its values in column order, NULLs lowest) wins."""
    pcols = [c for c in patch.columns if c != key and c in base.columns]
    if len(pcols) == 1:  # the largest value of one column is a plain aggregate
        one = patch.groupBy(key).agg(F.max(pcols[0]).alias(pcols[0]))
    else:
        one = latest_per_key(patch.select(key, *pcols), key, pcols) if pcols else patch.select(key).distinct()
    p = one.select(key, *[F.col(c).alias(f"_p_{c}") for c in pcols], F.lit(True).alias("_hit"))
    j = base.join(p, key, "left")
    out = [F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in pcols else F.col(c)
           for c in base.columns]
    return j.select(*out)


def lookup(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among `ids` (semi join)."""
    return base.join(ids.select(key), key, "left_semi")


def mark_flag(base: DataFrame, flags: DataFrame, key: str, flag: str = "representative") -> DataFrame:
    """Write a boolean flag back by key; a key flagged several times takes the OR;
    rows without a flag keep their previous value."""
    f = flags.groupBy(key).agg(F.bool_or(F.col(flag)).alias("_f"))
    j = base.join(f, key, "left")
    prev = F.col(flag) if flag in base.columns else F.lit(None).cast("boolean")
    cols = [c for c in base.columns if c != flag]
    return j.select(*cols, F.coalesce(F.col("_f"), prev).alias(flag))
