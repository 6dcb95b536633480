"""Approximate aggregates as mergeable sketches, one row per micro-batch and event-time window.

A micro-batch leaves a distinct-count sketch (HyperLogLog), a quantile sketch (KLL) and a frequent-items sketch for
each window it touches, of a size that does not depend on its rows. Readers merge the sketches of a window; the result is
the same whatever the order of the micro-batches, as far as the sketches' error bounds go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.streaming.jobs import event_time

#: log2 of the registers of a distinct-count sketch: a relative standard error of about 1.04 / sqrt(2**LG) = 0.8 %.
LG_REGISTERS = 14
#: Counters of a frequent-items sketch: an item's count is off by at most about the rows / (0.75 * COUNTERS / 3.5).
COUNTERS = 1024


def sketch_partials(posts: DataFrame, distinct: str = "user_id", measure: str = "flood_probability", item: str = "country",
                    interval: str = "1 day", ts: str = "created_at") -> DataFrame:
    """(key, n, distinct, quantiles, items) per window of a part of the posts; nulls are in no sketch."""
    return posts.groupBy(F.window(event_time(posts, ts), interval).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(distinct).cast("string"), LG_REGISTERS).alias("distinct"),
        F.kll_sketch_agg_double(F.col(measure).cast("double")).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(`{item}`, {COUNTERS})").alias("items")).select(F.col("w.start").alias("key"), "n", "distinct", "quantiles", "items")


def merge_sketches(partials: DataFrame) -> DataFrame:
    """The sketches of each window as one."""
    return partials.groupBy("key").agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
                                       F.expr(f"approx_top_k_combine(items, {COUNTERS})").alias("items"))


def estimates(sketches: DataFrame, top: int = 5, ranks=(0.5, 0.9)) -> DataFrame:
    """(key, n, n_distinct, quantile_<rank> ..., top array<struct<item, count>>) of merged sketches."""
    return sketches.select("key", "n", F.hll_sketch_estimate("distinct").alias("n_distinct"),
                           *[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(r))).alias(f"quantile_{round(100 * r)}") for r in ranks],
                           F.expr(f"approx_top_k_estimate(items, {int(top)})").alias("top"))
