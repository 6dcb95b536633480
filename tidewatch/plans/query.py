"""Q1: a post query - search, filters, ordering, size and aggregations over one filtered plan.

`QuerySpec.from_params` validates request-style parameters on the driver (whitelists,
ordering names, intervals); `run_query` turns them into lazy DataFrames. Rows and each
aggregation are separate DataFrames over the same filtered plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import aggs as A
from tidewatch.operators.filters import build_filter


class InvalidSortError(ValueError):
    pass


@dataclass
class QuerySpec:
    filters: dict = field(default_factory=dict)
    search: str | None = None
    order_by: list[str] = field(default_factory=list)
    size: int = schema.PAGE_SIZE
    offset: int = 0
    aggregations: dict = field(default_factory=dict)
    tz: str | None = None
    now: datetime | None = None
    allowed_filters: dict | None = None
    orderable: tuple[str, ...] = schema.ORDERABLE
    search_fields: tuple[str, ...] = schema.SEARCH_FIELDS

    @classmethod
    def from_params(cls, params: dict, **kw) -> "QuerySpec":
        """Split request parameters into filters / search / order_by / size / aggregations."""
        p = dict(params)
        search = p.pop("search", None)
        order = p.pop("order_by", [])
        order = [order] if isinstance(order, str) else list(order)
        size = int(p.pop("size", schema.PAGE_SIZE))
        offset = int(p.pop("offset", 0))
        aggs: dict = {}
        if "agg_timestamp" in p:
            p.pop("agg_timestamp")
            aggs["agg_timestamp"] = {"interval": p.pop("agg_timestamp__interval", schema.HISTOGRAM_INTERVAL)}
        if "agg_floodprob" in p:
            p.pop("agg_floodprob")
            aggs["agg_floodprob"] = {"interval": p.pop("agg_floodprob__interval", schema.HISTOGRAM_INTERVAL)}
        if "agg_hotspot" in p:
            p.pop("agg_hotspot")
            aggs["agg_hotspot"] = {
                "precision": int(p.pop("agg_hotspot__precision", schema.HOTSPOT_PRECISION)),
                "size": int(p.pop("agg_hotspot__size")) if "agg_hotspot__size" in p else None,
            }
        for k in [k for k in p if k.startswith("agg_")]:
            p.pop(k)
        spec = cls(filters=p, search=search, order_by=order, size=size, offset=offset, aggregations=aggs, **kw)
        spec.validate()
        return spec

    def validate(self) -> None:
        for name in self.order_by:
            bare = name[1:] if name.startswith("-") else name
            if bare not in self.orderable:
                raise InvalidSortError(f"The '{bare}' field does not allow ordering.")
        for agg in self.aggregations.values():
            if "interval" in agg:
                A.parse_interval(agg["interval"])
            if "precision" in agg and not 1 <= agg["precision"] <= 12:
                raise ValueError("precision must be within 1..12")

    def sort_columns(self, id_col: str = "tweetid"):
        """L1-L3: relevance only when searching; else the given order plus created_at desc,
        plus an id tie-break so pages are deterministic."""
        if self.search:
            return [F.desc("score"), F.asc(id_col)]
        cols, names = [], []
        for name in self.order_by:
            desc = name.startswith("-")
            bare = name[1:] if desc else name
            names.append(bare)
            cols.append(F.desc(bare) if desc else F.asc(bare))
        if "created_at" not in names:
            cols.append(F.desc("created_at"))
        cols.append(F.asc(id_col))
        return cols


def filtered(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """unscored filters AND-ed, then (if searching) scored search as a must clause."""
    pred = build_filter(spec.filters, dict(df.dtypes), tz=spec.tz, now=spec.now, allowed=spec.allowed_filters)
    if spec.search:
        from tidewatch.operators.search import search as bm25

        # relevance statistics are corpus-wide; the filters only select rows
        return bm25(df, spec.search, [f for f in spec.search_fields if f in df.columns], where=pred)
    out = df if pred is None else df.filter(pred)
    return out.withColumn("score", F.lit(0.0))  # P12: score = relevance or 0


def run_query(df: DataFrame, spec: QuerySpec, id_col: str = "tweetid") -> tuple[DataFrame | None, dict[str, DataFrame]]:
    """-> (rows or None when size == 0, {aggregation name: DataFrame}).

    Aggregations ignore size and ordering (they see the whole filtered set).
    """
    base = filtered(df, spec)
    rows = None
    if spec.size > 0:
        ordered = base.orderBy(*spec.sort_columns(id_col))
        rows = ordered.offset(spec.offset).limit(spec.size) if spec.offset else ordered.limit(spec.size)
    out: dict[str, DataFrame] = {}
    for name, conf in spec.aggregations.items():
        if name == "agg_timestamp":
            out[name] = A.time_histogram(base, conf["interval"])
        elif name == "agg_floodprob":
            out[name] = A.probability_histogram(base, conf["interval"])
        elif name == "agg_hotspot":
            out[name] = A.hotspots(base, precision=conf["precision"], size=conf["size"])
    return rows, out


def result_count(df: DataFrame) -> DataFrame:
    """Total count as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("total_count"))
