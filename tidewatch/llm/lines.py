"""Boilerplate lines by site-relative frequency.

A line's ratio on a host is the number of the host's pages that hold it over the number of the host's
pages. Lines above the ratio are dropped. Pages are reduced to distinct line hashes and pre-counted
before the shuffle, so a host with a third of all pages is counted in every task. A host has at most
(lines per page / ratio) such lines: its list is bounded whatever the host's size, and joins the
pages as one small row per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import Scratch

RATIO, LEAST_PAGES = 0.05, 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                      least_pages: int = LEAST_PAGES, count_copies: bool = True) -> DataFrame:
    """(host, line hash, pages, host_pages) of the lines above the ratio; blank lines never count.

    Unless ``count_copies``, pages of one host and text are one page in both counts.
    """
    site = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")
    page = F.xxhash64(text).alias("page")
    rows = pages.select(site, *([] if count_copies else [page]),
                        F.explode(F.array_distinct(F.transform(
                            F.filter(_lines(text), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))).alias("line"))
    each = pages.select(site)
    if not count_copies:
        rows, each = rows.distinct(), pages.select(site, page).distinct()
    total = each.groupBy("host").agg(F.count("*").alias("host_pages"))
    n = rows.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    return n.join(total, "host").where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                     least_pages: int = LEAST_PAGES, count_copies: bool = True, leave_empty: bool = True) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, and a column ``lines_dropped``.

    A line goes if at least ``least_pages`` pages of its host and more than ``ratio`` of them hold it;
    all its occurrences go. A line on a page twice counts once; repeated rows count each, or once per
    text unless ``count_copies``. Null hosts are one host with the empty one; null texts stay null, empty
    texts empty, blank lines stay; a page left without lines keeps an empty text, or all its lines
    unless ``leave_empty``. All columns of ``pages`` are kept; an input column of the
    name lines_dropped is replaced. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "lines")
    by_host = scratch.write(boilerplate_lines(pages, host, text, ratio, least_pages, count_copies).groupBy("host").agg(
        F.sort_array(F.collect_list("line")).alias("_boiler"))).df.withColumnRenamed("host", "_host")
    cols = [c for c in pages.columns if c != "lines_dropped"]
    joined = pages.join(by_host, F.coalesce(pages[host].cast("string"), F.lit("")) == F.col("_host"), "left")
    all_lines = _lines(text)
    kept = F.filter(all_lines, lambda x: ~F.array_contains(F.col("_boiler"), F.xxhash64(x)))
    hit = F.col("_boiler").isNotNull() & F.col(text).isNotNull()
    if not leave_empty:
        kept = F.when(F.exists(kept, lambda x: F.trim(x) != ""), kept).otherwise(all_lines)
    out = joined.withColumn("_kept", F.when(hit, kept))
    return out.select(*[F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col(c)).alias(c)
                        if c == text else F.col(c) for c in cols],
                      F.coalesce(F.size(_lines(text)) - F.size("_kept"), F.lit(0)).cast("long").alias("lines_dropped"))
