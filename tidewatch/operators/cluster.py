"""Clustering and the representative split.

Representative split (per cluster, over the aggressively normalized text):
  sim(u, v)      = 2 * LCS / (len u + len v)
  multiplicity d = #{v : id v > id d and sim(d, v) > 0.8}, at least 1
  centrality d   = 2 * sum over all v in the cluster (d itself included) of sim(d, v),
                   forced to 0 when some v with a smaller id has sim(d, v) > 0.8
  representative = centrality > 0;  rank key = int(multiplicity) * int(centrality)

Plan for scale:
  * exact copies are collapsed first: *distinct* texts of a cluster are compared and weighted
    by copy counts. A text with its sorted ids is an item; one with more than `SLICE` copies
    is several items, its ids dealt out by their hash;
  * a cluster with k items is cut into ceil(k / block) hash blocks; each pair of blocks is
    one unit of work (two blocks of items, never more), so a hot cluster spreads over many
    tasks. A unit returns one row per item (similarity sum, smallest near id, and for each of
    its ids the number of larger near ids there) and never its pairs;
  * an id travels once per block of its cluster, so rows and bytes grow with the documents
    times the blocks, never with the pairs of near texts or of documents and near texts;
  * similarities are summed as integers (15 decimals), so totals (and the int() in the rank
    key) do not depend on shuffle order.
Centrality sums the similarity of every pair of distinct texts, so the comparisons of a
cluster grow with the square of its distinct texts; rows and memory do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewatch import schema
from tidewatch.functions.similarity import similarities
from tidewatch.functions.text import normalize_aggressive
from tidewatch.session import written

SCALE = 10 ** 15             # a similarity (<= 1) as an integer with 15 decimals
DEFAULT_BLOCK = 256          # items per block
SLICE = 2048                 # ids of an item
RADIX_BITS = 16              # bits of the id per level of the larger-id count
_NO_ID = (1 << 63) - 1


def _key(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def count_greater(queries: DataFrame, members: DataFrame, keys: list[str], id_col: str = "id",
                  bits: int = RADIX_BITS) -> DataFrame:
    """For each query row: number of member rows with the same `keys` and a larger id.

    queries(keys..., id) -> (keys..., id, n_greater). Level by level, ids are cut to their
    leading bits; members that share a query's leading bits but for the last `bits` of the
    level are counted by a window over at most 2**bits pre-aggregated rows.
    """
    q = queries.select(*keys, F.col(id_col).alias("id")).distinct()
    counts = members.select(*keys, F.col(id_col).alias("id")).groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("cnt"))

    def levels(df: DataFrame, *more: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("lvl"), F.shiftright("id", s).alias("b"))
                                   for s in range(0, 64, bits)])).alias("_l")
        return df.select(*keys, *more, each).select(*keys, *more, "_l.lvl", "_l.b")

    asked = levels(q, "id")
    rows = levels(counts, "cnt").unionByName(asked.withColumn("cnt", F.lit(0).cast("long")).drop("id"))
    rows = rows.groupBy(*keys, "lvl", "b").agg(F.sum("cnt").alias("cnt"))
    # above the last level there is only the sign
    rows = rows.withColumn("up", F.when(F.col("lvl") + bits < 64, F.shiftright("b", bits)).otherwise(F.lit(0)))
    w = Window.partitionBy(*keys, "lvl", "up").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    above = rows.select(*keys, "lvl", "b", F.coalesce(F.sum("cnt").over(w), F.lit(0)).alias("_n"))
    return asked.join(above, [*keys, "lvl", "b"]).groupBy(*keys, "id").agg(F.sum("_n").alias("n_greater"))


_UNIT = ("cid", "p", "q", "blk", "tid", "slice", "ntext", "minid", "ids")


def _unit_rows(cid, p, q, blk, tid, slice_, ntext, minid, ids, threshold: float) -> list[tuple]:
    """What one pair of blocks says: (tid, slice, s, dmin, ids, ng) rows, see `_compare`."""
    same = p[0] == q[0]
    a = np.flatnonzero(blk == p)
    b = a if same else np.flatnonzero(blk != p)
    if not len(a) or not len(b):
        return []
    sim = similarities(list(ntext[a]), list(ntext[b]))
    near = sim > threshold
    if slice_.any():  # items of one text
        near |= tid[a][:, None] == tid[b][None, :]
    if same:
        np.fill_diagonal(sim, 0.0)
        np.fill_diagonal(near, True)
    n = np.array([len(i) for i in ids], np.int64)
    out = []
    for x, y, m, close in ((a, b, sim, near),) if same else ((a, b, sim, near), (b, a, sim.T, near.T)):
        part, copies = np.rint(m * SCALE).astype(np.int64), n[y]
        if int(copies.max()) * len(y) >= 9000:  # the sums may leave 64 bits
            part, copies = part.astype(object), copies.astype(object)
        dmin = np.where(close, minid[y], _NO_ID).min(axis=1)
        others, owner = np.concatenate(ids[y]), np.repeat(np.arange(len(y)), n[y])
        order = np.argsort(others)
        others, owner = others[order], owner[order]
        for i, s, d, row in zip(x, (part @ copies).tolist(), dmin.tolist(), close):
            mine, found = np.unique(ids[i]), others[row[owner]]
            out.append((tid[i], slice_[i], str(s), d, mine, len(found) - np.searchsorted(found, mine, "right")))
    return out


def _compare(threshold: float):
    """Rows sorted by (cid, p, q) -> per item and unit: similarity sum to the unit's other items, smallest near id, and its
    distinct ids, each with the number of larger ids of near items."""
    cols = ["tid", "slice", "s", "dmin", "ids", "ng"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            c, p, q, *_ = arrays = [b[k].to_numpy() for k in _UNIT]
            at = [0, *(np.flatnonzero((c[1:] != c[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist()]
            out, size = [], 0
            for i, j in zip(at, at[1:]):
                new = _unit_rows(*[x[i:j] for x in arrays], threshold)
                out, size = out + new, size + sum(10 + len(r[4]) for r in new)
                if size > 200_000:
                    yield pd.DataFrame(out, columns=cols)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=cols)
            rest = b.iloc[at[-1]:]
        if rest is not None and len(rest):
            yield pd.DataFrame(_unit_rows(*[rest[k].to_numpy() for k in _UNIT], threshold), columns=cols)

    return run


def _compared(items: DataFrame, single_cluster: bool, threshold: float, block: int) -> DataFrame:
    """All pairs of blocks of each cluster, compared where they are brought together."""
    if single_cluster:  # its size is a scalar subquery (no join on a constant key)
        t = items.withColumn("k", items.agg(F.count(F.lit(1))).scalar())
    else:
        t = items.join(items.groupBy("cid").agg(F.count(F.lit(1)).alias("k")), "cid")
    t = t.withColumn("nb", F.ceil(F.col("k") / F.lit(block)).cast("int"))
    t = t.withColumn("blk", F.pmod(F.xxhash64("tid", "slice"), F.col("nb")).cast("int"))
    t = t.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    t = t.select("cid", F.least("blk", "o").alias("p"), F.greatest("blk", "o").alias("q"), "blk", "tid", "slice", "ntext", "minid", "ids")
    # a given number of partitions: the work is in the comparisons, so small ones must not be merged by size
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return t.repartition(parts, "cid", "p", "q").sortWithinPartitions("cid", "p", "q").mapInPandas(
        _compare(threshold), "tid binary, slice int, s string, dmin long, ids array<long>, ng array<long>")


def integral_id(id_col: str) -> Column:
    """The id as a number, NULL when it is none."""
    return F.col(id_col).cast("string").try_cast("bigint")


def categorize_rejects(df: DataFrame, id_col: str = "tweetid") -> DataFrame:
    """The rows `categorize` cannot place: their id is not an integral number."""
    return df.filter(integral_id(id_col).isNull())


def categorize(
    df: DataFrame,
    cluster_cols=(),
    id_col: str = "tweetid",
    text_col: str = "text",
    threshold: float = schema.SIMILARITY_THRESHOLD,
    normalize: bool = True,
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Representative / non-representative split inside each cluster.

    Returns one row per input doc: cluster cols, id, text, multiplicity, centrality,
    representative, rank_key. Order a cluster's lists by (rank_key desc, id asc).
    Ids are integral, as text or number (`categorize_rejects` gives the other rows); a NULL
    text is empty; rows with a NULL cluster column belong to no cluster. The normalized rows,
    the items and the compared blocks are written to the shared checkpoint folder when this is called.
    """
    keys = _key(cluster_cols)
    ntext = normalize_aggressive(F.col(text_col)) if normalize else F.col(text_col)
    cid = F.unhex(F.sha2(F.to_json(F.array(*[F.col(k).cast("string") for k in keys])), 256)) if keys else F.lit(b"")
    docs = df.na.drop(subset=keys) if keys else df
    docs = docs.select(*keys, F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), integral_id(id_col).alias("id"),
                       F.coalesce(ntext, F.lit("")).alias("ntext"), cid.alias("cid")).filter(F.col("id").isNotNull())
    # one hash names the cluster and the text
    docs = written(docs.withColumn("tid", F.unhex(F.sha2(F.concat("cid", F.encode("ntext", "UTF-8")), 256))), "categorize-docs")
    many = docs.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE)
    many = many.select("tid", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))  # one row in SLICE documents at most
    dealt = docs.select("cid", "tid", "ntext", "id").join(F.broadcast(many), "tid", "left")
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("id"), F.coalesce("slices", F.lit(1))).cast("int"))
    items = written(dealt.groupBy("tid", "slice").agg(F.first("cid").alias("cid"), F.first("ntext").alias("ntext"), F.min("id").alias("minid"),
                                                      F.collect_list("id").alias("ids")), "categorize-items")
    found = written(_compared(items, not keys, threshold, block), "categorize-blocks")

    # per distinct text: weighted similarity sum and the smallest id among its near-duplicates; each of its
    # items meets all others, those of the same text included
    per_item = found.groupBy("tid", "slice").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("dmin").alias("dmin"))
    sizes = items.select("tid", "slice", F.size("ids").alias("n"))
    per_text = per_item.join(sizes, ["tid", "slice"]).groupBy("tid").agg(
        F.min("dmin").alias("dup_min"), F.max(F.col("n").cast("decimal(38,0)") * SCALE + F.col("s")).alias("sim_sum"))
    greater = found.join(per_text, "tid").select("tid", "dup_min", "sim_sum", F.explode(F.arrays_zip("ids", "ng")).alias("_z"))
    greater = greater.groupBy("tid", F.col("_z.ids").alias("id")).agg(
        F.sum("_z.ng").alias("n_greater"), F.min("dup_min").alias("dup_min"), F.min("sim_sum").alias("sim_sum"))

    out = docs.select(*keys, "_id", "_text", "id", "tid").join(greater, ["tid", "id"])
    is_dup = F.col("id") > F.col("dup_min")
    multiplicity = F.greatest("n_greater", F.lit(1)).cast("long")
    centrality = F.when(is_dup, F.lit(0.0)).otherwise(F.lit(2.0) * F.col("sim_sum").cast("double") / F.lit(float(SCALE)))
    out = out.select(*keys, F.col("_id").alias(id_col), F.col("_text").alias(text_col),
                     multiplicity.alias("multiplicity"), centrality.alias("centrality"))
    # int(centrality) of the exact value: sums that should be an integer may land a hair
    # below it after rounding each term, so round first
    return out.withColumn("representative", F.col("centrality") > 0).withColumn(
        "rank_key", F.col("multiplicity") * F.floor(F.round("centrality", 9)).cast("long"))


def split_lists(categorized: DataFrame, cluster_cols=(), id_col: str = "tweetid") -> tuple[DataFrame, DataFrame]:
    """The two ordered lists of C1 (representative first by rank key, ties by id)."""
    keys = _key(cluster_cols)
    order = [*keys, F.desc("rank_key"), integral_id(id_col)]
    rep = categorized.filter("representative").orderBy(*order)
    non = categorized.filter(~F.col("representative")).orderBy(*order)
    return rep, non


# ---------------------------------------------------------------- segments


def _interval_key(df: DataFrame, term: str, interval: str) -> Column:
    from tidewatch.operators.aggs import bucket_start

    ntz = dict(df.dtypes)[term] == "timestamp_ntz"
    return bucket_start(F.col(term), interval, ntz)


def cluster_segments(
    df: DataFrame,
    terms: list[str],
    interval: str = schema.CLUSTER_INTERVAL,
    size: int = schema.TERMS_SIZE,
    min_entries: int = schema.MIN_ENTRIES,
    time_field: str = "created_at",
) -> DataFrame:
    """Nested terms; at each level the top `size` values (count desc, key asc) inside
    their parent; leaves kept when count >= min_entries. The time field level is a
    histogram with `interval`. Array terms count each distinct element once per doc.

    Output: one row per surviving segment with the term columns and doc_count. Counts are of
    documents: a document without a child term still counts for its parent, and the values
    of a child array are not counted for the parent. Terms up to the next array share one
    `rollup`; each array term adds one pass.
    """
    if "location" in terms:
        raise ValueError("cannot aggregate by location here; use geo_cluster_segments")
    types = dict(df.dtypes)
    arrays = [i for i, t in enumerate(terms) if t != time_field and types[t].startswith("array")]
    base = df.select(*[_interval_key(df, t, interval).alias(t) if t == time_field else F.col(t) for t in terms])

    def counts(upto: int) -> DataFrame:
        """Rolled-up counts with the array terms before `upto` exploded."""
        rows = base.select(*terms[:upto])
        for i in (i for i in arrays if i < upto):
            rows = rows.withColumn(terms[i], F.explode(F.array_distinct(F.col(terms[i]))))
        return rows.rollup(*terms[:upto]).agg(F.count(F.lit(1)).alias("doc_count"), F.grouping_id().alias("_gid"))

    ends = [i for i in arrays if i] + [len(terms)]  # a pass ends before the next array term
    passes = {end: counts(end) for end in ends}
    n = len(terms)
    survivors = None
    for level in range(1, n + 1):
        prefix = terms[:level]
        # grouping_id bit i (from the left, over the columns of a pass) is 1 when column i is rolled up
        end = min(e for e in ends if e >= level)
        gid = (1 << (end - level)) - 1
        lvl = passes[end].filter(F.col("_gid") == gid).select(*prefix, "doc_count").na.drop(subset=prefix)
        if survivors is not None:
            lvl = lvl.join(survivors.select(*terms[: level - 1]), terms[: level - 1], "left_semi")
        if terms[level - 1] != time_field:
            # top `size` values inside each parent bucket (a histogram level keeps all buckets)
            parent = terms[: level - 1]
            order = [F.desc("doc_count"), F.asc(terms[level - 1])]
            if parent:
                w = Window.partitionBy(*parent).orderBy(*order)
                lvl = lvl.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= size).drop("_rn")
            else:
                lvl = lvl.orderBy(*order).limit(size)  # TakeOrderedAndProject, no single-partition window
        survivors = lvl
    return survivors.filter(F.col("doc_count") >= F.lit(min_entries))


def assign_clusters(df: DataFrame, segments: DataFrame, terms: list[str], interval: str = schema.CLUSTER_INTERVAL,
                    time_field: str = "created_at") -> DataFrame:
    """J6 + A9: docs of each surviving segment (equi-join on the segment keys); a doc in
    several segments (array terms) appears once per segment."""
    base = df
    for t in terms:
        dtype = dict(df.dtypes)[t]
        if t == time_field:
            base = base.withColumn(f"_k_{t}", _interval_key(df, t, interval))
        elif dtype.startswith("array"):
            base = base.withColumn(f"_k_{t}", F.explode(F.array_distinct(F.col(t))))
        else:
            base = base.withColumn(f"_k_{t}", F.col(t))
    seg = segments.select(*[F.col(t).alias(f"_k_{t}") for t in terms], "doc_count")
    out = base.join(seg, [f"_k_{t}" for t in terms])
    return out.select(*[F.col(f"_k_{t}").alias(f"seg_{t}") for t in terms], *df.columns)


def geo_cluster_segments(
    df: DataFrame,
    terms: list[str],
    precision: int = schema.CLUSTER_PRECISION,
    size: int = schema.TERMS_SIZE,
    min_entries: int = schema.MIN_ENTRIES,
    location: str = "location",
    strict: bool = False,
) -> DataFrame:
    """Geohash cell x term value. Per cell and per term: top `size` values of that
    term; segments with count >= min_entries; the union over terms (one family per
    term, not a product). The cell's box is the bounds of its docs, widened when flat.

    With no terms: cell-only segments (strict=True returns none, as the service did).
    Output: cell, term, value, doc_count, box corners.
    """
    from tidewatch.functions.geo import geohash, widen_box
    from tidewatch.operators.aggs import geo_bounds_aggs

    cells = df.filter(F.col(location).isNotNull()).withColumn(
        "cell", geohash(F.col(f"{location}.lat"), F.col(f"{location}.lon"), precision))
    corner_aggs = geo_bounds_aggs(location)

    def per_value(term):
        # one aggregation per term family gives both its counts and (rolled up) the cell
        # bounds; explode_outer keeps docs without a value in the bounds
        if term is None:
            return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("doc_count"), *corner_aggs) \
                .withColumn("value", F.lit(None).cast("string"))
        dtype = dict(df.dtypes)[term]
        vals = F.explode_outer(F.array_distinct(F.col(term))) if dtype.startswith("array") else F.col(term)
        rows = cells.select("cell", location, vals.alias("value")).withColumn("value", F.col("value").cast("string"))
        return rows.groupBy("cell", "value").agg(F.count(F.lit(1)).alias("doc_count"), *corner_aggs)

    first = per_value(terms[0] if terms else None)
    bounds = first.groupBy("cell").agg(
        F.max("top_left_lat").alias("top_left_lat"), F.min("top_left_lon").alias("top_left_lon"),
        F.min("bottom_right_lat").alias("bottom_right_lat"), F.max("bottom_right_lon").alias("bottom_right_lon"))
    box = widen_box("top_left_lat", "top_left_lon", "bottom_right_lat", "bottom_right_lon")
    bounds = bounds.select("cell", box["top_left_lat"].alias("top_left_lat"), box["top_left_lon"].alias("top_left_lon"),
                           box["bottom_right_lat"].alias("bottom_right_lat"), box["bottom_right_lon"].alias("bottom_right_lon"))
    fams = []
    if not terms:
        if strict:
            return bounds.select("cell", F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("value"),
                                 F.lit(0).cast("long").alias("doc_count"), "top_left_lat", "top_left_lon",
                                 "bottom_right_lat", "bottom_right_lon").limit(0)
        fams.append(first.select("cell", F.lit(None).cast("string").alias("term"), "value", "doc_count"))
    for k, t in enumerate(terms):
        g = (first if k == 0 else per_value(t)).filter(F.col("value").isNotNull()).select("cell", "value", "doc_count")
        w = Window.partitionBy("cell").orderBy(F.desc("doc_count"), F.asc("value"))
        g = g.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= size).drop("_rn")
        fams.append(g.select("cell", F.lit(t).alias("term"), "value", "doc_count"))
    seg = fams[0]
    for f in fams[1:]:
        seg = seg.unionByName(f)
    seg = seg.filter(F.col("doc_count") >= F.lit(min_entries))
    return seg.join(bounds, "cell")


def assign_geo_clusters(df: DataFrame, segments: DataFrame, terms: list[str], precision: int = schema.CLUSTER_PRECISION,
                        membership: str = "cell", location: str = "location") -> DataFrame:
    """J6 for A8 segments: the docs of each (cell, term, value) segment, once per segment.

    membership 'cell': docs of the segment's own cell. 'box': docs inside its (widened) box,
    edges included, which can take in neighbours of a degenerate box. A box touches few grid
    cells: it is listed under each and joined on (grid cell, term, value), never by range.
    Output: seg_cell, seg_term, seg_value (NULL without terms) and the columns of `df`.
    """
    from tidewatch.functions.geo import geohash

    if membership not in ("cell", "box"):
        raise ValueError(f"membership must be 'cell' or 'box': {membership!r}")
    lat, lon = F.col(f"{location}.lat"), F.col(f"{location}.lon")
    types = dict(df.dtypes)

    def values(t: str):
        vals = F.array_distinct(F.col(t)) if types[t].startswith("array") else F.array(F.col(t))
        vals = F.filter(vals, lambda x: x.isNotNull())
        return F.transform(F.coalesce(vals, F.array().cast(vals_type(t))),
                           lambda x: F.struct(F.lit(t).alias("t"), x.cast("string").alias("v")))

    def vals_type(t: str) -> str:
        return types[t] if types[t].startswith("array") else f"array<{types[t]}>"

    docs = df.filter(lat.isNotNull() & lon.isNotNull())
    if terms:
        docs = docs.withColumn("_tv", F.explode(F.concat(*[values(t) for t in terms])))
    else:
        docs = docs.withColumn("_tv", F.struct(F.lit("").alias("t"), F.lit("").alias("v")))
    seg = segments.select(F.col("cell").alias("seg_cell"), F.col("term").alias("seg_term"), F.col("value").alias("seg_value"),
                          F.coalesce("term", F.lit("")).alias("_t"), F.coalesce("value", F.lit("")).alias("_v"),
                          "top_left_lat", "top_left_lon", "bottom_right_lat", "bottom_right_lon")
    if membership == "cell":
        seg = seg.withColumn("_g", F.col("seg_cell"))
        docs = docs.withColumn("_g", geohash(lat, lon, precision))
        inside = F.lit(True)
    else:
        # grid step: the geohash cell's height, 0.004 degrees at least (a widened side has 0.002)
        step = max(0.004, 180.0 / 2 ** (5 * precision // 2))
        grid = lambda c: F.floor(c / F.lit(step))
        seg = seg.withColumn("_x", F.explode(F.sequence(grid(F.col("top_left_lon")), grid(F.col("bottom_right_lon"))))) \
            .withColumn("_y", F.explode(F.sequence(grid(F.col("bottom_right_lat")), grid(F.col("top_left_lat"))))) \
            .withColumn("_g", F.concat_ws("/", "_x", "_y")).drop("_x", "_y")
        docs = docs.withColumn("_g", F.concat_ws("/", grid(lon), grid(lat)))
        inside = lat.between(F.col("bottom_right_lat"), F.col("top_left_lat")) & lon.between(
            F.col("top_left_lon"), F.col("bottom_right_lon"))
    docs = docs.withColumn("_t", F.col("_tv.t")).withColumn("_v", F.col("_tv.v")).drop("_tv")
    return docs.join(seg, ["_g", "_t", "_v"]).filter(inside).select("seg_cell", "seg_term", "seg_value", *df.columns)
