"""Quadtree cover of a polygon layer (J1, X19): cells in which few edges decide the point-in-polygon test.

The world is divided into square-ish cells; a cell that holds more than `max_polygons` polygons or `max_edges` edges is
split into four, down to `max_level`. The leaves divide the world, so every point lies in exactly one. A leaf keeps, per
polygon, only the edges that pass through it. An edge that lies east of it is crossed by a ray eastwards from
latitude y if one of its ends lies above y and the other does not; so all such edges come down to the latitudes of
their ends, of which those that neighbouring edges share cancel out, and those above the leaf to a parity. A polygon
that contains a whole leaf keeps no edge and needs no test. Polygons behind one that fills the leaf can
never be the first match and are dropped from it. Only comparisons of given numbers and the crossing test itself decide,
so the answer is that of the test over all edges.

Each level is one pass over what is still to be split, written to the shared folder; the layer is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

BASE_LEVEL, MAX_LEVEL = 4, 18
MAX_POLYGONS, MAX_EDGES = 16, 64
#: Degrees by which a cell is taken larger than it is when edges are sorted out.
MARGIN = 1e-9


def cell_of(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    """Column and row of the cell of a point; points beyond the world belong to its outermost cells."""
    n = F.lit(float(1 << level))
    x = F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)), n - 1).cast("int")
    y = F.least(F.greatest(F.floor((lat + 90.0) / 180.0 * n), F.lit(0)), n - 1).cast("int")
    return x, y


def _edges(rings: Column) -> Column:
    """Edges (alat, alon, blat, blon) of all rings of three points or more."""
    def of(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.named_struct(
            F.lit("alat"), F.get(ring, i)["lat"], F.lit("alon"), F.get(ring, i)["lon"],
            F.lit("blat"), F.get(ring, F.pmod(i - 1, n))["lat"], F.lit("blon"), F.get(ring, F.pmod(i - 1, n))["lon"]))

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) >= 3), of))


_EDGES = "array<struct<alat:double,alon:double,blat:double,blon:double>>"
_PART = f"fid int, name string, lv int, cx int, cy int, odd boolean, far array<double>, edges {_EDGES}"


def _bounds(level: np.ndarray, at: np.ndarray, low: float, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of cells along one axis; the outermost cells have none on that side."""
    n = np.exp2(level)
    return (np.where(at == 0, -np.inf, at / n * span + low - MARGIN), np.where(at == n - 1, np.inf, (at + 1) / n * span + low + MARGIN))


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def _clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts cut down to what matters in their cell; those that are empty there are dropped."""
    for b in batches:
        col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("lv", "cx", "cy", "odd")}
        (x0, x1), (y0, y1) = _bounds(col["lv"], col["cx"], -180.0, 360.0), _bounds(col["lv"], col["cy"], -90.0, 180.0)
        edges, far = b.column("edges"), b.column("far")
        row, n = np.repeat(np.arange(len(b)), edges.value_lengths().to_numpy()), len(b)
        flat = edges.flatten()
        alat, alon, blat, blon = (flat.field(c).to_numpy() for c in ("alat", "alon", "blat", "blon"))
        low, high = np.maximum(np.minimum(alat, blat), y0[row]), np.minimum(np.maximum(alat, blat), y1[row])
        with np.errstate(invalid="ignore", divide="ignore"):  # where the edge enters and leaves the cell's latitudes
            at = [np.where(alat == blat, x, alon + (y - alat) / (blat - alat) * (blon - alon)) for y, x in ((low, alon), (high, blon))]
        meets = low <= high
        east = meets & (np.minimum(*at) > x1[row])
        near = meets & ~east & (np.maximum(*at) >= x0[row])
        ends = np.concatenate((alat[east], blat[east], far.flatten().to_numpy()))
        of = np.concatenate((row[east], row[east], np.repeat(np.arange(n), far.value_lengths().to_numpy())))
        odd = col["odd"].astype(bool) ^ (np.bincount(of[ends > y1[of]], minlength=n) % 2 == 1)
        inside = (ends <= y1[of]) & (ends > y0[of])
        of, ends = of[inside], ends[inside]
        order = np.lexsort((ends, of))
        of, ends = of[order], ends[order]
        head = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (ends[1:] != ends[:-1]))))[:len(of)]
        single = head[np.diff(np.append(head, len(of))) % 2 == 1]  # pairs cancel out
        of, ends = of[single], ends[single]
        out = {c: b.column(c) for c in ("fid", "name", "lv", "cx", "cy")} | {
            "odd": pa.array(odd), "far": _lists(np.bincount(of, minlength=n), pa.array(ends)),
            "edges": _lists(np.bincount(row[near], minlength=n), flat.filter(pa.array(near)))}
        keep = odd | (np.bincount(row[near], minlength=n) > 0)
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out)).filter(pa.array(keep))


def quadtree_cover(layer: DataFrame, max_polygons: int = MAX_POLYGONS, max_edges: int = MAX_EDGES,
                   base_level: int = BASE_LEVEL, max_level: int = MAX_LEVEL) -> tuple[DataFrame, list[int]]:
    """(lv, cx, cy, parts) of all leaves and the levels they are on, from a layer (fid, name, rings).

    `parts` is an array of (fid, name, odd, far, edges) by fid, null where no polygon reaches the leaf. A leaf holds at most
    `max_polygons` parts and `max_edges` edges, but at `max_level`, where polygons that share a border or lie on each
    other stay together. Polygons without a ring of three points contain nothing.
    """
    key = ["lv", "cx", "cy"]
    level = F.lit(base_level)
    lat = F.transform(F.flatten("rings"), lambda p: p["lat"])
    lon = F.transform(F.flatten("rings"), lambda p: p["lon"])
    x0, y0 = cell_of(F.array_min(lat), F.array_min(lon), base_level)
    x1, y1 = cell_of(F.array_max(lat), F.array_max(lon), base_level)
    todo = layer.where(F.size(F.flatten("rings")) > 0).select("fid", "name", _edges(F.col("rings")).alias("edges"), F.explode(F.sequence(x0, x1)).alias("cx"),
                                                              F.sequence(y0, y1).alias("ys"))
    part = ["fid", "name", "lv", "cx", "cy", "odd", "far", "edges"]
    todo = todo.select("fid", "name", level.alias("lv"), "cx", F.explode("ys").alias("cy"), F.lit(False).alias("odd"),
                       F.array().cast("array<double>").alias("far"), "edges")
    side = F.sequence(F.lit(0), F.lit((1 << base_level) - 1))
    cells = layer.sparkSession.range(1).select(level.alias("lv"), F.explode(side).alias("cx")).select("lv", "cx", F.explode(side).alias("cy"))
    leaves, levels = [], []
    for at in range(base_level, max_level + 1):
        parts = written(todo.select(part).mapInArrow(_clip, _PART), "cover")
        first = parts.where("size(edges) = 0").groupBy(*key).agg(F.min("fid").alias("filled"))
        parts = parts.join(first, key, "left").where("filled is null or fid <= filled").drop("filled")
        parts = written(parts, "cover")
        dense = parts.groupBy(*key).agg(F.count("*").alias("polygons"), F.sum(F.size("edges")).alias("edges")) \
            .where((F.col("polygons") > max_polygons) | (F.col("edges") > max_edges)).select(*key)
        dense = written(dense if at < max_level else dense.limit(0), "cover")
        held = parts.join(dense, key, "left_anti").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("fid", "name", "odd", "far", "edges"))).alias("parts"))
        leaves.append(cells.join(dense, key, "left_anti").join(held, key, "left"))
        levels.append(at)
        if dense.isEmpty():
            break
        four = [F.struct((F.col("lv") + 1).alias("lv"), (F.col("cx") * 2 + dx).alias("cx"), (F.col("cy") * 2 + dy).alias("cy")) for dx in (0, 1) for dy in (0, 1)]
        cells = dense.select(F.explode(F.array(*four)).alias("c")).select("c.*")
        todo = parts.join(dense, key, "left_semi").select("fid", "name", "odd", "far", "edges", F.explode(F.array(*four)).alias("c")) \
            .select("fid", "name", "odd", "far", "edges", "c.*")
    return written(reduce(DataFrame.unionByName, leaves), "cover"), levels


def contains(part: Column, lat: Column, lon: Column) -> Column:
    """Whether a leaf's part contains the point: parity of the edges a ray eastwards crosses."""
    east = F.size(F.filter(part["far"], lambda y: y > lat)) % 2 == 1

    def step(inside: Column, e: Column) -> Column:
        straddles = (e["alat"] > lat) != (e["blat"] > lat)  # implies different latitudes (no zero division)
        crosses = F.when(straddles, lon < (e["blon"] - e["alon"]) * (lat - e["alat"]) / (e["blat"] - e["alat"]) + e["alon"])
        return F.when(F.coalesce(crosses, F.lit(False)), ~inside).otherwise(inside)

    return F.aggregate(part["edges"], part["odd"] != east, step)
