"""Geo Column expressions: geohash, bounding boxes, centroids (distances: `functions.geodesic`).

All of these compile to JVM expressions (whole-stage codegen); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the geohash base-32 alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cell_index(value: Column, lo: float, span: float, bits: int) -> Column:
    """floor((v - lo) / span * 2^bits) clamped to [0, 2^bits - 1] (bisection cell number)."""
    scaled = F.floor((value - F.lit(lo)) / F.lit(span) * F.lit(float(2**bits)))
    return F.least(F.greatest(scaled, F.lit(0)), F.lit(2**bits - 1)).cast("long")


def geohash(lat, lon, precision: int = 5) -> Column:
    """Base-32 geohash of (lat, lon) with `precision` characters (1..12).

    Bits interleave starting with longitude; char i is built from global bits 5i..5i+4.
    """
    if not 1 <= int(precision) <= 12:
        raise ValueError("geohash precision must be within 1..12")
    p = int(precision)
    nbits = 5 * p
    lon_bits = (nbits + 1) // 2
    lat_bits = nbits // 2
    lon_idx = _cell_index(_col(lon), -180.0, 360.0, lon_bits)
    lat_idx = _cell_index(_col(lat), -90.0, 180.0, lat_bits)
    chars = []
    for i in range(p):
        code = F.lit(0)
        for b in range(5):
            g = 5 * i + b
            if g % 2 == 0:
                bit = F.shiftright(lon_idx, lon_bits - 1 - g // 2).bitwiseAND(F.lit(1))
            else:
                bit = F.shiftright(lat_idx, lat_bits - 1 - g // 2).bitwiseAND(F.lit(1))
            code = code + F.shiftleft(bit, 4 - b)
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), code.cast("int") + 1, 1))
    return F.concat(*chars)


def geohash_sql(lat: str, lon: str, precision: int = 5) -> str:
    """The same geohash as an ANSI/DuckDB SQL expression (used by oracles)."""
    p = int(precision)
    nbits = 5 * p
    lon_bits = (nbits + 1) // 2
    lat_bits = nbits // 2

    def idx(v, lo, span, bits):
        scaled = f"floor(({v} - CAST({lo} AS DOUBLE)) / CAST({span} AS DOUBLE) * CAST({float(2**bits)} AS DOUBLE))"
        return f"CAST(least(greatest({scaled}, 0), {2**bits - 1}) AS BIGINT)"

    lo_i, la_i = idx(lon, -180.0, 360.0, lon_bits), idx(lat, -90.0, 180.0, lat_bits)
    parts = []
    for i in range(p):
        terms = []
        for b in range(5):
            g = 5 * i + b
            src, width = (lo_i, lon_bits) if g % 2 == 0 else (la_i, lat_bits)
            terms.append(f"(((({src}) >> {width - 1 - g // 2}) & 1) << {4 - b})")
        parts.append(f"substr('{GEOHASH_ALPHABET}', CAST({' + '.join(terms)} AS INTEGER) + 1, 1)")
    return " || ".join(parts)


def in_bbox(lat, lon, top_left_lat, top_left_lon, bottom_right_lat, bottom_right_lon) -> Column:
    """Inclusive bounding box; a box whose left edge is east of its right edge crosses the date line."""
    lat, lon = _col(lat), _col(lon)
    lat_ok = lat.between(F.lit(float(bottom_right_lat)), F.lit(float(top_left_lat)))
    if float(top_left_lon) <= float(bottom_right_lon):
        lon_ok = lon.between(F.lit(float(top_left_lon)), F.lit(float(bottom_right_lon)))
    else:
        lon_ok = (lon >= F.lit(float(top_left_lon))) | (lon <= F.lit(float(bottom_right_lon)))
    return lat_ok & lon_ok


def widen_box(top_left_lat, top_left_lon, bottom_right_lat, bottom_right_lon, eps: float = 0.001) -> Column:
    """Degenerate box sides are widened by +-eps (a single point becomes a small box)."""
    tl_lat, tl_lon = _col(top_left_lat), _col(top_left_lon)
    br_lat, br_lon = _col(bottom_right_lat), _col(bottom_right_lon)
    same_lat = tl_lat == br_lat
    same_lon = tl_lon == br_lon
    return F.struct(
        F.when(same_lat, tl_lat + eps).otherwise(tl_lat).alias("top_left_lat"),
        F.when(same_lon, tl_lon - eps).otherwise(tl_lon).alias("top_left_lon"),
        F.when(same_lat, br_lat - eps).otherwise(br_lat).alias("bottom_right_lat"),
        F.when(same_lon, br_lon + eps).otherwise(br_lon).alias("bottom_right_lon"),
    )


def bounds_center(top_left_lat, top_left_lon, bottom_right_lat, bottom_right_lon) -> Column:
    """Centre of a box = mean of its two corners."""
    return F.struct(
        ((_col(top_left_lat) + _col(bottom_right_lat)) / 2).alias("lat"),
        ((_col(top_left_lon) + _col(bottom_right_lon)) / 2).alias("lon"),
    )


def mean_point(points) -> Column:
    """Centroid of an array of [lon, lat] pairs (ring / coordinate list) -> struct(lat, lon)."""
    arr = _col(points)
    n = F.size(arr).cast("double")
    zero = F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    acc = F.aggregate(
        arr,
        zero,
        lambda s, p: F.struct((s["lon"] + p.getItem(0)).alias("lon"), (s["lat"] + p.getItem(1)).alias("lat")),
    )
    return F.when(n > 0, F.struct((acc["lat"] / n).alias("lat"), (acc["lon"] / n).alias("lon")))
