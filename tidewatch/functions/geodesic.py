"""Distance on the ellipsoid (WGS 84), the inverse geodesic problem.

A geodesic is fixed by its azimuth at the first point; on the auxiliary sphere its longitude difference and its
length are smooth integrals (Gauss-Legendre, 16 nodes). With the points put in canonical order (southern point first, its
latitude the larger in size) the longitude difference grows with the azimuth from 0 to half a turn, so the azimuth that meets
the second point is found by safeguarded false position inside a bracket, for any two points: nearly
opposite ones converge like all others. The unknown is the arc from the equator to the first point, which also
resolves courses along the equator, but for points almost half a turn apart, where it is the azimuth itself.
Whole Arrow batches are solved together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# The WGS 84 ellipsoid.
AXIS_M, FLATTENING = 6378137.0, 1 / 298.257223563
_POLAR_M = AXIS_M * (1 - FLATTENING)
_SECOND_ECC = FLATTENING * (2 - FLATTENING) / (1 - FLATTENING) ** 2
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


def _sphere(x: np.ndarray, by_arc: np.ndarray, sin1: np.ndarray, cos1: np.ndarray, sin2: np.ndarray, cos2: np.ndarray) -> tuple:
    """(arc from, arc to, longitude on the sphere, sine of the azimuth at the equator) of a geodesic from the first
    reduced latitude on to the second; its azimuth runs from 0 to half a turn with ``x`` in [0, 1]."""
    first = np.arctan2(sin1, cos1)
    arc = first - x * (np.pi + 2 * first)
    c = np.where(by_arc, np.clip(sin1 * np.cos(arc) / (np.sin(arc) * cos1), -1, 1), np.cos(np.pi * x))
    s = np.where(by_arc, np.sqrt((1 - c) * (1 + c)), np.sin(np.pi * x))
    equator = s * cos1
    c2 = np.sqrt(np.maximum(0, (c * cos1) ** 2 + (cos2 - cos1) * (cos2 + cos1)))
    arc1, arc2 = np.where(by_arc, arc, np.arctan2(sin1, c * cos1)), np.arctan2(sin2, c2)
    around = np.arctan2(equator * sin2, c2) - np.arctan2(equator * sin1, c * cos1)
    return arc1, arc2, around, equator


def _integral(f, arc1: np.ndarray, arc2: np.ndarray, equator: np.ndarray) -> np.ndarray:
    half, k2 = (arc2 - arc1) / 2, _SECOND_ECC * np.maximum(0, 1 - equator * equator)
    at = (arc1 + arc2)[:, None] / 2 + half[:, None] * _NODES
    return half * (f(np.sqrt(1 + k2[:, None] * np.sin(at) ** 2)) @ _WEIGHTS)


def _longitude(x: np.ndarray, *point: np.ndarray) -> np.ndarray:
    arc1, arc2, around, equator = _sphere(x, *point)
    return around - FLATTENING * equator * _integral(lambda r: (2 - FLATTENING) / (1 + (1 - FLATTENING) * r), arc1, arc2, equator)


def geodesic_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres between points in degrees (arrays); NaN where a latitude is outside [-90, 90] or anything is not finite."""
    lat1, lon1, lat2, lon2 = (np.asarray(x, np.float64) for x in np.broadcast_arrays(lat1, lon1, lat2, lon2))
    out = np.full(lat1.shape, np.nan)
    good = np.isfinite(lat1) & np.isfinite(lat2) & np.isfinite(lon1) & np.isfinite(lon2) & (np.abs(lat1) <= 90) & (np.abs(lat2) <= 90)
    if not good.any():
        return out
    lat1, lat2 = lat1[good], lat2[good]
    goal = np.radians(np.abs((lon2[good] - lon1[good] + 180) % 360 - 180))
    swap = np.abs(lat1) < np.abs(lat2)
    lat1, lat2 = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    turn = np.where(lat1 > 0, -1.0, 1.0)
    point = [goal < 0.995 * np.pi]
    for lat in (lat1 * turn, lat2 * turn):
        sin, cos = (1 - FLATTENING) * np.sin(np.radians(lat)), np.where(np.abs(lat) == 90, 1e-150, np.cos(np.radians(lat)))
        size = np.hypot(sin, cos)
        point += [sin / size, cos / size]
    point[1] = np.where(point[1] == 0, -1e-150, point[1])  # both on the equator
    low, high = np.zeros(len(goal)), np.ones(len(goal))
    f_low, f_high = -goal, np.pi - goal
    todo = np.arange(len(goal))
    for turn_no in range(120):
        a, b, fa, fb = low[todo], high[todo], f_low[todo], f_high[todo]
        x = (a + b) / 2 if turn_no % 3 == 2 else a - fa * (b - a) / np.where(fb == fa, 1, fb - fa)
        x = np.where((x > a) & (x < b), x, (a + b) / 2)
        fx = _longitude(x, *[p[todo] for p in point]) - goal[todo]
        left = fx < 0
        low[todo], f_low[todo] = np.where(left, x, a), np.where(left, fx, fa / np.where(turn_no % 3, 2, 1))
        high[todo], f_high[todo] = np.where(left, b, x), np.where(left, fb / np.where(turn_no % 3, 2, 1), fx)
        todo = todo[(np.abs(fx) > 1e-16) & (high[todo] - low[todo] > 2e-16)]
        if not len(todo):
            break
    arc1, arc2, _, equator = _sphere(np.where(np.abs(f_low) < np.abs(f_high), low, high), *point)
    metres = _POLAR_M * _integral(lambda r: r, arc1, arc2, equator)
    along = (np.abs(lat1) < 1e-9) & (goal <= (1 - FLATTENING) * np.pi)  # on the equator: an arc of it
    out[good] = np.where(along, AXIS_M * goal, metres)
    return out


def _distances(lat1: pa.Array, lon1: pa.Array, lat2: pa.Array, lon2: pa.Array) -> pa.Array:
    flat = [x.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for x in (lat1, lon1, lat2, lon2)]
    d = geodesic_m(*flat)
    return pa.array(d, mask=np.isnan(d))


def _distances_of_lists(points: pa.Array, lat: pa.Array, lon: pa.Array) -> pa.Array:
    size = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, row = points.flatten(), np.repeat(np.arange(len(points)), size)
    one = pa.array(row)
    d = _distances(flat.field("lat"), flat.field("lon"), lat.take(one), lon.take(one))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), d, mask=points.is_null())


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Metres between two points in degrees as a Column; null where a coordinate is null or no latitude."""
    return F.arrow_udf(_distances, DoubleType())(lat1, lon1, lat2, lon2)


def distances_m(points, lat, lon) -> Column:
    """Metres from each of an array of struct(lat, lon, ...) to one point, in the array's order; null like `distance_m`."""
    return F.arrow_udf(_distances_of_lists, ArrayType(DoubleType()))(points, lat, lon)
