"""Filters and predicates over posts (all JVM-side Column expressions, pushed to the scan).

Parameter dictionaries follow the request form: ``field`` or ``field__lookup`` -> value.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions.geo import in_bbox
from tidewatch.functions.timerange import bounds_to_column, time_bounds

BBOX_FIELDS = ("top_left_lat", "top_left_lon", "bottom_right_lat", "bottom_right_lon")
RANGE_LOOKUPS = ("gt", "gte", "lt", "lte")


class InvalidFilterError(ValueError):
    pass


def require_fields(*names: str) -> Column:
    """all named columns present (non-null)."""
    out = F.col(names[0]).isNotNull()
    for n in names[1:]:
        out = out & F.col(n).isNotNull()
    return out


def bbox_filter(params: dict, location: str = "location") -> Column | None:
    """applied only when all four corners are given."""
    if not all(k in params for k in BBOX_FIELDS):
        return None
    return in_bbox(
        F.col(f"{location}.lat"), F.col(f"{location}.lon"),
        float(params["top_left_lat"]), float(params["top_left_lon"]),
        float(params["bottom_right_lat"]), float(params["bottom_right_lon"]),
    )


def term(column: str, value, is_array: bool = False, max_len: int | None = None) -> Column:
    """exact, case-sensitive equality; on an array column any element may match.

    With `max_len` longer keyword values never match (the search index keeps values up to
    `schema.KEYWORD_MAX_LEN` characters only); by default none are left out.
    """
    c = F.col(column)
    short = lambda x: x == F.lit(value) if max_len is None or not isinstance(value, str) else (x == F.lit(value)) & (F.length(x) <= max_len)
    return F.exists(c, short) if is_array else short(c)


def range_filter(column: str, op: str, value) -> Column:
    """gt/gte/lt/lte comparison."""
    c = F.col(column)
    v = F.lit(value)
    if op == "gt":
        return c > v
    if op == "gte":
        return c >= v
    if op == "lt":
        return c < v
    if op == "lte":
        return c <= v
    raise InvalidFilterError(f"not a range lookup: {op}")


TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes"), ("0", "false", "no")


def _coerce(value, dtype: str):
    """A request value (text) as the column's type; other values pass."""
    if not isinstance(value, str):
        return value
    try:
        if dtype in ("double", "float") or dtype.startswith("decimal"):
            return float(value)
        if dtype in ("bigint", "int", "smallint", "tinyint"):
            return int(value)
    except ValueError as e:
        raise InvalidFilterError(f"not a number: {value!r}") from e
    if dtype == "boolean":
        return _truth(value)
    return value


def _truth(value) -> bool:
    word = str(value).strip().lower()
    if word not in TRUE_WORDS + FALSE_WORDS:
        raise InvalidFilterError(f"not true or false: {value!r}")
    return word in TRUE_WORDS


def _values(value, dtype: str) -> list:
    """The values of a list lookup: a list, or a text with commas."""
    return [_coerce(v, dtype) for v in (value if isinstance(value, (list, tuple)) else str(value).split(","))]


def _whole(value, what: str) -> int:
    try:
        return int(str(value).strip())
    except ValueError as e:
        raise InvalidFilterError(f"{what} needs a whole number, not {value!r}") from e


def lookup_filter(column: str, lookup: str, value, is_array: bool = False, dtype: str = "") -> Column:
    """The documented lookup names, each given its conventional meaning.

    The value is read as the lookup needs it: as the column's type (`dtype`, of an array its elements') for
    comparisons, as a list of such values for `in`, `nin` and `all`, as true or false for `exists`, as whole numbers
    for `mod` and `size`, as text for the others, which compare the column's text. A row without the field matches
    `exists=false` alone, neither `ne` nor `nin`.
    """
    c = F.col(column)
    dtype = dtype.removeprefix("array<").removesuffix(">")
    if lookup in RANGE_LOOKUPS:
        return range_filter(column, lookup, _coerce(value, dtype))
    if lookup in ("exact", "ne", "not"):
        same = term(column, _coerce(value, dtype), is_array)
        return same if lookup == "exact" else ~same
    if lookup in ("in", "nin"):
        values = _values(value, dtype)
        pred = F.arrays_overlap(c, F.array(*[F.lit(v) for v in values])) if is_array else c.isin(values)
        return pred if lookup == "in" else ~pred
    if lookup == "all":
        wanted = F.array(*[F.lit(v) for v in _values(value, dtype)])
        return F.size(F.array_except(wanted, c if is_array else F.array(c))) == 0
    if lookup == "mod":
        numbers = value if isinstance(value, (list, tuple)) else str(value).split(",")
        if len(numbers) != 2 or not _whole(numbers[0], "mod"):
            raise InvalidFilterError(f"mod needs a divisor and a remainder, not {value!r}")
        return F.pmod(c, F.lit(_whole(numbers[0], "mod"))) == F.lit(_whole(numbers[1], "mod"))
    if lookup == "size":
        return F.size(c) == F.lit(_whole(value, "size"))
    if lookup == "exists":
        return c.isNotNull() if _truth(value) else c.isNull()
    text, said = c if dtype in ("", "string") else c.cast("string"), str(value)
    if lookup == "iexact":
        return F.lower(text) == F.lower(F.lit(said))
    if lookup in ("contains", "icontains", "startswith", "istartswith", "endswith", "iendswith"):
        if is_array and lookup == "contains":
            return F.array_contains(c, _coerce(value, dtype))
        if lookup.startswith("i"):
            text, said = F.lower(text), said.lower()
        return {"contains": text.contains, "startswith": text.startswith, "endswith": text.endswith}[lookup.removeprefix("i")](said)
    if lookup == "match":
        return text.rlike(said)
    raise InvalidFilterError(f"unknown lookup: {lookup}")


def build_filter(
    params: dict,
    df_columns: dict[str, str],
    tz=None,
    now: datetime | None = None,
    allowed: dict[str, tuple[str, ...]] | None = None,
    time_field: str = "created_at",
    location: str = "location",
) -> Column | None:
    """AND of every recognised filter, plus F1 whenever any parameter is present.

    `df_columns` maps column -> simple type name (``dict(df.dtypes)``). Unknown fields
    are ignored (F6); when `allowed` is given, a lookup outside it raises.
    """
    if not params:
        return None
    preds: list[Column] = [require_fields(time_field, location)]
    geo = bbox_filter(params, location)
    if geo is not None:
        preds.append(geo)
    ntz = df_columns.get(time_field) == "timestamp_ntz"
    tcol = bounds_to_column(time_bounds(params, tz=tz, now=now, field=time_field), time_field, ntz)
    if tcol is not None:
        preds.append(tcol)
    for key, value in params.items():
        bits = key.split("__")
        name = bits[0]
        if name not in df_columns or name == time_field or name in BBOX_FIELDS:
            continue
        lookup = bits[-1] if len(bits) > 1 and bits[-1] in schema.LOOKUPS else "exact"
        if allowed is not None:
            if name not in allowed or lookup not in allowed[name] and not (lookup == "exact" and "exact" in allowed[name]):
                raise InvalidFilterError(f"The '{name}' field does not allow filtering by '{lookup}'.")
        dtype = df_columns[name]
        is_array = dtype.startswith("array")
        preds.append(lookup_filter(name, lookup, value, is_array, dtype))
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def apply_filters(df: DataFrame, params: dict, tz=None, now: datetime | None = None, allowed=None) -> DataFrame:
    pred = build_filter(params, dict(df.dtypes), tz=tz, now=now, allowed=allowed)
    return df if pred is None else df.filter(pred)


def missing(df: DataFrame, column: str = "location", limit: int | None = None) -> DataFrame:
    """rows lacking `column`, at most `limit` per run if one is given."""
    out = df.filter(F.col(column).isNull())
    return out.limit(limit) if limit else out


def probability_gate(lo: float = 0.6, hi: float = 1.0, column: str = "flood_probability") -> Column:
    """lo < p <= hi."""
    return (F.col(column) > F.lit(lo)) & (F.col(column) <= F.lit(hi))


def min_entries(agg: DataFrame, n: int = schema.MIN_ENTRIES, count_col: str = "doc_count") -> DataFrame:
    """HAVING count >= n."""
    return agg.filter(F.col(count_col) >= F.lit(n))
