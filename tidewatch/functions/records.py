"""Nested-record shaping (P3, P4, P8, P10, X17): schema-driven, JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project_paths(df: DataFrame, variant_col: str, paths, extra=()) -> DataFrame:
    """Keep listed paths of a VARIANT record as columns. A top-level name becomes a
    column of that name; 'a/b' becomes column 'a_b' (typed as variant unless a type is
    given as 'a/b:type'). `extra` paths are added by the caller."""
    cols = []
    for spec in list(paths) + list(extra):
        path, _, typ = spec.partition(":")
        json_path = "$." + ".".join(path.split("/"))
        cols.append(F.try_variant_get(F.col(variant_col), json_path, typ or "variant").alias(path.replace("/", "_")))
    return df.select(*cols)


def flatten_struct(df: DataFrame, sep: str = "_", exclude=("location",)) -> DataFrame:
    """Nested struct columns -> `parent<sep>child` columns (recursively); arrays,
    maps and the excluded columns are left as they are."""

    def walk(prefix: str, col: Column, dtype: T.DataType, top: bool):
        if isinstance(dtype, T.StructType) and not (top and prefix in exclude):
            out = []
            for f in dtype.fields:
                out.extend(walk(f"{prefix}{sep}{f.name}", col[f.name], f.dataType, False))
            return out
        return [col.alias(prefix)]

    cols = []
    for f in df.schema.fields:
        cols.extend(walk(f.name, F.col(f.name), f.dataType, True))
    return df.select(*cols)


def merge_nested(base: Column, override: Column, dtype: T.StructType) -> Column:
    """Recursively override a nested record: a field present (non-NULL) in `override`
    wins; sub-records merge field by field; an override sub-record that is present but
    has no fields set replaces the base one (an empty mapping replaces)."""
    fields = []
    for f in dtype.fields:
        b, o = base[f.name], override[f.name]
        if isinstance(f.dataType, T.StructType):
            empty = F.lit(True)
            for sub in f.dataType.fields:
                empty = empty & o[sub.name].isNull()
            merged = F.when(o.isNull(), b).when(empty, o).otherwise(merge_nested(b, o, f.dataType))
            fields.append(merged.alias(f.name))
        else:
            fields.append(F.coalesce(o, b).alias(f.name))
    return F.when(base.isNull(), override).otherwise(F.struct(*fields))


def pairs_to_map(records: Column, key_field: str, value_field: str) -> Column:
    """P10: a list of records -> map from one field to another (last duplicate key wins)."""
    idx = F.transform(records, lambda r, i: F.struct(r[key_field].alias("key"), r[value_field].alias("value"), i.alias("i")))
    last = F.filter(idx, lambda x: ~F.exists(idx, lambda y: (y["key"] == x["key"]) & (y["i"] > x["i"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))


def drop_keys(df: DataFrame, *keys: str) -> DataFrame:
    """P10: remove columns (missing ones are ignored)."""
    return df.drop(*[k for k in keys if k in df.columns])


def to_zone(ts: Column, zone: str) -> Column:
    """An instant shown as wall-clock time in `zone` (TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def from_zone(local: Column, zone: str) -> Column:
    """A naive wall-clock time in `zone` attached to that zone -> UTC instant (NTZ)."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local.cast("timestamp_ntz"))
