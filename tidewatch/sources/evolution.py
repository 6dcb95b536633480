"""A table whose schema grows. Differences of two schemas, allowed widenings, and reading of all versions under the newest.

Each version of the schema has its own data folder and a file that holds the schema as JSON. Rows with a schema that the
newest one covers go to the newest version; rows that add fields or need wider types make a new version; rows that would
narrow a type or change its kind are refused. Reading casts every version to the newest schema; fields that a version does
not have are null.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Each type and the types that hold all its values exactly.
WIDER = {"byte": ("short", "integer", "long", "float", "double"), "short": ("integer", "long", "float", "double"), "integer": ("long", "double"),
         "float": ("double",), "date": ("timestamp_ntz",), "boolean": (), "long": (), "double": (), "string": ()}


class SchemaConflict(ValueError):
    """A schema that the table's cannot grow into."""


def difference(old: T.DataType, new: T.DataType, at: str = "") -> list[tuple[str, str, str, str]]:
    """(path, change, old type, new type) of all places where two schemas differ; change is `added`, `missing`,
    `widened`, `narrowed` or `changed`. Elements of arrays are `[]`, keys and values of maps `{key}` and `{value}`."""
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        mine, theirs = ({f.name: f.dataType for f in s.fields} for s in (old, new))
        path = lambda name: f"{at}.{name}" if at else name
        out = [(path(n), "missing", mine[n].simpleString(), "") for n in mine if n not in theirs]
        out += [d for n in mine if n in theirs for d in difference(mine[n], theirs[n], path(n))]
        return out + [(path(n), "added", "", theirs[n].simpleString()) for n in theirs if n not in mine]
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return difference(old.elementType, new.elementType, at + "[]")
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        return difference(old.keyType, new.keyType, at + "{key}") + difference(old.valueType, new.valueType, at + "{value}")
    if old == new:
        return []
    change = "widened" if _holds(new, old) else "narrowed" if _holds(old, new) else "changed"
    return [(at, change, old.simpleString(), new.simpleString())]


def _holds(wide: T.DataType, narrow: T.DataType) -> bool:
    """Whether every value of one simple type is exactly a value of another."""
    if isinstance(narrow, T.DecimalType) and isinstance(wide, T.DecimalType):
        return wide.scale >= narrow.scale and wide.precision - wide.scale >= narrow.precision - narrow.scale
    if isinstance(wide, T.DecimalType):
        digits = {"byte": 3, "short": 5, "integer": 10, "long": 19}.get(narrow.typeName())
        return digits is not None and wide.precision - wide.scale >= digits
    return wide.typeName() in WIDER.get(narrow.typeName(), ())


def merged(old: T.DataType, new: T.DataType, at: str = "") -> T.DataType:
    """The smallest schema that covers both: all fields, old ones first, the wider type of each. Raises SchemaConflict
    where the new type is not the old one or a wider or narrower form of it."""
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        theirs = {f.name: f for f in new.fields}
        fields = [T.StructField(f.name, merged(f.dataType, theirs[f.name].dataType, f"{at}.{f.name}".lstrip(".")) if f.name in theirs else f.dataType) for f in old.fields]
        return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in new.fields if f.name not in old.names])
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(merged(old.elementType, new.elementType, at + "[]"))
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        return T.MapType(merged(old.keyType, new.keyType, at + "{key}"), merged(old.valueType, new.valueType, at + "{value}"))
    if old == new or _holds(old, new):
        return old
    if _holds(new, old):
        return new
    raise SchemaConflict(f"{at}: {old.simpleString()} cannot become {new.simpleString()}")


def cast_to(value: Column, old: T.DataType, new: T.DataType) -> Column:
    """A value of one schema as one of a schema that covers it; fields it does not have are null."""
    if old == new:
        return value
    if isinstance(new, T.StructType):
        have = {f.name: f.dataType for f in old.fields}
        fields = [x for f in new.fields for x in (F.lit(f.name), cast_to(value[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType))]
        return F.when(value.isNotNull(), F.named_struct(*fields))
    if isinstance(new, T.ArrayType):
        return F.transform(value, lambda x: cast_to(x, old.elementType, new.elementType))
    if isinstance(new, T.MapType):
        values = F.transform_values(value, lambda k, v: cast_to(v, old.valueType, new.valueType))
        return F.transform_keys(values, lambda k, v: cast_to(k, old.keyType, new.keyType))
    return value.cast(new)


def conform_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows under a schema that covers theirs, in its column order."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[(cast_to(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


class GrowingTable:
    """The table under `path`; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def schemas(self) -> list[T.StructType]:
        """The schema of each version, oldest first."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/schema")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return []
        rows = self.spark.read.schema("v int, value string").json(f"{self.path}/schema").collect()
        return [T.StructType.fromJson(json.loads(r["value"])) for r in sorted(rows, key=lambda r: r["v"])]

    def append(self, df: DataFrame) -> int:
        """Add rows; the number of the version they went to."""
        known = self.schemas()
        plain = merged(df.schema, df.schema)  # without marks for columns that hold no nulls
        schema = merged(known[-1], plain) if known else plain
        version = len(known) - 1
        if not known or schema != known[-1]:
            version += 1
            text = self.spark.createDataFrame([(version, schema.json())], "v int, value string")
            text.coalesce(1).write.mode("append").json(f"{self.path}/schema")
        conform_to(df, schema).write.mode("append").parquet(f"{self.path}/data/v={version}")
        return version

    def read(self) -> DataFrame:
        """The rows of all versions under the newest schema."""
        schemas = self.schemas()
        if not schemas:
            raise ValueError(f"no version of the table under {self.path}")
        parts = [conform_to(self.spark.read.schema(s).parquet(f"{self.path}/data/v={v}"), schemas[-1]) for v, s in enumerate(schemas)]
        return reduce(DataFrame.unionByName, parts)
