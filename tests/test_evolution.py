"""A table that grows: differences, widenings, refusals, and all versions read as one."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.evolution import GrowingTable, SchemaConflict, difference, merged
from tidewatch.streaming.jobs import scratch


def of(ddl):
    return T.StructType.fromDDL(ddl)


def test_differences_of_schemas(spark):
    old = of("a int, b struct<x: float, y: string>, c array<struct<z: smallint>>, d map<string, int>, e double, f string, g decimal(10,2), h bigint")
    new = of("a bigint, b struct<x: double, w: int>, c array<struct<z: int>>, d map<string, bigint>, e float, f int, g decimal(12,2), i date, h bigint")
    assert difference(old, new) == [
        ("a", "widened", "int", "bigint"), ("b.y", "missing", "string", ""), ("b.x", "widened", "float", "double"), ("b.w", "added", "", "int"),
        ("c[].z", "widened", "smallint", "int"), ("d{value}", "widened", "int", "bigint"), ("e", "narrowed", "double", "float"),
        ("f", "changed", "string", "int"), ("g", "widened", "decimal(10,2)", "decimal(12,2)"), ("i", "added", "", "date")]
    assert difference(old, old) == []
    with pytest.raises(SchemaConflict, match="f: string cannot become int"):
        merged(old, new)
    assert merged(of("a int, b float"), of("b double, c string, a int")) == of("a int, b double, c string")
    assert merged(of("a bigint"), of("a int")) == of("a bigint")  # narrower rows fit
    for a, b in (("a bigint", "a double"), ("a string", "a array<string>"), ("a int", "a float"), ("a boolean", "a int"), ("a timestamp", "a date")):
        with pytest.raises(SchemaConflict):
            merged(of(a), of(b))


def test_three_versions_read_as_one(spark):
    t = GrowingTable(spark, scratch(spark, "t-growing"))
    with pytest.raises(ValueError):
        t.read()
    first = spark.createDataFrame([(1, (1.5, "u"), [(1,)]), (2, None, None)], "id int, s struct<x: float, y: string>, l array<struct<z: smallint>>")
    second = spark.createDataFrame([(2**40, (2.25, "v", True), [(70_000, "n"), None])], "id bigint, s struct<x: double, y: string, w: boolean>, l array<struct<z: int, q: string>>")
    third = spark.createDataFrame([("t", 4)], "note string, id int")
    assert [t.append(d) for d in (first, first.limit(1), second, third, first.limit(1), third)] == [0, 0, 1, 2, 2, 2]
    got = t.read()
    assert got.schema == of("id bigint, s struct<x: double, y: string, w: boolean>, l array<struct<z: int, q: string>>, note string")
    rows = sorted((r["id"], r["s"] and tuple(r["s"]), r["l"] and [x and tuple(x) for x in r["l"]], r["note"]) for r in got.collect() if r["id"] > 1)
    assert rows == [(2, None, None, None), (4, None, None, "t"), (4, None, None, "t"), (2**40, (2.25, "v", True), [(70_000, "n"), None], None)]
    assert got.where("id = 1").select("s.*", F.col("l")[0]["z"].alias("z")).distinct().collect() == [(1.5, "u", None, 1)]
    with pytest.raises(SchemaConflict, match="note: string cannot become int"):
        t.append(spark.createDataFrame([(1,)], "note int"))
    assert got.count() == t.read().count() == 7 and len(t.schemas()) == 3
