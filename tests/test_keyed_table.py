"""The keyed table: upserts, replays, merging, and work that does not grow with the number of versions."""

import os
import random

import pytest

from tidewatch.streaming import jobs as J
from tidewatch.streaming.keyed_table import KeyedTable

SCHEMA = "k string, n int, note string"


def files_read(df) -> int:
    return len(df.inputFiles())


def test_upserts_replays_and_merging(spark):
    rnd, path, want = random.Random(7), J.scratch(spark, "t-keyed"), {}
    t = KeyedTable(spark, path, "k", buckets=4, runs=3)
    with pytest.raises(ValueError):
        t.read()
    for v in range(0, 20, 2):
        rows = {rnd.choice([None, *map(str, range(40))]): (v, rnd.choice([None, "x"])) for _ in range(rnd.choice([1, 12]))}
        df = spark.createDataFrame([(k, *r) for k, r in rows.items()], SCHEMA)
        tally = {"created": len(rows.keys() - want.keys()), "updated": len(rows.keys() & want.keys())}
        for _ in range(rnd.choice([1, 2])):  # some versions are replayed
            got = {r["outcome"]: r["n"] for r in t.upsert(df, v).collect()}
            assert got == {o: n for o, n in tally.items() if n}
        want |= rows
        assert {r["k"]: (r["n"], r["note"]) for r in t.read().collect()} == want
    assert t.read().columns == ["k", "n", "note"]
    held, _ = t._manifest(t.versions()[-1])
    assert max(map(len, held.values())) <= 3 and any(len(x) == 1 for x in held.values())
    # runs that merging replaced are gone, but for those that a replay of the last version needs
    runs = {(int(b[7:]), int(v[2:])) for v in os.listdir(f"{path}/data") for b in os.listdir(f"{path}/data/{v}") if b.startswith("bucket=")}
    before, _ = t._manifest(t.versions()[-2])
    assert runs == {(b, v) for m in (held, before) for b, vs in m.items() for v in vs}


def test_work_does_not_grow_with_versions(spark):
    t = KeyedTable(spark, J.scratch(spark, "t-keyed"), "k", buckets=4, runs=3)
    read = []
    for v in range(14):
        done = t.versions()
        held, schema = t._manifest(done[-1] if done else None)
        one = spark.createDataFrame([("same key", v, None)], SCHEMA)
        read.append(sum(len(x) for x in held.values()))
        t.upsert(one, v)
    assert max(read) <= 3
    assert files_read(t.read()) <= 3 and t.read().collect()[0]["n"] == 13


def test_other_columns_are_refused(spark):
    t = KeyedTable(spark, J.scratch(spark, "t-keyed"), "k")
    t.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    with pytest.raises(ValueError, match="other columns"):
        t.upsert(spark.createDataFrame([("a", 1)], "k string, m int"), 1)
    with pytest.raises(ValueError, match="buckets"):
        KeyedTable(spark, t.path, "k", buckets=5).read()
    t.upsert(spark.createDataFrame([], SCHEMA), 1)  # an empty micro-batch
    assert t.read().count() == 1
