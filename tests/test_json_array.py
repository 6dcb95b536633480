"""Large JSON arrays: every way of splitting a file gives the rows and positions of the whole file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.geojoin import load_countries
from tidewatch.sources.ingest import load_json
from tidewatch.sources.json_array import json_elements


def odd_value(rnd, depth=3):
    kind = rnd.randrange(9 if depth else 5)
    if kind == 0:
        return rnd.choice([None, True, 1.5, -7, ""])
    if kind < 5:
        return "".join(rnd.choices(['"', "\\", "}", "{", "[", "]", ",", "a", "é", "\n", "日", ": ", "\\\\\""], k=rnd.randint(0, 12)))
    if kind < 7:
        return [odd_value(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]
    return {f"k{i}}},\"": odd_value(rnd, depth - 1) for i in range(rnd.randint(0, 4))}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(old, (n, 1))]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent, split", [(None, 61), (2, 333), (None, 4_000), (0, 10**9)])
def test_any_splitting_gives_the_whole_file(spark, tmp_path, small_splits, indent, split):
    rnd = random.Random(split)
    records = [odd_value(rnd) for _ in range(60)] + [{"long": "}" * 700 + '"' * 90, "n": [[[{}]]]}] + [odd_value(rnd) for _ in range(40)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(records, indent=indent, ensure_ascii=False), encoding="utf-8")
    small_splits(split)
    got = json_elements(spark, str(path))
    assert split > 5_000 or spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 3
    rows = {r["pos"]: json.loads(r["value"]) for r in got.collect()}
    assert rows == dict(enumerate(records))
    part = load_json(spark, str(path), 30, 40)
    assert {r["pos"]: json.loads(r["raw"]) for r in part.collect()} == {i: records[i] for i in range(30, 70)}


def test_several_files_and_empty_arrays(spark, tmp_path, small_splits):
    small_splits(20)
    for name, records in (("a", [{"x": i} for i in range(9)]), ("b", []), ("c", [["}"], "]"])):
        (tmp_path / f"{name}.json").write_text("  " + json.dumps(records, indent=1) + " \n\n")
    got = {(r["file"][-6:], r["pos"]): json.loads(r["value"]) for r in json_elements(spark, str(tmp_path)).collect()}
    assert got == {**{("a.json", i): {"x": i} for i in range(9)}, ("c.json", 0): ["}"], ("c.json", 1): "]"}


def test_layer_file_in_splits(spark, tmp_path, small_splits):
    ring = [[float(i % 7), float(i % 5)] for i in range(40)]
    features = [{"type": "Feature", "properties": {"NAME": f"N}} {i}", "ISO2": f"X{i}"},
                 "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring[:5]]]} if i % 2 else {"type": "Polygon", "coordinates": [ring, ring[:4]]}} for i in range(12)]
    doc = {"type": "FeatureCollection", "bbox": [0, 0, 7, 5], "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "features": features, "note": ["x", {"type": "none"}]}
    path = tmp_path / "layer.json"
    path.write_text(json.dumps(doc))
    want = [(i, f"N}} {i}", f"X{i}", [40, 5] if i % 2 else [40, 4]) for i in range(12)]
    for split in (250, 10**9):
        small_splits(split)
        got = load_countries(spark, str(path)).select("fid", "name", "iso2", F.transform("rings", F.size).alias("n")).orderBy("fid").collect()
        assert [(r["fid"], r["name"], r["iso2"], r["n"]) for r in got] == want
