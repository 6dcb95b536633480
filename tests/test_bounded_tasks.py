"""Steps whose memory must not grow with the input."""

import json
import tracemalloc
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.operators.normalize import normalize, record_tags, walk_record
from tidewatch.plans.q_ingest import _write_arrays
from tidewatch.sources.ingest import load_json


def test_arrays_are_written_in_parts_and_numbered_through(spark, tmp_path):
    keys = [(i * 37) % 1000 for i in range(1000)] + [500, 500, 501, None, None]
    rows = spark.createDataFrame([(k, f'v"}}{i}') for i, k in enumerate(keys)], "k long, v string").withColumn("file", F.col("k") % 3)
    path = tmp_path / "arrays"
    _write_arrays(rows, "file", "k", str(path), most=50)
    files = sorted(path.rglob("*.txt"))
    parts = [json.loads(f.read_text()) for f in files]  # each an array of its own
    assert max(map(len, parts)) <= 60 and len(files) >= 21
    whole = {}
    for f, part in zip(files, parts):
        whole.setdefault(f.relative_to(path).parts[0], []).extend(part)
    assert {f: [r.get("k") for r in rs] for f, rs in whole.items()} == {
        **{f"file={m}": sorted(k for k in keys if k is not None and k % 3 == m) for m in range(3)}, "file=__HIVE_DEFAULT_PARTITION__": [None, None]}
    got = load_json(spark, str(path), 10, 300, array=F.regexp_extract("file", "/(file=[^/]*)/", 1)).collect()
    want = [(i, r) for rs in whole.values() for i, r in enumerate(rs) if 10 <= i < 310]
    assert sorted((r["pos"], sorted(json.loads(r["raw"]).items())) for r in got) == sorted((i, sorted(r.items())) for i, r in want)


def test_empty_arrays_among_the_parts_take_no_number(spark, tmp_path):
    for name, records in (("a/1", [{"x": 0}, {"x": 1}]), ("a/2", []), ("a/3", [{"x": 2}]), ("b/1", [{"x": 0}])):
        path = Path(tmp_path, f"array={name}.json")
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(records))
    got = load_json(spark, str(tmp_path), array=F.regexp_extract("file", "/array=([^/]*)/", 1)).collect()
    assert sorted((r["pos"], json.loads(r["raw"])["x"]) for r in got) == [(0, 0), (0, 0), (1, 1), (2, 2)]


def _walk_peak(n):
    """Bytes of Python objects held at most while a batch of n records is walked."""
    raw = pa.array([json.dumps({"id": i, "text": f"w #t{i}", "entities": {"media": [{"media_url": f"http://m.example/{i}.jpg"}]}}) if i % 7 else None for i in range(n)])
    tracemalloc.start()
    out = walk_record.func(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [dict(zip(("tags", "media"), record_tags(r))) for r in raw.to_pylist()]
    return peak


def test_the_walk_holds_no_batch_as_python_objects(spark):
    assert _walk_peak(0) < 100_000  # also an empty batch
    assert _walk_peak(20_000) < 3 * _walk_peak(2_000)


def test_the_joins_have_no_python_for_stems(spark):
    raw = spark.createDataFrame([(json.dumps({"id": 1, "text": "Flooded roads near the river #flood", "lang": "en", "annotations": {"flood_probability": 0.5}}),)], "raw string")
    ok, _ = normalize(raw)
    assert ok.first()["tokens"] == ["flood", "near", "river", "road"]
    assert "_analyze_batch" not in ok._jdf.queryExecution().toString()  # done where the records are walked
