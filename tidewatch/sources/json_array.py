"""Large JSON array files read by several tasks.

Spark's text reader cuts a file at closing braces into fragments, split by split, on any file system it reads. A split does
not know whether it begins inside a string, nor how deep. A first pass works out, per split and for both
assumptions, whether it ends inside a string and how much deeper it gets; put together in file order these
summaries (one row a split) give every split its true beginning. The second pass cuts the elements of the array
at its commas. An element that crosses splits comes out in pieces, which alone are grouped again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import written

#: Outside a string: a string (maybe cut off) or a character of structure. Inside: up to its end.
_OUTSIDE = re.compile(r'"(?:[^"\\]++|\\.)*+(?:"|\Z)|[\[\]{},]', re.S)
_INSIDE = re.compile(r'(?:[^"\\]++|\\.)*+"?', re.S)


def _tokens(text: str, inside: bool) -> Iterator[tuple[str, int, int]]:
    """(token, start, end) of the characters of structure; at last ("in" or "out", n, n) for where the text ends."""
    at = 0
    if inside:
        m = _INSIDE.match(text)
        at = m.end()
        if not m[0].endswith('"') or _escaped(m[0]):
            yield "in", len(text), len(text)
            return
    for m in _OUTSIDE.finditer(text, at):
        if m[0][0] != '"':
            yield m[0], m.start(), m.end()
        elif len(m[0]) == 1 or not m[0].endswith('"') or _escaped(m[0][1:]):
            yield "in", len(text), len(text)
            return
    yield "out", len(text), len(text)


def _escaped(tail: str) -> bool:
    """Whether the quote at the end of a string's tail is part of it."""
    body = tail[:-1]
    return (len(body) - len(body.rstrip("\\"))) % 2 == 1


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, split), fragment) in order; the closing brace that ends a fragment is put back."""
    for b in batches:
        yield from zip(zip(b.column("file").to_pylist(), b.column("split").to_pylist()), (x + "}" for x in b.column("value").to_pylist()))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: dict[tuple, list] = {}
    for key, text in _splits(batches):
        states = ends.setdefault(key, [(0, False), (0, True)])
        walked = {}
        for inside in {s[1] for s in states}:
            tokens = [token for token, _, _ in _tokens(text, inside)]
            walked[inside] = sum((t in "[{") - (t in "]}") for t in tokens[:-1]), tokens[-1] == "in"
        ends[key] = [(depth + walked[inside][0], walked[inside][1]) for depth, inside in states]
    rows = [(f, n, *a, *b) for (f, n), (a, b) in ends.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(("file", "split", "d0", "s0", "d1", "s1"), r)) for r in rows],
                                     pa.schema([("file", pa.string()), ("split", pa.int64()), ("d0", pa.int64()), ("s0", pa.bool_()), ("d1", pa.int64()), ("s1", pa.bool_())]))


def _pieces(begins: dict[tuple, tuple[int, bool]], level: int):
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("no", pa.int64()), ("text", pa.string()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, no, depth, inside, held, out = None, 0, 0, False, [], []

        def done(last: bool) -> None:
            out.append((*key, no, "".join(held), last))
            held.clear()

        for at, text in _splits(batches):
            if at != key:
                if key is not None:
                    done(True)
                key, no, (depth, inside) = at, 0, begins[at]
            begin = 0
            for token, i, j in _tokens(text, inside):
                if token == "," and depth == level or token in ("]", "}") and depth == level:
                    held.append(text[begin:i])
                    done(False)
                    no, begin = no + 1, j
                if len(token) == 1:
                    depth += (token in "[{") - (token in "]}")
                    if depth == level and token in "[{":
                        begin = j  # the elements begin here
                inside = token == "in"
            if depth >= level:
                held.append(text[begin:])
            if len(out) >= 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
                out.clear()
        if key is not None:
            done(True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def json_elements(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """(file, pos, value) of the elements of JSON array files, as their JSON text, in the file's numbering.

    ``level`` 1 is an array at the top of a file; 2 are the arrays (and objects) directly inside an object at the
    top, numbered on, for the caller to choose from. Files are read split by split, each in its own task, and
    twice; the driver gets one summary row a split. An empty array gives no rows.
    """
    lines = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    summary = lines.mapInArrow(_summaries, "file string, split long, d0 long, s0 boolean, d1 long, s1 boolean")
    begins: dict[tuple, tuple[int, bool]] = {}
    file, depth, inside = None, 0, False
    for r in sorted(summary.collect(), key=lambda r: (r["file"], r["split"])):
        if r["file"] != file:
            file, depth, inside = r["file"], 0, False
        begins[r["file"], r["split"]] = depth, inside
        depth, inside = depth + (r["d1"] if inside else r["d0"]), r["s1"] if inside else r["s0"]
    pieces = written(lines.mapInArrow(_pieces(begins, level), "file string, split long, no long, text string, last boolean"), "json-array")
    counts = pieces.where("last").select("file", "split", F.col("no").alias("n"))  # elements ended before the split's last piece
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row a split: the texts stay where they are
    numbered = pieces.join(F.broadcast(counts), ["file", "split"]).select("file", (F.col("before") + F.col("no")).alias("pos"), "split", "text",
                                                            (F.col("last") | (F.col("no") == 0)).alias("edge"))
    joined = numbered.where("edge").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("split", "text"))).alias("p")) \
        .select("file", "pos", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("value"))
    whole = numbered.where("not edge").select("file", "pos", F.col("text").alias("value"))
    return whole.unionByName(joined).where(F.btrim("value", F.lit(" \t\n\r")) != "")
