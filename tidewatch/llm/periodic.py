"""Periodic runs of words, found with a dictionary of basic factors.

A run is a maximal stretch of words with smallest period q that is at least ``max(least, 2 * q)`` words
long. Level k of the dictionary names every stretch of 2**k words (a basic factor) by a number, equal for
equal stretches: the pair of names of its halves. Occurrences of one factor that follow each other within half
its length form an arithmetic progression, whose difference is the factor's period; so a handful of progressions
lies within twice the factor's length of any occurrence. A run of period q, 2**k <= q < 2**(k+1), repeats one of
its factors of level k after exactly q words: the differences between near progressions propose all periods.
Each proposal is extended to both sides by comparing names, longest factors first, and equal stretches keep
their smallest period.

The documents of an Arrow batch are worked on together: words of different documents have different names.
Positions whose factor occurs once leave the dictionary, so its upper levels hold little of ordinary prose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words worked on together (one longer document is worked on alone, whole).
CHUNK_WORDS = 400_000
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _names(symbols: np.ndarray) -> list[np.ndarray]:
    """The dictionary: per level the name of the factor at each position, -1 where it occurs once."""
    n = len(symbols)
    levels: list[np.ndarray] = []
    at, key = np.arange(n), symbols
    while len(at):
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        name = np.cumsum(head) - 1
        often = np.bincount(name)[name] > 1
        if not often.any():
            break
        level = np.full(n, -1, np.int64)
        level[at[order[often]]] = name[often]
        levels.append(level)
        half = 1 << (len(levels) - 1)
        at = np.flatnonzero(level[:max(0, n - half)] >= 0)
        at = at[level[at + half] >= 0]
        key = level[at] << 32 | level[at + half]
    return levels


def _proposals(level: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods proposed by the factors of one level (of ``size`` words)."""
    at = np.flatnonzero(level >= 0)
    order = np.argsort(level[at], kind="stable")
    pos, name = at[order], level[at][order]
    linked = (name[1:] == name[:-1]) & (2 * (pos[1:] - pos[:-1]) <= size)
    first = np.flatnonzero(np.concatenate(([True], ~linked)))  # progressions: maximal chains of near successors
    last = np.append(first[1:], len(pos)) - 1
    lo, hi, of = pos[first], pos[last], name[first]
    count = last - first + 1
    step = np.where(count > 1, pos[np.minimum(first + 1, len(pos) - 1)] - lo, size)
    starts, periods = [], []
    ahead = 1
    while ahead < len(first):  # ends after the few progressions that lie within twice the size
        a = np.flatnonzero((of[:-ahead] == of[ahead:]) & (lo[ahead:] - hi[:-ahead] < 2 * size))
        if not len(a):
            break
        b = a + ahead
        gap, by = lo[b] - hi[a], np.minimum(step[a], step[b])
        least = np.maximum(0, -((gap - size) // by))  # differences gap + t * by from size up to 2 * size - 1
        most = np.minimum((2 * size - 1 - gap) // by, count[a] + count[b] - 2)
        many = np.maximum(0, most - least + 1)
        which = np.repeat(np.arange(len(a)), many)
        t = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + least[which]
        back = np.minimum(t, count[a][which] - 1)  # steps back in the first progression, the rest ahead in the second
        starts.append(hi[a][which] - back * by[which])
        periods.append(gap[which] + t * by[which])
        ahead += 1
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def _extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` on (or before them), by names of falling length."""
    n, got = len(levels[0]), np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    while len(todo):  # the longest factors may fit many times
        i, j = (a - got)[todo], (b - got)[todo]
        if not back:
            i, j = (a + got)[todo], (b + got)[todo]
        size = 1 << (len(levels) - 1)
        x, y = (i - size, j - size) if back else (i, j)
        ok = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
        ok[ok] = (levels[-1][x[ok]] == levels[-1][y[ok]]) & (levels[-1][x[ok]] >= 0)
        got[todo[ok]] += size
        todo = todo[ok]
    for k in range(len(levels) - 2, -1, -1):
        size, level = 1 << k, levels[k]
        x, y = (a - got - size, b - got - size) if back else (a + got, b + got)
        ok = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
        ok[ok] = (level[x[ok]] == level[y[ok]]) & (level[x[ok]] >= 0)
        got[ok] += size
    return got


def find_runs(symbols: np.ndarray, least: int = 12) -> np.ndarray:
    """All runs of a sequence of word numbers: rows (start, length, period) by start, then period."""
    levels = _names(np.asarray(symbols, np.int64))
    found = [np.empty((0, 3), np.int64)]
    for k, level in enumerate(levels):
        a, q = _proposals(level, 1 << k)
        if not len(a):
            continue
        order = np.lexsort((a, q))
        a, q = a[order], q[order]
        # neighbours that propose the same period lie in one stretch
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (a[1:] > a[:-1] + 1)))
        a, q = a[new], q[new]
        left = _extend(levels, a, a + q, back=True)
        right = _extend(levels, a, a + q, back=False)
        length = left + right + q
        keep = length >= np.maximum(least, 2 * q)
        found.append(np.column_stack((a - left, length, q))[keep])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    same = np.concatenate(([False], (runs[1:, :2] == runs[:-1, :2]).all(1)))[:len(runs)]
    runs = runs[~same]  # the first of equal stretches has the smallest period
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """True for the words that some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def _run_rows(least: int, rewrite: Callable[[int | None, int], tuple[int, int] | None] | None):
    def chunks(b: pa.RecordBatch) -> Iterator[tuple[list, list[list[bytes]]]]:
        """Ids and words of consecutive documents, about ``CHUNK_WORDS`` words at once."""
        ids, words, size = [], [], 0
        for i, t in zip(b.column("id").to_pylist(), b.column("text")):
            t = t.as_py()
            w = t.encode("utf-8", "surrogatepass").split() if t else []  # bytes are split at ASCII white space
            tail = rewrite(i, len(w)) if rewrite and w else None
            if tail:
                a, p = tail
                w = w[:a] + (w[a:a + p] * -(-(len(w) - a) // p))[:len(w) - a]
            ids.append(i)
            words.append(w)
            size += len(w)
            if size >= CHUNK_WORDS:
                yield ids, words
                ids, words, size = [], [], 0
        if ids:
            yield ids, words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, words in chunks(b):
                size = np.fromiter(map(len, words), np.int64, len(words))
                flat = np.empty(int(size.sum()), object)
                flat[:] = [w for doc in words for w in doc]
                runs = find_runs(np.repeat(np.arange(len(words)), size) << 32 | pd.factorize(flat)[0], least)
                drop = repeated(runs, len(flat))
                bound = np.concatenate(([0], np.cumsum(size)))
                cut = np.searchsorted(runs[:, 0], bound)
                left = np.diff(np.concatenate(([0], np.cumsum(drop)))[bound]) > 0
                text = [b" ".join(flat[i:j][~drop[i:j]] if some else doc).decode("utf-8", "surrogatepass")
                        for doc, i, j, some in zip(words, bound[:-1], bound[1:], left)]
                start = runs[:, 0] - bound[np.searchsorted(bound, runs[:, 0], "right") - 1]
                rows = pa.StructArray.from_arrays([pa.array(x) for x in (start, runs[:, 1], runs[:, 2])], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(size), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows), pa.array(text, pa.string())],
                    ["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12,
                  rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """Rows (id, n_words, runs, collapsed), one per row of ``docs``.

    Words are stretches free of ASCII white space (`[^\\x20\\x09-\\x0D]+`), numbered from 0. ``runs`` holds every
    run's (start, length, period) by start, then period; ``collapsed`` the words that no run contains after its
    first period, joined by one space. ``rewrite(id, n_words)`` may plant a test case: (a, p) makes each word
    i >= a the word a + (i - a) % p; None leaves the text.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Repeated rows and null ids count
    each; whole texts are read, a text of any length in one task; only the two named columns are read; an empty
    table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id long, n_words long, runs {RUN_TYPE}, collapsed string"
    return src.mapInArrow(_run_rows(least, rewrite), schema).withColumnRenamed("id", id_col)


def run_digests(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) from ``periodic_runs``.

    The four numbers are those of the longest run (ties: smallest start, then period), null without a run.
    ``runs_sha256`` is the digest of `start,length,period` and a line feed per run. Keeps one row per row.
    """
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    top = F.array_min(ranked)
    return runs.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), top["s"].alias("start"), (-top["l"]).alias("length"),
        top["p"].alias("period"), text.alias("_text"), "collapsed",
    ).select(
        id_col, "n_runs", "start", "length", "period",
        F.expr("1000L * length div period").alias("exponent_milli"),
        F.sha2(F.col("_text").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
