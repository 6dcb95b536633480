"""Divergence of sources from their language and from each other, with exact top terms by a dominance skyband.

Terms are stretches of letters and non-ASCII characters, A-Z in lower case. A language keeps the terms that at least
``min_docs`` of its documents hold. Every group (lang, source) and every language gives each kept term a smoothed share
p = 1 + floor(10**9 * (count + 2) / (N + 2 V)); the value of a term between two shares is floor((p - q)^2 / (p + q)).

* ``pair``: for two sources of a language, the sum of the values of all kept terms. Blocks of terms are summed as dense
  matrices, tile of sources by tile of sources, and leave a task as one row per pair.
* ``term``: the terms that a group uses more than its language does, the best ``top`` by value. The value grows with the
  group's count and falls with the language's, and ties go to the earlier term in UTF-8; so a term that ``top`` others
  dominate (count at least as high, language count at most as high, term earlier) is not among the best. Each partition,
  sorted by term, keeps the terms dominated by fewer than ``top`` others, its skyband; skybands are merged the same way,
  and what is left is ranked by exact values. No totals are needed before that.

Counts leave the texts pre-aggregated; a group with most documents is spread over all tasks. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import Scratch

#: Shares are counted in units of 1 / 1000**3.
DIGITS = 3
MIN_DOCS = 10
TOP = 10
#: Sources of a language whose pairs are summed together; more are dealt as tiles of this size.
TILE = 256
#: Distinct counts that a task holds before it hands them on.
HELD = 300_000
#: Parts that the skybands of one group are merged in before the ranking.
MERGE_PARTS = 16
#: Term characters stay (A-Z in lower case), all other ASCII becomes white space.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uses: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in uses.items():
            n, own = len(counts), docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([t.decode("utf-8", "surrogatepass") for t in counts], pa.string()),
                 pa.array(counts.values(), pa.int64()), pa.array([own[t] for t in counts], pa.int64())], ["lang", "source", "term", "n", "docs"])
        uses.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
            terms = Counter(text.as_py().encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split())
            if not terms:
                continue
            group = uses[lang, source]
            held -= len(group)
            group.update(terms)
            docs[lang, source].update(terms.keys())
            held += len(group)
            if held >= HELD:
                yield from out()
                held = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs) of documents with non-null lang, source and text; a key may come several
    times (once per flush of a task): the counts are pre-aggregated, not final."""
    return docs.mapInArrow(_count_rows, "lang string, source string, term string, n long, docs long")


def _share(n: Column, total: Column) -> Column:
    """1 + floor(1000**DIGITS * n / total), as a long division by thousands: exact while 1000 * total is a long."""
    out, rest = F.lit(0).cast("long"), n.cast("long")
    for _ in range(DIGITS):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, total), rest * 1000 % total
    return out + 1


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(np.broadcast(n, total).shape, np.int64), n
    for _ in range(DIGITS):
        rest = rest * 1000
        part = rest // total
        out, rest = out * 1000 + part, rest - part * total
    return out + 1


def _band(high: np.ndarray, low: np.ndarray, held: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Which rows, in term order, fewer than ``k`` others dominate; ``held``: the earlier rows of the skyband.

    Rows of an earlier block that were not kept may be left out: their dominators are kept and dominate as well.
    """
    by_high, by_low = held
    keep = np.zeros(len(high), bool)
    for at in range(0, len(high), 256):
        h, w = high[at:at + 256], low[at:at + 256]
        over = ((by_high[:, None] >= h) & (by_low[:, None] <= w)).sum(0)
        left = np.flatnonzero(over < k)
        h, w = h[left], w[left]
        inside = (h[:, None] >= h) & (w[:, None] <= w)
        left = left[over[left] + np.triu(inside, 1).sum(0) < k]
        keep[at + left] = True
        by_high, by_low = np.append(by_high, high[at + left]), np.append(by_low, low[at + left])
    return keep


def _cuts(*keys: np.ndarray) -> list[np.ndarray]:
    """The row numbers of each group of equal keys, in row order."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    edge = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        edge |= np.diff(k[order]) != 0
    return np.split(order, np.flatnonzero(edge) + 1) if len(order) else []


def _skyband_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        none = np.empty(0, np.int64)
        for b in batches:
            lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
            of, by = lang.indices.to_numpy(), source.indices.to_numpy()
            n, all_n = (b.column(c).to_numpy() for c in ("n", "lang_n"))
            keep = [none]
            for rows in _cuts(of, by):
                key = (lang.dictionary[of[rows[0]]].as_py(), source.dictionary[by[rows[0]]].as_py())
                own = held.get(key, (none, none))
                rows = rows[_band(n[rows], all_n[rows], own, k)]
                held[key] = np.append(own[0], n[rows]), np.append(own[1], all_n[rows])
                keep.append(rows)
            yield b.take(pa.array(np.sort(np.concatenate(keep))))

    return run


def skyband(counts: DataFrame, k: int = TOP) -> DataFrame:
    """The rows (lang, source, term, n, lang_n) of each partition that fewer than ``k`` rows of their group (lang, source)
    in the partition dominate: n at least as high, lang_n at most as high, term earlier. The rows of a partition must
    come in the order of their terms. Moves no rows; a task holds the kept numbers of its groups."""
    rows = counts.select("lang", "source", "term", "n", "lang_n")
    return rows.mapInArrow(_skyband_rows(k), "lang string, source string, term string, n long, lang_n long")


def _tile_rows(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, a, b), s in sums.items():
                x, y = np.nonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array((x + a * tile).astype(np.int32)),
                                                  pa.array((y + b * tile).astype(np.int32)), pa.array(s[x, y])], ["lang", "i", "j", "value"])
            sums.clear()

        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            of, ta, tb = lang.indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("a", "b"))
            for rows in _cuts(of, ta, tb):
                part = batch.take(pa.array(rows))
                a, b = int(ta[rows[0]]), int(tb[rows[0]])
                key = (lang.dictionary[of[rows[0]]].as_py(), a, b)
                use = part.column("use")
                flat, row = use.flatten(), np.repeat(np.arange(len(rows)), use.value_lengths().to_numpy())
                names, uses, counts, total = flat.field("source"), flat.field("n").to_numpy(), [], []
                for sources in (part.column("sources_a")[0].values, part.column("sources_b")[0].values):
                    at = pc.index_in(names, value_set=sources.field("source")).fill_null(-1).to_numpy()
                    n = np.zeros((len(rows), len(sources)), np.int64)
                    n[row[at >= 0], at[at >= 0]] = uses[at >= 0]
                    counts.append(n)
                    total.append(sources.field("total").to_numpy())
                if key not in sums:
                    if len(sums) >= 64:
                        yield from out()
                    sums[key] = np.zeros((len(total[0]), len(total[1])), np.int64)
                for at in range(0, len(rows), 2048):
                    p, q = (_shares(n[at:at + 2048] + 2, d) for n, d in zip(counts, total))
                    for x in range(p.shape[1]):
                        y = q[:, x + 1:] if a == b else q  # inside a tile each pair once
                        by = y - p[:, x:x + 1]
                        sums[key][x, q.shape[1] - y.shape[1]:] += (by * by // (y + p[:, x:x + 1])).sum(0)
        yield from out()

    return run


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, tile: int = TILE) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of documents (lang, source, text).

    ``pair``: item is each other source of the lang, in the order of the summed values, all ranks. ``term``: item is a
    kept term with a positive count in the group and a share above the language's, the best ``top``. Equal values rank
    by item in UTF-8 order. Null lang, source and text are read as ''. A group without terms has count 0 for all; a
    language without kept terms has pairs of value 0; a lang with one source has no pairs. Repeated rows count each
    time. Other columns are not read. An empty table gives no rows. Intermediate tables go to the shared folder when
    this is called. The pairs are the output's size: the square of a language's sources.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    src = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    # one exchange by (lang, term) serves the sums per source and those per language
    by_source = term_counts(src).repartition("lang", "term").groupBy("lang", "term", "source") \
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = by_source.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"),
                                                 F.collect_list(F.struct("source", "n")).alias("use")).where(F.col("docs") >= min_docs)
    kept = scratch.write(kept.select("lang", "term", "lang_n", "use")).df

    group_n = kept.select("lang", F.explode("use").alias("u")).groupBy("lang", "u.source").agg(F.sum("u.n").alias("group_n"))
    lang_n = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("total"))
    groups = src.select("lang", "source").distinct()
    totals = groups.join(group_n, ["lang", "source"], "left").join(lang_n, "lang", "left").select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("i"),
        (F.coalesce("group_n", F.lit(0)) + 2 * F.col("v")).alias("group_total"), (F.col("total") + 2 * F.col("v")).alias("lang_total"))
    totals = scratch.write(totals).df  # both sums null where the language keeps no term

    return _pairs(kept, totals, tile).unionByName(_terms(kept, totals, top))


def _pairs(kept: DataFrame, totals: DataFrame, tile: int) -> DataFrame:
    """All pairs of sources of a language by the summed values of the kept terms."""
    own = totals.where("group_total is not null").groupBy("lang", F.expr(f"i div {int(tile)}").alias("t")).agg(
        F.array_sort(F.collect_list(F.struct("source", F.col("group_total").alias("total")))).alias("sources"))
    tiles = own.select("lang", F.col("t").alias("a"), F.col("sources").alias("sources_a")).join(
        own.select("lang", F.col("t").alias("b"), F.col("sources").alias("sources_b")), "lang").where("a <= b")
    sums = kept.join(tiles, "lang").select("lang", "a", "b", "sources_a", "sources_b", "use") \
        .mapInArrow(_tile_rows(tile), "lang string, i int, j int, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    one, other = totals.select("lang", "source", "i"), totals.select("lang", F.col("source").alias("item"), F.col("i").alias("j"))
    pairs = one.join(other, "lang").where("i != j").join(both, ["lang", "i", "j"], "left")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")) \
        .withColumn("rank", F.row_number().over(ranked))


def _terms(kept: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The best terms of each group: skybands of partitions, merged, then ranked by exact values."""
    rows = kept.sortWithinPartitions("term").select("lang", "term", "lang_n", F.explode("use").alias("u"))
    bands = skyband(rows.select("lang", "u.source", "term", "u.n", "lang_n"), top)
    dealt = bands.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(MERGE_PARTS))).sortWithinPartitions("term")
    shared = skyband(dealt, top).join(totals, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n") + 2, F.col("group_total")).alias("p"), _share(F.col("lang_n") + 2, F.col("lang_total")).alias("q"))
    valued = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _value(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
