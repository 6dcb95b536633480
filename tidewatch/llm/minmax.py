"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle hashes yields its minimum and its maximum, so 96 hash
evaluations give 192 signature values; both are unbiased estimators of the Jaccard similarity and
vary less together than two minima would. Bands of minima and as many of maxima give candidates; their
length follows from the threshold: at 0.85 six values in 32 bands, a pair at the threshold is missed
with probability (1 - 0.85**6)**32, about 3e-7; at 0.8 five values in 38 bands, about as much.

No bucket is expanded into its pairs. Equal sets collapse to one class; every member of a bucket is
confirmed against the bucket's leader, the first of four pseudo-random orders (one per bucket), so a
group of near copies gets a few leaders and not one per bucket; only members still in different
components of the same bucket are then compared with each other, each pair in the first bucket it
shares, inside the join that brings them together: behind a one-bit sketch of the signature, then on 32-bit codes of the full sets, whose
overlap is never below the true one but for codes that meet inside a set. It returns links, not
pairs, and these are confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import connected_components
from tidewatch.llm.tables import Scratch

PERMUTATIONS = 96
#: Probabilities to miss a pair at the threshold, by banding and by the one-bit sketch.
MISS_BANDS, MISS_BITS = 3e-7, 1e-7
ORDERS = 4
#: Candidate ids are broadcast to the texts up to this many (16 MB), beyond it joined by a shuffle.
BROADCAST_IDS = 1_000_000
SLAB = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_MULT = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BANDSEED = _rng.integers(1, 2**63, 2 * PERMUTATIONS, dtype=np.uint64)
_STEP = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def layout(percent: int) -> tuple[int, int]:
    """(values a band, most different sketch bits) for a threshold: the longest bands and the fewest bits that miss hardly any pair."""
    j = percent / 100
    rows = max((r for r in range(1, PERMUTATIONS + 1) if (1 - j**r) ** (2 * (PERMUTATIONS // r)) <= MISS_BANDS), default=1)
    n, p = 2 * PERMUTATIONS, (1 - j) / 2  # a bit differs if the values do, and then half the time
    bits, above = n, 0.0
    while bits > 0 and above + (step := math.comb(n, bits) * p**bits * (1 - p) ** (n - bits)) <= MISS_BITS:
        above += step
        bits -= 1
    return rows, bits


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _PLACE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


_POW = _powers(4096)


def _slab_words(b: np.ndarray) -> np.ndarray:
    space = _SPACE[b]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64)
    b, starts = b[starts[0]:], starts - starts[0]
    lens = np.diff(np.append(starts, len(b)))
    place = np.arange(len(b)) - np.repeat(starts, lens)
    pw = _POW if lens.max() <= len(_POW) else _powers(int(lens.max()))
    return _mix(np.add.reduceat(_BYTE[b] * pw[place], starts))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= SLAB:
        return _slab_words(b)
    out, at = [], 0
    while at < len(b):  # whole words only, a bounded piece of the text at a time
        end = min(len(b), at + SLAB)
        while end < len(b) and not _SPACE[b[end]]:
            end += 1
        out.append(_slab_words(b[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles (fewer words: one of the whole sequence)."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * _STEP[0] + w[i:len(w) - k + 1 + i] * _STEP[1])
    return np.unique(h)


def _signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    hi = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(s), 2048):
        v = _MULT[:, None] * s[None, i:i + 2048]
        np.minimum(lo, v.min(axis=1), out=lo)
        np.maximum(hi, v.max(axis=1), out=hi)
    return lo, hi


def _features(s: np.ndarray, rows: int) -> tuple:
    lo, hi = _signature(s)
    sig, used = np.concatenate((lo, hi)), PERMUTATIONS // rows * rows
    bands = np.concatenate((lo[:used], hi[:used])).reshape(-1, rows)
    h = _BANDSEED[:len(bands)]
    for j in range(rows):
        h = _mix(h ^ (bands[:, j] * _STEP[2 + j % 6]))
    bits = np.packbits((_mix(sig) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    d1, d2 = _mix(s + _STEP[0]).sum(dtype=np.uint64), _mix(s ^ _STEP[1]).sum(dtype=np.uint64)
    return h.view(np.int64).tolist(), *bits.tolist(), int(d1.view(np.int64)), int(d2.view(np.int64))


def _feature_rows(width: int, band: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"]):
                s = shingle_set(t, width)
                rows.append((i, len(s), *(_features(s, band) if len(s) else ([], 0, 0, 0, 0, 0))))
            yield pd.DataFrame(rows, columns=["id", "n", "bands", "s1", "s2", "s3", "d1", "d2"])

    return run


def _set_rows(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at:at + 500]
                sets = [shingle_set(t, width).view(np.int64) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"], "s": sets, "w": [s.astype(np.int32) for s in sets]})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    percent: int = 85) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept) of ``docs``, one per row.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| on their sets of word shingles;
    component_id is the smallest id reachable over links. Null, empty and blank texts have an empty
    set and link with nothing. Rows that repeat an id are one node of the graph and each get that
    node's component. A null id links with nothing: its component is null and kept is true. Only the
    two named columns are read, so further columns may have any name. Bands and sketches are laid out
    for ``percent``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minmax")
    band, max_bits = layout(percent)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feats = scratch.write(src.mapInPandas(
        _feature_rows(width, band), "id long, n long, bands array<long>, s1 long, s2 long, s3 long, d1 long, d2 long"))
    live = feats.df.where("n > 0 and id is not null")
    classes = scratch.write(live.groupBy("d1", "d2").agg(F.min("id").alias("cid"), F.count("*").alias("m")))
    reps = live.join(classes.df.select("d1", "d2", F.col("cid").alias("id")), ["d1", "d2", "id"], "left_semi")

    rows = reps.select("id", F.explode("bands").alias("key"))
    order = F.xxhash64("id", F.pmod("key", F.lit(ORDERS)))
    lead = rows.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id")).alias("lead"), F.min("id").alias("x"),
                                   F.max("id").alias("y")).where("x < y").select("key", F.col("lead.id").alias("lead"))
    members = scratch.write(rows.join(lead, "key"))
    sketch = scratch.write(reps.join(members.df.select("id").distinct(), "id", "left_semi").select(
        "id", "n", "s1", "s2", "s3"))

    def similar(a: str, b: str) -> str:
        return (f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and bit_count({a}.s1 ^ {b}.s1) "
                f"+ bit_count({a}.s2 ^ {b}.s2) + bit_count({a}.s3 ^ {b}.s3) <= {max_bits}")

    def overlap(slack: str, s: str) -> str:
        return f"(100 + {percent}) * (size(array_intersect(a.{s}, b.{s})) + {slack}) >= {percent} * (a.n + b.n)"

    # members with a partner in their bucket that may be linked, and their sets
    full = members.df.join(sketch.df, "id")
    cand = scratch.write(full.alias("a").join(full.drop("lead").alias("b"), F.expr(
        f"a.key = b.key and a.id != b.id and {similar('a', 'b')}"), "left_semi"))
    ids = scratch.write(cand.df.select("id").distinct())
    few = ids.df.count() <= BROADCAST_IDS
    sets = scratch.write(src.join(F.broadcast(ids.df) if few else ids.df, "id", "left_semi").mapInPandas(
        _set_rows(width), "id long, s array<long>, w array<int>"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        whole = sets.df.select("id", "s", F.size("s").alias("n"))
        both = pairs.join(whole.alias("b"), F.expr("b_id = b.id")).join(whole.alias("a"), F.expr("a_id = a.id"))
        return both.where(F.expr(overlap("0", "s"))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))

    # every member of a bucket with its leader
    star = cand.df.where("id != lead").select(F.col("lead").alias("a_id"), F.col("id").alias("b_id")).distinct()
    star = star.join(sketch.df.alias("a"), F.expr("a_id = a.id")).join(sketch.df.alias("b"), F.expr("b_id = b.id"))
    star = scratch.write(star.where(F.expr(similar("a", "b"))).select("a_id", "b_id"))
    first = scratch.write(confirmed(star.df))
    comp1 = scratch.write(connected_components(scratch, first.df))

    # members of one bucket that the leaders have not brought together
    tagged = cand.df.drop("lead").join(comp1.df, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    tagged = scratch.write(tagged).df
    open_keys = tagged.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    tagged = scratch.write(tagged.join(open_keys.select("key"), "key", "left_semi")).df
    apart = f"a.key = b.key and a.comp != b.comp and {similar('a', 'b')}"
    left = scratch.write(tagged.alias("a").join(tagged.alias("b"), F.expr(apart), "left_semi")).df
    keys = left.groupBy("id").agg(F.collect_set("key").alias("keys"))
    left = scratch.write(left.join(sets.df.select("id", "w"), "id").join(keys, "id")).df
    once = "a.key = array_min(array_intersect(a.keys, b.keys))"  # a pair meets in many buckets: it is compared in the first
    # two of a set's codes meet with probability n * n / 2**33
    met = "1 + greatest(a.n, b.n) / 10000"
    cross = left.alias("a").join(left.alias("b"), F.expr(f"{apart} and a.id < b.id and {once} and {overlap(met, 'w')}"))
    cross = scratch.write(cross.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")))
    second = scratch.write(confirmed(cross.df))
    if second.df.isEmpty():
        comps = comp1
    else:
        links = second.df
        for end in ("a", "b"):
            links = links.join(comp1.df.select(F.col("id").alias(end), F.col("comp").alias("c_" + end)), end, "left")
        over = connected_components(scratch, links.select(
            F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
        over = scratch.write(over).df
        comps = scratch.write(comp1.df.join(over.select(F.col("id").alias("comp"), F.col("comp").alias("up")), "comp", "left")
                              .select("id", F.coalesce("up", "comp").alias("comp"))
                              .unionByName(over.join(comp1.df.select("id"), "id", "left_anti")))
    scratch.clear(feats, classes, comps)

    copies = classes.df.where("m > 1").select("d1", "d2", "cid")
    out = feats.df.select("id", "n", "d1", "d2").join(copies, ["d1", "d2"], "left").select(
        "id", "n", F.coalesce(F.when(F.col("n") > 0, F.col("cid")), F.col("id")).alias("cid"))
    out = out.join(comps.df.select(F.col("id").alias("cid"), "comp"), "cid", "left")
    comp = F.coalesce("comp", "cid")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), comp).alias("component_id"),
                      F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
