"""Near-duplicate vectors: int8 tile products with rigorous error bounds.

A unit vector x is stored as scale * q + e with int8 codes q and the exact norm of its residual e, so
|cos(x, y) - scale_x * scale_y * <q_x, q_y>| <= |scale_x q_x| |e_y| + |e_x|. The residual has int8 codes and a
norm of what they leave in turn. Tiles of vectors are multiplied on their first codes; a pair whose interval
contains the threshold is multiplied again on both codes, which narrows it more than a hundredfold; a pair that
is open even then is decided in double precision. Pairs whose interval lies above the threshold are links, all
others are below it. No link is lost. Tiles carry two bytes a dimension; full vectors are fetched by id
for the open pairs alone, of which there are hardly any.

A tile returns one row per vector with links (their number, and one neighbour that spans the
vector's component inside the tile), and of its pairs only the open ones. Equal vectors collapse to one weighted class
first, so copies cost nothing. Work is one product per pair of tiles, which is what an exact
answer over unclustered vectors takes; tiles are independent tasks of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import connected_components
from tidewatch.llm.tables import Scratch

TILE = 6144
STRIP = 512


def _codes(u: np.ndarray) -> tuple[np.ndarray, float]:
    """Int8 codes of a vector and their scale."""
    scale = float(np.abs(u).max()) / 127 or 1.0
    return np.rint(u / scale).astype(np.int8), scale


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, v in zip(b["id"], b["v"]):
            if i is None or v is None or pd.isna(i):
                continue
            x = np.array([np.nan if c is None else c for c in v], np.float64)
            if not len(x) or not np.isfinite(x).all() or not x.any():
                continue
            x = x / np.abs(x).max()
            u = x / np.sqrt(np.dot(x, x))
            q, scale = _codes(u)
            e = u - q * scale
            r, fine = _codes(e)
            rows.append((int(i), len(u), q.tobytes(), scale, float(np.linalg.norm(q * scale)), float(np.linalg.norm(e)),
                         r.tobytes(), fine, float(np.linalg.norm(e - r * fine)), u.tobytes()))
        yield pd.DataFrame(rows, columns=["id", "dim", "q", "scale", "qn", "en", "r", "fine", "rn", "u"])


def _stack(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    dim = int(pdf["dim"].iloc[0])
    out = {c: np.frombuffer(b"".join(pdf[c]), np.int8).reshape(-1, dim) for c in ("q", "r")}
    return {**out, **{c: pdf[c].to_numpy() for c in ("id", "m", "scale", "qn", "en", "fine", "rn")}}


def _settle(lab: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
    """Smallest-label union of the pairs (r, c) into ``lab``."""
    while len(r):
        lr, lc = lab[r], lab[c]
        low, high = np.minimum(lr, lc), np.maximum(lr, lc)
        open_ = low < high
        if not open_.any():
            return
        r, c, low, high = r[open_], c[open_], low[open_], high[open_]
        np.minimum.at(lab, high, low)
        while True:
            nxt = lab[lab]
            if (nxt == lab).all():
                break
            lab[:] = nxt


def tile_links(a: dict, b: dict, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted link counts of the rows of a and of b, component labels over both (b after a), and the open pairs."""
    dim, n = a["q"].shape[1], len(a["id"])
    exact = dim * 127 * 127 < 1 << 24  # float32 adds the products of codes without rounding
    slack = 1e-12 if exact else 2.0**-22 * dim
    ca, cb = np.zeros(n, np.int64), np.zeros(len(b["id"]), np.int64)
    lab = np.arange(n if same else n + len(cb))
    off = 0 if same else n
    worst = float(a["qn"].max() * b["en"].max() + a["en"].max()) + slack + 1e-6
    right, open_ = b["q"].T.astype(np.float32), []
    for at in range(0, n, STRIP):
        product = a["q"][at:at + STRIP].astype(np.float32) @ right
        least = ((threshold - worst) / a["scale"][at:at + STRIP]).astype(np.float32)
        r, c = np.nonzero(product * b["scale"].astype(np.float32) >= least[:, None])
        near = product[r, c].astype(np.float64)
        r = r + at
        if same:
            keep = r < c
            r, c, near = r[keep], c[keep], near[keep]
        near *= a["scale"][r] * b["scale"][c]
        bound = a["qn"][r] * b["en"][c] + a["en"][r] + slack
        link, maybe = near - bound >= threshold, np.abs(near - threshold) < bound
        for i in range(0, len(r), 1 << 15):  # both codes
            part = np.flatnonzero(maybe[i:i + (1 << 15)]) + i
            x, y = (s["q"][k] * s["scale"][k][:, None] + s["r"][k] * s["fine"][k][:, None] for s, k in ((a, r[part]), (b, c[part])))
            near[part] = np.einsum("ij,ij->i", x, y)
            bound[part] = (1 + a["rn"][r[part]]) * b["rn"][c[part]] + a["rn"][r[part]] + 1e-12
        link |= maybe & (near - bound >= threshold)
        still = maybe & (np.abs(near - threshold) < bound)
        open_.append(np.column_stack((a["id"][r[still]], b["id"][c[still]])))
        r, c = r[link], c[link]
        np.add.at(ca, r, b["m"][c])
        np.add.at(cb, c, a["m"][r])
        _settle(lab, r, c + off)
    return ca, cb, lab, np.concatenate(open_)


def _tile(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        first = (pdf["block"] == pdf["i"]).to_numpy()
        if not first.any() or (first.all() and not same):  # the other block is empty
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("id", "links", "other")})
        a = _stack(pdf[first])
        b = a if same else _stack(pdf[~first])
        ca, cb, lab, pairs = tile_links(a, b, same, threshold)
        ids = a["id"] if same else np.concatenate((a["id"], b["id"]))
        links = ca + cb if same else np.concatenate((ca, cb))
        on = links > 0
        return pd.concat([pd.DataFrame({"id": ids[on], "links": links[on], "other": ids[lab[on]]}),
                          pd.DataFrame({"id": pairs[:, 0], "links": np.zeros(len(pairs), np.int64), "other": pairs[:, 1]})])

    return run


def _decide(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            link = [np.dot(np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)) >= threshold for x, y in zip(b["u"], b["v"])]
            yield b.loc[np.array(link, bool), ["a", "b", "ma", "mb"]]

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                 tile: int = TILE) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of ``df``.

    Links are all pairs of rows whose cosine, in double precision, is at least ``threshold``. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
    of different length or rows with a null id (component null, kept true). Rows that repeat an id
    with one vector count once as a partner. Only the two named columns are read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    prep = scratch.write(src.distinct().mapInPandas(
        _prepare, "id long, dim int, q binary, scale double, qn double, en double, r binary, fine double, rn double, u binary")
        .withColumns({"h1": F.xxhash64("u"), "h2": F.xxhash64(F.lit(7), "u")}))
    classes = scratch.write(prep.df.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("m")))
    reps = scratch.write(prep.df.join(classes.df, ["h1", "h2", "id"]).drop("h1", "h2")).df
    n = max(1, -(-classes.df.count() // tile))
    coded = reps.drop("u").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    tiles = coded.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select(
        "*", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j")).drop("k")
    found = scratch.write(tiles.groupBy("i", "j", "dim").applyInPandas(
        _tile(threshold), "id long, links long, other long"))
    linked = found.df.where("links > 0")
    pairs = found.df.where("links = 0").select(F.col("id").alias("a"), F.col("other").alias("b"))  # open: decided on full vectors
    pairs = pairs.join(reps.select(F.col("id").alias("a"), F.col("m").alias("ma"), "u"), "a").join(
        reps.select(F.col("id").alias("b"), F.col("m").alias("mb"), F.col("u").alias("v")), "b")
    pairs = scratch.write(pairs.mapInPandas(_decide(threshold), "a long, b long, ma long, mb long")).df
    both = pairs.select(F.col("a").alias("id"), F.col("mb").alias("links"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("id"), F.col("ma").alias("links"), F.col("a").alias("other")))
    linked = linked.unionByName(both)
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(scratch, linked.select(F.col("id").alias("a"), F.col("other").alias("b")))
    node = prep.df.select("id", "h1", "h2").join(
        classes.df.select("h1", "h2", F.col("id").alias("cid"), "m"), ["h1", "h2"])
    node = node.join(counts.select(F.col("id").alias("cid"), "links"), "cid", "left").join(
        comps.select(F.col("id").alias("cid"), "comp"), "cid", "left").groupBy("id").agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.min(F.coalesce("comp", "cid")).alias("comp"))
    out = src.select("id").join(node, "id", "left")
    comp = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("id").isNotNull(), comp).alias("component_id"),
                      F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
