"""Text similarity = 2 * LCS(a, b) / (len(a) + len(b)) (1.0 for two empty strings).

This is the indel-distance ratio (insert/delete cost 1, substitution 2), not Spark's
unit-cost `levenshtein`. The LCS length is computed with a bit-parallel recurrence on
Python integers inside an Arrow-batched pandas UDF (one call per batch of pairs).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, O(len(a) * len(b) / wordsize))."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        m = masks.get(ch)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def similarity(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    return 2.0 * lcs_length(a, b) / total


def _lcs_short(a: list[str], b: list[str]) -> np.ndarray:
    """LCS lengths of every a (64 characters at most) with every b: the recurrence on a matrix of words."""
    ids: dict[str, int] = {}
    masks = np.zeros((len(a), 1 + sum(map(len, a))), np.uint64)  # column 0: characters of no a
    for i, t in enumerate(a):
        for k, ch in enumerate(t):
            masks[i, ids.setdefault(ch, len(ids) + 1)] |= np.uint64(1 << k)
    masks = masks[:, :len(ids) + 1]
    codes = np.zeros((len(b), max(map(len, b), default=0)), np.int64)
    for j, t in enumerate(b):
        codes[j, :len(t)] = [ids.get(ch, 0) for ch in t]
    v = np.full((len(a), len(b)), np.iinfo(np.uint64).max, np.uint64)
    for k in range(codes.shape[1]):
        u = v & masks[:, codes[:, k]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def similarities(a: list[str], b: list[str]) -> np.ndarray:
    """(len a, len b) matrix of similarities; short texts are compared all at once."""
    la, lb = np.array([len(t) for t in a], np.int64), np.array([len(t) for t in b], np.int64)
    lcs = np.zeros((len(a), len(b)), np.int64)
    i, j = np.flatnonzero(la <= 64), np.flatnonzero(lb <= 256)
    if len(i) and len(j):
        lcs[np.ix_(i, j)] = _lcs_short([a[k] for k in i], [b[k] for k in j])
    for x, y in np.argwhere((la > 64)[:, None] | (lb > 256)[None, :]):
        lcs[x, y] = lcs_length(a[x], b[y])
    total = la[:, None] + lb[None, :]
    return np.where(total == 0, 1.0, 2.0 * lcs / np.maximum(total, 1))


@F.pandas_udf(T.IntegerType())
def lcs_length_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def lcs_len(a, b) -> Column:
    return lcs_length_udf(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def text_similarity(a, b) -> Column:
    """Similarity Column of two string Columns (Arrow UDF for the LCS, the rest JVM-side)."""
    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    total = F.length(ca) + F.length(cb)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * lcs_len(ca, cb) / total)
