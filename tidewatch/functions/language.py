"""the language of a text by ranked character n-gram profiles.

The n-grams (one to three characters) of a text's words, bounded by blanks, are ranked by their number; a language's
profile is the ranking of all its texts. A text's distance from a language is how far its own grams are out of place
there, summed up; a gram that the profile does not hold counts as `PROFILE` places. Profiles come from labelled rows, counted by
Spark; comparing is an Arrow function over whole batches. All numbers are integers, ties go by gram and by language.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Grams of a profile and of a text that are compared, the most frequent ones.
PROFILE = 400
_WORDS = regex.compile(r"\p{L}+")


def _coded(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(code, number) of the n-grams of a text's words, by code; a blank alone is none. A gram's code holds its characters'
    numbers in 21 bits each, so codes are ordered as the grams are."""
    words = _WORDS.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # neighbours share the blank between them, which is the middle of no gram
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    one, two = c << 42, (c[:-1] << 42) | (c[1:] << 21)
    three = (two[:-1] | c[2:])[c[1:-1] != 32]
    codes, n = np.unique(np.concatenate((one[c != 32], two, three)), return_counts=True)
    return codes, n.astype(np.int64)


def _code(gram: str) -> int:
    return sum(ord(ch) << (42 - 21 * i) for i, ch in enumerate(gram))


def _gram(code: int) -> str:
    return "".join(chr(c) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


def grams(text: str | None) -> Counter:
    """The n-grams of a text's words with their numbers; a blank alone is none."""
    codes, n = _coded(text)
    return Counter(dict(zip(map(_gram, codes.tolist()), n.tolist())))


def ranked(counts: Counter) -> list[str]:
    """The `PROFILE` most frequent grams, ties in the order of their characters."""
    return sorted(sorted(counts), key=counts.__getitem__, reverse=True)[:PROFILE]  # both sorts are stable


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))[:len(codes)]
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _gram_counts(batches):
    for b in batches:
        by_lang: dict[str, list] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            parts = by_lang.setdefault(lang, [])
            parts.append(_coded(text.as_py()))
            if len(parts) >= 256:
                parts[:] = [_summed(parts)]
        for lang, parts in by_lang.items():
            codes, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array([_gram(c) for c in codes.tolist()], pa.string()),
                                              pa.array(n, pa.int64())], ["lang", "gram", "n"])


def language_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, rank) with ranks from 0: the profile of each language of the labelled rows; rows without a language are
    left out. At most `PROFILE` rows a language."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = rows.mapInArrow(_gram_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE).select("lang", "gram", "rank")


def collected(profiles: DataFrame) -> dict[str, dict[str, int]]:
    """The profiles as a dict for `language_of`: `PROFILE` numbers a language."""
    out: dict[str, dict[str, int]] = {}
    for r in profiles.collect():
        out.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    return out


def _table(profiles: dict[str, dict[str, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, codes of all their grams, rank by language and code; -1: not in its profile)."""
    langs = sorted(profiles)
    codes = np.array(sorted({_code(g) for rank in profiles.values() for g in rank}), np.int64)
    ranks = np.full((len(langs), len(codes)), -1, np.int64)
    for k, lang in enumerate(langs):
        ranks[k, np.searchsorted(codes, np.array([_code(g) for g in profiles[lang]], np.int64))] = list(profiles[lang].values())
    return langs, codes, ranks


def _nearest(text: str | None, langs: list[str], codes: np.ndarray, ranks: np.ndarray) -> str | None:
    own, n = _coded(text)
    if not len(own) or not langs:
        return None
    own = own[np.argsort(-n, kind="stable")[:PROFILE]]
    if not len(codes):
        return langs[0]
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    rank = ranks[:, at]
    away = np.where((codes[at] == own) & (rank >= 0), np.abs(rank - np.arange(len(own))), PROFILE).sum(axis=1)
    return langs[int(away.argmin())]  # the first of the nearest


def nearest_language(text: str | None, profiles: dict[str, dict[str, int]]) -> str | None:
    """The language whose profile is nearest, None for a text without letters."""
    return _nearest(text, *_table(profiles))


def language_of(text, profiles: dict[str, dict[str, int]]) -> Column:
    """The nearest language of each text as a Column; null for null texts, texts without letters, and without profiles."""
    known = _table(profiles)

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([_nearest(t.as_py(), *known) for t in texts], pa.string())

    return F.arrow_udf(batch, StringType())(F.col(text) if isinstance(text, str) else text)
