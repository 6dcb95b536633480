"""Language identification by error-correcting output codes.

Every language has a codeword; each of its bits is predicted by a binary linear classifier over hashed
character n-grams (log-odds of the languages with the bit against those without, all languages equally
heavy). Decoding is loss-weighted: a language costs the sum of logistic losses of its bits' margins,
the cheapest wins, and texts whose two cheapest are close are flagged as ambiguous.

The classifiers come from n-gram counts of all training texts, summed in the tasks and then by
(language, n-gram bucket): a bounded table, whatever the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, ORDERS, PIECE = 14, (1, 2, 3), 1 << 18
DIM = len(ORDERS) << BITS
AMBIGUOUS = 0.8
_A = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the text's letter n-grams, words bounded by one blank; a bounded piece of the text at a time."""
    text = text or ""
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(f" {text[at:at + PIECE].lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        c[~_letters()[c]] = 0
        c = c[(c > 0) | np.concatenate(([True], c[:-1] > 0))]
        if len(c) < 2 or not c.any():
            continue
        h, out = c * _A, []
        for k, order in enumerate(ORDERS):
            n = len(c) - order + 1
            if n <= 0:
                break
            if order > 1:
                h = (h[:n] ^ (h[:n] >> np.uint64(29))) * _A + c[order - 1:]
            x = (h[:n] ^ (h[:n] >> np.uint64(31))) * _A
            x = (x >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS)
            out.append(x[c > 0] if order == 1 else x)
        yield np.concatenate(out)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: the exhaustive code up to six classes, else pseudo-random balanced columns."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        cols = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).T
    rng = np.random.Generator(np.random.PCG64(n))
    half = np.where(np.arange(n) % 2 == 0, 1, -1)
    return np.array([rng.permutation(half) for _ in range(int(10 * np.ceil(np.log2(n))))], np.int8).T


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: (languages, DIM) n-gram counts of the training texts."""
        self.langs, self.code = langs, codewords(len(langs))
        p = np.empty(counts.shape)
        for k in range(len(ORDERS)):
            part = counts[:, k << BITS:(k + 1) << BITS] + 0.5
            p[:, k << BITS:(k + 1) << BITS] = part / part.sum(axis=1, keepdims=True)
        pos, neg = (self.code > 0).astype(float), (self.code < 0).astype(float)
        self.weights = (np.log(pos.T @ p / np.maximum(pos.sum(0), 1)[:, None])
                        - np.log(neg.T @ p / np.maximum(neg.sum(0), 1)[:, None])).T.astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        margins, n = np.zeros(self.code.shape[1]), 0
        for x in ngrams(text):
            n += len(x)
            margins += self.weights[x].sum(axis=0, dtype=np.float64) if len(x) < 50_000 else \
                np.bincount(x, minlength=DIM) @ self.weights
        if not n or not self.langs:
            return "und", 0.0, True
        loss = np.logaddexp(0, -self.code * margins[None, :]).sum(axis=1) / max(1, self.code.shape[1]) * 2
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < AMBIGUOUS)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(DIM, np.int64))
    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            for x in ngrams(text):
                total[lang] += np.bincount(x, minlength=DIM)
    for lang, c in total.items():
        i = np.flatnonzero(c)
        yield pd.DataFrame({"lang": lang, "bucket": i, "n": c[i]})


def fit(labelled: DataFrame) -> Model:
    """A model from rows (text, lang); rows with a null lang are left out, null texts add nothing, repeated rows count each.

    An empty table gives a model without languages, which predicts ``und``. The driver gets one row per language and
    bucket that occurs: at most 49,152 a language, so ``lang`` must hold languages and not free text.
    """
    found = labelled.where("lang is not null").select("text", "lang").mapInPandas(_counts, "lang string, bucket int, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), DIM))
    counts[np.searchsorted(langs, found["lang"]), found["bucket"]] = found["n"]
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, ambiguous), one per row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was
    learned; with one learned language every other text is that language. Repeated rows get equal
    rows; only the two named columns are read; an empty table gives no rows.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [model.predict(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got],
                                "ambiguous": [g[2] for g in got]})

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(run, "id long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)
