"""Token counts by rank-synchronous byte-pair merging on ragged numpy arrays.

Texts are split as the byte-level tokenizer file says: added special strings first, then the
pre-token pattern. Distinct pre-tokens of a batch become one flat array of symbol ids with sequence
bounds. Each round looks up the rank of every adjacent pair, finds the lowest rank of each sequence
and merges all its non-overlapping occurrences in all sequences at once, until no pair has a rank;
the surviving symbols are counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000
#: Longer pre-tokens are counted but not kept in the cache.
CACHE_CHARS = 64


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Merges:
    """Byte symbols, merge ranks and added strings of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE files with the standard pattern and no normalizer or prefix space")
        vocab = spec["model"]["vocab"]
        self.byte_ids = np.array([vocab[c] for c in _byte_alphabet()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        to = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.to = key[order], order.astype(np.int64), to
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("only added tokens matched verbatim")
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def lengths(self, pretokens: list[str]) -> np.ndarray:
        """Number of symbols left of each pre-token."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), size)
        out = size.copy()
        while len(sym) > 1:
            key = sym[:-1] << 32 | sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], np.iinfo(np.int64).max)
            # a sequence without a mergeable pair is finished and leaves the arrays
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            low = np.minimum.reduceat(np.append(rank, np.iinfo(np.int64).max), starts)
            count = np.diff(np.append(starts, len(seq)))
            live = np.repeat(low < np.iinfo(np.int64).max, count)
            if not live.any():
                break
            hit = np.append(rank == np.repeat(low, count)[:-1], False) & live
            # of overlapping occurrences (runs), every second one counting from the left
            idx = np.flatnonzero(hit)
            run = np.concatenate(([True], np.diff(idx) > 1))
            pos = np.arange(len(idx)) - np.maximum.accumulate(np.where(run, np.arange(len(idx)), 0))
            idx = idx[pos % 2 == 0]
            sym = sym.copy()
            sym[idx] = self.to[rank[idx]]
            out -= np.bincount(seq[idx], minlength=len(out))
            live[idx + 1] = False
            sym, seq = sym[live], seq[live]
        return out

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens between added strings; an added string itself is the one-item list [None]."""
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            yield self.split.findall(text[at:m.start()])
            yield [None]
            at = m.end()
        yield self.split.findall(text[at:] if at else text)

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE:
            self.known.clear()
        known, long = self.known, {}
        out, todo = [], {}
        split = [list(self.pieces(t)) for t in texts]
        for parts in split:
            for p in parts:
                todo.update((x, None) for x in p if x is not None and x not in known)
        fresh = list(todo)
        for i in range(0, len(fresh), 50_000):
            part = fresh[i:i + 50_000]
            for x, n in zip(part, self.lengths(part).tolist()):
                (known if len(x) <= CACHE_CHARS else long)[x] = n
        table = known if not long else {**known, **long}
        for parts in split:
            out.append(sum(1 if p == [None] else sum(map(table.__getitem__, p)) for p in parts))
        return out


_MERGES: dict[str, Merges] = {}


def _count_rows(name: str, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        m = _MERGES.get(name)
        if m is None:
            m = _MERGES[name] = Merges(public_tokenizers.path(name))
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                texts = [t or "" for t in part["text"]]
                n = m.counts(texts)
                yield pd.DataFrame({"id": part["id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                                    "n_tokens": n, "over_limit": [x > limit for x in n]})

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one per row of ``docs``.

    Whole texts; null and empty texts have no tokens. ``tokenizer`` names a byte-level BPE file that
    ``public_tokenizers.path`` finds on every executor. Repeated rows are counted each; only the two
    named columns are read; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInPandas(_count_rows(tokenizer, limit), "id long, n_bytes long, n_tokens long, over_limit boolean") \
        .withColumnRenamed("id", id_col)
