"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens of a text that are new to a task are laid end to end as one linked list of symbols. Every adjacent
pair whose bytes are a vocabulary entry puts its position into the bucket of that entry's rank; a bitmap of three
levels, 64 bits a word, marks the buckets in use. Finding the first set bit gives the lowest rank; its positions are
merged from left to right, and each merge puts the two new neighbour pairs into their buckets. Entries whose pair has
changed since are stale and skipped. The positions of a large bucket are merged together with numpy, on the same lists, unless
two of them overlap or a merge brings up a lower rank. The work is linear in the number of merges, so a pre-token of any length is
encoded whole. Short pre-tokens are remembered with their ids.

A vocabulary is a file of ranks (base64 of the bytes, then the rank, per line); ids are ranks.
"""

from __future__ import annotations

import base64
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Remembered pre-tokens per worker and generation, and the longest one that is remembered.
CACHE = 150_000
CACHE_BYTES = 48
#: Bytes of new pre-tokens that share one queue (a longer one has its own).
QUEUE_BYTES = 1 << 20
#: Positions of a bucket from which on it is merged with numpy.
LARGE = 48
#: Bytes of text per output batch (a longer text is a batch of its own).
BATCH_BYTES = 2 << 20


class RankQueue:
    """Buckets of positions by rank; ``lowest`` finds the first rank in use by its bitmap."""

    def __init__(self, size: int):
        self.buckets: list[list[int] | None] = [None] * size
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = 0  # one bit per word of `mid`, as wide as the vocabulary needs

    def push(self, rank: int, positions: list[int]) -> None:
        held = self.buckets[rank]
        if held is None:
            self.buckets[rank] = positions
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            held += positions

    def lowest(self) -> int:
        """The lowest rank with a bucket, -1 if there is none."""
        if not self.top:
            return -1
        w = (self.top & -self.top).bit_length() - 1
        m = self.mid[w]
        w = w << 6 | (m & -m).bit_length() - 1
        m = self.low[w]
        return w << 6 | (m & -m).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        held, self.buckets[rank] = self.buckets[rank], None
        w = rank >> 6
        self.low[w] &= ~(1 << (rank & 63))
        if not self.low[w]:
            self.mid[w >> 6] &= ~(1 << (w & 63))
            if not self.mid[w >> 6]:
                self.top &= ~(1 << (w >> 6))
        return held


class Vocabulary:
    """Entries and, unless it only decodes, ranks and mergeable pairs of one rank file."""

    def __init__(self, path: str, pattern: str, encodes: bool = True):
        self.split = regex.compile(pattern)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.entries = {r: b for b, r in self.ranks.items()}
        if len(self.entries) != len(self.ranks) or any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("ranks must be distinct and cover all single bytes")
        self.size = max(self.entries) + 1
        lengths = np.zeros(self.size, np.int64)
        for r, b in self.entries.items():
            lengths[r] = len(b)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.entries.get(r, b"") for r in range(self.size)), np.uint8)
        del self.entries
        if not encodes:
            del self.ranks
            return
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs: dict[int, int] = {}  # left id and right id -> rank of both together
        for entry, rank in self.ranks.items():
            for cut in range(1, len(entry)):
                left, right = self.ranks.get(entry[:cut]), self.ranks.get(entry[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self._hash_pairs()
        self.byte_pairs = np.array([[self.pairs.get(a << 32 | b, -1) for b in self.byte_ids.tolist()] for a in self.byte_ids.tolist()], np.int32)
        #: Remembered pre-tokens: those of the present generation and of the one before it.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (none empty) as the bytes of int32 numbers: all in one linked list, with one rank queue."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        rank = np.full(n, -1, np.int32)
        rank[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        rank[ends - 1] = -1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        ids, cur, nxt, prv = lists = tuple(array("i", x.astype(np.int32).tobytes()) for x in (self.byte_ids[raw], rank, after, before))
        views = tuple(np.frombuffer(x, np.int32) for x in lists)
        queue, pair_rank = RankQueue(self.size), self.pairs.get
        buckets = queue.buckets
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for part in np.split(at, cuts) if len(at) else ():
            queue.push(int(rank[part[0]]), part.tolist())
        while (r := queue.lowest()) >= 0:
            todo = queue.take(r)
            if len(todo) >= LARGE and self._merge_all(r, todo, queue, *views):
                continue
            todo.sort()
            for k, i in enumerate(todo):
                if cur[i] != r:
                    continue  # stale: the pair has changed or is gone
                lower = False
                j = nxt[i]
                ids[i] = r
                cur[j] = -1
                ids[j] = -1
                j = nxt[i] = nxt[j]
                if j >= 0:
                    prv[j] = i
                    cur[i] = x = pair_rank(r << 32 | ids[j], -1)
                    if x >= 0:
                        if buckets[x]:
                            buckets[x].append(i)
                        else:
                            queue.push(x, [i])
                        lower = x < r
                else:
                    cur[i] = -1
                h = prv[i]
                if h >= 0:
                    cur[h] = x = pair_rank(ids[h] << 32 | r, -1)
                    if x >= 0:
                        if buckets[x]:
                            buckets[x].append(h)
                        else:
                            queue.push(x, [h])
                        lower = lower or x < r
                if lower:  # a rank below this one has come up: it goes first
                    if k + 1 < len(todo):
                        queue.push(r, todo[k + 1:])
                    break
        left = views[0]
        alive = left >= 0
        count = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))]
        flat, bound = left[alive].tobytes(), (4 * count).tolist()
        return [flat[a:b] for a, b in zip(bound, bound[1:])]

    def _hash_pairs(self) -> None:
        """The pairs as a sparse open hash table of arrays, for many look-ups at once."""
        keys, ranks = (np.array(list(x), np.int64) for x in (self.pairs.keys(), self.pairs.values()))
        self.slot_bits = max(10, len(keys).bit_length() + 3)
        self.slot_keys = np.full((1 << self.slot_bits) + 64, -1, np.int64)
        self.slot_ranks = np.full(len(self.slot_keys), -1, np.int32)
        at = self._slot(keys)
        while len(keys):  # of those that want one free slot the first takes it, the rest go one further
            free = self.slot_keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            takes = np.zeros(len(at), bool)
            takes[first] = True
            takes &= free
            self.slot_keys[at[takes]], self.slot_ranks[at[takes]] = keys[takes], ranks[takes]
            keys, ranks, at = keys[~takes], ranks[~takes], at[~takes] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _pair_ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is no entry."""
        at = self._slot(keys)
        seen = self.slot_keys[at]
        out = np.where(seen == keys, self.slot_ranks[at], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            at[open_] += 1
            seen = self.slot_keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.slot_ranks[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def _merge_all(self, r: int, todo: list[int], queue: RankQueue, ids: np.ndarray, cur: np.ndarray, nxt: np.ndarray, prv: np.ndarray) -> bool:
        """Merge all positions of a bucket at once; False, with nothing changed, if their order matters."""
        at = np.array(todo, np.int32)
        at = at[cur[at] == r]
        gone = nxt[at]
        if (cur[gone] == r).any():  # overlapping pairs
            return False
        after, before = nxt[gone], prv[at]
        has = after >= 0
        behind = after[has]
        old = ids[at], ids[gone], prv[behind]
        ids[at], ids[gone], nxt[at], prv[behind], cur[at] = r, -1, after, at[has], -2
        before = before[before >= 0]
        before = np.where(ids[before] < 0, prv[before], before)  # the left neighbour may have been merged as well
        near = np.concatenate((at, before[cur[before] != -2]))
        pairs = near[nxt[near] >= 0]
        rank = self._pair_ranks(ids[pairs].astype(np.int64) << 32 | ids[nxt[pairs]])
        new = rank >= 0
        if (rank[new] < r).any():
            ids[at], ids[gone], nxt[at], prv[behind], cur[at] = old[0], old[1], gone, old[2], r
            return False
        cur[gone] = cur[near] = -1
        rank, pairs = rank[new], pairs[new]
        cur[pairs] = rank
        order = np.argsort(rank, kind="stable")
        rank, pairs = rank[order], pairs[order].tolist()
        cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(pairs)]
        for i, j, x in zip(cuts, cuts[1:], rank[cuts[:-1]].tolist() if pairs else ()):
            queue.push(x, pairs[i:j])
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each as the bytes of int32 numbers. A pre-token that is a vocabulary entry is that entry."""
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        known, older, longer = self.known, self.older, {}
        split = [self.split.findall(t) for t in texts]
        todo: list[tuple[str, bytes]] = []
        size = 0
        for w in set().union(*split).difference(known):
            ids = older.get(w)
            if ids is not None:
                known[w] = ids
                continue
            b = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            if whole is not None:
                known[w] = whole.to_bytes(4, sys.byteorder)
                continue
            todo.append((w, b))
            size += len(b)
            if size >= QUEUE_BYTES:
                self._learn(todo, known, longer)
                todo, size = [], 0
        self._learn(todo, known, longer)
        ids_of = ({**known, **longer} if longer else known).__getitem__
        return [b"".join(map(ids_of, words)) for words in split]

    def _learn(self, todo: list[tuple[str, bytes]], known: dict, longer: dict) -> None:
        for (w, b), ids in zip(todo, self.merge([b for _, b in todo]) if todo else ()):
            (known if len(b) <= CACHE_BYTES else longer)[w] = ids

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.lengths[ids].all()):
            raise ValueError("ids that are not in the vocabulary")
        size = self.lengths[ids]
        upto = np.cumsum(size)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.starts[ids] - (upto - size), size)
        return self.bytes[at]


def _vocabulary(name: str, pattern: str | None, encodes: bool) -> Vocabulary:
    """The vocabulary of this worker; ``name`` is a file that ``public_tokenizers`` finds on every executor.

    It is kept, with what it has learned, in a module of the worker process: this package's own variables
    are shipped anew with every task.
    """
    import public_tokenizers

    kept = sys.modules.setdefault("_tidewatch_worker", types.ModuleType("_tidewatch_worker")).__dict__.setdefault("vocabularies", {})
    if (name, pattern, encodes) not in kept:
        kept[name, pattern, encodes] = Vocabulary(public_tokenizers.path(name), pattern or public_tokenizers.PATTERN, encodes)
    return kept[name, pattern, encodes]


def _encode_rows(name: str, pattern: str | None):
    def batch(ids: list, texts: list[str], v: Vocabulary) -> pa.RecordBatch:
        tokens = v.encode(texts)
        cut = np.concatenate(([0], np.cumsum([len(t) // 4 for t in tokens])))
        flat = np.frombuffer(b"".join(tokens), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat))], ["id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(name, pattern, True)
        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column("id").to_pylist(), b.column("text")):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield batch(ids, texts, v)
                    ids, texts, size = [], [], 0
            if ids:
                yield batch(ids, texts, v)

    return run


def _decode_rows(ids_col: str, out_col: str, name: str, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(name, pattern, False)
        for b in batches:
            lists = b.column(ids_col)
            upto = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            at = 0
            while at < len(b):  # about BATCH_BYTES of ids at once
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + BATCH_BYTES // 4, "right")) - 1)
                part = lists.slice(at, to - at)
                flat = part.flatten()
                data = v.decode(flat.fill_null(-1).to_numpy(zero_copy_only=False))
                ends = np.concatenate(([0], np.cumsum(v.lengths[flat.fill_null(-1).to_numpy(zero_copy_only=False)])))
                bound = ends[upto[at:to + 1] - upto[at]].tolist()
                raw, none = data.tobytes(), part.is_null().to_pylist()
                out = pa.array([None if z else raw[i:j] for i, j, z in zip(bound, bound[1:], none)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.slice(at, to - at).columns, out], [*b.schema.names, out_col])
                at = to

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_50k.tiktoken",
           pattern: str | None = None) -> DataFrame:
    """Rows (id, ids array<int>), one per row of ``docs``: the token ids of the whole text.

    ``pattern`` cuts a text into pre-tokens (default: that of the public tokenizers); each is encoded by itself,
    without special tokens. Null and empty texts have no ids (an empty array). Repeated rows and null ids of
    documents are kept; a text or a pre-token of any length is encoded whole, in one task; only the two named
    columns are read; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_encode_rows(ranks, pattern), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks: str = "byte_bpe_50k.tiktoken",
           pattern: str | None = None) -> DataFrame:
    """``df`` with the bytes of its token ids as a binary column.

    A null array decodes to null, an empty one to no bytes; null ids and unknown ids inside an array raise
    ValueError in the task, as there are no bytes for them. ``out_col`` must be a new name. Rows are kept as they
    are, repeated ones too; an empty table gives no rows.
    """
    if out_col in df.columns:
        raise ValueError(f"column {out_col} is there already")
    schema = StructType([*df.schema.fields, StructField(out_col, BinaryType())])
    return df.mapInArrow(_decode_rows(ids_col, out_col, ranks, pattern), schema)


def round_trip_digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256) of ``decode(encode(docs))``: digests of the decimal ids joined
    by one space, and of the decoded bytes. One row per row."""
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
