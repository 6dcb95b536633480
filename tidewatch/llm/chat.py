"""Chat formatting on token ids.

Every role and text is encoded on its own and the template's marks are spliced in as reserved ids
above the vocabulary, so no text can produce a mark. The rendered form of a turn is

    <s>{role}[INST]{text}</s>      a prompt turn
    <s>{role}[/INST]{text}</s>     a trained turn (its text is under the loss mask)

and control strings inside roles and texts are escaped with a backslash behind their first character
(a backslash itself is doubled), which ``unescape`` undoes. Offsets and loss spans are prefix sums
over the turns of a conversation.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, PROMPT, TRAINED, END = "<s>", "[INST]", "[/INST]", "</s>"
MARKS = (START, PROMPT, TRAINED, END)
_CONTROL = re.compile("|".join(map(re.escape, ("\\", *MARKS))))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """``text`` without any mark in it; reversible."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """Byte-pair encoder of one vocabulary file plus the template's reserved ids."""

    def __init__(self, tokenizer: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(tokenizer), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.base = max(ranks.values()) + 2  # the first id above the vocabulary stays free
        self.reserved = {m: self.base + i for i, m in enumerate(MARKS)}

    def encode(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def decode(self, ids) -> str:
        return self.enc.decode_bytes(list(ids)).decode("utf-8")

    def render(self, ids) -> str:
        """The formatted text of a sequence of ids."""
        out, run = [], []
        for i in ids:
            if i >= self.base:
                out.append(self.decode(run) + MARKS[i - self.base])
                run = []
            else:
                run.append(i)
        return "".join(out) + self.decode(run)


_CODECS: dict[str, Codec] = {}


def codec(tokenizer: str) -> Codec:
    if tokenizer not in _CODECS:
        _CODECS[tokenizer] = Codec(tokenizer)
    return _CODECS[tokenizer]


def _encode_rows(tokenizer: str, trained: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(tokenizer)
        s, e = c.reserved[START], c.reserved[END]
        for b in batches:
            ids, at, n = [], [], []
            for role, text in zip(b["role"], b["text"]):
                role, text = role or "", text or ""
                loss = role in trained
                head = [s, *c.encode(escape(role)), c.reserved[TRAINED if loss else PROMPT]]
                body = c.encode(escape(text))
                ids.append(np.array([*head, *body, e], np.int32))
                at.append(len(head))
                n.append(len(body) if loss else 0)
            yield b[["conv_id", "turn", "role", "text"]].assign(ids=ids, text_at=at, n_loss=n)

    return run


def format_conversations(turns: DataFrame, trained: tuple[str, ...] = ("assistant",),
                         tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per turn: conv_id, seq (0, 1, ...), ids, start, loss_start, loss_end.

    ``turns`` has conv_id, turn, role, text. The ids of a conversation are its rows' ``ids`` in order
    of ``seq``; ``start`` is the offset of a row's first id in them, [loss_start, loss_end) the ids
    under the loss mask (empty for other roles). Turns are ordered by (turn, role, text), nulls first,
    so ties have one order and repeated rows each count. A null role or text is empty; a null conv_id
    is a conversation of its own. Further columns are not read; an empty table gives no rows. A
    conversation of any length passes through as a stream of rows.
    """
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    enc = src.mapInPandas(_encode_rows(tokenizer, trained),
                          "conv_id long, turn long, role string, text string, ids array<int>, text_at int, n_loss int")
    w = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    size = F.size("ids").cast("long")
    start = (F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("start")
    return enc.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), "ids", start, "text_at", "n_loss") \
        .select("conv_id", "seq", "ids", "start", (F.col("start") + F.col("text_at")).alias("loss_start"),
                (F.col("start") + F.col("text_at") + F.col("n_loss")).alias("loss_end"))


def _digest_rows(tokenizer: str):
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(tokenizer)
        now, state = None, None

        def done():
            return (now[0], state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["chars"], state["ids"])

        for b in batches:
            rows = []
            for conv, ids, start, l0, l1 in zip(b["conv_id"], b["ids"], b["start"], b["loss_start"], b["loss_end"]):
                key = (None if pd.isna(conv) else int(conv),)
                if key != now:
                    if state:
                        rows.append(done())
                    now, state = key, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0, "ids": 0}
                marks = np.flatnonzero(ids >= c.base)
                role = unescape(c.decode(ids[marks[0] + 1:marks[1]]))
                text = unescape(c.decode(ids[marks[1] + 1:marks[2]]))
                loss = unescape(c.decode(ids[l0 - start:l1 - start]))
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["loss"].update(loss.encode())
                state["loss_n"] += len(loss)
                state["chars"] += len(c.render(ids))
                state["ids"] += len(ids)
            yield pd.DataFrame(rows, columns=cols)
        if state:
            yield pd.DataFrame([done()], columns=cols)

    return run


def conversation_digests(segments: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Per conversation, read back from the formatted ids: turn count, digests of turns and of the text
    under the loss mask, and length of the rendered form. Rows stream in order; nothing is gathered.

    A null conv_id is a conversation of its own; repeated rows are turns each; an empty table gives no rows.
    """
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInPandas(
        _digest_rows(tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long, n_tokens long")
