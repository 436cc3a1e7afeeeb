"""Chat formatting at the level of tokens.

Every segment of a turn - the role line, the text, the line end - is encoded on its own, and the reserved ids that mark
turns are spliced between them, so no token crosses a mark and no text can produce one.  Control strings inside a text
are escaped by one backslash more between ``<`` and the bar, which is undone on reading.  Segment lengths summed from the
left give the token offsets, and with them the loss mask.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.groups import arrow

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, END = "<|im_start|>", "<|im_end|>"
#: Control strings have the form <|...|>: any opening mark in a text gets a backslash more.
OPEN, CLOSED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
#: White space as the pattern knows it; the encoder's own search can't take runs of it that are very long.
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
RUN = 4096


def escape(text: str) -> str:
    return OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return CLOSED.sub(r"<\1|", text)


@lru_cache(maxsize=2)
def encoder(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    n = max(table.values()) + 1
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={START: n, END: n + 1})


def encode(enc, text: str, run: int = RUN) -> list[int]:
    """Token ids of the whole text.

    The pattern takes a run of white space but for its last character, or all of one at the end, as one piece; long ones are
    cut out by that rule, so the ids are those of the whole text."""
    out, at = [], 0
    for m in re.finditer(f"{BLANK}{{{run},}}", text):
        end = m.end() - (m.end() < len(text))
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def format_turns(rows: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row for each turn: ``(conv_id, turn, ids, bounds, loss)``.

    ``ids`` are the tokens of the turn, ``bounds`` the offsets at which its segments end (prefix sums of their lengths)
    and ``loss`` the mask of the tokens that are learnt: those of an assistant's text.  A null role or text counts as
    empty.  Turns are encoded where they are read: a long conversation is no larger task than others."""

    def fn(batch):
        enc = encoder(ranks)
        start, end = (enc.encode_single_token(x) for x in (START, END))
        ids, bounds, loss = [], [], []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            parts = [[start], encode(enc, escape(role or "") + "\n"), encode(enc, escape(text or "")), [end], encode(enc, "\n")]
            ends = np.cumsum([len(p) for p in parts])
            mask = np.zeros(ends[-1], bool)
            if role == "assistant":
                mask[ends[1] : ends[2]] = True
            ids.append([x for p in parts for x in p])
            bounds.append(ends.tolist())
            loss.append(mask.tolist())
        yield [batch.column("conv_id"), batch.column("turn"), ids, bounds, loss]

    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return arrow(turns, fn, "conv_id bigint, turn bigint, ids array<int>, bounds array<int>, loss array<boolean>")


class Reader:
    """Reads one conversation back from its tokens, turn by turn, and digests it."""

    def __init__(self, enc):
        self.enc, self.start, self.end = enc, enc.encode_single_token(START), enc.encode_single_token(END)
        self.n, self.chars, self.formatted = 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, mask: np.ndarray) -> None:
        marks = np.flatnonzero((ids == self.start) | (ids == self.end))
        if len(marks) != 2 or marks[0] != 0 or ids[0] != self.start:
            raise ValueError("the marks of a turn are damaged")
        body = self.enc.decode_bytes(ids[1 : marks[1]].tolist()).decode("utf-8")
        role, text = (unescape(x) for x in body.split("\n", 1))
        self.n += 1
        self.formatted += len(START) + len(body) + len(END) + len(self.enc.decode_bytes(ids[marks[1] + 1 :].tolist()).decode("utf-8"))
        self.turns.update(f"{role}\n{text}\n".encode())
        learnt = unescape(self.enc.decode_bytes(ids[mask].tolist()).decode("utf-8"))
        self.chars += len(learnt)
        self.loss.update(learnt.encode())

    def row(self, conv) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted


def read_back(turns: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, one row for each conversation.

    The digest of a conversation needs its turns in order: they are sorted (on disk, if need be) and streamed one by
    one, so memory does not grow with a conversation.  Turns with one number go by their tokens."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        enc, now, reader = encoder(ranks), None, None

        def send(done):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

        for batch in batches:
            done = []
            ids, loss = batch.column("ids"), batch.column("loss")
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = conv, Reader(enc)
                reader.add(ids[i].values.to_numpy(zero_copy_only=False), loss[i].values.to_numpy(zero_copy_only=False))
            if done:
                yield send(done)
        if reader is not None:
            yield send([reader.row(now)])

    by = turns.select("conv_id", "turn", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return by.mapInArrow(run, schema)


def chat_digests(rows: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Format and read back all conversations of ``rows`` (``conv_id, turn, role, text``).

    Null texts and roles are empty, null turns come first, a null id is one conversation; repeated rows are turns of
    their own.  Other columns are not read; an empty table gives no rows."""
    return read_back(format_turns(rows, ranks), ranks)
