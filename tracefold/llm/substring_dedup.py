"""Substring dedup with suffix automata of reference shards.

Passages come to the reference that holds them first.  Hashes of all windows of ``WINDOW`` words are dealt over the
hash space; a window found in two or more documents tells each of them the shard of the first.  Every document then
sends its runs of such windows, as words: those it holds first to its own shard as reference, the others to the shards
of their first holders as questions.  Each shard builds the suffix automaton of its reference runs, with the smallest
document id of each state, and streams the questions through it; the matching statistics decide, word by word, so a
clash of hashes removes nothing.  A shard with many questions is dealt over several tasks, which all get its (bounded)
reference: the broadcast, kept to where it is asked for.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracefold.llm.common import discard, materialize, word_hashes
from tracefold.llm.groups import arrow
from tracefold.llm.ngram_join import LIST_TOKENS, SPLIT, TOKEN_BITS, distinct, rows_of, scramble, shingle_hashes, split_tokens

WINDOW = 13
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Windows of the corpus for each shard, and words of questions for each task of a shard.
SHARD_WINDOWS, TASK_WORDS = 500_000, 100_000


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state knows the smallest document it occurs in.

    Documents must be added in ascending order of their ids."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.doc = [-1], [0], [None]
        self.last = 0

    def _state(self, length: int, after: dict, link: int, doc) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.doc.append(doc)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state for the longest string that ends in ``word`` after ``p``: ``q`` itself, or its upper part."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.doc[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, doc, sequence) -> None:
        last = 0
        for word in sequence:
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = self._split(p, word, q)
                continue
            last = self._state(self.length[p] + 1, {}, 0, doc)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                self.link[last] = self._split(p, word, self.next[p][word])

    def finish(self) -> None:
        """Carry smallest ids from each state to the shorter strings it ends in."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if up > 0 and (self.doc[up] is None or self.doc[v] < self.doc[up]):
                self.doc[up] = self.doc[v]

    def matches(self, doc, sequence, window: int) -> list[int]:
        """Starts of the windows that a smaller document holds.

        The matching statistic - the longest suffix read so far that the reference holds - is cut to the window, of
        whose state the smallest document is known."""
        v = at = 0
        out = []
        after, link, length = self.next, self.link, self.length
        for i, word in enumerate(sequence):
            while v and word not in after[v]:
                v = link[v]
                at = length[v]
            to = after[v].get(word)
            if to is None:
                continue
            v, at = to, at + 1
            if at >= window:
                while length[link[v]] >= window:
                    v = link[v]
                at = window
                if self.doc[v] < doc:
                    out.append(i - window + 1)
        return out


def repeated_in(rows: list[tuple], shards: int):
    """Of one partition of the hash space: for each document its windows that others hold too, with the shard of the
    first holder and whether that is the document itself."""
    p = rows[0][0]
    docs = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows])
    counts = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows]).astype(np.int64)
    tokens = np.concatenate([np.frombuffer(r[5], np.uint32).astype(np.uint64) | (np.frombuffer(r[6], np.uint16).astype(np.uint64) << np.uint64(32)) for r in rows])
    doc = np.repeat(docs, counts)
    order = np.lexsort((doc, tokens))
    t, d = tokens[order], doc[order]
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    sizes = np.diff(np.r_[starts, len(t)])
    first = np.repeat(d[starts], sizes)
    many = np.repeat(d[starts + sizes - 1] != d[starts], sizes)
    t, d, first = t[many] | np.uint64(p << TOKEN_BITS), d[many], first[many]
    order = np.argsort(d, kind="stable")
    t, d, first = t[order], d[order], first[order]
    cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else []
    shard = shard_of(first, shards) * 2 + (first == d)
    for a, b in zip(cuts, np.r_[cuts[1:], len(d)] if len(d) else []):
        yield int(d[a]), t[a:b].tobytes(), shard[a:b].astype(np.uint32).tobytes()


def shard_of(doc: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(shards)).astype(np.int64)


def repeated_windows(split: DataFrame, bits: int, shards: int) -> DataFrame:
    schema = "doc_id bigint, toks binary, shards binary"
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def send(rows):
            found = list(zip(*repeated_in(rows, shards)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, to.types)], schema=to)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if held and held[0][0] != row[0]:
                    yield from send(held)
                    held = []
                held.append(row)
        if held:
            yield from send(held)

    lists = split.repartition(1 << bits, "p").sortWithinPartitions("p").mapInArrow(run, schema)
    return lists.groupBy("doc_id").agg(F.collect_list(F.struct("toks", "shards")).alias("lists"))


def window_hashes(h: np.ndarray, window: int, hash_bits: int) -> np.ndarray:
    """Hashes of all windows; fewer bits than 64 only make them clash."""
    out = shingle_hashes(h, window)
    return out if hash_bits >= 64 else scramble(out >> np.uint64(64 - hash_bits))


def runs(doc: int, text: str, h: np.ndarray, lists: list[dict], bits: int, window: int, hash_bits: int):
    """Runs of one document: ``(shard, question, doc_id, start, text)``."""
    w = WORD.findall(text)
    if len(w) < window:
        return
    hashes = window_hashes(h, window, hash_bits) >> np.uint64(64 - bits - TOKEN_BITS)
    toks = np.concatenate([np.frombuffer(x["toks"], np.uint64) for x in lists])
    shard = np.concatenate([np.frombuffer(x["shards"], np.uint32) for x in lists])
    order = np.argsort(toks)
    toks, shard = toks[order], shard[order]
    at = np.minimum(np.searchsorted(toks, hashes), len(toks) - 1)
    code = np.where(toks[at] == hashes, shard[at].astype(np.int64), -1)
    cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(code)]):
        if code[a] >= 0:
            yield int(code[a]) // 2, int(code[a]) % 2 == 0, doc, int(a), " ".join(w[a : b - 1 + window])


def answers(dealt: DataFrame, window: int) -> DataFrame:
    """Spans ``(doc_id, spans, at, window)`` of word positions that the automata of the shards confirm; and of each window
    that was asked for and is not there its place and words, without spans: its hash is that of other words."""
    schema = "doc_id bigint, spans array<int>, at int, window string"
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        key, automaton, ready = None, None, False
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("shard", "salt", "question", "doc_id", "start", "text"))
            for shard, salt, question, doc, start, text in zip(*columns):
                if (shard, salt) != key:
                    key, automaton, ready = (shard, salt), SuffixAutomaton(), False
                if not question:
                    automaton.add(doc, text.split(" "))
                    continue
                if not ready:
                    automaton.finish()
                    ready = True
                spans: list[int] = []
                asked = text.split(" ")
                held = automaton.matches(doc, asked, window)
                if len(held) < len(asked) - window + 1:
                    there = set(held)
                    out += [(doc, None, start + i, " ".join(asked[i : i + window])) for i in range(len(asked) - window + 1) if i not in there]
                for i in held:
                    a, b = start + i, start + i + window
                    if spans and a <= spans[-1]:
                        spans[-1] = b
                    else:
                        spans += [a, b]
                if spans:
                    out.append((doc, spans, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), to.types)], schema=to)

    by = dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "question", "doc_id", "start")
    return by.mapInArrow(run, schema)


def kept_words(text: str | None, spans: list[list[int]] | None) -> tuple[list[str], int]:
    """Words that stay, and how many words the text had."""
    w = WORD.findall(text or "")
    gone = np.zeros(len(w), bool)
    for each in spans or []:
        for a, b in zip(each[::2], each[1::2]):
            gone[a:b] = True
    return [x for x, g in zip(w, gone) if not g], len(w)


def clashed(asked: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """Spans of windows whose hash clashed: by words, over the runs of all documents that hold a window of such a hash."""
    w = F.split("text", " ")
    each = F.explode(F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.array_join(F.slice(w, i + 1, window), " ")))
    held = spans.select("doc_id", each.alias("window")).join(asked.select("window").distinct(), "window", "left_semi")
    first = held.groupBy("window").agg(F.min("doc_id").alias("first"))
    return asked.join(first, "window").where("first < doc_id").select("doc_id", F.array("at", F.col("at") + window).alias("spans"))


def removed_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """``(doc_id, spans)``: positions of words covered by a window that a document with a smaller id holds.

    Hashes only route; windows of clashing hashes, which the shard of the other words does not hold, are decided by words.

    Rows without an id, and texts of fewer words than a window, take no part.  Rows of one id are one document: their
    windows are not held against each other."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    base = rows.select("doc_id", word_hashes(F.col("text")).alias("h"))
    total = base.agg(F.sum(F.greatest(F.lit(0), F.size("h") - window + 1))).first()[0] or 0
    bits = min(15, max(6, math.ceil(math.log2(max(1, total / LIST_TOKENS)))))
    shards = max(64, math.ceil(total / SHARD_WINDOWS))

    def split(batch):
        ids = batch.column("doc_id").to_numpy().astype(np.int64)
        sets = [distinct(window_hashes(h, window, hash_bits)) if len(h) >= window else np.empty(0, np.uint64) for h in rows_of(batch, "h")]
        raw = [x.tobytes() for x in ids]
        yield from split_tokens(raw, [b""] * len(raw), [0] * len(raw), sets, bits)

    lists = materialize(repeated_windows(arrow(base, split, SPLIT), bits, shards), "repeated")
    full = rows.join(lists, "doc_id").select("doc_id", "text", word_hashes(F.col("text")).alias("h"), "lists")

    def send(batch):
        out = [r for doc, text, h, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), rows_of(batch, "h"), batch.column("lists").to_pylist()) for r in runs(doc, text or "", h, x, bits, window, hash_bits)]
        if out:
            yield list(zip(*out))

    schema = "shard int, question boolean, doc_id bigint, start int, text string"
    spans = materialize(arrow(full, send, schema), "runs")
    discard(lists)
    asked = spans.where("question").groupBy("shard").agg(F.ceil(F.sum(F.size(F.split("text", " "))) / F.lit(TASK_WORDS)).cast("int").alias("salts"))
    asked = materialize(asked, "asked")
    refs = spans.where("not question").join(asked, "shard").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)")))
    questions = spans.where("question").join(asked, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int"))
    found = materialize(answers(refs.drop("salts").unionByName(questions.drop("salts")), window), "answers")
    sure, open_ = found.where("spans is not null").select("doc_id", "spans"), found.where("spans is null").select("doc_id", "at", "window")
    if open_.isEmpty():
        discard(spans, asked)
        return sure
    return sure.unionByName(clashed(open_, spans, window))


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, ``kept`` the words that stay, joined by one space.

    One row for each row of ``docs``.  Null and empty texts have no words.  Of equal texts the one with the smallest id
    keeps its words; repeated rows of one id lose nothing to each other; rows without an id lose nothing.  Other columns
    are not read; an empty table gives no rows."""
    spans = removed_spans(docs, window, id_col, text_col)
    found = spans.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(found, "doc_id", "left")

    def fn(batch):
        got = [kept_words(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        yield [batch.column("doc_id"), [n for _, n in got], [n - len(w) for w, n in got], [" ".join(w) for w, _ in got]]

    return arrow(rows.select("doc_id", "text", "spans"), fn, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digests(docs: DataFrame) -> DataFrame:
    out = dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


