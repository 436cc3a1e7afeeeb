"""SentencePiece encoding and decoding with exact N-best segmentation.

A text becomes the piece lattice of its characters (a space is the mark U+2581, and one is put in front).  No piece
crosses the start of a word, so the lattice falls into short ones, each solved once and kept: a forward pass gives the
best score of every position, and a backward A-star search from the end, with those scores as exact heuristic, yields
segmentations in descending order.  The N best of the text are then the N best sums over its words, each with the ids of
the paths that it sums.

The vocabulary file ranks its pieces by merge order and holds no probabilities: a piece scores minus the logarithm of
its rank (Zipf's law).  Characters that are no piece, and a literal U+2581, are spelled in byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.groups import arrow

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
N_BEST = 4
#: Scores are multiples of this.
GRAIN = 2.0**-20
#: Words kept with their segmentation, and characters of them; the store is emptied when full.
KEPT_WORDS, KEPT_CHARS = 400_000, 1 << 23
#: Characters of the texts that are split at once; words that are solved together, at least and at most, and their length.
SLICE_CHARS, FEWEST, MOST, LONGEST = 1 << 20, 64, 8192, 64
#: Words whose ids are gathered in one step.
GATHERED = 1 << 18
#: Words with the spaces before them; line ends and tabs are no pieces, so each stands alone.
CHUNKS = re.compile(r" +[^ \n\t]*|[^ \n\t]+|[\n\t]")


def bytes_of(c: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)


def grained(score: float) -> float:
    return round(score / GRAIN) * GRAIN


class Steps:
    """A trie in arrays (a double array): the child of ``node`` by a character is ``base[node] + code``, if ``parent`` of
    that is ``node``; node 0 is the root.  A node has the id of its piece, or -1, and the score."""

    def __init__(self, root: dict):
        nodes = [(root, 0, "", -1, 0.0)]
        for at, (kids, *_) in enumerate(nodes):
            nodes += [(hit[0], at, c, *hit[1:]) for c, hit in kids.items()]
        codes = {c: k for k, (c, _) in enumerate(Counter(x[2] for x in nodes[1:]).most_common(), 1)}
        room = len(codes) + 1
        used, high = bytearray(2 * room), 0
        used[0], base, low = 1, [0] * len(nodes), 0
        for at in sorted(range(len(nodes)), key=lambda at: -len(nodes[at][0])):
            kids = sorted(codes[c] for c in nodes[at][0])
            if not kids:
                break
            # Nodes of one child, the last ones, fill the gaps that the others leave.
            free, tries = used.find(0, kids[0] if len(kids) == 1 else max(low, kids[0])), 0
            while any(used[free - kids[0] + k] for k in kids):
                free, tries = used.find(0, free + 1), tries + 1
            if tries > 20:
                low = free
            base[at] = free - kids[0]
            for k in kids:
                used[base[at] + k] = 1
            high = max(high, base[at] + kids[-1])
            if high + 2 * room > len(used):
                used += bytes(len(used))
        slots = [0] * len(nodes)
        self.base, self.parent, self.ids = (np.full(high + room, x, np.int32) for x in (0, -1, -1))
        self.scores = np.zeros(high + room)
        for at, (_, above, c, i, score) in enumerate(nodes):
            if at:
                slots[at] = slot = base[above] + codes[c]
                self.parent[slot], self.ids[slot], self.scores[slot] = slots[above], i, score
            self.base[slots[at]] = base[at]
        self.codes = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.codes[[ord(c) for c in codes]] = list(codes.values())
        self.single = np.zeros(room, bool)  # codes of characters that are pieces
        self.single[[codes[c] for c, hit in root.items() if hit[1] >= 0]] = True
        # As in ``Lattice.marked``.
        self.codes[[ord(" "), ord(MARK)]] = self.codes[[ord(MARK), 0]]


class Lattice:
    """Pieces of a vocabulary with their scores, and the searches over them.

    Scores are multiples of ``GRAIN``, so that their sums are exact and equal sums are equal in any order."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], byte_score: float):
        self.root: dict = {}
        ends = {"": self.root}  # nodes of all beginnings of pieces: (children, id or -1, score)
        for piece in sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}):
            ends[piece] = {}
            ends[piece[:-1]][piece[-1]] = (ends[piece], *pieces.get(piece, (-1, 0.0)))
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.singles = {p for p in pieces if len(p) == 1}
        self.byte_ids, self.byte_score = byte_ids, byte_score
        self.steps = Steps(self.root)

    @staticmethod
    def marked(word: str) -> str:
        """The word with marks for its spaces; a literal mark is no piece."""
        return (word.replace(MARK, "\0") if MARK in word else word).replace(" ", MARK)

    def spelled(self, c: str) -> tuple[float, tuple[int, ...]]:
        """Score and ids of a character in byte pieces."""
        raw = c.encode("utf-8", "surrogatepass")
        return self.byte_score * len(raw), tuple(self.byte_ids[x] for x in raw)

    def edges(self, word: str) -> Iterator[tuple[int, int, float, tuple[int, ...]]]:
        """The pieces of the lattice, ``(start, end, score, ids)``, by start."""
        marked = self.marked(word)
        for a in range(len(word)):
            kids, single = self.root, False
            for b in range(a, len(word)):
                hit = kids.get(marked[b])
                if hit is None:
                    break
                kids = hit[0]
                if hit[1] >= 0:
                    yield a, b + 1, hit[2], (hit[1],)
                    single |= b == a
            if not single:
                score, ids = self.spelled(word[a])
                yield a, a + 1, score, ids

    def edges_to(self, word: str, marked: str, b: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """The pieces that end at ``b``, ``(start, score, ids)``, the longest first."""
        for a in range(max(0, b - self.longest), b):
            hit = self.pieces.get(marked[a:b])
            if hit is not None:
                yield a, hit[1], (hit[0],)
            elif a == b - 1:
                yield a, *self.spelled(word[a])

    def best_and_gap(self, word: str) -> tuple[float, float, list[int]]:
        """The best score, how far below it the next segmentation is, and the ids of the best.

        The forward pass carries the two best scores of every position.  Of equal paths the one whose last piece is the
        longest wins, then the last but one, and so on."""
        marked, n, root, singles = self.marked(word), len(word), self.root, self.singles
        best, second, via = [-math.inf] * (n + 1), [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for a in range(n):
            first, next_, kids = best[a], second[a], root
            for b in range(a + 1, n + 1):
                hit = kids.get(marked[b - 1])
                if hit is None:
                    break
                kids, i, score = hit
                if i >= 0:
                    x, held = first + score, best[b]
                    if x > held:
                        y = next_ + score
                        second[b] = held if held > y else y
                        best[b], via[b] = x, (a, i)
                    elif x > second[b]:
                        second[b] = x
            if marked[a] not in singles:
                score, ids = self.spelled(word[a])
                x, held = first + score, best[a + 1]
                if x > held:
                    second[a + 1] = max(held, next_ + score)
                    best[a + 1], via[a + 1] = x, (a, ids)
                elif x > second[a + 1]:
                    second[a + 1] = x
        ids, at = [], n
        while at:
            at, i = via[at]
            if type(i) is int:
                ids.append(i)
            else:
                ids += reversed(i)
        ids.reverse()
        return best[n], best[n] - second[n], ids

    def best_and_gap_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``best_and_gap`` gives for each of the words, which come longest first, the ids in one array and where those
        of each word end: the same passes, but each step is made for all words together.  Memory is that of all at the
        length of the longest."""
        trie, n = self.steps, len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        begin, longest = np.cumsum(sizes) - sizes, int(sizes[0])
        alive = np.searchsorted(-sizes, -np.arange(longest + 1)).tolist()  # words longer than each place
        best, second = np.full((longest + 1, n), -np.inf), np.full((longest + 1, n), -np.inf)
        start, via = np.zeros((longest + 1, n), np.int32), np.zeros((longest + 1, n), np.int32)
        best[0] = 0.0
        codes = [trie.codes[text[begin[:k] + a]] for a, k in enumerate(alive[:-1])]

        def reach(a, b, at, score, i):
            x, y, held = best[a, at] + score, second[a, at] + score, best[b, at]
            second[b, at] = np.maximum(np.maximum(second[b, at], y), np.minimum(x, held))
            up = x > held
            at = at[up]
            best[b, at], start[b, at], via[b, at] = x[up], a, i[up]

        for a in range(longest):
            at, node = np.arange(alive[a]), np.zeros(alive[a], np.int32)
            for b in range(a + 1, min(longest, a + self.longest) + 1):
                k = np.searchsorted(at, alive[b - 1])
                at, node = at[:k], node[:k]
                to = trie.base[node] + codes[b - 1][at]
                found = np.flatnonzero(trie.parent[to] == node)
                if not len(found):
                    break
                at, node = at[found], to[found]
                i = trie.ids[node]
                hit = np.flatnonzero(i >= 0)
                reach(a, b, at[hit], trie.scores[node[hit]], i[hit])
            odd = np.flatnonzero(~trie.single[codes[a]])
            if len(odd):
                c = text[begin[odd] + a]
                reach(a, a + 1, odd, self.byte_score * bytes_of(c), -1 - c)
        every = np.arange(n)
        first, gap = best[sizes, every], best[sizes, every] - second[sizes, every]
        # Back along the best paths: ids, or characters in bytes as numbers below 0.
        steps, at, word, counts = [], sizes.copy(), every, np.zeros(n, np.int64)
        while len(word):
            i = via[at[word], word]
            size = np.where(i < 0, bytes_of(-1 - i), 1)
            steps.append((word, i, size))
            counts[word] += size
            at[word] = start[at[word], word]
            word = word[at[word] > 0]
        ends = np.cumsum(counts)
        out, place = np.empty(ends[-1], np.int32), ends.copy()
        for word, i, size in steps:
            place[word] -= size
            out[place[word]] = i
            odd = np.flatnonzero(i < 0)
            if len(odd):
                c, kind = np.unique(-1 - i[odd], return_inverse=True)
                table = np.array([(self.spelled(chr(x))[1] + (0, 0, 0))[:4] for x in c.tolist()])
                for k in range(4):
                    more = size[odd] > k
                    out[place[word[odd[more]]] + k] = table[kind[more], k]
        return first, gap, ends, out

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations, best first; of equals as in ``best_and_gap``.

        Backward A-star: a state is a suffix, its bound the best prefix score plus the score of the suffix.  As that is
        the score of a whole path, no state beyond the ``n`` best can lead to one of the ``n`` best paths, and no more
        are kept; suffixes share their tails."""
        marked = self.marked(word)
        best = [0.0] + [-math.inf] * len(word)
        for a, b, score, _ in self.edges(word):
            best[b] = max(best[b], best[a] + score)
        open_ = [(best[-1], len(word), 0.0, None)]
        out: list[tuple[float, tuple[int, ...]]] = []
        while open_ and len(out) < n:
            _, at, done, tail = open_.pop(0)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                out.append((done, tuple(ids)))
                continue
            fresh = [(best[a] + score + done, a, score + done, (own, tail)) for a, score, own in self.edges_to(word, marked, at)]
            open_ = sorted(fresh + open_, key=lambda x: -x[0])[: n - len(out)]
        return out


@lru_cache(maxsize=2)
def lattice(model: str) -> Lattice:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    bytes_ = [sp.piece_to_id(f"<0x{x:02X}>") for x in range(256)]
    other = set(bytes_)
    pieces = {}
    for i in range(n):
        if i in other or sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        # Runs of marks have no rank in the file: they come last.
        rank = n if sp.get_score(i) < -n else int(-sp.get_score(i))
        pieces[piece] = (i, grained(-math.log(rank + 2.0)))
    return Lattice(pieces, bytes_, grained(-2 * math.log(n + 2.0)))


def sums(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` largest sums of one entry from each list, less the sum of the first ones, with the places of the entries;
    entries descend.  Of equal sums that of the earlier entries comes first."""
    top: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for each in lists:
        top = heapq.nlargest(n, ((x + (y - each[0]), (*at, j)) for x, at in top for j, y in enumerate(each)), key=lambda z: z[0])
    return top


class Coder:
    """Encodes whole texts; keeps the segmentation of the words it has met."""

    def __init__(self, lattice: Lattice, n_best: int):
        self.lattice, self.n = lattice, n_best
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.paths: list[str | tuple[list[float], list[bytes]]] = []
        # Of each word: score, gap, and where its ids end.
        self.first, self.gap, self.ends, self.ids = array("d"), array("d"), array("q", [0]), array("i")
        self.chars = 0

    def keep(self, words: list[str], first: np.ndarray, gap: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        """Keep words: their best segmentation, and the gap to the next; the search for more waits until it is asked."""
        self.index.update(zip(words, range(len(self.paths), len(self.paths) + len(words))))
        self.paths += words
        self.ends.frombytes((ends + len(self.ids)).tobytes())
        self.first.frombytes(first.tobytes())
        self.gap.frombytes(gap.tobytes())
        self.ids.frombytes(ids.tobytes())
        self.chars += sum(map(len, words))

    def learn(self, words: set[str]) -> None:
        """Keep new words; those of common lengths are solved together."""
        new = sorted(words, key=len, reverse=True)
        long = bisect_left(new, -LONGEST, key=lambda w: -len(w))
        together = range(long, len(new) - FEWEST, MOST)
        for a in together:
            self.keep(new[a : a + MOST], *self.lattice.best_and_gap_all(new[a : a + MOST]))
        for word in new[:long] + new[together[-1] + MOST if together else long :]:
            first, gap, ids = self.lattice.best_and_gap(word)
            self.keep([word], np.array([first]), np.array([gap]), np.array([len(ids)]), np.array(ids, np.int32))

    def paths_of(self, at: int) -> tuple[list[float], list[bytes]]:
        """Scores and ids of the N best segmentations of a word; the one that was kept comes first, also where others equal it."""
        if isinstance(self.paths[at], str):
            found = self.lattice.nbest(self.paths[at], self.n)
            own = self.ids[self.ends[at] : self.ends[at + 1]].tobytes()
            ids = [array("i", i).tobytes() for _, i in found]
            self.paths[at] = [s for s, _ in found], [own, *(i for i in ids if i != own)][: len(ids)]
        return self.paths[at]

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[list[list[bytes]], list[float]]]:
        """``encode_all`` of each text; many short ones are looked up together, and their new words solved together."""
        a = 0
        while a < len(texts):
            split, chars = [], 0
            while a < len(texts) and chars < SLICE_CHARS:
                split.append(CHUNKS.findall(" " + texts[a]) if texts[a] else [])
                chars += len(texts[a])
                a += 1
            yield from self.encode_split(split)

    def encode_split(self, split: list[list[str]]) -> list[tuple[list[list[bytes]], list[float]]]:
        """``encode_all`` of texts in words."""
        if len(self.index) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.forget()
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        unmet = list(map(words.__getitem__, missing.tolist()))
        self.learn(set(unmet))
        at[missing] = np.fromiter(map(self.index.__getitem__, unmet), np.int64, len(unmet))
        first, gap, ends = np.frombuffer(self.first)[at], np.frombuffer(self.gap)[at], np.frombuffer(self.ends, np.int64)
        to = np.concatenate([[0], np.cumsum(ends[at + 1] - ends[at])])
        blocks = []
        for a in range(0, len(at), GATHERED):
            start, end = to[a : a + GATHERED], to[a + 1 : a + GATHERED + 1]
            start = start[: len(end)]
            source = np.repeat(ends[at[a : a + GATHERED]] - start, end - start) + np.arange(start[0], end[-1])
            blocks.append(np.frombuffer(self.ids, np.int32)[source].astype("<i4", copy=False).tobytes())
        raw = b"".join(blocks)
        to, out, b = 4 * to, [], 0
        for each in split:
            a, b = b, b + len(each)
            if not each:
                out.append(([[b""]], [0.0]))
                continue
            # Only the n - 1 words with the smallest gaps, the first ones of equals, can differ in one of the n best.
            near = np.arange(a, b)
            if len(each) >= self.n:
                near = a + np.flatnonzero(gap[a:b] <= np.partition(gap[a:b], self.n - 2)[self.n - 2]) if self.n > 1 else near[:0]
                near = np.sort(near[np.argsort(gap[near], kind="stable")[: self.n - 1]])
            paths = [self.paths_of(i) for i in at[near].tolist()]
            runs = [raw[x:y] for x, y in zip(to[[a, *(near + 1)]].tolist(), to[[*near, b]].tolist())]
            # Scores are exact, and so is their sum.
            out.append(self.combined(runs, paths, float(first[a:b].sum())))
        return out

    def combined(self, runs: list[bytes], paths: list[tuple[list[float], list[bytes]]], total: float) -> tuple[list[list[bytes]], list[float]]:
        """The N best of all choices of one path between each two runs; the first ones sum to ``total``."""
        out, scores = [], []
        for more, places in sums([x for x, _ in paths], self.n):
            whole = [runs[0]]
            for j, (_, ids), run in zip(places, paths, runs[1:]):
                whole += ids[j], run
            out.append(whole)
            scores.append(total + more)
        return out, scores

    def encode_all(self, text: str) -> tuple[list[list[bytes]], list[float]]:
        """The N best segmentations, best first, and their scores.  The ids of each come in runs, which its parts with the
        others in common share."""
        return next(self.encode_texts([text]))

    def encode(self, text: str) -> tuple[bytes, list[float]]:
        """Ids of the best segmentation, and the scores of the N best, best first."""
        found, scores = self.encode_all(text)
        return b"".join(found[0]), scores


def run_digests(found: list[list[bytes]]) -> list[str]:
    """SHA-256 of each segmentation; the run that all begin with is read once."""
    start = hashlib.sha256(found[0][0])
    out = []
    for runs in found:
        own = start.copy()
        for run in runs[1:]:
            own.update(run)
        out.append(own.hexdigest())
    return out


class Decoder:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.raw = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.raw.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else piece.replace(MARK, " ").encode())

    def decode(self, ids: bytes) -> str:
        """The text again: pieces and bytes joined, without the space in front."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist()))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def coder(model: str, n_best: int) -> tuple[Coder, Decoder]:
    return Coder(lattice(model), n_best), Decoder(model)


def encode_docs(docs: DataFrame, n_best: int = N_BEST, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, scores, decoded, nbest_ids)``: the best segmentation of each whole text, the scores of the
    ``n_best`` best in descending order (fewer where the lattice has fewer), the text decoded from the ids, and the ids of
    each of the ``n_best``, in the order of the scores.

    One row for each row of ``docs``; ids may be null or repeat.  Null and empty texts have no ids, one score of 0 and
    decode to an empty text.  Other columns are not read; an empty table gives no rows."""

    def fn(batch):
        code, back = coder(model, n_best)
        got = list(code.encode_texts([t or "" for t in batch.column("text").to_pylist()]))
        every = [[b"".join(runs) for runs in found] for found, _ in got]
        yield [batch.column("doc_id"), [np.frombuffer(x[0], "<i4") for x in every], [s for _, s in got], [back.decode(x[0]) for x in every], [[np.frombuffer(i, "<i4") for i in x] for x in every]]

    return arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), fn, "doc_id bigint, ids array<int>, scores array<double>, decoded string, nbest_ids array<array<int>>")


def digests(docs: DataFrame, n_best: int = N_BEST, model: str = MODEL) -> DataFrame:
    """``(doc_id, n_pieces, scores, ids_sha256, round_trip, nbest_pieces, nbest_sha256)``: what ``encode_docs`` makes,
    without the ids; digests are over the ids as little-endian 32-bit numbers, of the best and of each of the N best."""

    def fn(batch):
        code, back = coder(model, n_best)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        columns: list[list] = [[] for _ in range(6)]
        for text, (found, scores) in zip(texts, code.encode_texts(texts)):
            sizes, shas = [sum(map(len, runs)) // 4 for runs in found], run_digests(found)
            for column, value in zip(columns, (sizes[0], scores, shas[0], back.decode(b"".join(found[0])) == text, sizes, shas)):
                column.append(value)
        yield [batch.column("doc_id"), *columns]

    return arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), fn, "doc_id bigint, n_pieces bigint, scores array<double>, ids_sha256 string, round_trip boolean, nbest_pieces array<bigint>, nbest_sha256 array<string>")
