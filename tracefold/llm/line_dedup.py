"""Fuzzy line dedup by MinHash over character shingles.

Equal lines (runs of white space count as one space) form one class.  MinHash signatures are cut into bands.  Band keys
are dealt over the hash space, packed, and those that several classes hold are kept.  The bands with one smallest member,
the head, form a group, in which each line comes once; all its pairs are decided by the exact Jaccard similarity.  A large
group is dealt into parts, each with the head; where it holds several components after that, the lines outside its largest
one meet all others in blocks of bounded size.  So no two near lines that share a band stay apart.  Union-find over the
links gives components, and of all lines of a component the first stays.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import components, discard, materialize, whole_row
from tracefold.llm.groups import arrow, group_links, rest_links, smallest_holders
from tracefold.llm.ngram_join import MIX, distinct, scramble

#: Characters of a shingle; a shorter line is one shingle.
SHINGLE = 8
#: At a similarity of 0.75 a pair shares a band with probability 0.995, at 0.1 with 0.0014.
BANDS, ROWS = 14, 4
PERCENT = 75
#: Columns of a step of the comparison of a block.
COLUMNS = 8192
#: Characters whose signatures are made at once.
CHUNK = 1 << 16
GAP = re.compile(r"[\x20\x09-\x0D]+")
#: White space that is more than single spaces.
ODD = ("  ", "\t", "\v", "\f", "\r")


def normal(line: str) -> str:
    return GAP.sub(" ", line).strip(" ")


def normal_lines(text: str | None) -> list[str]:
    """The lines of a text, each with its runs of white space as one space and none at its ends."""
    text = text or ""
    lines = text.split("\n")
    return [normal(x) for x in lines] if any(c in text for c in ODD) else [x.strip(" ") for x in lines]


def line_key(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def key_pair(line: str) -> tuple[int, int]:
    key = line_key(line)
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def band_keys(lines: list[str]) -> np.ndarray:
    """Band keys of the signatures of some lines, one row for each line; a short line is filled up to one shingle.

    A shingle is hashed from eight bytes, one for each character: characters beyond the first 256 are folded into them, which
    only lets more lines meet."""
    filled = [x.ljust(SHINGLE, "\0") for x in lines]
    lengths = np.fromiter(map(len, filled), np.int64, len(filled))
    text = "".join(filled)
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = (codes ^ (codes >> np.uint32(8)) ^ (codes >> np.uint32(16))).astype(np.uint8).tobytes()
    h = np.empty(len(raw) - SHINGLE + 2, np.uint32)  # those across two lines are left out below; one more ends the last
    h[:-1] = scramble(np.ndarray(len(raw) - SHINGLE + 1, "<u8", raw, strides=(1,))) >> np.uint64(32)
    h[-1] = 0
    starts = np.cumsum(lengths) - lengths
    at = np.stack([starts, starts + lengths - SHINGLE + 1], axis=1).ravel()
    seeds = ((np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(MIX[2])) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = np.empty((BANDS, ROWS, len(lines)), np.uint64)
    mixed = np.empty_like(h)
    for i, seed in enumerate(seeds):
        np.multiply(h, seed, out=mixed)
        least[i // ROWS, i % ROWS] = np.minimum.reduceat(mixed, at)[::2]
    acc = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for r in range(ROWS):
        acc = scramble(acc * np.uint64(MIX[1]) + least[:, r])
    return np.ascontiguousarray(acc.T).view(np.int64)


def banded_lines(batch) -> list:
    """Columns ``(doc_id, line_no, k1, k2, bands)`` of a batch; bands only where a line comes first in it."""
    ids, numbers, first, fresh = [], [], [], {}
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        for i, line in enumerate(normal_lines(text)):
            if line:
                ids.append(doc)
                numbers.append(i)
                first.append(fresh.setdefault(line, len(fresh)))
    lines = list(fresh)
    keys = np.frombuffer(b"".join(map(line_key, lines)), "<i8").reshape(-1, 2)
    parts, at = [], 0
    while at < len(lines):
        to, size = at, 0
        while to < len(lines) and (to == at or size + len(lines[to]) <= CHUNK):
            size += len(lines[to])
            to += 1
        parts.append(band_keys(lines[at:to]))
        at = to
    first = np.array(first, np.int64)
    new = np.zeros(len(first), bool)
    new[np.unique(first, return_index=True)[1]] = True  # classes are numbered in the order of their first lines
    flat = np.concatenate(parts).ravel() if parts else np.empty(0, np.int64)
    bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(new, BANDS, 0))].astype(np.int32), mask=np.r_[~new, False]), pa.array(flat))
    return [ids, numbers, keys[first, 0], keys[first, 1], bands]


def members_of(lines: DataFrame) -> DataFrame:
    """``(head, node)`` of lines that share a band; a node is the first half of a line's key here, and lines that agree in it
    count as one."""
    banded = lines.where("bands is not null").select(F.col("k1").alias("node"), F.col("bands").alias("keys"))
    return smallest_holders(banded, banded.count() * BANDS)


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, k2, line, id)`` of the lines that are to be compared; ``id`` is a number of its own for each."""
    asked = classes.join(wanted.distinct(), F.col("k1") == F.col("node")).groupBy(F.col("head.doc_id").alias("doc_id"))
    asked = asked.agg(F.collect_list(F.struct(F.col("head.line_no").alias("n"), "k1", "k2")).alias("wanted"))

    def fetch(batch):
        out: list[list] = [[], [], []]
        for text, want in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            lines = normal_lines(text)
            for w in want:  # of rows of one id only one has the line there
                if w["n"] < len(lines) and lines[w["n"]] and key_pair(lines[w["n"]]) == (w["k1"], w["k2"]):
                    for column, value in zip(out, (w["k1"], w["k2"], lines[w["n"]])):
                        column.append(value)
        yield out

    found = arrow(docs.join(asked.hint("merge"), "doc_id").select("text", "wanted"), fetch, "node bigint, k2 bigint, line string")
    return materialize(found.dropDuplicates(["node", "k2"]).withColumn("id", F.monotonically_increasing_id()), "texts")


def numbered(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each line as numbers, sorted; equal shingles of these lines have equal numbers, others not.

    Where the lines have fewer than 256 different characters, a shingle is the eight bytes of its characters."""
    letters: set[str] = set().union(*lines)
    if "\0" not in letters:
        if max(letters, default="") > "\xff" and len(letters) < 256:
            table = {ord(c): i for i, c in enumerate(sorted(letters), 1)}
            lines = [x.translate(table) for x in lines]
        if len(letters) < 256:
            raw = [x.ljust(SHINGLE, "\0").encode("latin-1") for x in lines]
            return [distinct(np.array(np.ndarray(len(x) - SHINGLE + 1, "<u8", x, strides=(1,)))) for x in raw]
    place: dict[str, int] = {}
    return [np.sort(np.fromiter((place.setdefault(s, len(place)) for s in shingles(x)), np.uint64)) for x in lines]


def block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links of one block: rows ``(id, root, line)``; two components are linked once.

    Small blocks go pair by pair.  In others the shingles that several lines hold become columns of a 0/1 matrix, whose
    product with itself counts what each two lines share, exactly."""
    rows = sorted({r[0]: r for r in rows}.values())
    sets = numbered([r[2] for r in rows])
    sizes = np.array([len(x) for x in sets], np.int64)
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    links = []

    def meet(i: int, j: int, same: int | None) -> None:
        x, y = find(rows[i][1]), find(rows[j][1])
        if x == y:
            return
        if same is None:
            n, m = len(sets[i]), len(sets[j])
            if 100 * min(n, m) < percent * max(n, m):
                return
            both = np.concatenate((sets[i], sets[j]))
            both.sort()
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * same < percent * (n + m - same):
                return
        links.append((rows[i][0], rows[j][0]))
        up[max(x, y)] = min(x, y)

    if len(rows) <= 16:
        for i in range(len(rows)):
            for j in range(i):
                meet(i, j, None)
        return links
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(rows)), sizes)
    common = np.bincount(flat) > 1
    owner, flat = owner[common[flat]], (np.cumsum(common) - 1)[flat[common[flat]]]
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    same = np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(flat, [at, at + COLUMNS])
        held = np.zeros((len(rows), min(COLUMNS, int(common.sum()) - at)), np.float32)
        held[owner[a:b], flat[a:b] - at] = 1
        same += held @ held.T
    roots = np.unique([r[1] for r in rows], return_inverse=True)[1]
    good = (100 * same >= percent * (sizes[:, None] + sizes[None, :] - same)) & (roots[:, None] > roots[None, :])
    for i, j in zip(*np.nonzero(good)):
        meet(int(i), int(j), int(same[i, j]))
    return links


def removals(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, gone)``: numbers and keys of the lines that go, for documents that lose any."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    lines = materialize(arrow(rows, lambda batch: [banded_lines(batch)], "doc_id bigint, line_no int, k1 bigint, k2 bigint, bands array<bigint>"), "lines")
    members = members_of(lines)
    places = lines.select("doc_id", "line_no", "k1", "k2")
    classes = materialize(places.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("head"), F.count("*").alias("n")), "classes")
    texts = texts_of(rows, classes, members.select("node").union(members.select("head")))

    def search(table):
        return block_links(list(zip(*(table.column(c).to_pylist() for c in ("id", "root", "line")))), percent)

    held = texts.select("node", "id", "line")
    links, large = group_links(members, held, search)
    comp = components(links)
    if not large.isEmpty():
        missed = rest_links(large, members, held, comp, search)
        if not missed.isEmpty():
            discard(comp)
            comp = components(links.union(missed))
    found = comp.select(F.col("node").alias("id"), "component")
    near_keys = texts.join(found, "id").select(F.col("node").alias("k1"), "k2", "component")
    known = classes.join(near_keys, ["k1", "k2"], "left").where("n > 1 or component is not null")
    heads = known.where("component is not null").groupBy("component").agg(F.min("head").alias("keep"))
    dup = materialize(known.join(heads, "component", "left").select("k1", "k2", F.coalesce("keep", "head").alias("keep")), "dups")
    gone = places.join(dup, ["k1", "k2"]).where(F.struct("doc_id", "line_no") != F.col("keep"))
    out = materialize(gone.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("line_no").alias("n"), "k1", "k2")).alias("gone")), "gone")
    discard(members, texts, links, comp, classes, dup, lines)
    return out


def without(text: str | None, gone: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without the lines that go, how many lines it had, and how many went."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not gone:
        return text, len(lines), 0
    out = {g["n"] for g in gone if g["n"] < len(lines) and key_pair(normal(lines[g["n"]])) == (g["k1"], g["k2"])}
    return "\n".join(x for i, x in enumerate(lines) if i not in out), len(lines), len(out)


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_lines, n_removed, text)``, one row for each row of ``docs``.

    Lines are split at ``\\n``.  Those with a word are compared, over all documents: of a component of near-equal lines
    (Jaccard similarity of 8-character shingles of at least 0.75 along the links) the first stays, by document id and
    line number.  Blank lines stay.  A null text stays null and has no lines; an empty one has one blank line.  Rows
    without an id are left as they are; rows that repeat an id and its text count as one and lose the same lines; texts
    of any length are read whole.  Other columns are not read, whatever their names; an empty table gives no rows."""
    gone = removals(docs, percent)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(gone.hint("merge"), "doc_id", "left")

    def fn(batch):
        got = [without(t, g) for t, g in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist())]
        yield [batch.column("doc_id"), [n for _, n, _ in got], [k for _, _, k in got], [t for t, _, _ in got]]

    return arrow(rows.select("doc_id", "text", "gone"), fn, "doc_id bigint, n_lines bigint, n_removed bigint, text string")


def clean_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns kept, with the lines that stay; ``n_chars``, where there is such a column, follows
    the text.

    Nulls, empty and repeated rows and empty tables are treated as in ``dedup_lines``; columns of any other name and type
    pass through."""
    gone = removals(docs, percent)
    names = docs.columns
    whole = docs.select(whole_row(docs), F.col("doc_id").cast("bigint").alias("doc_id"))
    # Merged at any size: what goes is few enough to broadcast on a sample, but not of the corpus.
    joined = whole.join(gone.hint("merge"), "doc_id", "left").select("row", "gone")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = dict(zip(names, batch.column("row").flatten()))
                texts = [without(t, g)[0] for t, g in zip(columns["text"].to_pylist(), batch.column("gone").to_pylist())]
                columns["text"] = pa.array(texts, columns["text"].type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return joined.mapInArrow(run, docs.schema)
