"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Documents whose shingle sets are equal form one class.  A pair with Jaccard similarity t or more shares at least
``ceil(t * n)`` shingles of each side, so a pass over inverted lists counts for each class how many of its shingles any
other class has, and drops those below that number.  Of the shared shingles of a class that holds ``cnt`` and needs
``need``, two linked classes have one of the ``cnt - need + 1`` rarest in common; all classes that hold such a shingle meet
in the group of its smallest holder.  There a T-occurrence search links them: each class is a query against inverted lists
of the shingles of one class for each component found so far, short lists are merged by counting, long ones are binary-probed,
and candidates that reach the required overlap are decided exactly.  Classes that could still link with another component
then search the lists of all such classes.  Nothing is dropped: links inside a component that is already joined are the
only ones not looked for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracefold.llm.common import ascii_lower, components, discard, materialize, unpacked, whole_row, word_hashes
from tracefold.llm.groups import arrow, group_links, rest_links, smallest_holders

#: Odd multipliers of the shingle and band hashes.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
#: Shingles per inverted-list partition; the number of partitions follows the input.
LIST_TOKENS = 1 << 22
#: Shingles of a batch that are split at once.
SPLIT_TOKENS = 1 << 20
#: Bits of a shingle hash kept besides those that number its partition.
TOKEN_BITS = 48
#: Weight of a binary probe against a merge step in the choice of long lists.
MU = 4.0


def scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX[4])
        x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(32))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes; a shorter sequence is one run, an empty one has none."""
    if not len(h):
        return np.empty(0, np.uint64)
    n, take = len(h), min(size, len(h))
    with np.errstate(over="ignore"):
        acc = np.full(n - take + 1, take, np.uint64)
        for i in range(take):
            acc = acc * np.uint64(MIX[0]) + scramble(h[i : n - take + 1 + i] + np.uint64(MIX[2]))
    return scramble(acc)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of an array, sorted; the array is sorted in place."""
    x.sort()
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.r_[True, new]]


def rows_of(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The lists of a batch as unsigned arrays, without copies."""
    col = batch.column(name)
    flat, ends = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
    for i in range(len(col)):
        yield flat[ends[i] : ends[i + 1]]


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def classes_of(base: DataFrame, size: int) -> DataFrame:
    def fn(batch):
        sets = [distinct(shingle_hashes(h, size)) for h in rows_of(batch, "h")]
        yield [batch.column("doc_id"), [len(s) for s in sets], [digest(s) if len(s) else None for s in sets]]

    return arrow(base, fn, "doc_id bigint, n_shingles bigint, key binary")


def split_tokens(ids: list[bytes], groups: list[bytes], ns: list[int], sets: list[np.ndarray], bits: int):
    """Rows ``(p, ids, groups, ns, counts, low, high)``: the shingles of a batch, by partition of the hash space."""
    at, n = 0, len(sets)
    while at < n:  # parts of bounded size: the arrays of a whole batch would take the memory of the executor
        to, size = at, 0
        while to < n and (to == at or size + len(sets[to]) <= SPLIT_TOKENS):
            size += len(sets[to])
            to += 1
        if size:
            yield _split_part(ids[at:to], groups[at:to], ns[at:to], sets[at:to], bits)
        at = to


def _split_part(ids: list[bytes], groups: list[bytes], ns: list[int], sets: list[np.ndarray], bits: int) -> list[list]:
    counts = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), counts)
    part = (tokens >> np.uint64(64 - bits)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    rest = (tokens[order] >> np.uint64(64 - bits - TOKEN_BITS)) & np.uint64((1 << TOKEN_BITS) - 1)
    low, high = (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint16)
    owner, part = owner[order], part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    out = [[] for _ in range(7)]
    for a, b in zip(starts, np.r_[starts[1:], len(part)]):
        own, cnt = np.unique(owner[a:b], return_counts=True)
        for col, value in zip(out, (int(part[a]), b"".join(ids[i] for i in own), b"".join(groups[i] for i in own), np.array([ns[i] for i in own], np.uint32).tobytes(), cnt.astype(np.uint32).tobytes(), low[a:b].tobytes(), high[a:b].tobytes())):
            col.append(value)
    return out


SPLIT = "p int, ids binary, groups binary, ns binary, counts binary, low binary, high binary"


def shared_in(rows: list[tuple], bits: int, width: int):
    """Of one partition of the hash space: for each id the shingles that other groups have too, and in how many groups."""
    p = rows[0][0]
    ids = np.concatenate([np.frombuffer(r[1], f"V{width}") for r in rows])
    groups = np.concatenate([np.frombuffer(r[2], f"V{width}") for r in rows])  # none: each id is its own group
    ns = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
    counts = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows]).astype(np.int64)
    tokens = np.concatenate([np.frombuffer(r[5], np.uint32).astype(np.uint64) | (np.frombuffer(r[6], np.uint16).astype(np.uint64) << np.uint64(32)) for r in rows])
    rows.clear()
    kept = np.zeros(len(ids), bool)
    kept[np.unique(ids, return_index=True)[1]] = True  # copies have the same shingles
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    use = kept[owner]
    owner, tokens = owner[use], tokens[use]
    if not len(tokens):
        return
    if len(groups):
        group = np.unique(groups, return_inverse=True)[1].astype(np.int32)[owner]
        order = np.lexsort((group, tokens))
        t, g = tokens[order], group[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])]
    else:
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        new = np.ones(len(t), bool)
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    df = np.repeat(np.add.reduceat(new.astype(np.int32), starts), np.diff(np.r_[starts, len(t)]))
    many = df > 1
    own, t, df = owner[order[many]], t[many] | np.uint64(p << TOKEN_BITS), df[many]
    del tokens, owner, order, new
    order = np.argsort(own, kind="stable")
    own, t, df = own[order], t[order], np.minimum(df[order], 0xFFFFFFFF).astype(np.uint32)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
    for a, b in zip(starts, np.r_[starts[1:], len(own)] if len(own) else []):
        i = own[a]
        yield ids[i].tobytes(), int(ns[i]), int(b - a), t[a:b].tobytes(), df[a:b].tobytes()


def shared_tokens(split: DataFrame, bits: int, width: int, percent: int) -> DataFrame:
    """``(id, n, cnt, toks, dfs)`` of the ids that share the shingles a partner needs (``percent`` of their own)."""
    schema = "id binary, n int, cnt int, toks binary, dfs binary"
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def send(rows):
            found = list(zip(*shared_in(rows, bits, width)))
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
    each = lists.groupBy("id").agg(F.first("n").alias("n"), F.sum("cnt").alias("cnt"), F.collect_list(F.struct("toks", "dfs")).alias("lists"))
    return each.where(F.col("cnt") * 100 >= F.col("n") * percent)


def joined(col: pa.Array, field: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x[field] for x in row), kind) for row in col.to_pylist()]


def t_occurrences(lists: list, least: int, mu: float = MU) -> dict[int, int]:
    """DivideSkip: the records in at least ``least`` of the sorted lists, with their counts.

    The L longest lists are set aside; the others are merged by counting and must hold a record ``least - L`` times;
    the long ones are then probed by binary search, until too few are left to reach ``least``."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if least < 1 or len(lists) < least:
        return {}
    n_long = min(least - 1, int(least / (mu * math.log2(max(2, len(lists[-1]))) + 1)))
    cut = len(lists) - n_long
    counts = np.bincount(np.concatenate(lists[:cut]))
    records = np.flatnonzero(counts >= least - n_long)
    counts = counts[records]
    for left, x in zip(range(n_long, 0, -1), lists[cut:]):
        can = counts + left >= least
        if not can.all():
            records, counts = records[can], counts[can]
        if not len(records):
            return {}
        x = np.asarray(x)
        counts += x[np.minimum(np.searchsorted(x, records), len(x) - 1)] == records
    reach = counts >= least
    return dict(zip(records[reach].tolist(), counts[reach].tolist()))


def search_block(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links of one block: rows ``(id, root, n, toks)``; a pair of components is linked once.

    Each record searches the inverted lists of the block.  How often a record occurs in them is the overlap itself."""
    rows = sorted({r[0]: r for r in rows}.values())
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while x in up:
            if up[x] in up:
                up[x] = up[up[x]]
            x = up[x]
        return x

    links: list[tuple[int, int]] = []
    if len({r[1] for r in rows}) < 2:
        return links
    ends = np.cumsum([len(x) for x in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(rows)), [len(x) for x in sets])
    order = np.argsort(tokens, kind="stable")
    owner, new = owner[order], np.r_[True, np.diff(tokens[order]) > 0][: len(order)]
    of = np.empty(len(tokens), np.int64)
    of[order] = np.cumsum(new) - 1
    cuts = np.r_[np.flatnonzero(new), len(order)]
    shared = np.diff(cuts) > 1
    for i, r in enumerate(rows):
        own = of[ends[i] - len(sets[i]) : ends[i]]
        own = own[shared[own]]
        for j, same in t_occurrences([owner[a:b] for a, b in zip(cuts[own].tolist(), cuts[own + 1].tolist())], -(-r[2] * percent // 100)).items():
            if j < i and 100 * same >= percent * (r[2] + rows[j][2] - same):
                x, y = find(r[1]), find(rows[j][1])
                if x != y:
                    links.append((r[0], rows[j][0]))
                    up[max(x, y)] = min(x, y)
    return links


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; a set holds the distinct runs of ``size``
    words, or the whole sequence when there are fewer.  Two rows link when ``100 * |A & B| >= percent * |A | B|``.
    Null, empty and blank texts have an empty set and link with nothing: their component is their own id.  Repeated
    rows and ties fall into one class, whose component is the smallest id; a row without an id takes that of its
    class, or null.  Other columns are not read, so clashing names do no harm; an empty table gives no rows."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), word_hashes(ascii_lower(F.col(text_col))).alias("h"))
    rows = materialize(classes_of(base, size), "shingles")
    reps = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"))
    total = reps.agg(F.sum("n")).first()[0] or 0
    bits = min(15, max(6, math.ceil(math.log2(max(1, total / LIST_TOKENS)))))

    def split(batch):
        sets = {}
        for h in rows_of(batch, "h"):
            s = distinct(shingle_hashes(h, size))
            if len(s):
                sets.setdefault(digest(s), s)
        keys = list(sets)
        yield from split_tokens(keys, [b""] * len(keys), [len(s) for s in sets.values()], list(sets.values()), bits)

    near = shared_tokens(arrow(base, split, SPLIT), bits, 16, percent).withColumnRenamed("id", "key")
    near = near.join(reps.select("key", "node"), "key").where("node is not null").select("node", "n", "lists")

    def rarest(batch):
        toks, dfs = (joined(batch.column("lists"), field, kind) for field, kind in (("toks", np.uint64), ("dfs", np.uint32)))
        ns = batch.column("n").to_pylist()
        prefixes = [len(t) - -(-n * percent // 100) + 1 for t, n in zip(toks, ns)]
        keys = [scramble(t[np.lexsort((t, d))[:k]]).view(np.int64) for t, d, k in zip(toks, dfs, prefixes)]
        yield [batch.column("node"), ns, [np.sort(t).tobytes() for t in toks], keys]

    near = materialize(arrow(near, rarest, "node bigint, n int, toks binary, keys array<bigint>"), "near")
    members = smallest_holders(near.select("node", "keys"), near.agg(F.sum(F.size("keys"))).first()[0] or 0)

    def search(table):
        return search_block(list(zip(*(table.column(c).to_pylist() for c in ("id", "root", "n", "toks")))), percent)

    records = near.select("node", F.col("node").alias("id"), "n", "toks")
    links, large = group_links(members, records, search)
    comp = components(links)
    if not large.isEmpty():
        more = rest_links(large, members, records, comp, search)
        if not more.isEmpty():
            discard(comp)
            comp = components(links.union(more))
    discard(near, members, links)
    ids = reps.select("key", "node").join(comp, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    return rows.join(ids, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Rows of ``docs``, all columns kept, one for each component: that with the smallest id.

    Rows without an id stay; of rows with one id, linked or not, one stays.  Documents without words link with nothing and
    stay.  Columns of any other name and type pass through; an empty table gives no rows."""
    comp = materialize(ngram_components(docs, percent=percent), "groups")
    heads = comp.where("doc_id = component_id or doc_id is null").groupBy("doc_id").agg(F.count("*").alias("k"))
    heads = materialize(heads, "heads")
    discard(comp)
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("bigint").alias("id"))
    # Merged at any size: heads that are few enough to broadcast on a sample are not so on the corpus.
    kept = rows.join(heads.select("doc_id").hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    if heads.where("doc_id is not null and k > 1").isEmpty():
        return unpacked(kept, docs)
    return unpacked(kept.where("id is not null").dropDuplicates(["id"]).unionByName(kept.where("id is null")), docs)
