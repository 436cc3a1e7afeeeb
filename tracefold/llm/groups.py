"""Groups of records that share keys, and exact links inside them.

A key (a band of a signature, a rare shingle) is shared by the records that hold it.  All keys with the same smallest
holder form one group, in which each record comes once, so two records that share any key meet in the group of that key's
smallest holder.  Groups are searched in parts of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracefold.llm.common import discard, freed, materialize

#: Keys of one part of the hash space, on average; a part of more than HEAVY is looked through for hot keys.
PART_KEYS, HEAVY = 1 << 20, 1 << 22
#: Records of a part of a group.
BLOCK = 512


def arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(batch) -> columns``; batches without rows give none."""
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, to.types)], schema=to)

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, keys: list[str], schema: str, fn: Callable, parts: int | None = None) -> DataFrame:
    """``fn(table) -> columns or None`` for each group, streamed from sorted partitions (``parts`` of them, where given)."""
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def send(pieces):
            got = fn(pa.Table.from_batches(pieces))
            if got is not None and len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, to.types)], schema=to)

        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            cuts = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(own)]):
                if held and own[a] != key:
                    yield from send(held)
                    held = []
                key = own[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from send(held)

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def flat_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a batch, and the node of each."""
    keys = batch.column("keys")
    return keys.flatten().to_numpy(), np.repeat(batch.column("node").to_numpy(), np.diff(keys.offsets.to_numpy()))


def hot_keys(rows: DataFrame, bits: int, heavy: int) -> list[int]:
    """Keys of more than ``heavy / 2`` records: only parts of more than ``heavy`` keys are looked through.

    There are fewer than ``2 / heavy`` of all keys of them."""

    def count(batch):
        n = np.bincount(part_of(flat_keys(batch)[0], bits))
        some = np.flatnonzero(n)
        yield [some, n[some]]

    with freed(rows.sparkSession):
        crowded = [r.p for r in arrow(rows, count, "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > heavy).collect()]
    if not crowded:
        return []

    def inside(batch):
        flat, _ = flat_keys(batch)
        keys, n = np.unique(flat[np.isin(part_of(flat, bits), crowded)], return_counts=True)
        yield [keys, n]

    with freed(rows.sparkSession):
        return [r.key for r in arrow(rows, inside, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > heavy // 2).collect()]


def smallest_holders(rows: DataFrame, total: int) -> DataFrame:
    """``(head, node)`` of rows ``(node, keys)`` with ``total`` keys in all: each node with the smallest node of every key
    that it shares, unless it is that node itself.

    Packed keys are dealt over parts of the hash space of about ``PART_KEYS``.  Hot ones are not dealt: their smallest
    holders are combined before the exchange and joined, a join that adaptive execution can split."""
    bits = min(22, max(6, math.ceil(math.log2(max(1, total / PART_KEYS)))))
    hot = np.array(sorted(hot_keys(rows, bits, HEAVY)), np.int64)

    def split(batch):
        flat, nodes = flat_keys(batch)
        if len(hot):
            cold = ~np.isin(flat, hot)
            flat, nodes = flat[cold], nodes[cold]
        if not len(flat):
            return
        part = part_of(flat, bits)
        order = np.argsort(part, kind="stable")
        part, flat, nodes = part[order], flat[order], nodes[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[cuts[1:], len(part)]
        yield [part[cuts], [flat[a:b].tobytes() for a, b in zip(cuts, ends)], [nodes[a:b].tobytes() for a, b in zip(cuts, ends)]]

    def shared(table):
        key, node = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("keys", "nodes"))
        order = np.argsort(key)
        key, node = key[order], node[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        head = np.repeat(np.minimum.reduceat(node, starts), np.diff(np.r_[starts, len(key)]))
        met = np.unique(np.stack([head, node], axis=1)[head != node], axis=0)
        return met[:, 0], met[:, 1]

    out = grouped(arrow(rows, split, "p int, keys binary, nodes binary"), ["p"], "head bigint, node bigint", shared, 1 << bits)
    if len(hot):

        def known(batch):
            flat, nodes = flat_keys(batch)
            at = np.isin(flat, hot)
            yield [flat[at], nodes[at]]

        each = arrow(rows, known, "key bigint, node bigint")
        out = out.union(each.join(each.groupBy("key").agg(F.min("node").alias("head")), "key").where("node <> head").select("head", "node"))
    return materialize(out.distinct(), "members")


def links_in(dealt: DataFrame, keys: list[str], search: Callable) -> DataFrame:
    """Links ``(a, b)`` that ``search(table)`` finds in the rows with equal keys."""

    def local(table):
        links = search(table)
        return [a for a, _ in links], [b for _, b in links]

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: small rows can be long work
    return grouped(dealt, keys, "a bigint, b bigint", local, parts).distinct()


def group_links(members: DataFrame, records: DataFrame, search: Callable) -> tuple[DataFrame, DataFrame]:
    """Links inside the parts of each group, which all hold the head; and ``(head, parts)`` of the groups of several parts.

    ``records`` are ``(node, id, ...)``; ``search`` gets them with ``root``, which is ``id`` here."""
    sizes = materialize(members.groupBy("head").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts")), "sizes")
    rows = members.join(sizes, "head").select("head", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    heads = sizes.select("head", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("head").alias("node"))
    dealt = rows.union(heads).join(records, "node").withColumn("root", F.col("id"))
    return materialize(links_in(dealt, ["head", "part"], search), "links"), sizes.where("parts > 1")


def rest_links(large: DataFrame, members: DataFrame, records: DataFrame, comp: DataFrame, search: Callable) -> DataFrame:
    """Links across the parts of the large groups: the records outside a group's largest component meet all its records,
    in blocks.  Records of the largest one need not meet each other."""
    rows = members.join(large, "head").select("head", "parts", "node").union(large.select("head", "parts", F.col("head").alias("node")))
    known = comp.select(F.col("node").alias("id"), "component")
    rows = materialize(rows.join(records.select("node", "id"), "node").join(known, "id", "left").select("head", "parts", "id", F.coalesce("component", "id").alias("root")), "rooted")
    roots = rows.groupBy("head", "root").agg(F.count("*").alias("n")).groupBy("head")
    roots = roots.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.ceil((F.sum("n") - F.max("n")) / F.lit(BLOCK)).cast("int").alias("others")).where("others > 0")
    both = rows.join(roots, "head")
    outer = both.where("root <> main").withColumn("x", F.pmod(F.xxhash64("id"), F.col("others")).cast("int")).withColumn("y", F.explode(F.expr("sequence(0, parts - 1)")))
    every = both.withColumn("y", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("x", F.explode(F.expr("sequence(0, others - 1)")))
    columns = ["head", "x", "y", "id", "root"]
    dealt = outer.select(columns).union(every.select(columns)).join(records, "id")
    out = materialize(links_in(dealt, ["head", "x", "y"], search), "missed")
    discard(rows)
    return out
