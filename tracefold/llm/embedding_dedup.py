"""Embedding near-dedup by NN-descent.

Equal vectors of a label form one class.  Random hyperplanes deal the classes into buckets, which give the first
neighbour lists; each round then joins the neighbours of every node's neighbours (forward and reverse) and keeps the
nearest.  Lists of which every entry is a near duplicate are saturated and grow twofold in the next round.

Lists full of near copies can lack the one link between two dense groups.  So rows that share a bucket of any of many
tables, as many as leave a pair at the threshold apart with a chance of at most ``MISS``, are compared exactly too, in
groups of bounded size; a group's largest component need not meet itself.  An audit compares a sample of nodes with all
rows; links it finds are added, and while its recall is short the search starts again from other planes.  The edges span
components; inside a component all members are compared in blocks, which makes the link counts exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefold.llm.common import components, discard, materialize
from tracefold.llm.groups import arrow, group_links, grouped, rest_links, smallest_holders
from tracefold.llm.ngram_join import scramble

THRESHOLD = 0.98
#: First length of a neighbour list, and rounds; a saturated list doubles in each.
NEIGHBOURS, ROUNDS = 8, 3
TABLES, BUCKET = 8, 256
#: Members of a bucket of several parts that all of its parts meet.
PIVOTS = 4
#: Rows of a shared bucket, on average, and the chance that a pair at the threshold shares none.
SHARED, MISS = 32, 1e-6
#: Nodes in one audit, the recall it asks for, and how often the search starts before it fails.
AUDIT, RECALL, STARTS = 512, 0.999, 3
BLOCK = 512


def matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def vectors_of(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, vec)`` of the rows that can link: label not null, components finite, not all zero."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("vec")).where(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))


def planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits))


def nearest(ids: np.ndarray, sims: np.ndarray, k: int):
    """For each row of a square similarity matrix its ``k`` best others: ``(u, v, sim)``."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()


def first_lists(reps: DataFrame, bits: int, seed: int, threshold: float, scale: int) -> DataFrame:
    """Neighbour lists from buckets of random hyperplanes.

    A full bucket is dealt into parts, by other hashes in each table; every part also meets the pivots of its bucket, so
    that the parts of a tight group hold together through links with these."""

    def codes(batch):
        vec, dims = batch.column("vec"), np.diff(batch.column("vec").offsets.to_numpy())
        for dim in np.unique(dims):
            at = pa.array(np.flatnonzero(dims == dim))
            ids, labels, own = batch.column("id").take(at), batch.column("label").take(at), vec.take(at)
            m = matrix(own)
            for t in range(TABLES):
                code = ((m @ planes(int(dim), max(1, bits), seed * 1000 + t)) > 0) @ (1 << np.arange(max(1, bits), dtype=np.int64))
                yield [ids, labels, own, np.full(len(at), int(dim) * TABLES + t), code]

    dealt = arrow(reps.select("id", "label", "vec"), codes, "id bigint, label string, vec array<float>, slot int, code bigint")
    keys = ["label", "slot", "code"]
    sizes = dealt.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(BUCKET * scale)).cast("int").alias("parts"))
    dealt = dealt.join(materialize(sizes, "sizes"), keys).withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed), "slot"), F.col("parts")).cast("int"))
    drawn = [F.min_by(F.struct("id", "vec", "part"), F.xxhash64("id", F.lit(seed), "slot", F.lit(i))) for i in range(PIVOTS)]
    pivots = dealt.where("parts > 1").groupBy(*keys, "parts").agg(F.array_distinct(F.array(*drawn)).alias("drawn"))
    pivots = pivots.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(*keys, "part", F.explode("drawn").alias("p")).where("p.part <> part")
    cells = dealt.select(*keys, "part", "id", "vec", F.lit(False).alias("pivot")).unionByName(pivots.select(*keys, "part", "p.id", "p.vec", F.lit(True).alias("pivot")))

    def local(table):
        if table.num_rows > 1:
            m, ids, pivot = matrix(table.column("vec")), table.column("id").to_numpy(), table.column("pivot").to_numpy()
            sims = cosines(m, m)
            u, v, sim = nearest(ids, sims, NEIGHBOURS * scale)
            a, b = np.nonzero(sims[:, pivot] >= threshold)
            return np.r_[u, ids[a]], np.r_[v, ids[pivot][b]], np.r_[sim, sims[:, pivot][a, b]]

    return grouped(cells, [*keys, "part"], "u bigint, v bigint, sim double", local)


def best(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nearest entries of each list, as many as its node's size."""
    ranked = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v")))
    return ranked.join(sizes, "u").where("rank <= k").drop("rank", "k")


def descend(reps: DataFrame, graph: DataFrame, sizes: DataFrame, scale: int) -> DataFrame:
    """One local join: the members of each neighbourhood are compared, and pairs nearer than a list's last go on."""
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n")).join(sizes, "u")
    worst = worst.select(F.col("u").alias("member"), F.when(F.col("n") < F.col("k"), F.lit(-2.0)).otherwise(F.col("worst")).alias("worst"), "k")
    back = graph.select(F.col("v").alias("c"), F.col("u").alias("member"))
    back = back.withColumn("r", F.row_number().over(W.partitionBy("c").orderBy(F.xxhash64("member")))).where(F.col("r") <= 2 * NEIGHBOURS * scale).drop("r")
    members = graph.select(F.col("u").alias("c"), F.col("v").alias("member")).union(back).union(sizes.select("u", "u")).distinct()
    members = members.join(worst, "member").join(reps.select(F.col("id").alias("member"), "vec"), "member")

    def local(table):
        if table.num_rows < 2:
            return None
        ids, worst, k = (table.column(x).to_numpy() for x in ("member", "worst", "k"))
        m = matrix(table.column("vec"))
        u, v, sim = nearest(ids, cosines(m, m), int(k.max()))
        good = sim > np.repeat(worst, len(u) // len(ids))
        return u[good], v[good], sim[good]

    return grouped(members, ["c"], "u bigint, v bigint, sim double", local)


def search(reps: DataFrame, bits: int, seed: int, threshold: float, scale: int = 1) -> DataFrame:
    """Edges ``(a, b)`` at or above the threshold that one start of the search finds; lists, buckets and rounds grow with
    ``scale``, a power of two."""
    bits = max(0, bits - scale.bit_length() + 1)
    first = materialize(first_lists(reps, bits, seed, threshold, scale), "first")
    near = materialize(first.where(F.col("sim") >= threshold).select("u", "v").distinct(), "near")
    sizes = reps.select(F.col("id").alias("u"), F.lit(NEIGHBOURS * scale).alias("k"))
    graph = materialize(best(first, sizes), "graph")
    discard(first)
    for _ in range(ROUNDS + scale.bit_length() - 1):
        full = graph.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
        k = F.when((F.col("n") >= F.col("k")) & (F.col("least") >= threshold), F.col("k") * 2).otherwise(F.col("k"))
        sizes = materialize(sizes.join(full, "u", "left").select("u", F.coalesce(k, "k").cast("int").alias("k")), "sizes")
        fresh = materialize(descend(reps, graph, sizes, scale), "fresh")
        merged = materialize(best(graph.unionByName(fresh), sizes), "graph")
        moved = merged.join(graph.select("u", "v"), ["u", "v"], "left_anti").where(F.col("sim") >= threshold - 0.05).isEmpty()
        discard(graph, fresh)
        graph = merged
        if moved:
            break
    return graph.where(F.col("sim") >= threshold).select("u", "v").union(near).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()


def tables_for(threshold: float, bits: int) -> int:
    """How many tables of ``bits`` planes leave a pair at the threshold without a shared bucket with chance ``MISS``."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if same >= 1 else math.ceil(math.log(MISS) / math.log1p(-same))


def spanning(ids: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a block."""
    np.fill_diagonal(near, False)
    links, free = [], near.any(axis=1)
    for start in np.flatnonzero(free):
        todo = [start] if free[start] else []
        free[start] = False
        while todo:
            i = todo.pop()
            fresh = np.flatnonzero(near[i] & free)
            free[fresh] = False
            links += [(int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))) for j in fresh]
            todo += fresh.tolist()
    return links


def bucket_links(reps: DataFrame, largest: int, total: int, seed: int, threshold: float) -> DataFrame:
    """Links ``(a, b)`` that span what the rows of shared buckets link, all pairs of a bucket decided."""
    bits = max(0, math.ceil(math.log2(max(1, largest / SHARED))))
    tables = tables_for(threshold, bits)

    def keyed(batch):
        vec, dims = batch.column("vec"), np.diff(batch.column("vec").offsets.to_numpy())
        for dim in np.unique(dims):
            at = pa.array(np.flatnonzero(dims == dim))
            own = scramble(batch.column("label_hash").take(at).to_numpy().view(np.uint64) + np.uint64(dim))
            signs = matrix(vec.take(at)) @ planes(int(dim), max(1, bits * tables), 1_000_003 + seed) > 0
            if not bits:
                signs[:] = False
            codes = signs.reshape(len(own), tables, -1) @ (1 << np.arange(signs.shape[1] // tables, dtype=np.uint64))
            keys = scramble(scramble(own[:, None] + np.arange(tables, dtype=np.uint64)) ^ codes.astype(np.uint64))
            ends = np.arange(0, keys.size + 1, tables, dtype=np.int32)
            yield [batch.column("node").take(at), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))]

    rows = arrow(reps.select(F.col("id").alias("node"), F.xxhash64("label").alias("label_hash"), "vec"), keyed, "node bigint, keys array<bigint>")
    members = smallest_holders(rows, total * tables)

    def search(table):
        table = table.combine_chunks()
        labels, vec = np.array(table.column("label").to_pylist(), object), table.column("vec").chunk(0)
        dims, ids = np.diff(vec.offsets.to_numpy()), table.column("id").to_numpy()
        links = []
        for label, dim in set(zip(labels.tolist(), dims.tolist())):
            at = np.flatnonzero((labels == label) & (dims == dim))
            at = at[np.unique(ids[at], return_index=True)[1]]
            if len(at) > 1:
                m = matrix(vec.take(pa.array(at)))
                links += spanning(ids[at], cosines(m, m) >= threshold)
        return links

    records = reps.select(F.col("id").alias("node"), "id", "label", "vec")
    links, large = group_links(members, records, search)
    if not large.isEmpty():
        comp = components(links)
        links = links.union(rest_links(large, members, records, comp, search))
    return links


def audit(reps: DataFrame, threshold: float, seed: int) -> DataFrame:
    """All links ``(a, b)`` of a sample of fixed size, by comparison with every row; the sample is sent to all tasks."""
    sample = reps.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(AUDIT).select("id", "label", "vec").toPandas()
    by = {}
    for i, label, vec in sample.itertuples(index=False):
        by.setdefault((label, len(vec)), []).append((i, np.asarray(vec, np.float64)))
    asked = {k: (np.array([i for i, _ in x]), np.array([v for _, v in x])) for k, x in by.items()}

    def fn(batch):
        ids, labels, vec = batch.column("id").to_numpy(), np.array(batch.column("label").to_pylist(), object), batch.column("vec")
        dims = np.diff(vec.offsets.to_numpy())
        for (label, dim), (qi, qv) in asked.items():
            at = np.flatnonzero((labels == label) & (dims == dim))
            if len(at):
                x, y = np.nonzero(cosines(matrix(vec.take(pa.array(at))), qv) >= threshold)
                a, b = ids[at][x], qi[y]
                yield [np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]]

    return arrow(reps.select("id", "label", "vec"), fn, "a bigint, b bigint").distinct()


def audited(true: DataFrame, comp: DataFrame) -> tuple[int, int]:
    """How many true links an audit has, and how many of them lie inside components, where all links are found."""
    seen = true.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return tuple(seen.agg(F.count("*"), F.count(F.when(F.col("ca") == F.col("cb"), 1))).first())


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``rows``.

    Rows are compared when labels are equal and not null and lengths agree, by cosine in double precision.  Vectors that
    are null, empty or zero, or hold null or non-finite components, link with nothing, nor do rows without an id; their
    component is their own id.  Copies link with each other; repeated rows count as rows.  Other columns are not read;
    an empty table gives no rows."""
    valid = vectors_of(rows, id_col, vec_col, label_col).where("vec_id is not null")
    reps = valid.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"))
    reps = materialize(reps, "vectors")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, largest / 64))))
    total, links = reps.count(), None
    for start in range(STARTS):
        found = search(reps, bits, start, threshold, 1 << start).unionByName(bucket_links(reps, largest, total, start, threshold))
        links = materialize((found if links is None else links.union(found)).distinct(), "links")
        comp = components(links)
        true = materialize(audit(reps, threshold, start), "audit")
        n, hit = audited(true, comp)
        if hit < n:
            links = materialize(links.union(true).distinct(), "links")
            comp = components(links)
        if hit >= RECALL * n:
            break
    else:
        raise RuntimeError(f"recall stays at {hit} of {n} audited links after {STARTS} searches")
    inside = reps.join(comp, reps["id"] == comp["node"]).select("id", "m", "vec", "component")
    blocks = comp.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    inside = materialize(inside.join(blocks, "component").withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "inside")
    pairs = inside.withColumn("y", F.explode(F.expr("sequence(0, blocks - 1)"))).select("component", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "x", "id", "m", "vec")

    def local(table):
        side, ids, m = (table.column(c).to_numpy() for c in ("x", "id", "m"))
        v = matrix(table.column("vec"))
        p, q = int(table.column("p")[0].as_py()), int(table.column("q")[0].as_py())
        a, b = np.flatnonzero(side == p), np.flatnonzero(side == q)
        near = cosines(v[a], v[b]) >= threshold
        if p == q:
            np.fill_diagonal(near, False)
            return ids[a], (near @ m[b]).astype(np.int64)
        return np.r_[ids[a], ids[b]], np.r_[near @ m[b], m[a] @ near].astype(np.int64)

    others = grouped(pairs, ["component", "p", "q"], "id bigint, links bigint", local).groupBy("id").agg(F.sum("links").alias("links"))
    each = materialize(reps.join(others, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left").select("label", "vec", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "each")
    flagged = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    joined = flagged.join(each, ["label", "vec"], "left")
    n_links, component = F.coalesce("n_links", F.lit(0)), F.coalesce("component_id", "vec_id")
    without = F.col("vec_id").isNull()
    joined = joined.select("vec_id", F.when(without, F.lit(0)).otherwise(n_links).alias("n_links"), F.when(~without, component).alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
