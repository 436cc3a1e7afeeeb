"""Helpers that the corpus operators share: words, intermediate tables, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a Java regular expression.
GAPS = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_find_package(spark: SparkSession) -> None:
    """Python workers also look for this package where the driver has it (no harm where that folder is missing)."""
    home = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment
    if home not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(x for x in (home, held.get("PYTHONPATH")) if x)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, out of the way of names that a join adds."""
    return F.struct(*map(quoted, docs.columns)).alias("row")


def unpacked(joined: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, from ``row``."""
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_hashes(text: Column) -> Column:
    """One 64-bit hash per word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).  Where it is unset, a session on one machine gets a
    folder of its own, and a cluster, whose machines would each write to their own disk, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracefold-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark deletes the shuffle files of an execution at its end where this is true.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has run."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: later stages reread replicated files when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracefold_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete intermediate tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_tracefold_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by contraction: ``(node, component)``, component = the smallest node reachable.

    Every round hooks each node to its smallest neighbour (a partial aggregate, so hubs are no hot group),
    resolves the resulting forest by pointer jumping, and contracts the edges.  Joins on hubs are plain
    sort-merge joins of two exchanges, which adaptive execution splits.  Each round is a table in the shared
    folder.  No edges give no rows; edges with a null end and loops are ignored."""
    work = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    work = materialize(work.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not work.isEmpty():
        both = work.union(work.select("b", "a"))
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parent")
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialize(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")), "jump")
            done = jumped.where("moved").isEmpty()
            discard(parent)
            parent = jumped
            if done:
                break
        roots = parent.select("node", F.col("up").alias("root"))
        if labels is None:
            fresh = roots.select("node", F.col("root").alias("component"))
            keep = parent
        else:
            up = roots.withColumnRenamed("node", "component")
            moved = labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            fresh = keep = materialize(moved, "labels")
            discard(labels)
        left = work.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        left = left.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        contracted = materialize(left.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        discard(work)
        if keep is not parent:
            discard(parent)
        fresh._tracefold_path = keep._tracefold_path
        work, labels = contracted, fresh
    if labels is None:
        return work.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
