"""Reduction to a closed universe of customers, with checks and the activity histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK, TARGET = 100, 10_000
BINS = ["1", "2", "3", "4", "5", "6-10", "11-20", "21-50", ">50"]


def scenario_customers(truth: DataFrame, scenarios: list[str], edges: DataFrame) -> DataFrame:
    """All parties of the transactions of the given scenarios."""
    txn = edges.join(truth.where(F.col("Scenario_Type").isin(scenarios)).select(F.col("Transaction_ID").alias("txn")).distinct(), "txn", "left_semi")
    return txn.select(F.col("sender").alias("customer")).union(txn.select("receiver")).where("customer is not null").distinct()


def levels(edges: DataFrame, fixed: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(customer, level)``: the chunk in which a customer is added; 0 are the fixed ones.

    The order is a hash of the id, so it is the same in every run.  Numbering all customers needs one order over them:
    a window over slices of the hash, whose counts (4096 at most) are summed first."""
    people = edges.select(F.col("sender").alias("customer")).union(edges.select("receiver")).where("customer is not null").distinct().withColumn("key", F.md5("customer"))
    if fixed is not None:
        people = people.join(fixed.select("customer"), "customer", "left_anti")
    people = people.withColumn("slice", F.substring("key", 1, 3))
    sums = people.groupBy("slice").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = people.join(F.broadcast(sums), "slice").withColumn("n", F.row_number().over(W.partitionBy("slice").orderBy("key", "customer")) + F.col("before") - 1)
    out = ranked.select("customer", (F.floor(F.col("n") / chunk) + 1).cast("bigint").alias("level"))
    return out if fixed is None else out.unionByName(fixed.select("customer", F.lit(0).cast("bigint").alias("level")))


def select_customers(edges: DataFrame, fixed: DataFrame | None = None, chunk: int = CHUNK, target: int = TARGET) -> DataFrame:
    """Customers of the first levels whose inner transactions reach the target: no loop, one count for each level."""
    lv = levels(edges, fixed, chunk)
    inner = edges.join(lv.select(F.col("customer").alias("sender"), F.col("level").alias("a")), "sender").join(lv.select(F.col("customer").alias("receiver"), F.col("level").alias("b")), "receiver")
    counts = inner.groupBy(F.greatest("a", "b").alias("level")).count().withColumn("total", F.sum("count").over(W.orderBy("level")))
    last = counts.where(F.col("total") >= target).agg(F.min("level").alias("last"))
    return lv.join(F.broadcast(last), F.col("last").isNull() | (F.col("level") <= F.col("last"))).select("customer")


def closed_universe(edges: DataFrame, customers: DataFrame) -> DataFrame:
    """Transactions of which both parties are selected."""
    c = customers.select("customer")
    return edges.join(c.withColumnRenamed("customer", "sender"), "sender", "left_semi").join(c.withColumnRenamed("customer", "receiver"), "receiver", "left_semi")


def follow_links(links: DataFrame, kept: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Rows of ``targets`` that a true link leads to from what is kept."""
    used = links.join(kept.select(key).distinct(), key, "left_semi")
    return targets.join(used.select(target_key).distinct(), target_key, "left_semi")


def orphans(links: DataFrame, records: DataFrame, key: str) -> DataFrame:
    return links.where(F.col(key).isNotNull()).join(records.select(key), key, "left_anti")


def validate(edges: DataFrame, customers: DataFrame, links: DataFrame) -> None:
    """Raises where a party is outside the universe, or a link leads nowhere."""
    if edges.count() != closed_universe(edges, customers).count():
        raise ValueError("a transaction leaves the universe")
    if not links.join(edges.select("txn"), "txn", "left_anti").isEmpty():
        raise ValueError("a link has no transaction")


def activity(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("sender").alias("customer")).union(edges.select("receiver"))
    return both.where("customer is not null").groupBy("customer").agg(F.count("*").alias("n"))


def activity_summary(edges: DataFrame) -> DataFrame:
    return activity(edges).agg(F.count("*").alias("customers"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"))


def histogram(edges: DataFrame) -> DataFrame:
    """Customers by number of transactions; bins without any have 0."""
    n = F.col("n")
    place = F.when(n <= 5, n).when(n <= 10, 6).when(n <= 20, 7).when(n <= 50, 8).otherwise(9).cast("bigint")
    counts = activity(edges).groupBy(place.alias("position")).agg(F.count("*").alias("k"))
    labels = edges.sparkSession.createDataFrame([(i + 1, b) for i, b in enumerate(BINS)], "position bigint, bin string")
    return labels.join(counts, "position", "left").select("position", "bin", F.coalesce("k", F.lit(0)).alias("n_customers"))
