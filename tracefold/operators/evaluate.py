"""Ranking metrics, exact and in SQL terms, over ``(id, score, label)``; ties of a score go by id where order counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(rows: DataFrame, ks: list[int]) -> DataFrame:
    """``(k, hits, precision_at_k, recall_at_k)``; the best rows are found by a limit, not by ranking all."""
    total = rows.agg(F.sum("label").alias("positives"))
    best = rows.orderBy(F.desc("score"), "id").limit(max(ks)).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    each = best.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k").groupBy("k").agg(F.sum("label").alias("hits"))
    return each.join(F.broadcast(total)).select("k", "hits", (F.col("hits") / F.col("k")).alias("precision_at_k"), F.when(F.col("positives") > 0, F.col("hits") / F.col("positives")).otherwise(0.0).alias("recall_at_k"))


def by_score(rows: DataFrame) -> DataFrame:
    """Positives and rows for each distinct score, and summed from the top (one window over distinct scores)."""
    w = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    g = rows.groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    return g.withColumn("tp", F.sum("p").over(w)).withColumn("seen", F.sum("n").over(w))


def average_precision(rows: DataFrame) -> DataFrame:
    return by_score(rows).agg((F.sum(F.col("p") * F.col("tp") / F.col("seen")) / F.sum("p")).alias("average_precision"))


def roc_auc(rows: DataFrame) -> DataFrame:
    g = by_score(rows).withColumn("fp_before", (F.col("seen") - F.col("n")) - (F.col("tp") - F.col("p")))
    below = F.sum("p") * F.sum(F.col("n") - F.col("p"))
    lost = F.sum(F.col("p") * (F.col("fp_before") + (F.col("n") - F.col("p")) / 2))
    return g.agg((1 - lost / below).alias("roc_auc"))


def threshold(rows: DataFrame) -> DataFrame:
    """The score percentile at the prevalence, and precision, recall and F1 there."""
    q = rows.agg((1 - F.avg("label")).alias("q")).first()["q"]
    cut = rows.agg(F.percentile("score", F.lit(q)).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    c = rows.join(F.broadcast(cut)).groupBy("threshold").agg(F.count(F.when(hit & (F.col("label") == 1), 1)).alias("tp"), F.count(F.when(hit & (F.col("label") == 0), 1)).alias("fp"), F.count(F.when(~hit & (F.col("label") == 1), 1)).alias("fn"))
    return c.select("threshold", "tp", "fp", "fn", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def with_labels(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows with the label that the truth ``(id, label)`` has for their id; 0 without one."""
    return rows.join(truth.select("id", "label"), "id", "left").withColumn("label", F.coalesce(F.col("label").cast("int"), F.lit(0)))


def f1_threshold(rows: DataFrame) -> DataFrame:
    """``(threshold, f1)``: the score that gives the best F1 when it and all above count as hits, the smallest of equals."""
    total = rows.agg(F.sum("label").alias("positives"))
    precision, recall = F.col("tp") / F.col("seen"), F.col("tp") / F.col("positives")
    f1 = 2 * precision * recall / (precision + recall + 1e-10)
    best = by_score(rows).join(F.broadcast(total)).where("positives > 0").withColumn("f1", f1)
    return best.agg(F.max_by("score", F.struct("f1", -F.col("score"))).alias("threshold"), F.max("f1").alias("f1"))


def scenario_rollup(rows: DataFrame, ks: tuple[int, ...] = (50, 100, 250)) -> DataFrame:
    """One row for each scenario but NORMAL: its rows, how many of them are among the ``k`` best of all, and their share."""
    best = rows.orderBy(F.desc("score"), "id").limit(max(ks)).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))).select("id", "rank")
    j = rows.where("scenario <> 'NORMAL'").join(best, "id", "left").groupBy("scenario")
    out = j.agg(F.count("*").alias("total_in_test"), *(F.count(F.when(F.col("rank") <= k, 1)).alias(f"detected_k{k}") for k in ks))
    return out.select("*", *(F.concat(F.format_number(100 * F.col(f"detected_k{k}") / F.col("total_in_test"), 2), F.lit("%")).alias(f"recall_k{k}") for k in ks))


def scenario_recall(rows: DataFrame, k: int) -> DataFrame:
    """Recall among the ``k`` best by scenario: ``rows (id, score, label, scenario)``."""
    best = rows.orderBy(F.desc("score"), "id").limit(k).select("id", F.lit(1).alias("in_top"))
    j = rows.where("label = 1").join(best, "id", "left")
    return j.groupBy("scenario").agg(F.count("*").alias("n"), F.count("in_top").alias("hits"), (F.count("in_top") / F.count("*")).alias("recall_at_k"))


def errors(rows: DataFrame, cut: float, n: int = 10) -> DataFrame:
    """The surest false alarms and the least sure misses."""
    fp = rows.where((F.col("score") >= cut) & (F.col("label") == 0)).orderBy(F.desc("score"), "id").limit(n).withColumn("kind", F.lit("FP"))
    fn = rows.where((F.col("score") < cut) & (F.col("label") == 1)).orderBy("score", "id").limit(n).withColumn("kind", F.lit("FN"))
    return fp.unionByName(fn)


def temporal_split(rows: DataFrame, cuts: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """``(id, part)`` by position in time: train, validation, test.

    Positions are counted by day first, so no window holds all rows."""
    rows = rows.withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    days = rows.groupBy("day").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.expr("sum(count) over ()")).drop("count")
    at = F.row_number().over(W.partitionBy("day").orderBy("us", "id")) + F.col("before") - 1
    part = F.when(F.col("at") < F.floor(F.col("total") * cuts[0]), "train").when(F.col("at") < F.floor(F.col("total") * cuts[1]), "validation").otherwise("test")
    return rows.join(days, "day").withColumn("at", at).select("id", part.alias("part"))


def deltas(scores: list[tuple[str, float]]) -> list[tuple[str, float, float]]:
    """Gain of each feature set over the one before."""
    return [(name, value, value - (scores[i - 1][1] if i else value)) for i, (name, value) in enumerate(scores)]
