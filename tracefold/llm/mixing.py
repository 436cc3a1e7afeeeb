"""Mixing sources to target weights by weighted fair queueing.  Columns only: no Python on the executors.

Each source is shuffled by a hash of the document id and read up to three times.  A document's virtual finish time is
the number of words its source has sent by then, divided by the weight of the source; the mix is the prefix of all
documents in the order of that time whose words fit the budget.

Running sums are taken in two levels (slices of the hash, slices of virtual time), so that no window holds a whole
source: a source with a third of all rows is dealt over ``SLICES`` groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefold.llm.common import discard, materialize, unpacked, whole_row, words

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Slices of the hash are its first three hexadecimal digits; slices of virtual time up to the level of the mix.
SLICES = 4096


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(source, rank, weight, source_size, target)``, one row for each source.

    The budget, all words, is shared by weight; targets above ``epochs`` times the source stop there and the rest is
    shared again until none is above.  Sources in the order of ``epochs * size / weight`` fill up first, so the level
    is that of the first source which it does not fill.  One row for each source goes through a single window."""
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = totals.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, all_rows = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / heavy)
    open_ = (F.col("cap") >= F.col("weight") * F.col("level")) & (F.col("source_size") > 0)
    s = s.withColumn("level", F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("cap") / F.col("weight"))).over(all_rows))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(F.col("level"), F.lit(0.0)))
    return s.select("source", "rank", "weight", "source_size", "level", target.alias("target"))


def units_of(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Documents as ``(doc_id, source, size, m)``; ``m`` rows that agree in all of these are one unit."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("bigint").alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))


def mix_sequence(units: DataFrame, sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """The mix as ``(doc_id, source, size, m, epoch, finish, position)``: ``position`` counts the words before."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = units.withColumn("key", key).withColumn("slice", F.substring("key", 1, 3))
    sums = rows.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("m")).alias("s"))
    before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("sent", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    within = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum(F.col("size") * F.col("m")).over(within))
    rows = rows.alias("r").join(sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.slice") == F.col("s.slice")))
    rows = rows.select("r.doc_id", "r.source", "r.size", "r.m", "r.key", (F.col("own") + F.col("sent")).alias("end"))
    rows = rows.alias("r").join(sources.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("r.*", "rank", "weight", "source_size", "level", F.explode(F.array(*map(F.lit, range(epochs)))).alias("epoch"))
    finish = (F.col("epoch") * F.col("source_size") + F.col("end")).cast("double") / F.col("weight")
    rows = rows.withColumn("finish", finish).where("size > 0")
    rows = rows.withColumn("time", F.least(F.lit(SLICES), F.floor(F.col("finish") / F.col("level") * (SLICES // 4))))
    # The slices of time: at most SLICES + 1 rows, whatever the input.
    slices = rows.groupBy("time").agg(F.sum(F.col("size") * F.col("m")).alias("s"))
    slices = slices.withColumn("start", F.coalesce(F.sum("s").over(W.orderBy("time").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    slices = slices.withColumn("budget", F.expr("sum(s) over ()") / F.lit(epochs)).drop("s")
    rows = rows.join(F.broadcast(slices), "time").where("start < budget")
    line = W.partitionBy("time").orderBy("finish", "rank", "key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("done", F.col("start") + F.sum(F.col("size") * F.col("m")).over(line)).where("done <= budget")
    return rows.select("doc_id", "source", "size", "m", "epoch", "finish", (F.col("done") - F.col("size") * F.col("m")).alias("position"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)``, one row for each row of ``docs``.

    ``size`` counts the words ``[^\\x20\\x09-\\x0D]+`` (null text: 0); sources go by code point with null last and take
    the weights 5, 2, 1 in turn; ``taken`` is the size times the reads in the mix, three at most.  Rows that agree in
    id, source and size stand together and are taken together.  Where no document has a word all targets are 0; an
    empty table gives no rows.  Null ids are one id.  The order is a hash of the id: reruns agree.  Other columns are
    not read."""
    units = materialize(units_of(docs, id_col, source_col, text_col), "units")
    sources = materialize(source_targets(units), "sources")
    taken = mix_sequence(units, sources).select("doc_id", "source", "size", F.lit(1).alias("reads"))
    rows = units.select("doc_id", "source", "size", "m", F.lit(0).alias("reads")).unionByName(taken.withColumn("m", F.lit(0).cast("bigint")))
    rows = rows.groupBy("doc_id", "source", "size").agg(F.sum("reads").alias("reads"), F.max("m").alias("m"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    out = rows.alias("r").join(sources.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    return out.select("r.doc_id", "r.size", "r.source", "t.source_size", "t.target", (F.col("r.size") * F.col("r.reads")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix reads it, with the columns of ``docs``.

    Nulls, ties and rows without words are treated as in ``mix_plan``: rows without words are in no mix, and where no row
    has one the mix is empty.  Words are counted again for the join, so that repeated ids with other texts are told apart;
    repeated rows stay together.  Columns of any other name and type pass through.  An empty table gives no rows."""
    units = materialize(units_of(docs, "doc_id", "source", "text"), "units")
    sources = materialize(source_targets(units), "sources")
    plan = mix_sequence(units, sources).groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("reads"))
    plan = materialize(plan, "plan")
    discard(units, sources)
    rows = docs.select(whole_row(docs), "doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size")).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size"))
    # Merged at any size: a plan that is small enough to broadcast on a sample is not so on the corpus.
    rows = rows.join(plan.hint("merge").alias("p"), same).select("row", F.explode(F.sequence(F.lit(1), F.col("reads"))))
    return unpacked(rows, docs)
