"""One context for each transaction: its calls, their sessions, all links, and one ordered timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.normalize import micros
from tracefold.operators import correlate, near


def check_unique(df: DataFrame, key: str) -> None:
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {twice[0][0]}")


def check_links(links: DataFrame, targets: DataFrame, key: str) -> None:
    lost = links.select("target_id").join(targets.select(F.col(key).alias("target_id")), "target_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"link to a missing {key}: {lost[0][0]}")


def link_tables(bank_cdr: DataFrame, cdr_ipdr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted links without repeats: transaction to call, and transaction to session over a call."""
    a = bank_cdr.where("accepted").dropDuplicates(["correlation_id"])
    b = cdr_ipdr.where("accepted").dropDuplicates(["correlation_id"])
    one = a.select(F.col("source_id").alias("transaction_id"), F.col("target_id").alias("cdr_id"), "correlation_id")
    two = one.select("transaction_id", "cdr_id").join(b.select(F.col("source_id").alias("cdr_id"), F.col("target_id").alias("ipdr_id"), F.col("correlation_id").alias("second_id")), "cdr_id")
    return one, two


def timeline(bank: DataFrame, cdr: DataFrame, ipdr: DataFrame, bank_cdr: DataFrame, cdr_ipdr: DataFrame) -> DataFrame:
    """``(transaction_id, us, event_type, event_id)``: every event of a context once, in long form."""
    one, two = link_tables(bank_cdr, cdr_ipdr)
    own = bank.select("transaction_id", micros(F.col("transaction_timestamp")).alias("us"), F.lit("TRANSACTION").alias("event_type"), F.col("transaction_id").alias("event_id"))
    calls = one.select("transaction_id", "cdr_id").distinct().join(cdr, "cdr_id").select("transaction_id", micros(F.col("event_timestamp")).alias("us"), F.lit("CDR").alias("event_type"), F.col("cdr_id").alias("event_id"))
    sessions = two.select("transaction_id", "ipdr_id").distinct().join(ipdr, "ipdr_id").select("transaction_id", micros(F.col("session_timestamp")).alias("us"), F.lit("IPDR").alias("event_type"), F.col("ipdr_id").alias("event_id"))
    return own.unionByName(calls).unionByName(sessions)


def ordered_timelines(bank: DataFrame, cdr: DataFrame, ipdr: DataFrame, window: int = correlate.WINDOW_SECONDS) -> DataFrame:
    """Timelines with each event's position.  Repeated ids bring rows of several phones together, which needs all links."""
    if not correlate.repeats(bank.select("transaction_id"), cdr.select("cdr_id"), ipdr.select("ipdr_id")):
        return near.timelines(bank, cdr, ipdr, window)
    rows = timeline(bank, cdr, ipdr, correlate.bank_cdr(bank, cdr, window), correlate.cdr_ipdr(cdr, ipdr, window)).distinct()
    order = Window.partitionBy("transaction_id").orderBy("us", "event_type", "event_id")
    return rows.select("transaction_id", (F.row_number().over(order) - 1).cast("bigint").alias("position"), "us", "event_type", "event_id")


def contexts(bank: DataFrame, cdr: DataFrame, ipdr: DataFrame, bank_cdr: DataFrame, cdr_ipdr: DataFrame, check: bool = True) -> DataFrame:
    """Nested contexts; every transaction stays, also without calls.  ``check`` raises on repeated ids and lost links."""
    if check:
        check_unique(cdr, "cdr_id")
        check_unique(ipdr, "ipdr_id")
        check_links(bank_cdr.where("accepted"), cdr, "cdr_id")
        check_links(cdr_ipdr.where("accepted"), ipdr, "ipdr_id")
        if not bank_cdr.where("relationship <> 'BANK_TO_CDR'").isEmpty() or not cdr_ipdr.where("relationship <> 'CDR_TO_IPDR'").isEmpty():
            raise ValueError("wrong relationship")
    one, two = link_tables(bank_cdr, cdr_ipdr)
    lists = timeline(bank, cdr, ipdr, bank_cdr, cdr_ipdr).groupBy("transaction_id").agg(F.array_sort(F.collect_list(F.struct("us", "event_type", "event_id"))).alias("timeline"))
    ids = one.groupBy("transaction_id").agg(F.array_sort(F.collect_set("correlation_id")).alias("bank_cdr_links")).join(two.groupBy("transaction_id").agg(F.array_sort(F.collect_set("second_id")).alias("cdr_ipdr_links")), "transaction_id", "left")
    return bank.join(lists, "transaction_id", "left").join(ids, "transaction_id", "left")
