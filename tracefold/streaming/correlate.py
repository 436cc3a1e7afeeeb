"""Bank-to-call correlation of two streams: watermarks bound the state, the window is part of the join condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_pairs(bank: DataFrame, calls: DataFrame, window: int = 1800, lateness: str = "10 minutes") -> DataFrame:
    """``bank (transaction_id, ts, phone)`` and ``calls (cdr_id, ts, phone)``: pairs with one phone within the window."""
    b = bank.select("transaction_id", F.col("ts").alias("bank_ts"), F.col("phone").alias("bank_phone")).withWatermark("bank_ts", lateness)
    c = calls.select("cdr_id", F.col("ts").alias("call_ts"), F.col("phone").alias("call_phone")).withWatermark("call_ts", lateness)
    near = F.expr(f"bank_phone = call_phone and call_ts between bank_ts - interval {window} seconds and bank_ts + interval {window} seconds")
    return b.join(c, near).select("transaction_id", "cdr_id", F.expr("cast((unix_micros(call_ts) - unix_micros(bank_ts)) / 1000000 as bigint)").alias("time_difference_seconds"))


def windowed_activity(events: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
