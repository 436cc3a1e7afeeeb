"""The driver's tables as raw bank, call and session records (all text), and as histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _phone(c) -> F.Column:
    return (F.lit(9_000_000_000) + c).cast("string")


def bank_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("event_type = 'purchase'")
    u, i = F.col("user_id"), F.col("event_id")
    none = F.lit(None).cast("string")
    party = lambda side, **k: [k.get(x, none).alias(f"{side}_{x}") for x in "Customer_ID Customer_Name Bank_Name Account_Number Account_Type IFSC Phone_Number".split()]
    sender = party("Sender", Customer_ID=F.concat(F.lit("C"), u), Account_Number=F.concat(F.lit("A"), u), Phone_Number=_phone(u))
    receiver = party("Receiver", Customer_ID=F.concat(F.lit("C"), (u * 7 + i) % 10), Phone_Number=_phone((u * 7 + i) % 10))
    return e.select(
        F.concat(F.lit("T"), i).alias("Transaction_ID"), F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.date_format("ts", "HH:mm:ss").alias("Timestamp"), none.alias("Txn_Ref_Number"),
        F.lit("UPI").alias("Transaction_Mode"), F.lit("INR").alias("Currency"), F.col("value").cast("string").alias("Transaction_Amount"), none.alias("Balance"), *sender, *receiver,
    )


def cdr_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    u, i = F.col("user_id"), F.col("event_id")
    return e.select(
        F.concat(F.lit("D"), i).alias("CDR_ID"), F.date_format("ts", "yyyy-MM-dd").alias("Call_Date"), F.date_format("ts", "HH:mm:ss").alias("Call_Start_Time"),
        _phone(u).alias("A_Party_Number"), _phone((u * 7 + i) % 10).alias("B_Party_Number"), F.col("event_type").alias("Call_Type"), F.floor("value").cast("string").alias("Call_Duration_Seconds"),
        (F.lit(404_000_000_000_000) + u).cast("string").alias("IMSI"), (F.lit(350_000_000_000_000) + u * 10 + i % 3).cast("string").alias("IMEI"), F.lit(None).cast("string").alias("First_BTS_Location"),
        F.concat(F.lit("K"), i % 20).alias("First_Cell_Global_ID"), F.concat(F.lit("R"), i % 4).alias("Roaming_Network_Circle"),
    )


def ipdr_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    u, i = F.col("user_id"), F.col("event_id")
    return e.select(
        F.concat(F.lit("I"), i).alias("IPDR_ID"), F.date_format("ts", "yyyy-MM-dd").alias("Session_Date"), F.date_format("ts", "HH:mm:ss").alias("Session_Start_Time"),
        (F.lit(404_000_000_000_000) + u).cast("string").alias("Subscriber_IMSI"), _phone(u).alias("Subscriber_MSISDN"), (F.lit(350_000_000_000_000) + u * 10 + i % 4).cast("string").alias("Device_IMEI"),
        F.concat(F.lit("10.0."), u % 256, F.lit("."), i % 256).alias("Source_IP_Address"), F.concat(F.lit("172.16."), i % 16, F.lit("."), (i * 7) % 256).alias("Destination_IP_Address"),
        (F.lit(1024) + i % 5).cast("string").alias("Destination_Port"), F.concat(F.lit("K"), i % 20).alias("Cell_Global_ID"), F.floor("value").cast("string").alias("Session_Duration_Seconds"),
    )


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a transaction history on day grain, with ties: ``(id, who, us, amount, receiver)``."""
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("receiver"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and line items as transactions between customers and suppliers: ``(txn, sender, receiver)``."""
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("txn"), F.concat(F.lit("C"), F.col("o_custkey") % 500).alias("sender"), F.concat(F.lit("C"), F.col("l_suppkey") % 500).alias("receiver")
    )
