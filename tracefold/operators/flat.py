"""Features over flat account and device tables: rolling windows, calls before a transaction, sessions around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def rolling(rows: DataFrame) -> DataFrame:
    """``(id, account, us, amount)``: count, sum, mean, max and deviation of what lies in ``[T - w, T)``, 0 if nothing."""
    w = lambda h: W.partitionBy("account").orderBy("us").rangeBetween(-h * HOUR, -1)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    a = F.col("amount")
    return rows.select(
        "id", F.count(a).over(w(1)).alias("b_velocity_1h"), F.count(a).over(w(24)).alias("b_velocity_24h"), z(F.sum(a).over(w(1))).alias("b_total_amount_1h"), z(F.sum(a).over(w(24))).alias("b_total_amount_24h"),
        z(F.avg(a).over(w(168))).alias("b_mean_amount_7d"), z(F.max(a).over(w(24))).alias("b_max_amount_24h"), z(F.stddev_samp(a).over(w(24))).alias("b_std_amount_24h"),
    )


def whole_history_scores(rows: DataFrame) -> DataFrame:
    """Deviation from the account's mean over all its rows (the future included, as in the flat family)."""
    w = W.partitionBy("account")
    mean, std = F.avg("amount").over(w), F.stddev_samp("amount").over(w)
    return rows.select("id", ((F.col("amount") - mean) / (F.coalesce(std, F.lit(0.0)) + 1e-6)).alias("b_amount_zscore"), (F.col("amount") / (mean + 1e-6)).alias("b_relative_amount_spike"))


def new_beneficiary(rows: DataFrame) -> DataFrame:
    first = F.row_number().over(W.partitionBy("account", "beneficiary").orderBy("us", "id"))
    return rows.select("id", F.when(first == 1, 1).otherwise(0).alias("b_new_beneficiary"))


def calendar(rows: DataFrame) -> DataFrame:
    from tracefold.functions.normalize import odd_hour, weekend

    ts = F.timestamp_micros("us")
    return rows.select("id", odd_hour(ts).alias("b_odd_hour"), weekend(ts).alias("b_is_weekend"), F.hour(ts).alias("hour"))


def _met(txn: DataFrame, key: str, events: DataFrame, width: int, reach: tuple[int, ...]) -> DataFrame:
    """Transactions (``t``) beside the events of their key in the slices of time that ``reach`` names; a transaction without
    any stays, more than once.  The slice is part of the key, so that a busy key is many groups."""
    t = txn.select("id", key, F.col("us").alias("t"), F.explode(F.array(*(F.floor(F.col("us") / width) + i for i in reach))).alias("slice"))
    return t.join(events.withColumn("slice", F.floor(F.col("us") / width)), [key, "slice"], "left")


def call_windows(txn: DataFrame, calls: DataFrame) -> DataFrame:
    """Aggregates of the calls of an account in the hour and day before, one pass: ``txn (id, account, us)``,
    ``calls (account, us, duration, cell, roaming, location)``."""
    j = _met(txn, "account", calls, 24 * HOUR, (-1, 0))
    day = (F.col("us") < F.col("t")) & (F.col("us") >= F.col("t") - 24 * HOUR)
    j = j.select("id", "t", *(F.when(day, F.col(c)).alias(c) for c in ("us", "duration", "cell", "roaming", "location")))
    hour = F.col("us") >= F.col("t") - HOUR
    h = lambda x: F.when(hour, x)
    z = lambda x: F.coalesce(x, F.lit(0.0))
    near = lambda m: F.count(F.when(F.col("us") >= F.col("t") - m * 60_000_000, 1))
    return j.groupBy("id").agg(
        F.count(h(F.col("us"))).alias("c_call_count_1h"), z(F.sum(h(F.col("duration")))).alias("c_total_duration_1h"), z(F.max(h(F.col("duration")))).alias("c_max_duration_1h"), z(F.avg(h(F.col("duration")))).alias("c_avg_duration_1h"),
        F.countDistinct(h(F.col("cell"))).alias("c_unique_cell_ids_1h"), F.count("us").alias("c_call_count_24h"), z(F.sum("duration")).alias("c_total_duration_24h"), F.count(F.when(F.col("roaming") == 1, 1)).alias("c_roaming_count_24h"), F.countDistinct("location").alias("c_unique_locations_24h"),
        F.when(near(30) > 0, 1).otherwise(0).alias("c_has_call_30min_before"), F.when(near(15) >= 3, 1).otherwise(0).alias("c_repeated_calls_15min"),
    )


def pair_novelty(txn: DataFrame, calls: DataFrame) -> DataFrame:
    """1 where the subscriber and device of the last call before a transaction were first seen (by anyone, at any time) less
    than seven days before it; NULL without a call.  ``calls (account, us, event_id, imsi, imei)``; of equal times the
    smallest id is the last call."""
    pair = F.concat_ws("_", F.coalesce(F.col("imsi").cast("string"), F.lit("nan")), F.coalesce(F.col("imei").cast("string"), F.lit("nan")))
    seen = calls.select("account", "us", "event_id", pair.alias("pair"))
    none = F.lit(None)
    rows = txn.select("id", "account", "us", none.cast("bigint").alias("event_id"), none.cast("string").alias("pair")).unionByName(seen.select(none.cast("bigint").alias("id"), "account", "us", "event_id", "pair"))
    last = F.max(F.when(F.col("event_id").isNotNull(), F.struct("us", -F.col("event_id"), "pair"))).over(W.partitionBy("account").orderBy("us").rangeBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("last", last).where("id is not null").select("id", "us", F.col("last.pair").alias("pair"))
    first = seen.groupBy("pair").agg(F.min("us").alias("first"))
    return rows.join(first, "pair", "left").select("id", F.when(F.col("pair").isNotNull(), (F.col("us") - F.col("first") < 168 * HOUR).cast("int")).alias("c_imsi_imei_novelty"))


def session_windows(txn: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions of a device within 30 minutes on either side: ``sessions (device, us, sent, received, domain, port, vpn, tor,
    location)``."""
    j = _met(txn, "device", sessions, HOUR // 2, (-1, 0, 1))
    near = F.abs(F.col("us") - F.col("t")) <= HOUR // 2
    j = j.select("id", *(F.when(near, F.col(c)).alias(c) for c in ("us", "sent", "received", "domain", "port", "vpn", "tor", "location")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.groupBy("id").agg(
        F.count("us").alias("i_session_count_30min"), total("sent").alias("i_total_bytes_sent_30min"), total("received").alias("i_total_bytes_received_30min"), F.countDistinct("domain").alias("i_unique_domains_30min"), F.countDistinct("port").alias("i_unique_ports_30min"),
        F.count(F.when(F.col("vpn") == 1, 1)).alias("i_vpn_count"), F.count(F.when(F.col("tor") == 1, 1)).alias("i_tor_count"), F.countDistinct("location").alias("i_unique_locations"),
    )


def usual_location(sessions: DataFrame) -> DataFrame:
    """Most frequent location of a device, the smallest on ties."""
    n = sessions.where("location is not null").groupBy("device", "location").count()
    return n.groupBy("device").agg(F.min_by("location", F.struct(-F.col("count"), "location")).alias("usual_location"))


def latest_before(txn: DataFrame, events: DataFrame) -> DataFrame:
    """As-of join: the last event of an account strictly before, ties by the larger id.  One window over both sides."""
    rows = txn.select("id", "account", "us", F.lit(None).cast("bigint").alias("event")).unionByName(events.select(F.lit(None).cast("bigint").alias("id"), "account", "us", F.col("event_id").alias("event")))
    last = F.max(F.when(F.col("event").isNotNull(), F.struct("us", "event"))).over(W.partitionBy("account").orderBy("us").rangeBetween(W.unboundedPreceding, -1))
    return rows.withColumn("last", last).where("id is not null").select("id", F.col("last.event").alias("event_id"), ((F.col("us") - F.col("last.us")) / 1_000_000).alias("age_seconds"))


def device_age(txn: DataFrame, sessions: DataFrame) -> DataFrame:
    """Whole days since the device was first seen; negative if that is later."""
    first = sessions.groupBy("device").agg(F.min("us").alias("first"))
    return txn.join(first, "device", "left").select("id", F.floor((F.col("us") - F.col("first")) / (24 * HOUR)).cast("bigint").alias("i_device_age_days"))
