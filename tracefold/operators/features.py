"""Point-in-time features.  History of a time T is what lies strictly before T: range frames end one microsecond before,
so ties are left out.  History and scored rows may differ; both go through one window with a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefold.operators.correlate import WINDOW_SECONDS, bank_cdr_pairs

MINUTE = 60_000_000
FACTOR = 0.6745
#: The feature sets, in order.
SET_A = "transaction_id transaction_amount transaction_hour customer_history_count amount_vs_customer_median amount_robust_zscore amount_percentile receiver_seen_before receiver_historical_count receiver_frequency hour_rarity txn_count_previous_10m txn_count_previous_30m txn_count_previous_1h amount_velocity_30m amount_velocity_1h time_since_previous_transaction".split()
SET_B = "has_cdr_context calls_previous_10m calls_previous_30m calls_previous_1h nearest_call_before_seconds total_call_duration_30m max_call_duration_30m caller_novelty caller_historical_frequency imei_novelty cell_novelty roaming_change".split()
SET_C = "has_ipdr_context sessions_previous_10m sessions_previous_30m nearest_session_before_seconds source_ip_novelty destination_ip_novelty destination_port_novelty imsi_imei_pair_novelty device_consistency cell_consistency session_duration_deviation".split()


def before(*by: str) -> W:
    return W.partitionBy(*by).orderBy("us").rangeBetween(W.unboundedPreceding, -1)


def within(span: int, *by: str) -> W:
    return W.partitionBy(*by).orderBy("us").rangeBetween(-span, -1)


def median(xs: Column) -> Column:
    """Median of an array of numbers; NULL if it is empty."""
    n = F.size(xs)
    mid = lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, F.element_at(F.transform(F.array(F.array_sort(xs)), mid), 1))


def bank_history(rows: DataFrame) -> DataFrame:
    """Set A of rows ``(id, who, us, amount, receiver, is_history, is_probe)``."""
    h = F.col("is_history")
    own = F.when(h, F.col("amount"))
    n = F.count(F.when(h, 1))
    rows = rows.withColumn("hour", F.hour(F.timestamp_micros("us")))
    w = before("who")
    rows = rows.withColumn("customer_history_count", n.over(w)).withColumn("median", F.percentile(own, F.lit(0.5)).over(w)).withColumn("past", F.collect_list(own).over(w)).withColumn("last", F.max(F.when(h, F.col("us"))).over(w))
    rows = rows.withColumn("same_hour", n.over(before("who", "hour"))).withColumn("same_receiver", n.over(before("who", "receiver")))
    for name, span in (("10m", 10), ("30m", 30), ("1h", 60)):
        rows = rows.withColumn(f"txn_count_previous_{name}", n.over(within(span * MINUTE, "who")))
        if name != "10m":
            rows = rows.withColumn(f"amount_velocity_{name}", F.coalesce(F.sum(own).over(within(span * MINUTE, "who")), F.lit(0.0)))
    count, a, m = F.col("customer_history_count"), F.col("amount"), F.col("median")
    rows = rows.where("is_probe").withColumn("mad", median(F.transform("past", lambda x: F.abs(x - m))))
    receiver = F.when((count > 0) & F.col("receiver").isNotNull(), F.col("same_receiver")).otherwise(F.lit(0))
    return rows.select(
        F.col("id").alias("transaction_id"), a.alias("transaction_amount"), F.col("hour").alias("transaction_hour"), "customer_history_count", F.when(m > 0, a / m).alias("amount_vs_customer_median"),
        F.when(F.col("mad") > 0, FACTOR * (a - m) / F.col("mad")).alias("amount_robust_zscore"), F.when(count > 0, F.size(F.filter("past", lambda x: x < a)) / count).alias("amount_percentile"),
        F.when(receiver > 0, 1).otherwise(0).alias("receiver_seen_before"), receiver.alias("receiver_historical_count"), F.when(count > 0, receiver / count).otherwise(F.lit(0.0)).alias("receiver_frequency"),
        F.when(count > 0, 1 - F.col("same_hour") / count).alias("hour_rarity"), "txn_count_previous_10m", "txn_count_previous_30m", "txn_count_previous_1h", "amount_velocity_30m", "amount_velocity_1h",
        ((F.col("us") - F.col("last")) / 1_000_000).alias("time_since_previous_transaction"),
    )


def bank_rows(bank: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Canonical transactions as rows for ``bank_history``; identity is customer, else account, else phone."""
    from tracefold.functions.normalize import micros

    def who(p: str) -> Column:
        tag = lambda k, f: F.when(F.col(f"{p}.{f}").isNotNull(), F.concat(F.lit(k + ":"), F.col(f"{p}.{f}")))
        return F.coalesce(tag("CUSTOMER_ID", "customer_id"), tag("ACCOUNT_NUMBER", "account_number"), tag("PHONE", "phone"))

    shape = lambda df: df.select(F.col("transaction_id").alias("id"), who("sender").alias("who"), micros(F.col("transaction_timestamp")).alias("us"), F.col("amount").cast("double").alias("amount"), who("receiver").alias("receiver"))
    if history is None:
        return shape(bank).withColumns({"is_history": F.lit(True), "is_probe": F.lit(True)})
    return shape(bank).withColumns({"is_history": F.lit(False), "is_probe": F.lit(True)}).unionByName(shape(history).withColumns({"is_history": F.lit(True), "is_probe": F.lit(False)}))


def as_of_sets(probes: DataFrame, history: DataFrame, values: list[str]) -> DataFrame:
    """For each probe ``(pid, who, us)`` the sets of each of ``values`` in the history of ``who`` strictly before."""
    p = probes.select("pid", "who", "us", *(F.lit(None).cast(history.schema[v].dataType).alias(v) for v in values), F.lit(False).alias("h"))
    rows = p.unionByName(history.select(F.lit(None).cast(probes.schema["pid"].dataType).alias("pid"), "who", "us", *values, F.lit(True).alias("h")))
    w = before("who")
    for v in values:
        rows = rows.withColumn(f"{v}_set", F.collect_set(F.when(F.col("h"), F.col(v))).over(w))
    return rows.where("not h").select("pid", "who", *(f"{v}_set" for v in values), "us")


def novelty(context: Column, past: Column) -> Column:
    """1 if a value of the context is new, NULL if the context has none."""
    return F.when(F.size(context) > 0, F.when(F.size(F.array_except(context, past)) > 0, 1).otherwise(0))


def call_context(bank: DataFrame, calls: DataFrame) -> DataFrame:
    """Set B counts over the calls of each context: rows ``(transaction_id, t, us, duration)``, ``us`` null if none."""
    pre = F.col("us") < F.col("t")
    at = lambda m: F.count(F.when(pre & (F.col("us") >= F.col("t") - m * MINUTE), 1))
    last = F.when(pre & (F.col("us") >= F.col("t") - 30 * MINUTE), F.col("duration"))
    return calls.groupBy("transaction_id", "t").agg(
        F.max(F.when(F.col("us").isNotNull(), 1).otherwise(0)).alias("has_cdr_context"), at(10).alias("calls_previous_10m"), at(30).alias("calls_previous_30m"), at(60).alias("calls_previous_1h"),
        ((F.col("t") - F.max(F.when(pre, F.col("us")))) / 1_000_000).alias("nearest_call_before_seconds"), F.coalesce(F.sum(last), F.lit(0)).alias("total_call_duration_30m"), F.max(last).alias("max_call_duration_30m"),
    )


def context_calls(bank: DataFrame, cdr: DataFrame, links: DataFrame) -> DataFrame:
    from tracefold.functions.normalize import micros

    own = bank.select("transaction_id", micros(F.col("transaction_timestamp")).alias("t"), F.col("sender.phone").alias("who"))
    one = links.select(F.col("source_id").alias("transaction_id"), F.col("target_id").alias("cdr_id")).distinct()
    c = cdr.select("cdr_id", micros(F.col("event_timestamp")).alias("us"), F.col("duration_seconds").alias("duration"), "a_party_phone", "b_party_phone", "imei", "cell_id", "roaming_circle")
    return own.join(one.join(c, "cdr_id"), "transaction_id", "left")


def near_calls(bank: DataFrame, cdr: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Transactions ``(transaction_id, t, who)`` and, for each, the calls that ``bank_cdr`` links with it.

    The rows are those of ``context_calls`` without the empty ones; they come from the join itself, not from links that
    were exchanged and joined by id again, so that an aggregate by transaction is partly done where a pair is made."""
    from tracefold.functions.normalize import micros

    own = bank.select("transaction_id", micros(F.col("transaction_timestamp")).alias("t"), F.col("sender.phone").alias("who"))
    left = bank.select("transaction_id", micros(F.col("transaction_timestamp")).alias("left_us"), F.col("sender.phone").alias("sender"), F.col("receiver.phone").alias("receiver"))
    right = cdr.select(micros(F.col("event_timestamp")).alias("right_us"), F.col("duration_seconds").alias("duration"), F.col("a_party_phone").alias("a_party"), F.col("b_party_phone").alias("b_party"), "imei", "cell_id", "roaming_circle")
    pairs = bank_cdr_pairs(left, right, window)
    return own, pairs.select("transaction_id", F.col("left_us").alias("t"), F.col("sender").alias("who"), F.col("right_us").alias("us"), "duration", F.col("a_party").alias("a_party_phone"), F.col("b_party").alias("b_party_phone"), "imei", "cell_id", "roaming_circle")


def near_call_context(bank: DataFrame, cdr: DataFrame, window: int) -> DataFrame:
    """``call_context`` of the calls that lie within ``window`` seconds of each transaction."""
    own, calls = near_calls(bank, cdr, window)
    found = call_context(bank, calls)
    none = {c: 0 for c in found.columns if c.startswith("calls_") or c in ("has_cdr_context", "total_call_duration_30m")}
    return own.select("transaction_id", "t").distinct().join(found, ["transaction_id", "t"], "left").fillna(none)


def call_history(cdr: DataFrame) -> DataFrame:
    """Calls by each of their phones (once if equal): ``(who, us, other, imei, cell_id, roaming_circle)``."""
    from tracefold.functions.normalize import micros

    side = F.array_distinct(F.array("a_party_phone", "b_party_phone"))
    rows = cdr.select(F.explode(side).alias("who"), micros(F.col("event_timestamp")).alias("us"), "a_party_phone", "b_party_phone", "imei", "cell_id", "roaming_circle")
    other = F.when(F.col("who") == F.col("a_party_phone"), F.col("b_party_phone")).otherwise(F.col("a_party_phone"))
    return rows.select("who", "us", other.alias("other"), "imei", "cell_id", "roaming_circle")


def caller_features(calls: DataFrame, history: DataFrame) -> DataFrame:
    """Novelty of callers, devices, cells and circles of the context against the sender's calls strictly before."""
    ctx = calls.where("us < t")
    other = F.when(F.col("a_party_phone") == F.col("who"), F.col("b_party_phone")).when(F.col("b_party_phone") == F.col("who"), F.col("a_party_phone"))
    sets = ctx.groupBy("transaction_id").agg(F.collect_set(other).alias("others"), *(F.collect_set(c).alias(c) for c in ("imei", "cell_id", "roaming_circle")))
    probes = calls.select(F.col("transaction_id").alias("pid"), "who", F.col("t").alias("us")).distinct()
    p = probes.withColumn("h", F.lit(False))
    rows = p.unionByName(history.withColumn("h", F.lit(True)), allowMissingColumns=True)
    w = before("who")
    past = rows.withColumn("past", F.collect_list(F.when(F.col("h"), F.col("other"))).over(w)).withColumn("n", F.count(F.when(F.col("h"), 1)).over(w))
    for c in ("imei", "cell_id", "roaming_circle"):
        past = past.withColumn(f"{c}_past", F.collect_set(F.when(F.col("h"), F.col(c))).over(w))
    past = past.where("not h").select(F.col("pid").alias("transaction_id"), "past", "n", "imei_past", "cell_id_past", "roaming_circle_past")
    j = past.join(sets, "transaction_id", "left")
    share = F.array_min(F.transform("others", lambda o: F.size(F.filter("past", lambda x: x == o)) / F.col("n")))
    return j.select(
        "transaction_id", novelty(F.col("others"), F.col("past")).alias("caller_novelty"), F.when(F.size("others") > 0, F.when(F.col("n") > 0, share).otherwise(F.lit(0.0))).alias("caller_historical_frequency"),
        novelty(F.col("imei"), F.col("imei_past")).alias("imei_novelty"), novelty(F.col("cell_id"), F.col("cell_id_past")).alias("cell_novelty"), novelty(F.col("roaming_circle"), F.col("roaming_circle_past")).alias("roaming_change"),
    )


def context_sessions(bank: DataFrame, ipdr: DataFrame, two: DataFrame) -> DataFrame:
    from tracefold.functions.normalize import micros

    own = bank.select("transaction_id", micros(F.col("transaction_timestamp")).alias("t"))
    i = ipdr.select("ipdr_id", micros(F.col("session_timestamp")).alias("us"), F.coalesce("subscriber_imsi", "subscriber_msisdn").alias("who"), "subscriber_imsi", "device_imei", "source_ip", "destination_ip", "destination_port", F.col("duration_seconds").alias("duration"))
    return own.join(two.select("transaction_id", "ipdr_id").distinct().join(i, "ipdr_id"), "transaction_id", "left")


def session_counts(sessions: DataFrame) -> DataFrame:
    pre = F.col("us") < F.col("t")
    at = lambda m: F.count(F.when(pre & (F.col("us") >= F.col("t") - m * MINUTE), 1))
    return sessions.groupBy("transaction_id", "t").agg(
        F.max(F.when(F.col("us").isNotNull(), 1).otherwise(0)).alias("has_ipdr_context"), at(10).alias("sessions_previous_10m"), at(30).alias("sessions_previous_30m"), ((F.col("t") - F.max(F.when(pre, F.col("us")))) / 1_000_000).alias("nearest_session_before_seconds"),
    )


def session_history(ipdr: DataFrame) -> DataFrame:
    from tracefold.functions.normalize import micros

    pair = F.when(F.col("subscriber_imsi").isNotNull() & F.col("device_imei").isNotNull(), F.concat_ws("|", "subscriber_imsi", "device_imei"))
    return ipdr.select(F.coalesce("subscriber_imsi", "subscriber_msisdn").alias("who"), micros(F.col("session_timestamp")).alias("us"), "source_ip", "destination_ip", "destination_port", pair.alias("pair"), F.col("duration_seconds").cast("double").alias("duration"))


def session_novelty(sessions: DataFrame, history: DataFrame) -> DataFrame:
    """Novelty of addresses, ports and subscriber-device pairs, and the deviation of durations, per transaction."""
    pair = F.when(F.col("subscriber_imsi").isNotNull() & F.col("device_imei").isNotNull(), F.concat_ws("|", "subscriber_imsi", "device_imei"))
    ctx = sessions.where("us < t").withColumn("pair", pair)
    sets = ctx.groupBy("transaction_id", "t").agg(F.min("who").alias("who"), *(F.collect_set(c).alias(c) for c in ("source_ip", "destination_ip", "destination_port", "pair")), F.collect_list(F.col("duration").cast("double")).alias("durations"))
    p = sets.select(F.col("transaction_id").alias("pid"), "who", F.col("t").alias("us"), F.lit(False).alias("h"))
    rows = p.unionByName(history.withColumn("h", F.lit(True)), allowMissingColumns=True)
    w = before("who")
    for c in ("source_ip", "destination_ip", "destination_port", "pair"):
        rows = rows.withColumn(f"{c}_past", F.collect_set(F.when(F.col("h"), F.col(c))).over(w))
    past = rows.withColumn("past", F.collect_list(F.when(F.col("h"), F.col("duration"))).over(w)).where("not h").withColumn("m", F.coalesce(median(F.col("past")), F.lit(0.0)))
    past = past.withColumn("mad", median(F.transform("past", lambda x: F.abs(x - F.col("m"))))).select(F.col("pid").alias("transaction_id"), *(f"{c}_past" for c in ("source_ip", "destination_ip", "destination_port", "pair")), "m", "mad")
    j = sets.join(past, "transaction_id")
    far = F.array_max(F.transform("durations", lambda d: F.abs(FACTOR * (d - F.col("m")) / F.col("mad"))))
    names = {"source_ip": "source_ip_novelty", "destination_ip": "destination_ip_novelty", "destination_port": "destination_port_novelty", "pair": "imsi_imei_pair_novelty"}
    return j.select("transaction_id", *(novelty(F.col(c), F.col(f"{c}_past")).alias(n) for c, n in names.items()), F.when(F.col("mad") > 0, far).alias("session_duration_deviation"))


def consistency(bank: DataFrame, one: DataFrame, cdr_ipdr: DataFrame) -> DataFrame:
    """Device and cell consistency over links between calls and sessions that both lie before the transaction."""
    from tracefold.functions.normalize import micros

    t = bank.select("transaction_id", micros(F.col("transaction_timestamp")).alias("t"))
    links = t.join(one.select("transaction_id", "cdr_id").distinct(), "transaction_id").join(cdr_ipdr.withColumnRenamed("source_id", "cdr_id"), "cdr_id").where("left_us < t and right_us < t")
    has = lambda c, kinds: F.max(F.exists(c, lambda x: x["identity_type"].isin(*kinds)))
    say = lambda kinds: F.when(has("conflicts", kinds), 0).when(has("evidence", kinds), 1)
    return links.groupBy("transaction_id").agg(say(["IMSI", "IMEI"]).alias("device_consistency"), say(["CELL_ID"]).alias("cell_consistency"))


def feature_sets(bank: DataFrame, cdr: DataFrame, ipdr: DataFrame, bank_cdr: DataFrame, cdr_ipdr: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets A, B and C (17, 28 plus id, 40 columns); each transaction once."""
    from tracefold.operators.fusion import link_tables

    one, two = link_tables(bank_cdr, cdr_ipdr)
    a = bank_history(bank_rows(bank)).select(*SET_A)
    calls, sessions = context_calls(bank, cdr, bank_cdr), context_sessions(bank, ipdr, two)
    b = a.join(call_context(bank, calls).drop("t"), "transaction_id", "left").join(caller_features(calls, call_history(cdr)), "transaction_id", "left").select(*SET_A, *SET_B)
    c = b.join(session_counts(sessions).drop("t"), "transaction_id", "left").join(session_novelty(sessions, session_history(ipdr)), "transaction_id", "left").join(consistency(bank, one, cdr_ipdr), "transaction_id", "left")
    return a, b, c.select(*SET_A, *SET_B, *SET_C)


def near_calls_set(bank: DataFrame, cdr: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """Set B of ``feature_sets`` for the links that ``bank_cdr`` makes within ``window`` seconds, without a list of them."""
    from tracefold.operators import near

    history = call_history(cdr)
    parts = near_call_context(bank, cdr, window).drop("t"), near.caller_novelty(bank, history, window), near.value_novelty(bank, history, window)
    found = bank_history(bank_rows(bank)).select(*SET_A)
    for p in parts:
        found = found.join(p, "transaction_id", "left")
    return found.select(*SET_A, *SET_B)


def near_sessions_set(bank: DataFrame, cdr: DataFrame, ipdr: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """Set C of ``feature_sets`` for the links that ``bank_cdr`` and ``cdr_ipdr`` make within ``window`` seconds, without lists of them."""
    from tracefold.operators import near

    found = near_calls_set(bank, cdr, window)
    for p in (near.session_counts(bank, cdr, ipdr, window).drop("t"), near.session_novelty(bank, cdr, ipdr, session_history(ipdr), window), near.consistency(bank, cdr, ipdr, window)):
        found = found.join(p, "transaction_id", "left")
    return found.select(*SET_A, *SET_B, *SET_C)
