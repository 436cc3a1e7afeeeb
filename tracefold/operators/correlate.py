"""Correlation of events across sources: equal identities within a time window, with evidence and conflicts.

Identities of both sides are put in long form, so that alternatives between keys become one equi-join.  Time buckets of
the window's width join the equi-key (each event on the right meets three buckets), which bounds the pairs a hot
identity makes; the exact window is the residual condition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.normalize import micros

WINDOW_SECONDS = 1800


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """Pairs with equal ``keys`` and ``abs(right_us - left_us) <= window_us``; a pair meets in one bucket."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(window_us)).cast("bigint")
    l = left.withColumn("bucket", bucket("left_us"))
    r = right.withColumn("bucket", F.explode(F.array(*(bucket("right_us") + d for d in (-1, 0, 1)))))
    return l.join(r, [*keys, "bucket"]).where(F.abs(F.col("right_us") - F.col("left_us")) <= window_us).drop("bucket")


def _roles(df: DataFrame, id_col: str, us: str, side: str, fields: list[tuple[str, str, str]]) -> DataFrame:
    each = [F.struct(F.lit(kind).alias("kind"), F.col(f).alias("value"), F.lit(role).alias(f"{side}_role"), F.lit(i).alias(f"{side}_ord")) for i, (f, role, kind) in enumerate(fields)]
    return df.select(F.col(id_col).alias(f"{side}_id"), F.col(us).alias(f"{side}_us"), F.inline(F.filter(F.array(*each), lambda x: x["value"].isNotNull())))


def bank_cdr_evidence(bank: DataFrame, cdr: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """One row for each piece of evidence: a phone of the transaction is a phone of the call, within the window."""
    return interval_join(*_sides(bank, cdr), ["kind", "value"], window * 1_000_000)


def _sides(bank: DataFrame, cdr: DataFrame) -> tuple[DataFrame, DataFrame]:
    b = _roles(bank.withColumn("us", micros(F.col("transaction_timestamp"))), "transaction_id", "us", "left", [("sender.phone", "BANK_SENDER", "PHONE"), ("receiver.phone", "BANK_RECEIVER", "PHONE")])
    c = _roles(cdr.withColumn("us", micros(F.col("event_timestamp"))), "cdr_id", "us", "right", [("a_party_phone", "A_PARTY", "PHONE"), ("b_party_phone", "B_PARTY", "PHONE")])
    return b, c


def bank_cdr_pairs(bank: DataFrame, cdr: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """Each pair of rows of ``bank_cdr`` once, by one of its equal phones, so that no exchange follows the join.

    ``bank`` has ``left_us, sender, receiver``, ``cdr`` has ``right_us, a_party, b_party``; other columns pass through."""
    phones = lambda *c: F.explode(F.array_distinct(F.array_compact(F.array(*c)))).alias("value")
    rows = interval_join(bank.select("*", phones("sender", "receiver")), cdr.select("*", phones("a_party", "b_party")), ["value"], window * 1_000_000)
    by_sender = F.coalesce(F.col("sender").isin(F.col("a_party"), F.col("b_party")), F.lit(False))
    return rows.where(F.col("value").eqNullSafe(F.col("sender")) | ~by_sender).drop("value")


def _seconds() -> Column:
    return F.expr("cast((right_us - left_us) / 1000000 as bigint)")


def bank_cdr(bank: DataFrame, cdr: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """``BANK_TO_CDR`` records, one for each pair; a match of a phone is always STRONG."""
    b, c = _sides(bank, cdr)
    items = lambda side: F.array_sort(F.collect_list(F.struct(f"{side}_ord", "value", f"{side}_role"))).alias(f"{side}_items")
    values = lambda side: F.array_distinct(F.transform(f"{side}_items", lambda x: x["value"]))
    b = b.groupBy("left_id", "left_us").agg(items("left")).withColumn("phones", values("left")).select("*", F.explode("phones").alias("value"))
    c = c.groupBy("right_id", "right_us").agg(items("right")).select("*", F.explode(values("right")).alias("value"))
    pairs = interval_join(b, c, ["value"], window * 1_000_000)
    # Of the phones that both have, the first makes the pair: all its evidence is at hand there, and no pair is exchanged.
    in_right = lambda v: F.exists("right_items", lambda y: y["value"] == v)
    pairs = pairs.where((F.element_at("phones", 1) == F.col("value")) | (F.get(F.filter("phones", in_right), F.lit(0)) == F.col("value")))
    item = lambda x, y: F.struct(x["left_ord"].alias("left_ord"), y["right_ord"].alias("right_ord"), F.lit("PHONE").alias("identity_type"), x["value"].alias("normalized_value"), x["left_role"].alias("source_role"), y["right_role"].alias("target_role"))
    same = lambda x: F.transform(F.filter("right_items", lambda y: y["value"] == x["value"]), lambda y: item(x, y))
    pairs = pairs.select("left_id", "right_id", "left_us", "right_us", F.flatten(F.transform("left_items", same)).alias("evidence"))
    return _records(pairs, "BANK_TO_CDR").withColumn("conflicts", F.expr("cast(array() as array<struct<identity_type:string,source_value:string,target_value:string,source_role:string,target_role:string>>)")).withColumn("strength", F.lit("STRONG"))


def repeats(*ids: DataFrame) -> bool:
    """Whether a table of one column has a value twice."""
    rows = [df.toDF("id").withColumn("table", F.lit(i)) for i, df in enumerate(ids)]
    return not reduce(DataFrame.unionByName, rows).groupBy("table", "id").count().where("count > 1").isEmpty()


def _phones(df: DataFrame, first: str, second: str) -> DataFrame:
    """A row for each different phone of a row: how often it is there, the other one, and whether it is the second."""
    a, b = F.col(first), F.col(second)
    same = a.eqNullSafe(b)
    row = lambda value, n, other, later: F.struct(value.alias("value"), n.alias("n"), other.alias("other"), F.lit(later).alias("later"))
    rows = F.array(row(a, F.when(same, 2).otherwise(1), F.when(~same, b), False), row(F.when(~same, b), F.lit(1), a, True))
    return df.select(*(c for c in df.columns if c not in (first, second)), F.inline(F.filter(rows, lambda x: x["value"].isNotNull())))


def bank_cdr_counts(bank: DataFrame, cdr: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """Pairs of ``bank_cdr`` with the number of their evidence in its place.

    With unique ids each side has two phones at most, so a pair is made and counted by comparing them, in compiled code
    and without lists.  Repeated ids need the lists."""
    if repeats(bank.select("transaction_id"), cdr.select("cdr_id")):
        return bank_cdr(bank, cdr, window).select("correlation_id", "source_id", "target_id", "time_difference_seconds", F.size("evidence").cast("bigint").alias("n_evidence"))
    tx = bank.select("transaction_id", F.concat_ws("_", F.lit("BANK_TO_CDR"), "transaction_id").alias("prefix"), micros(F.col("transaction_timestamp")).alias("right_us"), F.col("sender.phone").alias("a"), F.col("receiver.phone").alias("b"))
    calls = cdr.select("cdr_id", micros(F.col("event_timestamp")).alias("left_us"), F.col("a_party_phone").alias("a"), F.col("b_party_phone").alias("b"))
    # The transactions, which are fewer, meet the three buckets.
    pairs = interval_join(_phones(calls, "a", "b").withColumnsRenamed({"n": "m", "other": "beside"}).drop("later"), _phones(tx, "a", "b"), ["value"], window * 1_000_000)
    both = F.coalesce(F.col("other") == F.col("beside"), F.lit(False))
    return pairs.where(~(F.col("later") & both)).select(
        F.concat_ws("_", "prefix", "cdr_id").alias("correlation_id"), F.col("transaction_id").alias("source_id"), F.col("cdr_id").alias("target_id"), F.expr("cast((left_us - right_us) / 1000000 as bigint)").alias("time_difference_seconds"),
        (F.col("n") * F.col("m") + F.when(~F.col("later") & both, 1).otherwise(0)).cast("bigint").alias("n_evidence"),
    )


def _records(pairs: DataFrame, relation: str) -> DataFrame:
    evidence = F.transform("evidence", lambda e: e.dropFields("left_ord", "right_ord"))
    return pairs.select(
        F.concat_ws("_", F.lit(relation), "left_id", "right_id").alias("correlation_id"), F.lit(relation).alias("relationship"), F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id"), "left_us", "right_us",
        _seconds().alias("time_difference_seconds"), evidence.alias("evidence"), *[c for c in pairs.columns if c not in ("left_id", "right_id", "left_us", "right_us", "evidence")], F.lit(True).alias("accepted"),
    )


def cdr_ipdr(cdr: DataFrame, ipdr: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """``CDR_TO_IPDR`` records: at least one phone, subscriber or device number agrees within the window.

    Cells never make a pair alone, so they make no candidates; they are added as evidence.  Numbers that are present on
    both sides and differ are conflicts.  Two pieces of strong evidence, or one without a strong conflict, are STRONG;
    else the pair is MODERATE."""
    c = cdr.withColumn("us", micros(F.col("event_timestamp")))
    i = ipdr.withColumn("us", micros(F.col("session_timestamp")))
    left = _roles(c, "cdr_id", "us", "left", [("a_party_phone", "", "PHONE"), ("b_party_phone", "", "PHONE"), ("imsi", "", "IMSI"), ("imei", "", "IMEI")])
    right = _roles(i, "ipdr_id", "us", "right", [("subscriber_msisdn", "", "PHONE"), ("subscriber_imsi", "", "IMSI"), ("device_imei", "", "IMEI")])
    pairs = interval_join(left, right, ["kind", "value"], window * 1_000_000).select("left_id", "right_id", "left_us", "right_us").distinct()
    full = pairs.join(c.select(F.col("cdr_id").alias("left_id"), "a_party_phone", "b_party_phone", "imsi", "imei", F.col("cell_id").alias("cell")), "left_id")
    full = full.join(i.select(F.col("ipdr_id").alias("right_id"), "subscriber_msisdn", "subscriber_imsi", "device_imei", "cell_id"), "right_id")
    ms = "subscriber_msisdn"
    tested = [("a_party_phone", ms, "PHONE", "CDR_A_PARTY", "SUBSCRIBER"), ("b_party_phone", ms, "PHONE", "CDR_B_PARTY", "SUBSCRIBER"), ("imsi", "subscriber_imsi", "IMSI", "CDR_IMSI", "SUBSCRIBER"), ("imei", "device_imei", "IMEI", "CDR_IMEI", "DEVICE"), ("cell", "cell_id", "CELL_ID", "CDR_CELL_ID", "CELL")]
    items = [F.when(F.col(a) == F.col(b), F.struct(F.lit(n).alias("left_ord"), F.lit(0).alias("right_ord"), F.lit(k).alias("identity_type"), F.col(a).alias("normalized_value"), F.lit(s).alias("source_role"), F.lit(t).alias("target_role"))) for n, (a, b, k, s, t) in enumerate(tested)]
    clash = lambda a, b, k, s, t: F.struct(F.lit(k).alias("identity_type"), a.alias("source_value"), b.alias("target_value"), F.lit(s).alias("source_role"), F.lit(t).alias("target_role"))
    differs = [("imsi", "subscriber_imsi", "IMSI", "CDR_IMSI", "IPDR_SUBSCRIBER_IMSI"), ("imei", "device_imei", "IMEI", "CDR_IMEI", "IPDR_DEVICE_IMEI"), ("cell", "cell_id", "CELL_ID", "CDR_CELL_ID", "IPDR_CELL_ID")]
    conflicts = [F.when(F.col(a) != F.col(b), clash(F.col(a), F.col(b), k, s, t)) for a, b, k, s, t in differs]
    other = (F.col(ms) != F.col("a_party_phone")) & (F.col(ms) != F.col("b_party_phone"))
    conflicts.append(F.when(other, clash(F.concat(F.lit("A:"), "a_party_phone", F.lit("|B:"), "b_party_phone"), F.col(ms), "PHONE", "CDR_A_B_PARTY", "IPDR_SUBSCRIBER_MSISDN")))
    full = full.withColumn("evidence", F.array_compact(F.array(*items))).withColumn("conflicts", F.array_compact(F.array(*conflicts)))
    strong = F.size(F.filter("evidence", lambda e: e["identity_type"] != "CELL_ID"))
    clean = ~F.exists("conflicts", lambda x: x["identity_type"] != "CELL_ID")
    full = full.withColumn("strength", F.when((strong >= 2) | ((strong == 1) & clean), "STRONG").otherwise("MODERATE"))
    return _records(full.select("left_id", "right_id", "left_us", "right_us", "evidence", "conflicts", "strength"), "CDR_TO_IPDR")


def cdr_ipdr_pairs(cdr: DataFrame, ipdr: DataFrame, window: int, *columns: str) -> DataFrame:
    """Pairs of rows of ``cdr_ipdr`` with ``columns`` of either side, so that no exchange follows the join.

    ``cdr`` has ``left_us, a_party_phone, b_party_phone, imsi, imei``, ``ipdr`` has ``right_us, subscriber_msisdn,
    subscriber_imsi, device_imei``.  A pair that agrees in a phone comes once, another once for each number that agrees."""
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    span = window * 1_000_000
    slot = lambda x: F.floor(x / F.lit(8 * span)).cast("bigint")

    def keyed(df: DataFrame, own: list[str], *keys: Column) -> DataFrame:
        return df.select(*own, *(c for c in columns if c in df.columns and c not in own), F.inline(F.filter(F.array_distinct(F.array(*keys)), lambda x: x["value"].isNotNull())))

    l = keyed(cdr, ["left_us", "a_party_phone", "b_party_phone"], key(0, "a_party_phone"), key(0, "b_party_phone"), key(1, "imsi"), key(2, "imei")).withColumn("bucket", slot(F.col("left_us")))
    r = keyed(ipdr, ["right_us", "subscriber_msisdn"], key(0, "subscriber_msisdn"), key(1, "subscriber_imsi"), key(2, "device_imei"))
    r = r.withColumn("bucket", F.explode(F.sequence(slot(F.col("right_us") - span), slot(F.col("right_us") + span))))
    rows = l.join(r, ["kind", "value", "bucket"]).where(F.abs(F.col("right_us") - F.col("left_us")) <= span)
    by_phone = F.coalesce(F.col("subscriber_msisdn").isin(F.col("a_party_phone"), F.col("b_party_phone")), F.lit(False))
    return rows.where((F.col("kind") == 0) | ~by_phone).drop("kind", "value", "bucket")


def compare(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``(source_id, target_id, outcome)`` with outcome TP, FP or FN."""
    f = found.select("source_id", "target_id").distinct().withColumn("f", F.lit(1))
    t = truth.select("source_id", "target_id").distinct().withColumn("t", F.lit(1))
    outcome = F.when(F.col("f").isNull(), "FN").when(F.col("t").isNull(), "FP").otherwise("TP")
    return f.join(t, ["source_id", "target_id"], "full_outer").select("source_id", "target_id", outcome.alias("outcome"))


def scores(compared: DataFrame) -> DataFrame:
    """Precision, recall and F1 with guards; without any truth all are 0."""
    n = lambda x: F.count(F.when(F.col("outcome") == x, 1)).alias(x.lower())
    c = compared.agg(n("TP"), n("FP"), n("FN"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    none = F.col("tp") + F.col("fn") == 0
    c = c.withColumn("precision", F.when(none, F.lit(0.0)).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("predicted_links", F.col("tp") + F.col("fp"))


def error_samples(compared: DataFrame, n: int = 5) -> DataFrame:
    part = lambda x: compared.where(F.col("outcome") == x).orderBy("source_id", "target_id").limit(n)
    return part("FP").union(part("FN"))
