"""Identity observations in long form, and the queries of the identity index over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (field, role, identity type) in the order of emission.
BANK = [(f"{p}.{f}", p.upper(), t) for p in ("sender", "receiver") for f, t in (("phone", "PHONE"), ("account_number", "BANK_ACCOUNT"), ("customer_id", "CUSTOMER_ID"))]
CDR = [("a_party_phone", "A_PARTY", "PHONE"), ("b_party_phone", "B_PARTY", "PHONE"), ("imsi", "SUBSCRIBER", "IMSI"), ("imei", "DEVICE", "IMEI"), ("cell_id", "CELL", "CELL_ID")]
IPDR = [("subscriber_msisdn", "SUBSCRIBER", "PHONE"), ("subscriber_imsi", "SUBSCRIBER", "IMSI"), ("device_imei", "DEVICE", "IMEI"), ("cell_id", "CELL", "CELL_ID"), ("source_ip", "SOURCE_IP", "IP_ADDRESS"), ("destination_ip", "DESTINATION_IP", "IP_ADDRESS")]


def observations(records: DataFrame, kind: str, rid: str, fields: list[tuple[str, str, str]]) -> DataFrame:
    """``(identity_type, normalized_value, raw_value, role, source_type, record_id, ordinal)``."""
    each = [F.struct(F.lit(t).alias("identity_type"), F.col(f).alias("normalized_value"), F.col(f).alias("raw_value"), F.lit(role).alias("role"), F.lit(i).alias("ordinal")) for i, (f, role, t) in enumerate(fields)]
    found = records.select(F.col(rid).alias("record_id"), F.inline(F.filter(F.array(*each), lambda x: x["normalized_value"].isNotNull() & (x["normalized_value"] != ""))))
    return found.withColumn("source_type", F.lit(kind))


def register(*parts: DataFrame) -> DataFrame:
    """The identity index: observations without repeats, dealt by identity for the lookups that follow."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["identity_type", "normalized_value", "role", "source_type", "record_id"])


def lookup(index: DataFrame, identity_type: str, value: str) -> DataFrame:
    return index.where((F.col("identity_type") == identity_type) & (F.col("normalized_value") == value))


def has_identity(index: DataFrame, identity_type: str, value: str) -> bool:
    return not lookup(index, identity_type, value).isEmpty()


def sources(index: DataFrame) -> DataFrame:
    """``(identity_type, normalized_value, sources, n_observations)``."""
    return index.groupBy("identity_type", "normalized_value").agg(F.array_sort(F.collect_set("source_type")).alias("sources"), F.count("*").alias("n_observations"))


def cross_source(index: DataFrame) -> DataFrame:
    return sources(index).where(F.size("sources") > 1)


def unique_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("identity_type").agg(F.countDistinct("normalized_value").alias("n_values"), F.count("*").alias("n_observations"))
