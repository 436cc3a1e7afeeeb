"""Raw text rows to canonical records: one pass gives record, first error and warnings; splitting is a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import normalize as N
from tracefold.sources.tables import PARTY

CORE = "Missing CORE_REQUIRED field: "
CORE_BAD = "Missing or invalid CORE_REQUIRED field: "
FUSION = "Missing FUSION_REQUIRED field: "


def _warn(**fields: Column) -> Column:
    marks = [F.when(value.isNull(), F.lit(FUSION + name.replace("__", "."))) for name, value in fields.items()]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def _source(kind: str, file: str, rid: Column) -> Column:
    return F.struct(F.lit(kind).alias("source_type"), F.lit(file).alias("source_file"), rid.alias("source_record_id"))


def _stage(raw: DataFrame, **columns: Column) -> DataFrame:
    """The raw row with its normalised values as columns of their own, so that each is computed once."""
    return raw.withColumns({f"_{k}": v for k, v in columns.items()})


def _result(raw: DataFrame, staged: DataFrame, fields: list[Column], error: Column, warnings: Column) -> DataFrame:
    row = F.create_map(*(x for c in raw.columns for x in (F.lit(c), F.col(c))))
    done = staged.withColumn("_error", error)
    out = done.select(F.col("_error").alias("error"), F.when(F.col("_error").isNull(), warnings).alias("warnings"), F.when(F.col("_error").isNull(), F.struct(*fields)).alias("record"), row.alias("row"))
    # The number of the row keeps the test of the error above the columns it is made of: pushed into the scan, it would
    # hold each of them written out many times.
    out._valid = staged.withColumn("_at_row", F.monotonically_increasing_id()).withColumn("_error", error).where("_error is null and _at_row >= 0").select(*fields)
    return out


def _bad_int(c: str, least: int = 0, most: int | None = None) -> Column:
    value = N.integer(F.col(c))
    wrong = value.isNull() | (value < least)
    if most is not None:
        wrong = wrong | (value > most)
    return ~N.missing(F.col(c)) & F.coalesce(wrong, F.lit(True))


def bank(raw: DataFrame, file: str = "bank") -> DataFrame:
    """``(error, warnings, record, row)`` of raw bank rows; errors are tested in the order id, time, amount."""
    c = F.col
    sides = {f"{p}_{x}": (N.phone if x == "Phone_Number" else N.trimmed)(c(f"{p}_{x}")) for p in ("Sender", "Receiver") for x in PARTY}
    staged = _stage(raw, rid=N.trimmed(c("Transaction_ID")), amount=N.decimal_amount(c("Transaction_Amount")), at=N.timestamp(c("Date"), c("Timestamp")), **sides)
    rid, amount, fault = c("_rid"), c("_amount"), N.timestamp_fault(c("Date"), c("Timestamp"), c("_at"))
    error = (
        F.when(rid.isNull(), F.lit(CORE + "transaction_id"))
        .when(fault.isNotNull(), F.concat(F.lit(CORE_BAD + "transaction_timestamp - "), fault))
        .when(amount.isNull(), F.concat(F.lit(CORE_BAD + "amount - "), F.coalesce(c("Transaction_Amount"), F.lit("missing"))))
    )

    def party(side: str) -> Column:
        t = lambda x: c(f"_{side}_{x}")
        return F.struct(t("Customer_ID").alias("customer_id"), t("Customer_Name").alias("customer_name"), t("Bank_Name").alias("bank_name"), t("Account_Number").alias("account_number"), t("Account_Type").alias("account_type"), t("IFSC").alias("ifsc"), t("Phone_Number").alias("phone"))

    fields = [
        rid.alias("transaction_id"), c("_at").alias("transaction_timestamp"), N.trimmed(c("Txn_Ref_Number")).alias("transaction_reference"), N.trimmed(c("Transaction_Mode")).alias("transaction_mode"),
        N.trimmed(c("Currency")).alias("currency"), amount.alias("amount"), party("Sender").alias("sender"), party("Receiver").alias("receiver"), _source("BANK", file, rid).alias("provenance"),
    ]
    return _result(raw, staged, fields, error, _warn(sender__phone=c("_Sender_Phone_Number"), receiver__phone=c("_Receiver_Phone_Number")))


def cdr(raw: DataFrame, file: str = "cdr") -> DataFrame:
    c = F.col
    staged = _stage(raw, rid=N.trimmed(c("CDR_ID")), a=N.phone(c("A_Party_Number")), b=N.phone(c("B_Party_Number")), at=N.timestamp(c("Call_Date"), c("Call_Start_Time")), imsi=N.compact(c("IMSI")), imei=N.compact(c("IMEI")), cell=N.trimmed(c("First_Cell_Global_ID")))
    rid, a, b, imsi, imei, cell = (c(f"_{x}") for x in ("rid", "a", "b", "imsi", "imei", "cell"))
    fault = N.timestamp_fault(c("Call_Date"), c("Call_Start_Time"), c("_at"))
    error = (
        F.when(rid.isNull(), F.lit(CORE + "cdr_id")).when(fault.isNotNull(), F.concat(F.lit(CORE_BAD + "event_timestamp - "), fault)).when(a.isNull(), F.lit(CORE + "a_party_phone"))
        .when(b.isNull(), F.lit(CORE + "b_party_phone")).when(_bad_int("Call_Duration_Seconds"), F.concat(F.lit("Invalid Call_Duration_Seconds: "), c("Call_Duration_Seconds")))
    )
    fields = [
        rid.alias("cdr_id"), c("_at").alias("event_timestamp"), a.alias("a_party_phone"), b.alias("b_party_phone"), N.trimmed(c("Call_Type")).alias("call_type"), N.integer(c("Call_Duration_Seconds")).alias("duration_seconds"),
        imsi.alias("imsi"), imei.alias("imei"), N.trimmed(c("First_BTS_Location")).alias("first_bts_location"), cell.alias("cell_id"), N.trimmed(c("Roaming_Network_Circle")).alias("roaming_circle"), _source("CDR", file, rid).alias("provenance"),
    ]
    return _result(raw, staged, fields, error, _warn(imsi=imsi, imei=imei, cell_id=cell))


def ipdr(raw: DataFrame, file: str = "ipdr") -> DataFrame:
    c = F.col
    staged = _stage(raw, rid=N.trimmed(c("IPDR_ID")), msisdn=N.phone(c("Subscriber_MSISDN")), at=N.timestamp(c("Session_Date"), c("Session_Start_Time")), imsi=N.compact(c("Subscriber_IMSI")), imei=N.compact(c("Device_IMEI")), cell=N.trimmed(c("Cell_Global_ID")))
    rid, msisdn, imsi, imei, cell = (c(f"_{x}") for x in ("rid", "msisdn", "imsi", "imei", "cell"))
    fault = N.timestamp_fault(c("Session_Date"), c("Session_Start_Time"), c("_at"))
    bad_ip = lambda x: ~N.missing(c(x)) & ~N.ip_valid(c(x))
    error = (
        F.when(rid.isNull(), F.lit(CORE + "ipdr_id")).when(fault.isNotNull(), F.concat(F.lit(CORE_BAD + "session_timestamp - "), fault)).when(msisdn.isNull(), F.lit(CORE + "subscriber_msisdn"))
        .when(_bad_int("Session_Duration_Seconds"), F.concat(F.lit("Invalid Session_Duration_Seconds: "), c("Session_Duration_Seconds"))).when(_bad_int("Destination_Port", 0, 65535), F.concat(F.lit("Invalid Destination_Port: "), c("Destination_Port")))
        .when(bad_ip("Source_IP_Address"), F.concat(F.lit("Invalid Source_IP_Address: "), c("Source_IP_Address"))).when(bad_ip("Destination_IP_Address"), F.concat(F.lit("Invalid Destination_IP_Address: "), c("Destination_IP_Address")))
    )
    fields = [
        rid.alias("ipdr_id"), c("_at").alias("session_timestamp"), imsi.alias("subscriber_imsi"), msisdn.alias("subscriber_msisdn"), imei.alias("device_imei"), N.trimmed(c("Source_IP_Address")).alias("source_ip"),
        N.trimmed(c("Destination_IP_Address")).alias("destination_ip"), N.integer(c("Destination_Port")).cast("int").alias("destination_port"), cell.alias("cell_id"), N.integer(c("Session_Duration_Seconds")).alias("duration_seconds"), _source("IPDR", file, rid).alias("provenance"),
    ]
    return _result(raw, staged, fields, error, _warn(subscriber_imsi=imsi, device_imei=imei, cell_id=cell))


def valid(mapped: DataFrame) -> DataFrame:
    return getattr(mapped, "_valid", None) or mapped.where("error is null").select("record.*")


def rejects(mapped: DataFrame) -> DataFrame:
    return mapped.where("error is not null").select("error", "row")


def warning_count(mapped: DataFrame) -> DataFrame:
    return mapped.agg(F.coalesce(F.sum(F.size("warnings")).cast("bigint"), F.lit(0).cast("bigint")).alias("warnings"))
