"""Scans, sinks, fusion checks, the scenario rollup and the streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracefold.operators import evaluate, fusion
from tracefold.sources import tables
from tracefold.streaming import correlate


def test_scans_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([["007", *[None] * 10, "x"]], tables.text_schema(tables.CDR))
    tables.write_csv(rows, f"{tmp_path}/cdr", one_file=True)
    assert len(list((tmp_path / "cdr").glob("part-*"))) == 1
    back = tables.read_csv(spark, f"{tmp_path}/cdr", tables.CDR)
    assert back.columns == tables.CDR and back.first()["CDR_ID"] == "007" and back.first()["IMSI"] is None
    assert tables.read_csv(spark, f"{tmp_path}/none", tables.CDR, missing_ok=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_csv(spark, f"{tmp_path}/none", tables.CDR).count()
    tables.write_parquet(spark.range(4).withColumn("k", F.col("id") % 2), f"{tmp_path}/p", ["k"])
    assert spark.read.parquet(f"{tmp_path}/p").where("k = 1").count() == 2


def test_truth_pairs(spark, tmp_path):
    (tmp_path / "truth.csv").write_text("Transaction_ID,CDR_ID,Is_Correlated\nT1,C1,1\nT1,C1, 1 \nT2,C2,0\nT3,C3,\n")
    got = tables.read_truth_pairs(spark, f"{tmp_path}/truth.csv", "Transaction_ID", "CDR_ID").collect()
    assert [tuple(r) for r in got] == [("T1", "C1")]
    assert tables.read_truth_pairs(spark, f"{tmp_path}/no.csv", "Transaction_ID", "CDR_ID").count() == 0


def test_text_grids_and_scans(spark):
    text = "Statement\nDate  Narration  Amount\n1/2/2024  UPI/x\n\n3\nPage 1 of 2\na\tb\tc\td"
    pages = spark.createDataFrame([("d", 1, text), ("e", 1, "short")], "doc string, page int, text string")
    got = {r.row_idx: list(r.cells) for r in tables.read_text_grid(spark, pages).where("doc = 'd'").collect()}
    assert got == {1: ["Date", "Narration", "Amount", None], 2: ["1/2/2024", "UPI/x", None, None], 6: ["a", "b", "c", "d"]}
    assert tables.require_text(pages.where("doc = 'd'")).count() == 1
    with pytest.raises(Exception, match="no text in the pages of e"):
        tables.require_text(pages).collect()


def linked(spark, *links):
    return spark.createDataFrame([(f"L{i}", rel, a, b, True) for i, (rel, a, b) in enumerate(links)], "correlation_id string, relationship string, source_id string, target_id string, accepted boolean")


def test_fusion_checks(spark):
    t = dt.datetime(2024, 1, 1)
    bank = spark.createDataFrame([("T1", t), ("T2", t)], "transaction_id string, transaction_timestamp timestamp_ntz")
    cdr = spark.createDataFrame([("C1", t), ("C2", t)], "cdr_id string, event_timestamp timestamp_ntz")
    ipdr = spark.createDataFrame([("I1", t)], "ipdr_id string, session_timestamp timestamp_ntz")
    one, two = linked(spark, ("BANK_TO_CDR", "T1", "C1"), ("BANK_TO_CDR", "T1", "C2")), linked(spark, ("CDR_TO_IPDR", "C1", "I1"), ("CDR_TO_IPDR", "C2", "I1"))
    got = {r.transaction_id: [(x.event_type, x.event_id) for x in r.timeline] for r in fusion.contexts(bank, cdr, ipdr, one, two).collect()}
    assert got == {"T1": [("CDR", "C1"), ("CDR", "C2"), ("IPDR", "I1"), ("TRANSACTION", "T1")], "T2": [("TRANSACTION", "T2")]}
    with pytest.raises(ValueError, match="link to a missing cdr_id: C9"):
        fusion.contexts(bank, cdr, ipdr, linked(spark, ("BANK_TO_CDR", "T1", "C9")), two)
    with pytest.raises(ValueError, match="duplicate ipdr_id"):
        fusion.contexts(bank, cdr, ipdr.union(ipdr), one, two)
    with pytest.raises(ValueError, match="wrong relationship"):
        fusion.contexts(bank, cdr, ipdr, linked(spark, ("CDR_TO_IPDR", "T1", "C1")), two)


def test_scenario_rollup_and_labels(spark):
    rows = spark.createDataFrame([(i, float(100 - i), 1, "NORMAL" if i % 4 == 0 else f"S{i % 3}") for i in range(12)], "id long, score double, label int, scenario string")
    got = {r.scenario: (r.total_in_test, r.detected_k3, r.recall_k3, r.recall_k12) for r in evaluate.scenario_rollup(rows, (3, 12)).collect()}
    assert got == {"S0": (3, 0, "0.00%", "100.00%"), "S1": (3, 1, "33.33%", "100.00%"), "S2": (3, 1, "33.33%", "100.00%")}
    truth = spark.createDataFrame([(1, "1"), (2, None)], "id long, label string")
    assert {r.id: r.label for r in evaluate.with_labels(rows.drop("label"), truth).where("id < 4").collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    none = evaluate.f1_threshold(rows.limit(0)).first()
    assert none.threshold is None and evaluate.f1_threshold(rows).first().threshold == 89.0


def test_streams(spark, tmp_path):
    """Pairs inside the window only, edges included, and counts of windows that the watermark has closed."""
    t = dt.datetime(2024, 1, 1, 12)
    schema = "id string, ts timestamp, phone string"
    spark.createDataFrame([("T1", t, "1"), ("T2", t, "2")], schema).write.parquet(f"{tmp_path}/bank")
    calls = [("C1", t + dt.timedelta(seconds=1800), "1"), ("C2", t - dt.timedelta(seconds=1801), "1"), ("C3", t, "3"), ("C4", t - dt.timedelta(seconds=5), "2")]
    spark.createDataFrame(calls, schema).write.parquet(f"{tmp_path}/calls")
    bank = spark.readStream.schema(schema).parquet(f"{tmp_path}/bank").withColumnRenamed("id", "transaction_id")
    call = spark.readStream.schema(schema).parquet(f"{tmp_path}/calls").withColumnRenamed("id", "cdr_id")
    pairs = correlate.stream_pairs(bank, call).writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp1").start()
    assert pairs.awaitTermination(120)
    assert {tuple(r) for r in spark.table("pairs").collect()} == {("T1", "C1", 1800), ("T2", "C4", -5)}
    active = correlate.windowed_activity(call.withColumnRenamed("phone", "event_type")).writeStream.format("memory").queryName("active").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    assert active.awaitTermination(120)
    assert sum(r.n for r in spark.table("active").collect()) == 4
