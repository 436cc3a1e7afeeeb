from pyspark.sql import functions as F

from tracefold.functions import normalize as N
from tracefold.operators import canonical, correlate, evaluate, grid
from tracefold.plans import catalogue
from tracefold.sources.tables import BANK, text_schema

SCHEMA_B = "transaction_id string, transaction_timestamp timestamp_ntz, sender struct<phone:string>, receiver struct<phone:string>"


def bank_rows(spark, *rows):
    return spark.createDataFrame([[r.get(c) for c in BANK] for r in rows], text_schema(BANK))


def test_amounts(spark):
    cases = {"(1,234.56)": -1234.56, "1234.56-": -1234.56, "Rs. 5,000 DR": -5000.0, "1,23,456.78": 123456.78, "-1,234.56": -1234.56, "5000 CR": 5000.0, "": None, "INR 10,500.25": 10500.25, "INR 999": 999.0, "50.00": 50.0, "(500)": -500.0}
    df = spark.createDataFrame(list(cases.items()), "v string, want double")
    assert df.where(~N.amount(F.col("v")).eqNullSafe(F.col("want"))).count() == 0


def test_bank_rejects_in_order(spark):
    good = {"Transaction_ID": "T1", "Date": "2024-01-02", "Timestamp": "3:4:5", "Transaction_Amount": "1E2", "Sender_Phone_Number": "+91 98"}
    mapped = canonical.bank(bank_rows(spark, good, good | {"Transaction_ID": " "}, good | {"Date": None}, good | {"Timestamp": "25:00:00"}, good | {"Transaction_Amount": "1,000"}))
    errors = [r.error for r in canonical.rejects(mapped).collect()]
    assert errors == ["Missing CORE_REQUIRED field: transaction_id", "Missing or invalid CORE_REQUIRED field: transaction_timestamp - Missing date for timestamp", "Missing or invalid CORE_REQUIRED field: transaction_timestamp - Failed to parse datetime: 2024-01-02 25:00:00", "Missing or invalid CORE_REQUIRED field: amount - 1,000"]
    assert canonical.warning_count(mapped).first()[0] == 1
    row = canonical.valid(mapped).first()
    assert float(row.amount) == 100 and row.sender.phone == "9198" and row.receiver.phone is None


def test_window_edges_and_evidence(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1, 12)
    bank = spark.createDataFrame([("T", t, ("1",), ("2",))], SCHEMA_B)
    calls = [(f"D{i}", t + dt.timedelta(seconds=d), a, b) for i, (d, a, b) in enumerate([(-1800, "1", "9"), (1800, "9", "2"), (1801, "1", "2"), (-1801, "1", "2"), (0, "1", "2")])]
    cdr = spark.createDataFrame(calls, "cdr_id string, event_timestamp timestamp_ntz, a_party_phone string, b_party_phone string")
    got = {r.target_id: (r.time_difference_seconds, [(e.source_role, e.target_role) for e in r.evidence]) for r in correlate.bank_cdr(bank, cdr).collect()}
    assert got == {"D0": (-1800, [("BANK_SENDER", "A_PARTY")]), "D1": (1800, [("BANK_RECEIVER", "B_PARTY")]), "D4": (0, [("BANK_SENDER", "A_PARTY"), ("BANK_RECEIVER", "B_PARTY")])}


def test_headers_and_types():
    assert grid.best_column("Calling Number", "cdr") == "A_Party_Number" and grid.best_column("Src IP", "ipdr") == "Source_IP_Address"
    assert grid.detect_dataset(["Txn Date", "Description", "Debit", "Credit", "Balance"]) == "bank"


def test_ranking_ties_and_guards(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (2, 0.9, 0), (3, 0.1, 1)], "id long, score double, label long")
    assert [tuple(r) for r in evaluate.top_k(rows, [1, 2]).orderBy("k").collect()] == [(1, 1, 1.0, 0.5), (2, 1, 0.5, 0.5)]
    assert evaluate.roc_auc(rows).first()[0] == 0.25
    none = spark.createDataFrame([], "source_id string, target_id string, outcome string")
    assert correlate.scores(none).select("precision", "recall", "f1").first() == (0.0, 0.0, 0.0)


def test_entry_works_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_ip_addresses_as_the_standard_library_reads_them(spark):
    import ipaddress
    import random

    rng = random.Random(4)
    parts = ["", "0", "1", "ffff", "12345", "g", "1.2.3.4", "256.1.1.1", "01.2.3.4"]
    tries = {":".join(rng.choices(parts, weights=[3, 3, 9, 3, 1, 1, 2, 1, 1], k=rng.randint(1, 9))) for _ in range(6000)} | {"fe80::1%eth0", "::1%", "1.2.3.4%x", "1.2.3.4 ", "::"}

    def good(x):
        try:
            ipaddress.ip_address(x.strip())
            return True
        except ValueError:
            return False

    got = {r.v: r.ok for r in spark.createDataFrame([(x,) for x in tries], "v string").select("v", N.ip_valid(F.col("v")).alias("ok")).collect()}
    want = {x: good(x) for x in tries}
    assert got == want and sum(want.values()) > 100


def test_summary_rows_and_narrations(spark):
    says = {"TOTAL MOTORS PAYMENT": False, "BY OPENING BALANCE": True, "TRANSACTION TOTAL": True, " Sub Total ": True, "GRAND TOTAL 5": False, "x\nOPENING BALANCE": False, None: False}
    df = spark.createDataFrame(list(says.items()), "v string, want boolean")
    assert df.where(N.is_summary(F.col("v")) != F.col("want")).count() == 0
    cases = {"IMPS/OUT/77/ A B /x/Axis Ltd": ("IMPS", "77", "A B", "Axis Ltd"), "IMPS/P2M/77/A": ("IMPS_P2M", None, None, None), "pos//x/12": ("POS", "12", None, None), "EDC/ab": ("EDC", None, None, None), "x/ATM": ("x/ATM", None, None, None), "": ("", None, None, None), "IMPS/a/7/First Bank": ("IMPS", "7", None, "First Bank"), "CASHBACK/1": ("CASH", None, None, None), None: None}
    got = {r.v: r.n and tuple(r.n) for r in spark.createDataFrame([(k,) for k in cases], "v string").select("v", N.narration(F.col("v")).alias("n")).collect()}
    assert got == cases


def test_text_forms(spark):
    df = spark.createDataFrame([("ﬁn  x\t① ",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(N.text(F.col("v"))).collect()] == ["fin x 1", None, ""]


def test_headers_of_real_statements_map():
    bank = grid.column_map(["Tran Dt", "Chq/Ref.", "Amt(INR)", "Payee Name", "Beneficiary A/C No", "A/c No.", "Closing Balance", "Narration", "Debit"], "bank")
    assert list(bank.values()) == ["Date", "Txn_Ref_Number", "Transaction_Amount", "Receiver_Customer_Name", "Receiver_Account_Number", "Sender_Account_Number", "Balance", "Transaction_Mode"]
    assert set(grid.column_map(["Calling No.", "Dialed Number", "Dur (sec)", "CGI", "Call Dt"], "cdr").values()) == {"A_Party_Number", "B_Party_Number", "Call_Duration_Seconds", "First_Cell_Global_ID", "Call_Date"}
    assert grid.detect_dataset(["Framed IP", "NAT IP", "x"]) == "ipdr" and grid.detect_dataset(["BTS", "Roaming"]) == "cdr"


def test_signed_amounts(spark):
    df = spark.createDataFrame([("-500", "D", "5000 DR", "-500"), ("500", "credit", None, "(7)"), ("-5", "x", None, None), (None, "DR", "5", "")], "a string, f string, d string, c string")
    got = df.select(grid.merge_amount_flag(F.col("a"), F.col("f")), grid.merge_debit_credit(F.col("d"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(-500.0, -4500.0), (500.0, 7.0), (-5.0, None), (None, -5.0)]
    assert grid.amount_columns(["Amt.", "DR/CR", "Balance"]) == {"amount": "Amt.", "flag": "DR/CR"} and grid.amount_columns(["Withdrawal Amt", "Deposit Amt"]) == {"debit": "Withdrawal Amt", "credit": "Deposit Amt"}


def test_required_columns(spark):
    import pytest

    bank = spark.createDataFrame([("2024-01-01", None, "9")], "Date string, Transaction_Amount string, Balance string")
    with pytest.raises(ValueError, match="Transaction_Amount"):
        grid.require(bank, "bank")
    grid.require(bank.withColumn("Transaction_Amount_Merged", F.lit("1")), "bank")
    grid.require(spark.createDataFrame([("d", "1")], "Call_Date string, B_Party_Number string"), "cdr")
    grid.require(spark.createDataFrame([("d", "1")], "Session_Date string, Device_IMEI string"), "ipdr")


def test_providers_and_responses(spark):
    import json

    from tracefold.sources import tables

    rows = [("d", i, ["upi to jio", "Kotak Mahindra"] if i == 3 else ["x", None]) for i in range(30)] + [("e", 25, ["jio", ""]), ("e", 1, ["a", "b"])]
    df = spark.createDataFrame(rows, "doc string, row_idx int, cells array<string>")
    got = {r.doc: r.provider for r in grid.provider_of(df, {"KOTAK": "Kotak Bank", "MAHINDRA": "Kotak Bank", "JIO": "Jio"}).collect()}
    assert got == {"d": "Kotak Bank", "e": None}
    out = json.loads(tables.response(spark.range(2500), "bank"))
    assert out["rows"] == 2500 == len(out["data"]) and out["data"][0] == {"id": 0} and json.loads(tables.response(spark.range(0), "x"))["data"] == []


def test_documents_of_unknown_kind_and_empty_grids(spark):
    rows = [("u", i, ["hello", "world"]) for i in range(4)] + [("b", 0, ["Txn Date", "Narration", "Amount"]), ("b", 1, ["1/2/2024", "POS/7", "-5"]), ("b", 2, ["TXN DATE", "Narration", "Amount"]), ("b", 3, ["", "TOTAL", "9"])]
    df = spark.createDataFrame(rows, "doc string, row_idx int, cells array<string>")
    got = grid.extract(df, "bank").collect()
    assert [(r.doc, r.row_idx, r.Transaction_Amount, r.Transaction_ID) for r in got] == [("b", 1, "-5.0", "7")]
    assert grid.extract(df.limit(0), "bank").count() == 0 == grid.extract(df, "cdr").count()


def pairs_rows(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1, 12)
    bank = spark.createDataFrame([("T", t, ("1",), ("2",)), ("T", t, ("1",), ("2",)), ("U", t, ("3",), ("3",)), ("V", t, None, ("2",)), ("W", t, (None,), None)], SCHEMA_B)
    calls = [("D1", t - dt.timedelta(seconds=60), "1", "2"), ("D1", t - dt.timedelta(seconds=60), "1", "2"), ("D2", t, "3", "3"), ("D3", t + dt.timedelta(seconds=9), "2", None), ("D4", t - dt.timedelta(seconds=1800), "9", "1")]
    cdr = spark.createDataFrame([(*c, 5, "m", "K", "R") for c in calls], "cdr_id string, event_timestamp timestamp_ntz, a_party_phone string, b_party_phone string, duration_seconds bigint, imei string, cell_id string, roaming_circle string")
    return bank, cdr


def test_pairs_are_not_exchanged_and_repeated_rows_meet(spark):
    bank, cdr = pairs_rows(spark)
    found = correlate.bank_cdr(bank, cdr)
    want = correlate.bank_cdr_evidence(bank, cdr).groupBy("left_id", "right_id").count().collect()
    assert {(r.source_id, r.target_id): len(r.evidence) for r in found.collect()} == {(r.left_id, r.right_id): r["count"] for r in want} and found.count() == len(want) == 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")]


def test_call_context_without_links(spark):
    from tracefold.operators import features

    bank, cdr = pairs_rows(spark)
    bank, cdr = bank.dropDuplicates(["transaction_id"]), cdr.dropDuplicates(["cdr_id"])
    want = features.call_context(bank, features.context_calls(bank, cdr, correlate.bank_cdr(bank, cdr)))
    got = features.near_call_context(bank, cdr, 1800)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 4
    plan = catalogue.QUERIES["feat_calls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "target_id" not in plan


def far_rows(spark):
    """Transactions and calls of few phones with ties, repeats and missing values."""
    import datetime as dt
    import random

    rng, t = random.Random(7), dt.datetime(2024, 1, 1, 12)
    phone = lambda: rng.choice(["1", "2", "3", "4", "5", None])
    bank = spark.createDataFrame([(f"T{i}", t + dt.timedelta(minutes=rng.randint(0, 300)), (phone() or "6",), (phone(),)) for i in range(60)], SCHEMA_B)
    some = lambda n: rng.choice([None, *map(str, range(n))])
    calls = [(f"D{i}", t + dt.timedelta(minutes=rng.randint(-60, 300)), phone(), phone(), rng.randint(0, 99), some(30), some(9), some(3)) for i in range(150)]
    cdr = spark.createDataFrame(calls, "cdr_id string, event_timestamp timestamp_ntz, a_party_phone string, b_party_phone string, duration_seconds bigint, imei string, cell_id string, roaming_circle string")
    return bank, cdr


def test_value_novelty_without_pairs_or_prefix_sets(spark):
    from tracefold.operators import features, near

    bank, cdr = far_rows(spark)
    all_of = features.caller_features(features.context_calls(bank, cdr, correlate.bank_cdr(bank, cdr)), features.call_history(cdr))
    want = all_of.select("transaction_id", "imei_novelty", "cell_novelty", "roaming_change").collect()
    got = near.value_novelty(bank, features.call_history(cdr), 1800).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r[1:] for r in got}) > 3
    plan = catalogue.QUERIES["feat_device_cell_roam_novelty"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "correlation_id" not in plan
    empty = near.value_novelty(bank, features.call_history(cdr.limit(0)), 1800)
    assert empty.count() == 60 and empty.where("imei_novelty is not null").count() == 0


def test_caller_novelty_without_pairs_or_prefix_lists(spark):
    from tracefold.operators import features, near

    bank, cdr = far_rows(spark)
    all_of = features.caller_features(features.context_calls(bank, cdr, correlate.bank_cdr(bank, cdr)), features.call_history(cdr))
    want = all_of.select("transaction_id", "caller_novelty", "caller_historical_frequency").collect()
    got = near.caller_novelty(bank, features.call_history(cdr), 1800).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r[2] for r in got}) > 3
    plan = catalogue.QUERIES["feat_caller_novelty"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "correlation_id" not in plan


def test_set_of_call_features_without_links(spark):
    from tracefold.operators import features

    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["feature_set_b"](spark, sf)
    want = features.feature_sets(*catalogue._linked(spark, sf))[1]
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "correlation_id" not in got._jdf.queryExecution().optimizedPlan().toString()


def far_sessions(spark, cdr):
    """Calls with subscriber numbers, and sessions that agree with them in one or several numbers."""
    import datetime as dt
    import random

    rng, t = random.Random(11), dt.datetime(2024, 1, 1, 12)
    some = lambda n, p="": rng.choice([None, *(p + str(x) for x in range(n))])
    calls = [(*r, some(4, "M")) for r in cdr.collect()]
    cdr = spark.createDataFrame(calls, cdr.schema.add("imsi", "string"))
    rows = [(f"I{i}", t + dt.timedelta(minutes=rng.randint(-60, 300)), rng.choice("12345"), some(4, "M") or "M9", some(30), some(3, "a"), some(4, "b"), rng.randint(1, 3), rng.randint(0, 50), some(9)) for i in range(120)]
    ipdr = spark.createDataFrame(rows, "ipdr_id string, session_timestamp timestamp_ntz, subscriber_msisdn string, subscriber_imsi string, device_imei string, source_ip string, destination_ip string, destination_port int, duration_seconds bigint, cell_id string")
    return cdr, ipdr


def same_rows(got, want, kinds=3):
    text = lambda rows: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    a, b = got.select(*sorted(got.columns)), want.select(*sorted(want.columns))
    assert a.columns == b.columns and text(a.collect()) == text(b.collect()) and a.count() > 20
    assert len({r[1:] for r in a.drop("t").select("transaction_id", *[c for c in a.columns if c not in ("t", "transaction_id")]).collect()}) >= kinds


def linked_sessions(spark):
    from tracefold.operators import features, fusion

    bank, cdr = far_rows(spark)
    cdr, ipdr = far_sessions(spark, cdr)
    links = correlate.bank_cdr(bank, cdr), correlate.cdr_ipdr(cdr, ipdr)
    one, two = fusion.link_tables(*links)
    return bank, cdr, ipdr, one, links[1], features.context_sessions(bank, ipdr, two)


def unlinked(spark, name):
    assert "correlation_id" not in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_all_session_features_without_links(spark):
    from tracefold.operators import features, near

    bank, cdr, ipdr, one, links, sessions = linked_sessions(spark)
    same_rows(near.session_counts(bank, cdr, ipdr, 1800), features.session_counts(sessions))
    same_rows(near.session_novelty(bank, cdr, ipdr, features.session_history(ipdr), 1800), features.session_novelty(sessions, features.session_history(ipdr)))
    same_rows(near.consistency(bank, cdr, ipdr, 1800), features.consistency(bank, one, links), kinds=1)
    unlinked(spark, "feature_set_c")


def test_session_counts_without_links(spark):
    from tracefold.operators import features, near

    bank, cdr, ipdr, _, _, sessions = linked_sessions(spark)
    same_rows(near.session_counts(bank, cdr, ipdr, 1800), features.session_counts(sessions))
    unlinked(spark, "feat_sessions")


def test_contexts_without_calls_are_counted_without_timelines(spark):
    bank, cdr = far_rows(spark)
    from tracefold.operators import near

    linked = {r.source_id for r in correlate.bank_cdr(bank, cdr, 60).collect()}
    got = {r.transaction_id for r in near.counts(bank, near.call_events(cdr), 60).where("n > 0").collect()}
    assert got == linked and 0 < len(got) < 60
    unlinked(spark, "fusion_missing_context")


def test_consistency_without_links(spark):
    from tracefold.operators import features, near

    bank, cdr, ipdr, one, links, sessions = linked_sessions(spark)
    same_rows(near.consistency(bank, cdr, ipdr, 1800), features.consistency(bank, one, links), kinds=1)
    unlinked(spark, "feat_consistency")


def test_duration_deviation_without_links(spark):
    from tracefold.operators import features, near

    bank, cdr, ipdr, one, links, sessions = linked_sessions(spark)
    h = features.session_history(ipdr)
    columns = ["transaction_id", "session_duration_deviation"]
    same_rows(near.session_novelty(bank, cdr, ipdr, h, 1800).select(columns), features.session_novelty(sessions, h).select(columns), kinds=2)
    unlinked(spark, "feat_duration_dev")


def test_address_novelty_without_links(spark):
    from tracefold.operators import features, near

    bank, cdr, ipdr, one, links, sessions = linked_sessions(spark)
    h = features.session_history(ipdr)
    columns = ["transaction_id", "source_ip_novelty", "destination_ip_novelty", "destination_port_novelty"]
    same_rows(near.session_novelty(bank, cdr, ipdr, h, 1800).select(columns), features.session_novelty(sessions, h).select(columns), kinds=2)
    unlinked(spark, "feat_ip_port_novelty")


def test_pair_novelty_without_links(spark):
    from tracefold.operators import features, near

    bank, cdr, ipdr, one, links, sessions = linked_sessions(spark)
    h = features.session_history(ipdr)
    columns = ["transaction_id", "imsi_imei_pair_novelty"]
    same_rows(near.session_novelty(bank, cdr, ipdr, h, 1800).select(columns), features.session_novelty(sessions, h).select(columns), kinds=1)
    unlinked(spark, "feat_pair_novelty")


def test_context_counts_without_timelines(spark):
    unlinked(spark, "fusion_counts")


def test_pairs_are_counted_in_compiled_code(spark):
    for bank, cdr in (far_rows(spark), pairs_rows(spark)):
        want = correlate.bank_cdr(bank, cdr).select("correlation_id", "source_id", "target_id", "time_difference_seconds", F.size("evidence").cast("bigint").alias("n_evidence"))
        got = correlate.bank_cdr_counts(bank, cdr)
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 4
    plan = catalogue.QUERIES["corr_bank_cdr_wide"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]
    assert "Join" in above and "lambda" not in above


def test_valid_rows_are_filtered_above_their_columns(spark):
    plan = catalogue.bank(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert all(x.count("gettimestamp") <= 1 for x in plan.splitlines() if "Filter" in x)


def test_timelines_without_links(spark):
    from tracefold.operators import fusion, near

    bank, cdr, ipdr, *_ = linked_sessions(spark)
    rows = fusion.timeline(bank, cdr, ipdr, correlate.bank_cdr(bank, cdr), correlate.cdr_ipdr(cdr, ipdr)).distinct().collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r.us, r.event_type, r.event_id)):
        want.setdefault(r.transaction_id, []).append((len(want.get(r.transaction_id, [])), r.us, r.event_type, r.event_id))
    want = sorted((t, *x) for t, xs in want.items() for x in xs)
    assert sorted(map(tuple, near.timelines(bank, cdr, ipdr, 1800).collect())) == want == sorted(map(tuple, fusion.ordered_timelines(bank, cdr, ipdr).collect()))
    assert len({r[3] for r in want}) == 3 and len(want) > 200
    twice = fusion.ordered_timelines(bank.union(bank), cdr, ipdr)
    assert sorted(map(tuple, twice.collect())) == want
    assert near.timelines(bank, cdr.limit(0), ipdr.limit(0), 1800).count() == 60
    unlinked(spark, "fusion_timeline")
