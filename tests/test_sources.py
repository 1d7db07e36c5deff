import datetime as dt

import pytest
from pyspark.sql import functions as F

from paisaflow.operators.numbering import rank_in_groups
from paisaflow.plans.upload import run_gateway, run_upload
from paisaflow.schemas import TABLES
from paisaflow.sources import csv_rows, gateway, narration, normalize, tables
from tests.helpers import at


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


LEDGER = """Row ID,Order ID, amount ,Timestamp,Payment_Method,fee_amount,status
,order_1,1000.0,2025-06-01T10:00:00,card,20,
L2,order_2,,2025-06-01 10:00:00,upi,x,settled
L3,,n/a,01/06/2025,,,settled
L4,order_4,5,someday,,,
L5,order_5,5,,,,
L6,order_6,nan,2025-06-01,,,
,order_7,12.5,01/06/2025 11:30:00,,1e1,ok
"""


def test_ledger_csv(spark, tmp_path):
    parsed = csv_rows.read_ledger_csv(spark, write(tmp_path, "l.csv", LEDGER))
    got = {r.source_id: r for r in parsed.rows.collect()}
    assert set(got) == {"LEDG00001", "L3", "LEDG00007"}
    first = got["LEDG00001"]
    assert (first.amount, first.fee, first.status, first.method) == (1000.0, 20.0, "unknown", "card")
    assert got["L3"].order_id is None and got["L3"].amount == 0.0
    assert got["L3"].created_at == dt.datetime(2025, 6, 1)
    assert got["LEDG00007"].fee == 10.0
    errors = {r.row_num: r.error for r in parsed.rejects.collect()}
    assert errors[2] == "Row 2: missing required column 'amount'."
    assert errors[4] == "Row 4: unrecognized timestamp format 'someday'."
    assert errors[5] == "Row 5: missing required column 'timestamp'."
    assert set(errors) == {2, 4, 5, 6}
    with pytest.raises(csv_rows.CsvFormatError, match="Row 2"):
        csv_rows.strict(parsed)


def test_bank_csv_and_empty(spark, tmp_path):
    text = "order_id,amount,timestamp,utr_reference\norder_1,,2025-06-01T10:00:00+05:30, \n"
    row = csv_rows.strict(csv_rows.read_bank_csv(spark, write(tmp_path, "b.csv", text))).first()
    assert (row.source_id, row.amount, row.utr_reference) == ("BANK00001", 0.0, None)
    assert row.created_at == dt.datetime(2025, 6, 1, 10) == row.settled_at
    with pytest.raises(csv_rows.CsvFormatError):
        csv_rows.read_bank_csv(spark, write(tmp_path, "e.csv", ""))


def test_row_numbers_over_splits(spark, tmp_path):
    lines = "".join(f"{i},{'x' * (i % 37)}\n" for i in range(1, 5001))
    path = write(tmp_path, "n.csv", "row_id,pad\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = csv_rows.read_csv_text(spark, path)
        assert df.rdd.getNumPartitions() > 1
        assert df.filter(F.col("row_id").cast("long") != F.col("row_num")).isEmpty()
        assert df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ranks(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as g", "(id * 7919) % 500 as o").repartition(9)
    ranked = rank_in_groups(df, ["g"], ["o"]).toPandas()
    for _, part in ranked.groupby("g"):
        assert list(part.sort_values("o")["rank"]) == list(range(len(part)))
    whole = rank_in_groups(df, [], ["o"])
    assert whole.filter("rank <> o").isEmpty()


def test_store(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    store.init()
    assert store.load("ledger_rows").isEmpty()
    row = ("T1", "exempt", "rule", "r")
    one = spark.createDataFrame([row], TABLES["tax_classifications"])
    store.replace("tax_classifications", one)
    store.replace("tax_classifications", one)
    assert store.load("tax_classifications").count() == 1
    metrics = lambda label, mae: spark.createDataFrame(
        [(label, "t", 1, 1, mae, 2.0, "linear", False)], TABLES["forecaster_metrics"]
    )
    store.replace_key("forecaster_metrics", metrics("a", 1.0), "label")
    store.replace_key("forecaster_metrics", metrics("b", 2.0), "label")
    store.replace_key("forecaster_metrics", metrics("a", 3.0), "label")
    got = {r.label: r.mae for r in store.load("forecaster_metrics").collect()}
    assert got == {"a": 3.0, "b": 2.0}
    found = store.lookup("tax_classifications", "txn_id", "T1")
    assert found.count() == 1 and store.lookup("tax_classifications", "txn_id", "T2").isEmpty()
    assert "PushedFilters: [IsNotNull(txn_id), EqualTo(txn_id,T1)]" in (
        found._jdf.queryExecution().executedPlan().toString()
    )


def test_base_export_and_index_reset(spark, sf_dir, tmp_path):
    import registry

    base = registry.workspace(spark, sf_dir).base
    tables.export_base_csv(base, str(tmp_path / "csv"))
    again = tables.read_base_csv(spark, str(tmp_path / "csv"))
    assert again.columns == base.columns
    assert again.exceptAll(base).isEmpty() and base.exceptAll(again).isEmpty()
    store = tables.Store(spark, str(tmp_path / "store"))
    store.init()
    store.append("record_embeddings", spark.createDataFrame(
        [("T1", "x", [0.5])], TABLES["record_embeddings"]
    ))
    store.refresh_base(base)
    assert store.load("record_embeddings").isEmpty()
    assert store.load("base_transactions").count() == base.count()


def test_json_rows(spark, tmp_path):
    path = write(tmp_path, "l.json", '[{"row_id": "L1", "order_id": "o", "amount": 5,'
                 ' "timestamp": "2025-06-01T10:00:00"}, {"row_id": "L2", "amount": 1.5}]')
    df = tables.strict(tables.read_json_rows(spark, path, "ledger_rows"))
    got = normalize.ledger_to_txn(df).orderBy("source_id").collect()
    assert [r.source_id for r in got] == ["L1", "L2"]
    assert got[0].currency == "INR" and got[0].settled_at is None and got[0].tax_on_fee is None
    tables.write_json_rows(df, str(tmp_path / "out"))
    lines = tables.read_json_rows(spark, str(tmp_path / "out"), "ledger_rows", array_file=False).rows
    assert lines.count() == 2


def test_gateway(spark):
    orders = spark.createDataFrame([("o1", 1), ("o2", 1)], gateway.ORDERS)
    payments = spark.createDataFrame([
        ("p1", "o1", 12345, None, "card", "captured", 200, 36, 500, "s1", 1700000000, "d"),
        ("p2", "o1", 100, "INR", None, None, None, None, None, None, 1700000001, None),
        ("p3", "o2", 100, "INR", "upi", "captured", 1, 0, 0, "s9", None, None),
        ("p4", "o9", 100, "INR", "upi", "captured", 1, 0, 0, "s1", 1700000002, None),
    ], gateway.PAYMENTS)
    settlements = spark.createDataFrame([("s1", 1700090000)], gateway.SETTLEMENTS)
    txns = gateway.gateway_txns(orders, payments, settlements)
    got = {r.source_id: r for r in txns.collect()}
    assert set(got) == {"p1", "p2", "p3"}
    assert (got["p1"].amount, got["p1"].fee, got["p1"].currency) == (123.45, 2.0, "INR")
    assert got["p1"].created_at == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert got["p1"].settled_at is not None and got["p3"].settled_at is None
    assert got["p2"].fee is None and got["p2"].status == "unknown"
    assert gateway.calibration_rows(txns).count() == 2
    done = run_gateway(txns, prefix="G_")
    r = {x.txn_id: x for x in done.records.collect()}
    assert r["G_p1"].had_refund and r["G_p2"].fee_amount_pending
    assert done.summary.first().transactions_fetched == 2


def test_narration(spark):
    rows = spark.createDataFrame(
        [("L1", "o1", 5.0, None), ("L2", "o2", 7.25, None)],
        "row_id string, order_id string, amount double, narration string",
    )
    given = spark.createDataFrame([("L1", "text")], "row_id string, narration string")
    got = {r.row_id: r.narration for r in narration.with_narration(rows, given).collect()}
    assert got == {"L1": "text", "L2": "Settlement - Order o2 - INR 7.25"}


def test_upload(spark, tmp_path):
    ledger = csv_rows.read_ledger_csv(spark, write(tmp_path, "l.csv", (
        "order_id,amount,timestamp,payment_method,fee_amount,tax_on_fee,refund_amount\n"
        "order_1,1000,2025-06-01T10:00:00,card,20,3.6,0\n"
        "order_2,500,2025-06-07T10:00:00,upi,0,0,100\n"
    ))).rows
    bank = csv_rows.read_bank_csv(spark, write(tmp_path, "b.csv", (
        "order_id,amount,timestamp\norder_1,976.4,2025-06-01T12:00:00\n"
    ))).rows
    done = run_upload(ledger, bank, prefix="S_")
    s = done.summary.first()
    assert (s.total_ledger_rows, s.matched, s.exact, s.exception_count) == (2, 1, 1, 1)
    assert (str(s.start_date), str(s.end_date), s.matched_share) == (
        "2025-06-01", "2025-06-07", 0.5
    )
    got = {r.txn_id: (r.reconciliation_status, r.had_refund) for r in done.records.collect()}
    assert got == {"S_LEDG00001": ("matched", False), "S_LEDG00002": ("exception", True)}
    kinds = {r.txn_id: r.category for r in done.classifications.collect()}
    assert kinds == {"S_LEDG00001": "gst_on_fee", "S_LEDG00002": "refund_credit_note"}


def test_quoted_csv_equals_the_csv_module(spark, tmp_path):
    """Commas, doubled quotes, backslashes and line breaks in quoted fields."""
    import csv
    import io
    import random

    rng = random.Random(4)
    piece = lambda: rng.choice(['a', ',', '"', '\\', '\n', ' x ', 'gold', '""', '\\"', '1'])
    rows = [[f"L{i}", "5", "2025-06-01", "".join(piece() for _ in range(rng.randrange(1, 7)))] for i in range(80)]
    for breaks in (False, True):
        own = [r[:3] + [r[3] if breaks else r[3].replace("\n", " ")] for r in rows]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["row_id", "amount", "timestamp", "payment_method"], *own])
        path = write(tmp_path, f"q{breaks}.csv", out.getvalue())
        got = csv_rows.read_csv_text(spark, path, multi_line=breaks).orderBy("row_num").collect()
        assert [[r.row_id, r.amount, r.timestamp, r.payment_method] for r in got] == own
        assert [r.row_num for r in got] == list(range(1, 81))
    with pytest.raises(csv_rows.CsvFormatError, match="multi_line"):
        csv_rows.read_csv_text(spark, path)


def test_rows_of_other_lengths_are_rejects(spark, tmp_path):
    text = "row_id,amount,timestamp\nL1,5,2025-06-01\nL2,5,2025-06-01,more\nL3,5\n"
    parsed = csv_rows.read_ledger_csv(spark, write(tmp_path, "f.csv", text))
    assert [r.source_id for r in parsed.rows.collect()] == ["L1"]
    assert {r.row_num for r in parsed.rejects.collect()} == {2, 3}


def test_bad_json_is_told_apart(spark, tmp_path):
    good, bad = '{"row_id":"L1","amount":5.0}', ['{"row_id":"L2","amount":oops}', '{"row_id":"L3","amount":"x"}']
    path = write(tmp_path, "r.json", "\n".join([good, *bad]))
    read = tables.read_json_rows(spark, path, "ledger_rows", array_file=False)
    assert [(r.row_id, r.amount) for r in read.rows.collect()] == [("L1", 5.0)]
    assert sorted(r.raw for r in read.rejects.collect()) == bad
    with pytest.raises(ValueError):
        tables.strict(read)


def test_refresh_from_itself_and_after_a_failure(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    store.init()
    assert store.load("forecaster_metrics").isEmpty()
    rows = spark.createDataFrame([("T1", "exempt", "rule", "r"), ("T2", "exempt", "rule", "r")], TABLES["tax_classifications"])
    store.replace("tax_classifications", rows)
    store.replace("tax_classifications", store.load("tax_classifications").filter("txn_id = 'T1'"))
    assert [r.txn_id for r in store.load("tax_classifications").collect()] == ["T1"]
    broken = rows.withColumn("reasoning", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        store.replace("tax_classifications", broken)
    assert store.load("tax_classifications").count() == 1
