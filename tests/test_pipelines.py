"""Ingest, promotion and incremental loads: every row has a fate."""

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import contracts, promote
from quarrystone.plans.outcomes import Refusal
from quarrystone.sources import bronze, lake, sql, triage
from quarrystone.streaming import incremental


@pytest.fixture
def store(spark, tmp_path):
    return lake.Lake(spark, str(tmp_path / "lake"))


YAML = """
target: silver.sales
sources: [bronze.sales]
dedup_key: [invoice_no, line_no]
columns:
  invoice_date: date
  amount: {type: "decimal(18,2)", min: 0}
  region: text
  invoice_no: {type: text, required: true}
  line_no: integer
expectations: ["amount_not_null_rate >= 0.99"]
"""


def sales(spark, rows):
    df = spark.createDataFrame(rows, "invoice_date string, amount string, region string, invoice_no string, line_no string")
    return bronze.with_provenance(df, F.lit(1), "ref", "ing")


def test_promote_splits_conserves_and_upserts(spark, store):
    pipe = contracts.load_yaml(YAML)
    store.write("bronze.sales", sales(spark, [("2024-01-01", "5.005", "N", "a", "1"), ("2024-01-01", "-5", "N", "b", "1"), ("x", "1", "N", "c", "1"), (None, None, None, None, "1")]))
    r = promote.promote(store, pipe)
    assert (r.source_rows, r.passed, r.quarantined, r.unmatched, r.reconciled) == (4, 1, 3, 0, True)
    assert r.counts_by_reason == {"below_min": 1, "type_mismatch": 1, "required_null": 1} and r.expectations == {"amount": False}
    store.write("bronze.sales", sales(spark, [("2024-01-02", "7", "N", "a", "1"), ("2024-01-02", "8", "S", "d", "1")]))
    promote.promote(store, pipe)
    assert sorted((x.invoice_no, str(x.amount)) for x in store.read("silver.sales").collect()) == [("a", "7.00"), ("d", "8.00")]
    assert store.read("quarantine.sales").count() == 3
    assert promote.latest_receipt(store, "silver.sales")["passed"] == 2


def test_join_fanout_is_counted(spark, store):
    store.write("bronze.a", spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, a string"))
    store.write("bronze.b", spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, b string"))
    pipe = contracts.load({"target": "silver.ab", "sources": ["bronze.a", "bronze.b"], "join_on": ["k"], "columns": {"k": "int", "a": "text", "b": "text"}})
    r = promote.promote(store, pipe)
    assert (r.source_rows, r.passed, r.unmatched, r.join_cardinality_change, r.reconciled) == (3, 3, -1, True, False)
    assert r.counts_by_reason == {"join_unmatched": 1}


def test_contract_errors():
    for bad in ({"target": "silver.x", "sources": ["a"], "columns": {"c": "blob"}}, {"target": "bronze.x", "sources": ["a"], "columns": {"c": "int"}}, {"target": "silver.x", "sources": ["a", "b", "c"], "columns": {"c": "int"}}, {"target": "silver.x", "sources": ["a"], "columns": {"c": "int"}, "lineage": False}):
        with pytest.raises(ValueError):
            contracts.load(bad)


def test_gold_needs_signature_and_chain(spark, store):
    t = {"s": spark.createDataFrame([(1,), (2,)], "v int")}
    m = contracts.GoldMetric("total", "SELECT SUM(v) AS total FROM {s}")
    assert promote.run_gold(store, m, "gold.total", t, lambda _: True).reason == "metric_unsigned"
    signed = contracts.sign(m, "sig", "me", "2024-01-01", lambda e: "entry", lambda e: True)
    assert isinstance(promote.run_gold(store, signed, "gold.total", t, lambda _: False), Refusal)
    assert promote.run_gold(store, signed, "gold.total", t, lambda _: True).collect()[0].total == 3
    with pytest.raises(PermissionError):
        contracts.sign(m, "sig", "me", "2024-01-01", lambda e: "entry", lambda e: False)


def test_csv_ingest(spark, store):
    r = bronze.ingest_csv(store, "My Sales.csv", "﻿sku,QTY,qty,when\r\nA,1,2.5,2024-01-02\r\nB,,x,2024-01-03\r\n".encode())
    df = store.read(r.table)
    assert r.row_count == 2 and dict(df.dtypes)["QTY"] == "bigint" and dict(df.dtypes)["qty_2"] == "string" and dict(df.dtypes)["when"] == "date"
    assert [x._src[0].row for x in df.orderBy("sku").collect()] == [1, 2]
    other = bronze.ingest_csv(store, "my-sales.csv", b"a\n1\n")
    assert other.table != r.table
    assert bronze.ingest_csv(store, "e.csv", b" \n").quarantine_reason == "empty_file"
    assert bronze.ingest_csv(store, "e.csv", b"a\0b").quarantine_reason == "not_csv"
    copy = lake.Lake(spark, store.root + "-serving")
    assert lake.identity_check(store, copy).count() == len(store.tables("bronze"))
    assert not lake.sync_bronze(store, copy).skipped and lake.identity_check(store, copy).isEmpty()
    assert store.preview(r.table, 1, 1, ("sku",)).collect()[0].sku == "B"
    with pytest.raises(PermissionError):
        store.preview(r.table, allowed=set())
    assert bronze.ingest_csv(store, "My Sales.csv", b"a\n1\n").table == r.table and store.read(r.table).count() == 1


def test_exact_typing(spark):
    df = spark.createDataFrame([("1", "1.50", "1.5", "2024-01-01T00:00:00+08:00"), ("2", "2", "x", None)], "a string, b string, c string, d string")
    typed, given, left, numeric = bronze.type_columns(df, {"a": "int", "b": "bare", "c": "double"})
    assert given == {"a": "int", "b": "decimal(38,2)"} and left == numeric == ["c"]
    assert bronze.type_columns(df, {"c": "int"})[2] == ["c"] and bronze.source_type("datetimeoffset") is None


def test_sql_source(spark, store):
    rows = {"tables": spark.createDataFrame([("dbo", "t", "BASE TABLE"), ("sys", "x", "BASE TABLE"), ("dbo", "v", "VIEW")], "table_schema string, table_name string, table_type string"),
            "columns": spark.createDataFrame([("dbo", "t", "n", "int", None, None), ("dbo", "t", "m", "money", None, None)], "table_schema string, table_name string, column_name string, data_type string, numeric_precision int, numeric_scale int"),
            "table_constraints": spark.createDataFrame([("PRIMARY KEY", "pk", "dbo", "t", "n", 1, None, None)], "constraint_type string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, parent_table string, parent_column string"),
            "dbo.t": spark.createDataFrame([(i, f"{i}.25") for i in range(9)], "n int, m string")}
    s = sql.SqlSource(spark, sql.Source("sqlserver"), lambda q: next(df for k, df in rows.items() if k in q.split("FROM")[1]))
    assert s.tables() == ["dbo.t"]
    got = s.pull_all(store, max_rows=5)["dbo.t"]
    assert got.truncated and got.row_count == 5
    assert {"n": "int", "m": "decimal(19,4)"}.items() <= dict(store.read(got.table).dtypes).items()
    assert bronze.stamp_watermarks(store, store.read(got.table)).where("source_watermark is null").isEmpty()


GRIDS = {
    "CLEAN": [["sku", "qty", "region"], ["A", "1", "N"], ["B", "2", "S"]],
    "title": [["Sales Report 2024"], ["sku", "qty", "region"], ["A", "1", "N"], ["B", "2", "S"]],
    "MULTI_TABLE": [["sku", "qty"], ["A", "1"], [], ["city", "pop"], ["X", "2"]],
    "UNSTRUCTURED": [["This is a long paragraph of prose that is no table at all."], ["And here is another long paragraph of prose to read."]],
    "HEADERLESS": [["1", "2", "3"], ["4", "5", "6"]],
    "thousands": [["sku", "region", "amount"], ["A", "N", "1,200"], ["B", "S", "3,400.50"]],
    "notes": [["sku", "qty"], ["A", "1"], ["B", "2"], ["C", "3"], ["Source: the finance team, provisional figures"]],
}


@pytest.mark.parametrize("name", GRIDS)
def test_triage(name):
    t = triage.classify(GRIDS[name])
    assert t.label == (name if name.isupper() else "DIRTY")
    assert triage.classify([[], ["", None]]).label == "UNSTRUCTURED"


def test_fates_and_files(spark, store):
    grid = [["Title here"], ["sku", "qty", "city"], ["A", "1", "X"], ["sku", "qty", "city"], ["Total", "1"], ["North"], [], ["sku", "qty", "city"], ["Z", "9", "Q"]]
    assert triage.fates(grid, 1) == ["above_header", "header", "landed", "duplicate_header", "total_row", "section_break", "blank_row", "second_table", "second_table"]
    got = triage.ingest_files(store, {"a.csv": b"sku,qty,city\nA,1,X\nB,2,Y\n", "b.csv": b"Only a note", "c.xlsx": b"no"})
    assert [g.label.split(":")[0] for g in got] == ["CLEAN", "UNSTRUCTURED", "UNREADABLE"] and got[0].rows == 2
    assert store.read("quarantine._row_fates").count() == 3


def source(spark, rows):
    data = {"rows": rows}
    return data, incremental.SourceSpec("orders", lambda: spark.createDataFrame(data["rows"], "order_id int, seq int, amount double"), ("order_id",), "seq")


def test_batch_bound_is_found_without_sorting_to_the_driver(spark, monkeypatch):
    """The k-th watermark of many rows, ties and types, with few rows picked from at once."""
    from pyspark.sql import functions as F

    offsets, frame = [], type(spark.range(0))
    plain = frame.offset
    monkeypatch.setattr(frame, "offset", lambda self, n: offsets.append(n) or plain(self, n))
    monkeypatch.setattr(incremental, "PICK", 50, raising=False)
    df = spark.range(0, 3000, 1, 6).select(F.pmod(F.col("id") * 7919, F.lit(3001)).alias("i"), F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id") % 11).alias("ties"))
    df = df.select("i", "ties", F.timestamp_micros(F.col("i") * 1_000_003).alias("ts"), F.concat(F.lit("k"), "i").alias("s"), (F.col("i") / 7).alias("x"), F.when(F.col("i") > 2990, None).otherwise(F.col("i")).alias("some")).localCheckpoint()
    for c in df.columns:
        want = [r[0] for r in df.select(F.col(c).alias("w")).where("w is not null").orderBy("w").select(F.col("w").cast("string")).collect()]
        spec = incremental.SourceSpec("e", lambda: df, ("i",), c)
        for k in (1, 1500, len(want), len(want) + 1):
            assert incremental.next_high(spec, incremental.Ledger(spark, "/tmp/none"), k) == want[min(k, len(want)) - 1], (c, k)
    assert max(offsets) < 50


def test_incremental_batches_ties_and_late_rows(spark, tmp_path):
    data, spec = source(spark, [(1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 3, 1.0), (5, None, 1.0)])
    ledger = incremental.Ledger(spark, str(tmp_path / "l"))
    assert incremental.ingest_batch(spec, ledger, 2) == 3  # a tie is not split
    assert incremental.run(spec, ledger, 2) == (1, 1)
    data["rows"] += [(6, 2, 9.0), (7, 3, 9.0), (8, 4, 9.0)]
    again = incremental.Ledger(spark, str(tmp_path / "l"))
    assert again.mark("orders") == "3"
    assert incremental.run(spec, again) == (1, 2 + 0)
    assert sorted(r.order_id for r in incremental.visible(again, spec).collect()) == [1, 2, 3, 4, 8]
    reasons = {(r.order_id, r._reason) for r in incremental.quarantined(again, spec).collect()}
    assert reasons == {(5, "null_watermark"), (6, "below_mark"), (7, "below_mark")}
    assert incremental.run(spec, again) == (0, 0)


def test_rejected_batch_is_invisible(spark, tmp_path):
    for rows in ([(1, 1, 1.0), (1, 2, 1.0)], [(None, 1, 1.0)]):
        _, spec = source(spark, rows)
        ledger = incremental.Ledger(spark, str(tmp_path / str(len(rows))))
        with pytest.raises(incremental.BatchRejected):
            incremental.run(spec, ledger)
        assert incremental.visible(ledger, spec).isEmpty()


def test_structured_stream_drains(spark, tmp_path):
    _, spec = source(spark, [(1, 1, 1.0), (2, 2, 1.0)])
    ledger = incremental.Ledger(spark, str(tmp_path / "l"))
    (tmp_path / "ticks").mkdir()
    (tmp_path / "ticks" / "one.json").write_text('{"t": 1}\n')
    ticks = spark.readStream.schema("t int").json(str(tmp_path / "ticks"))
    incremental.stream(spec, ledger, ticks, str(tmp_path / "cp")).awaitTermination(60)
    assert incremental.visible(ledger, spec).count() == 2
