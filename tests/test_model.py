"""The warehouse model, definition checks, access and documents."""

import datetime

from pyspark.sql import functions as F

from quarrystone.plans import access, definitions, governance, warehouse
from quarrystone.plans.model import sales, table
from quarrystone.plans.outcomes import Refusal
from quarrystone.sources import documents


def rows(q):
    return [tuple(r) for r in q.frame.collect()]


def test_warehouse_measures(spark):
    o, missing = warehouse.warehouse(spark, warehouse.sample(spark), datetime.date(2026, 10, 1))
    assert o.verified and len(o.measures) == 11 and list(missing) == ["lane"]
    assert rows(o.compile("outbound_value_myr", [("product", "category")], filters=[("product", "category", "=", "RAW")])) == [("RAW", 870 * 4.5 + 200 * 5.2)]
    assert rows(o.compile("stock_value_myr")) == [(1200 * 4.5 + 80 * 5.2 + 3400 * 2.1 + 900 * 8.75 + 150 * 12 + 60 * 6.4 + 2100 * 3.25,)]
    assert rows(o.compile("utilisation_pct")) == [(65.3,)]
    assert rows(o.compile("below_reorder_lots")) == [(3,)] and rows(o.compile("audit_overdue")) == [(2,)]
    assert rows(o.compile("net_movement_kg", filters=[("transaction", "sku", "=", "SKU-ALPHA")])) == [(-700.0,)]
    assert o.links["txn_of_lot"].cardinality == "many_to_one"
    more = warehouse.sample(spark)
    more["inventory"] = more["inventory"].union(spark.createDataFrame([("RS622XK", "WH-B", 1.0, 1.0, 1.0, "SUP-02", "RAW", None)], warehouse.SCHEMAS["inventory"]))
    other, _ = warehouse.warehouse(spark, more, datetime.date(2026, 10, 1))
    assert other.compile("outbound_kg", [("supplier", "country")]).reason == "fanout_refused"
    assert rows(warehouse.answer("top 2 risk suppliers", o)) == [("Orbit Packing", 0.41), ("Peninsula Polymers", 0.337)]
    assert warehouse.answer("forecast sales", o).reason == "predictive" and warehouse.answer("hello", o).reason == "unknown_measure"
    assert len(warehouse.answer("top 50 sales", o).frame.collect()) <= 20
    assert ("lane", False, missing["lane"]) in warehouse.grains(o, missing)


def test_definitions(spark, small):
    o = sales(spark, small)
    for t in ("orders", "customer", "lineitem", "part"):
        table(spark, small, t).createOrReplaceTempView(t)
    granted = {"orders", "customer", "lineitem", "part", "elsewhere"}

    def check(sql, approved=("sum(orders.o_totalprice)",)):
        return definitions.validate(spark, sql, o, granted, approved)

    good = check("SELECT c_mktsegment, SUM(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
    assert good.grain == "orders" and good.provenance == ("derived:sum(orders.o_totalprice)",)
    assert isinstance(check("SELECT COUNT(*) AS n FROM orders"), definitions.Checked)
    for sql, reason in {
        "SELECT FROM WHERE": "unparseable", "SELECT email FROM orders": "pii_column", "SELECT * FROM orders": "select_star", "SELECT s_name FROM supplier": "table_not_granted",
        "SELECT a FROM elsewhere": "not_in_ontology", "SELECT COUNT(*) AS n FROM orders JOIN customer ON o_orderkey = c_custkey": "undeclared_join",
        "SELECT AVG(o_totalprice) AS v FROM orders": "measure_unjustified", "SELECT SUM(c_acctbal) AS v FROM orders JOIN customer ON o_custkey = c_custkey": "fan_trap",
    }.items():
        got = check(sql)
        assert isinstance(got, Refusal) and got.reason == reason, (sql, got)


def test_access(spark):
    grants = [access.Grant("a", "t1", "k < 3"), access.Grant("b", "t2"), access.Grant("a", "t1", "k = 9")]
    assert access.effective(grants, None) == grants and access.effective(grants, ["b"]) == grants[1:2] and access.effective(grants, ["a"], member=False) == []
    got = access.views({"t1": spark.range(10).withColumnRenamed("id", "k")}, grants)
    assert list(got) == ["t1"] and governance.query(spark, "SELECT COUNT(*) AS n FROM t1", {"t1"}).first().n == 4


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    docs = documents.read_texts(spark, [str(tmp_path)])
    got = documents.chunk_table(docs, "path", size=4).orderBy("chunk_index").collect()
    assert [r.text for r in got] == ["one", "two"] and len(got[0].vector) == 64
    assert documents.chunk_table(docs.withColumn("text", F.lit(None).cast("string")), "path").isEmpty()


def test_context(spark):
    import datetime as dt

    from quarrystone.plans import context

    tables = warehouse.sample(spark)
    found = context.value_index(tables)
    assert found.values["inventory", "category"] == ("CHEMICALS", "PACKAGING", "PARTS", "RAW")
    assert ("transactions", "txn_id") in context.value_index(tables, total_cap=40).unchecked
    hints = context.shortlist("stock of packaging by location", tables, found)
    assert (hints[0].table, hints[0].column, hints[0].values) == ("inventory", "category", ("PACKAGING",)) and len(hints) <= 48
    assert sum(len(x) + 1 for x in context.pack(hints, 20)) <= 80
    columns, day = {"location": ["is_cold_storage"], "supplier": ["last_audit_date"]}, dt.date(2026, 10, 1)
    assert context.typed_filters("cold storage", columns, {}, day) == [("location", "is_cold_storage", "=", True)]
    assert context.typed_filters("not in cold storage", columns, {}, day) == [("location", "is_cold_storage", "=", False)]
    assert context.typed_filters("overdue audits", columns, {}, day) == [("supplier", "last_audit_date", "<", dt.date(2026, 7, 3))]
    assert context.typed_filters("expired lots", columns, {}, day) is None and context.typed_filters("sales", columns, {}, day) == []
    assert set(context.samples(spark.range(1000).selectExpr("cast(id as string) as c"), ["c"])["c"]) <= {str(i) for i in range(1000)}


def test_sheets():
    import zipfile
    from io import BytesIO

    from quarrystone.sources import sheets

    data = sheets.xlsx([{"a": "=1+1", "b": 2.5}, {"a": "x<y", "b": None}])
    sheet = zipfile.ZipFile(BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert "'=1+1" in sheet and "x&lt;y" in sheet and "<v>2.5</v>" in sheet


def test_sheet_questions(spark):
    from quarrystone.sources import sheets

    df = spark.createDataFrame([(" A ", "1.5"), ("A", "2"), ("B", "x"), ("B", "3"), ("", "9"), (None, "9")], "category string, v string")
    assert [tuple(r) for r in sheets.top_groups(df, "category", "v", 1).collect()] == [("A", 3.5)]
    assert tuple(sheets.total_where(df, "v", "category", "B").first()) == (3.0, 2)


def test_registry(spark):
    from quarrystone.plans import registry

    spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double").createOrReplaceTempView("facts")
    r = registry.Registry(spark)
    total = registry.Verified("Total of all values?", "SELECT SUM(v) AS total FROM facts")
    assert r.register(total, {"facts"}) == total and r.register(registry.Verified("x", "DROP TABLE facts"), {"facts"}).reason == "statement_not_allowed"
    r.scored.add(registry.content_hash("scored", "SELECT 1 AS a"))
    assert r.register(registry.Verified("Scored!", "select  1 as A"), set()).reason == "scored_row"
    r.register(registry.Verified("Rows by key", "SELECT k, COUNT(*) AS n FROM facts GROUP BY k", "s1"), {"facts"})
    assert r.ask("total of all VALUES", "s1", {"facts"}).first().total == 5.0
    assert r.ask("rows by key", "s2", {"facts"}).reason == "no_verified_query" and r.ask("total of all values", "s1", set()).reason == "table_not_granted"
    assert [v.question for v in r.examples("rows per key", "s1")] == ["Rows by key"] and r.examples("rows", "s2") == []
    rows = spark.createDataFrame([("a", "SELECT 1"), ("b", "SELECT 2")], "question string, sql string")
    assert [x.question for x in registry.without_scored(rows, rows.where("question = 'a'")).collect()] == ["b"]
    assert registry.scrub("no column secret.pay in Facts", ["secret", "pay", "facts"], ["facts"]) == "no column [hidden].[hidden] in Facts"
    token = registry.mint({"tenant": "t"}, b"k")
    assert registry.opened(token, b"k") == {"tenant": "t"} and registry.opened(token, b"z").reason == "bad_signature"
    assert registry.within(spark, 60, lambda: spark.range(5).count()) == 5


def test_derived_ontology(spark):
    from quarrystone.plans import registry

    frames = {"p": spark.createDataFrame([(1,)], "id int"), "c": spark.createDataFrame([(1, 1)], "id int, pid int")}
    manifest = {"tables": [{"name": "p", "primary_key": ["id"]}, {"name": "c", "primary_key": ["id"]}], "foreign_keys": [{"name": "f", "child": "c", "child_column": "pid", "parent": "p", "parent_column": "id"}]}
    _, violations, item = registry.derive(spark, manifest, lambda t: frames[t["name"]])
    assert violations == [] and item["status"] == "active" and item["links"] == {"f": ["many_to_one", 1]}
    assert registry.derive(spark, manifest, lambda t: frames[t["name"]], item)[2]["status"] == "reused"
    frames["c"] = spark.createDataFrame([(1, 9, 0)], "id int, pid int, more int")
    assert registry.derive(spark, manifest, lambda t: frames[t["name"]], item)[2]["status"] == "proposed"
