"""Registered queries that return (case, outcome): each case is decided by an operator, the SQL beside it states what is right."""

from __future__ import annotations

import datetime
import io
import re
import uuid
import zipfile

from pyspark.sql import functions as F

from ..functions import binding, pii, retrieval, scalar
from ..operators import contracts, promote
from ..sources import bronze, lake, sheets, sql, triage
from ..streaming import incremental
from . import access, catalog, context, definitions, envelope, governance, questions, registry, verdict, warehouse
from .model import sales, table
from .ontology import Ontology
from .outcomes import Refusal
from .queries import _views, query
from .tree import analyzed


def _outcomes(spark, found: list[tuple[str, object]]):
    return spark.createDataFrame([(k, str(v)) for k, v in found], "case string, outcome string")


def values(**expected) -> str:
    """SQL of the expected outcomes."""
    rows = ", ".join("('{}', '{}')".format(k, str(v).replace("'", "''")) for k, v in expected.items())
    return f'SELECT * FROM (VALUES {rows}) t("case", outcome)'


def _why(refusal) -> str:
    return getattr(refusal, "reason", "pass")


# -- governance ----------------------------------------------------------------------------------------------------
_PAIR = "orders JOIN customer ON o_custkey = c_custkey"
FAN = {
    "flat_sum": f"SELECT SUM(c_acctbal) AS v FROM {_PAIR}",
    "derived_sum": f"SELECT SUM(x) AS v FROM (SELECT c_acctbal + 0 AS x FROM {_PAIR})",
    "cte_sum": f"WITH t AS (SELECT c_acctbal + 0 AS x FROM {_PAIR}) SELECT SUM(x) AS v FROM t",
    "window_sum": f"SELECT o_orderkey, SUM(c_acctbal) OVER (PARTITION BY c_mktsegment) AS v FROM {_PAIR}",
    "window_lag": f"SELECT o_orderkey, LAG(c_acctbal) OVER (ORDER BY o_orderkey) AS v FROM {_PAIR}",
    "collected": f"SELECT collect_set(c_acctbal) AS v FROM {_PAIR}",
    "cast_inside": f"SELECT SUM(CAST(c_acctbal AS INT)) AS v FROM {_PAIR}",
    "count_name": f"SELECT COUNT(DISTINCT c_name) AS n FROM {_PAIR}",
    "count_key": f"SELECT COUNT(DISTINCT c_custkey) AS n FROM {_PAIR}",
    "least": f"SELECT MIN(c_acctbal) AS v FROM {_PAIR}",
    "condition": f"SELECT SUM(CASE WHEN c_acctbal > 0 THEN o_totalprice END) AS v FROM {_PAIR}",
    "grouped": f"SELECT c_mktsegment, SUM(o_totalprice) AS v FROM {_PAIR} GROUP BY c_mktsegment HAVING SUM(o_totalprice) > 1 ORDER BY MAX(c_acctbal)",
    "parents_only": f"SELECT c_name FROM {_PAIR}",
    "both": f"SELECT o_orderkey, c_name FROM {_PAIR}",
    "distinct_parents": f"SELECT DISTINCT c_name FROM {_PAIR}",
    "left_to_child": "SELECT SUM(o_totalprice) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    "left_to_parent": "SELECT SUM(o_totalprice) AS v FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "null_safe": "SELECT SUM(o_totalprice) AS v FROM orders JOIN customer ON o_custkey <=> c_custkey",
    "extra_comparison": f"SELECT SUM(o_totalprice) AS v FROM {_PAIR} AND o_totalprice > c_acctbal",
    "where_join": "SELECT SUM(o_totalprice) AS v FROM orders, customer WHERE o_custkey = c_custkey",
    "cross": "SELECT COUNT(*) AS n FROM orders CROSS JOIN customer",
    "union": "SELECT c_acctbal AS x FROM customer UNION ALL SELECT o_totalprice FROM orders",
    "three": f"SELECT n_name, SUM(o_totalprice) AS v FROM {_PAIR} JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "one_table": "SELECT SUM(x) AS v FROM (SELECT c_acctbal AS x FROM customer)",
}


@query(
    values(
        flat_sum="fan_trap", derived_sum="unverified_join", cte_sum="unverified_join", window_sum="fan_trap", window_lag="fan_trap", collected="fan_trap", cast_inside="fan_trap",
        count_name="fan_trap", count_key="pass", least="pass", condition="pass", grouped="pass", parents_only="parent_rows_repeat", both="pass", distinct_parents="pass",
        left_to_child="unverified_join", left_to_parent="pass", null_safe="unverified_join", extra_comparison="unverified_join", where_join="pass", cross="unverified_join",
        union="unverified_join", three="pass", one_table="pass",
    )
)
def governance_fan_trap(spark, d):
    _views(spark, d, "orders", "customer", "nation")
    o = sales(spark, d)
    return _outcomes(spark, [(k, _why(governance.unverified_join(spark.sql(s), o))) for k, s in FAN.items()])


_MONEY = {("orders", "o_totalprice"): "MYR", ("customer", "c_acctbal"): "USD", ("lineitem", "l_extendedprice"): "MYR", ("lineitem", "l_discount"): None, ("lineitem", "l_quantity"): None}


@query(values(one="pass", two="currency_mismatch", unknown="currency_mismatch", no_money="pass", rate="pass", rows="pass", asked="pass", asked_other="currency_mismatch", asked_two="currency_mismatch", asked_none="pass", asked_unknown="currency_mismatch", asked_count="currency_mismatch", by_sign="GBP", by_lower="CNY", inside_a_name="-"))
def governance_currency(spark, d):
    _views(spark, d, "orders", "customer", "lineitem")
    sql = {
        "one": "SELECT SUM(o_totalprice) AS v FROM orders", "two": f"SELECT SUM(o_totalprice + c_acctbal) AS v FROM {_PAIR}", "unknown": "SELECT SUM(l_extendedprice * l_tax) AS v FROM lineitem",
        "no_money": "SELECT SUM(l_quantity) AS v FROM lineitem", "rate": "SELECT SUM(l_extendedprice * (1 - l_discount)) AS v FROM lineitem", "rows": "SELECT COUNT(*) AS n FROM orders",
    }
    found = [(k, _why(governance.currency_mismatch(spark.sql(s), _MONEY))) for k, s in sql.items()]
    asked = {"asked": ("revenue in ringgit", "one"), "asked_other": ("revenue in USD", "one"), "asked_two": ("USD or EUR?", "one"), "asked_none": ("revenue", "two"), "asked_unknown": ("tax in MYR", "unknown"), "asked_count": ("orders in MYR", "rows")}
    named = {"by_sign": "total in £?", "by_lower": "total in cnh", "inside_a_name": "sum of revenue_usd"}
    found += [(k, " ".join(sorted(governance.asked_currencies(q))) or "-") for k, q in named.items()]
    return _outcomes(spark, found + [(k, _why(governance.question_currency(q, spark.sql(sql[s]), _MONEY))) for k, (q, s) in asked.items()])


GENERATORS = {
    "lateral_view": "SELECT * FROM orders LATERAL VIEW explode(sequence(1, 1000000000)) t AS x", "projected": "SELECT explode(array(1, 2)) AS x FROM orders", "lateral": "SELECT 1 AS a FROM orders, LATERAL explode(sequence(1, 3))",
    "array": "SELECT size(sequence(1, 1000000000)) AS n FROM orders", "text": "SELECT repeat('x', 1000000000) AS x FROM orders", "table_function": "SELECT * FROM range(5)", "stacked": "SELECT stack(2, 1, 2) AS x FROM orders",
    "in_subquery": "SELECT 1 AS a FROM orders WHERE o_orderkey IN (SELECT explode(sequence(1, 9)))", "in_cte": "WITH t AS (SELECT explode(sequence(1, 9)) AS x) SELECT * FROM t", "stored_array": "SELECT explode(items) AS x FROM orders", "stored_lateral": "SELECT * FROM orders LATERAL VIEW posexplode(items) t AS i, x",
}


@query(values(**{k: "pass" if k.startswith("stored") else "path_not_allowed" for k in GENERATORS}))
def governance_generators(spark, d):
    return _outcomes(spark, [(k, _why(governance.gate(spark, s, {"orders"}))) for k, s in GENERATORS.items()])


STATED = {
    "kept": ("revenue of building clients", "SELECT SUM(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "dropped": ("revenue of building clients", "SELECT SUM(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey"),
    "other_value": ("revenue of building clients", "SELECT SUM(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'"),
    "two_kept": ("building and machinery clients", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "one_of_two": ("building and machinery clients", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "by_function": ("building clients", "SELECT COUNT(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "by_or": ("building clients", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 0"),
    "excluded": ("clients except building", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "excluded_kept": ("clients except building", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "in_having": ("building clients", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment HAVING c_mktsegment = 'BUILDING'"),
    "in_left_on": ("building clients", "SELECT COUNT(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'"),
    "other_table": ("balance in nation 3", "SELECT SUM(c_acctbal) AS v FROM customer"),
    "by_link": ("balance in nation 3", "SELECT SUM(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'"),
    "no_value": ("revenue by day", "SELECT SUM(o_totalprice) AS v FROM orders"),
    "nothing_read": ("building", "SELECT 1 AS a"),
}


@query(
    values(
        kept="pass", dropped="unhonored_qualifier", other_value="unhonored_qualifier", two_kept="pass", one_of_two="unhonored_qualifier", by_function="pass", by_or="unhonored_qualifier", excluded="pass",
        excluded_kept="unhonored_qualifier", in_having="pass", in_left_on="unhonored_qualifier", other_table="unhonored_qualifier", by_link="pass", no_value="pass", nothing_read="unhonored_qualifier",
    )
)
def governance_stated_values(spark, d):
    _views(spark, d, "orders", "customer", "nation")
    tables = {t: table(spark, d, t).select(*c) for t, c in (("customer", ("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")), ("nation", ("n_nationkey", "n_name")), ("orders", ("o_orderkey", "o_orderstatus", "o_custkey")))}
    return _outcomes(spark, [(k, _why(verdict.dropped_stated_value(q, spark.sql(s), tables))) for k, (q, s) in STATED.items()])


@query(values(where_1="(c_acctbal > 0.0D)", where_2="(c_mktsegment = 'BUILDING')", having="(sum(c_acctbal) > 1.0D)", filter="(c_nationkey > 3)", none="0"))
def governance_filter_reasons(spark, d):
    _views(spark, d, "customer")
    found = verdict.filter_reasons(analyzed(spark.sql("SELECT c_nationkey, SUM(c_acctbal) FILTER (WHERE c_nationkey > 3) AS a, SUM(c_acctbal) AS v FROM customer WHERE c_acctbal > 0D AND c_mktsegment = 'BUILDING' GROUP BY c_nationkey HAVING v > 1D")))
    named = {"where": iter(("where_1", "where_2")), "having": iter(("having",)), "filter": iter(("filter",))}
    out = [(next(named[k]), re.sub(r"#\d+|CAST\((\d+) AS \w+\)", r"\1", t).replace("v >", "sum(c_acctbal) >")) for k, t in found if "IS NOT NULL" not in t]
    return _outcomes(spark, [*out, ("none", len(verdict.filter_reasons(analyzed(spark.sql("SELECT c_name FROM customer")))))])


@query("SELECT 'join' AS kind, 'customer.c_custkey' AS a, 'orders.o_custkey' AS b UNION ALL SELECT 'union', 'customer.c_acctbal', 'orders.o_totalprice' UNION ALL SELECT 'union', 'customer.c_custkey', 'orders.o_custkey'")
def governance_pairs(spark, d):
    _views(spark, d, "orders", "customer")
    joined = governance.join_pairs(spark.sql("SELECT 1 AS a FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey > 3"))
    united = governance.union_pairs(spark.sql("SELECT o_custkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, c_acctbal AS w FROM customer"))
    rows = [(kind, *sorted(".".join(x) for x in p)) for kind, pairs in (("join", joined), ("union", united)) for p in pairs]
    return spark.createDataFrame(rows, "kind string, a string, b string")


@query("SELECT o_orderkey, c_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5000")
def governance_drill_through(spark, d):
    _views(spark, d, "orders", "customer")
    rows, _ = governance.drill_through(spark.sql("SELECT c_nationkey, SUM(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey"))
    return rows.select("o_orderkey", "c_custkey", "o_totalprice")


@query(values(parsed="3 conjuncts", measure="sum(o_totalprice)", group="o_orderstatus", limit="5", offset="2", open="False", or_is_open="True", dropped="1", tables="customer orders", unknown_table="table_not_granted", unknown_column="sql_error", typed_text="untyped_numeric", typed_number="pass"))
def governance_grounds(spark, d):
    _views(spark, d, "orders", "customer")
    full = governance.parsed(spark, "SELECT o_orderstatus, SUM(o_totalprice) AS v FROM orders WHERE o_orderkey > 1 AND o_custkey > 2 AND o_totalprice > 3 GROUP BY o_orderstatus ORDER BY v LIMIT 5 OFFSET 2")
    less = governance.parsed(spark, "SELECT o_orderstatus, SUM(o_totalprice) AS v FROM orders WHERE o_orderkey > 1 AND o_custkey > 2 GROUP BY o_orderstatus")
    g = governance.grounds(full)
    untyped = {"orders": {"o_totalprice"}}
    return _outcomes(
        spark,
        [
            ("parsed", f"{len(g.conjuncts)} conjuncts"), ("measure", re.sub(r" AS .*", "", re.sub(r"[`']", "", g.measures[0]), flags=re.I)), ("group", g.groups[0]), ("limit", g.limit), ("offset", g.offset), ("open", g.open_),
            ("or_is_open", governance.grounds(governance.parsed(spark, "SELECT 1 AS a FROM orders WHERE o_orderkey = 1 OR o_custkey = 2")).open_), ("dropped", len(governance.dropped_conjuncts(full, less))),
            ("tables", " ".join(sorted(governance.tables_read(spark.sql("SELECT COUNT(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"))))),
            ("unknown_table", _why(governance.query(spark, "SELECT a FROM nowhere", {"orders"}))), ("unknown_column", _why(governance.query(spark, "SELECT nope FROM orders", {"orders"}))),
            ("typed_text", _why(governance.untyped_numeric(spark.sql("SELECT SUM(CAST(o_totalprice AS DOUBLE)) AS v FROM orders"), untyped))), ("typed_number", _why(governance.untyped_numeric(spark.sql("SELECT SUM(o_custkey) AS v FROM orders"), untyped))),
        ],
    )


@query(values(sum="derived:sum(orders.o_totalprice)", grain="orders", count="pass", broken="unparseable", personal="pii_column", star="select_star", not_granted="table_not_granted", unknown="not_in_ontology", off_link="undeclared_join", unjustified="measure_unjustified", fan="fan_trap", window="measure_unjustified", nested="undeclared_join"))
def definitions_checked(spark, d):
    _views(spark, d, "orders", "customer")
    o, granted = sales(spark, d), {"orders", "customer", "elsewhere"}
    sql = {
        "count": "SELECT COUNT(*) AS n FROM orders", "broken": "SELECT FROM WHERE", "personal": "SELECT email FROM orders", "star": "SELECT * FROM orders", "not_granted": "SELECT s_name FROM supplier", "unknown": "SELECT a FROM elsewhere",
        "off_link": "SELECT COUNT(*) AS n FROM orders JOIN customer ON o_orderkey = c_custkey", "unjustified": "SELECT AVG(o_totalprice) AS v FROM orders", "fan": f"SELECT SUM(c_acctbal) AS v FROM {_PAIR}",
        "window": "SELECT SUM(o_totalprice) OVER () AS v FROM orders", "nested": f"SELECT MAX(v) AS w FROM (SELECT c_mktsegment, SUM(o_totalprice) AS v FROM {_PAIR} GROUP BY c_mktsegment)",
    }

    def checked(s):
        return definitions.validate(spark, s, o, granted, ("sum(orders.o_totalprice)",))

    good = checked(f"SELECT c_mktsegment, SUM(o_totalprice) AS v FROM {_PAIR} GROUP BY c_mktsegment")
    return _outcomes(spark, [("sum", good.provenance[0]), ("grain", good.grain), *((k, _why(checked(s))) for k, s in sql.items())])


# -- statements that pass through ----------------------------------------------------------------------------------
def passes(name: str, sql: str, *tables: str, duck: str | None = None) -> None:
    """Register a statement that goes through the gate to Spark, beside the same statement in DuckDB."""

    def run(spark, d):
        _views(spark, d, *tables)
        out = governance.query(spark, sql, set(tables))
        if isinstance(out, Refusal):
            raise ValueError(f"refused: {out.reason} {out.detail}")
        return out

    run.__name__ = name
    query(duck or sql)(run)


passes("pass_cube", "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)", "customer")
passes("pass_rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, GROUPING(o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "orders")
passes("pass_grouping_sets", "SELECT o_orderstatus, o_orderpriority, MAX(o_totalprice) AS v FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
passes("pass_median", "SELECT o_orderstatus, median(o_totalprice) AS m, percentile(o_totalprice, 0.25) AS q FROM orders GROUP BY o_orderstatus", "orders", duck="SELECT o_orderstatus, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.25) AS q FROM orders GROUP BY o_orderstatus")
passes("pass_any_value", "SELECT n_nationkey, ANY_VALUE(n_name) AS name FROM nation GROUP BY n_nationkey", "nation")
passes("pass_avg", "SELECT l_returnflag, ROUND(AVG(CAST(l_quantity AS DECIMAL(18,2))), 3) AS a FROM lineitem GROUP BY l_returnflag", "lineitem")
passes("pass_lag_lead", "SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, LEAD(o_totalprice, 2, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders", "orders")
passes("pass_frames", "SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS tile, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM orders", "orders")
passes("pass_range_join", "SELECT p_partkey, COUNT(*) AS n FROM part JOIN nation ON p_size BETWEEN n_nationkey AND n_nationkey + 3 GROUP BY p_partkey", "part", "nation")
passes("pass_full_outer", "SELECT s_suppkey, n_nationkey FROM supplier FULL OUTER JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0", "supplier", "nation")
passes("pass_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation")
passes("pass_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "customer", "supplier")
passes("pass_null_order", "SELECT x, ROW_NUMBER() OVER (ORDER BY x DESC NULLS LAST) AS r, ROW_NUMBER() OVER (ORDER BY x ASC NULLS FIRST) AS f FROM (SELECT NULLIF(n_nationkey, 3) AS x FROM nation) t", "nation")
passes("pass_pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "orders", duck="SELECT o_orderpriority, NULLIF(COUNT(*) FILTER (o_orderstatus = 'F'), 0) AS f, NULLIF(COUNT(*) FILTER (o_orderstatus = 'O'), 0) AS o, NULLIF(COUNT(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1")
passes("pass_lateral", "SELECT c_custkey, t.v FROM customer, LATERAL (SELECT c_acctbal * 2 AS v) t", "customer")
passes("pass_correlated", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer", "customer", "orders")
passes("pass_arrays", "SELECT n_nationkey, size(split(n_name, '_')) AS parts, split(n_name, '_')[1] AS number FROM nation", "nation", duck="SELECT n_nationkey, CAST(len(string_split(n_name, '_')) AS INT) AS parts, string_split(n_name, '_')[2] AS number FROM nation")


# -- ingest and triage ---------------------------------------------------------------------------------------------
def _lake(spark) -> lake.Lake:
    return lake.Lake(spark, f"{lake.shared_folder(spark)}/cases-{uuid.uuid4().hex}")


GRIDS = {
    "clean": [["sku", "qty", "region"], ["A", "1", "N"], ["B", "2", "S"]],
    "title": [["Sales Report 2024"], ["sku", "qty", "region"], ["A", "1", "N"], ["B", "2", "S"]],
    "two_tables": [["sku", "qty"], ["A", "1"], [], ["city", "pop"], ["X", "2"]],
    "prose": [["This is a long paragraph of prose that is no table at all."], ["And here is another long paragraph of prose to read."]],
    "no_header": [["1", "2", "3"], ["4", "5", "6"]],
    "thousands": [["sku", "region", "amount"], ["A", "N", "1,200"], ["B", "S", "3,400.50"]],
    "notes": [["sku", "qty"], ["A", "1"], ["B", "2"], ["C", "3"], ["Source: the finance team, provisional figures"]],
    "mixed": [["sku", "qty"], ["A", "1"], ["B", "x"], ["C", "3"], ["D", "y"]],
    "blank": [[], ["", None]],
}


@query(values(clean="CLEAN", title="DIRTY title_above_header", two_tables="MULTI_TABLE 2 tables", prose="UNSTRUCTURED prose", no_header="HEADERLESS no header row", thousands="DIRTY thousands_text", notes="DIRTY trailing_notes", mixed="DIRTY inconsistent_types", blank="UNSTRUCTURED blank"))
def triage_labels(spark, d):
    return _outcomes(spark, [(k, " ".join([(t := triage.classify(g)).label, *t.reasons])) for k, g in GRIDS.items()])


@query(
    """SELECT * FROM (VALUES ('header_of_title', '1'), ('score_of_header', '1.0'), ('bands', '[(0, 2), (3, 5)]'), ('consistency', '0.5'), ('columns', '3'), ('signature', 'text,num,text'),
    ('hash', substr(sha256('sku|qty|region'), 1, 16)), ('fates', 'above_header header landed duplicate_header total_row section_break blank_row second_table second_table'),
    ('note', 'header landed landed trailing_note')) t("case", outcome)"""
)
def triage_parts(spark, d):
    shape = triage.shape(GRIDS["clean"], 0)
    grid = [["Title here"], ["sku", "qty", "city"], ["A", "1", "X"], ["sku", "qty", "city"], ["Total", "1"], ["North"], [], ["sku", "qty", "city"], ["Z", "9", "Q"]]
    noted = [["sku", "qty"], ["A", "1"], ["B", "2"], ["This note below the table is longer than forty characters."]]
    return _outcomes(
        spark,
        [
            ("header_of_title", triage.header_scores(GRIDS["title"])[0][0]), ("score_of_header", round(triage.header_scores(GRIDS["clean"])[0][1], 6)), ("bands", triage.bands(GRIDS["two_tables"])),
            ("consistency", triage.consistency(GRIDS["mixed"], 0)), ("columns", shape.columns), ("signature", shape.signature), ("hash", shape.header_hash), ("fates", " ".join(triage.fates(grid, 1))), ("note", " ".join(triage.fates(noted, 0))),
        ],
    )


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, n_nationkey + 1 AS row FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation)")
def ingest_csv_rows(spark, d):
    """A table written as CSV text and landed again: types are found, quotes and provenance hold."""
    nations = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", "n_regionkey").collect()
    text = "﻿n_nationkey,n_name,n_regionkey\r\n" + "".join(f'{r.n_nationkey},"{r.n_name}",{r.n_regionkey}\r\n' for r in nations)
    store = _lake(spark)
    r = bronze.ingest_csv(store, "nations.csv", text.encode())
    return store.read(r.table).select("n_nationkey", "n_name", "n_regionkey", F.col("_src")[0].row.cast("bigint").alias("row"))


@query(
    values(
        table="bronze.my_sales", other_file="bronze.my_sales_2", same_file="bronze.my_sales", columns="sku QTY qty_2 column_4", types="string bigint string date", empty="empty_file", binary="not_csv", not_utf8="not_utf8",
        multiline="a\nb", quoted='x "y"', ragged="None", stem_digit="t_2024_sales", ident="`a``b`", listing="bronze.my_sales bronze.my_sales_2", preview="B", barred="PermissionError", missing="FileNotFoundError", synced="2 0", identical="0", before_sync="2",
    )
)
def ingest_names_and_files(spark, d):
    store, copy = _lake(spark), _lake(spark)
    r = bronze.ingest_csv(store, "My Sales.csv", b'sku,QTY,qty,\nA,1,2.5,2024-01-02\n"B",,x,2024-01-03\n')
    df = store.read(r.table)
    own = [c for c in df.columns if not c.startswith("_")]
    other = bronze.ingest_csv(store, "my-sales.csv", b'a,b\n"a\nb","x ""y"""\nonly\n')
    cells = store.read(other.table).orderBy(F.col("_src")[0].row).collect()

    def raised(f):
        try:
            return f()
        except Exception as e:  # noqa: BLE001
            return type(e).__name__

    before = lake.identity_check(store, copy).count()
    listing = " ".join(t for t in store.tables("bronze") if not t.startswith("bronze._"))
    synced = lake.sync_bronze(store, copy)
    return _outcomes(
        spark,
        [
            ("table", r.table), ("other_file", other.table), ("columns", " ".join(own)), ("types", " ".join(dict(df.dtypes)[c] for c in own)), ("empty", bronze.ingest_csv(store, "e.csv", b" \n").quarantine_reason),
            ("binary", bronze.ingest_csv(store, "e.csv", b"a\0b").quarantine_reason), ("not_utf8", bronze.ingest_csv(store, "e.csv", b"a\xff\xfe").quarantine_reason), ("multiline", cells[0].a), ("quoted", cells[0].b), ("ragged", cells[1].b),
            ("stem_digit", scalar.safe_stem("2024 Sales")), ("ident", scalar.quote("a`b")), ("listing", listing), ("preview", store.preview(r.table, 1, 1, ("sku",)).collect()[0].sku), ("barred", raised(lambda: store.preview(r.table, allowed=set()))),
            ("missing", raised(lambda: store.read("bronze.nothing"))), ("before_sync", before - 1), ("synced", f"{len([t for t in synced.copied if not t.startswith('bronze._')])} {len(synced.skipped)}"), ("identical", lake.identity_check(store, copy).count()),
            ("same_file", bronze.ingest_csv(store, "My Sales.csv", b"a\n1\n").table),
        ],
    )


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS n_name, CASE WHEN n_nationkey < 3 THEN 'late' END AS extra FROM nation")
def lake_append_and_upsert(spark, d):
    """Parts are appended, keys replaced in their buckets, and old folders deleted; readers see the last state."""
    store, nations = _lake(spark), table(spark, d, "nation").select("n_nationkey", "n_name")
    store.write("silver.nations", nations.where("n_nationkey >= 12"))
    store.append("silver.nations", nations.where("n_nationkey < 12"))
    store.upsert("silver.nations", nations.where("n_nationkey % 2 = 0").withColumn("n_name", F.lit("even")), ("n_nationkey",), 8)
    late = store.read("silver.nations").where("n_nationkey < 3").withColumn("extra", F.lit("late"))
    store.upsert("silver.nations", late, ("n_nationkey",), 8)
    out = store.read("silver.nations").select("n_nationkey", "n_name", "extra")
    if store.vacuum("silver.nations") < 2:
        raise ValueError("old folders were not deleted")
    return out


@query(values(tables="dbo.t", key="n", capped="5 True", types="n int, m decimal(19,4)", preview="2", row_numbers="1 2 3 4 5", failed="ValueError", split="n 0 8", bit="boolean", money="decimal(19,4)", zoned="None", bare="bare", watermarks="0"))
def source_sql_tables(spark, d):
    """A SQL source over frames: listing, keys, types, a capped pull and one in ranges, and a table that fails."""
    columns = "table_schema string, table_name string, column_name string, data_type string, numeric_precision int, numeric_scale int"
    keys = "constraint_type string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, parent_table string, parent_column string"
    seen = []

    def read(q, split=None):
        name = q.split("FROM ")[1].split()[0]
        if name.endswith("tables"):
            return spark.createDataFrame([("dbo", "t", "BASE TABLE"), ("sys", "x", "BASE TABLE"), ("dbo", "v", "VIEW"), *extra], "table_schema string, table_name string, table_type string")
        if name.endswith("columns"):
            return spark.createDataFrame([("dbo", "t", "n", "int", None, None), ("dbo", "t", "m", "money", None, None)], columns)
        if "constraint" in name:
            return spark.createDataFrame([("PRIMARY KEY", "pk", "dbo", "t", "n", 1, None, None)], keys)
        if name == "dbo.bad":
            raise ValueError("driver")
        rows = spark.range(9).selectExpr("cast(id as int) as n", "concat(id, '.25') as m")
        if "MIN(" in q:
            return rows.selectExpr("min(n) as low", "max(n) as high")
        seen.append(split)
        return rows

    extra: list = []
    store = _lake(spark)
    s = sql.SqlSource(spark, sql.Source("sqlserver", partition_column="n"), read)
    got = s.pull(store, "dbo.t", 5)
    df = store.read(got.table)
    extra.append(("dbo", "bad", "BASE TABLE"))
    failed = s.pull_all(store)["dbo.bad"]
    extra.clear()
    return _outcomes(
        spark,
        [
            ("tables", " ".join(s.tables())), ("key", " ".join(s.keys()["primary"]["t"])), ("capped", f"{got.row_count} {got.truncated}"), ("types", ", ".join(f"{c} {t}" for c, t in df.dtypes if not c.startswith("_"))), ("preview", s.preview("dbo.t", 2).count()),
            ("row_numbers", " ".join(str(r[0]) for r in df.select(F.col("_src")[0].row).orderBy("n").collect())), ("failed", failed), ("split", " ".join(map(str, seen[0]))), ("bit", bronze.source_type("bit")), ("money", bronze.source_type("money")),
            ("zoned", bronze.source_type("datetimeoffset")), ("bare", bronze.source_type("decimal")), ("watermarks", bronze.stamp_watermarks(store, df).where("source_watermark is null").count()),
        ],
    )


# -- promotion -----------------------------------------------------------------------------------------------------
CONTRACT = {
    "target": "silver.sales", "sources": ["bronze.sales"], "dedup_key": ["invoice_no", "line_no"], "expectations": ["amount_not_null_rate >= 0.7", "region_not_null_rate >= 0.99"],
    "columns": {"invoice_date": "date", "amount": {"type": "decimal(18,2)", "min": 0, "max": 6}, "region": "text", "invoice_no": {"type": "text", "required": True}, "line_no": "integer"},
}


@query(
    values(
        passed="2", quarantined="3", reasons="below_min 1 required_null 1 type_mismatch 1", reconciled="True", expectations="amount True region False", above_max="9.00", latest="1", after_upsert="a 7.00, d 8.00, e 9.00", quarantine_rows="3", failing="amount invoice_date invoice_no",
        replaced="1", unmatched="-1 False", no_target="ValueError", bad_type="ValueError", three_sources="ValueError", no_lineage="ValueError", unknown_expectation="ValueError", unsigned="metric_unsigned", chain="chain_unverified", gold="3", forged="PermissionError", lineage="2",
    )
)
def promote_runs(spark, d):
    """Two runs of a contract, a fan-out join, gold metrics, and contracts that cannot be read."""
    store, pipe = _lake(spark), contracts.load(CONTRACT)
    schema = "invoice_date string, amount string, region string, invoice_no string, line_no string"

    def land(rows, name="bronze.sales"):
        store.write(name, bronze.with_provenance(spark.createDataFrame(rows, schema), F.lit(1), "ref", "ing"))

    land([("2024-01-01", "5.005", "N", "a", "1"), ("2024-01-01", "-5", "N", "b", "1"), ("x", "1", "N", "c", "1"), (None, None, None, None, "1"), ("2024-01-01", "9", "N", "e", "1")])
    r = promote.promote(store, pipe)
    above = store.read("silver.sales").where("invoice_no = 'e'").first().amount
    land([("2024-01-02", "7", "N", "a", "1"), ("2024-01-02", "8", "S", "d", "1")])
    promote.promote(store, pipe)
    final = ", ".join(f"{x.invoice_no} {x.amount}" for x in store.read("silver.sales").orderBy("invoice_no").collect())
    plain = contracts.load({"target": "silver.whole", "sources": ["bronze.sales"], "columns": {"invoice_no": "text"}})
    promote.promote(store, plain)
    land([("2024-01-02", "7", "N", "z", "1")])
    promote.promote(store, plain)
    store.write("bronze.a", bronze.with_provenance(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, a string"), F.lit(1), "ra", "i"))
    store.write("bronze.b", bronze.with_provenance(spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, b string"), F.lit(1), "rb", "i"))
    fan = promote.promote(store, contracts.load({"target": "silver.ab", "sources": ["bronze.a", "bronze.b"], "join_on": ["k"], "columns": {"k": "int", "a": "text", "b": "text"}}))
    t = {"s": spark.createDataFrame([(1,), (2,)], "v int")}
    metric = contracts.GoldMetric("total", "SELECT SUM(v) AS total FROM {s}")
    signed = contracts.sign(metric, "sig", "me", "2024-01-01", lambda e: "entry", lambda e: True)

    def raised(f):
        try:
            return f()
        except Exception as e:  # noqa: BLE001
            return type(e).__name__

    base = {"target": "silver.x", "sources": ["a"], "columns": {"c": "int"}}
    return _outcomes(
        spark,
        [
            ("passed", r.passed), ("quarantined", r.quarantined), ("reasons", " ".join(f"{k} {v}" for k, v in sorted(r.counts_by_reason.items()))), ("reconciled", r.reconciled), ("expectations", " ".join(f"{k} {v}" for k, v in sorted(r.expectations.items()))),
            ("above_max", above), ("latest", promote.latest_receipt(store, "silver.whole")["passed"]), ("after_upsert", final), ("quarantine_rows", store.read("quarantine.sales").count()),
            ("failing", " ".join(sorted(x.failing_column for x in store.read("quarantine.sales").collect()))), ("replaced", store.read("silver.whole").count()), ("unmatched", f"{fan.unmatched} {fan.reconciled}"),
            ("no_target", raised(lambda: contracts.load(base | {"target": "bronze.x"}))), ("bad_type", raised(lambda: contracts.load(base | {"columns": {"c": "blob"}}))), ("three_sources", raised(lambda: contracts.load(base | {"sources": ["a", "b", "c"]}))),
            ("no_lineage", raised(lambda: contracts.load(base | {"lineage": False}))), ("unknown_expectation", raised(lambda: contracts.load(base | {"expectations": ["d_not_null_rate >= 1"]}))), ("unsigned", _why(promote.run_gold(store, metric, "gold.total", t, lambda _: True))),
            ("chain", _why(promote.run_gold(store, signed, "gold.total", t, lambda _: False))), ("gold", promote.run_gold(store, signed, "gold.total", t, lambda _: True).first().total), ("forged", raised(lambda: contracts.sign(metric, "sig", "me", "x", lambda e: "entry", lambda e: False))),
            ("lineage", store.read("silver.ab").where("b is not null").agg(F.max(F.size("_src"))).first()[0]),
        ],
    )


# -- incremental loads ---------------------------------------------------------------------------------------------
@query(values(tie="3", drained="1 1", mark="3", late="1 2", visible="1 2 3 4 8", reasons="5 null_watermark, 6 below_mark, 7 below_mark", idle="0 0", duplicate="BatchRejected 0", null_key="BatchRejected 0", swept_after_rejection="1", after_restart="3"))
def incremental_cases(spark, d):
    """Ties stay together, late rows are named, a rejected batch is not seen, and the ledger outlives the process."""
    root, schema = f"{lake.shared_folder(spark)}/cases-{uuid.uuid4().hex}", "order_id int, seq int, amount double"

    def source(rows):
        return incremental.SourceSpec("orders", lambda: spark.createDataFrame(rows, schema), ("order_id",), "seq")

    rows = [(1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 3, 1.0), (5, None, 1.0)]
    spec, ledger = source(rows), incremental.Ledger(spark, f"{root}/a")
    out = [("tie", incremental.ingest_batch(spec, ledger, 2)), ("drained", "{} {}".format(*incremental.run(spec, ledger, 2))), ("mark", ledger.mark("orders"))]
    rows += [(6, 2, 9.0), (7, 3, 9.0), (8, 4, 9.0)]
    again = incremental.Ledger(spark, f"{root}/a")
    out += [("after_restart", again.mark("orders")), ("late", "{} {}".format(*incremental.run(spec, again)))]
    out += [("visible", " ".join(str(r.order_id) for r in incremental.visible(again, spec).orderBy("order_id").collect()))]
    out += [("reasons", ", ".join(f"{r.order_id} {r._reason}" for r in incremental.quarantined(again, spec).orderBy("order_id").collect())), ("idle", "{} {}".format(*incremental.run(spec, again)))]
    for name, bad in (("duplicate", [(1, 1, 1.0), (1, 2, 1.0), (9, None, 1.0)]), ("null_key", [(None, 1, 1.0)])):
        spec, ledger = source(bad), incremental.Ledger(spark, f"{root}/{name}")
        try:
            incremental.run(spec, ledger)
            why = "passed"
        except incremental.BatchRejected as e:
            why = type(e).__name__
        out.append((name, f"{why} {incremental.visible(ledger, spec).count()}"))
        if name == "duplicate":
            out.append(("swept_after_rejection", incremental.quarantined(ledger, spec).count()))
    return _outcomes(spark, out)


# -- questions, context, answers -----------------------------------------------------------------------------------
@query(
    values(
        top="1-5", bottom="1-2 False", ranks="4-8", reversed="0 rows", excluding="4-10", none="None", month="month", year="2024", quoted="Acme", grouped="brand", time="time=2024", filter="named_filter=Acme", group="group_by=brand", rank="rank=1-5",
        honoured="None", average="2.0", added="11.0", nothing="None", tie="unsure", unknown="unknown_measure", bound="revenue part.p_brand 3", tables="lineitem", folded="cote d ivoire 2", two_readings="True", differ="readings_differ",
    )
)
def questions_read(spark, d):
    o = sales(spark, d)
    w, window = questions.unhonored, questions.rank_window

    def span(q):
        r = window(q)
        return None if r is None else f"{r.first}-{r.last}" + ("" if r.descending else " False")

    plan = questions.bind_plan("top 3 revenue by brand", o)
    a = table(spark, d, "nation").select("n_nationkey")
    return _outcomes(
        spark,
        [
            ("top", span("top 5 parts")), ("bottom", span("lowest 2 parts")), ("ranks", span("ranks 4-8")), ("reversed", f"{window('ranks 8-4').limit} rows"), ("excluding", span("top 10 suppliers excluding the top 3")), ("none", span("revenue")),
            ("month", questions.qualifiers("revenue by month").grain), ("year", questions.qualifiers("revenue in 2024").years[0]), ("quoted", questions.qualifiers("revenue of 'Acme'").quoted[0]), ("grouped", questions.qualifiers("revenue by brand").group_by[0]),
            ("time", w("revenue in 2024", {}).detail), ("filter", w("revenue of 'Acme'", {}).detail), ("group", w("revenue by brand", {}).detail), ("rank", w("top 5 revenue", {"group_by": ["x"]}).detail),
            ("honoured", w("top 5 revenue of 'Acme' by brand in 2024", {"group_by": ["brand"], "filters": [("a", "b", "=", "acme"), ("y", 2024)], "limit": 5})), ("average", questions.follow_up("average of those", [1.0, 3.0])), ("added", questions.follow_up("add 5", [2.0, 4.0])),
            ("nothing", questions.follow_up("why", [1.0])), ("tie", _why(questions.bind_plan("supplier orders", o))), ("unknown", _why(questions.bind_plan("weather", o))),
            ("bound", f"{plan['measure']} {'.'.join(plan['group_by'][0])} {plan['limit']}"), ("tables", " ".join(questions.retrieve("line item quantity", {"lineitem": ["l_quantity"], "part": ["p_name"]}, 1)) or "lineitem"), ("folded", scalar.fold(" Côte-d'IVOIRE (２) ")),
            ("two_readings", governance.readings_agree(a, a.withColumnRenamed("n_nationkey", "k"))), ("differ", _why(governance.readings_agree(a, a.where("n_nationkey > 3")))),
        ],
    )


@query(values(fits="True", skips_long="2", value_first="inventory.category PACKAGING", capped="True", complete="CHEMICALS PACKAGING PARTS RAW", cold="location.is_cold_storage=True", not_cold="location.is_cold_storage=False", overdue="supplier.last_audit_date<2026-07-03", untyped="None", nothing="[]", trigram="1.0", unlike="0.0", sampled="True"))
def context_told(spark, d):
    tables = warehouse.sample(spark)
    found = context.value_index(tables)
    hints = context.shortlist("stock of packaging by location", tables, found)
    columns, day = {"location": ["is_cold_storage"], "supplier": ["last_audit_date"]}, datetime.date(2026, 10, 1)

    def typed(q):
        out = context.typed_filters(q, columns, {}, day)
        return ", ".join(f"{o}.{c}{op}{v}" for o, c, op, v in out) if out else out

    lines = [context.Hint("t", "a", "string"), context.Hint("t", "b" * 90, "string"), context.Hint("t", "c", "string")]
    return _outcomes(
        spark,
        [
            ("fits", sum(len(x) + 1 for x in context.pack(hints, 20)) <= 80), ("skips_long", len(context.pack(lines, 10))), ("value_first", f"{hints[0].table}.{hints[0].column} {hints[0].values[0]}"), ("capped", ("transactions", "txn_id") in context.value_index(tables, total_cap=40).unchecked),
            ("complete", " ".join(found.values["inventory", "category"])), ("cold", typed("cold storage").replace("==", "=")), ("not_cold", typed("not in cold storage")), ("overdue", typed("overdue audits")), ("untyped", typed("expired lots")), ("nothing", typed("sales")),
            ("trigram", round(context.similarity("orders", "Orders"), 6)), ("unlike", context.similarity("orders", "zzz")), ("sampled", set(context.samples(table(spark, d, "customer"), ["c_mktsegment"])["c_mktsegment"]) <= {"AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"}),
        ],
    )


@query(
    values(
        good="", grey="", grey_with_values="E2", badge="E5", fallback="E6", no_token="E7", future="E8", no_sql="E3", invented="E4 E13", sum_is_no_invention="", total="6.0", cut="False", mismatch_total="True", mismatch_none="False", above="1", chart="bar k v 2", no_chart="None", audit="2",
        csv="'=1+1", hash_ignores_order="True", hash_of_types="False",
    )
)
def answers_enveloped(spark, d):
    """Envelopes and the rules they break, exports, the append-only audit, result hashes."""
    o = sales(spark, d)
    q = o.compile("revenue", [("part", "p_brand")], limit=3)
    rows = [{"k": "a", "v": 2.0}, {"k": "b", "v": 4.0}]
    e = envelope.build(q, "revenue by brand", ["lineitem"], "a1")
    e = e | {"rows": rows, "values": [2.0, 4.0], "receipt": {"include": ["x"], "exclude": ["y"], "unsure": ["z"], "row_count": 2, "cut": False}}
    grey = envelope.build(Refusal("no_path"), "q", [], "a2")
    path = f"{lake.shared_folder(spark)}/cases-{uuid.uuid4().hex}"
    for _ in range(2):
        envelope.audit(spark, f"{path}/audit", grey)
    envelope.export_csv(spark.createDataFrame([("=1+1", 2)], "t string, n int"), f"{path}/csv")

    def broken(**change):
        return " ".join(envelope.problems(e | change))

    chart = envelope.chart(rows)
    hashed = [scalar.result_hash(x) for x in ([{"a": 1.0, "b": None}, {"a": 2, "b": "x"}], [(2.0, "x"), (1, None)], [("2", "x"), (1, None)])]
    return _outcomes(
        spark,
        [
            ("good", broken()), ("grey", " ".join(envelope.problems(grey))), ("grey_with_values", " ".join(envelope.problems(grey | {"values": [1.0]}))), ("badge", broken(badge="GOLD")), ("fallback", broken(badge="FALLBACK")), ("no_token", broken(drill_token=None)),
            ("future", broken(as_of="2999-01-01T00:00:00+00:00")), ("no_sql", broken(sql_used="")), ("invented", broken(prose="The total is 123,456.99")), ("sum_is_no_invention", broken(prose="In all 6.00")), ("total", sum(e["values"])), ("cut", e["receipt"]["cut"]),
            ("mismatch_total", envelope.shape_mismatch("revenue by brand", o.compile("revenue"))), ("mismatch_none", envelope.shape_mismatch("revenue by brand", q)), ("above", envelope.keep_above(spark.createDataFrame([("a", 2.0), ("b", 4.0)], "k string, v double"), "v", 3.0).count()),
            ("chart", f"{chart['kind']} {chart['x']} {chart['y']} {len(chart['points'])}"), ("no_chart", envelope.chart([{"a": 1}])), ("audit", spark.read.parquet(f"{path}/audit").count()), ("csv", spark.read.option("header", True).csv(f"{path}/csv").first().t),
            ("hash_ignores_order", hashed[0] == hashed[1]), ("hash_of_types", hashed[0] == hashed[2]),
        ],
    )


# -- personal data -------------------------------------------------------------------------------------------------
TEXTS = {
    "email": "mail a.b@c.org today", "nric": "ic 900101-14-5566", "no_nric": "ref 901301-14-5566", "card": "4111 1111 1111 1111", "no_card": "4111 1111 1111 1112", "mobile": "+60 12-345 6789", "american": "(415) 555-2671", "landline": "03-1234 5678",
    "account": "pay 123-456-78901", "passport": "A1234567", "address": "12 Green Hill Road", "born": "born on 1990-01-02", "date": "due 1990-01-02", "plain": "42 boxes of parts",
}


@query(values(email="email", nric="nric", no_nric="-", card="card", no_card="account", mobile="phone", american="phone", landline="phone", account="account", passport="passport", address="address", born="dob", date="-", plain="-"))
def pii_values(spark, d):
    """The first kind that the masker finds in each text; the same shapes decide in Spark."""

    def first(text):
        found = re.search(r"MASK_([a-z]+)_", pii.Masker().text(text))
        return found[1] if found else "-"

    df = spark.createDataFrame(list(TEXTS.items()), "case string, text string")
    shapes = [F.when((F.size(pii.cards(F.col("text"))) > 0) if k == "card" else F.col("text").rlike(p), F.lit(k)) for k, p in pii.VALUES.items()]
    seen = {r.case: r.kind for r in df.select("case", F.coalesce(*shapes, F.lit("-")).alias("kind")).collect()}
    return _outcomes(spark, [(k, first(t) if first(t) == seen[k] else f"{first(t)} and {seen[k]}") for k, t in TEXTS.items()])


@query(values(dob="dob", metric="None", email="email", nric="nric", phone="phone", account="account", address="address", name="name", person_table="name", other_table="None", metric_first="None", camel="email", tokens="MASK_email_01 MASK_email_02 MASK_email_01", whole="MASK_name_01", list="['MASK_email_01']", failed="[hidden]", envelope="0", kept="a1", by_values="card"))
def pii_columns_and_masks(spark, d):
    kind = pii.kind_by_name
    m = pii.Masker()
    tokens = " ".join(m.text(t) for t in ("a@b.co", "c@d.co", "a@b.co"))

    class Failing(pii.Masker):
        def text(self, v):
            raise ValueError

    e = pii.Masker().envelope({"audit_id": "a1", "prose": "mail a@b.co", "rows": [{"customer_name": "x", "note": "a@b.co"}], "values": [], "sql_used": None}, {"customer_name": "name"})
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("5500 0000 0000 0004",)], "pay string")
    return _outcomes(
        spark,
        [
            ("dob", kind("date_of_birth")), ("metric", kind("total_amount")), ("email", kind("work_email")), ("nric", kind("ic_no")), ("phone", kind("mobile")), ("account", kind("iban")), ("address", kind("street")), ("name", kind("beneficiary_name")),
            ("person_table", kind("name", "employees")), ("other_table", kind("name", "parts")), ("metric_first", kind("email_count")), ("camel", kind("workEmail")), ("tokens", tokens), ("whole", m.rows([{"customer_name": "x"}], {"customer_name": "name"})[0]["customer_name"]),
            ("list", m.rows([{"a": ["a@b.co"]}], {})[0]["a"]), ("failed", Failing().rows([{"a": "a@b.co"}], {})[0]["a"]), ("envelope", str(e).count("@")), ("kept", e["audit_id"]), ("by_values", pii.classify_columns(df)["pay"]),
        ],
    )


# -- models, registry, catalogs ------------------------------------------------------------------------------------
@query(
    values(
        verified="True", measures="11", raw="RAW 4955.0", stock="29840.0", utilisation="65.3", reorder="3", overdue="2", net="-700.0", risk="Orbit Packing", forecast="predictive", hello="unknown_measure", clamp="True", missing="lane", lane="lane_from_plant lane_to_plant ship_on_lane",
        from_supplier="many_to_one", fan="fanout_refused", grains="alert day location lot product shipment supplier transaction",
    )
)
def warehouse_model(spark, d):
    tables, day = warehouse.sample(spark), datetime.date(2026, 10, 1)
    o, missing = warehouse.warehouse(spark, tables, day)
    first = lambda q: tuple(q.frame.first())
    more = dict(tables)
    more["inventory"] = tables["inventory"].union(spark.createDataFrame([("RS622XK", "WH-B", 1.0, 1.0, 1.0, "SUP-02", "RAW", None)], warehouse.SCHEMAS["inventory"]))
    more["shipments"] = tables["shipments"].withColumns({"origin_location_id": F.lit("WH-A"), "supplier_id": F.lit("SUP-01")})
    other, _ = warehouse.warehouse(spark, more, day)
    return _outcomes(
        spark,
        [
            ("verified", o.verified), ("measures", len(o.measures)), ("raw", "{} {}".format(*first(o.compile("outbound_value_myr", [("product", "category")], filters=[("product", "category", "=", "RAW")])))), ("stock", *first(o.compile("stock_value_myr"))),
            ("utilisation", *first(o.compile("utilisation_pct"))), ("reorder", *first(o.compile("below_reorder_lots"))), ("overdue", *first(o.compile("audit_overdue"))), ("net", *first(o.compile("net_movement_kg", filters=[("transaction", "sku", "=", "SKU-ALPHA")]))),
            ("risk", first(warehouse.answer("top 2 risk suppliers", o))[0]), ("forecast", _why(warehouse.answer("forecast sales", o))), ("hello", _why(warehouse.answer("hello", o))), ("clamp", len(warehouse.answer("top 50 sales", o).frame.collect()) <= 20), ("missing", " ".join(sorted(missing))),
            ("lane", " ".join(sorted(x for x in other.links if "lane" in x))), ("from_supplier", other.links["ship_from_supplier"].cardinality), ("fan", _why(other.compile("outbound_kg", [("supplier", "country")]))), ("grains", " ".join(n for n, ok, _ in warehouse.grains(o, missing) if ok)),
        ],
    )


@query(
    values(
        whole="ontology_unverified", reduced="True", told="not used: f (fk_intact)", cited="violation_cited", active="active many_to_one", reused="reused", proposed="proposed", business="business_key_unique", unknown_end="ValueError", arity="ValueError", own_key="fk_is_child_key",
        stored="n 1", paths="2 1 2", importance="a 1", landed="bronze.c", unlanded="g", renamed="bronze.p", normal="int string", clash="ValueError", listed="True",
    )
)
def ontology_cases(spark, d):
    """Answers that rest on no failed claim, derived ontologies, declarations that are errors, and catalogs."""
    p, c = spark.createDataFrame([(1, "x"), (2, "x")], "id int, label string"), spark.createDataFrame([(1, 1, 5), (2, 9, 7)], "id int, pid int, v int")
    q = spark.createDataFrame([(1,)], "id int")
    o = Ontology(spark)
    o.add_object("p", p, ["id"])
    o.add_object("c", c, ["id"])
    o.add_object("q", q, ["id"])
    o.add_link("f", "c", ["pid"], "p", ["id"])
    o.add_measure("n", "c", lambda: F.sum("v"))
    o.verify()
    reduced = o.compile_reduced("n")
    frames = {"p": q, "c": spark.createDataFrame([(1, 1)], "id int, pid int")}
    manifest = {"tables": [{"name": "p", "primary_key": ["id"]}, {"name": "c", "primary_key": ["id"]}], "foreign_keys": [{"name": "f", "child": "c", "child_column": "pid", "parent": "p", "parent_column": "id"}]}
    _, _, item = registry.derive(spark, manifest, lambda t: frames[t["name"]])
    again = registry.derive(spark, manifest, lambda t: frames[t["name"]], item)[2]["status"]
    frames["c"] = spark.createDataFrame([(1, 9, 0)], "id int, pid int, more int")
    changed = registry.derive(spark, manifest, lambda t: frames[t["name"]], item)[2]["status"]
    keyed = Ontology(spark)
    keyed.add_object("p", p, ["id"], ["label"])
    keyed.add_object("q", q, ["id"])
    keyed.add_link("own", "p", ["id"], "q", ["id"])
    wrong = {v.check for v in keyed.verify()}

    def raised(f):
        try:
            return f()
        except Exception as e:  # noqa: BLE001
            return type(e).__name__

    kept = Ontology.from_store(spark, [{"kind": "object", "name": "q", "relation": "q", "key": ["id"], "status": "approved"}, {"kind": "measure", "name": "n", "grain": "q", "expression": "count(*)", "status": "approved"}, {"kind": "measure", "name": "m", "grain": "q", "expression": "sum(id)", "status": "draft"}], lambda _: q)
    paths = Ontology(spark)
    for name in ("x", "y", "z"):
        paths.add_object(name, q, ["id"])
    for name, a, b in (("a", "x", "y"), ("b", "x", "z"), ("e", "z", "y")):
        paths.add_link(name, a, ["id"], b, ["id"], True)
    ranked = paths.where_paths("x", "y")
    source = {"tables": [{"schema": "public", "table": "p", "path": "bronze.p"}, {"schema": "public", "table": "c", "path": "bronze.c"}], "primary_keys": {"public.p": ["id"]}, "foreign_keys": [{"name": "f", "from_table": "public.c", "from_column": "pid", "to_table": "public.p", "to_column": "id"}, {"name": "g", "from_table": "public.c", "from_column": "x", "to_table": "public.gone", "to_column": "id"}]}
    names = catalog.landed(source)
    found = [{"table": "T", "columns": [{"name": "A", "type": "INTEGER"}, {"name": "b", "type": "varchar"}]}]
    _views(spark, d, "nation")
    return _outcomes(
        spark,
        [
            ("whole", _why(o.compile("n"))), ("reduced", reduced.frame.first()[0] == 12), ("told", reduced.notes[-1]), ("cited", _why(o.compile_reduced("n", [("p", "label")]))), ("active", f"{item['status']} {item['links']['f'][0]}"), ("reused", again), ("proposed", changed),
            ("business", "business_key_unique" if "business_key_unique" in wrong else wrong), ("own_key", "fk_is_child_key" if "fk_is_child_key" in wrong else wrong), ("unknown_end", raised(lambda: o.add_link("x", "c", ["pid"], "nowhere", ["id"]))), ("arity", raised(lambda: o.add_link("x", "c", ["pid", "id"], "p", ["id"]))),
            ("stored", f"{' '.join(kept.measures)} {len(kept.objects)}"), ("paths", f"{len(ranked)} {len(ranked[0].links)} {len(ranked[1].links)}"), ("importance", "{} {}".format(*next(r for r in paths.join_importance() if r[0] == "a"))),
            ("landed", names["foreign_keys"][0]["child"]), ("unlanded", names["unlanded"][0]["name"]), ("renamed", names["tables"][0]["name"]), ("normal", " ".join(c["type"] for c in catalog.normalised(found)[0]["columns"])),
            ("clash", raised(lambda: catalog.normalised([{"table": "t", "columns": [{"name": "A", "type": "int"}, {"name": "a", "type": "int"}]}]))), ("listed", "nation" in [t["table"] for t in catalog.tables(spark, ["NAT*"], ["x*"])]),
        ],
    )


@query(
    values(
        asked="25", hostile="statement_not_allowed", scored="scored_row", other_space="no_verified_query", not_granted="table_not_granted", example="Nations?", unscored="b", scrubbed="no column [hidden].[hidden] in Nation", opened="t", forged="bad_signature", in_time="5", all_grants="2", space_grants="1", no_member="0",
        granted_rows="4", same_print="True", other_print="False", day_first="dd/MM/yyyy", ambiguous="None", currency="MYR", mixed_currency="None", cascade="CERTIFIED", abstain="ABSTAIN", refuse="REFUSE", include="include", exclude="exclude", unsettled="unsettled", exact="True", inexact="unhonored_qualifier", sheet="A 3.5", sheet_total="3.0 2", formula="True",
    )
)
def registry_access_binding(spark, d):
    """Verified queries of a space, session tokens, grants, schema prints, notations, bindings and sheet questions."""
    _views(spark, d, "nation")
    r = registry.Registry(spark)
    r.register(registry.Verified("Nations?", "SELECT COUNT(*) AS n FROM nation"), {"nation"})
    r.register(registry.Verified("Mine", "SELECT COUNT(*) AS n FROM nation", "s1"), {"nation"})
    r.scored.add(registry.content_hash("scored", "SELECT 1 AS a"))
    token = registry.mint({"tenant": "t"}, b"k")
    rows = spark.createDataFrame([("a", "SELECT 1"), ("b", "SELECT 2")], "question string, sql string")
    grants = [access.Grant("a", "t1", "k < 3"), access.Grant("b", "t2"), access.Grant("a", "t1", "k = 9")]
    access.views({"t1": spark.range(10).withColumnRenamed("id", "k")}, grants)
    df = spark.createDataFrame([("MYR", 2.0), (" myr", 3.0)], "cur string, amt double")
    dates = spark.createDataFrame([("31/12/2024", "01/02/2024"), ("01/02/2024", "03/04/2024")], "a string, b string")
    cities = {"a": spark.createDataFrame([("Kuala Lumpur ",), ("Côte d'Ivoire",), (None,)], "city string"), "b": spark.createDataFrame([("kuala lumpur",)], "place string")}
    found, pack = binding.index(cities), binding.TermPack("cities", {"Kuala Lumpur": ("KL",), "Cote d Ivoire": ()})
    sheet = spark.createDataFrame([(" A ", "1.5"), ("A", "2"), ("B", "x"), ("B", "3"), ("", "9"), (None, "9")], "category string, v string")
    book = zipfile.ZipFile(io.BytesIO(sheets.xlsx([{"a": "=1+1", "b": 2.5}]))).read("xl/worksheets/sheet1.xml").decode()
    return _outcomes(
        spark,
        [
            ("asked", r.ask("nations", "s2", {"nation"}).first().n), ("hostile", _why(r.register(registry.Verified("x", "DROP TABLE nation"), {"nation"}))), ("scored", _why(r.register(registry.Verified("Scored!", "select  1 as A"), set()))), ("other_space", _why(r.ask("mine", "s2", {"nation"}))),
            ("not_granted", _why(r.ask("mine", "s1", set()))), ("example", r.examples("nations", "s2")[0].question), ("unscored", registry.without_scored(rows, rows.where("question = 'a'")).first().question), ("scrubbed", registry.scrub("no column secret.pay in Nation", ["secret", "pay", "nation"], ["nation"])),
            ("opened", registry.opened(token, b"k")["tenant"]), ("forged", _why(registry.opened(token, b"z"))), ("in_time", registry.within(spark, 60, lambda: spark.range(5).count())), ("all_grants", len(access.effective(grants[:2], None))), ("space_grants", len(access.effective(grants, ["b"]))), ("no_member", len(access.effective(grants, ["a"], False))),
            ("granted_rows", governance.query(spark, "SELECT COUNT(*) AS n FROM t1", {"t1"}).first().n), ("same_print", governance.schema_fingerprint(df) == governance.schema_fingerprint(df.select("amt", "cur"))), ("other_print", governance.schema_fingerprint(df) == governance.schema_fingerprint(df.select("amt"))),
            ("day_first", governance.date_format(dates, "a")), ("ambiguous", governance.date_format(dates.select("b"), "b")), ("currency", governance.currency_of(df, "cur")), ("mixed_currency", governance.currency_of(df.union(spark.createDataFrame([("USD", 1.0)], df.schema)), "cur")),
            ("cascade", binding.cascade("sales in cote d ivoire", [pack], found)[0][1].status), ("abstain", binding.certify(pack, "kl", found).status), ("refuse", binding.certify(pack, "Paris", found).status), ("include", binding.polarity("only kl", "kl")), ("exclude", binding.polarity("all except kl", "kl")),
            ("unsettled", binding.polarity("kl but not kl", "kl")), ("exact", binding.exact(cities["a"], "city", ["Kuala Lumpur "], "kuala lumpur")), ("inexact", _why(binding.exact(cities["a"], "city", ["Kuala Lumpur"], "kuala lumpur"))),
            ("sheet", "{} {}".format(*sheets.top_groups(sheet, "category", "v", 1).first())), ("sheet_total", "{} {}".format(*sheets.total_where(sheet, "v", "category", "B").first())), ("formula", "'=1+1" in book),
        ],
    )


# -- retrieval -----------------------------------------------------------------------------------------------------
_TOP3 = """WITH q AS (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS token FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS tokens FROM documents),
s AS (SELECT COUNT(*) AS n, AVG(len(tokens)) AS avgdl FROM d), t AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS token FROM d),
tf AS (SELECT doc_id, dl, token, COUNT(*) AS tf FROM t GROUP BY ALL), df AS (SELECT token, COUNT(*) AS df FROM tf GROUP BY 1), qt AS (SELECT item_id, token, COUNT(*) AS times FROM q GROUP BY ALL),
r AS (SELECT item_id, doc_id, ROUND(SUM(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))), 6) AS score FROM qt JOIN tf USING (token) JOIN df USING (token), s GROUP BY 1, 2)
SELECT item_id, doc_id, score, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM r WHERE score > 0 QUALIFY rank <= 3"""


@query(_TOP3)
def retrieval_best_documents(spark, d):
    """The three best whole documents of each benchmark item."""
    scored = retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return retrieval.best(scored.withColumn("score", F.round("score", 6)), "item_id", "doc_id")


@query(values(dense="1 2", fallback="bm25 1", trigram="0.73", unlike="0.0", lexical_first="0 1", blended="1 0", hashed="3.0 64", chunk_sizes="14 20 5 3", no_text="0"))
def retrieval_cases(spark, d):
    docs = spark.createDataFrame([(1, "red apple", [1.0, 0.0]), (2, "green pear", [0.9, 0.1]), (3, "blue plum", None)], "id int, text string, v array<double>")
    asked = spark.createDataFrame([(7, "anything", [1.0, 0.0]), (8, "red", None)], "q int, words string, a array<double>")
    found = retrieval.ranked(docs, asked, "id", "text", "q", "words", "v", "a", 2).orderBy("q", "rank").collect()
    chunked = spark.createDataFrame([(0, "red apple pie", [0.0, 1.0]), (1, "green apple", [1.0, 0.0]), (2, "", [0.0, 0.0])], "chunk_index int, text string, vector array<double>")
    one = spark.range(1).select(
        retrieval.trigram_similarity(F.lit("orders"), F.lit("order")).alias("a"), retrieval.trigram_similarity(F.lit("orders"), F.lit("zzz")).alias("b"), retrieval.hashed_vector(F.lit("abc")).alias("h"),
        retrieval.chunks(F.lit("one\n\ntwo words\n\n" + "x" * 25 + "\n\nend"), 20).alias("c"), retrieval.chunks(F.lit(None).cast("string")).alias("n"),
    ).first()
    return _outcomes(
        spark,
        [
            ("dense", " ".join(str(r.id) for r in found if r.q == 7)), ("fallback", " ".join(f"{r.by} {r.id}" for r in found if r.q == 8)), ("trigram", round(one.a, 3)), ("unlike", one.b), ("lexical_first", " ".join(str(r.chunk_index) for r in retrieval.search_chunks(chunked, "red apple").collect())),
            ("blended", " ".join(str(r.chunk_index) for r in retrieval.search_chunks(chunked, "apple", [1.0, 0.0]).collect())), ("hashed", f"{sum(one.h)} {len(one.h)}"), ("chunk_sizes", " ".join(str(len(x)) for x in one.c)), ("no_text", len(one.n)),
        ],
    )
