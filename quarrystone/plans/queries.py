"""Registered queries of the engine over the sales tables, each beside the SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binding, pii, retrieval, scalar
from ..operators import contracts, promote
from ..sources import bronze, lake
from ..sources.lake import shared_folder
from ..streaming import incremental
from . import governance
from .model import OBJECTS, money, revenue, sales, table
from .outcomes import Refusal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_REV = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(18,2)) - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("$REV", _REV)
        return f

    return add


def _frame(answer) -> DataFrame:
    if isinstance(answer, Refusal):
        raise ValueError(f"refused: {answer.reason} {answer.detail}")
    return answer.frame


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


# -- semantic layer ------------------------------------------------------------------------------------------------
@query("SELECT n_name AS nation_n_name, CAST(SUM($REV) AS DOUBLE) AS revenue FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def sl_revenue_by_nation(spark, d):
    return _frame(sales(spark, d).compile("revenue", [("nation", "n_name")]))


@query("SELECT r_name AS region_r_name, o_orderstatus AS orders_o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_value FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def sl_three_hops_and_own_attribute(spark, d):
    return _frame(sales(spark, d).compile("order_value", [("region", "r_name"), ("orders", "o_orderstatus")]))


@query("SELECT p_brand AS part_p_brand, COUNT(*) AS lines FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE n_name LIKE 'NATION_1%' AND n_regionkey > 1) AND l_quantity >= 10 GROUP BY 1")
def sl_semi_join_filters(spark, d):
    return _frame(sales(spark, d).compile("lines", [("part", "p_brand")], [("nation", "n_name", "LIKE", "NATION_1%"), ("nation", "n_regionkey", ">", 1), ("lineitem", "l_quantity", ">=", 10)]))


@query("SELECT CAST(SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS supplier_balance FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)")
def sl_existential_filter(spark, d):
    return _frame(sales(spark, d, neighbours=True).compile("supplier_balance", filters=[("customer", "c_mktsegment", "=", "BUILDING"), ("customer", "c_acctbal", ">", 9000.0)]))


@query("SELECT c_mktsegment AS customer_c_mktsegment, CAST(SUM($REV) AS DOUBLE) AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 2 OFFSET 1")
def sl_rank_window(spark, d):
    return _frame(sales(spark, d).compile("revenue", [("buyer", "c_mktsegment")], offset=1, limit=2))


@query("SELECT p_brand AS part_p_brand, ROUND(CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) / NULLIF(CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0), 6) AS returned_share FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def sl_ratio_of_sums(spark, d):
    return _frame(sales(spark, d).compile("returned_share", [("part", "p_brand")]))


@query("SELECT s_name AS supplier_s_name, p_type AS part_p_type, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def sl_two_grains(spark, d):
    return _frame(sales(spark, d).compile_grains("quantity", [("supplier", "s_name"), ("part", "p_type")]))


@query("SELECT r_name AS region_r_name, CAST(SUM($REV) AS DOUBLE) AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sl_path_named_by_via(spark, d):
    o = sales(spark, d)
    del o.links["supplier_nation"]
    return _frame(o.compile("revenue", [("region", "r_name")], via={"nation": "customer_nation"}))


@query("""SELECT * FROM (VALUES ('average', 'unknown_measure'), ('city', 'unknown_object'), ('fanout', 'fanout_refused'), ('limit', 'bad_limit'), ('mood', 'unknown_column'),
('offset', 'bad_offset'), ('operator', 'bad_operator'), ('path', 'no_path'), ('unused', 'unused_via'), ('unverified', 'ontology_unverified'), ('via', 'unknown_link')) t(request, reason)""")
def sl_refusals(spark, d):
    o = sales(spark, d, neighbours=True)
    asked = {
        "average": o.compile("average"), "city": o.compile("lines", [("city", "name")]), "mood": o.compile("lines", [("part", "mood")]),
        "fanout": o.compile("supplier_balance", [("customer", "c_mktsegment")]), "limit": o.compile("lines", limit=-1), "offset": o.compile("lines", offset=3),
        "operator": o.compile("lines", filters=[("part", "p_size", "~", 1)]), "path": o.compile("supplier_balance", [("part", "p_size")]),
        "unused": o.compile("lines", [("part", "p_brand")], via={"supplier": "line_supplier"}), "via": o.compile("lines", [("part", "p_brand")], via={"part": "nope"}),
    }
    o.add_measure("more", "part", lambda: F.count("*"))
    asked["unverified"] = o.compile("more")
    return spark.createDataFrame([(k, v.reason) for k, v in asked.items()], "request string, reason string")


@query("""SELECT 'customer_nation' AS link, 'many_to_one' AS cardinality, CAST(1 AS INT) AS max_fanout UNION ALL SELECT 'supplier_neighbours', 'many_to_many', CAST(MAX(n) AS INT) FROM (SELECT COUNT(*) AS n FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey)""")
def sl_measured_links(spark, d):
    o = sales(spark, d, neighbours=True)
    rows = [(x.name, x.cardinality, x.max_fanout) for x in o.links.values() if x.name in ("customer_nation", "supplier_neighbours")]
    return spark.createDataFrame(rows, "link string, cardinality string, max_fanout int")


@query("SELECT 'key_unique' AS check_name, 'events_by_user' AS subject UNION ALL SELECT 'fk_is_child_key', 'order_as_customer' UNION ALL SELECT 'fk_intact', 'event_customer'")
def sl_violations(spark, d):
    from .ontology import Ontology

    o = Ontology(spark)
    events = table(spark, d, "events")
    o.add_object("events_by_user", events, ["user_id"])
    o.add_object("events", events.withColumn("custkey", -F.col("user_id") - 1), ["event_id"])
    o.add_object("orders", table(spark, d, "orders"), ["o_orderkey"])
    o.add_object("customer", table(spark, d, "customer"), ["c_custkey"])
    o.add_link("order_as_customer", "orders", ["o_orderkey"], "customer", ["c_custkey"])
    o.add_link("event_customer", "events", ["custkey"], "customer", ["c_custkey"])
    return spark.createDataFrame([(v.check, v.subject) for v in o.verify()], "check_name string, subject string")


# -- promote -------------------------------------------------------------------------------------------------------
PIPE = {
    "target": "silver.lines", "sources": ["bronze.lines"], "dedup_key": ["order_no", "line_no"],
    "columns": {"order_no": {"type": "bigint", "required": True}, "line_no": "integer", "amount": {"type": "decimal(18,2)", "min": 10000, "required": True}, "flag": {"type": "text", "allowed_from": "dim.flags"}, "shipped": "date"},
    "expectations": ["amount_not_null_rate >= 0.99"],
}
_TEXT = """SELECT CAST(l_orderkey AS VARCHAR) AS order_no, CASE WHEN l_linenumber = 7 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS line_no,
CASE WHEN l_quantity = 13 THEN NULL ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount, l_returnflag AS flag, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem"""
_REASON = """CASE WHEN line_no = 'x' THEN 'type_mismatch' WHEN amount IS NULL THEN 'required_null' WHEN CAST(amount AS DOUBLE) < 10000 THEN 'below_min' WHEN flag NOT IN ('A', 'N') THEN 'not_in_allowed_from' END"""


def _lines(spark, d) -> DataFrame:
    """Lineitem as text, with planted faults."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_no"),
        F.when(F.col("l_linenumber") == 7, "x").otherwise(F.col("l_linenumber").cast("string")).alias("line_no"),
        F.when(F.col("l_quantity") != 13, money("l_extendedprice").cast("string")).alias("amount"),
        F.col("l_returnflag").alias("flag"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
    )


def _staged(spark, d) -> DataFrame:
    flags = spark.createDataFrame([("A",), ("N",)], "code string")
    return promote.staged(promote.joined_sources([_lines(spark, d)], ()), contracts.load(PIPE), {"dim.flags": flags})


@query(f"SELECT coalesce({_REASON}, 'passed') AS reason, COUNT(*) AS n FROM ({_TEXT}) GROUP BY 1")
def promote_reason_counts(spark, d):
    return _staged(spark, d).groupBy(F.coalesce("_fail_reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(order_no AS BIGINT) AS order_no, CAST(line_no AS INT) AS line_no, CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE) AS amount, flag, shipped FROM ({_TEXT}) WHERE ({_REASON}) IS NULL")
def promote_silver_rows(spark, d):
    rows = _staged(spark, d).where("_fail_reason is null")
    return rows.select(F.col("order_no").try_cast("bigint").alias("order_no"), F.col("line_no").try_cast("int").alias("line_no"), F.col("amount").try_cast("decimal(18,2)").cast("double").alias("amount"), "flag", F.col("shipped").try_cast("date").cast("string").alias("shipped"))


@query("SELECT o_orderkey, o_orderstatus, 'old' AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_orderstatus, 'new' FROM orders WHERE o_orderkey % 3 = 0")
def promote_upsert(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return promote.upsert(orders.withColumn("v", F.lit("old")), orders.where("o_orderkey % 3 = 0").withColumn("v", F.lit("new")), ("o_orderkey",))


@query("SELECT o_orderkey, o_totalprice, c_name, c_custkey IS NOT NULL AS matched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON o_custkey = c_custkey")
def promote_two_sources(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("cust"))
    customer = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("cust"), "c_name")
    return promote.joined_sources([orders, customer], ("cust",)).select("o_orderkey", "o_totalprice", "c_name", F.col("_join_matched").alias("matched"))


@query("SELECT 'c_custkey' AS column_name, 0.0 AS null_rate, TRUE AS candidate_key UNION ALL SELECT 'c_name', 0.0, TRUE UNION ALL SELECT 'c_nationkey', 0.0, FALSE UNION ALL SELECT 'c_mktsegment', 0.0, FALSE")
def infer_contract(spark, d):
    found = promote.infer_contract(table(spark, d, "customer").drop("c_acctbal"))
    return spark.createDataFrame([(c, r, (c,) in found["candidate_keys"]) for c, r in found["null_rates"].items()], "column_name string, null_rate double, candidate_key boolean")


# -- sources -------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice, CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey = 1 THEN '.5' ELSE '' END AS o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def source_exact_typing(spark, d):
    text = table(spark, d, "orders").select(F.col("o_orderkey").cast("string"), money("o_totalprice").cast("string").alias("o_totalprice"), F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") == 1, ".5").otherwise("")).alias("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    typed, given, left, numeric = bronze.type_columns(text, {"o_orderkey": "bigint", "o_totalprice": "bare", "o_custkey": "int", "day": "date"})
    assert left == ["o_custkey"] == numeric and given["o_totalprice"] == "decimal(38,2)"
    return typed.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_custkey", F.col("day").cast("string").alias("day"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS row_no FROM orders")
def source_row_numbers(spark, d):
    return bronze.numbered(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", F.col("__row").cast("long").alias("row_no"))


@query("""SELECT 'pk_unique' AS check_name, 'orders' AS subject, TRUE AS passed UNION ALL SELECT 'pk_null', 'orders', TRUE UNION ALL SELECT 'row_count', 'orders', TRUE
UNION ALL SELECT 'row_count', 'customer', TRUE UNION ALL SELECT 'pk_unique', 'customer', TRUE UNION ALL SELECT 'pk_null', 'customer', TRUE
UNION ALL SELECT 'fk_intact', 'orders(o_custkey) -> customer(c_custkey)', (SELECT COUNT(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'cardinality', 'orders(o_custkey) -> customer(c_custkey)', TRUE""")
def source_lake_validation(spark, d):
    found = lake.validate({t: table(spark, d, t) for t in ("orders", "customer")}, {t: OBJECTS[t] for t in ("orders", "customer")}, [("orders", ["o_custkey"], "customer", ["c_custkey"])])
    return spark.createDataFrame([x[:3] for x in found], "check_name string, subject string, passed boolean")


# -- joins and aggregates ------------------------------------------------------------------------------------------
@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_anti(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def join_semi(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 49").select("l_orderkey")
    return table(spark, d, "orders").select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@query("SELECT n_name, COUNT(s_suppkey) AS rich FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def join_left_filter_in_on(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select("s_suppkey", "s_nationkey")
    return table(spark, d, "nation").join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("rich"))


@query("SELECT p_type, COUNT(*) AS pairs FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1")
def join_after_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.count("*").alias("pairs"))


@query("SELECT a.o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS k FROM customer WHERE c_nationkey < 10) b WHERE a.k IS NOT DISTINCT FROM b.k)")
def join_anti_null_safe(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("k"))
    b = table(spark, d, "customer").where("c_nationkey < 10").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("k2")).distinct()
    return a.join(b, F.col("k").eqNullSafe(F.col("k2")), "left_anti").select("o_orderkey")


@query("SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(SUM($REV) AS DOUBLE) AS revenue, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(*) FILTER (WHERE l_discount > 0.05) AS discounted, MAX(l_extendedprice) AS largest, MIN(l_tax) AS least_tax FROM lineitem GROUP BY 1, 2")
def agg_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(revenue()).cast("double").alias("revenue"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"),
        F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("discounted"), F.max("l_extendedprice").alias("largest"), F.min("l_tax").alias("least_tax"),
    )


@query("SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS tuples FROM lineitem")
def agg_distinct_tuples(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct(F.struct("l_partkey", "l_suppkey")).alias("tuples"))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 12")
def agg_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT o_orderpriority, ROUND(100.0 * CAST(v AS DOUBLE) / CAST(SUM(v) OVER () AS DOUBLE), 6) AS share FROM (SELECT o_orderpriority, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1)")
def window_share_of_total(spark, d):
    per = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(money("o_totalprice")).alias("v"))
    total = per.agg(F.sum("v").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("o_orderpriority", F.round(F.lit(100.0) * F.col("v").cast("double") / F.col("t").cast("double"), 6).alias("share"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal, r FROM (SELECT c_mktsegment, c_custkey, c_acctbal, CAST(ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INT) AS r FROM customer) WHERE r <= 3")
def window_top_per_group(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.row_number().over(w).alias("r")).where("r <= 3")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def window_latest_per_key(spark, d):
    newest = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("x"))
    return newest.select("user_id", "x.event_id", "event_type")


@query("SELECT n_name, total FROM (SELECT n_name, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) ORDER BY total DESC, n_name LIMIT 5 OFFSET 3")
def sort_ranks_four_to_eight(spark, d):
    per = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum(money("c_acctbal")).cast("double").alias("total"))
    return per.orderBy(F.desc("total"), "n_name").offset(3).limit(5)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def set_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_quantity > 48").select("l_partkey"))


@query("SELECT TRUE AS same_rows, FALSE AS other_rows")
def rows_compared(spark, d):
    a = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 0.000001).alias("v"))
    return spark.createDataFrame([(scalar.same_rows(a, b), scalar.same_rows(a, b.where("k > 5")))], "same_rows boolean, other_rows boolean")


# -- scalar functions ----------------------------------------------------------------------------------------------
@query("SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CAST(hour(ts) AS INT) AS hour, CAST(isoyear(ts) AS INT) AS isoyear, CAST(week(ts) AS INT) AS isoweek FROM events")
def scalar_dates(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.date_trunc("month", "ts"), "yyyy-MM-dd").alias("month"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), F.hour("ts").alias("hour"), F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("int").alias("isoyear"), F.weekofyear("ts").alias("isoweek"))


@query("SELECT COUNT(*) AS n FROM events WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-08'")
def scalar_period_bounds(spark, d):
    return table(spark, d, "events").where(scalar.day_bounds(F.col("ts"), "2024-01-05", "2024-01-07")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def scalar_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT p_partkey, upper(p_name) AS up, split_part(p_name, ' ', 2) AS second, regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand_no, regexp_extract(p_name, '^[a-z]+') AS first_word, length(p_name) AS len, p_name ILIKE '%RING%' AS ring, trim(replace(p_type, 'E', ' ')) AS t FROM part")
def scalar_strings(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"), F.regexp_replace("p_brand", "[^0-9]", "").alias("brand_no"), F.regexp_extract("p_name", "^[a-z]+", 0).alias("first_word"), F.length("p_name").cast("long").alias("len"), F.col("p_name").ilike("%RING%").alias("ring"), F.trim(F.replace("p_type", F.lit("E"), F.lit(" "))).alias("t"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / NULLIF(l_discount, 0) IS NULL AS undefined, sha256(CAST(l_partkey AS VARCHAR)) AS digest FROM lineitem")
def scalar_guards_and_hash(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalar.ratio(F.col("l_extendedprice"), F.col("l_discount")).isNull().alias("undefined"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"))


@query("SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS folded FROM documents")
def scalar_folding(spark, d):
    return table(spark, d, "documents").select("doc_id", scalar.folded(F.col("text")).alias("folded"))


# -- incremental ---------------------------------------------------------------------------------------------------
@query("SELECT event_type, COUNT(*) AS n, MIN(event_id) AS first_id, MAX(event_id) AS last_id FROM events GROUP BY 1")
def incremental_drain(spark, d):
    base = shared_folder(spark)
    spec = incremental.SourceSpec("events", lambda: table(spark, d, "events"), ("event_id",), "ts")
    ledger = incremental.Ledger(spark, f"{base.rstrip('/')}/ledger-{uuid.uuid4().hex}")
    total = table(spark, d, "events").count()
    incremental.run(spec, ledger, batch_size=max(1, total // 3))
    return incremental.visible(ledger, spec).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def events_per_day(spark, d):
    w = F.window("ts", "1 day")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


# -- governance ----------------------------------------------------------------------------------------------------
STATEMENTS = {
    "copy": "COPY orders TO 'x'", "two": "SELECT 1 AS a; SELECT 2 AS b", "file": "SELECT * FROM parquet.`/tmp/x`", "reader": "SELECT * FROM read_parquet('x')",
    "hidden": "WITH o AS (SELECT * FROM secrets) SELECT * FROM o", "subquery": "SELECT * FROM orders WHERE o_custkey IN (SELECT k FROM secrets)", "generator": "SELECT * FROM range(5)",
    "plain": "SELECT COUNT(*) AS n FROM orders", "cte": "WITH o AS (SELECT o_custkey FROM Orders) SELECT COUNT(*) AS n FROM o JOIN customer ON o_custkey = c_custkey", "qualify": "SELECT * FROM orders QUALIFY 1 = 1",
}


@query("""SELECT * FROM (VALUES ('copy', 'statement_not_allowed'), ('two', 'sql_not_supported'), ('file', 'path_not_allowed'), ('reader', 'path_not_allowed'), ('hidden', 'table_not_granted'),
('subquery', 'table_not_granted'), ('generator', 'path_not_allowed'), ('plain', 'pass'), ('cte', 'pass'), ('qualify', 'sql_not_supported')) t(statement, outcome)""")
def governance_gate(spark, d):
    got = [(k, getattr(governance.gate(spark, s, {"orders", "customer"}), "reason", "pass")) for k, s in STATEMENTS.items()]
    return spark.createDataFrame(got, "statement string, outcome string")


@query("SELECT n_name, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1")
def governance_pass_through(spark, d):
    _views(spark, d, "customer", "nation")
    out = governance.query(spark, "SELECT n_name, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1", {"customer", "nation"})
    assert isinstance(out, DataFrame), out
    return out


@query("SELECT 'k' AS output, 'nation.n_name' AS source UNION ALL SELECT 'v', 'customer.c_acctbal' UNION ALL SELECT 'v', 'customer.c_nationkey'")
def governance_lineage(spark, d):
    _views(spark, d, "customer", "nation")
    df = spark.sql("SELECT n_name AS k, SUM(x) AS v FROM (SELECT c_nationkey AS n, c_acctbal + c_nationkey AS x FROM customer) JOIN nation ON n = n_nationkey GROUP BY n_name")
    rows = [(c, f"{v}.{k}") for c, found in governance.sources(df).items() for v, k in sorted(found)]
    return spark.createDataFrame(rows, "output string, source string")


JOINS = {
    "sound": "SELECT c_mktsegment, SUM(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "fan": "SELECT SUM(c_acctbal) AS v FROM orders JOIN customer ON o_custkey = c_custkey",
    "off_link": "SELECT COUNT(*) AS n FROM orders JOIN customer ON o_orderkey = c_custkey",
    "extreme": "SELECT MAX(c_acctbal) AS v FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "member": "SELECT SUM(o_totalprice) AS v FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "exists": "SELECT COUNT(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)",
    "threshold": "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "off_member": "SELECT COUNT(*) AS n FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer)",
}


@query("SELECT * FROM (VALUES ('sound', 'pass'), ('fan', 'fan_trap'), ('off_link', 'unverified_join'), ('extreme', 'pass'), ('member', 'pass'), ('exists', 'pass'), ('threshold', 'pass'), ('off_member', 'unverified_join')) t(statement, outcome)")
def governance_free_sql_joins(spark, d):
    _views(spark, d, "orders", "customer")
    o = sales(spark, d)
    return spark.createDataFrame([(k, r.reason if (r := governance.unverified_join(spark.sql(s), o)) is not None else "pass") for k, s in JOINS.items()], "statement string, outcome string")


# -- binding, retrieval, personal data -----------------------------------------------------------------------------
@query("SELECT 'customer' AS \"table\", 'c_mktsegment' AS \"column\", 'building' AS phrase, 'BUILDING' AS cell UNION ALL SELECT 'nation', 'n_name', 'nation 3', 'NATION_3'")
def binding_stated_values(spark, d):
    return binding.stated_values("Revenue of building clients in Nation 3?", {t: table(spark, d, t) for t in ("customer", "nation")})


@query("SELECT 'CERTIFIED' AS status, 'c_mktsegment' AS bound_column, 'MACHINERY' AS stored")
def binding_certificate(spark, d):
    found = binding.index({"customer": table(spark, d, "customer"), "part": table(spark, d, "part")})
    c = binding.certify(binding.TermPack("segments", {"Machinery": ("machines", "equipment")}), "equipment", found)
    return spark.createDataFrame([(c.status, c.column, c.values[0])], "status string, bound_column string, stored string")


@query("""WITH q AS (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS token FROM benchmark),
d AS (SELECT page_id, regexp_extract_all(lower(coalesce(url, '')), '[\\p{L}\\p{N}_]+') AS tokens FROM pages),
s AS (SELECT COUNT(*) AS n, AVG(len(tokens)) AS avgdl FROM d), t AS (SELECT page_id, len(tokens) AS dl, unnest(tokens) AS token FROM d),
tf AS (SELECT page_id, dl, token, COUNT(*) AS tf FROM t GROUP BY ALL), df AS (SELECT token, COUNT(*) AS df FROM tf GROUP BY 1), qt AS (SELECT item_id, token, COUNT(*) AS times FROM q GROUP BY ALL)
SELECT item_id, page_id, ROUND(SUM(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))), 6) AS score FROM qt JOIN tf USING (token) JOIN df USING (token), s GROUP BY 1, 2""")
def retrieval_bm25(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    out = retrieval.bm25(pages, table(spark, d, "benchmark"), "page_id", "url", "item_id", "text")
    return out.select("item_id", "page_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, ROUND(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 0)), 9) AS cosine FROM embeddings")
def retrieval_cosine(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("asked")).limit(1)
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("asked")), 9).alias("cosine"))


@query()
def retrieval_bm25_documents(spark, d):
    out = retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return out.select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query()
def retrieval_cosine_queries(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    return retrieval.cosines(e, asked, "vec_id", "embedding", "query_id", "asked").withColumn("cosine", F.round("cosine", 9))


@query()
def retrieval_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(retrieval.chunks(F.col("text"))).alias("chunk_index", "chunk"))


@query("SELECT doc_id, regexp_matches(text, '(?i)\\b[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{2,}\\b') AS has_email FROM documents")
def pii_email_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(pii.VALUES["email"]).alias("has_email"))


@query()
def pii_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(pii.cards(F.col("text"))).alias("cards"), *[F.regexp_count("text", F.lit(p)).alias(k) for k, p in pii.VALUES.items() if k != "card"])


from . import cases  # noqa: E402,F401  (registers its queries)
