"""The ontology of the sales tables, used by the registered queries and as an example of declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .ontology import Ontology


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> Column:
    """Sums of doubles depend on their order; decimals do not."""
    return F.col(c).cast("decimal(18,2)")


def revenue() -> Column:
    return (money("l_extendedprice") * (F.lit(1).cast("decimal(18,2)") - money("l_discount"))).cast("decimal(18,4)")


#: Distinct names of objects, keys and tables.
OBJECTS = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "orders": ["o_orderkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"],
}
LINKS = [
    ("line_order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("line_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("line_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("order_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
]
NEIGHBOURS = ("supplier_neighbours", "supplier", "s_nationkey", "customer", "c_nationkey")


def sales(spark: SparkSession, sf_dir: str, neighbours: bool = False) -> Ontology:
    """A verified ontology of the sales tables; ``neighbours`` adds a link that is many-to-many."""
    out = Ontology(spark, aliases={"customer": ["client", "buyer"], "supplier": ["vendor"]})
    for name, key in OBJECTS.items():
        out.add_object(name, table(spark, sf_dir, name), key)
    for name, a, ac, b, bc in LINKS + ([NEIGHBOURS] if neighbours else []):
        out.add_link(name, a, [ac], b, [bc])
    out.add_measure("revenue", "lineitem", lambda: F.sum(revenue()).cast("double"))
    out.add_measure("lines", "lineitem", lambda: F.count("*"))
    out.add_measure("quantity", "lineitem", lambda: F.sum(money("l_quantity")).cast("double"))
    out.add_measure("returned_share", "lineitem", lambda: F.round(ratio(F.sum(F.when(F.col("l_returnflag") == "R", money("l_quantity"))).cast("double"), F.sum(money("l_quantity")).cast("double")), 6), additive=False)
    out.add_measure("order_value", "orders", lambda: F.sum(money("o_totalprice")).cast("double"))
    out.add_measure("open_orders", "orders", lambda: F.count(F.when(F.col("o_orderstatus") == "O", 1)))
    out.add_measure("largest_order", "orders", lambda: F.max("o_totalprice"), additive=False)
    out.add_measure("supplier_balance", "supplier", lambda: F.sum(money("s_acctbal")).cast("double"))
    out.verify()
    return out
