"""The warehouse model: a small stock, shipment and movement schema with its measures, on any frames of that shape."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .ontology import Ontology
from .outcomes import CompiledQuery, Refusal

#: Schemas and rows of the sample warehouse.
SCHEMAS = {
    "locations": "location_id string, name string, capacity_kg double, current_load_kg double, location_code string, is_cold_storage boolean, cctv_camera_id string",
    "suppliers": "supplier_id string, supplier_name string, country string, lead_time_days int, risk_score double, last_audit_date date",
    "inventory": "sku string, location_id string, quantity_kg double, reorder_level_kg double, unit_cost_myr double, supplier_id string, category string, expiry_date date",
    "shipments": "shipment_id string, sku string, destination_location_id string, quantity_kg double, status string, cost_myr double",
    "alerts": "alert_id string, severity string, location_id string, message string, resolved boolean",
    "transactions": "txn_id string, sku string, location_id string, txn_type string, quantity_kg double, unit_cost_myr double, ts timestamp_ntz",
}
_DAY, _TIME = datetime.date.fromisoformat, datetime.datetime.fromisoformat
ROWS = {
    "locations": [
        ("WH-A", "Warehouse A", 100000.0, 72000.0, "WH-A", False, "CAM-A-01"), ("WH-B", "Warehouse B", 80000.0, 45000.0, "WH-B", False, "CAM-B-01"),
        ("WH-C", "Warehouse C", 60000.0, 58000.0, "WH-C", True, "CAM-C-01"), ("WH-D", "Warehouse D", 120000.0, 31000.0, "WH-D", False, "CAM-D-01"),
        ("WH-E", "Warehouse E", 90000.0, 88000.0, "WH-E", False, "CAM-E-01"),
    ],
    "suppliers": [
        ("SUP-01", "Northshore Materials", "MY", 7, 0.22, _DAY("2025-01-01")), ("SUP-02", "Peninsula Polymers", "SG", 12, 0.41, _DAY("2026-08-01")),
        ("SUP-03", "Delta Logistics Co", "MY", 5, 0.18, _DAY("2024-06-01")), ("SUP-04", "Orbit Packing", "TH", 9, 0.55, _DAY("2026-09-01")),
    ],
    "inventory": [
        ("RS622XK", "WH-A", 1200.0, 500.0, 4.50, "SUP-01", "RAW", None), ("RS622XKR", "WH-A", 80.0, 200.0, 5.20, "SUP-01", "RAW", None),
        ("SKU-ALPHA", "WH-B", 3400.0, 1000.0, 2.10, "SUP-02", "PACKAGING", None), ("SKU-BETA", "WH-B", 900.0, 400.0, 8.75, "SUP-03", "PACKAGING", None),
        ("SKU-GAMMA", "WH-C", 150.0, 300.0, 12.00, "SUP-04", "CHEMICALS", _DAY("2020-01-15")), ("SKU-DELTA", "WH-D", 60.0, 250.0, 6.40, "SUP-02", "PARTS", None),
        ("SKU-EPSILON", "WH-E", 2100.0, 800.0, 3.25, "SUP-03", "PARTS", None),
    ],
    "shipments": [
        ("SH-100", "SKU-ALPHA", "WH-B", 400.0, "in_transit", 820.0), ("SH-101", "SKU-BETA", "WH-B", 120.0, "delivered", 310.0), ("SH-102", "RS622XK", "WH-A", 250.0, "delayed", 540.0),
        ("SH-103", "SKU-GAMMA", "WH-C", 80.0, "in_transit", 190.0), ("SH-104", "SKU-DELTA", "WH-D", 200.0, "delayed", 460.0),
    ],
    "alerts": [
        ("AL-1", "high", "WH-C", "Load near capacity", False), ("AL-2", "medium", "WH-A", "SKU RS622XKR below reorder", False), ("AL-3", "low", "WH-B", "Inbound delayed 1 day", True),
        ("AL-4", "high", "WH-E", "Load near capacity", False), ("AL-5", "medium", "WH-D", "SKU-DELTA below reorder", False),
    ],
    "transactions": [
        ("T001", "RS622XK", "WH-A", "outbound", 400.0, 4.50, _TIME("2026-06-02 10:00:00")), ("T002", "RS622XK", "WH-A", "outbound", 350.0, 4.50, _TIME("2026-06-15 11:00:00")),
        ("T003", "RS622XKR", "WH-A", "outbound", 200.0, 5.20, _TIME("2026-06-20 09:00:00")), ("T004", "SKU-ALPHA", "WH-B", "outbound", 1500.0, 2.10, _TIME("2026-07-01 08:00:00")),
        ("T005", "SKU-ALPHA", "WH-B", "outbound", 800.0, 2.10, _TIME("2026-07-10 14:00:00")), ("T006", "SKU-BETA", "WH-B", "outbound", 600.0, 8.75, _TIME("2026-07-12 16:00:00")),
        ("T007", "SKU-GAMMA", "WH-C", "outbound", 220.0, 12.00, _TIME("2026-07-18 12:00:00")), ("T008", "SKU-BETA", "WH-B", "outbound", 100.0, 8.75, _TIME("2026-07-22 10:00:00")),
        ("T009", "RS622XK", "WH-A", "inbound", 500.0, 4.50, _TIME("2026-07-05 07:00:00")), ("T010", "SKU-ALPHA", "WH-B", "inbound", 2000.0, 2.10, _TIME("2026-07-08 07:00:00")),
        ("T011", "SKU-DELTA", "WH-D", "outbound", 180.0, 6.40, _TIME("2026-07-20 09:00:00")), ("T012", "SKU-EPSILON", "WH-E", "outbound", 900.0, 3.25, _TIME("2026-07-21 11:00:00")),
        ("T013", "SKU-BETA", "WH-B", "outbound", 250.0, 8.75, _TIME("2026-07-23 15:00:00")), ("T014", "RS622XK", "WH-A", "outbound", 120.0, 4.50, _TIME("2026-07-24 10:00:00")),
        ("T015", "SKU-ALPHA", "WH-B", "outbound", 400.0, 2.10, _TIME("2026-07-25 13:00:00")),
    ],
}
AUDIT_DAYS = 90
OUT, IN, LOSS = ("OUT", "outbound"), ("IN", "inbound"), ("WRITE_OFF",)


def sample(spark: SparkSession) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame(ROWS[t], s) for t, s in SCHEMAS.items()}


def warehouse(spark: SparkSession, tables: dict[str, DataFrame], as_of: datetime.date) -> tuple[Ontology, dict[str, str]]:
    """The verified ontology, and grains that the tables cannot give with the reason."""
    o, missing = Ontology(spark, aliases={"product": ["sku", "item"], "location": ["warehouse", "plant"]}), {}
    txn = tables["transactions"].withColumn("day", F.col("ts").cast("date"))
    product = tables["inventory"].groupBy("sku").agg(F.any_value("category").alias("category"))
    lane_start = next((c for c in ("origin_location_id", "from_location_id", "origin_plant_id") if c in tables["shipments"].columns), None)
    for name, df, key in (
        ("transaction", txn, ["txn_id"]), ("day", txn.select("day").where("day is not null").distinct(), ["day"]), ("shipment", tables["shipments"], ["shipment_id"]),
        ("supplier", tables["suppliers"], ["supplier_id"]), ("location", tables["locations"], ["location_id"]), ("alert", tables["alerts"], ["alert_id"]),
        ("lot", tables["inventory"], ["sku", "location_id"]), ("product", product, ["sku"]),
    ):
        o.add_object(name, df, key)
    for name, a, ac, b, bc in (
        ("txn_on_day", "transaction", "day", "day", "day"), ("txn_at_location", "transaction", "location_id", "location", "location_id"), ("txn_of_product", "transaction", "sku", "product", "sku"),
        ("ship_to_location", "shipment", "destination_location_id", "location", "location_id"), ("ship_of_product", "shipment", "sku", "product", "sku"),
        ("lot_at_location", "lot", "location_id", "location", "location_id"), ("lot_from_supplier", "lot", "supplier_id", "supplier", "supplier_id"), ("lot_of_product", "lot", "sku", "product", "sku"),
        ("alert_at_location", "alert", "location_id", "location", "location_id"), ("txn_of_lot", "transaction", "sku", "lot", "sku"),
    ):
        o.add_link(name, a, [ac], b, [bc])
    if "supplier_id" in tables["shipments"].columns:
        o.add_link("ship_from_supplier", "shipment", ["supplier_id"], "supplier", ["supplier_id"])
    if lane_start:
        ends = [lane_start, "destination_location_id"]
        o.add_object("lane", tables["shipments"].select(*ends).na.drop().distinct(), ends)
        o.add_link("ship_on_lane", "shipment", ends, "lane", ends)
        o.add_link("lane_from_plant", "lane", ends[:1], "location", ["location_id"])
        o.add_link("lane_to_plant", "lane", ends[1:], "location", ["location_id"])
    else:
        missing["lane"] = "missing_join: shipments name no origin"
    kind, qty, cost = F.col("txn_type"), F.col("quantity_kg"), F.col("unit_cost_myr")
    o.add_measure("outbound_value_myr", "transaction", lambda: F.round(F.sum(F.when(kind.isin(*OUT), qty * cost).otherwise(0.0)), 2))
    o.add_measure("outbound_kg", "transaction", lambda: F.round(F.sum(F.when(kind.isin(*OUT), qty).otherwise(0.0)), 2))
    o.add_measure("net_movement_kg", "transaction", lambda: F.round(F.sum(F.when(kind.isin(*IN), qty).when(kind.isin(*OUT, *LOSS), -qty).otherwise(0.0)), 2))
    o.add_measure("stock_value_myr", "lot", lambda: F.round(F.sum(qty * cost), 2))
    o.add_measure("shipping_cost_myr", "shipment", lambda: F.round(F.sum("cost_myr"), 2))
    o.add_measure("shipment_count", "shipment", lambda: F.count("*"))
    o.add_measure("sku_count", "product", lambda: F.count("*"))
    o.add_measure("utilisation_pct", "location", lambda: F.round(100.0 * ratio(F.sum("current_load_kg"), F.sum("capacity_kg")), 1), additive=False)
    o.add_measure("below_reorder_lots", "lot", lambda: F.count(F.when((qty < F.col("reorder_level_kg")) & (F.col("reorder_level_kg") > 0), 1)))
    o.add_measure("supplier_rank_score", "supplier", lambda: F.round(F.max("risk_score") * 0.65 + F.max("lead_time_days") / 60.0 * 0.35, 3), additive=False)
    o.add_measure("audit_overdue", "supplier", lambda: F.count(F.when(F.col("last_audit_date") < F.date_sub(F.lit(as_of), AUDIT_DAYS), 1)))
    o.verify()
    return o, missing


def grains(o: Ontology, missing: dict[str, str]) -> list[tuple[str, bool, str]]:
    """Objects that a question may be broken down by, and why others may not."""
    return [(n, True, ", ".join(x.key)) for n, x in sorted(o.objects.items())] + [(n, False, why) for n, why in sorted(missing.items())]


#: Words of the sample questions.
PREDICT = ("predict", "forecast", "will ", "next month", "next year", "project ")
TOPICS = (
    (("capacity", "utilisation", "utilization", "occupancy"), "utilisation_pct", ("location", "name")), (("reorder",), "below_reorder_lots", ("product", "sku")),
    (("freight", "shipping"), "shipping_cost_myr", ("location", "name")), (("stock", "inventory"), "stock_value_myr", ("product", "category")),
    (("risk", "lead time"), "supplier_rank_score", ("supplier", "supplier_name")), (("sold", "sales", "revenue", "outbound"), "outbound_value_myr", ("product", "sku")),
)


def answer(question: str, o: Ontology) -> CompiledQuery | Refusal:
    """Route a question of the sample pack: forecasts are refused, top-n is 1 to 20, exclusions skip ranks."""
    from .questions import rank_window

    q = question.lower()
    if any(w in q for w in PREDICT):
        return Refusal("predictive", "the tables hold the past")
    topic = next((t for t in TOPICS if any(w in q for w in t[0])), None)
    if topic is None:
        return Refusal("unknown_measure", question)
    w = rank_window(q)
    limit = min(20, max(1, w.limit)) if w else None
    return o.compile(topic[1], [topic[2]] if w or " by " in q or " per " in q else [], order_desc=w.descending if w else True, limit=limit, offset=w.offset if w and w.offset else None)
