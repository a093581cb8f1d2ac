"""Contract-gated promotion from bronze to silver and gold.

All checks of a run are one pass of column expressions; the staged rows are written once, and target, quarantine and
counts are read from that, so a lost executor or a second evaluation cannot split a row's fate.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import quote, spark_type
from ..plans.outcomes import Refusal
from ..sources.lake import Lake
from .contracts import GoldMetric, Pipeline, PromoteReceipt

RECEIPTS = "quarantine._promote_receipts"


def joined_sources(frames: list[DataFrame], join_on: tuple[str, ...]) -> DataFrame:
    """One source, or a left join of two on shared keys: left columns win, lineage is concatenated, matches are flagged."""
    a = frames[0]
    if len(frames) == 1:
        return a.withColumn("_join_matched", F.lit(True))
    extra = [c for c in frames[1].columns if c not in a.columns and c not in join_on]
    b = frames[1].select(*[F.col(quote(k)) for k in join_on], *[F.col(quote(c)) for c in extra], *([F.col("_src").alias("__src")] if "_src" in frames[1].columns else []), F.lit(True).alias("__hit"))
    out = a.join(b, list(join_on), "left").withColumn("_join_matched", F.coalesce("__hit", F.lit(False)))
    if "__src" in out.columns and "_src" in out.columns:
        out = out.withColumn("_src", F.coalesce(F.concat("_src", "__src"), F.col("_src")))
    return out.drop("__hit", "__src").select(*a.columns, *extra, "_join_matched")


def failure(pipe: Pipeline, dims: dict[str, DataFrame]) -> tuple[Column, Column]:
    """The first failing column of a row and why; columns are looked at in contract order, an unmatched join before all."""
    column = [F.when(~F.col("_join_matched"), F.lit("_join"))]
    reason = [F.when(~F.col("_join_matched"), F.lit("join_unmatched"))]
    for name, c in pipe.columns.items():
        x = F.col(quote(name))
        why = F.lit(None).cast("string")
        if c.allowed_from and c.allowed_from in dims:
            why = F.when(x.isNotNull() & ~F.coalesce(F.col(f"__in_{name}"), F.lit(False)), F.lit("not_in_allowed_from")).otherwise(why)
        if c.minimum is not None:
            why = F.when(x.try_cast("double") < c.minimum, F.lit("below_min")).otherwise(why)
        why = F.when(x.isNotNull() & x.try_cast(spark_type(c.type)).isNull(), F.lit("type_mismatch")).otherwise(why)
        if c.required:
            why = F.when(x.isNull(), F.lit("required_null")).otherwise(why)
        column.append(F.when(why.isNotNull(), F.lit(name)))
        reason.append(why)
    return F.coalesce(*column), F.coalesce(*reason)


def staged(df: DataFrame, pipe: Pipeline, dims: dict[str, DataFrame]) -> DataFrame:
    """Rows with ``_failing_column`` and ``_fail_reason`` (null for rows that pass)."""
    for name, c in pipe.columns.items():
        if c.allowed_from and c.allowed_from in dims:
            dim = dims[c.allowed_from]
            key = name if name in dim.columns else "code"
            known = dim.select(F.col(quote(key)).cast("string").alias("__k")).where("__k is not null").distinct().withColumn(f"__in_{name}", F.lit(True))
            df = df.join(known, F.col(quote(name)).cast("string") == F.col("__k"), "left").drop("__k")
    column, reason = failure(pipe, dims)
    return df.withColumns({"_failing_column": column, "_fail_reason": reason}).drop(*[f"__in_{n}" for n in pipe.columns])


def upsert(old: DataFrame | None, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Old rows whose key is not in the batch, and all rows of the batch; null keys match nothing, repeats in a batch stay."""
    if old is None or not key:
        return new
    keys = new.select(*[quote(k) for k in key]).distinct()
    return old.join(keys, list(key), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def promote(lake: Lake, pipe: Pipeline, run_id: str | None = None) -> PromoteReceipt:
    """Run one pipeline: check, split, upsert, quarantine, and append a receipt."""
    spark, run_id = lake.spark, run_id or uuid.uuid4().hex
    frames = [lake.read(s) for s in pipe.sources]
    dims = {c.allowed_from: lake.read(c.allowed_from) for c in pipe.columns.values() if c.allowed_from and lake.exists(c.allowed_from)}
    source_rows = frames[0].count()  # from the files' footers
    stage = f"quarantine._stage_{run_id}"
    lake.write(stage, staged(joined_sources(frames, pipe.join_on), pipe, dims))
    rows = lake.read(stage)
    rates = [F.count(F.col(quote(c))).alias(f"r{i}") for i, c in enumerate(pipe.not_null_rates)]
    found = rows.groupBy("_fail_reason").agg(F.count("*").alias("n"), *rates).collect()
    by_reason, total = {r._fail_reason: r.n for r in found}, sum(r.n for r in found)
    passed = by_reason.pop(None, 0)
    expectations = {c: (sum(r[f"r{i}"] for r in found) / total if total else 0.0) >= least for i, (c, least) in enumerate(pipe.not_null_rates.items())}

    lineage = [c for c in ("_src", "_ingest_id") if c in rows.columns]
    good = rows.where("_fail_reason is null").select(*[F.col(quote(n)).try_cast(spark_type(c.type)).alias(n) for n, c in pipe.columns.items()], *lineage, F.lit(run_id).alias("_run_id"))
    if pipe.dedup_key:
        lake.upsert(pipe.target, good, pipe.dedup_key)
    else:
        lake.write(pipe.target, good)
    quarantine = f"quarantine.{pipe.target.split('.')[1]}"
    bad = rows.where("_fail_reason is not null").select(*[F.col(quote(n)).cast("string").alias(n) for n in pipe.columns], *lineage, F.col("_failing_column").alias("failing_column"), F.col("_fail_reason").alias("reason"), F.lit(run_id).alias("run_id"))
    if pipe.dedup_key:
        lake.upsert(quarantine, bad, pipe.dedup_key)
    else:
        lake.append(quarantine, bad)
    receipt = PromoteReceipt(run_id, pipe.target, source_rows, passed, sum(by_reason.values()), source_rows - total, by_reason, expectations, source_rows != total)
    _keep(spark, lake, receipt)
    return receipt


def _keep(spark: SparkSession, lake: Lake, r: PromoteReceipt) -> None:
    row = [(r.run_id, r.target, r.source_rows, r.passed, r.quarantined, r.unmatched, r.counts_by_reason, r.expectations, r.reconciled, datetime.now(timezone.utc))]
    lake.append(RECEIPTS, spark.createDataFrame(row, "run_id string, target string, source_rows long, passed long, quarantined long, unmatched long, counts_by_reason map<string,long>, expectations map<string,boolean>, reconciled boolean, recorded_at timestamp"))


def latest_receipt(lake: Lake, target: str) -> dict | None:
    if not lake.exists(RECEIPTS):
        return None
    row = lake.read(RECEIPTS).where(F.col("target") == target).orderBy(F.desc("recorded_at"), F.desc("run_id")).limit(1).collect()
    return row[0].asDict() if row else None


def run_gold(lake: Lake, metric: GoldMetric, target: str, tables: dict[str, DataFrame], chain_verified: Callable[[str], bool]) -> DataFrame | Refusal:
    """Write a metric's result to gold; refused unless it is signed and its ledger chain verifies."""
    if not metric.signed:
        return Refusal("metric_unsigned", metric.name)
    if not chain_verified(metric.ledger_id):
        return Refusal("chain_unverified", metric.name)
    lake.write(target, lake.spark.sql(metric.sql, **tables))
    return lake.read(target)


def infer_contract(df: DataFrame, max_keys: int = 5) -> dict:
    """Types, null rates and candidate keys (single columns, else pairs of the first six) in two passes."""
    columns = [c for c in df.columns if not c.startswith("_")]
    row = df.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(quote(c)).isNull(), 1)).alias(f"null_{i}") for i, c in enumerate(columns)]).first()
    n = row.n
    rates = {c: (row[f"null_{i}"] / n if n else 0.0) for i, c in enumerate(columns)}

    def unique(sets: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        if not sets or not n:
            return []
        counts = df.agg(*[F.countDistinct(F.struct(*[quote(c) for c in s])).alias(str(i)) for i, s in enumerate(sets)]).first()
        return [s for i, s in enumerate(sets) if counts[str(i)] == n and not any(rates[c] for c in s)]

    keys = unique([(c,) for c in columns])
    if not keys:
        first = columns[:6]
        keys = unique([(a, b) for i, a in enumerate(first) for b in first[i + 1 :]])
    return {"rows": n, "types": dict(df.select(*[quote(c) for c in columns]).dtypes), "null_rates": rates, "candidate_keys": keys[:max_keys]}
