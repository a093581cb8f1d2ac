"""Incremental ingest with half-open watermark intervals, atomic visibility and counted late rows.

Each batch is the rows with low < watermark <= high. It becomes visible only when the ledger commits its part, after
all assertions held. Rows that no batch claims (null watermark, at or below the mark but not visible) are quarantined
by identity, never dropped. The same step runs as a plain loop or inside a structured stream's ``foreachBatch``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import quote

#: Rows that the k-th watermark is picked from at once, and values that cut a larger range.
PICK, CUTS = 20_000, 64


@dataclass(frozen=True)
class SourceSpec:
    name: str
    frame: Callable[[], DataFrame]
    key: tuple[str, ...]
    watermark: str


class BatchRejected(Exception):
    """A batch failed an assertion; nothing of it is visible."""


@dataclass
class Ledger:
    """Committed parts and marks as one JSON file, replaced whole; the last committed mark counts."""

    spark: SparkSession
    root: str
    state: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        jvm = self.spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        p = self._jpath(f"{self.root}/ledger.json")
        if self._fs.exists(p):
            stream = self._fs.open(p)
            self.state = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()

    def _source(self, name: str) -> dict:
        return self.state.setdefault(name, {"commits": [], "quarantine": []})

    def _save(self) -> None:
        part, target = self._jpath(f"{self.root}/.ledger-{uuid.uuid4().hex}"), self._jpath(f"{self.root}/ledger.json")
        out = self._fs.create(part, True)
        out.write(json.dumps(self.state).encode())
        out.close()
        sc = self.spark.sparkContext
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = sc._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(part), self._fs.makeQualified(target), options)

    def commit(self, name: str, part: str, mark: str, rows: int) -> None:
        self._source(name)["commits"].append({"part": part, "mark": mark, "rows": rows})
        self._save()

    def commit_quarantine(self, name: str, part: str, rows: int) -> None:
        self._source(name)["quarantine"].append({"part": part, "rows": rows})
        self._save()

    def mark(self, name: str) -> str | None:
        commits = self._source(name)["commits"]
        return commits[-1]["mark"] if commits else None

    def visible_parts(self, name: str) -> list[str]:
        return [c["part"] for c in self._source(name)["commits"]]

    def quarantine_parts(self, name: str) -> list[str]:
        return [c["part"] for c in self._source(name)["quarantine"]]


def _same(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> Column:
    """Null-safe equality of columns of two frames."""
    return reduce(and_, [a[quote(c)].eqNullSafe(b[quote(c)]) for c in columns])


def visible(ledger: Ledger, spec: SourceSpec) -> DataFrame:
    """What readers see: committed parts only."""
    parts = ledger.visible_parts(spec.name)
    return ledger.spark.read.schema(spec.frame().schema).parquet(*parts) if parts else spec.frame().limit(0)


def quarantined(ledger: Ledger, spec: SourceSpec) -> DataFrame:
    parts = ledger.quarantine_parts(spec.name)
    return ledger.spark.read.parquet(*parts) if parts else spec.frame().limit(0).withColumn("_reason", F.lit(""))


def interval(spec: SourceSpec, ledger: Ledger) -> tuple[DataFrame, Column]:
    """Source rows above the mark, and the watermark column."""
    w = F.col(quote(spec.watermark))
    df = spec.frame().where(w.isNotNull())
    low = ledger.mark(spec.name)
    return (df if low is None else df.where(w > F.lit(low).cast(df.schema[spec.watermark].dataType))), w


def kth(df: DataFrame, w: Column, k: int) -> str | None:
    """The k-th smallest value of ``w``, null ones left out, as text; None where there are fewer.

    Ranges between a few sampled values are counted, and the one that holds the k-th is cut again until it has PICK rows or is one
    value, so the driver never gets more than that. The sample only says where to cut; every row is counted.
    """
    rows = df.select(w.alias("w")).where("w is not null")
    kind, n = rows.schema["w"].dataType, rows.count()
    if not 0 < k <= n:
        return None
    while n > PICK:
        # the bounds travel as text, as marks do, and are compared as what that text means
        some = rows.sample(min(1.0, PICK / 4 / n)).select(F.col("w").cast("string").cast(kind).alias("w")).agg(F.array_sort(F.collect_set("w")).cast("array<string>")).first()[0]
        cuts = some[:: max(1, -(-len(some) // CUTS))]
        if not cuts:
            continue
        bounds, place = [F.lit(c).cast(kind) for c in cuts], None
        for i in range(len(cuts)):  # 2 i: below cut i; 2 i + 1: the cut itself
            below, at = F.col("w") < bounds[i], F.col("w") == bounds[i]
            place = F.when(below, 2 * i).when(at, 2 * i + 1) if place is None else place.when(below, 2 * i).when(at, 2 * i + 1)
        counts = dict(rows.groupBy(place.otherwise(2 * len(cuts)).alias("at")).count().collect())
        for at in range(2 * len(cuts) + 1):
            if k <= counts.get(at, 0):
                break
            k -= counts.get(at, 0)
        else:
            return None
        if at % 2:
            return cuts[at // 2]
        if counts[at] == n:  # no text says what lies between
            break
        if at:
            rows = rows.where(F.col("w") > bounds[at // 2 - 1])
        if at < 2 * len(cuts):
            rows = rows.where(F.col("w") < bounds[at // 2])
        n = counts[at]
    return rows.orderBy("w").offset(k - 1).limit(1).select(F.col("w").cast("string")).first()[0]


def next_high(spec: SourceSpec, ledger: Ledger, batch_size: int | None) -> str | None:
    """The upper bound of the next batch: the batch_size-th watermark, or the largest; ties are never split."""
    df, w = interval(spec, ledger)
    if batch_size:
        high = kth(df, w, batch_size)
        if high is not None:
            return high
    return df.agg(F.max(w).cast("string")).first()[0]


def ingest_batch(spec: SourceSpec, ledger: Ledger, batch_size: int | None = None) -> int:
    """Land and commit one batch; returns its rows, 0 when there is nothing new. Raises ``BatchRejected``."""
    high = next_high(spec, ledger, batch_size)
    if high is None:
        return 0
    df, w = interval(spec, ledger)
    batch = df.where(w <= F.lit(high).cast(df.schema[spec.watermark].dataType))
    part = f"{ledger.root}/{spec.name}/part-{uuid.uuid4().hex}"
    batch.write.parquet(part)
    landed = ledger.spark.read.schema(spec.frame().schema).parquet(part)
    rows = _assert(spec, ledger, batch, landed, high)
    ledger.commit(spec.name, part, high, rows)
    return rows


def _assert(spec: SourceSpec, ledger: Ledger, batch: DataFrame, landed: DataFrame, high: str) -> int:
    w, kind = F.col(quote(spec.watermark)), landed.schema[spec.watermark].dataType
    null_key = reduce(lambda a, b: a | b, [F.col(quote(k)).isNull() for k in spec.key])
    low = ledger.mark(spec.name)
    outside = (w > F.lit(high).cast(kind)) | (F.lit(False) if low is None else w <= F.lit(low).cast(kind)) | w.isNull()
    got = landed.agg(F.count("*").alias("n"), F.count(F.when(null_key, 1)).alias("nulls"), F.count(F.when(outside, 1)).alias("outside")).first()
    problems = []
    if got.nulls:
        problems.append(f"{got.nulls} rows with a null key")
    if got.n != batch.count():
        problems.append("row count changed while landing")
    if not landed.groupBy(*[quote(k) for k in spec.key]).count().where("count > 1").isEmpty():
        problems.append("a key occurs twice in the batch")
    if got.outside:
        problems.append("rows outside the interval")
    if ledger.visible_parts(spec.name):
        seen = visible(ledger, spec)
        if not landed.join(seen, _same(landed, seen, spec.key), "left_semi").isEmpty():
            problems.append("a key is visible already")
    if problems:
        raise BatchRejected("; ".join(problems))
    return got.n


def sweep(spec: SourceSpec, ledger: Ledger) -> int:
    """Quarantine, once each, source rows that no batch will claim; returns how many are new."""
    w, mark = F.col(quote(spec.watermark)), ledger.mark(spec.name)
    df = spec.frame()
    late = F.lit(False) if mark is None else w <= F.lit(mark).cast(df.schema[spec.watermark].dataType)
    rows = df.where(w.isNull() | late).withColumn("_reason", F.when(w.isNull(), "null_watermark").when(w == F.lit(mark).cast(df.schema[spec.watermark].dataType), "tied_at_mark").otherwise("below_mark"))
    identity = (*spec.key, spec.watermark)
    for known in (visible(ledger, spec), quarantined(ledger, spec)):
        rows = rows.join(known, _same(rows, known, identity), "left_anti")
    part = f"{ledger.root}/{spec.name}/quarantine-{uuid.uuid4().hex}"
    rows.write.parquet(part)
    n = ledger.spark.read.parquet(part).count()
    if n:
        ledger.commit_quarantine(spec.name, part, n)
    return n


def run(spec: SourceSpec, ledger: Ledger, batch_size: int | None = None, max_batches: int | None = None) -> tuple[int, int]:
    """Drain the source: (rows committed, rows quarantined). A rejected batch stops the drain after a sweep, then raises."""
    total, n = 0, 0
    try:
        while (max_batches is None or n < max_batches) and (rows := ingest_batch(spec, ledger, batch_size)):
            total, n = total + rows, n + 1
    finally:
        swept = sweep(spec, ledger)
    return total, swept


def stream(spec: SourceSpec, ledger: Ledger, ticks: DataFrame, checkpoint: str, batch_size: int | None = None):
    """The same drain as a structured stream: every micro-batch of ``ticks`` runs one; available data only."""
    def step(_: DataFrame, __: int) -> None:
        run(spec, ledger, batch_size)

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
