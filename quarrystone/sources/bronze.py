"""Landing raw rows: CSV text and SQL rows with provenance, names that never overwrite, exact declared typing."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalar import quote, safe_stem
from .lake import Lake

REGISTRY = "bronze._ingest_registry"
REGISTRY_SCHEMA = "table_name string, filename string, sha256 string, ingest_id string, row_count long, truncated boolean, extracted_at timestamp, source_kind string, untyped_numeric array<string>, space_id string"
DEFAULT_MAX_ROWS = 500_000
#: Source catalog types and what a proven column becomes; zoned times stay text.
SOURCE_TYPES = {
    "int": "int", "integer": "int", "smallint": "int", "tinyint": "int", "mediumint": "int", "bigint": "bigint", "bit": "boolean",
    "bool": "boolean", "boolean": "boolean", "float": "double", "real": "double", "double": "double", "double precision": "double",
    "date": "date", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "smalldatetime": "timestamp_ntz", "timestamp": "timestamp_ntz",
    "timestamp without time zone": "timestamp_ntz", "money": "decimal(19,4)", "smallmoney": "decimal(19,4)",
}


@dataclass(frozen=True)
class IngestReceipt:
    table: str | None
    ingest_id: str
    row_count: int = 0
    columns: tuple[str, ...] = ()
    quarantine_reason: str | None = None
    truncated: bool = False
    untyped_numeric: tuple[str, ...] = field(default=())


def ingests(lake: Lake) -> DataFrame:
    """Every ingest there was, one row each."""
    return lake.read(REGISTRY) if lake.exists(REGISTRY) else lake.spark.createDataFrame([], REGISTRY_SCHEMA)


def registry(lake: Lake) -> DataFrame:
    """The last ingest of each table."""
    log = ingests(lake)
    last = log.groupBy("table_name").agg(F.max(F.struct("extracted_at", *[c for c in log.columns if c not in ("table_name", "extracted_at")])).alias("r"))
    return last.select("table_name", "r.*").select(*log.columns)


def _register(lake: Lake, row: dict) -> None:
    lake.append(REGISTRY, lake.spark.createDataFrame([tuple(row.get(f.split()[0]) for f in REGISTRY_SCHEMA.split(", "))], REGISTRY_SCHEMA))


def claim_name(lake: Lake, stem: str, filename: str) -> str:
    """A free table name: the same file keeps its own, another file whose name folds to the same gets a suffix."""
    base, n = safe_stem(stem), 1
    near = registry(lake).where(F.col("table_name").rlike(rf"^bronze\.{base}(_\d+)?$"))  # only names that could collide come to the driver
    taken = {r.table_name: r.filename for r in near.select("table_name", "filename").collect()}
    while True:
        name = f"bronze.{base}" if n == 1 else f"bronze.{base}_{n}"
        if taken.get(name, filename) == filename and (name in taken or not lake.exists(name)):
            return name
        n += 1


def distinct_columns(names: list[str]) -> list[str]:
    """Names that differ without regard to case; later ones get a number, empty ones a place."""
    out, seen = [], set()
    for i, name in enumerate(names):
        base = name or f"column_{i + 1}"
        new, n = base, 2
        while new.lower() in seen:
            new, n = f"{base}_{n}", n + 1
        seen.add(new.lower())
        out.append(new)
    return out


def with_provenance(df: DataFrame, row_number: Column, ref_id: str, ingest_id: str) -> DataFrame:
    source = F.array(F.struct(F.lit(ref_id).alias("ref_id"), row_number.cast("int").alias("row")))
    return df.withColumn("_src", source).withColumn("_ingest_id", F.lit(ingest_id))


def ingest_csv(lake: Lake, filename: str, data: bytes, ref_id: str | None = None, space_id: str | None = None) -> IngestReceipt:
    """Land one CSV upload with inferred types; empty or binary content is quarantined with a reason.

    The bytes, as they came over the wire, are put into the lake's folder and read by Spark's reader; types are inferred from all
    rows. Rows carry their number in the file: record numbers come from their place, before anything is shuffled.
    """
    ingest_id, digest = uuid.uuid4().hex, hashlib.sha256(data).hexdigest()
    reason = "empty_file" if not data.strip() else "not_csv" if b"\0" in data else None
    try:
        text = "" if reason else data.decode("utf-8-sig")
    except UnicodeDecodeError:
        reason = "not_utf8"
    if reason:
        return IngestReceipt(None, ingest_id, quarantine_reason=reason)
    path = lake.put(f"uploads/{ingest_id}.csv", text.replace("\r\n", "\n").replace("\r", "\n").encode())
    return ingest_csv_file(lake, filename, path, ref_id or digest, digest, ingest_id, space_id)


def ingest_csv_file(lake: Lake, filename: str, path: str, ref_id: str, digest: str | None = None, ingest_id: str | None = None, space_id: str | None = None) -> IngestReceipt:
    """Land a CSV file, of any size, that executors can read at ``path``: UTF-8, the first record holds the names, quoted fields may hold line ends."""
    spark, ingest_id = lake.spark, ingest_id or uuid.uuid4().hex
    reader = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("emptyValue", "").option("nullValue", "")
    first = reader.csv(path).limit(1).collect()
    if not first:
        return IngestReceipt(None, ingest_id, quarantine_reason="empty_file")
    columns = distinct_columns([(c or "").strip() for c in first[0]])
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(columns))])
    raw = reader.schema(schema).csv(path)
    # one file is one partition under multiLine, and its ids follow the records: 0 is the record of names
    rows = raw.select(F.monotonically_increasing_id().alias("__row"), *raw.columns).where("__row > 0")
    rows = rows.select("__row", *[F.when(F.col(f"c{i}") != "", F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)])
    staged = f"quarantine._upload_{ingest_id}"
    lake.write(staged, rows)
    table = claim_name(lake, filename.rsplit("/", 1)[-1].rsplit(".", 1)[0], filename)
    df = inferred(lake.read(staged), columns)
    lake.write(table, with_provenance(df, F.col("__row"), ref_id, ingest_id).drop("__row"))
    n = lake.read(table).count()
    _register(lake, {"table_name": table, "filename": filename, "sha256": digest, "ingest_id": ingest_id, "row_count": n, "truncated": False, "extracted_at": datetime.now(timezone.utc), "source_kind": "file", "untyped_numeric": [], "space_id": space_id})
    return IngestReceipt(table, ingest_id, n, tuple(columns))


def inferred(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast each text column to the narrowest type that keeps every value: bigint, double, boolean, date, timestamp, else text."""
    kinds = ["bigint", "double", "boolean", "date", "timestamp_ntz"]
    shapes = {"bigint": r"^\s*[+-]?\d+\s*$", "double": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", "boolean": r"^(?i)(true|false)$", "date": r"^\d{4}-\d{1,2}-\d{1,2}$", "timestamp_ntz": r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d"}
    tests = []
    for i, c in enumerate(columns):
        x = F.col(quote(c))
        for k in kinds:
            tests.append(F.count(F.when(x.isNotNull() & ~(F.coalesce(x.rlike(shapes[k]), F.lit(False)) & x.try_cast(k).isNotNull()), 1)).alias(f"{i}_{k}"))
        tests.append(F.count(x).alias(f"{i}_n"))
    found = df.agg(*tests).first()
    casts = {}
    for i, c in enumerate(columns):
        kind = next((k for k in kinds if found[f"{i}_n"] and not found[f"{i}_{k}"]), None)
        if kind:
            casts[c] = F.col(quote(c)).try_cast(kind)
    return df.withColumns(casts) if casts else df


def write_rows(lake: Lake, table: str, columns: list[str], rows: DataFrame, ref_id: str, ingest_id: str) -> int:
    """Land rows as text with provenance; ``rows`` has a ``__row`` number and the columns in order."""
    names = distinct_columns(columns)
    own = [c for c in rows.columns if c != "__row"]
    df = rows.select("__row", *[F.col(quote(c)).cast("string").alias(n) for c, n in zip(own, names, strict=True)])
    lake.write(table, with_provenance(df, F.col("__row"), ref_id, ingest_id).drop("__row"))
    return lake.read(table).count()


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Row numbers in the order of the given columns, counted per range and added up, so no task sees all rows."""
    spark = df.sparkSession
    parts = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__p", F.spark_partition_id())
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__p", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.withColumn("__i", within).join(F.broadcast(offsets), "__p").withColumn("__row", F.col("__i") + F.col("__before")).drop("__p", "__i", "__before")


def source_type(name: str, precision: int | None = None, scale: int | None = None) -> str | None:
    """The type that a source column may get, or None if it stays text."""
    name = name.lower().split("(")[0].strip()
    if name in ("decimal", "numeric"):
        return f"decimal({precision},{scale or 0})" if precision and precision <= 38 else "bare"
    return SOURCE_TYPES.get(name)


def type_columns(df: DataFrame, declared: dict[str, str]) -> tuple[DataFrame, dict[str, str], list[str], list[str]]:
    """Apply declared types to text columns where every value converts exactly; one pass over the data decides.

    ``bare`` asks for decimal(38, most places seen). Returns the frame, the types given, the columns left as text and
    those of them that were declared numeric.
    """
    tests = []
    for i, (c, kind) in enumerate(declared.items()):
        x = F.col(quote(c))
        if kind == "bare":
            tests.append(F.count(F.when(x.isNotNull() & ~x.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), 1)).alias(f"{i}_bad"))
            tests.append(F.max(F.length(F.substring_index(x, ".", -1)) * x.contains(".").cast("int")).alias(f"{i}_scale"))
        else:
            y = x.try_cast(kind)
            wrong = y.isNull()
            if kind.startswith("decimal") or kind in ("int", "bigint", "double"):
                wrong = wrong | ~F.coalesce(y.cast("decimal(38,18)").eqNullSafe(x.try_cast("decimal(38,18)")), F.lit(False))
            tests.append(F.count(F.when(x.isNotNull() & F.coalesce(wrong, F.lit(True)), 1)).alias(f"{i}_bad"))
    found = df.agg(*tests).first() if tests else None
    given, left, numeric = {}, [], []
    for i, (c, kind) in enumerate(declared.items()):
        if found[f"{i}_bad"]:
            left.append(c)
            if kind == "bare" or kind.startswith("decimal") or kind in ("int", "bigint", "double"):
                numeric.append(c)
        else:
            given[c] = f"decimal(38,{min(found[f'{i}_scale'] or 0, 38)})" if kind == "bare" else kind
    return df.withColumns({c: F.col(quote(c)).try_cast(k) for c, k in given.items()}) if given else df, given, left, numeric


def capped(lake: Lake, table: str, df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> tuple[DataFrame, bool]:
    """At most ``max_rows`` rows and whether there were more; one row too many is asked for to know.

    What the source gives is landed once under ``table`` and read from there: asked again, it may give other rows. Rows are numbered
    by range and the last number beyond the cap goes, so no task sees all.
    """
    lake.write(table, df.limit(max_rows + 1))
    rows = lake.read(table)
    truncated = rows.count() > max_rows
    return (rows.limit(max_rows) if truncated else rows), truncated


def ingest_source(lake: Lake, name: str, df: DataFrame, declared: dict[str, str], order: list[str], max_rows: int = DEFAULT_MAX_ROWS, space_id: str | None = None) -> IngestReceipt:
    """Pull one SQL source table: capped, landed as text with provenance, then typed by proof."""
    ingest_id = uuid.uuid4().hex
    table = claim_name(lake, name, name)
    rows, truncated = capped(lake, f"quarantine._pull_{ingest_id}", df, max_rows)
    if truncated:  # the cut is made once, too
        lake.write(f"quarantine._pull_{ingest_id}", rows)
        rows = lake.read(f"quarantine._pull_{ingest_id}")
    write_rows(lake, table, rows.columns, numbered(rows, order or rows.columns), name, ingest_id)
    typed, _, _, untyped = type_columns(lake.read(table), declared)
    lake.write(table, typed)
    n = lake.read(table).count()
    _register(lake, {"table_name": table, "filename": name, "sha256": None, "ingest_id": ingest_id, "row_count": n, "truncated": truncated, "extracted_at": datetime.now(timezone.utc), "source_kind": "sql", "untyped_numeric": untyped, "space_id": space_id})
    return IngestReceipt(table, ingest_id, n, tuple(rows.columns), truncated=truncated, untyped_numeric=tuple(untyped))


def stamp_watermarks(lake: Lake, df: DataFrame) -> DataFrame:
    """Add when each contributing ingest was extracted, the oldest first: rows name it by ``_ingest_id``."""
    known = ingests(lake).groupBy(F.col("ingest_id").alias("_ingest_id")).agg(F.min("extracted_at").alias("source_watermark"))
    return df.join(known, "_ingest_id", "left")
