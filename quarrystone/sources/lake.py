"""The lake: five schemas of Parquet tables under one folder, swapped in whole, with a registry and checks."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import quote
from ..plans.ontology import key_profile, orphans

SCHEMAS = ("bronze", "silver", "gold", "quarantine", "dim")


#: Parts of a table beyond which an append writes them as one.
MAX_PARTS = 256
#: Buckets of a table that is upserted by key.
BUCKETS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="quarrystone-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Lake:
    """Tables are folders ``root/schema/table/v-<id>``; a pointer file names the parts that readers see.

    A write goes to a new folder and is published by replacing the pointer, so readers see all of it or none, and a
    failed or repeated job leaves the old parts in place. An append adds a part and reads nothing; an upsert rewrites the buckets
    that hold keys of the batch; ``vacuum`` deletes folders that no pointer names. Paths go through Spark's file systems.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, table: str) -> str:
        schema, _, name = table.partition(".")
        if schema not in SCHEMAS or not name or "/" in name or ".." in name:
            raise ValueError(f"{table!r} is not schema.table with a schema of {', '.join(SCHEMAS)}")
        return f"{self.root}/{schema}/{name}"

    def _pointer(self, table: str) -> list[str] | None:
        p = self._path(f"{self._folder(table)}/CURRENT")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def exists(self, table: str) -> bool:
        return self._pointer(table) is not None

    def read(self, table: str) -> DataFrame:
        parts = self._pointer(table)
        if parts is None:
            raise FileNotFoundError(table)
        reader = self.spark.read.option("mergeSchema", len({p.split("/")[0] for p in parts}) > 1)
        return reader.parquet(*[f"{self._folder(table)}/{p}" for p in parts])

    def write(self, table: str, df: DataFrame) -> None:
        """Replace the table's content in one step; ``df`` may read the old version."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self._folder(table)}/{version}")
        self._publish(table, [version])

    def _publish(self, table: str, parts: list[str]) -> None:
        folder = self._folder(table)
        part = self._path(f"{folder}/.CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write("\n".join(parts).encode())
        out.close()
        self._replace(part, self._path(f"{folder}/CURRENT"))

    def _replace(self, part, target) -> None:
        """Rename over the old pointer in one step of the file system."""
        sc = self.spark.sparkContext
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = sc._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(part), self._fs.makeQualified(target), options)

    def append(self, table: str, df: DataFrame) -> None:
        """Add a part; missing columns are null. Types of columns that both have must be the same."""
        parts = self._pointer(table) or []
        if parts:
            old = dict(self.read(table).dtypes)
            if clash := [c for c, t in df.dtypes if old.get(c, t) != t]:
                raise ValueError(f"{table}: other types for {', '.join(clash)}")
        if len(parts) >= MAX_PARTS:
            self.write(table, self.read(table).unionByName(df, allowMissingColumns=True))
            return
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self._folder(table)}/{version}")
        self._publish(table, [*parts, version])

    def upsert(self, table: str, df: DataFrame, key: tuple[str, ...], buckets: int = BUCKETS) -> None:
        """Replace the rows whose key is in ``df`` by its rows; null keys match nothing and repeats in ``df`` stay.

        The table lies in buckets by the hash of the key, and only buckets that hold a key of ``df`` are read and written anew. A table
        written otherwise is put into buckets once. ``df`` is read more than once, so it should be stored.
        """
        parts, version = self._pointer(table) or [], f"v-{uuid.uuid4().hex}"
        columns = [F.col(quote(k)) for k in key]
        bucket = F.pmod(F.hash(*[c.cast("string") for c in columns], F.lit(len(key))), F.lit(buckets))
        new = df.withColumn("__bucket", bucket)
        if parts and all("/__bucket=" in p for p in parts):
            touched = {r[0] for r in new.select("__bucket").distinct().collect()}
            stale = [p for p in parts if int(p.rpartition("=")[2]) in touched]
            kept = [p for p in parts if p not in set(stale)]
        else:
            stale, kept = parts, []
        if stale:
            old = self.spark.read.option("mergeSchema", True).parquet(*[f"{self._folder(table)}/{p}" for p in stale]).withColumn("__bucket", bucket)
            old = old.join(df.select(*columns).distinct(), list(key), "left_anti").select(*old.columns)
            new = old.unionByName(new, allowMissingColumns=True)
        folder = f"{self._folder(table)}/{version}"
        new.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        found = sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(folder)) if x.getPath().getName().startswith("__bucket="))
        if not found and not kept:
            self.write(table, df)
            return
        self._publish(table, kept + [f"{version}/{x}" for x in found])

    def vacuum(self, table: str) -> int:
        """Delete version folders of a table that its pointer does not name; returns how many. No reader may be on an old one."""
        live = {p.split("/")[0] for p in self._pointer(table) or []}
        old = [x.getPath() for x in self._fs.listStatus(self._path(self._folder(table))) if x.getPath().getName().startswith("v-") and x.getPath().getName() not in live]
        for p in old:
            self._fs.delete(p, True)
        return len(old)

    def put(self, name: str, data: bytes) -> str:
        """Keep an upload's bytes in the lake's folder, where executors read them; returns the path."""
        path = f"{self.root}/{name}"
        out = self._fs.create(self._path(path), True)
        try:
            for at in range(0, len(data), 1 << 22):
                out.write(data[at : at + (1 << 22)])
        finally:
            out.close()
        return path

    def tables(self, schema: str | None = None) -> list[str]:
        out = []
        for s in [schema] if schema else SCHEMAS:
            p = self._path(f"{self.root}/{s}")
            if self._fs.exists(p):
                out += [f"{s}.{x.getPath().getName()}" for x in self._fs.listStatus(p) if self.exists(f"{s}.{x.getPath().getName()}")]
        return sorted(out)

    def promote_targets(self) -> list[str]:
        return [t for t in self.tables() if t.split(".")[0] in ("silver", "gold")]

    def preview(self, table: str, limit: int = 50, offset: int = 0, order: tuple[str, ...] = (), allowed: set[str] | None = None) -> DataFrame:
        """Some rows of an allowed table, in the order of the given columns (all columns unless given)."""
        if allowed is not None and table not in allowed or not self.exists(table):
            raise PermissionError(f"{table!r} cannot be previewed")
        df = self.read(table)
        keys = order or tuple(c for c, t in df.dtypes if not t.startswith(("map", "array", "struct")))
        return df.orderBy(*[F.col(quote(c)).asc_nulls_last() for c in keys]).offset(offset).limit(limit)


@dataclass(frozen=True)
class SyncResult:
    copied: tuple[str, ...]
    skipped: tuple[tuple[str, str], ...]


def sync_bronze(source: Lake, serving: Lake) -> SyncResult:
    """Copy every bronze table to the serving lake; a table that cannot be read is reported, the others go on."""
    copied, skipped = [], []
    for t in source.tables("bronze"):
        try:
            serving.write(t, source.read(t))
            copied.append(t)
        except (AnalysisException, FileNotFoundError) as e:
            skipped.append((t, type(e).__name__))
    return SyncResult(tuple(copied), tuple(skipped))


def identity_check(source: Lake, serving: Lake) -> DataFrame:
    """Bronze tables that are missing from the serving lake or differ in row count."""
    rows = []
    for t in source.tables("bronze"):
        n = source.read(t).count()
        m = serving.read(t).count() if serving.exists(t) else None
        if n != m:
            rows.append((t, n, m, "missing" if m is None else "row_count"))
    return source.spark.createDataFrame(rows, "table string, source_rows long, serving_rows long, problem string")


def validate(tables: dict[str, DataFrame], primary_keys: dict[str, list[str]], foreign_keys: list[tuple[str, list[str], str, list[str]]]) -> list[tuple[str, str, bool, str]]:
    """(check, subject, passed, detail) for row_count, pk_null, pk_unique, fk_intact and cardinality."""
    out = []
    for name, df in tables.items():
        key = primary_keys.get(name)
        if key:
            n, distinct, nulls = key_profile(df, key)
            out += [("row_count", name, n > 0, str(n)), ("pk_null", name, nulls == 0, str(nulls)), ("pk_unique", name, n == distinct, f"{n} rows, {distinct} keys")]
        else:
            out.append(("row_count", name, not df.isEmpty(), ""))
    for child, cc, parent, pc in foreign_keys:
        lost = orphans(tables[child], tables[parent], cc, pc).agg(F.sum("rows").alias("n")).first().n or 0
        subject = f"{child}({', '.join(cc)}) -> {parent}({', '.join(pc)})"
        out.append(("fk_intact", subject, lost == 0, str(lost)))
        worst = tables[parent].where(~reduce(or_, [F.col(quote(c)).isNull() for c in pc])).groupBy(*[quote(c) for c in pc]).count().agg(F.max("count").alias("m")).first().m or 0
        out.append(("cardinality", subject, worst <= 1, "many_to_one" if worst <= 1 else f"many_to_many, up to {worst}"))
    return out
