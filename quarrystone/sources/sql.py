"""SQL sources through Spark's JDBC reader. Drivers are found on the session's class path; nothing connects at import."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bronze
from .lake import Lake

#: JDBC addresses, and the schemas of each system that hold no user tables.
SYSTEMS = {
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", ("sys", "INFORMATION_SCHEMA")),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", ("mysql", "sys", "performance_schema", "information_schema")),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", ("pg_catalog", "information_schema")),
}
KEYS = """SELECT tc.constraint_type, tc.constraint_name, kcu.table_schema, kcu.table_name, kcu.column_name, kcu.ordinal_position,
ccu.table_name AS parent_table, ccu.column_name AS parent_column FROM information_schema.table_constraints tc
JOIN information_schema.key_column_usage kcu ON tc.constraint_name = kcu.constraint_name AND tc.table_schema = kcu.table_schema
LEFT JOIN information_schema.constraint_column_usage ccu ON tc.constraint_name = ccu.constraint_name AND tc.constraint_type = 'FOREIGN KEY'
WHERE tc.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY')"""


@dataclass(frozen=True)
class Source:
    kind: str
    host: str = ""
    port: int = 0
    database: str = ""
    user: str = ""
    password: str = ""
    partition_column: str | None = None
    partitions: int = 32


class SqlSource:
    """Reads go through ``reader(query)``, or ``reader(query, (column, low, high))`` for one in parallel ranges; by default JDBC."""

    def __init__(self, spark: SparkSession, source: Source, reader: Callable[..., DataFrame] | None = None):
        if source.kind not in SYSTEMS:
            raise ValueError(f"unknown source kind {source.kind!r}; known: {', '.join(SYSTEMS)}")
        self.spark, self.source = spark, source
        self.read = reader or self._jdbc

    def _jdbc(self, query: str, split: tuple[str, object, object] | None = None) -> DataFrame:
        s = self.source
        url = SYSTEMS[s.kind][0].format(host=s.host, port=s.port, database=s.database)
        reader = self.spark.read.format("jdbc").options(url=url, user=s.user, password=s.password, fetchsize="10000")
        if split is None:
            return reader.options(query=query).load()
        column, low, high = split
        return reader.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(s.partitions)).load()

    def whole(self, table: str, columns: list[str]) -> DataFrame:
        """A table in parallel reads by ranges of the partition column, where the table has it and it has values."""
        c, query = self.source.partition_column, f"SELECT * FROM {table}"
        if c not in columns or self.source.partitions < 2:
            return self.read(query)
        ends = self.read(f"SELECT MIN({c}) AS low, MAX({c}) AS high FROM {table}").first()
        return self.read(query) if ends is None or ends[0] is None else self.read(query, (c, ends[0], ends[1]))

    def tables(self) -> list[str]:
        df = self.read("SELECT table_schema, table_name, table_type FROM information_schema.tables")
        hidden = [h.lower() for h in SYSTEMS[self.source.kind][1]]
        rows = df.where((F.col("table_type") == "BASE TABLE") & ~F.lower("table_schema").isin(hidden)).orderBy("table_schema", "table_name")
        return [f"{r.table_schema}.{r.table_name}" for r in rows.select("table_schema", "table_name").collect()]

    def keys(self) -> dict[str, list]:
        """Declared primary keys by table and foreign keys as rows for ``Ontology.from_manifest``."""
        primary: dict[str, list[str]] = {}
        foreign = []
        for r in self.read(KEYS).orderBy("constraint_name", "ordinal_position").collect():
            if r.constraint_type == "PRIMARY KEY":
                primary.setdefault(r.table_name, []).append(r.column_name)
            else:
                foreign.append({"name": r.constraint_name, "child": r.table_name, "child_column": r.column_name, "parent": r.parent_table, "parent_column": r.parent_column, "position": r.ordinal_position})
        return {"primary": primary, "foreign": foreign}

    def column_types(self, table: str) -> dict[str, str]:
        schema, _, name = table.rpartition(".")
        df = self.read("SELECT table_schema, table_name, column_name, data_type, numeric_precision, numeric_scale FROM information_schema.columns")
        rows = df.where((F.col("table_name") == name) & ((F.col("table_schema") == schema) if schema else F.lit(True))).collect()
        found = {r.column_name: bronze.source_type(r.data_type, r.numeric_precision, r.numeric_scale) for r in rows}
        return {c: t for c, t in found.items() if t}

    def preview(self, table: str, limit: int = 20) -> DataFrame:
        return self.read(f"SELECT * FROM {table}").limit(limit)

    def pull(self, lake: Lake, table: str, max_rows: int = bronze.DEFAULT_MAX_ROWS) -> bronze.IngestReceipt:
        known = self.column_types(table)
        df = self.whole(table, list(known))
        df = df.toDF(*bronze.distinct_columns(df.columns))
        types = {c: t for c, t in known.items() if c in df.columns}
        order = self.keys()["primary"].get(table.rpartition(".")[2], [])
        return bronze.ingest_source(lake, table, df, types, order, max_rows)

    def pull_all(self, lake: Lake, max_rows: int = bronze.DEFAULT_MAX_ROWS) -> dict[str, bronze.IngestReceipt | str]:
        """Every table; one that fails is named with its error class and the rest go on."""
        out: dict[str, bronze.IngestReceipt | str] = {}
        for t in self.tables():
            try:
                out[t] = self.pull(lake, t, max_rows)
            except Exception as e:  # noqa: BLE001  a driver's error, a value that does not fit: the others go on
                out[t] = type(e).__name__
        return out
