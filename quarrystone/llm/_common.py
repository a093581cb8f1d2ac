"""Shared storage, Arrow helpers and distributed connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local session, as in tests, may do without, a cluster may not."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="quarrystone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_path`` through Spark's own file system layer."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(hadoop).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of ``stored`` frames that no later result reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def crc_mod(col: str, n: int) -> "F.Column":
    """crc32 of the id's decimal text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker keeps between tasks, by operator module.
_caches: dict[str, dict] = {}


def cache_of(module: str) -> dict:
    return _caches.setdefault(module, {})


def forget_others(module: str) -> None:
    for other in set(_caches) - {module}:
        del _caches[other]


def lean(run):
    """A worker function that drops what other operators kept, and gives freed memory back when its task ends: Spark keeps
    workers while stages follow each other."""

    @functools.wraps(run)
    def task(batches):
        forget_others(run.__module__)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts are long: bound the rows of an Arrow batch, so that a worker and its executor hold a few MB of text at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def with_text(docs: DataFrame, text: str, added: list[str], keep_text: bool = True) -> tuple[DataFrame, list[str], int]:
    """What is sent to workers (the text once), the columns that come back before ``added``, and the text's place."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in added if c != text])
    kept = [c for c in docs.columns if keep_text or c != text]
    if keep_text:
        return docs, kept, kept.index(text)
    return docs.select(*kept, F.col(text).alias("__t")), kept, len(kept)


def slices(batch: pa.RecordBatch, text: str | int, limit: int = 1 << 20):
    """Cut a batch into runs of rows whose text holds about ``limit`` bytes, so working arrays stay bounded."""
    col = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
    sizes = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64)
    if not len(sizes):
        return
    run = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges(src, dst)`` as (node, component), component the smallest node.

    Every round each root with an edge to a smaller root hooks onto the smallest such one, hooks are
    flattened by pointer jumping, and edges are rewritten onto roots, so the edge table shrinks until it is
    empty. All state lives in tables of the shared folder. Null ends and self loops are ignored; no edges
    give an empty result.
    """
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()
    e = stored(e, f"{tag}-edges")
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    parent = stored(nodes.withColumn("component", F.col("node")), f"{tag}-parent")
    while not e.isEmpty():
        hook = stored(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), f"{tag}-hook")
        while True:
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("up"))
            flat = hook.join(up, "to", "left")
            if flat.where("up is not null").isEmpty():
                break
            new = stored(flat.select("node", F.coalesce("up", "to").alias("to")), f"{tag}-hook")
            discard(hook)
            hook = new
        to_root = hook.select(F.col("node").alias("component"), "to")
        new_parent = stored(parent.join(to_root, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"{tag}-parent")
        new_e = e
        for c in ("a", "b"):
            new_e = new_e.join(hook.select(F.col("node").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        new_e = stored(new_e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{tag}-edges")
        discard(parent, e, hook)
        parent, e = new_parent, new_e
    return parent


def groups(batches):
    """Tables of one group each, from batches sorted by their first column; a group that crosses batches is joined."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def local_roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of n positions reaches by links between positions a and b."""
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            return low
        low = new
