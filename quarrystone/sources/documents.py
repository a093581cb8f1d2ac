"""Documents as rows of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.retrieval import chunks, hashed_vector


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of text files; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.expr("decode(content, 'UTF-8')").alias("text"))


def chunk_table(docs: DataFrame, id_col: str, text: str = "text", size: int = 800) -> DataFrame:
    """(id, chunk_index, text, vector) of every chunk of every document."""
    parts = docs.select(F.col(id_col), F.posexplode(chunks(F.col(text), size)).alias("chunk_index", "text"))
    return parts.withColumn("vector", hashed_vector(F.col("text")))
