"""Lexical and vector retrieval as DataFrame plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

K1, B, TOP = 1.5, 0.75, 3
#: Vectors of a block, and pairs of a batch, of ``cosines``.
BLOCK, PAIRS = 512, 1 << 16


def tokens(c: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str) -> DataFrame:
    """Okapi BM25 of every query and document that share a token: (query_id, doc_id, score); others score 0 and are left out.

    Only tokens that some query holds are exploded, so the shuffle carries matches, not the corpus. Query tokens count as
    often as they occur.
    """
    asked = queries.select(F.col(query_id).alias("__q"), F.explode(tokens(F.col(query))).alias("token"))
    tokenised = docs.select(F.col(doc_id).alias("__d"), tokens(F.col(text)).alias("tokens"))
    stats = tokenised.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    hits = tokenised.select("__d", F.size("tokens").alias("dl"), F.explode("tokens").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    tf = hits.groupBy("__d", "dl", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "token").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.greatest(F.col("dl"), F.lit(1)) / F.col("avgdl")))
    per_query = asked.groupBy("__q", "token").agg(F.count("*").alias("times"))
    scored = weighted.withColumn("part", part).join(per_query, "token").groupBy("__q", "__d").agg(F.sum(F.col("part") * F.col("times")).alias("score"))
    return scored.where("score > 0").select(F.col("__q").alias(query_id), F.col("__d").alias(doc_id), "score")


def best(scored: DataFrame, query_id: str, doc_id: str, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each query by score, equal scores by document; each task keeps its own best before the shuffle."""
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, vector: str | None = None, asked: str | None = None, top: int = TOP) -> DataFrame:
    """The best documents by cosine of their vectors with the query's; queries that no vector answers are ranked by BM25."""
    lexical = best(bm25(docs, queries, doc_id, text, query_id, query), query_id, doc_id, top).withColumn("by", F.lit("bm25"))
    if vector is None or asked is None:
        return lexical
    pairs = docs.select(doc_id, F.col(vector).alias("__v")).crossJoin(queries.select(query_id, F.col(asked).alias("__a")))
    dense = pairs.select(query_id, doc_id, cosine(F.col("__v"), F.col("__a")).alias("score")).where("score > 0")
    dense = best(dense, query_id, doc_id, top).withColumn("by", F.lit("cosine"))
    return dense.unionByName(lexical.join(dense.select(query_id).distinct(), query_id, "left_anti"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; null where either is zero or they differ in length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(a) == F.size(b), dot / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def _vector_blocks(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Up to BLOCK vectors of equal length a row: their keys, and their numbers as bytes; vectors that are null or hold null are of length -1."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def full(n):
            keys, rows = held.pop(n)
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(kind)), pa.array([n], pa.int32()), pa.array([b"".join(rows)], pa.binary())], ["keys", "n", "raw"])

        for batch in batches:
            kind = batch.column(0).type
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values
                n = -1 if v is None or v.null_count else len(v)
                keys, rows = held.setdefault(n, ([], []))
                keys.append(k)
                if n > 0:
                    rows.append(v.to_numpy().tobytes())
                if len(keys) == BLOCK:
                    yield full(n)
        for n in list(held):
            yield full(n)

    of = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return of.mapInArrow(run, f"keys array<{of.schema['k'].dataType.simpleString()}>, n int, raw binary")


def cosines(docs: DataFrame, queries: DataFrame, doc_id: str, vector: str, query_id: str, asked: str) -> DataFrame:
    """``cosine`` of every query and document, (query_id, doc_id, cosine), by blocks: products are added up dimension by
    dimension in double precision, in the order of ``cosine``, so its values come out. Blocks of both sides are dealt out, so no task or driver holds all vectors.
    """
    tasks = max(1, docs.sparkSession.sparkContext.defaultParallelism)
    left = _vector_blocks(docs, doc_id, vector).repartition(4 * tasks)
    right = _vector_blocks(queries, query_id, asked).select(*[F.col(c).alias(f"q_{c}") for c in ("keys", "n", "raw")]).repartition(tasks)

    def run(batches):
        def added(x, y):
            out, term = np.zeros(np.broadcast_shapes(x[:, :1].shape, y[0].shape)), np.empty(np.broadcast_shapes(x[:, :1].shape, y[0].shape))
            for i in range(x.shape[1]):
                out += np.multiply(x[:, i, None], y[i], out=term)
            return out

        def norms(x):
            out = np.zeros(len(x))
            for i in range(x.shape[1]):
                out += x[:, i] * x[:, i]
            return np.sqrt(out)

        for batch in batches:
            for row in range(batch.num_rows):
                keys, n, raw, q_keys, q_n, q_raw = (batch.column(c)[row] for c in range(6))
                keys, q_keys, n, q_n = keys.values, q_keys.values, n.as_py(), q_n.as_py()
                step = max(1, PAIRS // len(keys))
                for a in range(0, len(q_keys), step):
                    part = q_keys.slice(a, step)
                    value, null = np.zeros((len(part), len(keys))), np.ones((len(part), len(keys)), bool)
                    if n == q_n and n > 0:
                        x = np.frombuffer(q_raw.as_buffer(), np.float64).reshape(-1, n)[a : a + step]
                        y = np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, n)
                        with np.errstate(all="ignore"):
                            size = norms(x)[:, None] * norms(y)
                            null = size == 0
                            value = added(x, np.ascontiguousarray(y.T)) / size
                    ids = pa.array(np.repeat(np.arange(len(part)), len(keys))), pa.array(np.tile(np.arange(len(keys)), len(part)))
                    yield pa.RecordBatch.from_arrays([part.take(ids[0]), keys.take(ids[1]), pa.array(value.ravel(), mask=null.ravel())], [query_id, doc_id, "cosine"])

    kinds = queries.schema[query_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    return left.crossJoin(right).mapInArrow(run, f"`{query_id}` {kinds[0]}, `{doc_id}` {kinds[1]}, cosine double")


def trigrams(c: Column) -> Column:
    """Character trigrams of the lower-case text padded with one space on both sides."""
    t = F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Cosine of the trigram bags of two texts."""
    x, y = trigrams(a), trigrams(b)

    def count(bag: Column, g: Column) -> Column:
        return F.size(F.filter(bag, lambda z: z == g)).cast("double")

    dot = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, g: s + count(x, g) * count(y, g))
    square = lambda v: F.aggregate(F.array_distinct(v), F.lit(0.0), lambda s, g: s + count(v, g) * count(v, g))
    return dot / F.sqrt(square(x) * square(y))


def chunks(c: Column, size: int = 800) -> Column:
    """Paragraphs packed into chunks of at most ``size`` characters; longer ones are cut; lines count where there is one paragraph break less."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n", "\n")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    trimmed = F.filter(F.transform(F.split(text, "\n\n", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    empty = F.array().cast(ArrayType(StringType()))
    state = F.struct(empty.alias("out"), F.lit("").alias("buf"))

    def flush(s: Column) -> Column:
        return F.when(s["buf"] != "", F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["buf"] != "", F.concat(s["buf"], F.lit("\n\n"), p)).otherwise(p)
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substring(p, i * size + 1, F.lit(size)))
        long = F.struct(F.concat(flush(s), cut).alias("out"), F.lit("").alias("buf"))
        fits = F.struct(s["out"].alias("out"), joined.alias("buf"))
        full = F.struct(flush(s).alias("out"), p.alias("buf"))
        return F.when(F.length(p) > size, long).when(F.length(joined) <= size, fits).otherwise(full)

    return F.aggregate(trimmed, state, step, flush)


def search_chunks(found: DataFrame, question: str, vector: list[float] | None = None, top: int = 5) -> DataFrame:
    """Rank (chunk_index, text[, vector]) rows by matched tokens, 0.6, and cosine, 0.4; equal scores by chunk_index."""
    words = F.array_distinct(tokens(F.lit(question)))
    matched = F.size(F.filter(words, lambda w: F.contains(F.lower("text"), w)))
    lexical = matched / F.greatest(F.size(words), F.lit(1))
    dense = F.coalesce(cosine(F.col("vector"), F.array(*map(F.lit, vector))), F.lit(0.0)) if vector else F.lit(0.0)
    scored = found.withColumns({"matched": matched, "score": 0.6 * lexical + 0.4 * dense})
    return scored.where("matched > 0 or score > 0").orderBy(F.desc("score"), "chunk_index").limit(top)


def hashed_vector(c: Column, dims: int = 64) -> Column:
    """Counts of trigrams by hash; stable between processes."""
    bag = F.transform(trigrams(c), lambda g: F.pmod(F.xxhash64(g), F.lit(dims)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(bag, lambda z: z == i)).cast("double"))
