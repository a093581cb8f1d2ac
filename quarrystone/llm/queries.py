"""The registered queries of this subpackage and, where SQL can express one, the SQL for the same rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dup, fingerprint, language_id, language_model, mixing, near_dup, quality, sentencepiece_codec, token_count, toxicity
from ._common import crc_mod, table

#: Target weights of the mix: sources of the synthetic tables in four classes.
WEIGHTS = {f"src{i}": 1 + i % 4 for i in range(20)}

#: The piece vocabulary of the encoding queries; the folder is a parameter of the environment.
MODEL = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, WEIGHTS)


def op2_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "text")
    return language_model.score(docs, language_model.train(docs.where("not held_out")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode(docs, MODEL, round_trip="round_trip", keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, MODEL, keep_text=False)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text", "lang")
    return language_id.classify(docs.drop("lang"), language_id.train(docs.where("not held_out")), keep_text=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    model = toxicity.train(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep_text=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    model = quality.train(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep_text=False)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_embedding_near_dup, op3_language_model, op4_sentencepiece, op5_minhash_near_dup, op6_fingerprints, op7_token_counts, op8_language_id, op9_toxicity, op10_quality)}

_OP1 = f"""
WITH RECURSIVE
counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS i,
    CASE WHEN regexp_full_match(source, 'src1?[0-9]') THEN 1 + CAST(substr(source, 4) AS INT) % 4 ELSE 1 END AS w FROM counts),
sized AS (SELECT *, {mixing.SLOTS} * w // sum(w) OVER () AS low, {mixing.SLOTS} * w % sum(w) OVER () AS rest FROM weighted),
quota AS (SELECT source, i, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, i) <= {mixing.SLOTS} - sum(low) OVER () THEN 1 ELSE 0 END AS q FROM sized),
all_q AS (SELECT list(CAST(q AS BIGINT) ORDER BY i) AS q FROM quota),
sim AS (
    SELECT 0 AS t, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS k, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS nth FROM all_q
    UNION ALL
    SELECT t + 1, list_transform(k, lambda x, j: x + CASE WHEN j = p THEN 1 ELSE 0 END), p, k[p] FROM (
        SELECT t, k, list_min(list_transform(list_filter(range(1, len(k) + 1), lambda j: k[j] < q[j] AND k[j] * {mixing.SLOTS} // q[j] <= t),
            lambda j: ((k[j] + 1) * {mixing.SLOTS} + q[j] - 1) // q[j] * 1000000 + j)) % 1000000 AS p
        FROM sim, all_q WHERE t < {mixing.SLOTS})),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS k FROM documents),
blocks AS (SELECT r.*, q.i, q.q, k // {mixing.BLOCK_ROWS} AS mix_block FROM ranked r JOIN quota q ON r.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, b.source, mix_block, CAST(mix_block // q * {mixing.SLOTS} + t - 1 AS BIGINT) AS mix_slot,
    CAST((mix_block // q * {mixing.SLOTS} + t - 1) * {mixing.BLOCK_ROWS} + b.k % {mixing.BLOCK_ROWS} AS BIGINT) AS mix_position
FROM blocks b JOIN sim s ON s.pick = b.i AND s.nth = b.mix_block % b.q AND s.t > 0
"""

_OP2 = """
WITH RECURSIVE
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) l ON l.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = vec_id
"""

_OP5 = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(m, n.doc_id)) AS kept
FROM n LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = n.doc_id
"""

ORACLES = {"op1_mix_sources": _OP1, "op2_embedding_near_dup": _OP2, "op5_minhash_near_dup": _OP5}
