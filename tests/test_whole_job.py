"""Engine queries that read whole columns, against brute force."""

import math
import re
from collections import Counter

import numpy as np

from quarrystone.functions import scalar
from quarrystone.plans import queries


def test_folding_reads_texts_to_their_end(spark, tmp_path):
    tail = "Straße, ÉTÉ -- déjà; Ñandú!"
    texts = [(1, "word " * 40 + tail), (2, "x" * 20000 + " " + tail), (3, tail), (4, None), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.folded for r in queries.QUERIES["scalar_folding"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else scalar.fold(t) for i, t in texts}
    assert got[2].endswith(" strasse ete deja nandu")


def test_folding_equals_brute_force_on_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.folded for r in queries.QUERIES["scalar_folding"](spark, small).collect()}
    assert got == {i: scalar.fold(t) for i, t in texts.items()}


def test_cosine_takes_every_twentieth_row_against_all(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    v = {r.vec_id: np.array(r.embedding, float) for r in rows}
    got = {(r.query_id, r.vec_id): r.cosine for r in queries.QUERIES["retrieval_cosine_queries"](spark, small).collect()}
    assert set(got) == {(q, i) for q in v if q % 20 == 0 for i in v}
    for (q, i), c in got.items():
        assert abs(c - v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i])) < 1e-8


def test_cosines_by_blocks_equal_cosines_by_pairs(spark, small, monkeypatch):
    """No pair is computed by itself, and odd vectors, lengths and blocks give what single pairs give, to the bit."""
    from pyspark.sql import functions as F

    from quarrystone.functions import retrieval

    assert "zip_with" not in queries.QUERIES["retrieval_cosine_queries"](spark, small)._jdf.queryExecution().toString()
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "PAIRS", 4)
    odd = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [3e200, 1.0], [1e-200, 0.0], [1.0], [1.0, 2.0, 3.0], [0.1, 0.7], [-0.3, 0.9], [0.1, 0.7]]
    rows = spark.createDataFrame([*enumerate(odd), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    asked = rows.select(F.concat(F.lit("q"), F.col("vec_id")).alias("query_id"), F.col("embedding").alias("asked"))
    pairs = rows.crossJoin(asked).select("query_id", "vec_id", retrieval.cosine(F.col("embedding"), F.col("asked")).alias("cosine"))
    got = retrieval.cosines(rows, asked, "vec_id", "embedding", "query_id", "asked")
    assert sorted(map(str, got.collect())) == sorted(map(str, pairs.collect())) and got.count() == 14 * 14


def test_bm25_searches_whole_documents(spark, small):
    def bags(name, key):
        rows = spark.read.parquet(f"{small}/{name}.parquet").select(key, "text").collect()
        return {r[key]: Counter(re.findall(r"[^\W]+", (r.text or "").lower())) for r in rows}

    docs, asked = bags("documents", "doc_id"), bags("benchmark", "item_id")
    df = Counter(w for bag in docs.values() for w in bag)
    long = {d: sum(bag.values()) for d, bag in docs.items()}
    mean = sum(long.values()) / len(docs)
    want = {}
    for q, words in asked.items():
        for d, bag in docs.items():
            s = sum(n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.5 / (bag[w] + 1.5 * (0.25 + 0.75 * max(long[d], 1) / mean)) for w, n in words.items() if w in bag)
            if s > 0:
                want[q, d] = s
    got = {(r.item_id, r.doc_id): r.score for r in queries.QUERIES["retrieval_bm25_documents"](spark, small).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_personal_data_is_counted_in_whole_texts(spark, small):
    """Counts of every shape, and cards by the Luhn rule, with Python's own matcher."""
    from quarrystone.functions import pii

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["pii_counts"](spark, small).collect():
        t = texts[r.doc_id] or ""
        for kind, shape in pii.VALUES.items():
            if kind != "card":
                assert r[kind] == len(re.findall(f"(?:{shape})" if not shape.startswith("(?i)") else shape, t)), (kind, r.doc_id)
        assert r.cards == sum(pii.luhn_number(re.sub(r"\D", "", x)) for x in re.findall(pii.VALUES["card"], t))


def test_chunks_hold_whole_texts(spark, small):
    """Chunks are no longer than asked and give the text's words back in order."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    found = {}
    for r in queries.QUERIES["retrieval_chunks"](spark, small).collect():
        found.setdefault(r.doc_id, {})[r.chunk_index] = r.chunk
    for doc, t in texts.items():
        parts = [found.get(doc, {})[i] for i in range(len(found.get(doc, {})))]
        assert all(0 < len(p) <= 800 for p in parts)
        assert "".join("".join(p.split()) for p in parts) == "".join((t or "").split())
