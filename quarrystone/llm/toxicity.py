"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, the stems of words (their first STEM bytes, for inflected forms), pairs of
neighbouring words and pairs with one word between, hashed to 2**BITS places. FTRL-proximal keeps a learning rate per coordinate, and its L1 term leaves most weights at zero,
so the model is a short list of weights that is broadcast.

Edge cases: a null or empty text is scored by the bias alone; unlabelled rows train nothing; without any labelled
row every score is 0.5; repeated rows are scored one by one and count as often as they occur in training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, slices, small_batches, with_text
from ._words import PUNCT, Words, combine, distinct

BITS = 20
STEM = 6
#: Labelled rows used in training, at most; those with the smallest hash of the id.
MAX_ROWS = 8000


def features(col: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature places of each text and the texts' offsets."""
    words = Words(col, PUNCT)
    h, doc = words.hashes(), words.doc
    stems = words.hashes(STEM)
    parts, docs = [combine([h]), combine([stems, stems])], [doc, doc]
    for kind, gap in ((1, 1), (2, 2)):
        same = doc[:-gap] == doc[gap:]
        parts.append(combine([h[:-gap][same], h[gap:][same]]) + np.uint64(kind))
        docs.append(doc[gap:][same])
    place = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    return distinct(place, np.concatenate(docs), len(col))


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = 10, alpha: float = 5.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Train on (places, label) rows in order; returns the nonzero places and weights, the bias last at place 2**bits."""
    n = (1 << bits) + 1
    z, g2 = np.zeros(n), np.zeros(n)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1 * (i < n - 1), 0.0, -(z[i] - np.sign(z[i]) * l1 * (i < n - 1)) / ((beta + np.sqrt(g2[i])) / alpha + l2))

    for _ in range(epochs):
        for places, label in rows:
            i = np.append(places, n - 1)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            step = (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / alpha
            z[i] += g - step * w
            g2[i] += g * g
    w = weights(np.arange(n))
    kept = np.flatnonzero(w)
    return kept, w[kept]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``max_rows`` labelled rows of ``docs``, chosen by hash; one task trains, weights come back."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    order = F.xxhash64("__id")
    known = known.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi").orderBy(order, "__id", "__y").limit(max_rows)

    def extract(batches):
        for batch in batches:
            for part in slices(batch, "__t"):
                places, first = features(part.column(2), bits)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(places.astype(np.int32)))], ["id", "y", "x"])

    def fit(batches):
        rows = []
        for batch in batches:
            first = np.asarray(batch.column(2).offsets)
            places = batch.column(2).values.to_numpy()
            rows += [(places[first[i] : first[i + 1]].astype(np.int64), y) for i, y in enumerate(batch.column(1).to_pylist())]
        places, w = ftrl(rows, bits)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(w)], ["place", "w"])

    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(known), "__id").select("__id", "__y", "__t")
    found = chosen.withColumn("__id", F.xxhash64("__id")).mapInArrow(lean(extract), "id long, y int, x array<int>")
    model = found.repartition(1).sortWithinPartitions("id").mapInArrow(lean(fit), "place long, w double").toPandas()
    return model["place"].to_numpy(np.int64), model["w"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", bits: int = BITS, keep_text: bool = True) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` (1 from 0.5) to every row; columns of those names are replaced."""
    rows, kept, at = with_text(docs, text, ["score", "predicted"], keep_text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        places, w = sent.value
        dense = np.zeros((1 << bits) + 1)
        dense[places] = w
        for batch in batches:
            for part in slices(batch, at):
                x, first = features(part.column(at), bits)
                total = np.concatenate([[0.0], np.cumsum(dense[x])])
                p = 1 / (1 + np.exp(-np.clip(total[first[1:]] - total[first[:-1]] + dense[-1], -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    schema = rows.select(*kept).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return rows.mapInArrow(lean(run), schema)
