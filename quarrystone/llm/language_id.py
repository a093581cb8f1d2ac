"""Language identification with hyperdimensional profiles.

Every letter class has a random +-1 vector; a letter trigram is the product (binding) of its letters' vectors,
each rotated (permuted) by its place; a document or language is the sum (bundle) of its trigram vectors.
A document gets the language whose prototype has the largest cosine with it, the smaller name on a tie.

Edge cases: a null text, an empty text or one without a letter is ``und`` with score 0; with no training row
every document is ``und``; rows with a null language train nothing; repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cache_of, lean, slices, small_batches, with_text

DIM = 1024
#: Letter classes: 0 is the edge of a word, 1-26 the ASCII letters, 27-63 all other letters by code point.
CLASSES = 64


def letter_classes() -> np.ndarray:
    cache = cache_of(__name__)
    if "classes" not in cache:
        out = np.fromiter((27 + (i * 2654435761 >> 7) % 37 if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint8, 0x110000)
        out[97:123] = out[65:91] = np.arange(1, 27)
        cache["classes"] = out
    return cache["classes"]


def letter_vectors(dim: int = DIM) -> np.ndarray:
    """One random +-1 vector per letter class, from a fixed seed."""
    return np.random.default_rng(8).choice(np.array([-1, 1], np.float32), (CLASSES, dim))


class Profiles:
    """Trigram vectors, made when a trigram is first seen."""

    def __init__(self, dim: int = DIM):
        letters = letter_vectors(dim)
        self.a, self.b, self.c = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
        self.row = np.full(CLASSES**3, -1, np.int32)
        self.vectors = np.zeros((0, dim), np.int8)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        new = np.flatnonzero(np.bincount(codes[self.row[codes] < 0], minlength=CLASSES**3))
        if len(new):
            made = self.a[new // CLASSES**2] * self.b[new // CLASSES % CLASSES] * self.c[new % CLASSES]
            made = made.astype(np.int8)
            self.row[new] = np.arange(len(self.vectors), len(self.vectors) + len(new))
            self.vectors = np.concatenate([self.vectors, made])
        return self.row[codes]

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """The bundle of each text: one row per text, zero where it has no letter."""
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *map(len, lowered)])
        kind = letter_classes()[points].astype(np.int32)
        left, right = np.zeros_like(kind), np.zeros_like(kind)
        left[1:], right[:-1] = kind[:-1], kind[1:]
        filled = first[:-1][first[:-1] < first[1:]]
        left[filled] = 0
        right[filled[1:] - 1] = 0
        at = np.flatnonzero(kind)
        rows = self.rows((left[at] * CLASSES + kind[at]) * CLASSES + right[at])
        bounds = np.searchsorted(at, first)
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        for d in range(len(texts)):
            if bounds[d] < bounds[d + 1]:
                count = np.bincount(rows[bounds[d] : bounds[d + 1]])
                seen = np.flatnonzero(count)
                out[d] = count[seen].astype(np.float32) @ self.vectors[seen].astype(np.float32)
        return out


def _profiles(dim: int) -> Profiles:
    cache = cache_of(__name__)
    if dim not in cache:
        cache[dim] = Profiles(dim)
    return cache[dim]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototypes: the sum of the unit vectors of all documents of each language, over every row of ``docs``.

    What reaches the driver is one vector per language.
    """

    small_batches(docs.sparkSession)

    def partial(batches):
        p, sums = _profiles(dim), {}
        for batch in batches:
            for part in slices(batch, "__t"):
                v = p.documents(part.column(0).to_pylist())
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float64)
                names = np.array(part.column(1).to_pylist(), object)
                for name in set(names):
                    sums[name] = sums.get(name, 0) + v[names == name].sum(0)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "i", "v"])

    rows = docs.select(F.col(text).alias("__t"), F.col(lang).alias("__l")).where("__l is not null and __t is not null")
    sums = rows.mapInArrow(lean(partial), "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    packed = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).collect()
    return {r.lang: np.array([x.v for x in r.v]) for r in packed}


def classify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dim: int = DIM, keep_text: bool = True) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the cosine, cut at 0) to every row of ``docs``; columns of those names are replaced."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names]).reshape(len(names), dim)
    sent_rows, kept, at = with_text(docs, text, ["lang_pred", "score"], keep_text)

    def run(batches):
        p = _profiles(dim)
        for batch in batches:
            for part in slices(batch, at):
                v = p.documents(part.column(at).to_pylist()).astype(np.float64)
                norm = np.linalg.norm(v, axis=1)
                cos = v @ matrix.T / np.where(norm > 0, norm, 1)[:, None] if names else np.zeros((len(v), 1))
                best = cos.argmax(1)
                known = (norm > 0) & bool(names)
                pred = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(cos[np.arange(len(cos)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    schema = sent_rows.select(*kept).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return sent_rows.mapInArrow(lean(run), schema)
