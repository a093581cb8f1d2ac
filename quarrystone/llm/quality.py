"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, its last one shorter; the whole text is used. The encoder of a passage
reads its hashed words and word pairs (WORD places), its hashed character trigrams (CHAR places), both as counts scaled to unit length,
and the shape features of ``shapes``; one tanh layer over all of them is learned. A gated attention (tanh times sigmoid)
weighs the passages of a document, and the weighted sum gives the probability. Only document labels are learned from.

Memory: texts go through a worker in slices, and passages of one text through the encoder in blocks of BLOCK, so a very long text
holds a few numbers a word, never its whole feature matrix. Training rows come as counts of one byte.

Edge cases: a null or empty text is one passage of zeros and so gets a defined score; unlabelled rows train nothing, nor do labels other
than 0 and 1 or null ids; without any labelled row every score is 0.5; repeated rows are scored one by one, and a labelled id that
occurs in several rows trains with each. A score equal to the threshold is predicted 1. Columns called score or
predicted are replaced, all others are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, slices, small_batches, with_text
from ._words import Words, combine

PASSAGE = 64
HIDDEN = 16
#: Places of hashed words and word pairs, and of hashed character trigrams.
WORD, CHAR = 2048, 1024
SHAPES = 14
#: Labelled rows used in training, at most; those with the smallest hash of the id, while they hold this many passages in all.
MAX_ROWS = 6000
MAX_PASSAGES = 80_000
#: Passages that are encoded at once.
BLOCK = 1024
THRESHOLD = 0.7


class Bags:
    """The passages of a string column: offsets by document, shape features, and hashed content in blocks."""

    def __init__(self, col: pa.Array, size: int = PASSAGE):
        words = Words(col)
        self.shape, self.first, self.of = shapes(words, len(col), size)
        h = words.hashes()
        pair = np.flatnonzero(words.doc[1:] == words.doc[:-1]) if len(h) else np.zeros(0, np.int64)
        data = words.data
        step = np.zeros(len(data) + 1, np.int32)
        step[words.start] = 1
        word = np.cumsum(step[:-1]) - 1
        last = np.zeros(len(data), np.int64) if not len(h) else words.end[np.maximum(word, 0)]
        byte = np.flatnonzero((word >= 0) & (np.arange(len(data)) < last))
        last = last[byte]
        wide = np.concatenate([data, np.full(2, 32, np.uint8)]).astype(np.uint32)
        code = (wide[byte] << 16) | (np.where(byte + 1 < last, wide[byte + 1], 32) << 8) | np.where(byte + 2 < last, wide[byte + 2], 32)
        trigram = (code.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - CHAR.bit_length() + 1)
        top = np.uint64(64 - WORD.bit_length() + 1)
        #: Passage, place and first column of each kind of content; passages rise.
        self.parts = [
            (self.of, (h >> top).astype(np.int64), 0, WORD),
            (self.of[pair + 1], (combine([h[pair], h[pair + 1]]) >> top).astype(np.int64), 0, WORD),
            (self.of[word[byte]], trigram.astype(np.int64), WORD, CHAR),
        ]

    def counts(self, a: int, b: int) -> np.ndarray:
        """Counts of the hashed content of passages a to b, at most 255 each."""
        out = np.zeros((b - a, WORD + CHAR), np.int32)
        for where, places, first, n in self.parts:
            s, e = np.searchsorted(where, [a, b])
            out[:, first : first + n] += np.bincount((where[s:e] - a) * n + places[s:e], minlength=(b - a) * n).reshape(b - a, n)
        return np.minimum(out, 255).astype(np.uint8)


def scaled(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as numbers, and by passage what both kinds are multiplied by to have length 1."""
    x = counts.astype(np.float32)
    size = [np.sqrt(np.einsum("ij,ij->i", p, p)) for p in (x[:, :WORD], x[:, WORD:])]
    return x, *((1 / np.where(n > 0, n, 1))[:, None] for n in size)


def shapes(words: Words, n_docs: int, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape features of every passage, the documents' offsets, and the passage of each word; a document without words has one of zeros.

    Shares of bytes: upper case, digits, symbols, commas and stops, bytes above 127. Of words: one byte long, capitalised,
    ending in a symbol, all upper case, equal to the word before, seen earlier in the document. Then the mean and
    deviation of word lengths, and how full the passage is.
    """
    raw = words.raw
    upper = (raw >= 65) & (raw <= 90)
    digit = (raw >= 48) & (raw <= 57)
    high = raw >= 128
    lower = (raw >= 97) & (raw <= 122)
    stop = (raw == 44) | (raw == 46)
    symbol = (raw > 32) & ~(upper | digit | high | lower | stop)
    total = np.zeros((5, len(raw) + 1), np.int32)
    for i, m in enumerate((upper, digit, symbol, stop, high)):
        np.cumsum(m, out=total[i, 1:])
    s, e = words.start, words.end
    length = (e - s).astype(np.float64)
    counts = [(total[i, e] - total[i, s]).astype(np.float64) for i in range(5)]
    h = words.hashes()
    n_words = len(s)
    order = np.lexsort((np.arange(n_words), h, words.doc))
    seen = np.zeros(n_words)
    seen[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (words.doc[order[1:]] == words.doc[order[:-1]])
    again = np.zeros(n_words)
    again[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    per_word = np.array([*counts, length == 1, upper[s] if n_words else length, symbol[e - 1] if n_words else length, (counts[0] == length) & (length > 1), again, seen, length, length**2, np.ones(n_words)], np.float64)
    n_passages = np.maximum(1, -(-np.diff(words.first) // size))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    of = first[words.doc] + (np.arange(n_words) - words.first[words.doc]) // size
    sums = np.array([np.bincount(of, w, first[-1]) for w in per_word])
    chars, n = np.maximum(sums[11], 1), np.maximum(sums[13], 1)
    mean = sums[11] / n
    x = np.column_stack([*(sums[i] / chars for i in range(5)), *(sums[i] / n for i in range(5, 11)), mean / 10, np.sqrt(np.maximum(sums[12] / n - mean**2, 0)) / 10, sums[13] / size])
    return x, first, of


def encode(m: dict, shape: np.ndarray, content: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    x, by_word, by_char = content
    w = m["W"]
    return np.tanh(shape @ w[:SHAPES] + x[:, :WORD] @ w[SHAPES : SHAPES + WORD] * by_word + x[:, WORD:] @ w[SHAPES + WORD :] * by_char + m["b"])


def attend(m: dict, h: np.ndarray, first: np.ndarray) -> dict:
    """Attention over the encoded passages of each document, and the documents' probabilities."""
    u, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (u * g) @ m["w"]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[doc])
    a = e / np.add.reduceat(e, first[:-1])[doc]
    z = np.add.reduceat(a[:, None] * h, first[:-1])
    p = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -35, 35)))
    return {"h": h, "u": u, "g": g, "a": a, "z": z, "p": p, "doc": doc}


def gradient(m: dict, shape: np.ndarray, counts: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    """Gradient of the mean log loss of a batch."""
    x, by_word, by_char = content = scaled(counts)
    f = attend(m, encode(m, shape, content).astype(np.float64), first)
    ds = (f["p"] - y) / len(y)
    dz = ds[:, None] * m["c"]
    da = (f["h"] * dz[f["doc"]]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["doc"]])
    dug = de[:, None] * m["w"]
    du, dg = dug * f["g"] * (1 - f["u"] ** 2), dug * f["u"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz[f["doc"]] + du @ m["V"].T + dg @ m["U"].T
    dp = (dh * (1 - f["h"] ** 2)).astype(np.float32)
    by_input = np.concatenate([shape.T @ dp, x[:, :WORD].T @ (dp * by_word), x[:, WORD:].T @ (dp * by_char)])
    return {"c": f["z"].T @ ds, "d": ds.sum(), "w": (f["u"] * f["g"]).T @ de, "V": f["h"].T @ du, "U": f["h"].T @ dg, "W": by_input, "b": dp.sum(0)}


def fit(shape: np.ndarray, counts: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-3) -> dict:
    """Adam on the mean log loss, with weight decay on the encoder, in a fixed random order. Shape features are standardised."""
    rng = np.random.default_rng(10)
    m = {"mean": shape.mean(0), "sd": shape.std(0) + 1e-3}
    shape = ((shape - m["mean"]) / m["sd"]).astype(np.float32)
    width = shape.shape[1] + counts.shape[1]
    for k, size, scale in (("W", (width, hidden), 0.1), ("b", (hidden,), 0), ("V", (hidden, hidden), 0.3), ("U", (hidden, hidden), 0.3), ("w", (hidden,), 0.3), ("c", (hidden,), 0.3), ("d", (), 0)):
        m[k] = np.asarray(rng.normal(size=size) * scale)
    m["W"] = m["W"].astype(np.float32)
    learned = ("W", "b", "V", "U", "w", "c", "d")
    first_moment, second_moment, t = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = order[at : at + batch]
            sizes = first[docs + 1] - first[docs]
            own = np.concatenate([[0], np.cumsum(sizes)])
            pick = np.repeat(first[docs] - own[:-1], sizes) + np.arange(own[-1])
            grad = gradient(m, shape[pick], counts[pick], own, y[docs])
            grad["W"] += np.float32(decay) * m["W"] / np.float32(len(y) / batch)
            t += 1
            for k, v in grad.items():
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * v
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * v * v
                m[k] = m[k] - rate * (first_moment[k] / (1 - 0.9**t)) / (np.sqrt(second_moment[k] / (1 - 0.999**t)) + 1e-8)
            m["W"] = m["W"].astype(np.float32)
    return m


def probabilities(m: dict, bags: Bags) -> np.ndarray:
    """The probability of label 1 of each document."""
    shape = ((bags.shape - m["mean"]) / m["sd"]).astype(np.float32)
    h = [encode(m, shape[a : a + BLOCK], scaled(bags.counts(a, min(a + BLOCK, len(shape))))) for a in range(0, len(shape), BLOCK)]
    return attend(m, np.concatenate(h).astype(np.float64), bags.first)["p"]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, max_passages: int = MAX_PASSAGES) -> dict | None:
    """Fit on at most ``max_rows`` labelled rows of ``docs`` with ``max_passages`` passages in all, in the order of a hash; a text with
    more passages than that alone is passed over. One task trains, the model comes back."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    known = known.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)

    def extract(batches):
        for batch in batches:
            for part in slices(batch, "__t", 1 << 18):
                bags = Bags(part.column(2))
                for d in range(part.num_rows):
                    a, b = int(bags.first[d]), int(bags.first[d + 1])
                    if b - a <= max_passages:
                        yield pa.RecordBatch.from_arrays([part.column(0).slice(d, 1), part.column(1).slice(d, 1), pa.array([bags.shape[a:b].tobytes()]), pa.array([bags.counts(a, b).tobytes()], pa.binary())], ["id", "y", "shape", "counts"])

    def learn(batches):
        shape, counts, sizes, ys = [], [], [], []
        for batch in batches:
            for y, s, c in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                s = np.frombuffer(s.as_buffer(), np.float64).reshape(-1, SHAPES)
                if sum(sizes) + len(s) <= max_passages:
                    shape.append(s.copy())
                    counts.append(np.frombuffer(c.as_buffer(), np.uint8).reshape(len(s), -1).copy())
                    sizes.append(len(s))
                    ys.append(y)
        if ys:
            counts = np.concatenate(counts)
            model = fit(np.concatenate(shape), counts, np.concatenate([[0], np.cumsum(sizes)]), np.array(ys, np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["m"])

    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(known), "__id").select(F.xxhash64("__id").alias("__id"), "__y", "__t")
    found = chosen.mapInArrow(lean(extract), "id long, y int, shape binary, counts binary")
    rows = found.repartition(1).sortWithinPartitions("id").mapInArrow(lean(learn), "m binary").collect()
    return pickle.loads(rows[0].m) if rows else None


def score(docs: DataFrame, model: dict | None, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold``); columns of those names are replaced."""
    rows, kept, at = with_text(docs, text, ["score", "predicted"], keep_text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for part in slices(batch, at, 1 << 18):
                p = probabilities(m, Bags(part.column(at))) if m else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = rows.select(*kept).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return rows.mapInArrow(lean(run), schema)
