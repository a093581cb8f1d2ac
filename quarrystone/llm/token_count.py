"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of all pieces enumerates their matches in the distinct chunks of a batch; relaxation in the order
of match ends carries the best score and the piece count, never the path. Ties follow the tokenizer: among equal scores into a
position the match that starts first stays; a character that is no piece costs the lowest score less 10 and counts
as its UTF-8 bytes with byte fallback, else as one piece. Scores add up in double precision within a chunk (parts between
spaces, which no piece crosses), so the library's single-precision rounding over long texts is not copied.

Edge cases: a null or empty text has 0 tokens. The model file is read on the driver and its bytes are broadcast.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cache_of, lean, slices, with_text
from ._pieces import Lattice, Pieces, chunk_text, count_unigram

#: Distinct chunks whose counts a worker remembers in each of two generations; what is used again moves to the younger one.
MEMORY = 400_000


class Counter:
    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in self.pieces.normal:
            self.automaton.add_word(self.pieces.text[i], int(i))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def chunk_counts(self, keys: list[str]) -> np.ndarray:
        lattice = Lattice([chunk_text(k) for k in keys])
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(lattice.joined)), np.int64).reshape(-1, 2)
        piece = flat[:, 1]
        count = count_unigram(lattice, self.pieces, flat[:, 0] + 1 - self.pieces.length[piece], piece)
        return np.where(lattice.last > lattice.first, count[lattice.last], 0)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        parts = [self.pieces.chunks(t or "") for t in texts]
        flat = list(chain.from_iterable(parts))
        new = list(set(flat) - self.known.keys())
        if new:
            if len(self.known) + len(new) > MEMORY:
                self.old, self.known = self.known, {}
                new = list(set(flat))
            self.known.update((k, self.old[k]) for k in new if k in self.old)
            if new := [k for k in new if k not in self.old]:
                self.known.update(zip(new, self.chunk_counts(new).tolist(), strict=True))
        own = np.concatenate([[0], np.cumsum(np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)))])
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return own[first[1:]] - own[first[:-1]]


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", to: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """Add the token count ``to`` to every row of ``docs``; a column of that name is replaced."""
    with open(model_file, "rb") as f:
        data = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(data)
    rows, kept, at = with_text(docs, text, [to], keep_text)

    def run(batches):
        model = sent.value
        cache, key = cache_of(__name__), hash(model)
        if key not in cache:
            cache[key] = Counter(model)
        counter = cache[key]
        for batch in batches:
            for part in slices(batch, at):
                n = counter.counts(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(n)], [*kept, to])

    return rows.mapInArrow(lean(run), rows.select(*kept).withColumn(to, F.lit(0).cast("long")).schema)
