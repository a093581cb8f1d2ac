"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch, BATCH bytes of them, are cut into chunks that no piece crosses; a chunk that comes again is laid down once.
Laid end to end they are indexed by a suffix array, in order of their first SORTED letters, as few pieces are longer. Binary
search finds every piece's range of occurrences at once, and what longer pieces have beyond is compared letter by letter. The
occurrences, sorted by position, are the edges that relaxation follows: for a unigram model the best path by total score, for a
BPE model the merges in order of score (``relax_bpe``), so ids equal the library's for either kind. Characters outside the
vocabulary become their UTF-8 bytes with byte fallback, else the unknown piece. Nothing is kept from batch to batch.

Decoding joins pieces and bytes, turns the marks into spaces and drops the space that encoding put first. A text with the mark character
U+2581 itself comes back with spaces there, as with the library; every other text comes back whole.

Edge cases: a text longer than a batch is a batch of its own; repeated rows and clashing columns change nothing but that a column
called like an added one is replaced; an empty table stays empty; a null or empty text has no pieces and decodes to the empty text; a null id list decodes to null.
The model file is read on the driver and its bytes are broadcast; nothing is trained.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cache_of, lean, slices, small_batches, with_text
from ._pieces import BPE, Lattice, Pieces, chunk_text, relax_bpe, relax_unigram

#: Bytes of text that are indexed together.
BATCH = 1 << 20
#: Distinct chunks that are matched at once, and letters that suffixes are sorted by; what longer pieces add is compared after.
CHUNKS = 32_000
SORTED = 8


def suffix_array(letters: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of ``letters`` (16-bit values) in order of their first SORTED letters, and the packed letters.

    Four letters are packed into each 64-bit word; suffixes that start with 0, the end of a chunk, are left out.
    """
    padded = np.concatenate([letters, np.zeros(depth + 4, np.uint64)]).astype(np.uint64)
    n = len(letters)
    four = padded[: n + depth] << np.uint64(48) | padded[1 : n + depth + 1] << np.uint64(32) | padded[2 : n + depth + 2] << np.uint64(16) | padded[3 : n + depth + 3]
    words = [four[i : i + n] for i in range(0, depth, 4)]
    starts = np.flatnonzero(letters)
    return starts[np.lexsort([w[starts] for w in reversed(words[: SORTED // 4])])], words


class Matcher:
    """Finds all occurrences of the pieces in a text of chunks."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        alphabet = sorted(set("".join(pieces.text[i] for i in pieces.normal)))
        if len(alphabet) >= 1 << 16:
            raise ValueError("more than 65535 different characters in pieces")
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.depth = -(-int(pieces.length[pieces.normal].max()) // 4) * 4
        low = np.zeros((len(pieces.normal), self.depth), np.uint64)
        high = np.full_like(low, 0xFFFF)
        for row, i in enumerate(pieces.normal):
            low[row, : pieces.length[i]] = high[row, : pieces.length[i]] = self.letter[[ord(c) for c in pieces.text[i]]]
        self.low, self.high = (self._packed(x) for x in (low, high))
        self.long = pieces.length[pieces.normal] > SORTED

    def _packed(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, i] << np.uint64(48) | x[:, i + 1] << np.uint64(32) | x[:, i + 2] << np.uint64(16) | x[:, i + 3] for i in range(0, self.depth, 4)]

    @staticmethod
    def _search(order: np.ndarray, words: list[np.ndarray], query: list[np.ndarray], after: bool) -> np.ndarray:
        """For every query the first place in the suffix array that is not below it (``after``: that is above it)."""
        low, high = np.zeros(len(query[0]), np.int64), np.full(len(query[0]), len(order))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            below = np.full(len(low), after)
            for w, q in zip(reversed(words[: SORTED // 4]), reversed(query[: SORTED // 4]), strict=True):
                x = w[at]
                below = (x < q) | ((x == q) & below)
            low = np.where(open_ & below, mid + 1, low)
            high = np.where(open_ & ~below, mid, high)
        return low

    def edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence, in order of position, then length."""
        order, words = suffix_array(self.letter[points], self.depth)
        if not len(order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = self._search(order, words, self.low, False), self._search(order, words, self.high, True)
        n = b - a
        total = np.concatenate([[0], np.cumsum(n)])
        start = order[np.repeat(a - total[:-1], n) + np.arange(total[-1])]
        row = np.repeat(np.arange(len(self.pieces.normal)), n)
        whole = np.ones(len(row), bool)
        far = np.flatnonzero(self.long[row])
        for w, low, high in zip(words[SORTED // 4 :], self.low[SORTED // 4 :], self.high[SORTED // 4 :], strict=True):
            x = w[start[far]]
            whole[far] &= (x >= low[row[far]]) & (x <= high[row[far]])
        start, piece = start[whole], self.pieces.normal[row[whole]]
        by = np.argsort(start * (self.depth + 1) + self.pieces.length[piece], kind="stable")
        return start[by], piece[by]


def gathered(pool: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[first[i]:first[i + 1]] for i in ``at``, one after the other, and their offsets."""
    n = first[at + 1] - first[at]
    total = np.concatenate([[0], np.cumsum(n)])
    return pool[np.repeat(first[at] - total[:-1], n) + np.arange(total[-1])], total


class Codec:
    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.matcher = Matcher(self.pieces)

    def chunk_ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and their offsets."""
        p = self.pieces
        lattice = Lattice([chunk_text(k) for k in keys])
        start, piece = self.matcher.edges(lattice.points)
        if p.method == BPE:
            nxt = relax_bpe(lattice, p, start, piece)
            begin = np.flatnonzero(nxt >= 0)
            begin = begin[lattice.last[lattice.of[begin]] > begin]
            end = nxt[begin]
        else:
            _, by, back = relax_unigram(lattice, p, start, piece)
            on = np.zeros(len(by), bool)
            at = lattice.last.copy()
            live = np.flatnonzero(at > lattice.first)
            while len(live):
                on[at[live]] = True
                at[live] = back[at[live]]
                live = live[at[live] > lattice.first[live]]
            end = np.flatnonzero(on)
            begin = back[end]
        width = self.matcher.depth + 1
        code, want = start * width + p.length[piece], begin * width + (end - begin)
        ids = np.full(len(begin), -1, np.int64)
        if len(code):
            at = np.minimum(np.searchsorted(code, want), len(code) - 1)
            ids = np.where(code[at] == want, piece[at], -1)
        n = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids < 0)
        extra = [p.fallback(chr(lattice.points[begin[i]])) for i in odd]
        n[odd] = [len(x) for x in extra]
        out = np.repeat(ids, n)
        if len(odd):
            out[out < 0] = list(chain.from_iterable(extra))
        of = lattice.of[begin]
        return out.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(of, n, len(keys)))]).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their offsets: the distinct chunks of the texts are indexed and relaxed, CHUNKS at once."""
        parts = [self.pieces.chunks(t or "") for t in texts]
        flat = list(chain.from_iterable(parts))
        keys = list(dict.fromkeys(flat))
        made = [self.chunk_ids(keys[i : i + CHUNKS]) for i in range(0, len(keys), CHUNKS)]
        pool = np.concatenate([ids for ids, _ in made]) if made else np.zeros(0, np.int32)
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in made]))]).astype(np.int64) if made else np.zeros(1, np.int64)
        place = dict(zip(keys, range(len(keys)), strict=True))
        out, total = gathered(pool, first, np.fromiter(map(place.__getitem__, flat), np.int64, len(flat)))
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return out, total[bounds]


def _codec(model: bytes) -> Codec:
    cache, key = cache_of(__name__), hash(model)
    if key not in cache:
        cache[key] = Codec(model)
    return cache[key]


def _sent(df: DataFrame, model_file: str):
    with open(model_file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _bundles(batches, at: int):
    """Runs of rows, of BATCH bytes of text or one longer text, that are indexed together."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, at):
            n = pc.sum(pc.binary_length(part.column(at))).as_py() or 0
            if held and size + n > BATCH:
                yield held
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield held


def encode(docs: DataFrame, model_file: str, text: str = "text", to: str = "ids", round_trip: str | None = None, keep_text: bool = True) -> DataFrame:
    """Add the piece ids ``to`` (array of int) to every row of ``docs``; a column of that name is replaced.

    ``round_trip`` names a column that tells whether decoding the ids gave the text back; it is decoded from the ids alone.
    """
    sent = _sent(docs, model_file)
    added = [to] + ([round_trip] if round_trip else [])
    rows, kept, at = with_text(docs, text, added, keep_text)

    def run(batches):
        codec = _codec(sent.value)
        for held in _bundles(batches, at):
            texts = [t for part in held for t in part.column(at).to_pylist()]
            ids, first = codec.encode(texts)
            row = 0
            for part in held:
                own, text = first[row : row + part.num_rows + 1], texts[row : row + part.num_rows]
                row += part.num_rows
                out = [*part.columns[: len(kept)], pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(ids[own[0] : own[-1]]))]
                if round_trip:
                    out.append(pa.array([codec.pieces.decode(ids[a:b].tolist()) == (t or "") for a, b, t in zip(own[:-1], own[1:], text, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, [*kept, *added])

    schema = rows.select(*kept).withColumn(to, F.lit(None).cast("array<int>"))
    return rows.mapInArrow(lean(run), (schema.withColumn(round_trip, F.lit(True)) if round_trip else schema).schema)


def decode(docs: DataFrame, model_file: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the text ``to`` of the piece ids to every row of ``docs``; a column of that name is replaced."""
    sent = _sent(docs, model_file)
    small_batches(docs.sparkSession)
    docs = docs.withColumn("__ids", F.col(ids).cast("array<int>")).drop(to)
    kept = [c for c in docs.columns if c != "__ids"]

    def run(batches):
        pieces = _codec(sent.value).pieces
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [None if x is None else pieces.decode(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*kept, to])

    return docs.select(*kept, "__ids").mapInArrow(lean(run), docs.select(*kept).withColumn(to, F.lit(None).cast("string")).schema)
