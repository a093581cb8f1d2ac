"""Document fingerprints from prefix polynomial hashes.

A text of code points c has prefix arrays P[i] = sum over j < i of (c[j] + 1) * B**j modulo 2**31 - 1, for two bases. Any span's
hash is (P[e] - P[s]) * B**-s, so spans compare in O(1) (``Prefix.span``) and the longest common extension of two
positions is found by binary search (``extension``). The hash of an edited text, and of every window in it,
follows from the arrays of its two parts; nothing is hashed twice.

A fingerprint is text: the 62-bit hash of the whole text, its length, and SLOTS 16-bit minima over all windows of WINDOW
code points (a shorter text is one window). ``likeness`` is the share of equal slots among those that either text
fills: an estimate of the windows' Jaccard similarity, 1 for equal texts and for two empty ones.

Each text is paired with the next one by descending id: rows are dealt over ranges of the id (quantiles), and the first row
of each range is also sent to the range before it, the very first to the last.

Memory: a worker holds two texts at a time with their arrays, about 60 bytes a code point of each. Rows of one id, and those
without an id, follow each other and so are one task's: their neighbours are each other.

Edge cases: other columns are ignored, whatever their names; a null text is empty; an empty text has no windows; null ids come last; rows with equal ids follow each other in
the order of their compressed texts; a single row is its own next; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, slices, small_batches, utf8
from ._words import mix

P = (1 << 31) - 1
BASES = (1_000_003_579, 1_768_104_233)
WINDOW = 16
SLOTS = 64
LOWEST = -(1 << 63)
#: Rows of a range, and ranges at most: beyond that ranges grow, as the driver gets two ids of each.
RANGE_ROWS, MOST_RANGES = 20_000, 20_000
_tables: dict[int, np.ndarray] = {}


def residue(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**62."""
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    return np.where(x >= P, x - np.uint64(P), x)


def table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo P, by doubling."""
    have = _tables.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), P))
        have = np.concatenate([have, residue(have * step)])
    _tables[base] = have
    return have[:n]


class Prefix:
    """Prefix arrays of a text, and the hashes of its windows."""

    def __init__(self, text: str):
        self.n = len(text)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sums = []
        for b in BASES:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(residue(c * table(b, self.n)), out=s[1:])
            self.sums.append(residue(s))
        self.windows = self._windows(0, self.n - WINDOW + 1) if self.n >= WINDOW else np.zeros(0, np.uint64)

    def _windows(self, a: int, b: int) -> np.ndarray:
        s = self.sums[0]
        inverse = table(pow(BASES[0], -1, P), b)[a:b]
        return residue(residue(s[a + WINDOW : b + WINDOW] + np.uint64(P) - s[a:b]) * inverse)

    def span(self, s: int, e: int) -> tuple[int, int]:
        """The hash of text[s:e]; equal spans of equal length have equal hashes."""
        return tuple((int(x[e]) - int(x[s])) * pow(pow(b, -1, P), s, P) % P for b, x in zip(BASES, self.sums, strict=True))

    def whole(self) -> tuple[int, int]:
        return int(self.sums[0][-1]), int(self.sums[1][-1])


def extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest common extension of position i of a and j of b."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def minima(windows: np.ndarray) -> np.ndarray:
    out = np.full(SLOTS, np.iinfo(np.uint64).max)
    h = mix(windows + np.uint64(0x9E37))
    np.minimum.at(out, (h >> np.uint64(58)).astype(np.int64), h)
    return out


def render(whole: tuple[int, int], n: int, low: np.ndarray) -> str:
    slots = "".join(f"{int(x) & 0xFFFF:04x}" if x != np.iinfo(np.uint64).max else "----" for x in low)
    return f"{(whole[0] << 31 | whole[1]):016x}:{n:x}:{slots}"


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    x, y = a.rpartition(":")[2], b.rpartition(":")[2]
    pairs = [(x[i : i + 4], y[i : i + 4]) for i in range(0, 4 * SLOTS, 4)]
    filled = [p for p in pairs if p != ("----", "----")]
    return sum(p == q for p, q in filled) / len(filled) if filled else 1.0


def of_prefix(p: Prefix) -> str:
    """The fingerprint of one text."""
    windows = p.windows if p.n >= WINDOW or not p.n else np.array([p.sums[0][-1]])
    return render(p.whole(), p.n, minima(windows))


def of_joined(a: Prefix, k: int, b: Prefix, m: int, text: str) -> str:
    """The fingerprint of the first k code points of a followed by the first m of b, ``text`` being that string."""
    n = k + m
    if n < WINDOW:
        return of_prefix(Prefix(text))
    whole = tuple((int(x[k]) + pow(base, k, P) * int(y[m])) % P for base, x, y in zip(BASES, a.sums, b.sums, strict=True))
    across = Prefix(text[max(0, k - WINDOW + 1) : k + WINDOW - 1]).windows if 0 < k < n else np.zeros(0, np.uint64)
    parts = [a.windows[: max(0, k - WINDOW + 1)], across, b.windows[: max(0, m - WINDOW + 1)]]
    return render(whole, n, minima(np.concatenate(parts)))


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_next"]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col and NAMES; ``common_next`` is the common prefix with the next text.

    ``ranges`` (by the number of rows unless given) bounds what reaches the driver: two ids for each range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not ranges:  # by the size of the input, and enough tasks for the session
        ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("__t"))
    keyed = rows.withColumn("key", F.coalesce("id", F.lit(LOWEST)))
    cuts = keyed.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges + 1000)).first()[0]
    bounds = -np.unique(np.array(cuts or [], np.int64))[::-1].astype(object)
    bounds = np.array([int(-b) for b in bounds], np.int64)

    def bucket(keys: np.ndarray) -> np.ndarray:
        """Ranges in descending order of the key; a bound belongs to the range that it begins."""
        return len(bounds) - np.searchsorted(np.sort(bounds), keys, "left")

    def tops(batches):
        for batch in batches:
            k = batch.column(0).to_numpy()
            b = bucket(k)
            for x in np.unique(b):
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]), pa.array([int(k[b == x].max())])], ["bucket", "top"])

    top = {r.bucket: r.top for r in keyed.select("key").mapInArrow(lean(tops), "bucket long, top long").groupBy("bucket").agg(F.max("top").alias("top")).collect()}
    filled = sorted(top)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    heads = np.sort(np.array(list(top.values()), np.int64))

    def deal(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "__t"):
                raw, at = utf8(part.column(1))
                keys = part.column(2).to_numpy()
                packed = pa.array([press.compress(raw[at[i] : at[i + 1]].tobytes()) for i in range(len(keys))], pa.binary())
                b = bucket(keys)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.zeros(len(b), bool)), part.column(0), part.column(2), packed], ["bucket", "tail", "id", "key", "packed"])
                first = np.flatnonzero(np.isin(keys, heads))
                if len(first):
                    to = pa.array([before[int(x)] for x in b[first]], pa.int64())
                    pick = pa.array(first)
                    yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(first), bool)), part.column(0).take(pick), part.column(2).take(pick), packed.take(pick)], ["bucket", "tail", "id", "key", "packed"])

    def run(batches):
        expand = zstandard.ZstdDecompressor()
        out: list[tuple] = []
        at, held, ended = None, None, False
        for batch in batches:
            for b, tail, key, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), batch.column(4), strict=True):
                if b != at:
                    at, held, ended = b, None, False
                if ended:
                    continue
                t = expand.decompress(packed.as_buffer().to_pybytes()).decode("utf-8", "surrogatepass")
                p = Prefix(t)
                mine = of_prefix(p)
                if held:
                    old, q, own, old_id = held
                    cut, m = q.n - q.n // 2, min(q.n // 2, p.n)
                    edited = old[:cut] + t[:m]
                    print_ = of_joined(q, cut, p, m, edited)
                    out.append((old_id, q.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, print_, likeness(own, print_), likeness(own, mine), extension(q, 0, p, 0)))
                    if len(out) >= 2000:
                        yield _batch(out)
                        out = []
                held, ended = (t, p, mine, key), tail
        if out:
            yield _batch(out)

    def _batch(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [id_col, *NAMES])

    dealt = keyed.select("id", "__t", "key").mapInArrow(lean(deal), "bucket long, tail boolean, id long, key long, packed binary")
    placed = dealt.repartitionById(ranges, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "tail", F.col("key").desc(), F.col("id").desc_nulls_last(), "packed")
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_next long"
    return placed.mapInArrow(lean(run), schema)
