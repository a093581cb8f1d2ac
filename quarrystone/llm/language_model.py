"""Interpolated modified Kneser-Ney model of order three, counted in Spark and memory-mapped by workers.

``train`` counts all training texts in three shuffles. Words: map tasks sum what they see and send compressed blocks of sorted
hashes; reducers merge them into sorted hash arrays, and a word's id is its place there. Trigrams: map tasks sort the ids of up to
HOLD tokens, sum equal trigrams and send blocks cut by the hash of the trigram's first two words, so a frequent trigram costs one
entry a block; a reducer sees all followers of its contexts and writes both trigram counts and contexts. Bigrams:
each distinct trigram adds one to the continuation count of its last two words. Counts of distinct followers and predecessors
of a word are summed over ranges of ids. ``score`` maps the files and looks up each distinct word and bigram of a slice once.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; every text ends with one end token and is preceded by two start
contexts. The highest order uses counts, the lower ones continuation counts; discounts D1, D2, D3+ follow from the counts of counts
of each order, and are 0.5, 1 and 1.5 where one of those is zero. The unigram level is interpolated with 1 / (V + 1), one
unknown word included. A context never seen leaves the lower order as it is.

Word hashes have 64 bits. N-grams are kept under 38 bits beside the shard's, in shards of about SHARD_BYTES of text: an n-gram that
is not there is taken for another one with a chance of about 1e-5. All counts have 64 bits. The model is a folder of the shared
one; ``Model.remove`` deletes it when no score is to be read any more.

Edge cases: a null or empty text is the end token alone; a very long text is cut into slices of rows, never inside, and holds some
100 bytes a word while it is counted or scored; with no training text N = V = 0 and scores are 0; repeated rows count as often as
they occur; columns of ``docs`` called like the added ones are replaced. ``train`` refuses more than 2**32 - 2 distinct words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, remove, shared_path, slices, small_batches, stored
from ._store import PackedTable, SortedHashes, distinct_of, mapped, merge, pack, runs, shard_of, unpack, write
from ._words import Words, mix

END = np.uint64(0x656E64)
#: Bytes of training text for each shard of the model.
SHARD_BYTES = 16 << 20
#: Shards are 2**MAX_BITS at most, so that what the driver gets of them is bounded; beyond that they grow.
MAX_BITS = 20
#: Distinct words, and tokens, that a map task holds before it sends them.
HOLD = 2_000_000
#: Tokens that are looked up at once: a look-up of a batch costs a call for each shard, so small batches would cost shards x input.
ASK = 1 << 20
LOW = np.uint64(0xFFFFFFFF)
SHIFT = np.uint64(32)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end tokens included, and the documents' offsets."""
    words = Words(col)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END)
    out[np.arange(len(words.doc)) + words.doc] = words.hashes()
    return out, first


def pair_key(pair: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and key of pairs of ids; a pair is one 64-bit number."""
    return hash_key(mix(pair), bits)


def hash_key(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from mixed pairs; their order is the order of shards and keys."""
    return shard_of(h, bits), (h << np.uint64(bits)) >> np.uint64(64 - PackedTable.KEY)


def triple_key(mixed: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a trigram in the shard of its first two words, which are given as a mixed pair."""
    return mix(mixed + word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PackedTable.KEY)


@dataclass
class Model:
    folder: str
    words: SortedHashes
    bits: int
    width: int
    n_tokens: int
    n_docs: int
    #: Distinct bigrams, and discounts of the orders one, two and three.
    bigrams: int = 0
    discounts: tuple[tuple[float, float, float], ...] = ((0.5, 1.0, 1.5),) * 3
    rest: float = 1.0

    @property
    def vocabulary(self) -> int:
        return int(self.words.offsets[-1])

    @property
    def triples(self) -> PackedTable:
        return PackedTable(self.folder, "triple")

    @property
    def contexts(self) -> PackedTable:
        """Followers seen once, twice and more often, and the count of all, of pairs seen at least twice."""
        return PackedTable(self.folder, "pair", 4)

    @property
    def continuations(self) -> PackedTable:
        return PackedTable(self.folder, "before")

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and training count of each token; -1 and 0 for an unknown one."""
        distinct, back = distinct_of(hashes)
        place, count = self.words.find(distinct)
        return place[back], count[back]

    def followed(self, ids: np.ndarray) -> np.ndarray:
        """For sorted ids: continuations of count 1, 2 and more after the word, their sum, and distinct predecessors; a row each."""
        out = np.zeros((5, len(ids)), np.int64)
        for a, b, k in runs(ids // self.width):
            raw = mapped(self.folder, f"word-context-{k}")
            kind = np.uint64 if len(raw) == 40 * self.width else np.uint32
            out[:, a:b] = raw.view(kind).reshape(5, -1)[:, ids[a:b] - k * self.width]
        return out

    def remove(self, spark: SparkSession) -> None:
        remove(spark, self.folder)


def _reduced(rows: DataFrame, n: int, reduce, schema: str) -> DataFrame:
    """Bring the blocks of each shard together, a task for each shard, and reduce them."""

    def run(batches):
        at, blocks = None, []
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != at and blocks:
                    yield reduce(at, blocks)
                    blocks = []
                at = k
                blocks.append(block.as_buffer().to_pybytes())
        if blocks:
            yield reduce(at, blocks)

    return rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard").mapInArrow(lean(run), schema)


def _rows(blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], ["shard", "block"])


def _counted_words(rows: DataFrame, bits: int) -> DataFrame:
    def sent(keys, counts):
        return _rows([(k, pack(keys[a:b], counts[a:b])) for a, b, k in runs(shard_of(keys, bits))])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "__t"):
                held.append(np.unique(tokens(part.column(0))[0], return_counts=True))
                size += len(held[-1][0])
                if size > HOLD:
                    held = [merge(*zip(*held, strict=True))]
                    size = len(held[0][0])
                    if size > HOLD // 2:
                        yield sent(*held[0])
                        held, size = [], 0
        if held:
            yield sent(*merge(*zip(*held, strict=True)))

    return rows.mapInArrow(lean(run), "shard int, block binary")


def summed(pair: np.ndarray, word: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, word) in order and the sums of their counts (1 each unless given)."""
    order = np.argsort(pair)
    pair = pair[order]
    new = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
    both = (np.cumsum(new).astype(np.uint64) - np.uint64(1) << SHIFT) | word[order].astype(np.uint64)
    if counts is None:
        both.sort()
    else:
        by = np.argsort(both)
        both, counts = both[by], counts[order][by]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]][: len(both)])
    n = np.diff(np.r_[first, len(both)]) if counts is None else np.add.reduceat(counts, first) if len(both) else counts
    both = both[first]
    return pair[new][(both >> SHIFT).astype(np.int64)], both & LOW, n.astype(np.int64)


def _pair_blocks(pair: np.ndarray, word: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> list[tuple[int, bytes]]:
    """(shard, block) of rows in order of shard, pair and word. A block: distinct pairs as differences of first words, second words, words a pair, then words and counts."""
    new = np.r_[True, shards[1:] != shards[:-1]][: len(shards)]
    head = np.flatnonzero(new | np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    u, v, n = (pair[head] >> SHIFT).astype(np.uint32), (pair[head] & LOW).astype(np.uint32), np.diff(np.r_[head, len(pair)]).astype(np.uint32)
    step = np.where(new[head], u, np.diff(u, prepend=np.uint32(0)))
    at, word = np.flatnonzero(new), word.astype(np.uint32)
    rows, heads = np.r_[at, len(pair)].tolist(), np.r_[np.searchsorted(head, at), len(head)].tolist()
    return [(k, pack(step[c:d], v[c:d], n[c:d], word[a:b], counts[a:b])) for k, a, b, c, d in zip(shards[at].tolist(), rows, rows[1:], heads, heads[1:])]


def _packed_pairs(pair: np.ndarray, word: np.ndarray, counts: np.ndarray) -> bytes:
    return _pair_blocks(pair, word, counts, np.zeros(len(pair), np.int64))[0][1]


def _unpacked_pairs(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for b in blocks:
        u, *rest = unpack(b, *[np.uint32] * 4, np.int64)
        parts.append((np.cumsum(u, dtype=np.uint64), *rest))
    u, v, n, word, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.repeat((u << SHIFT) | v, n), word.astype(np.uint64), counts


def _by_shard(pair: np.ndarray, word: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(shards.astype(np.uint16) if shards.max(initial=0) < 1 << 16 else shards, kind="stable")
    return _rows(_pair_blocks(pair[order], word[order], counts[order], shards[order]))


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and offsets of several runs of texts as one."""
    return np.concatenate([h for h, _ in held]), np.r_[0, np.cumsum(np.concatenate([np.diff(first) for _, first in held]))]


def _trigrams(model: Model):
    """Pairs and words of every token: (start, start) and (start, first word) are pairs too."""
    start = np.uint64(model.vocabulary)

    def of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = model.ids(h)[0].astype(np.uint64)
        v = np.r_[start, w[:-1]]
        v[first[:-1]] = start
        u = np.r_[start, v[:-1]]
        u[first[:-1]] = start
        return (u << SHIFT) | v, w

    return of


def _counted_trigrams(rows: DataFrame, model: Model) -> DataFrame:
    of, bits = _trigrams(model), model.bits

    def sent(held):
        pair, word, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return _by_shard(pair, word, counts, pair_key(pair, bits)[0])

    def run(batches):
        held, size, told, asked = [], 0, [], 0
        for batch in batches:
            for part in slices(batch, "__t"):
                told.append(tokens(part.column(0)))
                asked += len(told[-1][0])
                if asked > ASK:
                    held.append(of(*_joined(told)))
                    size, told, asked = size + asked, [], 0
                    if size > HOLD:
                        yield sent(held)
                        held, size = [], 0
        if told:
            held.append(of(*_joined(told)))
        if held:
            yield sent(held)

    return rows.mapInArrow(lean(run), "shard int, block binary")


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.0), float(i)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _kinds(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, and at least 3."""
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)] + [int((counts > 2).sum())]


def _with_kinds(batch: pa.RecordBatch, k: int, kinds: list[int]) -> pa.RecordBatch:
    """The blocks of a reducer, and its counts of counts as a block of their own, told by its first byte."""
    shard, block = pa.array([*batch.column(0).to_pylist(), k], pa.int32()), pa.array([*(b"B" + x for x in batch.column(1).to_pylist()), b"K" + np.array(kinds, np.int64).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([shard, block], ["shard", "block"])


def _without_kinds(blocks: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    found = [np.frombuffer(b, np.int64, 5, 1) for b in blocks if b[:1] == b"K"]
    return [b[1:] for b in blocks if b[:1] == b"B"], np.sum([np.zeros(5, np.int64), *found], axis=0)


def train(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count every text of ``docs`` and write the model's files; only sizes and sums reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_path(spark, "lm")
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__t"))
    seen = rows.agg(F.sum(F.octet_length("__t")).alias("b"), F.count("*").alias("n")).first()
    n_docs, bits = seen.n, min(MAX_BITS, ((seen.b or 0) // shard_bytes).bit_length())
    n = 1 << bits

    def words_done(k, blocks):
        keys, counts = merge(*zip(*(unpack(b, np.uint64, np.int64) for b in blocks), strict=True))
        write(folder, f"word-{k}", keys, counts)
        return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(keys)]), pa.array([int(counts.sum())])], ["k", "n", "total"])

    done = _reduced(_counted_words(rows, bits), n, words_done, "k long, n long, total long").collect()
    sizes = np.zeros(n, np.int64)
    for r in done:
        sizes[r.k] = r.n
    words = SortedHashes(folder, "word", sizes)
    v, total = int(sizes.sum()), sum(r.total for r in done)
    if v > (1 << 32) - 2:
        raise ValueError("more distinct words than 32-bit ids")
    ranges = max(1, n // 8)
    model = Model(folder, words, bits, -(-(v + 1) // ranges), total, n_docs)
    if not v:
        return model
    width, start = model.width, np.uint64((v << 32) | v)

    def trigrams_done(k, blocks):
        pair, word, counts = summed(*_unpacked_pairs(blocks))
        model.triples.write(k, triple_key(mix(pair), word), counts)
        head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        by = [np.add.reduceat((counts == 1).astype(np.int64), head), np.add.reduceat((counts == 2).astype(np.int64), head), np.add.reduceat((counts > 2).astype(np.int64), head), np.add.reduceat(counts, head)]
        often = (by[3] > 1) | (pair[head] == start)
        model.contexts.write(k, pair_key(pair[head][often], bits)[1], np.column_stack(by)[often])
        last = np.sort((pair << SHIFT) | word)
        one = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        pairs, preceded = last[one], np.diff(np.r_[one, len(last)]).astype(np.int64)
        # (v, w) goes as the pair (v, 0) with the word w
        return _with_kinds(_by_shard(pairs & ~LOW, pairs & LOW, preceded, pair_key(pairs, bits)[0]), k, _kinds(counts))

    after = _reduced(_counted_trigrams(rows, model), n, trigrams_done, "shard int, block binary")

    def bigrams_done(k, blocks):
        blocks, third = _without_kinds(blocks)
        if not blocks:
            return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([[*third, *[0] * 5]], pa.list_(pa.int64()))], ["shard", "block", "kinds"])
        first, second, counts = summed(*_unpacked_pairs(blocks))
        first = first >> SHIFT
        model.continuations.write(k, pair_key((first << SHIFT) | second, bits)[1], counts)
        cu, iu = np.unique(first.astype(np.int64), return_inverse=True)
        t = np.bincount(iu * 3 + np.minimum(counts, 3) - 1, minlength=3 * len(cu)).reshape(-1, 3)
        of = np.bincount(iu, counts.astype(np.float64), len(cu)).astype(np.int64)
        cw, nw = np.unique(second.astype(np.int64), return_counts=True)
        out = []
        for r in range(ranges):
            a, b = np.searchsorted(cu, [r * width, (r + 1) * width])
            c, d = np.searchsorted(cw, [r * width, (r + 1) * width])
            if a < b or c < d:
                out.append((r, pack(np.diff(cu[a:b], prepend=r * width).astype(np.uint32), *(t[a:b, i].astype(np.int64) for i in range(3)), of[a:b], np.diff(cw[c:d], prepend=r * width).astype(np.uint32), nw[c:d].astype(np.int64))))
        kinds = pa.array([None] * len(out) + [[*third, *_kinds(counts)]], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out] + [-1], pa.int32()), pa.array([b for _, b in out] + [b""], pa.binary()), kinds], ["shard", "block", "kinds"])

    context = stored(_reduced(after, n, bigrams_done, "shard int, block binary, kinds array<long>"), "lm-words")
    found = context.agg(*[F.sum(F.col("kinds")[i]) for i in range(10)]).first()
    third, second = _discounts(*map(int, found[:4])), _discounts(*map(int, found[5:9]))

    def words_followed(r, blocks):
        dense = np.zeros((5, width), np.uint64)
        for b in blocks:
            du, t1, t2, t3, of, dw, nw = unpack(b, np.uint32, *[np.int64] * 4, np.uint32, np.int64)
            u, w = np.cumsum(du, dtype=np.int64), np.cumsum(dw, dtype=np.int64)
            for i, t in enumerate((t1, t2, t3, of)):
                dense[i, u] += t.astype(np.uint64)
            dense[4, w] += nw.astype(np.uint64)
        write(folder, f"word-context-{r}", dense if dense.max(initial=0) >> SHIFT else dense.astype(np.uint32))
        return pa.RecordBatch.from_arrays([pa.array([_kinds(dense[4]) + [int(dense[4].sum())]], pa.list_(pa.int64()))], ["kinds"])

    kinds = np.sum([r.kinds for r in _reduced(context.where("shard >= 0").select("shard", "block"), ranges, words_followed, "kinds array<long>").collect()], axis=0)
    d = _discounts(*map(int, kinds[:4]))
    model.bigrams, model.discounts = int(kinds[5]), (d, second, third)
    model.rest = float((d[0] * kinds[0] + d[1] * kinds[1] + d[2] * kinds[4]) / kinds[5])
    return model


def _cut(discounts: tuple[float, float, float], counts: np.ndarray) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(counts - np.array([0.0, *discounts])[np.minimum(counts, 3)], 0)


def probabilities(m: Model, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By token: log10 of the model's and of the base probability, and whether the word is known."""
    v, (d1, d2, d3) = m.vocabulary, m.discounts
    distinct, back = distinct_of(h)
    ids, counts = m.words.find(distinct)
    base = np.log10((counts[back] + 1.0) / (m.n_tokens + v + 1))
    if not v:
        return np.zeros(len(h)), base, np.zeros(len(h), bool)
    known = np.flatnonzero(ids >= 0)
    own = np.zeros((5, len(ids) + 1), np.int64)
    own[:, known] = m.followed(ids[known])
    own[:, -1] = m.followed(np.array([v]))[:, 0]
    # one word
    one = np.full(len(ids), m.rest / (v + 1))
    one[known] += _cut(d1, own[4, known]) / max(m.bigrams, 1)
    p = one[back]
    # two words
    start = np.zeros(len(h), bool)
    start[first[:-1]] = True
    before = np.r_[0, back[:-1]]
    before[start] = len(ids)
    of = np.r_[ids, v]
    there = (of[before] >= 0) & (ids[back] >= 0)
    pair = mix((of[before].astype(np.uint64) << SHIFT) | ids[back].astype(np.uint64))
    pairs, place = distinct_of(pair[there])
    cont = np.zeros(len(h), np.int64)
    cont[there] = m.continuations.find(*hash_key(pairs, m.bits))[place]
    rest = d2[0] * own[0] + d2[1] * own[1] + d2[2] * own[2]
    has = own[3][before] > 0
    b = before[has]
    p[has] = (_cut(d2, cont[has]) + rest[b] * p[has]) / own[3][b]
    # three words: the context is the pair that ends at the word before
    context = np.r_[np.uint64(0), pair[:-1]]
    context[start] = mix(np.array([(v << 32) | v], np.uint64))
    seen = np.r_[False, cont[:-1] > 0] | start
    at = np.flatnonzero(seen)
    contexts, place = distinct_of(context[at])
    stats = m.contexts.find(*hash_key(contexts, m.bits))[place]
    stats[stats[:, 3] == 0] = (1, 0, 0, 1)  # seen, but not kept: once, with one follower
    c = np.zeros(len(at), np.int64)
    some = np.flatnonzero(cont[at] > 0)
    t = at[some]
    c[some] = m.triples.find(shard_of(context[t], m.bits), triple_key(context[t], ids[back[t]].astype(np.uint64)))
    p[at] = (_cut(d3, c) + (stats[:, :3] @ np.array(d3)) * p[at]) / stats[:, 3]
    return np.log10(p), base, counts[back] > 0


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score (log10) to every row of ``docs``; the text column goes."""
    small_batches(docs.sparkSession)
    added = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [x.split()[0] for x in added.split(", ")]
    docs = docs.withColumn("__t", F.col(text)).drop(text, *names)
    kept = [c for c in docs.columns if c != "__t"]

    def scored(held):
        h, first = _joined([x for _, *x in held])
        own, base, known = probabilities(model, h, first)
        at = first[:-1]
        columns = [np.diff(first), np.add.reduceat(known.astype(np.int64), at), np.full(len(at), model.n_tokens, np.int64), np.add.reduceat(base, at), np.add.reduceat(own, at)]
        a = 0
        for part, _, f in held:
            yield pa.RecordBatch.from_arrays([*part, *[pa.array(c[a : a + len(f) - 1]) for c in columns]], [*kept, *names])
            a += len(f) - 1

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "__t"):
                held.append((part.columns[:-1], *tokens(part.column(part.num_columns - 1))))
                size += len(held[-1][1])
                if size > ASK:
                    yield from scored(held)
                    held, size = [], 0
        if held:
            yield from scored(held)

    kinds = {x.split()[0]: F.lit(0).cast(x.split()[1]) for x in added.split(", ")}
    return docs.select(*kept, "__t").mapInArrow(lean(run), docs.select(*kept).withColumns(kinds).schema)
