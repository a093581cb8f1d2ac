"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Equal vectors of a label form a class, which is one point with a weight. ``fit`` learns ROTATIONS rotations from a bounded
sample with the ITQ iteration (codes are the signs of the rotated, centred unit vectors; the rotation is the orthogonal matrix
nearest to mapping vectors onto their codes). Each code is cut into substrings, and every substring is the key of one
Hamming table. A vector is stored under its own key and looks up, besides, the keys at a Hamming distance whose
flipped bits have squared projections of no more than ``budget`` in sum: centring and rotating keep distances, so two
vectors at cosine t differ in bits with squared projections of at most 1 - t in sum, on one of both sides. A budget of that
share of each substring finds every link; ``plan`` takes the least budget that finds all but LOST of made links at the
threshold itself (random directions, and directions between sampled vectors), and the length
and number of substrings that cost least with it, at KEYS keys a vector at most. Vectors close to each other get few short
substrings: then nearly all of a label meet, and nearly all are links.

Points that meet in a bucket, one of them stored there, are compared by cosine of the original vectors in double
precision; a pair that meets in several buckets is counted in the first of them. A bucket of more than TILE points is dealt
over tiles, and each pair of tiles is a task's group, so a hot bucket costs more groups, not a larger one. Of the links only
counts per point and a star of each local component leave a task.

Edge cases: vectors that are null, empty, zero or hold a null, infinite or NaN component link with nothing, as do those with
a null label; vectors of different lengths never link. Repeated rows are one vector, counted once, and each row gets its
result. An id with several vectors has each row counted by its own vector (the others may be among its links) and one component. A
null id is a row of its own without links. Other columns are ignored, whatever their names. An empty table gives an empty result. A sample with fewer
vectors than dimensions is fine.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, lean, local_roots, stored

ROTATIONS = 2
#: Keys of a vector in all tables, on average, at most.
KEYS = 64
#: Bits of a substring that are tried.
LENGTHS = (1, 2, 4, 6, 8, 10, 12, 16, 20, 24, 30)
#: Share of made links at the threshold that the tables may miss.
LOST = 0.0001
#: What comparing two points costs, in rows sent to a bucket.
PAIR_COST = 0.01
TILE = 1024
#: Vectors in the training sample, at most; those with the smallest hash.
SAMPLE = 4096


def fit(vectors: np.ndarray, rotations: int = ROTATIONS, iterations: int = 15, seed: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean and rotations; each starts from its own random orthogonal matrix."""
    rng = np.random.default_rng(seed)
    mean = vectors.mean(0) if len(vectors) else np.zeros(vectors.shape[1])
    x = vectors - mean
    d = x.shape[1]
    axes = np.linalg.svd(x.T @ x)[0] if len(x) else np.eye(d)
    out = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        v = x @ axes
        for _ in range(iterations if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, out


class Tables:
    """Substrings of ``bits`` bits of every rotation's code, and the keys that a vector looks up."""

    def __init__(self, mean: np.ndarray, rotations: list[np.ndarray], bits: int, budget: float):
        self.mean, self.all, self.bits, self.budget = mean, np.concatenate(rotations, 1), bits, budget
        d = len(mean)
        self.cut = [np.arange(r * d + i, r * d + i + bits) for r in range(len(rotations)) for i in range(0, d - bits + 1, bits)]

    def __len__(self) -> int:
        return len(self.cut)

    def projected(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.all

    def costs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By pair and table: the squared projections that differ in sign, of the first and of the second vector."""
        differ = (a >= 0) != (b >= 0)
        return tuple(np.stack([np.where(differ[:, c], x[:, c] ** 2, 0).sum(1) for c in self.cut], 1) for x in (a, b))

    def keys(self, v: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, table, key and whether it is the vector's own, for all keys of the projections ``v``; ``most`` stops a count early."""
        out, total = [], 0
        for t, c in enumerate(self.cut):
            own = (v[:, c] >= 0) @ (1 << np.arange(len(c), dtype=np.int64))
            out.append((np.arange(len(v)), np.full(len(v), t), own, np.ones(len(v), bool)))
            sq = v[:, c] ** 2
            order = np.argsort(sq, 1, kind="stable")
            sq, bit = np.take_along_axis(sq, order, 1), np.int64(1) << order
            row, last, cost, mask = np.arange(len(v)), np.zeros(len(v), np.int64), sq[:, 0], bit[:, 0]
            while len(row):  # of each set of flipped bits: one with the next bit added, one with the last bit moved on
                fits = cost <= self.budget
                row, last, cost, mask = row[fits], last[fits], cost[fits], mask[fits]
                out.append((row, np.full(len(row), t), own[row] ^ mask, np.zeros(len(row), bool)))
                total += len(row)
                if most and total > most:
                    break
                more = last + 1 < len(c)
                row, last, cost, mask = row[more], last[more], cost[more], mask[more]
                nxt, b = sq[row, last + 1], bit[row, last + 1]
                cost, mask = np.concatenate([cost + nxt, cost + (nxt - sq[row, last])]), np.concatenate([mask | b, mask ^ bit[row, last] | b])
                row, last = np.concatenate([row, row]), np.concatenate([last + 1, last + 1])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def made_links(x: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold: turned in random directions, and towards other vectors of the sample."""
    a = x[rng.integers(0, len(x), 4096)]
    to = np.concatenate([rng.normal(size=(2048, x.shape[1])), x[rng.integers(0, len(x), 2048)]])
    side = to - (to * a).sum(1, keepdims=True) * a
    size = np.linalg.norm(side, axis=1, keepdims=True)
    good = size[:, 0] > 1e-9
    side = side[good] / size[good]
    return a[good], threshold * a[good] + (max(0.0, 1 - threshold * threshold) ** 0.5) * side


def plan(x: np.ndarray, n: int, threshold: float, keys: int = KEYS, lost: float = LOST) -> Tables:
    """The cheapest tables for ``n`` vectors of a label like the unit vectors ``x``: rows to shuffle, and pairs to compare."""
    mean, rotations = fit(x)
    rng = np.random.default_rng(3)
    d = x.shape[1]
    a, b = made_links(x, threshold, rng)
    some = x[rng.permutation(len(x))[:256]]
    left, right = x[rng.integers(0, len(x), 4096)], x[rng.integers(0, len(x), 4096)]
    best, best_cost = None, np.inf
    top = min(d, max(1, int(n)).bit_length() + 4)
    for bits in (b for b in LENGTHS if b <= top):
        t = Tables(mean, rotations, bits, 0.0)
        far = np.minimum(*t.costs(t.projected(left), t.projected(right)))
        made = np.minimum(*t.costs(t.projected(a), t.projected(b))) if len(a) else np.zeros((1, len(t)))
        whole, own = t.cut, len(t.cut) // len(rotations)
        for tables in sorted({len(whole) >> i for i in range(8)} - {0}):
            t = Tables(mean, rotations, bits, 0.0)
            t.cut = whole[:tables]
            # the substrings of one rotation find every link within this budget
            sure = (1 - threshold) / min(tables, own) + 1e-12
            t.budget = min(sure, float(np.quantile(made[:, :tables].min(1), 1 - lost)) * 1.1 + 1e-12)
            compared = PAIR_COST * n * float((far[:, :tables] <= t.budget).sum(1).mean())
            if tables + compared >= best_cost:
                continue
            per = len(t.keys(t.projected(some), most=2 * keys * len(some))[0]) / len(some)
            if per <= keys and per + compared < best_cost:
                best, best_cost = t, per + compared
    return best


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, keys: int = KEYS, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors``: id_col, n_links (other vectors linked directly), component_id, kept."""
    kind = vectors.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(kind).alias("v"))
    good = F.expr("id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    rows = rows.withColumns({"h1": F.when(good, F.xxhash64("label", "v")), "h2": F.when(good, F.xxhash64("v", F.lit(1), "label"))})
    members = stored(rows.select("id", "h1", "h2"), "vector-members")
    own = members.where("h1 is not null").distinct()
    classes = own.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "rep", "m", "h1", "h2"), "vector-classes")
    one = rows.where("h1 is not null").withColumnRenamed("id", "rep").join(classes, ["rep", "h1", "h2"]).dropDuplicates(["cid"])
    points = stored(one.select("cid", "rep", "m", "label", "v", F.size("v").alias("dim")), "vector-points")
    found = None
    for dim in sorted(r.dim for r in points.select("dim").distinct().collect()):
        part = points.where(F.col("dim") == dim)
        n = part.groupBy("label").count().agg(F.max("count")).first()[0]
        tables = _trained(part.orderBy(F.xxhash64("cid", "rep"), "cid").limit(sample).select("v"), n, threshold, keys)
        links = stored(_links(part, tables, threshold, tile), "vector-links")
        found = links if found is None else found.union(links)
    if found is None:
        zero = F.lit(0).cast("long")
        return members.select(F.col("id").alias(id_col), zero.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    per = classes.join(counts, "cid", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    stars = found.where("root != rep").select(F.col("root").alias("src"), F.col("rep").alias("dst"))
    shared = own.join(classes.where("m > 1"), ["h1", "h2"]).where("id != rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    linked = components(stars.union(shared), "vectors").withColumnRenamed("node", "id")
    out = members.join(per, ["h1", "h2"], "left").join(linked, "id", "left")
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), comp.eqNullSafe(F.col("id")).alias("kept"))


def _trained(chosen: DataFrame, n: int, threshold: float, keys: int) -> Tables:
    """The tables for a bounded sample, fitted in one task, where linear algebra keeps to the task's cores."""

    def learn(batches):
        x = np.concatenate([_matrix(b.column(0)) for b in batches if b.num_rows])
        x = _unit(x[np.lexsort(x.T[::-1])])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(plan(x, n, threshold, keys))])], ["m"])

    return pickle.loads(chosen.repartition(1).mapInArrow(lean(learn), "m binary").collect()[0].m)


def _links(points: DataFrame, tables: Tables, threshold: float, tile: int) -> DataFrame:
    """Rows (cid, rep, n, root): of a task's group, the weight of what each linked point is linked with, and its local root."""
    spark = points.sparkSession
    sent = spark.sparkContext.broadcast(tables)

    def keyed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, table, key, own = sent.value.keys(sent.value.projected(_unit(_matrix(part.column(2)))))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(table.astype(np.int32)), pa.array(key), pa.array(own)], ["cid", "label", "t", "k", "own"])

    def joined(batches):
        """Rows come sorted by group; one that crosses a batch is carried over."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(group)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if held and held[0].column(0)[0].as_py() != group[0]:
                yield from linked(held)
                held = []
            if last:
                yield from linked([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from linked(held)

    def linked(parts):
        tables = sent.value
        g = pa.Table.from_batches(parts).combine_chunks()
        grp, cid, rep, m, table, own, side, crossed = (g.column(i).to_numpy() for i in (0, 1, 2, 3, 5, 6, 7, 8))
        x = _unit(_matrix(g.column(4).chunk(0)))
        cuts = np.r_[0, np.flatnonzero(np.diff(grp)) + 1, len(grp)]
        sizes = np.diff(cuts)
        small, a, b = np.repeat(sizes <= 32, sizes), [], []
        for d in range(1, int(sizes[sizes <= 32].max(initial=1))):  # small groups: all points against those d places on
            i = np.flatnonzero((grp[:-d] == grp[d:]) & small[:-d] & (own[:-d] | own[d:]))
            i = i[np.einsum("ij,ij->i", x[i], x[i + d]) >= threshold]
            i = i[~crossed[i] | (side[i] != side[i + d])]
            a.append(i)
            b.append(i + d)
        for k in np.flatnonzero(sizes > 32):
            s, e = int(cuts[k]), int(cuts[k + 1])
            for r in range(s, e, 1024):  # a block of rows against the group: bounded memory
                to = min(e, r + 1024)
                near = (x[r:to] @ x[s:e].T >= threshold) & (own[r:to, None] | own[s:e])
                if crossed[s]:
                    near &= side[r:to, None] != side[s:e]
                i, j = np.nonzero(near)
                up = i + r < j + s
                a.append(i[up] + r)
                b.append(j[up] + s)
        a, b = (np.concatenate([*y, np.zeros(0, np.int64)]).astype(np.int64) for y in (a, b))
        swap = cid[a] > cid[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        first = np.zeros(len(a), bool)
        v = tables.projected(x)
        for s in range(0, len(a), 1 << 14):
            first[s : s + (1 << 14)] = _first(tables, v, own, table, a[s : s + (1 << 14)], b[s : s + (1 << 14)])
        a, b = a[first], b[first]
        if len(a):
            n = np.bincount(np.r_[a, b], np.r_[m[b], m[a]].astype(np.float64), len(cid)).astype(np.int64)
            root = local_roots(len(cid), a, b, rep)
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(y[hit]) for y in (cid, rep, n, root)], ["cid", "rep", "n", "root"])

    entries = points.select("cid", "label", "v").mapInArrow(lean(keyed), "cid long, label string, t int, k long, own boolean")
    entries = stored(entries.select("cid", "t", "own", F.xxhash64("label", "t", "k").alias("bucket")), "vector-keys")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.count(F.when(F.col("own"), 1)).alias("stored")).where("m > 1 and stored > 0")
    met = entries.join(sizes.select("bucket", F.ceil(F.col("m") / tile).alias("tiles")), "bucket").withColumn("side", F.pmod(F.xxhash64("cid", "bucket"), F.col("tiles")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    lo, hi = F.least("side", "other"), F.greatest("side", "other")
    met = met.select("cid", "t", "own", "side", F.xxhash64("bucket", lo, hi).alias("grp"), (lo != hi).alias("crossed"))
    full = met.join(points.select("cid", "rep", "m", "v"), "cid").select("grp", "cid", "rep", "m", "v", "t", "own", "side", "crossed")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(lean(joined), "cid long, rep long, n long, root long")


def _first(tables: Tables, v: np.ndarray, own: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bucket of each pair (smaller id first) is the first where it meets: no earlier table has it, and of the two
    buckets that one table can have, it is the one where the smaller id is stored."""
    from_a, from_b = tables.costs(v[a], v[b])
    at = table[a]
    earlier = ((np.minimum(from_a, from_b) <= tables.budget) & (np.arange(len(tables)) < at[:, None])).any(1)
    i = np.arange(len(a))
    other = ~(own[a] & own[b]) & ~own[a] & (from_b[i, at] <= tables.budget)
    return ~earlier & ~other
