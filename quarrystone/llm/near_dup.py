"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Each document becomes its set of hashed word shingles; the SKETCH smallest hashes are its bottom-k sketch.
   Documents with equal sets (same size and 128-bit sum hash) form a class; its smallest id represents it.
2. Inverted lists hold the representatives under their LISTED smallest retained values. A value whose list is longer than LONG is
   hot: every document that retains it is listed under the value with the next two retained ones instead, however many
   other values it has, as those may all be its own text. So no list holds more than documents that agree on a run of values.
3. Round one compares every member of a list with the list's smallest document. Round two compares all members of
   different components (pairs inside one cannot change the result). Where at most LONG members are outside the
   list's most common component, pairs of those with the others are made. A list with more is dealt over tiles of TILE
   members; each pair of tiles is a task that counts exact intersections by matrix products and returns a star of each
   component it finds, not pairs. A pair of documents that shares several such lists is looked at in the first.
4. Otherwise a pair passes when the union sketch (the smallest values of both sketches) estimates a similarity within four
   standard deviations of the threshold; sets that fit their sketches are exact there. Exact Jaccard on the full
   sets, made again from the texts of the pair's two documents, decides each link. Texts that no pair needs are left
   out before the shuffle by a bitmap of 2**BITMAP bits, whatever the size of the input; a wrong bit only costs traffic.
5. Components of the links give the groups.

Edge cases: a document without words, or a null text, has the empty set, links with nothing and is kept; one with
fewer words than the shingle size has its whole sequence as the one shingle; rows with equal ids are one node, and each
row gets that node's result, taken over the union of their links; a null id is a row of its own that links with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, discard, groups, lean, local_roots, slices, small_batches, stored, utf8
from ._words import Words, distinct, list_array, mix, shingles

SKETCH = 64
LONG = 64
LISTED = 32
BITMAP = 26
TILE = 1024
#: Slots of consecutive values, from a hot one on, that a document is listed under.
RUN = 3


def _described(docs: DataFrame, id_col: str, text: str, size: int, sketch: int) -> DataFrame:
    """Per row: id, n_shingles, a 128-bit set hash and the sketch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__t"):
                values, first = distinct(*shingles(Words(part.column(1)), size), part.num_rows)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values * np.uint64(k)))]) for k in (3, 5)]
                sums = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
                low = np.minimum(np.diff(first), sketch)
                start = np.concatenate([[0], np.cumsum(low)])
                pick = np.repeat(first[:-1] - start[:-1], low) + np.arange(start[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), *map(pa.array, sums), list_array((values[pick] ^ np.uint64(1 << 63)).view(np.int64), start, pa.int64())], ["id", "n", "h1", "h2", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("__t"))
    return rows.mapInArrow(lean(run), "id long, n long, h1 long, h2 long, sketch array<long>")


def _lists(reps: DataFrame, listed: int, long: int) -> DataFrame:
    """Entries (key, id, n, leader, nl) of the inverted lists that hold at least two documents; nl: the leader's size."""
    entries = reps.select("id", "n", F.posexplode(F.slice("sketch", 1, listed)).alias("i", "v"))
    hot = stored(entries.groupBy("v").count().where(F.col("count") > long).select("v", F.lit(True).alias("hot")), "hot")
    marked = entries.join(hot, "v", "left").select("id", "n", "i", "v", F.coalesce("hot", F.lit(False)).alias("hot"))
    per_doc = marked.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("i", "v", "hot"))).alias("e"))
    own = F.filter("e", lambda x: ~x.hot)
    runs = F.expr(
        f"transform(filter(sequence(0, size(e) - 1), j -> e[j].hot), "
        f"j -> xxhash64(e[j].v, slice(e.v, j + 2, {RUN - 1})))"
    )
    keys = F.concat(F.transform(own, lambda x: x.v), runs)
    rows = stored(per_doc.select("id", "n", F.explode(F.array_distinct(keys)).alias("key")), "entries")
    shared = rows.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("id", "n")).alias("l")).where("m > 1")
    return rows.join(shared, "key").select("key", "id", "n", F.col("l.id").alias("leader"), F.col("l.n").alias("nl"))


def _passing(pairs: DataFrame, sketches: DataFrame, threshold: float, sketch: int) -> DataFrame:
    """Distinct pairs (a, b) whose union sketches allow the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("id").alias(side), F.col("sketch").alias(f"s{side}")), side)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, sketch)
    both = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    exact = F.size(F.array_union("sa", "sb")) <= sketch
    slack = F.when(exact, F.lit(1e-9)).otherwise(4 * (threshold * (1 - threshold) / sketch) ** 0.5)
    return pairs.where(both / F.size(union) >= threshold - slack).select("a", "b")


def _texts(docs: DataFrame, id_col: str, text: str, pairs: DataFrame) -> DataFrame:
    """(id, packed) of the documents in ``pairs``, and of a few others."""
    spot = F.xxhash64("id").bitwiseAND(F.lit((1 << BITMAP) - 1))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    words = ids.select(spot.alias("h")).groupBy(F.expr("h div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP - 6), np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches):
        bits = np.frombuffer(sent.value, np.uint64)
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            h = batch.column(1).to_numpy()
            hit = np.flatnonzero(bits[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1))
            raw, at = utf8(batch.column(2))
            packed = [press.compress(raw[at[i] : at[i + 1]].tobytes()) for i in hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array(packed, pa.binary())], ["id", "packed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("__t")).where("id is not null")
    return rows.select("id", spot.alias("h"), "__t").mapInArrow(lean(run), "id long, packed binary")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs that hold 100 * intersection >= percent * union on the full sets."""

    def run(batches):
        expand = zstandard.ZstdDecompressor()

        def full(packed):
            text = expand.decompress(packed.as_buffer().to_pybytes()).decode("utf-8", "surrogatepass")
            return np.unique(shingles(Words(pa.array([text])), size)[0])

        at, x = None, None
        for batch in batches:
            keep = []
            for a, pa_, pb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != at:
                    at, x = a, (pa_, full(pa_))
                elif not x[0].equals(pa_):
                    x = (pa_, full(pa_))
                y = full(pb)
                both = len(np.intersect1d(x[1], y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x[1]) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    for side in ("b", "a"):
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("packed").alias(f"p{side}")), side)
    return pairs.select("a", "b", "pa", "pb").mapInArrow(lean(run), "a long, b long")


def _tiled(big: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) inside long lists ``big(key, id, comp, m)``: a star of each component that a pair of tiles holds."""

    def run(batches):
        expand = zstandard.ZstdDecompressor()
        for t in groups(batches):
            ids, comp, own = (t.column(i).to_numpy() for i in (2, 3, 5))
            key, crossed = t.column(1)[0].as_py(), t.column(6)[0].as_py()
            need = np.triu(comp[:, None] != comp, 1)
            if crossed:
                need &= own[:, None] != own
            before = [[k for k in keys if k < key] for keys in t.column(4).to_pylist()]
            place = {k: i for i, k in enumerate({k for ks in before for k in ks})}
            member = np.zeros((len(ids), len(place)), np.float32)
            for i, ks in enumerate(before):
                member[i, [place[k] for k in ks]] = 1
            need &= member @ member.T == 0
            rows = np.flatnonzero(need.any(0) | need.any(1))
            if not len(rows):
                continue
            need, ids = need[np.ix_(rows, rows)], ids[rows]
            texts = [expand.decompress(t.column(7)[int(i)].as_buffer().to_pybytes()).decode("utf-8", "surrogatepass") for i in rows]
            values, first = distinct(*shingles(Words(pa.array(texts)), size), len(rows))
            n = np.diff(first).astype(np.float64)
            of = np.repeat(np.arange(len(rows)), np.diff(first))
            _, place, count = np.unique(values, return_inverse=True, return_counts=True)
            shared = count[place] > 1
            column = (np.cumsum(count > 1) - 1)[place[shared]]
            of = of[shared]
            order = np.argsort(column, kind="stable")
            column, of = column[order], of[order]
            both = np.zeros((len(rows), len(rows)))
            for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
                a, b = np.searchsorted(column, [at, at + 4096])
                dense = np.zeros((len(rows), 4096), np.float32)
                dense[of[a:b], column[a:b] - at] = 1
                both += dense @ dense.T
            a, b = np.nonzero(need & (100 * both >= percent * (n[:, None] + n - both)))
            if len(a):
                root = local_roots(len(ids), a, b, ids)
                own_root = root != ids
                yield pa.RecordBatch.from_arrays([pa.array(root[own_root]), pa.array(ids[own_root])], ["a", "b"])

    keys = big.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    dealt = big.join(keys, "id").withColumn("tiles", F.ceil(F.col("m") / TILE)).withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("tiles")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.withColumn("grp", F.xxhash64("key", lo, hi)).withColumn("crossed", lo != hi)
    full = dealt.join(texts, "id").select("grp", "key", "id", "comp", "keys", "own", "crossed", "packed")
    n = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, sketch: int = SKETCH, listed: int = LISTED, long: int = LONG) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id, kept (the id is the smallest of its component)."""
    small_batches(docs.sparkSession)
    threshold = percent / 100
    all_rows = stored(_described(docs, id_col, text, size, sketch), "sketches")
    filled = all_rows.where("id is not null and n > 0")
    classes = stored(filled.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
    copies = classes.where("m > 1").select("n", "h1", "h2", "rep")
    same = filled.select("id", "n", "h1", "h2").join(copies, ["n", "h1", "h2"]).where("id != rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    reps = stored(filled.join(classes.select(F.col("rep").alias("id"), "n", "h1", "h2"), ["id", "n", "h1", "h2"], "left_semi").select("id", "n", "sketch"), "reps")

    def linked(pairs):
        near = stored(_passing(pairs, reps.select("id", "sketch"), threshold, sketch), "near")
        return stored(_verified(near, _texts(docs, id_col, text, near), size, percent), "links")

    lists = stored(_lists(reps, listed, long), "lists")
    sized = F.least("n", "nl") >= F.greatest("n", "nl") * threshold
    one = stored(lists.where(F.col("id") != F.col("leader")).where(sized).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = linked(one)
    found = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = stored(lists.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp")), "placed")
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    top = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("t"), F.count("*").alias("comps"), F.sum("c").alias("m"))
    top = top.where("comps > 1").select("key", "m", F.col("t.comp").alias("main"), (F.col("m") - F.col("t.c") > long).alias("long"))
    every = stored(placed.join(top, "key"), "mixed")
    big, mixed = every.where("long").select("key", "id", "comp", "m"), every.where("not long")
    tiled = stored(_tiled(big, _texts(docs, id_col, text, big.select(F.col("id").alias("a"), F.col("id").alias("b"))), size, percent), "tiled")
    odd = mixed.where("comp != main").select(F.col("key").alias("kx"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"))
    others = mixed.select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), (F.col("comp") == F.col("main")).alias("in_main"))
    fits = (F.least("nx", "ny") >= F.greatest("nx", "ny") * threshold) & (F.col("cx") != F.col("cy")) & (F.col("in_main") | (F.col("x") < F.col("y")))
    two = odd.join(others, (F.col("kx") == F.col("key")) & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = linked(two.join(one, ["a", "b"], "left_anti"))
    final = components(links.union(more).union(tiled).select(F.col("a").alias("src"), F.col("b").alias("dst")).union(same))
    discard(lists, one, links, placed, every, more, tiled, found, reps)
    rows = all_rows.select("id", "n").join(final.withColumnRenamed("node", "id"), "id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (component.eqNullSafe(F.col("id"))).alias("kept"))
