"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL operations only.

The rows of a source, in the order of the MD5 of their id, form blocks. Weights, as their decimal text says, become
whole quotas of a period that holds them exactly, of up to ``slots`` slots where that is possible. Block k of a source with quota q has release floor(k * slots / q) and deadline ceil((k + 1) * slots / q);
in each slot the released block with the earliest deadline runs (the first source in name order on a tie). The quotas fill the
period, so every block runs in its window and after any number of slots each source is less than one block away from
its share. The schedule of one period repeats: block b of a source runs in period b div q, in the slot of its block b mod q.

A source that runs out leaves its slots empty, and the others keep their proportion; all rows stay. ``mix_slot`` is
the slot, ``mix_position`` = slot * block_rows + place in the block orders the whole table (unique, with gaps where
sources have run out).

Rows are numbered without gathering a source: each source is cut into ranges of the hash, up to 2**16 and of about
``range_rows`` rows, and numbers come from the counts of the ranges before. Where an id (or a null one) holds far more rows than a
range, its range is cut by a hash of the whole row; only rows that are equal in all columns stay together.

Edge cases: a null source is a source of its own (named by None in ``weights``, last in order); sources not in ``weights``
get ``default_weight``; a weight must be positive. Rows with equal ids are numbered by a hash of their other columns
(maps and variants left out); equal rows keep one place each. Columns called mix_block, mix_slot or mix_position are
replaced. An empty table stays empty. More than MAX_SOURCES sources are refused.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1000
BLOCK_ROWS = 64
RANGE_ROWS = 256
#: What the driver can hold of sources and their quotas; the schedule itself has no such bound.
MAX_SOURCES = 1_000_000
#: A range with so many times its rows is cut further, by this many bits of a hash of the whole row.
OVER, TIE_BITS = 16, 12
#: Periods up to this many slots are laid out by a SQL aggregate; of longer ones only the slots that the rows need, on the driver.
LONGEST = 2000


def quotas(weights: list[float], slots: int) -> list[int]:
    """Whole parts of ``slots`` in proportion to the weights, by largest remainder (earlier first on a tie), at least 1 each."""
    total = sum(weights)
    exact = [slots * w / total for w in weights]
    out = [max(1, math.floor(x)) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (-(exact[i] - math.floor(exact[i])), i))
    at = 0
    while sum(out) < slots:
        out[order[at % len(order)]] += 1
        at += 1
    while sum(out) > slots:
        out[max(range(len(out)), key=lambda i: (out[i], -i))] -= 1
    return out


def whole(weights: list[float], slots: int) -> tuple[list[int], int]:
    """Quotas in exactly the proportion of the weights and their sum: the largest multiple of the least such sum up to ``slots``, or that sum."""
    exact = [Fraction(str(w)) for w in weights]
    scale = math.lcm(*(x.denominator for x in exact))
    least = [int(x * scale) for x in exact]
    divisor = math.gcd(*least)
    least = [x // divisor for x in least]
    times = max(1, slots // sum(least))
    return [x * times for x in least], sum(least) * times


def first_slots(quota: list[int], slots: int, n: int) -> list[int]:
    """The source of each of the first ``n`` slots of a long period, by the rule of ``schedule``."""
    waiting, ready, out = [(0, i, 0) for i in range(len(quota))], [], []
    for t in range(n):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * slots // quota[i]), i, k))
        _, i, k = heapq.heappop(ready)
        out.append(i)
        if k + 1 < quota[i]:
            heapq.heappush(waiting, ((k + 1) * slots // quota[i], i, k + 1))
    return out


def schedule(quota: list[int], slots: int) -> str:
    """SQL array of the source (by place in ``quota``) that runs in each slot of a period."""
    q = f"array({', '.join(f'{x}L' for x in quota)})"
    pick = (
        f"array_min(transform(filter(sequence(0, {len(quota) - 1}), i -> s.k[i] < {q}[i] and (s.k[i] * {slots}) div {q}[i] <= t), "
        f"i -> named_struct('deadline', ((s.k[i] + 1) * {slots} + {q}[i] - 1) div {q}[i], 'i', i))).i"
    )
    step = f"transform(array({pick}), p -> named_struct('k', transform(s.k, (x, i) -> x + if(i = p, 1L, 0L)), 'out', concat(s.out, array(p))))[0]"
    return f"aggregate(sequence(0, {slots - 1}), named_struct('k', array_repeat(0L, {len(quota)}), 'out', cast(array() as array<int>)), (s, t) -> {step}, s -> s.out)"


def mix(df: DataFrame, weights: dict | None = None, source: str = "source", id_col: str = "doc_id", default_weight: float = 1.0, block_rows: int = BLOCK_ROWS, slots: int = SLOTS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add mix_block, mix_slot and mix_position to every row of ``df``."""
    spark, weights = df.sparkSession, weights or {}
    df = df.drop("mix_block", "mix_slot", "mix_position")
    found = df.groupBy(F.col(source).alias("s")).count().orderBy(F.col("s").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    given = [float(weights.get(r.s, default_weight)) for r in found]
    if any(not 0 < w < math.inf for w in given):
        raise ValueError("weights must be positive")
    if not found:
        zero = F.lit(0).cast("long")
        return df.withColumns({"mix_block": zero, "mix_slot": zero, "mix_position": zero})
    quota, slots = whole(given, slots)
    bits = [min(16, max(0, math.ceil(math.log2(max(1, r["count"] / range_rows))))) for r in found]
    kind = df.schema[source].dataType.simpleString()
    plan = spark.createDataFrame([(r.s, i, q, b) for i, (r, q, b) in enumerate(zip(found, quota, bits, strict=True))], f"__s {kind}, __i int, __q long, __b int")
    if slots <= LONGEST:
        runs = spark.range(1).select(F.posexplode(F.expr(schedule(quota, slots))).alias("__slot", "__i"))
    else:
        need = max(-(-math.ceil(r["count"] / block_rows) * slots // q) for r, q in zip(found, quota, strict=True))
        runs = spark.createDataFrame(list(enumerate(first_slots(quota, slots, min(slots, need)))), "__slot long, __i int")
    runs = runs.withColumn("__nth", F.row_number().over(Window.partitionBy("__i").orderBy("__slot")) - 1)

    own = [c for c in df.columns if not df.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    rows = df.join(F.broadcast(plan), df[source].eqNullSafe(plan["__s"])).drop("__s")
    rows = rows.withColumn("__h", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("__r", F.expr("shiftrightunsigned(cast(conv(substring(__h, 1, 8), 16, 10) as bigint), 32 - __b)"))
    rows = rows.withColumn("__tie", F.xxhash64(*own))
    # a range far over its size holds an id many times: it is cut further, by id and the top bits of the tie, in the same order
    sized = F.greatest(F.lit(range_rows), F.col("count") / F.pow(F.lit(2), F.col("__b")))
    over = rows.groupBy("__i", "__r").agg(F.count("*").alias("__n"))
    expected = spark.createDataFrame([(i, r["count"], b) for i, (r, b) in enumerate(zip(found, bits, strict=True))], "__i int, count long, __b int")
    over = over.join(F.broadcast(expected), "__i").where(F.col("__n") > OVER * sized).select("__i", "__r", F.lit(True).alias("__over"))
    rows = rows.join(over, ["__i", "__r"], "left")
    cut = F.struct("__h", F.col(id_col).alias("id"), F.shiftright("__tie", 64 - TIE_BITS).alias("t"))
    rows = rows.withColumn("__u", F.when(F.col("__over"), cut)).drop("__over")
    counts = rows.groupBy("__i", "__r", "__u").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__i").orderBy("__r", "__u").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__i").alias("__oi"), F.col("__r").alias("__or"), F.col("__u").alias("__ou"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__i", "__r", "__u").orderBy("__h", F.col(id_col), "__tie")) - 1
    rows = rows.withColumn("__k", nth)
    here = (F.col("__i") == F.col("__oi")) & (F.col("__r") == F.col("__or")) & F.col("__u").eqNullSafe(F.col("__ou"))
    rows = rows.join(offsets, here).withColumn("__k", F.col("__k") + F.col("__before"))
    rows = rows.withColumn("mix_block", F.floor(F.col("__k") / block_rows)).withColumn("__nth", F.col("mix_block") % F.col("__q"))
    rows = rows.join(F.broadcast(runs), ["__i", "__nth"])
    rows = rows.withColumn("mix_slot", F.floor(F.col("mix_block") / F.col("__q")) * slots + F.col("__slot"))
    rows = rows.withColumn("mix_position", F.col("mix_slot") * block_rows + F.col("__k") % block_rows)
    return rows.select(*df.columns, "mix_block", "mix_slot", "mix_position")


def mixed(df: DataFrame, *args, **options) -> DataFrame:
    """The rows of ``df`` with its own columns, in the order of the mix."""
    return mix(df, *args, **options).orderBy("mix_position").select(*df.columns)
