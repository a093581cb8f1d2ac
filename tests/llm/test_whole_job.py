"""Operators on inputs where a part of the job was once left out, against brute force."""

import random

from pyspark.sql import functions as F

from quarrystone.llm import _pieces, mixing, near_dup, queries, token_count


def test_copies_with_own_text_stay_in_a_large_group(spark):
    """100 near copies make the shared values hot; 150 more carry a fifth of own text, at a similarity just above 0.8."""
    rng = random.Random(6)
    base = [f"b6-{i}" for i in range(404)]
    texts = []
    for k in range(100):
        words = list(base)
        words[403 if k % 2 else 0] = f"x{rng.random()}"
        texts.append(words)
    texts += [base + [f"own{rng.random()}" for _ in range(96)] for _ in range(150)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=5).collect()
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    assert all(100 * len(s & sets[0]) >= 80 * len(s | sets[0]) for s in sets)
    assert {r.doc_id for r in got if r.component_id != 0} == set()
    assert [r.doc_id for r in got if r.kept] == [0]


def test_counts_are_carried_without_a_path():
    """The count of each chunk is that of the walked best path, and the counter keeps no path."""
    assert not hasattr(token_count, "relax_unigram")
    with open(queries.MODEL, "rb") as f:
        counter = token_count.Counter(f.read())
    rng = random.Random(2)
    keys = ["".join(rng.choices("abetion sé漢😀\u0378", k=rng.randint(1, 40))).replace(" ", "") or "a" for _ in range(500)]
    lattice = _pieces.Lattice([_pieces.chunk_text(k) for k in keys])
    found = [(e, i) for e, i in counter.automaton.iter(lattice.joined)]
    ends, piece = (token_count.np.array(x) for x in zip(*found, strict=True))
    _, by, back = _pieces.relax_unigram(lattice, counter.pieces, ends + 1 - counter.pieces.length[piece], piece)
    want = []
    for first, at in zip(lattice.first.tolist(), lattice.last.tolist(), strict=True):
        n = 0
        while at > first:
            p = int(lattice.points[at - 1])
            n += 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF) if by[at] == -1 and counter.pieces.byte_fallback else 1
            at = int(back[at])
        want.append(n)
    assert counter.chunk_counts(keys).tolist() == want


def test_mix_stays_within_a_block_of_the_weights(spark):
    """Deviation from the weights themselves, past many periods and in a period that is never finished."""
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    for weights in ({}, {"s0": 0.3334, "s1": 0.3333, "s2": 0.33331}):
        rows = mixing.mix(df, weights, block_rows=1).select("source", "mix_slot").orderBy("mix_slot").collect()
        w = [weights.get(f"s{i}", 1.0) for i in range(3)]
        done = [0] * 3
        for t, r in enumerate(rows[:8900], 1):
            assert r.mix_slot == t - 1
            done[int(r.source[1])] += 1
            assert all(abs(done[i] - t * w[i] / sum(w)) < 1 + 1e-9 for i in range(3))
