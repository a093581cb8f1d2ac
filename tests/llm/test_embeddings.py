"""Embedding near-duplicates against brute force, where vectors are close to each other, equal or many."""

from collections import Counter

import numpy as np
import pytest

from quarrystone.llm import embedding_dup

from test_operators import groups_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def wanted(ids, x, label, threshold=0.98):
    """Links and components by comparing all pairs; repeated rows are one vector."""
    u = unit(x.astype(np.float32).astype(np.float64))
    _, first = np.unique(np.column_stack([ids, label, x]), axis=0, return_index=True)
    near = (u[first] @ u[first].T >= threshold) & (label[first][:, None] == label[first])
    np.fill_diagonal(near, False)
    links = {(int(ids[f]), tuple(x[f].astype(np.float32).tolist())): int(n) for f, n in zip(first, near.sum(1), strict=True)}
    a, b = np.nonzero(np.triu(near))
    return links, groups_of(zip(ids[first][a].tolist(), ids[first][b].tolist(), strict=True), set(ids.tolist()))


def check(spark, ids, x, label, **options):
    rows = [(int(i), v.astype(np.float32).tolist(), int(k)) for i, v, k in zip(ids, x, label, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = embedding_dup.near_duplicates(df, **options).collect()
    links, groups = wanted(np.array(ids), x, np.array(label))
    assert len(got) == len(rows)
    assert Counter((r.vec_id, r.n_links) for r in got) == Counter((i, links[i, tuple(v)]) for i, v, _ in rows)
    assert all(r.component_id == groups[r.vec_id] and r.kept == (groups[r.vec_id] == r.vec_id) for r in got)
    return sum(links.values())


def with_mates(rng, x, n):
    """Some vectors get a mate at a cosine between 0.9801 and 0.99."""
    a = x[rng.choice(len(x), n, replace=False)]
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.9801, 0.99, (n, 1))
    return np.concatenate([x, c * a + np.sqrt(1 - c * c) * side])


@pytest.mark.parametrize("common", [0, 1, 3, 5])
def test_vectors_that_share_a_direction(spark, common):
    rng = np.random.default_rng(common)
    axis = unit(rng.normal(size=(1, 48)))
    x = with_mates(rng, unit(unit(rng.normal(size=(1200, 48))) + common * axis), 300)
    assert check(spark, range(len(x)), x, rng.integers(0, 2, len(x)), tile=200) >= 100


def test_one_tight_cluster(spark):
    rng = np.random.default_rng(1)
    x = unit(unit(rng.normal(size=(1, 64))) + 0.012 * rng.normal(size=(600, 64)))
    assert check(spark, range(600), x, np.zeros(600), tile=100) > 100_000


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_near_equal_vectors(spark, n):
    rng = np.random.default_rng(n)
    x = unit(np.ones((n, 16)) + 0.001 * rng.normal(size=(n, 16)))
    assert check(spark, range(n), x, np.zeros(n)) == n * (n - 1)


def test_long_substrings(spark):
    """What the plan would take for a large table: long substrings, many small buckets."""
    rng = np.random.default_rng(4)
    x = with_mates(rng, unit(rng.normal(size=(2000, 64))), 500)
    seen = embedding_dup.plan
    tables = seen(unit(x), 10**8, 0.98)
    assert tables.bits >= 10
    v = tables.projected(x)
    a, b = np.arange(500), np.arange(500)
    near = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    a, b = near.T
    found = (np.minimum(*tables.costs(v[a], v[b])) <= tables.budget).any(1)
    assert len(a) >= 500 and found.mean() >= 0.998
    row, table, key, own = tables.keys(v)
    held = {(int(t), int(k)) for t, k, o in zip(table, key, own, strict=True) if o}
    keys = Counter(zip(row.tolist(), table.tolist(), key.tolist(), strict=True))
    assert max(keys.values()) == 1 and len(held) <= len(x) * len(tables)


def test_equal_ids_and_equal_vectors(spark):
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(40, 8)))
    x = np.concatenate([x, x[:20], x[:5], x[:5], unit(x[:10] + 0.01 * rng.normal(size=(10, 8)))]).astype(np.float32)
    ids = [*range(40), *range(100, 120), *range(5), *range(200, 205), *range(10)]
    check(spark, ids, x, np.arange(len(x)) * 0)


def test_many_equal_vectors(spark):
    """20,000 equal vectors are one point: their rows meet no other row of the group."""
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(-1.0)).alias("embedding"), F.lit(1).alias("label"))
    df = df.union(spark.createDataFrame([(20_000, [1.0, 2.0, -1.01], 1), (20_001, [-1.0, 2.0, 1.0], 1)], df.schema))
    got = embedding_dup.near_duplicates(df).groupBy("n_links", "component_id", "kept").count().collect()
    assert Counter({(r.n_links, r.component_id, r.kept): r["count"] for r in got}) == {(20_000, 0, True): 1, (20_000, 0, False): 20_000, (0, 20_001, True): 1}


def test_columns_that_clash(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)], SCHEMA)
    for c in ("id", "h1", "rep", "n_links", "component_id", "kept", "cid", "m"):
        df = df.withColumn(c, F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dup.near_duplicates(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True)}
