"""Tables of the language model: small and large numbers, absent keys, equal keys."""

import numpy as np

from quarrystone.llm import _store, language_model
from quarrystone.llm._store import PackedTable


def test_packed_tables_give_back_all_numbers(tmp_path):
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 38, 5000, dtype=np.uint64))
    keys = np.unique(np.r_[keys, keys[:50] ^ np.uint64(1), keys[:50] ^ np.uint64(3)])
    one = rng.integers(1, 6, len(keys))
    one[::97] = 5 << 40
    four = rng.integers(0, 300, (len(keys), 4))
    four[::89] = 1 << 35
    order = rng.permutation(len(keys))
    t1, t4 = PackedTable(str(tmp_path), "a"), PackedTable(str(tmp_path), "b", 4)
    for t, values in ((t1, one), (t4, four)):
        t.write(0, keys[order], values[order])
        ask = np.r_[keys[::-1], keys ^ np.uint64(1 << 20)]
        shards = np.r_[np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)]
        got = t.find(shards, ask)
        assert (got[: len(keys)] == values[::-1]).all()
        there = np.isin(ask[len(keys) :], keys)
        assert not got[len(keys) :][~there].any()
        assert not t.find(np.ones(3, np.int64), keys[:3]).any()
    t1.write(2, np.array([7, 7, 9], np.uint64), np.array([1, 2, 4]))
    assert t1.find(np.full(3, 2), np.array([7, 8, 9], np.uint64)).tolist() == [3, 0, 4]
    t4.write(3, np.zeros(0, np.uint64), np.zeros((0, 4), np.int64))
    assert t4.find(np.array([3]), np.array([5], np.uint64)).tolist() == [[0, 0, 0, 0]]


def test_counts_have_64_bits():
    key = np.array([1], np.uint64)
    assert _store.merge([key, key], [np.array([3_000_000_000]), np.array([3_000_000_000])])[1].tolist() == [6_000_000_000]
    pair, word, n = language_model.summed(np.array([5, 5], np.uint64), np.array([2, 2], np.uint64), np.array([3_000_000_000, 3_000_000_000]))
    assert (pair.tolist(), word.tolist(), n.tolist()) == ([5], [2], [6_000_000_000])


def test_blocks_come_back():
    rng = np.random.default_rng(1)
    pair, word, n = language_model.summed(rng.integers(0, 1 << 40, 900, dtype=np.uint64) // np.uint64(1 << 30), rng.integers(0, 50, 900, dtype=np.uint64))
    n[0] = 1 << 40
    back = language_model._unpacked_pairs([language_model._packed_pairs(pair[:400], word[:400], n[:400]), language_model._packed_pairs(pair[400:], word[400:], n[400:])])
    assert all((a == b).all() for a, b in zip(back, (pair, word, n), strict=True))


def test_model_folder_goes(spark):
    import os

    model = language_model.train(spark.createDataFrame([("a b a",)], "text string"))
    folder = model.folder.removeprefix("file:")
    assert os.path.isdir(folder)
    model.remove(spark)
    assert not os.path.exists(folder)


def test_lookups_do_not_grow_with_batches(spark, monkeypatch):
    """Every look-up visits all shards, so many small batches are looked up at once, with the scores of one by one."""
    import pyarrow as pa

    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3} Ä{i}") for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = language_model.train(docs, shard_bytes=40)
    assert model.bits > 2
    runs, calls, find = [], [], PackedTable.find
    monkeypatch.setattr(language_model, "lean", lambda run: runs.append(run) or run)
    want = {r.doc_id: tuple(r) for r in language_model.score(docs, model).collect()}
    monkeypatch.setattr(PackedTable, "find", lambda self, *a: calls.append(self.kind) or find(self, *a))
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], ["doc_id", "__t"]) for i, t in rows]
    got = [r for b in runs[-1](iter(batches)) for r in zip(*b.to_pydict().values(), strict=True)]
    assert {r[0]: r for r in got} == want and len(got) == len(rows)
    assert len(calls) <= 3


def test_orders_are_those_of_plain_sorts():
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2), rng.integers(0, 9, 3000, dtype=np.uint64), np.zeros(0, np.uint64), np.array([3, 1, 3], np.uint64) + (np.uint64(1) << np.uint64(63))):
        assert (_store.order_of(x) == np.argsort(x, kind="stable")).all()
        assert all((a == b).all() for a, b in zip(_store.distinct_of(x), np.unique(x, return_inverse=True), strict=True))
    pair, word = rng.integers(0, 1 << 63, 40, dtype=np.uint64)[rng.integers(0, 40, 5000)], rng.integers(0, 30, 5000, dtype=np.uint64)
    n = rng.integers(1, 1 << 40, 5000)
    for counts in (None, n):
        want = {}
        for k, c in zip(zip(pair.tolist(), word.tolist(), strict=True), n.tolist(), strict=True):
            want[k] = want.get(k, 0) + (1 if counts is None else c)
        p, w, c = language_model.summed(pair, word, counts)
        assert list(zip(p.tolist(), w.tolist(), c.tolist(), strict=True)) == [(*k, v) for k, v in sorted(want.items())]
