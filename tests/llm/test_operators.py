"""Each operator against brute force, an exact round trip or held-out accuracy, and on rows that are easy to get wrong."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import _pieces, _store, _words, embedding_dup, fingerprint, language_id, language_model, mixing, near_dup, quality, queries, sentencepiece_codec, token_count, toxicity
from quarrystone.llm._common import components, crc_mod, table

WORDS = [f"w{i}" for i in range(400)]
#: Null ids and texts, empty and blank texts, ties, repeated rows, odd characters and one long text; columns that operators also add.
ODD = "doc_id long, text string, lang string, source string, score double, ids string, n_tokens string, lang_pred string, predicted string, mix_slot int"


def odd_rows(spark):
    long_text = " ".join(WORDS[i * i % 397] for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "One two  three "), (None, "null id"), (6, "日本語 😀 \x00 ß"), (7, long_text), (8, "....$$$ 123"), (None, None), (9, "x" * 5000)]
    return spark.createDataFrame([(i, t, "en" if i != 5 else None, None if i in (2, 6) else f"s{(i or 0) % 2}", 0.5, "x", "y", "z", "p", 3) for i, t in rows], ODD)


def labels(spark, empty=False):
    rows = [] if empty else [(1, 0, 0), (4, 1, 1), (5, 0, 1), (5, 0, 1), (7, 1, None), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def pandas_of(df, key="doc_id"):
    return df.toPandas().set_index(key)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def groups_of(pairs, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


# -- shared kernels ------------------------------------------------------------------------------------------------
def test_words_equal_regex():
    texts = ["", None, "a", "A  b\tC\nd\x0b\x0ce", " lead and trail ", "é日本 ÀB x", "same same"]
    w = _words.Words(pa.array(texts))
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [split(t) for t in texts]
    h = w.hashes()
    assert h[-1] == h[-2] and h[0] == h[1] and len(set(h.tolist())) == len(h) - 2


def test_packed_arrays_come_back(tmp_path):
    a, b = np.arange(5, dtype=np.uint64), np.zeros(0, np.uint32)
    assert [x.tolist() for x in _store.unpack(_store.pack(a, b), np.uint64, np.uint32)] == [a.tolist(), []]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    want = groups_of(real, {x for p in real for x in p})
    assert got == want
    assert components(spark.createDataFrame([], "src long, dst long")).isEmpty()


# -- 1 mixing ------------------------------------------------------------------------------------------------------
def test_mix_equals_sql(same):
    same(queries.op1_mix_sources, queries.ORACLES["op1_mix_sources"])


@pytest.mark.parametrize("weights", [[1, 1, 1], [90, 9, 1], [5, 3, 3, 2, 1], [1]])
def test_schedule_stays_within_one_block(spark, weights):
    slots = 200
    q = mixing.quotas(weights, slots)
    runs = spark.range(1).select(F.expr(mixing.schedule(q, slots))).first()[0]
    assert sum(q) == slots and Counter(runs) == {i: n for i, n in enumerate(q)}
    done = [0] * len(q)
    for t, i in enumerate(runs, 1):
        done[i] += 1
        assert all(abs(done[s] - t * q[s] / slots) < 1 for s in range(len(q)))


def test_mix_keeps_rows_and_order_of_blocks(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    got = mixing.mix(df, {"a": 3, None: 2}, block_rows=8, slots=100, range_rows=50).toPandas()
    assert sorted(got.doc_id) == list(range(3000)) and got.mix_position.is_unique
    first = got[got.mix_slot < 100].groupby(got.source.fillna("-")).mix_slot.nunique()
    assert dict(first) == {"a": 50, "b": 17, "-": 33}
    assert mixing.mixed(df, {"a": 3}).columns == df.columns


# -- 2 embeddings --------------------------------------------------------------------------------------------------
def test_embeddings_equal_sql(same):
    same(queries.op2_embedding_near_dup, queries.ORACLES["op2_embedding_near_dup"])


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 32))
    x = np.concatenate([c + rng.normal(size=(120, 32)) * s for c, s in zip(centres, (0.02, 0.05, 0.09, 0.12, 0.15, 0.3), strict=True)] + [rng.normal(size=(80, 32))])
    label = rng.integers(0, 2, len(x))
    rows = [(i, v.astype(np.float32).tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    odd = [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, [float("nan")] * 32, 1), (9003, [1.0, None] + [0.0] * 30, 1), (9004, rows[0][1], None), (9005, [1.0, 2.0], 0), (9006, [1.0, 2.0], 0), (9007, [float("inf")] + [0.0] * 31, 0), (9008, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = pandas_of(embedding_dup.near_duplicates(df, tile=50), "vec_id")
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = np.triu((u @ u.T >= 0.98) & (label[:, None] == label), 1)
    pairs = list(zip(*map(list, np.nonzero(near)), strict=True)) + [(9005, 9006)]
    want = groups_of(pairs, got.index)
    links = Counter(i for p in pairs for i in p)
    assert len(pairs) > 2000
    assert sum(links.values()) == got.n_links.sum() and all(got.n_links[i] == links[i] for i in got.index)
    assert all(got.component_id[i] == want[i] and got.kept[i] == (want[i] == i) for i in got.index)
    assert embedding_dup.near_duplicates(df.limit(0)).isEmpty()
    assert len(embedding_dup.near_duplicates(spark.createDataFrame(odd[:4], df.schema)).collect()) == 4


# -- 3 language model ----------------------------------------------------------------------------------------------
def brute_model(training):
    """Order three by dictionaries: highest counts, then numbers of distinct words before."""
    tokens = [split(t) + ["\n"] for t in training]
    uni, three = Counter(w for t in tokens for w in t), Counter(g for t in tokens for g in zip([" ", " "] + t, [" "] + t, t, strict=False))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)
    after3, after2 = defaultdict(list), defaultdict(list)
    for (u, v, _), c in three.items():
        after3[u, v].append(c)
    for (v, _), c in two.items():
        after2[v].append(c)

    def discounts(counts):
        n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
        if not all(n):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0), i + 1) for i in range(3)]

    d3, d2, d1 = (discounts(x.values()) for x in (three, two, one))
    cut = lambda ds, c: ds[min(c, 3) - 1] if c else 0.0
    v_size = len(uni)
    rest = sum(cut(d1, c) for c in one.values()) / len(two) if two else 1.0

    def level(d, count, followers, lower):
        return (max(count - cut(d, count), 0) + sum(cut(d, c) for c in followers) * lower) / sum(followers) if followers else lower

    def p(u, v, w):
        lowest = (max(one[w] - cut(d1, one[w]), 0) / len(two) if two else 0.0) + rest / (v_size + 1)
        middle = level(d2, two[v, w], after2.get(v), lowest)
        return level(d3, three[u, v, w], after3.get((u, v)), middle)

    return uni, p


@pytest.mark.parametrize("shard", [1 << 24, 2000])
def test_language_model_equals_brute_force(spark, small, shard):
    docs = table(spark, small, "documents").select("doc_id", "text").limit(60).union(odd_rows(spark).where("doc_id is null or doc_id not in (7, 9)").select("doc_id", "text"))
    rows = [tuple(r) for r in docs.withColumn("held_out", crc_mod("doc_id", 7) == 2).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    model = language_model.train(df.where("not held_out"), shard_bytes=shard)
    uni, p = brute_model([t for _, t, h in rows if not h])
    n, v = sum(uni.values()), len(uni)
    assert (model.n_tokens, model.vocabulary) == (n, v)
    cache = {}
    got = language_model.score(df.withColumn("row", F.monotonically_increasing_id()).withColumn("t", F.col("text")), model).collect()
    assert len(got) == len(rows)
    for r in got:
        t = split(r.t) + ["\n"]
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        own = 0.0
        for g in zip([" ", " "] + t, [" "] + t, t, strict=False):
            if g not in cache:
                cache[g] = p(*g)
            own += math.log10(cache[g])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(uni[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(own)
    a, b = next((t[0], t[1]) for r in rows if not r[2] and len(t := split(r[1])) > 2)
    for u, w in ((a, b), (" ", " "), (" ", a), ("never", b), ("never", "ever")):
        assert sum(p(u, w, x) for x in uni) + p(u, w, "never seen") == pytest.approx(1)


def test_language_model_without_training(spark):
    df = odd_rows(spark).select("doc_id", "text")
    got = language_model.score(df, language_model.train(df.limit(0))).collect()
    assert len(got) == 12 and all(r.score == r.base_score == 0 and r.train_tokens == 0 for r in got)


# -- 4 and 7 pieces ------------------------------------------------------------------------------------------------
MODEL = queries.MODEL
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


def odd_texts(n=150):
    rng = random.Random(4)
    out = ["", " ", "  two  spaces ", "▁mark ▁▁ x", "日本語 mixed 😀😀", "a\0b \0c", "\n\t\n", "x" * 700, "http" * 200, "é" * 300 + " the"]
    return out + ["".join(rng.choice("abcdefghiteso nr  é日\n😀▁") for _ in range(rng.randint(1, 300))) for _ in range(n)]


def unigram(data):
    """The same vocabulary marked as a unigram model."""
    at = data.rindex(b"\x18\x02\x20\x80\xfa\x01")
    return data[: at + 1] + b"\x01" + data[at + 2 :]


@needs_model
def test_encoding_equals_the_library(spark, small):
    import sentencepiece

    texts = odd_texts() + [r.text for r in table(spark, small, "documents").select("text").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(df, MODEL), MODEL).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        assert list(got.ids[i]) == library.encode(t), t[:60]
        assert got.decoded[i] == t.replace("▁", " ") or "▁" in t


@needs_model
def test_unigram_paths_and_counts_equal_the_library():
    from tokenizers import Tokenizer, models

    data = unigram(open(MODEL, "rb").read())
    pieces = _pieces.Pieces(data)
    library = Tokenizer(models.Unigram(list(zip(pieces.text, map(float, pieces.score), strict=True)), 0, True))
    texts = [t for t in odd_texts(300) if t and " " not in t and "▁" not in t and "\n" not in t] + [w for w in ("the", "theaha", "hestth", "Zukeitpf", "ö", "日本", "😀")] + [t.split(" ")[0] or "x" for t in odd_texts(300)]
    texts = [t for t in texts if "▁" not in t]
    ids, first = sentencepiece_codec.Codec(data).encode(texts)
    counts = token_count.Counter(data).counts(texts)
    for i, t in enumerate(texts):
        want = library.encode("▁" + t).ids
        assert ids[first[i] : first[i + 1]].tolist() == want and counts[i] == len(want), t[:50]


@needs_model
def test_batches_and_forgotten_chunks_change_nothing(monkeypatch):
    data = open(MODEL, "rb").read()
    texts = odd_texts(60) * 2
    want, first = sentencepiece_codec.Codec(data).encode(texts)
    counts = token_count.Counter(data).counts(texts)
    monkeypatch.setattr(sentencepiece_codec, "CHUNKS", 7)
    monkeypatch.setattr(token_count, "MEMORY", 40)
    codec, counter = sentencepiece_codec.Codec(data), token_count.Counter(data)
    for i, t in enumerate(texts):
        assert codec.encode([t])[0].tolist() == want[first[i] : first[i + 1]].tolist()
        assert counter.counts([t])[0] == counts[i]


@needs_model
def test_suffix_array_finds_all_occurrences():
    codec = sentencepiece_codec.Codec(open(MODEL, "rb").read())
    lattice = _pieces.Lattice(["▁the▁", "▁then", "x"])
    start, piece = codec.matcher.edges(lattice.points)
    got = {(int(s), codec.pieces.text[p]) for s, p in zip(start, piece, strict=True)}
    joined = lattice.joined
    want = {(i, codec.pieces.text[p]) for p in codec.pieces.normal for i in range(len(joined)) if joined.startswith(codec.pieces.text[p], i)}
    assert got == want


@needs_model
def test_pieces_on_odd_rows(spark):
    df = odd_rows(spark)
    coded = sentencepiece_codec.encode(df, MODEL).collect()
    counts = token_count.count_tokens(df, MODEL).collect()
    assert len(coded) == len(counts) == 12 and dict(df.dtypes)["ids"] == "string"
    assert all((len(r.ids) == 0) == (not r.text) for r in coded) and all((r.n_tokens == 0) == (not r.text) for r in counts)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(df, MODEL), MODEL)
    assert back.where("decoded != coalesce(text, '')").isEmpty()
    none = spark.createDataFrame([(None,)], "ids array<int>")
    assert sentencepiece_codec.decode(none, MODEL).first().decoded is None
    assert token_count.count_tokens(df.limit(0), MODEL).isEmpty() and sentencepiece_codec.encode(df.limit(0), MODEL).isEmpty()


# -- 5 near duplicates ---------------------------------------------------------------------------------------------
def brute_groups(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = split(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, groups_of(pairs, ids)


def test_near_duplicates_equal_sql(same):
    same(queries.op5_minhash_near_dup, queries.ORACLES["op5_minhash_near_dup"])


def copies(seed=5):
    """Groups of copies of all sizes and distances, many of them close to the threshold, and a passage in all texts of one kind."""
    rng = random.Random(seed)
    texts, n = {}, 0
    passage = [rng.choice(WORDS) for _ in range(60)]
    for size, length, edits in [(1, 30, 0)] * 30 + [(4, 60, 1), (5, 90, 2), (150, 80, 3), (120, 200, 9), (40, 50, 2), (3, 3, 0), (3, 2, 1)]:
        base = [rng.choice(WORDS) + str(n) for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts[n], n = " ".join(w), n + 1
    for _ in range(110):
        texts[n], n = " ".join(passage + [rng.choice(WORDS) + str(n) for _ in range(rng.choice((20, 40, 90)))]), n + 1
    return texts | {n: "", n + 1: None, n + 2: " ", n + 3: texts[0].upper(), n + 4: "solo", n + 5: "Solo"}


@pytest.mark.parametrize("options", [{}, {"long": 8}])
def test_near_duplicates_equal_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 40)
    texts = copies()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = pandas_of(near_dup.near_duplicates(df, size=4, **options))
    sets, want = brute_groups(texts, 4, 80)
    assert {i: len(s) for i, s in sets.items()} == dict(got.n_shingles)
    assert dict(got.component_id) == want and all(got.kept[i] == (want[i] == i) for i in want)


def test_near_duplicates_on_odd_rows(spark):
    got = near_dup.near_duplicates(odd_rows(spark)).collect()
    assert len(got) == 12 and sum(r.doc_id is None and r.component_id is None and r.kept for r in got) == 2
    assert sum(r.doc_id == 4 and r.kept for r in got) == 2
    assert near_dup.near_duplicates(odd_rows(spark).limit(0)).isEmpty()


# -- 6 fingerprints ------------------------------------------------------------------------------------------------
def test_spans_and_extensions():
    a, b = fingerprint.Prefix("xxhello world"), fingerprint.Prefix("hello there, hello world")
    assert a.span(2, 8) == b.span(0, 6) and a.span(2, 8) != b.span(1, 7)
    assert fingerprint.extension(a, 2, b, 0) == 6 and fingerprint.extension(a, 2, b, 13) == 11 and fingerprint.extension(a, 0, b, 0) == 0


def test_joined_fingerprint_equals_that_of_the_text():
    rng = random.Random(6)
    for _ in range(80):
        s, t = ("".join(rng.choice("abé日😀 ") for _ in range(rng.randint(0, 60))) for _ in range(2))
        k, m = rng.randint(0, len(s)), rng.randint(0, len(t))
        text = s[:k] + t[:m]
        assert fingerprint.of_joined(fingerprint.Prefix(s), k, fingerprint.Prefix(t), m, text) == fingerprint.of_prefix(fingerprint.Prefix(text))


def test_fingerprints_equal_brute_force(spark, small):
    rows = [(r.doc_id * 7, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()] + [(3, None), (4, ""), (5, "short"), (5, "short"), (8, "日本😀")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: -r[0])
    for ranges in (1, 7):
        got = sorted(fingerprint.fingerprints(df, ranges=ranges).collect(), key=lambda r: -r.doc_id)
        assert len(got) == len(rows)
        for i, (r, (k, t)) in enumerate(zip(got, order, strict=True)):
            t, after = t or "", order[(i + 1) % len(order)][1] or ""
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            own, other = (fingerprint.of_prefix(fingerprint.Prefix(x)) for x in (t, edited))
            assert (r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint) == (k, len(t), own, other)
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.near_edited == fingerprint.likeness(own, other) and r.common_next == len(os.path.commonprefix([t, after]))
    same = [r.fingerprint for r in got if r.doc_id == 5]
    assert same[0] == same[1] and fingerprint.likeness(same[0], same[1]) == 1.0


def test_fingerprints_on_odd_rows(spark):
    assert fingerprint.fingerprints(odd_rows(spark)).count() == 12
    assert fingerprint.fingerprints(odd_rows(spark).limit(0)).isEmpty()
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# -- 8, 9, 10 classifiers ------------------------------------------------------------------------------------------
def test_language_profiles_by_hand():
    p = language_id.Profiles(256)
    letters, classes = language_id.letter_vectors(256), language_id.letter_classes()
    a, b = (letters[classes[ord(c)]] for c in "ab")
    edge = letters[0]
    want = np.roll(edge, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * edge
    got = p.documents(["AB", "ab 1", "", None, "12"])
    assert np.allclose(got[0], want) and np.allclose(got[1], want) and not got[2:].any()


def test_language_on_held_out_documents(spark):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97 and got.where("score < 0 or score > 1").isEmpty()


def test_language_on_odd_rows(spark):
    df = odd_rows(spark)
    got = language_id.classify(df, language_id.train(df)).collect()
    assert len(got) == 12 and {r.lang_pred for r in got if not re.search(r"[^\W\d_]", r.text or "")} == {"und"}
    assert all(r.lang_pred == "en" for r in got if r.text == "one")
    assert {r.lang_pred for r in language_id.classify(df, {}).collect()} == {"und"}
    assert language_id.train(df.limit(0)) == {} and language_id.classify(df.limit(0), {}).isEmpty()


def test_ftrl_keeps_few_weights():
    rng = np.random.default_rng(9)
    rows = [(np.unique(np.r_[rng.integers(10, 1000, 30), [3] if i % 4 == 0 else []]).astype(np.int64), int(i % 4 == 0)) for i in range(400)]
    places, w = toxicity.ftrl(rows, bits=10)
    assert dict(zip(places, w, strict=True))[3] == w.max() and len(places) < 400


def accuracy(spark, query, label, low):
    d = "/root/testdata/sf0.1"
    got = query(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").select(label, "predicted", "score").toPandas()
    assert got.score.between(0, 1).all() and (got[label] == got.predicted).mean() > low
    return got


def test_toxicity_on_held_out_documents(spark):
    got = accuracy(spark, queries.op9_toxicity, "toxic", 0.95)
    assert (got[got.toxic == 0].predicted == 0).mean() > 0.99


def test_quality_on_held_out_documents(spark):
    got = accuracy(spark, queries.op10_quality, "quality", 0.97)
    assert (got[got.quality == 1].predicted == 1).mean() > 0.98


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, module):
    df = odd_rows(spark)
    got = module.score(df, module.train(df, labels(spark))).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    blank = module.score(df, module.train(df, labels(spark, empty=True))).collect()
    assert {r.score for r in blank} == {0.5}
    assert module.score(df.limit(0), module.train(df.limit(0), labels(spark))).isEmpty()


def test_mix_on_odd_rows(spark):
    got = mixing.mix(odd_rows(spark), {"s0": 2}).collect()
    assert len(got) == 12 and len({r.mix_position for r in got}) == 12
    assert mixing.mix(odd_rows(spark).limit(0)).columns[-3:] == ["mix_block", "mix_slot", "mix_position"]
    with pytest.raises(ValueError):
        mixing.mix(odd_rows(spark), {"s0": 0})
