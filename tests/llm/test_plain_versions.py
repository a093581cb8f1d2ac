"""Operators 4 and 6 to 9 against plain versions, the library or DuckDB, on whole texts."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import MODEL, needs_model, odd_rows, odd_texts, unigram

from quarrystone.llm import fingerprint, language_id, queries, sentencepiece_codec, token_count, toxicity
from quarrystone.llm._common import table


def whole_texts(spark, small, n=120):
    long_text = "The quick  brown fox, número 42! " * 900
    return [long_text, "  lead and  trail ", "one\ntwo\tthree", *odd_texts(40), *(r.text for r in table(spark, small, "documents").select("text").limit(n).collect())]


# -- 7 -------------------------------------------------------------------------------------------------------------
@needs_model
def test_counts_of_whole_texts_equal_the_library(spark, small):
    """Many-word texts, spaces, line ends and unknown characters, against a library that adds scores up in double precision."""
    from tokenizers import Tokenizer, models

    with open(MODEL, "rb") as f:
        data = unigram(f.read())
    counter = token_count.Counter(data)
    p = counter.pieces
    library = Tokenizer(models.Unigram(list(zip(p.text, map(float, p.score), strict=True)), p.unknown, p.byte_fallback))
    texts = [t for t in whole_texts(spark, small) if "▁" not in t]
    want = [len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for t in texts]
    assert counter.counts(texts).tolist() == want


def plain_count(counter, text):
    """Best score by trying every piece at every place of the whole text; of equal ones into a place, that of the piece that starts first."""
    p = counter.pieces
    marked = ("▁" if p.dummy_prefix else "") + text.replace(" ", "▁")
    pieces = {p.text[i]: p.score[i] for i in p.normal}
    best, n = [0.0] + [-math.inf] * len(marked), [0] * (len(marked) + 1)
    longest = max(map(len, pieces))
    for e in range(1, len(marked) + 1):
        for s in range(max(0, e - longest), e):
            part = marked[s:e]
            score, width = pieces.get(part), 1
            if score is None and len(part) == 1:
                score, width = p.unknown_score, len(part.encode("utf-8", "surrogatepass")) if p.byte_fallback else 1
            if score is not None and round(best[s] + score, 6) > round(best[e], 6):
                best[e], n[e] = best[s] + score, n[s] + width
    return n[-1] if text else 0


@needs_model
def test_counts_equal_plain_on_whole_texts():
    with open(MODEL, "rb") as f:
        counter = token_count.Counter(unigram(f.read()))
    texts = ["", "One two  three", " lead", "trail ", "日本 mixed 😀 text", "a\nb c", "x" * 60, *odd_texts(8)]
    texts = [t for t in texts if "▁" not in t]
    got = counter.counts(texts).tolist()
    near = [abs(a - plain_count(counter, t)) for a, t in zip(got, texts, strict=True)]
    assert sum(d == 0 for d in near) >= len(near) - 1 and max(near) <= 1


# -- 4 -------------------------------------------------------------------------------------------------------------
@needs_model
def test_bundled_batches_equal_the_library(spark, small, monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = whole_texts(spark, small, 200)
    with open(MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    ids, first = codec.encode(texts)
    assert all(ids[first[i] : first[i + 1]].tolist() == library.encode(t) for i, t in enumerate(texts))
    monkeypatch.setattr(sentencepiece_codec, "BATCH", 5000)
    column = pa.array(texts)
    parts = [pa.RecordBatch.from_arrays([column.slice(a, 9)], ["t"]) for a in range(0, len(texts), 9)]
    held = list(sentencepiece_codec._bundles(parts, 0))
    assert len(held) > 3 and [t for h in held for p in h for t in p.column(0).to_pylist()] == texts


# -- 6 -------------------------------------------------------------------------------------------------------------
def test_digests_equal_duckdb(spark, small, duck):
    """Lengths, edited digests and which fingerprints are equal, by SQL over whole texts."""
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, small).collect()}
    want = duck.sql(
        """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS u FROM d)
        SELECT doc_id, length(t), sha256(t[: length(t) - length(t) // 2] || u[: length(t) // 2]), dense_rank() OVER (ORDER BY t), t = u FROM n"""
    ).fetchall()
    assert len(want) == len(got)
    by_text, by_print = {}, {}
    for doc, n, digest, group, same in want:
        assert (got[doc].n_chars, got[doc].edited_sha256) == (n, digest)
        by_text.setdefault(group, set()).add(doc)
        by_print.setdefault(got[doc].fingerprint, set()).add(doc)
        assert 0 <= got[doc].near_edited <= 1 and (not same or got[doc].near_next == 1)
    assert sorted(map(sorted, by_text.values())) == sorted(map(sorted, by_print.values()))


def test_fingerprints_with_clashing_columns(spark):
    df = odd_rows(spark).withColumns({c: F.lit("own") for c in ("id", "key", "fingerprint", "n_chars", "near_next")})
    assert fingerprint.fingerprints(df).count() == df.count()


# -- 8 -------------------------------------------------------------------------------------------------------------
def plain_bundle(text, dim):
    """Letter by letter: class, neighbours, bound and permuted vectors, summed."""
    letters = language_id.letter_vectors(dim).astype(np.float64)
    kinds = [int(language_id.letter_classes()[ord(c)]) for c in (text or "").lower()]
    out = np.zeros(dim)
    for i, k in enumerate(kinds):
        if k:
            left = kinds[i - 1] if i else 0
            right = kinds[i + 1] if i + 1 < len(kinds) else 0
            out += np.roll(letters[left], 2) * np.roll(letters[k], 1) * letters[right]
    return out


def test_profiles_and_cosines_equal_plain(spark):
    rng = random.Random(1)
    texts = [("the cat sat on the mat ÄÖ 12", "en"), ("le chat est assis sur le tapis", "fr"), ("the dog and the log", "en"), ("un chien et un autre chien", "fr"), ("日本語 text", None), (None, "en"), ("", "fr"), ("...", "en")]
    texts += [("".join(rng.choice("abc déf ") for _ in range(80)), rng.choice(["en", "fr"])) for _ in range(20)]
    df = spark.createDataFrame(texts, "text string, lang string")
    model = language_id.train(df, dim=128)
    want = {"en": np.zeros(128), "fr": np.zeros(128)}
    for t, lang in texts:
        b = plain_bundle(t, 128)
        if lang and np.linalg.norm(b):
            want[lang] += b / np.linalg.norm(b)
    assert set(model) == set(want) and all(np.allclose(model[k], want[k], atol=1e-5) for k in want)
    for r in language_id.classify(df.withColumn("t", F.col("text")), model, dim=128).collect():
        b = plain_bundle(r.t, 128)
        if not np.linalg.norm(b):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = {k: b @ v / np.linalg.norm(b) / np.linalg.norm(v) for k, v in want.items()}
        assert r.lang_pred == max(sorted(cos), key=cos.get) and r.score == pytest.approx(min(max(max(cos.values()), 0), 1), abs=1e-5)


# -- 9 -------------------------------------------------------------------------------------------------------------
def plain_ftrl(rows, epochs, alpha, beta, l1):
    """Coordinate by coordinate, with dictionaries; the bias has no L1 term."""
    z, n = {}, {}

    def weight(i):
        cut = l1 if i != "bias" else 0.0
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= cut else -(zi - math.copysign(cut, zi)) * alpha / (beta + math.sqrt(n.get(i, 0.0)))

    for _ in range(epochs):
        for places, y in rows:
            own = [*places.tolist(), "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in own:
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_ftrl_equals_plain():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 200, 25)).astype(np.int64), int(rng.random() < 0.4)) for _ in range(150)]
    places, w = toxicity.ftrl(rows, bits=8, epochs=4, alpha=1.0, beta=1.0, l1=0.5)
    got = {("bias" if p == 256 else int(p)): v for p, v in zip(places, w, strict=True)}
    want = plain_ftrl(rows, 4, 1.0, 1.0, 0.5)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_toxicity_scores_equal_plain(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text")
    training = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = toxicity.train(training, table(spark, small, "labels"))
    weight = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in training.collect())
    for r in toxicity.score(docs.withColumn("t", F.col("text")), model).limit(60).collect():
        places, _ = toxicity.features(pa.array([r.t]))
        s = sum(weight.get(int(p), 0.0) for p in places) + weight.get(1 << toxicity.BITS, 0.0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, s)))), abs=1e-9) and r.predicted == int(r.score >= 0.5)


