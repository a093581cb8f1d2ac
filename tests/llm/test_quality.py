"""The passage encoder and its attention against a plain version in Python, and the gradient against differences."""

import math

import numpy as np
import pyarrow as pa
import pytest
from test_operators import labels, odd_rows, split

from quarrystone.llm import quality

MASK = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def word_hash(word):
    return mixed(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word.encode())) & MASK)


def pair_hash(a, b):
    out = 0
    for h in (a, b):
        out = mixed((out * 0xD6E8FEB86659FD93 + h + 0x2545F4914F6CDD1D) & MASK)
    return out


def plain_counts(text):
    """Counts of hashed words, pairs and trigrams, passage by passage."""
    words = split(text)
    out = [[0] * (quality.WORD + quality.CHAR) for _ in range(max(1, -(-len(words) // quality.PASSAGE)))]
    for i, w in enumerate(words):
        row = out[i // quality.PASSAGE]
        row[word_hash(w) * quality.WORD >> 64] += 1
        if i:
            row[pair_hash(word_hash(words[i - 1]), word_hash(w)) * quality.WORD >> 64] += 1
        b = w.encode() + b"  "
        for j in range(len(b) - 2):
            code = b[j] << 16 | b[j + 1] << 8 | b[j + 2]
            row[quality.WORD + ((code * 2654435761 & 0xFFFFFFFF) * quality.CHAR >> 32)] += 1
    return [[min(x, 255) for x in row] for row in out]


def plain_score(m, text, shapes):
    """Encoder and gated attention with lists and loops."""
    hidden = len(m["b"])
    hs = []
    for counts, shape in zip(plain_counts(text), shapes, strict=True):
        x = [(s - mu) / sd for s, mu, sd in zip(shape, m["mean"], m["sd"], strict=True)]
        for part in (counts[: quality.WORD], counts[quality.WORD :]):
            n = math.sqrt(sum(c * c for c in part)) or 1.0
            x += [c / n for c in part]
        hs.append([math.tanh(m["b"][k] + sum(v * m["W"][i, k] for i, v in enumerate(x) if v)) for k in range(hidden)])
    e = []
    for h in hs:
        u = [math.tanh(sum(h[i] * m["V"][i, k] for i in range(hidden))) for k in range(hidden)]
        g = [1 / (1 + math.exp(-sum(h[i] * m["U"][i, k] for i in range(hidden)))) for k in range(hidden)]
        e.append(sum(a * b * w for a, b, w in zip(u, g, m["w"], strict=True)))
    top = max(e)
    a = [math.exp(x - top) for x in e]
    z = [sum(w * h[k] for w, h in zip(a, hs, strict=True)) / sum(a) for k in range(hidden)]
    return 1 / (1 + math.exp(-(sum(p * q for p, q in zip(z, m["c"], strict=True)) + float(m["d"]))))


TEXTS = ["", None, "one", "One  two, THREE\n4 ééé 日本", " ".join(f"w{i * i % 91}" for i in range(300)), "x" * 700, "same " * 400]


def model(texts=TEXTS, **options):
    bags = quality.Bags(pa.array(texts))
    y = np.arange(len(texts)) % 2.0
    return bags, quality.fit(bags.shape, bags.counts(0, len(bags.shape)), bags.first, y, **options)


def test_content_counts_equal_plain():
    bags = quality.Bags(pa.array(TEXTS))
    for d, t in enumerate(TEXTS):
        assert bags.counts(int(bags.first[d]), int(bags.first[d + 1])).tolist() == plain_counts(t)


def test_scores_equal_plain():
    bags, m = model(epochs=5)
    got = quality.probabilities(m, bags)
    for d, t in enumerate(TEXTS):
        shapes = bags.shape[int(bags.first[d]) : int(bags.first[d + 1])].tolist()
        assert got[d] == pytest.approx(plain_score(m, t, shapes), abs=2e-5)


def test_blocks_and_slices_change_nothing(monkeypatch):
    bags, m = model(epochs=2)
    whole = quality.probabilities(m, bags)
    monkeypatch.setattr(quality, "BLOCK", 2)
    assert quality.probabilities(m, bags) == pytest.approx(whole, abs=1e-5)
    assert quality.probabilities(m, quality.Bags(pa.array(TEXTS).slice(4, 2))) == pytest.approx(whole[4:6], abs=1e-5)


def test_gradient_equals_differences():
    bags, m = model(epochs=1)
    counts, y = bags.counts(0, len(bags.shape)), np.arange(len(TEXTS)) % 2.0
    shape = ((bags.shape - m["mean"]) / m["sd"]).astype(np.float32)
    m["W"] = m["W"].astype(np.float64)

    def loss(changed):
        x, *by = quality.scaled(counts)
        p = quality.attend(changed, quality.encode(changed, shape, (x.astype(np.float64), *by)), bags.first)["p"]
        return -np.mean(np.log(np.where(y == 1, p, 1 - p)))

    grad = quality.gradient(m, shape, counts, bags.first, y)
    rng = np.random.default_rng(0)
    for k, g in grad.items():
        flat = np.atleast_1d(np.asarray(g)).ravel()
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            up, down = ({**m, k: np.array(m[k], np.float64)} for _ in range(2))
            up[k].reshape(-1)[i] += 1e-4
            down[k].reshape(-1)[i] -= 1e-4
            assert flat[i] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-5, rel=1e-2), k


def test_content_alone_is_learned():
    """Two kinds of text with the same shapes, told apart by their words; one telling passage among many is enough."""
    rng = np.random.default_rng(3)
    words = [f"{c}ab{i:02d}" for c in "mn" for i in range(50)]
    texts = [" ".join(rng.choice(words, 400).tolist() + (["zubat"] * 30 if k % 2 else ["zubut"] * 30) + rng.choice(words, 200).tolist()) for k in range(240)]
    bags = quality.Bags(pa.array(texts))
    y = np.arange(240) % 2.0
    cut = int(bags.first[160])
    m = quality.fit(bags.shape[:cut], bags.counts(0, cut), bags.first[:161], y[:160])
    p = quality.probabilities(m, quality.Bags(pa.array(texts[160:])))
    assert ((p >= 0.5) == y[160:]).mean() > 0.95


def test_training_is_bounded(spark):
    """Texts beyond the bound of passages train nothing, and every row still has a score."""
    df = odd_rows(spark)
    m = quality.train(df, labels(spark), max_passages=3)
    got = quality.score(df, m).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert quality.train(df.where("doc_id = 7"), labels(spark), max_passages=3) is None
