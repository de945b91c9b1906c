import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factline.llm import lm
from factline.llm import tokens as K


def brute(texts):
    """Scores by counting tuples; which documents are held out is asked of the operator."""
    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    held = []
    for t in texts:
        h, row = K.words(pa.array([t], pa.string()))
        held.append(bool(lm.held_out(np.array([len(h)]), h, row)[0]))
    uni, ctx, two, hu, hc, h2 = (Counter() for _ in range(6))
    for w, out in zip(words, held):
        for a, b in zip(["<s>", *w], w):
            uni[b] += 1
            ctx[a] += 1
            two[a, b] += 1
            if out:
                hu[b] += 1
                hc[a] += 1
                h2[a, b] += 1
    n = sum(uni.values())
    left = max(n - sum(hu.values()), 1)
    p0 = 1 / (len(uni) + 1)
    cells = []
    for w, out in zip(words, held):
        for a, b in zip(["<s>", *w], w) if out else ():
            c = ctx[a] - hc[a]
            cells.append((lm.bucket(np.array([float(c)]))[0], (two[a, b] - h2[a, b]) / c if c else 0.0, (uni[b] - hu[b]) / left, p0, 1))
    lam = em(cells)
    out = []
    for w in words:
        ps = [lam[lm.bucket(np.array([float(ctx[a])]))[0]] @ (two[a, b] / ctx[a], uni[b] / n, p0) for a, b in zip(["<s>", *w], w)]
        out.append((len(w), sum(map(math.log, ps)) / len(ps) if ps else None))
    return out, held


def em(cells):
    """Weights of each bucket by expectation-maximisation, a word at a time."""
    lam = {b: [1 / 3] * 3 for b in range(lm.BUCKETS)} | {0: [0.0, 0.5, 0.5]}
    for b in {c[0] for c in cells}:
        for _ in range(lm.ROUNDS):
            part = [0.0] * 3
            for _, *p, _ in (c for c in cells if c[0] == b):
                x = [a * q for a, q in zip(lam[b], p)]
                part = [a + q / sum(x) for a, q in zip(part, x)]
            lam[b] = [x / sum(part) for x in part]
    return {b: np.array(x) for b, x in lam.items()}


def test_deleted_estimates_sum_to_one(spark, monkeypatch):
    """A word's share among the words that aren't held out is divided by their number alone."""
    seen = []
    fit = lm._fit
    monkeypatch.setattr(lm, "_fit", lambda n, u: seen.append((n, u)) or fit(n, u))
    texts = [f"a{k % 7} b{k % 5} c{k}" for k in range(200)]
    lm.lm_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    held = 0
    for t in texts:
        h, row = K.words(pa.array([t], pa.string()))
        held += 3 * bool(lm.held_out(np.array([3]), h, row)[0])
    assert 0 < held < 600 and seen[0][0] == 600 - held and seen[0][1] == 1 / (1 + 7 + 5 + 200)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "straße", "日本"]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 60), p=(p := 1 / np.arange(1, 64)) / p.sum())) for _ in range(120)] + [None, "", "...", "one", texts_long(rng, vocab)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], "x")], "doc_id long, text string, log_prob string")
    want, held = brute([*texts, texts[0]])
    assert any(held) and not all(held)
    got = {r["doc_id"]: r for r in lm.lm_score(df.repartition(3)).collect()}
    assert len(got) == len(texts) + 1
    for i, (n, lp) in enumerate(want):
        r = got[i if i < len(texts) else None]
        assert r["n_words"] == n
        assert (r["log_prob"] is None) == (lp is None)
        if lp is not None:
            assert r["log_prob"] == pytest.approx(lp, abs=1e-4)  # held-out counts of 16 and more are averaged in steps of 1/8 of a doubling
            assert r["perplexity"] == pytest.approx(math.exp(-lp), rel=1e-4)


def texts_long(rng, vocab):
    return " ".join(rng.choice(vocab, 30_000))


def test_weights_sum_to_one_and_prefer_what_predicts():
    lam = lm.weights(np.array([[5, 0.9, 0.01, 1e-6, 100], [9, 0.0, 0.1, 1e-6, 100]]))
    assert np.allclose(lam.sum(1), 1)
    assert lam[5, 0] > 0.95 and lam[9, 1] > 0.95


def test_an_empty_table(spark):
    assert lm.lm_score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shuffled_words_score_worse(spark):
    rng = np.random.default_rng(1)
    base = " ".join(f"a{i % 17} b{i % 17} c{i % 17}" for i in range(400)).split()
    data = [(i, " ".join(base[k : k + 90])) for i, k in enumerate(rng.integers(0, 1000, 60))] + [(99, " ".join(rng.permutation(base[:90])))]
    got = {r["doc_id"]: r["log_prob"] for r in lm.lm_score(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[99] < min(v for k, v in got.items() if k != 99)


def test_owners_that_share_partitions_answer_alike(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice([f"w{i}" for i in range(50)], 40))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, lm.lm_score(df).collect()))
    monkeypatch.setattr(K, "PARTITIONS", 2)
    assert sorted(map(tuple, lm.lm_score(df).collect())) == want
