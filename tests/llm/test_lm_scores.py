"""Scores and held-out counts of the language model against plain counting."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from specforge.llm import lmscore


def tokens(text):
    return [*(text or "").lower().split(), None]


def counted(texts):
    words, pairs = Counter(), Counter()
    for t in texts:
        own = tokens(t)
        words.update(own)
        pairs.update(zip([None, *own], own))
    return words, pairs


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    return [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=rng.randint(0, 30))) for _ in range(n)] + [None, "", "Unseen A a", "w1 " * 50]


def test_scores_equal_plain_counting(spark, monkeypatch):
    rng = np.random.default_rng(5)
    weights = rng.dirichlet([1, 1, 1], lmscore.CONTEXT_BUCKETS)
    monkeypatch.setattr(lmscore, "expectation_maximisation", lambda held, uniform: weights)
    texts = corpus(120, 1)
    learn = [i % 5 != 1 for i in range(len(texts))]
    learn[-2] = False
    docs = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(texts, learn, strict=True))], "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r for r in lmscore.score_texts(docs, F.col("learn"), ~F.col("learn")).collect()}
    words, pairs = counted([t for t, u in zip(texts, learn, strict=True) if u])
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        own, base, score = tokens(t), 0.0, 0.0
        for before, w in zip([None, *own], own):
            c = words[before]
            bucket = 0 if c == 0 else min(1 + int(math.log2(c) // 2), lmscore.CONTEXT_BUCKETS - 1)
            two, one, none = weights[bucket]
            if c == 0:
                two, one, none = 0.0, one / (one + none), none / (one + none)
            score += math.log10(two * (pairs[before, w] / c if c else 0.0) + one * words[w] / n + none / (v + 1))
            base += math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1)))
        row = got[i]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(own), sum(words[w] > 0 for w in own), n)
        assert row["base_score"] == pytest.approx(base, rel=1e-9) and row["score"] == pytest.approx(score, rel=1e-9)


def packed(chunk, texts, learn):
    press = lambda t: None if t is None else zstandard.compress(t.encode())
    return pd.DataFrame({"chunk": chunk, "doc_id": range(len(texts)), "learn": learn, "held_out": False, "part": range(len(texts)), "text": [press(t) for t in texts]})


def test_each_chunk_is_held_out_with_its_own_counts_deleted():
    parts = [corpus(40, seed) for seed in (1, 2, 3)]
    chunks = [packed(i, p, [j % 4 != 0 for j in range(len(p))]) for i, p in enumerate(parts)]
    asked = pd.concat([lmscore._ask(2)(c) for c in chunks], ignore_index=True)
    answers = pd.concat([lmscore._answer(g.reset_index(drop=True)) for _, g in asked.groupby(["kind", "bucket"])], ignore_index=True)
    learned = [[t for j, t in enumerate(p) if j % 4 != 0] for p in parts]
    n, v = sum(len(tokens(t)) for p in learned for t in p), len(counted([t for p in learned for t in p])[0])
    for i, own in enumerate(learned):
        words, pairs = counted([t for j, p in enumerate(learned) if j != i for t in p])
        left = sum(words.values())
        steps = [(a, b) for t in own for a, b in zip([None, *tokens(t)], tokens(t))]
        held = lmscore._held_counts(float(n), float(v))((i,), chunks[i], answers[answers["chunk"] == i])
        assert held["n"].sum() == len(steps)
        assert held["one"].sum() == pytest.approx(sum(words[b] / left for _, b in steps))
        assert held["two"].sum() == pytest.approx(sum(pairs[a, b] / words[a] for a, b in steps if words[a]))


def test_weights_of_a_context_bucket_maximise_its_likelihood():
    rng = np.random.default_rng(2)
    n, one, two = rng.integers(1, 50, 60), rng.uniform(0.001, 0.1, 60), rng.uniform(0, 0.6, 60) * (np.arange(60) % 2)
    code = (3 * (lmscore.BINS + 1) + np.arange(60) % 41) * (lmscore.BINS + 1) + np.arange(60) // 41
    held = pd.DataFrame({"code": code, "n": n, "two": two * n, "one": one * n})
    found = lmscore.expectation_maximisation(held, 1e-3, 2000)[3]
    value = lambda w: float((n * np.log(w[0] * two + w[1] * one + w[2] * 1e-3)).sum())
    grid = [(a / 50, b / 50, 1 - a / 50 - b / 50) for a in range(51) for b in range(51 - a)]
    assert found.sum() == pytest.approx(1) and value(found) >= max(value((np.array(w) + 1e-4) / (1 + 3e-4)) for w in grid) - 0.05
