import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import EDGE_TEXTS

from duewise.llm import language_model as lm

LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [""]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base(texts):
    c = Counter(w for i, t in enumerate(texts) if not is_held(i) for w in words_of(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        words = words_of(t)
        yield i, is_held(i), len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)


def corpus(rng, n=400):
    # Each word is followed by one of two, so the previous word tells a good deal.
    follow = {i: [rng.randrange(40), rng.randrange(40)] for i in range(40)}
    texts = list(EDGE_TEXTS)
    for _ in range(n):
        at, words = rng.randrange(40), []
        for _ in range(rng.randrange(20, 120)):
            words.append(f"Word{at}" if rng.random() < 0.97 else f"rare{rng.randrange(10**6)}")
            at = rng.choice(follow[at])
        texts.append(" ".join(words))
    return texts


def test_op13(spark, folder):
    texts = corpus(random.Random(6)) + ["unseen " * 30]
    rows = lm.op13(spark, folder(texts)).orderBy("doc_id").collect()
    want = list(base(texts))
    assert [tuple(r)[:5] for r in rows] == [w[:5] for w in want]
    assert [r.base_score for r in rows] == pytest.approx([w[5] for w in want], rel=1e-9, abs=1e-9)
    held = [r for r in rows if r.held_out and r.n_tokens > 20]
    # What the previous words tell must show on texts that were not learnt from.
    assert sum(r.score for r in held) > 0.985 * sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


def test_few_frequent_words_give_the_same_base(spark, folder, monkeypatch):
    # Nearly all words meet their counts in the join.
    monkeypatch.setattr(lm, "FREQUENT", 20)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    texts = corpus(random.Random(7), 60)
    rows = lm.op13(spark, folder(texts)).orderBy("doc_id").collect()
    want = list(base(texts))
    assert [tuple(r)[:5] for r in rows] == [w[:5] for w in want]
    assert [r.base_score for r in rows] == pytest.approx([w[5] for w in want], rel=1e-9, abs=1e-9)


def test_probabilities_are_normalised_and_equal_a_plain_loop():
    lexicon = lm.Lexicon([b"", b"a", b"b"], np.array([5, 4, 1]), 12, 5)
    assert lexicon.unigram.sum() == pytest.approx(1) and lexicon.size == 5
    # With vectors of zero the model is the smoothed unigram distribution.
    model = lm.LogBilinear.start(lexicon.unigram)
    rng = np.random.default_rng(0)
    flat = lm.LogBilinear({k: np.zeros_like(v) if k in ("context", "outcome") else v for k, v in model.values.items()})
    words = np.arange(1, 5)
    p = np.exp(flat.log_probabilities(np.zeros((4, 2), np.int64), words))
    assert p == pytest.approx(lexicon.unigram[1:], rel=1e-5)
    model = lm.LogBilinear({k: rng.standard_normal(v.shape).astype(np.float32) for k, v in model.values.items()})
    v = model.values
    for before in ([0, 0], [3, 1], [2, 4]):
        predicted = sum(v["context"][w] * v["position"][k] for k, w in enumerate(before))
        scores = [float(predicted @ v["outcome"][w] + v["bias"][w]) for w in words]
        norm = math.log(sum(map(math.exp, scores)))
        got = model.log_probabilities(np.tile(before, (4, 1)), words)
        assert got == pytest.approx([s - norm for s in scores], abs=1e-4)
        assert np.exp(got).sum() == pytest.approx(1, abs=1e-4)


def test_odd_tables(spark):
    from duewise.llm.common import Workspace

    schema = "doc_id long, text string, row long, words string, c int"
    assert lm.language_model_scores(spark.createDataFrame([], schema), Workspace(spark, "t")).count() == 0
    rows = [(None, None, 1, "x", 2), (1, "A b", 1, "x", 2), (1, "A b", 1, "x", 2)]
    got = lm.language_model_scores(spark.createDataFrame(rows, schema), Workspace(spark, "t")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(0, 1, 1, 7), (1, 3, 3, 7), (1, 3, 3, 7)]
    # Only held-out rows: nothing is known, and both scores are those of the unseen slot.
    only = next(i for i in range(50) if is_held(i))
    (r,) = lm.language_model_scores(spark.createDataFrame([(only, "a b", 1, "x", 2)], schema), Workspace(spark, "t")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
