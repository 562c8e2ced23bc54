import random

import numpy as np
import pytest
from test_line_dedup_blocks import Counted

from duewise.llm import ngram_join as nj


def _components(texts, percent):
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if want[i] != want[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    return dict(enumerate(want))


def test_differing_places_never_exceed_differing_grams():
    rng = np.random.default_rng(4)
    for n in (1, 40, 200, 900):
        for width in (64, 256, 1024):
            a, b, both = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(3))
            x, y = (nj.bitmap(np.concatenate([own, both]), width) for own in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= 2 * n
            assert (nj.bitmap(both, 64) == nj.folded(nj.bitmap(both, width), 64)).all()


@pytest.mark.parametrize(("length", "changed"), [(150, 2), (1100, 30)])
def test_copies_just_too_far_apart_make_few_pairs(spark, length, changed):
    """Copies of one text, each a little under the similarity of every other: their common n-grams fill a bitmap, their own differ."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(length)]
    texts = []
    for _ in range(90):
        own = list(words)
        for at in rng.sample(range(length // 8, length), changed):
            own[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts.append(texts[7] + " tail")
    ws = Counted(spark, "t")
    got = nj.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ws).collect()
    assert {r.doc_id: r.component_id for r in got} == _components(texts, 85)
    assert ws.rows["pairs"] < 1000
