import random

from test_line_dedup_blocks import Counted

from duewise.llm import ngram_join as nj


def test_borderline_copies_meet_centres_before_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(130)]
    texts = [" ".join(words)]
    for i in range(150):
        own = list(words)
        for at in rng.sample(range(130), 1 + i % 3):
            own[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(127)} for t in texts]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if want[i] != want[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    ws = Counted(spark, "t")
    got = nj.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ws).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    assert ws.rows["crowds"] > 0 and ws.rows["candidates"] < len(texts)


def test_tiles_compare_bitmaps_once(spark, monkeypatch):
    # Pairs of ordinary sets come from the tiles with their bitmaps compared; only very large sets are joined to them again.
    given, allowed = [], nj._allowed
    monkeypatch.setattr(nj, "_allowed", lambda pairs, *a: given.append(pairs.count()) or allowed(pairs, *a))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(24):
        own = list(words)
        for at in rng.sample(range(60), 1):
            own[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(57)} for t in texts]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if want[i] != want[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    ws = Counted(spark, "t")
    got = nj.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ws).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    assert ws.rows["candidates"] > 0 and given[-1] == 0
