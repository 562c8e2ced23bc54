import hashlib
import random
from collections import Counter

from conftest_llm import EDGE_TEXTS

from duewise.llm import substring_dedup as sd


def brute(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for w in words:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        yield len(w), len(gone), hashlib.sha256(kept).hexdigest()


def test_op4(spark, folder):
    rng = random.Random(3)
    text = lambda n, v=400: [f"w{rng.randrange(v)}" for _ in range(n)]
    passage, other = text(60), text(35)
    texts = list(EDGE_TEXTS)
    for k in range(25):
        t = text(rng.randrange(20, 200))
        at = rng.randrange(len(t))
        cut = rng.randrange(30, 61)
        off = rng.randrange(0, 61 - cut)
        texts.append(" ".join(t[:at] + passage[off : off + cut] + t[at:]))
        if k % 5 == 0:
            texts.append("\n".join(text(30) + other + text(k)))
    near = text(300)
    for k in range(8):
        copy = list(near)
        for _ in range(k):
            copy[rng.randrange(300)] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[-1], texts[-1], "  ".join(near), " ".join(text(200, 2)), " ".join(["a", "b"] * 100), " ".join(other), " ".join(other[:-1])]
    rows = sd.op4(spark, folder(texts)).orderBy("doc_id").collect()
    for i, (r, want) in enumerate(zip(rows, brute(texts), strict=True)):
        assert (r.n_words, r.n_removed, r.kept_sha256) == want, (i, r, want)


def test_op4_empty_and_repeated_rows(spark, folder):
    assert sd.op4(spark, folder([])).count() == 0


def test_repeated_and_null_ids(spark):
    long = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, long), (1, long), (2, "x " + long), (None, None), (None, "short"), (3, " ".join(map(str, range(100, 150))))], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(df, sd.Workspace(spark, "t")).collect())
    assert got[0][1:] == (0, 0, "") and got[1][1:] == (1, 0, "short")
    assert got[2][1:] == got[3][1:] == (40, 40, "") and got[4][1:] == (41, 40, "x") and got[5][2] == 0
