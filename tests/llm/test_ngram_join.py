import random

from conftest_llm import EDGE_TEXTS

from duewise.llm import ngram_join as nj
from duewise.llm.common import Workspace
from duewise.llm.components import components


def brute(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus():
    rng = random.Random(5)
    text = lambda n, v=300: [f"w{rng.randrange(v)}" for _ in range(n)]
    hot = text(40)
    texts = list(EDGE_TEXTS)
    for k in range(6):
        base = text(rng.choice([12, 40, 120, 400]))
        for e in range(10):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9)}"
            texts.append(" ".join(copy if e % 3 else copy[: -rng.randrange(1, 4)]))
    # A chain: each links with the next only.
    chain = text(300)
    for k in range(12):
        texts.append(" ".join(chain[k * 10 : k * 10 + 150]))
    texts += [" ".join(hot + text(rng.randrange(2, 60))) for _ in range(40)]
    texts += ["A b", "a B", "a b c", "A b c d", "a b c d", "x " * 50, "x " * 70]
    rng.shuffle(texts)
    return texts


def test_op5(spark, folder):
    texts = corpus()
    path = folder(texts)
    got = [(r.n_shingles, r.component_id) for r in nj.op5(spark, path).orderBy("doc_id").collect()]
    assert got == brute(texts, 4, 85)
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as n", "'x' as node")
    got = [(r.n_shingles, r.component_id) for r in nj.near_duplicates(docs, Workspace(spark, "t"), 5, 80).orderBy("doc_id").collect()]
    assert got == brute(texts, 5, 80)


def test_repeated_rows_and_null_ids(spark, folder):
    df = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (7, "q r s t"), (None, "a b c d e"), (None, None), (9, "q r s t")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in nj.near_duplicates(df, Workspace(spark, "t")).collect())))
    assert got == sorted(map(str, [(7, 2, 7), (7, 2, 7), (7, 1, 7), (None, 2, 7), (None, 0, None), (9, 1, 7)]))
    assert nj.op5(spark, folder([])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2000, 2001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long"), Workspace(spark, "t"), "c").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50)) and got[2001] == 2000
