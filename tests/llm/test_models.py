import random
import zlib

from duewise.llm import quality_model as qm
from duewise.llm import toxicity as tx

CLEAN = [f"word{i}" for i in range(300)]


def tables(spark, folder):
    rng = random.Random(9)
    texts, labels = [None, ""], [(0, 1, 0), (1, None, None)]
    for i in range(2, 1300):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(30, 90))]
        toxic, good = rng.random() < 0.15, rng.random() < 0.8
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "scumbag", "vilest", "trashy"]) + rng.choice(["", "er", "ness"]))
        text = " ".join(words) if good else " ".join(f"{w}***" for w in words) if rng.random() < 0.5 else " ".join([words[0]] * 60)
        texts.append(text)
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    labels += [(5, 7, 9), (None, 1, 1), (10**9, 0, 1)]
    return folder(texts, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), {d: (q, t) for d, q, t in labels[:-3]}, texts


def accuracy(rows, truth, k):
    known = [(r.predicted, truth[r.doc_id][k]) for r in rows if r.held_out and truth.get(r.doc_id, (None, None))[k] is not None]
    hits = [p == t for p, t in known]
    found = [p for p, t in known if t == 1]
    return sum(hits) / len(hits), sum(found) / len(found)


def test_held_out_accuracy(spark, folder):
    path, truth, texts = tables(spark, folder)
    # Toxicity learns from some sixty positives here; the floor of what it finds is that of so small a sample.
    for query, k, floor in ((qm.op8, 0, 0.85), (tx.op10, 1, 0.7)):
        rows = query(spark, path).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
        right, found = accuracy(rows, truth, k)
        assert right > 0.93 and found > floor, (query, right, found)


def test_without_labels(spark, folder):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = folder(["some text", None, ""], labels=none)
    assert [r.score for r in qm.op8(spark, path).collect()] == [0.5] * 3
    assert [r.predicted for r in tx.op10(spark, path).collect()] == [0] * 3


def test_rules_of_a_description():
    text = """Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 > 2.0)
      Predict: 1.0
     Else (feature 1 <= 2.0)
      Predict: 0.0
    Else (feature 0 > 1.5)
     Predict: 0.0"""
    a, b = qm.STATISTICS[:2]
    assert set(qm.tree_rules(text)) == {((a, "<=", 1.5),), ((a, "<=", 1.5), (b, ">", 2.0)), ((a, "<=", 1.5), (b, "<=", 2.0)), ((a, ">", 1.5),)}
