import math
import random

import numpy as np

from duewise.llm import hard_negatives as hn
from duewise.llm.common import Workspace

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = {}
    for i, v, c in rows:
        if i is None or c is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (c + 1) % 10 if i % 7 == 0 else c
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        good[i] = min(good.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in good.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, c) for i, (c, p) in good.items() if i != a)
        for s, i, c in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= -100 * x[0] <= 90 * -s][:10]
            out += [(a, i, k, n[1], -s, -n[0]) for k, n in enumerate(fits, 1)]
    return sorted(out)


def vectors(rng, n, dim=12):
    base = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        near = rng.random() < 0.6
        v = [x + rng.gauss(0, 0.05) for x in rng.choice(base)] if near else [rng.gauss(0, 0.4) for _ in range(dim)]
        rows.append((i, v, rng.randrange(4)))
    return rows


def test_op12(spark, tmp_path, monkeypatch):
    # Small trees and leaves, so that every bound and cut is used.
    for name, value in (("TREE_ROWS", 64), ("LEAF", 4), ("CHILDREN", 3), ("SEARCH_ROWS", 3)):
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(3)
    rows = vectors(rng, 701)
    # A third of all rows are one vector: ties, and a group that must not fill one tree.
    rows = [(i, rows[1][1] if i % 3 == 1 else v, c) for i, v, c in rows]
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] * 12, 2), (904, [0.1] * 12, None), (None, [0.1] * 12, 1)]
    rows += [(1000, [0.0] * 12, 1), (1100, [2.0e9] * 12, 2), rows[100], rows[5]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = hn.op12(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bounds_hold_for_every_point_below_a_node():
    rng = np.random.default_rng(1)
    points = np.floor(256 * rng.standard_normal((900, 10)) * rng.random((900, 1)))
    tree = hn.CoverTree.build(np.arange(900), points)
    back = hn.CoverTree.from_row(tree.to_row())
    anchors = np.floor(256 * rng.standard_normal((20, 10)))
    least, most = back.bounds(anchors)
    assert sorted(tree.ids.tolist()) == list(range(900)) and len(tree.leaf) > 20
    ends = [len(tree.leaf)] * len(tree.leaf)
    for node in range(len(tree.leaf)):
        below = {node}
        for k in range(node + 1, len(tree.leaf)):
            if tree.parent[k] in below:
                below.add(k)
        own = np.concatenate([np.arange(tree.first[k], tree.first[k] + tree.size[k]) for k in below if tree.leaf[k]])
        scores = anchors @ tree.points[own].T
        assert (scores >= least[:, [node]]).all() and (scores <= most[:, [node]]).all()
        assert len(own) == tree.size[node] and ends[node]


def test_search_skips_nodes_and_misses_nothing():
    rng = np.random.default_rng(2)
    points = np.floor(256 * np.concatenate([rng.standard_normal((300, 6)) * 0.05 + c for c in rng.standard_normal((8, 6))]))
    tree = hn.CoverTree.build(np.arange(len(points)), points)
    anchors = points[:40]
    own, low, high = np.arange(40), np.full(40, 2_000), np.full(40, 60_000)
    q, ids, scores = tree.search(anchors, own, low, high, 7)
    for a in range(40):
        s = (points @ anchors[a]).astype(int)
        want = sorted((-s[i], i) for i in range(len(points)) if i != a and 2_000 <= s[i] <= 60_000)[:7]
        assert list(zip((-scores[q == a]).tolist(), ids[q == a].tolist())) == want
    least, most = tree.bounds(anchors)
    assert ((most < low[:, None]) | (least > high[:, None])).mean() > 0.2


def test_odd_tables(spark):
    for rows in ([], [(100, [0.5], 1)], [(100, [0.5], 1), (1, [0.5], 2)], [(3, [0.5], 1)]):
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as q", "2 as block", "'x' as r")
        assert hn.mine(df, df.where("vec_id % 100 = 0"), Workspace(spark, "t")).count() == 0
    # Missing components are zero; vectors without components have scores of 0, which lie in the window of 0.
    df = spark.createDataFrame([(100, [], 1), (1, [], 1), (2, [0.5, 0.5], 2)], SCHEMA)
    assert [tuple(r) for r in hn.mine(df, df.where("vec_id = 100"), Workspace(spark, "t")).collect()] == [(100, 1, 1, 2, 0, 0)]
    df = spark.createDataFrame([(100, [1.0, 1.0], 1), (1, [1.0], 1), (2, [0.5], 2)], SCHEMA)
    got = hn.mine(df, df.where("vec_id = 100"), Workspace(spark, "t")).collect()
    assert [tuple(r) for r in got] == [(100, 1, 1, 2, 65536, 32768)]
