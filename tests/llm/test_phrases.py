import random
import re
from collections import Counter

import numpy as np
from conftest_llm import EDGE_TEXTS

from duewise.llm import phrases as ph
from duewise.llm.common import Workspace

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=30, returned=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, g), a in found.items():
        inside = [k for k in found if k[0] == lang and len(k[1]) > len(g) and any(k[1][i : i + len(g)] == g for i in range(4))]
        if any(100 * found[k] >= 80 * a for k in inside):
            continue
        cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:returned]
        ranked += [(x[0], r, *x[1:]) for r, x in enumerate(own, 1)]
    return sorted(ranked)


def rows_of(rng, n):
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünï", "日本", "don't"]
    fixed = ["new york city hall", "in spite of", "The The the THE", "q r"]
    rows = [(t, None) for t in EDGE_TEXTS] * 2
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "."]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "w1", None, ""])))
    return rows


def test_against_brute_force(spark):
    rows = rows_of(random.Random(5), 250)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = ph.find_phrases(df, Workspace(spark, "t"))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    # Few phrases are returned.
    assert sorted(map(tuple, ph.find_phrases(df, Workspace(spark, "t"), 7).collect())) == brute(rows, returned=7)


def test_beginnings_before_a_range_are_found(spark):
    # One first word for nearly all rows of the stream, cut into many ranges.
    rows = [(1, 0, 0, 0, 900)] + [(1, 1000 + i, 0, 0, 100 + i) for i in range(40)] + [(1, 1000, 2000 + i, 0, 50 + i) for i in range(60)]
    rows += [(1, 1000, 2000, 3000 + i, 31 + i) for i in range(60)] + [(-5, 0, 0, 0, 77), (-5, 1, 0, 0, 40)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        stream = spark.createDataFrame(rows, "w1 long, w2 long, w3 long, w4 long, n long")
        got = {tuple(r)[:4]: tuple(r)[5:] for r in ph.lockstep(stream, Workspace(spark, "t"), "x").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    counts = {r[:4]: r[4] for r in rows}
    for key in counts:
        length = sum(x != 0 for x in key)
        assert got[key] == tuple(counts[key[:k] + (0,) * (4 - k)] if k < length else None for k in (1, 2, 3)), key


def test_keys_are_distinct_and_of_the_language():
    data = " ".join(f"{a}{b}" for a in "abcdefgh" for b in range(500)).encode()
    one, two = ph.Piece(data, b"en", 0), ph.Piece(data, b"de", 0)
    assert len(np.unique(np.concatenate([one.keys, two.keys]))) == 8000
    assert ph.Piece(b"de", b"en", 0).keys != ph.Piece(b"en", b"de", 0).keys


def test_odd_tables(spark):
    schema = "text string, lang string, w1 int, n int, key string"
    assert ph.find_phrases(spark.createDataFrame([], schema), Workspace(spark, "t")).count() == 0
    long = "a b " * 400_000 + "x" * 1_000_000
    got = ph.find_phrases(spark.createDataFrame([(None, None, 1, 2, "k"), (long, None, 3, 4, "k")], schema), Workspace(spark, "t")).collect()
    # The longer phrases have nearly the same counts, so only those of four words stay.
    assert sorted((r.lang, r.phrase, r.a, r.n) for r in got) == [("und", "a b a b", 399_999, 800_001), ("und", "b a b a", 399_998, 800_001)]


def test_a_task_hands_on_each_phrase_once(monkeypatch):
    monkeypatch.setattr(ph, "ROOM", 64)
    rng = np.random.default_rng(3)
    counts, out, want = ph.Counts(4), [], Counter()
    for _ in range(40):
        rows = rng.integers(0, 2, (30, 4)).astype(np.uint64)
        want.update(map(tuple, rows.tolist()))
        out += counts.add(rows)
    out += counts.take()
    got = [tuple(r[k] for k in (*ph.KEYS, "n")) for b in out for r in b.to_pylist()]
    assert sorted(got) == sorted((*k, n) for k, n in want.items())


def test_more_phrases_than_room(monkeypatch):
    monkeypatch.setattr(ph, "ROOM", 64)
    rng = np.random.default_rng(4)
    counts, out, want = ph.Counts(2), [], Counter()
    for _ in range(40):
        rows = rng.integers(0, 40, (30, 2)).astype(np.uint64)
        want.update(map(tuple, rows.tolist()))
        out += counts.add(rows)
    got = Counter()
    for b in [*out, *counts.take()]:
        for r in b.to_pylist():
            got[r["w1"], r["w2"]] += r["n"]
    assert got == want


def test_bitmaps_follow_the_number_of_keys(spark):
    keys = ph.mix(np.arange(1, 4001, dtype=np.uint64))
    df = spark.createDataFrame([(int(k),) for k in keys[:2000].view(np.int64)], "key long")
    bitmap = ph.Bitmap(df, ("t", "t"))
    assert len(bitmap.shared.value) <= 2000 * ph.SPARE // 4
    assert bitmap.may_hold(keys[:2000]).all() and bitmap.may_hold(keys[2000:]).sum() < 60
    bitmap.close()
    few = ph.Bitmap(df.where("false"), ("none", "none"))
    assert not few.may_hold(keys).any()
