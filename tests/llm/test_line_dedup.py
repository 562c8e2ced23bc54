import hashlib
import random

import numpy as np
from conftest_llm import EDGE_TEXTS

from duewise.llm import line_dedup as ld
from duewise.llm.common import Workspace


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        at = rng.randrange(len(line) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            line.insert(at, rng.choice("abcé"))
        elif line and at < len(line):
            line[at : at + 1] = [] if kind == 1 else [rng.choice("abcé")]
    return "".join(line)


def test_banded_distance():
    rng = random.Random(1)
    for k in (1, 2, 3):
        pairs = []
        for _ in range(400):
            a = "".join(rng.choice("abc") for _ in range(rng.randrange(8, 60)))
            pairs.append((a, edited(rng, a, rng.randrange(0, 6))))
        codes = [tuple(np.array([ord(c) for c in t]) for t in p) for p in pairs]
        pairs_ok = [(p, c) for p, c in zip(pairs, codes) if min(map(len, p)) > k]
        got = ld.within([c for _, c in pairs_ok], k)
        assert got.tolist() == [distance(a, b) <= k for (a, b), _ in pairs_ok]


def test_segments_miss_nothing():
    rng = random.Random(2)
    for edits in (1, 2, 3):
        for _ in range(300):
            a = "".join(rng.choice("ab") for _ in range(rng.randrange(4 * edits + 1, 50)))
            b = edited(rng, a, rng.randrange(0, edits + 1))
            if len(b) < 4 * edits + 1:
                continue
            long, short = (a, b) if len(a) >= len(b) else (b, a)
            index, _ = ld.segment_keys([ld._code_points(short)], edits)
            _, probe = ld.segment_keys([ld._code_points(long)], edits)
            if distance(a, b) <= edits:
                assert set(index[0]) & set(probe[0])


def _classes(texts, edits=2, min_chars=30, min_documents=2):
    at, names = [], []
    for d, t in enumerate(texts):
        for i, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if line:
                at.append((d, i))
                names.append(line)
    distinct = sorted(set(names))
    group = {x: x for x in distinct}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if len(a) >= min_chars and len(b) >= min_chars and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                group[find(a)] = find(b)
    members = {}
    for line in distinct:
        members.setdefault(find(line), []).append(line)
    docs = {}
    for (d, _), line in zip(at, names):
        docs.setdefault(find(line), set()).add(d)
    seen, gone = set(), {}
    for (d, i), line in zip(at, names):
        c = find(line)
        key = c if len(docs[c]) >= min_documents else (c, d)
        if key in seen:
            gone.setdefault(d, set()).add(i)
        seen.add(key)
    return at, names, find, members, gone


def brute_texts(texts):
    *_, gone = _classes(texts)
    for d, t in enumerate(texts):
        yield "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, ()))


def brute(texts):
    at, names, find, members, gone = _classes(texts)
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        own = [line for (e, _), line in zip(at, names) if e == d]
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone.get(d, ()))
        yield len(own), sum(len(members[find(x)]) > 1 for x in own), len(gone.get(d, ())), hashlib.sha256(kept.encode()).hexdigest()


def test_op9(spark, folder):
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcdé ") for _ in range(n)).strip() + "."
    common, short = [line(60) for _ in range(4)], ["short line", "other", "another one"]
    texts = list(EDGE_TEXTS)
    # Classes of two to five documents, equal and edited.
    few = [line(50) for _ in range(4)]
    for n, own in zip((2, 3, 4, 5), few, strict=True):
        texts += [f"{line(40)}\n{edited(rng, own, k % 2)}\n{line(9)}" for k in range(n)]
    for _ in range(40):
        lines = [line(rng.randrange(5, 80)) for _ in range(rng.randrange(0, 4))]
        lines += [edited(rng, rng.choice(common), rng.randrange(0, 4)) for _ in range(rng.randrange(0, 4))]
        lines += [rng.choice(short) for _ in range(rng.randrange(0, 2))] + ["", "  "][: rng.randrange(0, 3)]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    rows = ld.op9(spark, folder(texts)).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_near, r.n_removed, r.kept_sha256) for r in rows] == list(brute(texts))


def test_columns_and_empty_tables(spark, folder):
    df = spark.createDataFrame([(1, "a\na\n", 5, "x"), (1, "a\na\n", 6, "y"), (None, None, 7, "z")], "doc_id long, text string, row_id int, n_lines string")
    got = ld.remove_lines(df, Workspace(spark, "t"))
    assert got.columns == ["doc_id", "text", "row_id", "n_lines", "n_removed", "n_near"]
    assert sorted((r.row_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == [(5, "a\n", 2, 1), (6, "a\n", 2, 1), (7, None, 0, 0)]
    assert ld.op9(spark, folder([])).count() == 0
