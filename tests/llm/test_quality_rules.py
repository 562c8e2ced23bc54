from collections import Counter

from conftest_llm import EDGE_TEXTS

from duewise.llm import quality_rules as qr
from duewise.llm.common import Workspace


def brute(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cov = {j for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cov))


def test_op2_counts(spark, folder):
    rep = " ".join(f"w{i}" for i in range(30))
    texts = [*EDGE_TEXTS, f"{rep} {rep}", f"{rep} x {rep} y {rep}", f"{rep}\n{rep}\n {rep}\n\n \n", "a#b*c$d%e&f|g<h>i", "a b " * 40,
             "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", " ".join(str(i % 11) for i in range(200)), "w " * 7, "w " * 8, "w " * 9]
    rows = qr.op2(spark, folder(texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "short", "bad") for i in range(80)] + [(i, good, "bad") for i in range(80, 90)]
    rows += [(i, good, "fine") for i in range(100, 200)] + [(i, "short", "fine") for i in range(200, 203)]
    rows += [(300, "short", "single"), (301, good, None), (301, good, None)]
    rows += [(400 + i, good, f"h{i % 7}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as n_words", "1 as host")
    judged, hosts = qr.judge_documents(df, Workspace(spark, "t"))
    got = {(r.host, r.base_failed): r.kept for r in judged.collect()}
    assert not got["bad", False] and got["fine", False] and got[None, False]
    rates = {r.host: r.too_short_rate for r in hosts.collect()}
    # One failure of one document is not enough to condemn a host; nine in ten of ninety are.
    assert 0.8 < rates["bad"] < 80 / 90 and rates["single"] < 0.9 and judged.count() == len(rows)


def test_empty(spark, folder):
    assert qr.op2(spark, folder([])).count() == 0
