import hashlib
import random

import corpus_pipeline
import test_line_dedup
import test_ngram_join
import test_quality_rules
from conftest_llm import DOCUMENTS, EDGE_TEXTS

from duewise.llm import byte_bpe, decontamination


def corpus():
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    common = [text(12) for _ in range(3)]
    texts = list(EDGE_TEXTS) + [f"{text(30)}\n{rng.choice(common)}\n{text(9)}" for _ in range(30)]
    # Lines of two to five documents.
    for n in (2, 3, 5):
        own = text(14)
        texts += [f"{text(25)}\n{own}\n{text(8)}" for _ in range(n)]
    base = [text(80) for _ in range(3)]
    for b in base:
        for k in range(4):
            words = b.split()
            words[rng.randrange(80)] = f"x{k}"
            texts.append(" ".join(words) + "\n" + text(2))
    question = text(20)
    texts += [f"{text(10)} {question} {text(20)}", f"{text(500)} {question}", text(5), " ".join(["same"] * 60), base[0], base[0]]
    return texts, [(1, question), (2, text(15)), (3, None)]


def brute(texts, items):
    rows = [(i, t) for i, t in enumerate(texts)]
    out = []
    for i, t in rows:
        n, *_, rep = test_quality_rules.brute(t)
        if n >= 20 and 100 * rep <= 30 * n:
            out.append((i, t))
    rows = out
    counts = list(test_line_dedup.brute([t for _, t in rows]))
    kept = list(test_line_dedup.brute_texts([t for _, t in rows]))
    rows = [(i, k) for (i, _), (n, _, gone, _), k in zip(rows, counts, kept) if n > gone or n == 0]
    groups = test_ngram_join.brute([t for _, t in rows], 5, 80)
    rows = [r for k, (r, (n, c)) in enumerate(zip(rows, groups)) if c == k or n == 0]
    good = []
    for i, t in rows:
        n, hit, _ = decontamination.brute_force(t, [(a, b) for a, b in items if b])
        if not (hit and 20 * hit >= n):
            good.append((i, t))
    return good


def test_pipeline(spark, folder):
    texts, items = corpus()
    path = folder(texts, sources={i: "one" for i in range(len(texts))}, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    want = brute(texts, items)
    rows = corpus_pipeline.run(spark, path).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [i for i, _ in want]
    bpe = byte_bpe.ByteBpe(*byte_bpe.public_vocabulary())
    for r, (_, t) in zip(rows, want, strict=True):
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(bpe.encode(t)).hexdigest() and r.n_tokens == len(r.token_ids)
    assert len(want) < len(texts) - 10


def test_stages_on_odd_tables(spark, folder):
    path = folder([], benchmark=spark.createDataFrame([], "item_id long, text string"))
    clashing = ["1 as n_words", "'x' as own", "2 as row_id", "3 as text_key", "'y' as host", "4 as ids", "5 as node", "6 as gone"]
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1, good, "en", None, 3), (1, good, "en", None, 3), (None, None, None, None, None), (2, good + " more", "en", "s", 9), (3, "", "", "", 0)]
    for data, left in (([], [0] * 4), (rows, [3, 5, 3, 5])):
        docs = spark.createDataFrame(data, DOCUMENTS).selectExpr("*", *clashing).coalesce(1)
        for (_, stage), n in zip(corpus_pipeline.STAGES[:-1], left, strict=True):
            out = stage(spark, docs, path)
            assert out.columns == docs.columns and out.count() == n
        assert corpus_pipeline.encode(spark, docs, path).count() == docs.count()
