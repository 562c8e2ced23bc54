import hashlib
import re

from conftest_llm import EDGE_TEXTS

from duewise.llm import decontamination as dc
from duewise.llm import personal_data as pd_

ITEMS = [(7, "What is the Capital of the far away land that we all know so very well today?"), (10, "Two words"), (11, None), (12, " "),
         (13, "What is the Capital of the far away land that we all know so very well today?"), (None, "one")]


def test_op6(spark, folder):
    question = ITEMS[0][1]
    texts = [*EDGE_TEXTS, f"Ünicode start: {question.upper()} and then some", "TWO, words! two words", f"{question} {question}",
             "filler " * 300 + "two words"]
    path = folder(texts, benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"))
    want = [dc.brute_force(t, [(i, x) for i, x in ITEMS if x and i is not None]) for t in texts]
    rows = dc.op6(spark, path).orderBy("doc_id").collect()
    for r, (n, hit, items) in zip(rows, want, strict=True):
        ids = ",".join(sorted(map(str, items)))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(items), hashlib.sha256(ids.encode()).hexdigest())
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert rows[9].contaminated and not rows[12].contaminated
    # Parts of the benchmark give the same as the whole; clashing columns are replaced.
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "'x' as items", "1 as n_hit")
    parts = dc.find_contamination(docs, spark.read.parquet(f"{path}/benchmark.parquet"), part_bytes=20).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, sorted(r["items"])) for r in parts] == [(n, h, i) for n, h, i in want]
    text, spans = texts[9], parts[9].spans
    assert [text[s.start:s.end] for s in spans] == [question.upper()[:-1]]


def test_op6_without_benchmark(spark, folder):
    path = folder(["a b"], benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert [r.n_hit for r in dc.op6(spark, path).collect()] == [0]


PII = [
    "write a.b+c@mail.example.com, or x@y@z.org; bad@nodot 10.0.0.1 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111 1", "call +1 (988) 555-2485 or +12 34 or + 1",
    "a@b.c@d.e.f @x.y .@-.-- %@a.b", "1.2.3 4.5.6.7 4.5.6.7890 12345678901234567890.1.2.3", "é" * 50 + "me@ünï.de me@x.de",
    "a" * 200_000, "1" * 200_000, "1." * 50_000, "+1" * 20_000, "@." * 20_000, "a@b." * 2000, "1 " * 100_000,
]


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        odd = sum(int(c) for c in d[::-2]) + sum(int(c) * 2 - 9 * (int(c) > 4) for c in d[-2::-2])
        if 13 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_plain_identifiers():
    for text in PII[:6] + [x[:300] for x in PII[6:]]:
        assert pd_.identifiers(text) == brute_base(text), text[:80]


def test_disguises_map_back():
    cases = {
        "mail joe [at] example [dot] com now": ("email", "joe [at] example [dot] com"),
        "mail joe.b at mail dot example dot com now": ("email", "joe.b at mail dot example dot com"),
        "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ": ("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        "jоe@exаmple.com (Cyrillic)": ("email", "jоe@exаmple.com"),
        "ring plus one nine eight eight five five five two four eight five.": ("phone", "plus one nine eight eight five five five two four eight five"),
        "host 10(dot)0(dot)0(dot)1": ("ip", "10(dot)0(dot)0(dot)1"),
        "card ４１１１ １１１１ １１１１ １１１１ x": ("card", "４１１１ １１１１ １１１１ １１１１"),
        "a​b@ex​ample.com": ("email", "a​b@ex​ample.com"),
    }
    for text, (kind, value) in cases.items():
        got = pd_.spans_of(text)
        assert [(s["kind"], s["value"]) for s in got if not s["plain"]] == [(kind, value)] or (kind, value) in [(s["kind"], s["value"]) for s in got], (text, got)
    for clean in ("The meeting is at noon. Dot the i at one, two, three or four.", "éàü ß ñ 日本 look (at) this", "one two three four five six"):
        assert pd_.spans_of(clean) == []


def test_op7(spark, folder):
    texts = [*EDGE_TEXTS, *PII]
    rows = pd_.op7(spark, folder(texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        t = t or ""
        base = brute_base(t) if len(t) < 5000 else pd_.identifiers(t)
        order = sorted(base, key=lambda x: (pd_.KINDS.index(x[0]), x[1]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in order).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in base) for kind in pd_.KINDS)
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r.spans.split(","))
