import test_line_dedup as base

from duewise.llm import line_dedup as ld
from duewise.llm.common import Workspace

LONG = "a line that stands in two documents and has a good many characters"


def test_classes_of_two_documents_keep_one_line(spark, folder):
    near = LONG.replace("good many", "god many")
    texts = [f"{LONG}\none", f"two\n{LONG}", f"three\n{near}\n{near}", "short\nfour", "short\nfive\nfive", None]
    docs = spark.read.parquet(f"{folder(texts)}/documents.parquet")
    rows = ld.remove_lines(docs, Workspace(spark, "t")).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [f"{LONG}\none", "two", "three", "short\nfour", "five", None]
    # A caller may still ask for a higher bound.
    rows = ld.remove_lines(docs, Workspace(spark, "t"), min_documents=4).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [f"{LONG}\none", f"two\n{LONG}", f"three\n{near}", "short\nfour", "short\nfive", None]


def test_op9_against_brute_force_of_two(spark, folder):
    texts = [f"{LONG} {i // 2}\nown {i}\n{'x' * (i % 5)}" for i in range(12)] + [f"{LONG}!\n{LONG}?"]
    at, names, find, members, gone = base._classes(texts, min_documents=2)
    want = ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in enumerate(texts)]
    rows = ld.remove_lines(spark.read.parquet(f"{folder(texts)}/documents.parquet"), Workspace(spark, "t")).orderBy("doc_id").collect()
    assert [r.text for r in rows] == want and gone
