import random

import test_line_dedup as base

from duewise.llm import line_dedup as ld
from duewise.llm.common import Workspace

LINE = "each of the many variants of this line differs from it in one or two places"


def test_five_hundred_variants_of_a_line_make_one_class(spark, folder):
    rng = random.Random(5)
    variants = {base.edited(rng, LINE, rng.randrange(1, 3)) for _ in range(500)}
    far = ["another line with the same ending differs from it in one or two places", "no line is near to this one, whatever its length is"]
    docs = spark.read.parquet(f"{folder([*sorted(variants), LINE, *far])}/documents.parquet")
    occurrences, classes = ld.line_classes(docs, Workspace(spark, "t"))
    rows = classes.collect()
    texts = {r.line_id: r.line for r in ld.line_occurrences(docs).collect()}
    assert {texts[r.line_id] for r in rows} == {*variants, LINE} and len({r.component for r in rows}) == 1


def test_groups_against_all_pairs(spark):
    rng = random.Random(6)
    seeds = ["".join(rng.choice("ab ") for _ in range(36)) for _ in range(12)]
    # Short alphabets and shared thirds: many keys hold lines of several groups.
    seeds += [seeds[i][:12] + seeds[(i + 1) % 12][12:24] + seeds[(i + 5) % 12][24:] for i in range(12)]
    lines = sorted({base.edited(rng, rng.choice(seeds), rng.randrange(0, 4)).strip() for _ in range(260)})
    lines = [x for x in lines if len(x) >= 30]
    frame = spark.createDataFrame(list(enumerate(lines)), "number long, line string")
    got = {r.node: r.component for r in ld.near_groups(frame, Workspace(spark, "t")).collect()}
    want = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            if abs(len(lines[j]) - len(x)) <= 2 and want[i] != want[j] and base.distance(lines[j], x) <= 2:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    linked = {i: w for i, w in enumerate(want) if want.count(w) > 1}
    assert got == linked and len(set(linked.values())) > 3
