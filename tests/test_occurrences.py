"""Positions of keywords: against a plain search, and in a very long text full of hits."""

import random
import re

from pyspark.sql import functions as F

from duewise.functions.text import occurrences, running_sums


def test_positions_are_those_of_a_plain_search(spark):
    rng = random.Random(5)
    texts = ["", "a", "aa", "aaa", "ab.ab", *("".join(rng.choice("ab.") for _ in range(rng.randrange(60))) for _ in range(40))]
    needles = ["a", "ab", "aa", ".", "a.b"]
    df = spark.createDataFrame([(t, n) for t in texts for n in needles], "text string, needle string")
    for r in df.select("*", occurrences("text", F.col("needle")).alias("at")).collect():
        assert r["at"] == [m.start() for m in re.finditer(re.escape(r.needle), r.text)], (r.text, r.needle)


def test_running_sums(spark):
    rows = [([],), ([5],), ([1, 2, 3, 4, 5, 6, 7],), ([3] * 64,), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "v array<int>").select(running_sums(F.col("v")).alias("s")).collect()]
    assert got == [[], [5], [1, 3, 6, 10, 15, 21, 28], [3 * i for i in range(1, 65)], None]


def test_five_megabytes_of_hits(spark):
    text = spark.range(1).select(F.repeat(F.lit("hit..."), 850_000).alias("text"))
    at = text.select(occurrences("text", F.lit("hit")).alias("at")).select(F.size("at").alias("n"), F.element_at("at", -1).alias("last")).first()
    assert (at.n, at["last"]) == (850_000, 6 * 849_999)
