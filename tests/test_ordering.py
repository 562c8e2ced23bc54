"""Running totals over bounded pieces and exact medians of many columns, against plain loops."""

import statistics

from pyspark.sql import functions as F

from duewise.operators.ordering import exact_medians, running_totals
from duewise.plans.models import median_fill


def rows_of(n):
    # A third of the values are equal; nulls and NaN are among them.
    return [(i, None if i % 7 == 0 else float(i % 3 and i % 31), float("nan") if i % 5 == 0 else float(i % 6), None, i) for i in range(n)]


def frame(spark, n):
    return spark.createDataFrame(rows_of(n), "id long, a double, b double, c double, d int")


def test_running_totals_over_many_slices_and_pieces(spark):
    data = rows_of(900)
    out = running_totals(frame(spark, 900).select("id", "a", "d"), [F.col("id").desc()], {"s": "d", "sa": "a"}, slice_rows=170, piece_rows=13)
    s, sa = 0, 0.0
    for k, row in enumerate(sorted(out.collect(), key=lambda r: r.position)):
        want = data[899 - k]
        s, sa = s + want[4], sa + (want[1] or 0.0)
        assert (row.position, row.id, row.s, row.row_total, row.s_total) == (k + 1, want[0], s, 900, sum(range(900)))
        assert abs(row.sa - sa) < 1e-6


def test_positions_alone_and_empty_tables(spark):
    df = frame(spark, 500)
    out = running_totals(df.select("id"), [F.col("id")], {}, slice_rows=90).collect()
    assert sorted((r.id + 1, r.position) for r in out) == [(i, i) for i in range(1, 501)]
    assert running_totals(df.filter("id < 0"), [F.col("id")], {"s": "d"}).collect() == []


def test_a_group_of_equal_keys_stays_whole(spark):
    df = spark.range(400).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("k"))
    out = running_totals(df.withColumn("one", F.lit(1)), [F.col("k")], {"n": "one"}, slice_rows=50, piece_rows=8).collect()
    assert sorted(r.position for r in out) == list(range(1, 401)) == sorted(r.n for r in out)
    assert max(r.position for r in out if r.k == 1) == 300


def test_exact_medians_of_columns(spark):
    data = rows_of(300)
    got = {r["name"]: r for r in exact_medians(frame(spark, 300), ["a", "b", "c", "d"]).collect()}
    for i, c in enumerate("abcd"):
        known = [r[i + 1] for r in data if r[i + 1] is not None and r[i + 1] == r[i + 1]]
        assert got[c]["values"] == len(known) and got[c]["median"] == (statistics.median(known) if known else None)
    assert all(r["values"] == 0 for r in exact_medians(frame(spark, 0), ["a", "d"]).collect())


def test_missing_numbers_take_the_training_median(spark):
    df = frame(spark, 300)
    out = median_fill(df, ["a", "b", "c"]).transform(df).collect()
    known = [r[2] for r in rows_of(300) if r[2] == r[2]]
    assert {r.b__num for r in out if r.id % 5 == 0} == {statistics.median(known)} and {r.c__num for r in out} == {0.0}
    assert all(r.a__num == r.a for r in out if r.a is not None)
