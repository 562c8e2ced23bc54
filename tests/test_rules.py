"""Null, zero, window and tie rules on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duewise.functions.buckets import dpd_bucket
from duewise.functions.dates import day_ceiling, days_between, hours_between, parse_date
from duewise.functions.rates import flag_sum, log_amount, rate_or_zero, relative_change, safe_rate, total
from duewise.operators.joins import asof_join, assert_unique, coalescing_join, trailing_features
from duewise.operators.ordering import average_percent_rank, exact_median, latest_per_key, ntile_of, running_totals, top_per_key
from duewise.operators.evaluation import classification_metrics, lift_table, stratified_split
from duewise.plans.metrics import METRIC_CODES, REGISTRY, metric
from duewise.plans.warehouse import Warehouse, plan_recoveries
from duewise.sources.tables import FrameSet, LayeredFolder, TableMissing, read_results_json, write_results_json, write_table

D = dt.date
NAN = float("nan")


def one(df):
    return df.collect()[0]


def test_safe_rate_variants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (1.0, 0.0), (None, 2.0), (1.0, None), (NAN, 2.0), (1.0, NAN)], "n double, d double")
    by_name = [r[0] for r in df.select(safe_rate("n", "d")).collect()]
    by_column = [r[0] for r in df.select(safe_rate(F.col("n"), F.col("d"))).collect()]
    assert by_name == by_column == [0.5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(safe_rate("n", "d", clipped=False)).collect()][1] == 1.5
    assert [r[0] for r in df.select(rate_or_zero("n", F.lit(-2.0))).collect()][0] == -0.5


def test_sums_and_changes(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, True)], "k string, x double, f boolean")
    row = one(df.groupBy("k").agg(total("x").alias("x"), flag_sum("f").alias("f")))
    assert (row.x, row.f) == (0.0, 1)
    assert one(spark.range(1).select(relative_change(F.lit(0.0), F.lit(1.0))))[0] == 0.0
    assert one(spark.range(1).select(relative_change(F.lit(-2.0), F.lit(-1.0))))[0] == 0.5
    assert one(spark.range(1).select(log_amount(F.lit(-5.0))))[0] == 0.0


def test_time_expressions(spark):
    row = one(spark.sql("""select timestamp_ntz'2024-01-08 00:00:00' a, timestamp_ntz'2024-01-08 10:00:00' b,
                           timestamp_ntz'2024-01-07 22:30:00' c""").select(
        day_ceiling("a").alias("x"), day_ceiling("b").alias("y"), hours_between("a", "c").alias("h"),
        days_between("c", "a").alias("d"), parse_date(F.lit("nope")).alias("p")))
    assert (row.x, row.y, row.h, row.d, row.p) == (D(2024, 1, 8), D(2024, 1, 9), 1.5, 0.0, None)
    buckets = spark.createDataFrame([(0,), (30,), (31,), (61,)], "d int").select(dpd_bucket("d"))
    assert [r[0] for r in buckets.collect()] == ["CURRENT", "M1", "M2", "M3+"]


def test_recovery_window_has_no_lower_bound_and_counts_a_plan_once(spark):
    due = spark.createDataFrame([(1, D(2024, 1, 1), 100.0), (2, D(2024, 1, 1), 50.0)], "plan_id int, due_date date, outstanding_amount double")
    pay = spark.createDataFrame([
        (1, dt.datetime(2023, 12, 20), 1.0), (1, dt.datetime(2024, 1, 8), 2.0), (1, dt.datetime(2024, 1, 8, 10), 4.0), (1, dt.datetime(2024, 1, 9), 8.0),
    ], "plan_id int, repay_time timestamp_ntz, repay_amount double")
    rows = {r.plan_id: r for r in plan_recoveries(due, pay, [7, 15]).collect()}
    assert len(rows) == 2 and rows[1].repaid_amount_d7 == 3.0 and rows[1].repaid_amount_d15 == 15.0 and rows[2].repaid_amount_d7 == 0.0


def test_asof_join_against_brute_force(spark):
    import random

    rng = random.Random(7)
    left = [(i, rng.choice(["hot", "hot", "b", None]), D(2024, rng.randint(1, 4), rng.randint(1, 28))) for i in range(120)]
    right = [(i, rng.choice(["hot", "b", "c"]), D(2024, rng.randint(1, 4), rng.randint(1, 28)), i * 1.0) for i in range(80)]
    ldf = spark.createDataFrame(left, "id int, k string, t date")
    rdf = spark.createDataFrame(right, "sid int, k string, at date, v double")
    for unit in ("month", "week", None):
        got = {r.id: (r.sid, r.v) for r in asof_join(ldf, rdf, ["k"], "t", "at", ["sid", "v"], tie_break=["sid"], slice_unit=unit).collect()}
        for i, k, t in left:
            past = [(at, sid, v) for sid, rk, at, v in right if rk == k and at <= t]
            assert got[i] == (max(past)[1:] if past else (None, None))


def test_trailing_window_bounds(spark):
    anchors = spark.createDataFrame([(1, "a", D(2024, 1, 10)), (2, "z", D(2024, 1, 10)), (3, None, D(2024, 1, 10))], "id int, k string, d date")
    facts = spark.createDataFrame([("a", D(2024, 1, d)) for d in (3, 4, 10, 11)], "k string, day date")
    rows = {r.id: r for r in trailing_features(anchors, facts, ["k"], "d", "day", {"n": F.lit(1)}, 7, last_date="last").collect()}
    assert (rows[1].n, rows[1]["last"]) == (2, D(2024, 1, 10)) and rows[2].n is None and rows[3].n is None


def test_orders_and_medians(spark):
    df = spark.createDataFrame([(i, [5.0, 1.0, 5.0, 2.0, None][i % 5]) for i in range(100)], "id int, v double")
    values = sorted(v for v in ([5.0, 1.0, 5.0, 2.0] * 20))
    assert one(exact_median(df, "v"))[0] == (values[39] + values[40]) / 2
    run = running_totals(df.dropna(), [F.col("v").desc(), F.col("id").asc()], {"s": "v"}).orderBy("position").collect()
    assert [r.position for r in run] == list(range(1, 81)) and run[-1].s == sum(values) and run[0].v == 5.0
    ranks = {r.v: r.pct_rank for r in average_percent_rank(df.dropna(), "v").distinct().collect()}
    assert ranks[1.0] == pytest.approx((1 + 20) / 2 / 80)
    sizes = spark.range(1, 24).select(ntile_of(F.col("id"), F.lit(23), 10).alias("b")).groupBy("b").count().orderBy("b")
    assert [r["count"] for r in sizes.collect()] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]


def test_latest_and_top_are_deterministic_on_ties(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1), 1), ("a", D(2024, 1, 2), 2), ("a", D(2024, 1, 2), 3), ("a", None, 9)], "k string, d date, i int")
    assert one(latest_per_key(df, ["k"], "d", ["i"])).i == 3
    assert {r.i for r in top_per_key(df, ["k"], [F.col("i").desc()], 2).collect()} == {9, 3}


def test_checked_and_coalescing_joins(spark):
    left = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    right = spark.createDataFrame([(1, "r"), (2, "r")], "k int, v string")
    assert {(r.k, r.v) for r in coalescing_join(left, right, ["k"], ["v"]).collect()} == {(1, "r"), (2, "x")}
    with pytest.raises(ValueError):
        assert_unique(right.union(right), ["k"], "right")


def test_classifier_metrics_match_hand_values(spark):
    rows = [(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.7), (4, 0, 0.3), (5, 1, 0.3), (6, 0, 0.1)]
    df = spark.createDataFrame(rows, "id int, y int, s double")
    pairs = [(a[2], b[2]) for a in rows if a[1] for b in rows if not b[1]]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    got = one(classification_metrics(df, "y", "s"))
    assert got.auc == round(auc, 6) and got.ks == round(1 / 3, 6)
    assert got.pr_auc == round((1 * 1 + 2 / 3 + 3 / 5) / 3, 6)
    assert (got.tp, got.fp, got.fn, got.tn) == (2, 1, 1, 2)
    table = lift_table(df, "y", "s", "id", 3).orderBy("decile").collect()
    assert [r.positive_count for r in table] == [1, 1, 1] or sum(r.positive_count for r in table) == 3
    assert table[-1].cumulative_capture_rate == 1.0


def test_split_is_exact_per_class(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 < 3).cast("int").alias("y"))
    counts = {(r.y, r.is_test): r["count"] for r in stratified_split(df, "y", "id").groupBy("y", "is_test").count().collect()}
    assert counts == {(1, True): 75, (1, False): 225, (0, True): 175, (0, False): 525}


def test_registry_and_folder_io(spark, tmp_path):
    assert len(METRIC_CODES) == 26 and set(REGISTRY) == set(METRIC_CODES)
    with pytest.raises(KeyError):
        metric(None, "nope")
    df = spark.createDataFrame([(D(2024, 1, 1), "a")], "stat_date date, k string")
    write_table(df, str(tmp_path), "ads_x_di", "csv")
    folder = LayeredFolder(spark, str(tmp_path), {"ads_x_di": df.schema})
    assert folder.table("ads_x_di").collect() == df.collect()
    with pytest.raises(TableMissing):
        folder.table("ads_missing")
    assert folder.optional("ads_missing", df.schema).count() == 0 and folder.notes
    nested = spark.sql("select 'a' id, array(struct('m' method, 1.5D delta)) evidence")
    path = write_results_json(nested, str(tmp_path / "r.json"))
    assert read_results_json(spark, path, nested.schema).collect() == nested.collect()


def test_complaints_repeat_on_the_real_process_grain(spark):
    t = dt.datetime(2024, 1, 1, 9)
    flags = "connected_flag boolean, ptp_flag boolean, ptp_fulfilled_flag boolean, ai_outbound_flag boolean"
    action = spark.createDataFrame(
        [(1, 7, 1, "v", "l", 10, t, "CALL", None, True, False, False, False), (2, 7, 1, "v", "l", 11, t, "CALL", None, True, True, False, False),
         (3, 7, 1, None, "l", 11, t, "CALL", None, True, True, False, False)],
        f"action_id int, case_id int, customer_id int, vendor_id string, line_id string, collector_id int, action_time timestamp_ntz, action_type string, template_id string, {flags}")
    complaint = spark.createDataFrame([(1, 7, 1, "v", 10, None, t, "T", "LOW")], "complaint_id int, case_id int, customer_id int, vendor_id string, collector_id int, template_id string, complaint_time timestamp_ntz, complaint_type string, complaint_level string")
    wh = Warehouse(FrameSet(spark, {"ods_collection_action": action, "ods_complaint": complaint}))
    rows = wh["dws_collection_process_wide_di"].orderBy("collector_id").collect()
    assert [(r.collector_id, r.complaint_count) for r in rows] == [(10, 1), (11, 1)]
