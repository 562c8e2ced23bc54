"""Step-change, attribution, leakage, text, contact and return-on-cost fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duewise.functions.text import case_id_in, money, normalize_case_id, quoted_in
from duewise.plans import compliance as cp
from duewise.plans import contact as ct
from duewise.plans import features as ft
from duewise.plans.anomaly import Detection, severity_counts, template_complaint_check, top_findings, trend_drop
from duewise.plans.attribution import Attribution
from duewise.plans.strategy import SCENARIO_SCHEMA, SCENARIOS, roi, roi_summary
from duewise.plans.tools import call_tool
from duewise.plans.warehouse import Warehouse
from duewise.schemas import schema_of, without_personal_fields
from duewise.sources.tables import FrameSet

DAY0 = dt.date(2026, 3, 19)
DAYS = [DAY0 + dt.timedelta(days=i) for i in range(60)]


def late(i):
    return i >= 30


def step_frames(spark):
    make = spark.createDataFrame
    sms = [(f"{i}-{t}-{n}", d, "SMS", t) for i, d in enumerate(DAYS) for t in ("TPL_RISK_NOTICE", "TPL_NORMAL") for n in range(50)]
    moans = [(f"{i}-{t}-{n}", d, t) for i, d in enumerate(DAYS) if late(i) for t, k in (("TPL_RISK_NOTICE", 2), ("TPL_NORMAL", 1)) for n in range(k)]
    people = [(d, c, 40000.0 if c < (2 if late(i) else 1) else 10000.0, "high" if c < (2 if late(i) else 1) else "medium") for i, d in enumerate(DAYS) for c in range(10)]
    return {
        "ads_postloan_dashboard_di": make([(d, .15 if late(i) else .20, .43 if late(i) else .50) for i, d in enumerate(DAYS)], "stat_date date, m1_recovery_rate double, ptp_keep_rate double"),
        "ads_vendor_performance_di": make([(d, v, (.28 if late(i) else .34) if v == "V_B" else .36) for i, d in enumerate(DAYS) for v in ("V_A", "V_B")], "stat_date date, vendor_id string, connect_rate double"),
        "ads_reduction_roi_di": make([(d, .03 if late(i) else .08) for i, d in enumerate(DAYS)], "stat_date date, reduction_usage_rate double"),
        "dws_vendor_line_capacity_di": make([(d, "华东", 140 if late(i) else 100, 10) for i, d in enumerate(DAYS)], "stat_date date, region string, active_case_count long, active_collector_count long"),
        "dws_customer_status_snapshot_di": make(people, "stat_date date, customer_id int, total_outstanding_amount double, risk_level string"),
        "dws_collection_process_wide_di": make([(d, 1, 100, 18 if late(i) else 30) for i, d in enumerate(DAYS)], "stat_date date, case_id int, action_count long, ai_action_count long"),
        "dwd_collection_action_detail_di": make(sms, "action_id string, action_date date, action_type string, template_id string"),
        "dwd_complaint_detail_di": make(moans, "complaint_id string, complaint_date date, template_id string"),
    }


def test_step_changes_give_the_seven_findings(spark):
    run = Detection(Warehouse(FrameSet(spark, step_frames(spark)), strict=True))
    rows = {(r.metric_code, r.dimension_value): r for r in run.findings.collect()}
    expected = {
        ("m1_recovery_rate", "ALL"): (.20, .15, -.05, -.25, "high"), ("connect_rate", "V_B"): (.34, .28, -.06, -.176471, "high"),
        ("avg_case_per_collector", "华东"): (10.0, 14.0, 4.0, .4, "high"), ("high_balance_high_risk_share", "ALL"): (.1, .2, .1, 1.0, "high"),
        ("ai_call_coverage", "AI_OUTBOUND"): (.30, .18, -.12, -.4, "high"), ("reduction_usage_rate", "ALL"): (.08, .03, -.05, -.625, "high"),
        ("ptp_keep_rate", "ALL"): (.50, .43, -.07, -.14, "high"),
    }
    assert set(rows) == set(expected) and not run.warnings
    for key, (b, r, a, c, severity) in expected.items():
        got = rows[key]
        assert (got.baseline_value, got.recent_value, got.absolute_change, got.relative_change) == pytest.approx((b, r, a, c))
        assert got.severity == severity and len(got) == 16
    assert rows[("m1_recovery_rate", "ALL")].recent_window == "2026-04-18~2026-05-17"
    assert "15.00%" in rows[("m1_recovery_rate", "ALL")].explanation
    assert {r.severity: r.finding_count for r in severity_counts(run.findings).collect()} == {"high": 7, "medium": 0, "low": 0}
    assert [r.metric_code for r in top_findings(run.findings, 2).collect()] == ["high_balance_high_risk_share", "reduction_usage_rate"]


def test_template_check_below_its_multiple(spark):
    row = template_complaint_check(Warehouse(FrameSet(spark, step_frames(spark)), strict=True)).first()
    assert (row.recent_value, row.baseline_value, row.fired) == (400.0, 300.0, False)


def test_missing_tables_become_warnings(spark):
    only = {"ads_postloan_dashboard_di": step_frames(spark)["ads_postloan_dashboard_di"]}
    run = Detection(Warehouse(FrameSet(spark, only), strict=True))
    assert len(run.warnings) == 5 and {r.metric_code for r in run.findings.collect()} == {"m1_recovery_rate", "ptp_keep_rate"}
    falling = spark.createDataFrame([(d, 1.0 - i / 100) for i, d in enumerate(DAYS)], "stat_date date, v double")
    assert trend_drop(falling, "v").first().falling and not trend_drop(falling.limit(4), "v").first().falling


def attribution_frames(spark):
    make = spark.createDataFrame
    vendors = ["V_A", "V_B", "V_C", "V_D"]
    loans, mapping, cases, channels, people, dims, scores = [], [], [], [], [], [], []
    for i, d in enumerate(DAYS):
        for j, v in enumerate(vendors):
            key = i * 4 + j
            paid = 80.0 if late(i) and v != "V_A" else 220.0
            loans.append((d, key, key, "P_CASH" if j % 2 == 0 else "P_CONS", "M1", 1000.0, paid))
            mapping.append((key, key))
            cases.append((key, v, f"L{j}", j, "HIGH" if j == 1 else "NORMAL"))
            channels.append((key, "UNKNOWN" if j == 0 else "APP"))
    return {
        "dws_loan_status_snapshot_di": make(loans, "stat_date date, loan_id long, customer_id long, product_code string, dpd_bucket string, due_amount double, repaid_amount_d7 double"),
        "dim_case_loan_mapping": make(mapping, "loan_id long, case_id long"),
        "dim_case": make(cases, "case_id long, current_vendor_id string, current_line_id string, collector_id long, balance_segment string"),
        "dim_loan": make(channels, "loan_id long, channel_code string"),
    }


def test_attribution_scores_and_degraded_path(spark):
    wh = Warehouse(FrameSet(spark, attribution_frames(spark)), strict=True)
    run = Attribution(wh)
    overall = run.overall.first()
    assert (overall.baseline_total, overall.recent_total) == pytest.approx((0.22, 0.115))
    rows = run.results().orderBy("contribution_rank").collect()
    assert wh.notes and rows[0].notes
    assert "channel_code" not in {r.dimension_name for r in rows} and "region" not in {r.dimension_name for r in rows}
    assert ("vendor_id", "V_A") not in {(r.dimension_name, r.dimension_value) for r in rows}
    top = {(r.dimension_name, r.dimension_value): r.contribution_score for r in rows}
    assert top[("vendor_id", "V_B")] == pytest.approx(top[("line_id", "L1")])
    assert rows[0].evidence[0].method == "segment_delta" and len(rows[0].evidence) == 7
    assert [r.contribution_rank for r in rows] == list(range(1, len(rows) + 1))


def loan_frames(spark, action_day=dt.date(2024, 1, 9), kept=True, repaid=10.0):
    make = spark.createDataFrame
    at = dt.datetime.combine(action_day, dt.time(9))
    return {
        "dws_loan_status_snapshot_di": make([(dt.date(2024, 1, 10), 1, 5, "P", "M1", 100.0, repaid, repaid / 100)], "stat_date date, loan_id long, customer_id long, product_code string, dpd_bucket string, due_amount double, repaid_amount_d7 double, recovery_rate_d7 double"),
        "dim_case_loan_mapping": make([(9, 1, True, dt.date(2024, 1, 1))], "case_id long, loan_id long, main_loan_flag boolean, mapping_start_date date"),
        "ods_collection_action": make([(1, 9, at, True, True, kept)], "action_id long, case_id long, action_time timestamp_ntz, connected_flag boolean, ptp_flag boolean, ptp_fulfilled_flag boolean"),
        "ods_postloan_c_score": make([(1, 5, "2024-01-07", 401.0, "D"), (2, 5, "2024-01-13", 849.0, "A")], "score_id long, customer_id long, score_date string, postloan_c_score double, score_level string"),
    }


def test_features_ignore_the_future(spark):
    now = Warehouse(FrameSet(spark, loan_frames(spark)), strict=True)
    seen = ft.recent_actions(now, ft.observations(now)).first()
    assert (seen.action_count_7d, seen.connect_rate_7d, seen.days_since_last_action) == (1.0, 1.0, 1.0)
    flipped = Warehouse(FrameSet(spark, loan_frames(spark, kept=False, repaid=99.0)), strict=True)
    assert ft.recent_actions(flipped, ft.observations(flipped)).first() == seen
    later = Warehouse(FrameSet(spark, loan_frames(spark, dt.date(2099, 1, 1))), strict=True)
    none = ft.recent_actions(later, ft.observations(later)).first()
    assert (none.action_count_7d, none.ptp_rate_7d, none.days_since_last_action) == (0.0, 0.0, None)
    base = ft.observations(now).select("loan_id", "customer_id", "observation_date")
    score = ft.score_asof(now, base).first()
    assert (score.postloan_c_score, score.score_level) == (401.0, "D")
    counts = ft.score_guard_counts(now).first()
    assert (counts.future_score_blocked_count, counts.score_date_fallback_count) == (1, 0)


def test_feature_lists_are_disjoint():
    names = ft.feature_columns([*ft.FEATURE_COLUMNS, *ft.LEAKAGE_COLUMNS, *ft.SENSITIVE_COLUMNS])
    assert all(ft.leakage_guard(names).values()) and "vintage_month" not in ft.feature_columns(names, True)
    with pytest.raises(ValueError):
        ft.dataset(None, target="other")


def test_scanner(spark):
    texts = ["你赶快还钱，今天处理一下。", "再不还款就起诉你。", "我是法院，马上起诉你，还会联系你家人。", "ﬁ 老赖老赖", None]
    rows = cp.scan(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    assert [r.risk_level for r in rows] == ["clean", "medium", "high", "medium", "clean"]
    assert rows[1].violations[0].keyword == "起诉你" and rows[1].violations[0].position == texts[1].index("起诉你")
    assert [v.position for v in rows[3].violations] == [2, 4]
    wide = cp.scan(spark.createDataFrame([("xＡＢＣ",)], "text string"), words={"w": ["ABC"]}).first()
    assert [(v.keyword, v.position) for v in wide.violations] == [("ABC", 1)]


def test_score_merge_rules(spark):
    scanned = spark.createDataFrame([(0, 0, "clean"), (1, 1, "medium"), (2, 2, "medium"), (3, 3, "high")], "id int, violation_count int, risk_level string")
    scores = scanned.select("id", F.create_map(F.lit(cp.RED_LINE), F.lit(85), F.lit(cp.COMPLAINT_RISK), F.lit(10)).alias("dimensions"),
                            F.lit(85).alias("overall_compliance_score"), F.lit(False).alias("supervisor_review_required"))
    rows = cp.merge_scores(scanned, scores, ["id"]).orderBy("id").collect()
    assert [r.dimensions[cp.RED_LINE] for r in rows] == [85, 10, 0, 0]
    assert [r.dimensions[cp.COMPLAINT_RISK] for r in rows] == [10, 70, 80, 90]
    assert [r.overall_compliance_score for r in rows] == [85, 65, 65, 30]
    assert [r.supervisor_review_required for r in rows] == [False, True, True, True]


def test_frequency_limits(spark):
    rows = spark.sql("""select id as case_id, map('sms', struct(t as today, w as week)) as frequency_counts
                        from values (1, 0L, 0L), (2, 2L, 5L), (3, 0L, 5L) v(id, t, w)""")
    got = {r.case_id: r for r in ct.check_frequency(rows, " SMS ").collect()}
    assert [got[i].allowed for i in (1, 2, 3)] == [True, False, False]
    assert "今日触达 2 次" in got[2].block_reason and "近7日触达 5 次" in got[3].block_reason


def test_text_helpers(spark):
    row = spark.range(1).select(normalize_case_id(F.lit(" CASE-1 ")), normalize_case_id(F.lit("CASE00000002")), case_id_in(F.lit("x case-77 y")),
                                quoted_in(F.lit("a “b c” d")), money(F.lit(12253.785)), money(F.lit(1000.0))).first()
    assert tuple(row) == ("CASE00000001", "CASE00000002", "CASE-77", "b c", "12,253.78", "1,000")


def test_roi_formulas(spark):
    rows = spark.createDataFrame(SCENARIOS, SCENARIO_SCHEMA).withColumn("estimated_delta", F.col("rule_delta"))
    got = {r.strategy_type: r for r in roi(rows).collect()}
    assert (got["contact_strategy"].gross_benefit, got["contact_strategy"].action_cost) == (30000.0, 800.0)
    assert (got["contact_strategy"].roi_ratio, got["contact_strategy"].payback_period_days) == (36.5, 0.8)
    assert got["settlement_strategy"].action_cost == pytest.approx(0.15 * got["settlement_strategy"].gross_benefit)
    assert roi_summary(roi(rows)).first().top_scenario_id == "increase_ai_call_coverage"


def test_privacy_and_tools(spark):
    frame = spark.createDataFrame([(1, "n")], schema_of("dim_customer", ["customer_id", "customer_name"]).simpleString().replace("struct<", "").rstrip(">").replace("customer_id:string", "customer_id:int"))
    assert without_personal_fields(frame).columns == ["customer_id"]
    wh = Warehouse(FrameSet(spark, step_frames(spark)), strict=True)
    result = call_tool(wh, "no_such_tool", {"a": 1})
    assert result.row_count == 0 and "unknown" in result.note
