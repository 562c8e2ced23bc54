"""Interval-coded states and as-of joins with several anchors, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from duewise.operators.joins import asof_anchors
from duewise.plans import daily_state as ds

D0 = datetime.date(2001, 1, 1)


def day(n):
    return D0 + datetime.timedelta(days=n)


class Tables(dict):
    """Tables by name, with the panel's bounds as a source states them."""

    def __init__(self, first, last, **tables):
        super().__init__(tables)
        self.source = type("Source", (), {"panel": (F.lit(first), F.lit(last))})()


@pytest.fixture(scope="module")
def loans(spark):
    rng = random.Random(4)
    plans = [(i, 100 + i % 3, day(rng.randrange(60)), float(rng.randrange(1, 400))) for i in range(40)]
    paid = [(rng.randrange(45), day(rng.randrange(-20, 260)), rng.choice([10.0, 25.5, 80.0]), rng.choice(["SUCCESS", "REVERSED"])) for _ in range(120)]
    paid += [(3, day(70), 5.0, "SUCCESS")] * 30 + [(None, day(3), 1.0, "SUCCESS"), (4, None, 1.0, "SUCCESS")]
    wh = Tables(
        day(30), day(240),
        ods_repayment_plan=spark.createDataFrame(plans, "loan_id long, customer_id long, due_date date, due_amount double"),
        dwd_repayment_detail_di=spark.createDataFrame(paid, "loan_id long, repay_date date, repay_amount double, repay_status string"),
    )
    return wh, plans, paid


def brute(plan, paid, at):
    loan, customer, due, amount = plan
    repaid = sum(a for i, d, a, s in paid if i == loan and d is not None and d <= at and s == "SUCCESS")
    owed = round(max(amount - repaid, 0.0), 2)
    dpd = 0 if owed <= 0 else (at - due).days
    status = "closed" if owed <= 0 else "current" if dpd == 0 else "overdue" if dpd <= 30 else "in_collection"
    bucket = "CURRENT" if dpd == 0 else "M1" if dpd <= 30 else "M2" if dpd <= 60 else "M3+"
    return (at, loan, customer, dpd, bucket, owed, status, repaid)


def test_daily_states_of_every_day_from_the_due_date(loans):
    wh, plans, paid = loans
    want = {brute(p, paid, day(n)) for p in plans for n in range(30, 241) if p[2] <= day(n)}
    rows = [tuple(r) for r in ds.loan_daily_state(wh).collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert max(r[3] for r in rows) > 200 and any(r[4] == "M3+" for r in rows)


def test_changes_grow_with_payments_not_with_days(loans):
    wh, plans, paid = loans
    rows = ds.loan_changes(wh).collect()
    days = {(i, max(d, next(p[2] for p in plans if p[0] == i))) for i, d, a, s in paid if s == "SUCCESS" and d is not None and i is not None and i < 40}
    assert len(rows) == len(days | {(p[0], p[2]) for p in plans})
    by_loan = {}
    for r in rows:
        by_loan.setdefault(r.loan_id, []).append((r.valid_from, r.valid_to, r.outstanding_amount))
    for spans in by_loan.values():
        spans.sort(key=lambda x: x[0])
        assert all(a[1] == b[0] and a[2] >= b[2] for a, b in zip(spans, spans[1:])) and spans[-1][1] is None


def test_states_at_several_dates_without_a_panel(spark, loans):
    wh, plans, paid = loans
    asked = [(p[0], day(20), day(200)) for p in plans] + [(99, day(20), day(200))]
    got = ds.loan_states_at(wh, spark.createDataFrame(asked, "loan_id long, a date, b date"), {"x": "a", "y": "b"}).collect()
    assert {r.loan_id for r in got} == {p[0] for p in plans}
    for r in got:
        plan = plans[r.loan_id]
        for state, at in ((r.x, day(20)), (r.y, day(200))):
            if at < plan[2]:
                assert state is None
            else:
                b = brute(plan, paid, at)
                assert tuple(state) == (at, b[3], b[5], b[6])


def test_asof_with_several_anchors(spark):
    rng = random.Random(7)
    # Key 1 holds most of both sides; key 9 has no history, key 8 no point.
    history = [(rng.choice([1, 1, 1, 2, 3, 8]), day(rng.randrange(300)), rng.randrange(1000)) for _ in range(300)]
    history += history[:20] + [(None, day(1), 1), (2, None, 2)]
    points = [(i, rng.choice([1, 1, 1, 2, 3, 9, None]), day(rng.randrange(-10, 320)), rng.choice([None, day(rng.randrange(320))])) for i in range(200)]
    p = spark.createDataFrame(points, "id long, k long, a date, b date")
    h = spark.createDataFrame(history, "k long, t date, v long")
    got = {(r.id, r.anchor): r.state and r.state.v for r in asof_anchors(p, h, ["k"], {"first": "a", "second": "b"}, "t", ["v"], ["id"]).collect()}
    want = {}
    for i, k, a, b in points:
        for name, at in (("first", a), ("second", b)):
            if k is not None and at is not None:
                seen = [(t, v) for kk, t, v in history if kk == k and t is not None and t <= at]
                want[i, name] = max(seen)[1] if seen else None
    assert got == want
