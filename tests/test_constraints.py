"""Constraint rows on tables with planted faults."""

from duewise.operators.constraints import Reference, TableRules, evaluate, rules_by_name, unmet_references


def found(df):
    return {(r.constraint_name, r.column_name): (r.row_count, r.bad_count) for r in df.collect()}


SCHEMA = "a long, b string, paid_amount double, late_fee string, hit_rate double, strategy string, address string"


def test_every_rule_counts_what_breaks_it(spark):
    rows = [
        (1, "x", -1.0, "-2", 1.5, "keep", "road"), (1, "x", 2.0, "none", -0.1, "5", None), (1, "x", None, "3", None, None, None),
        (None, "x", float("nan"), None, 1.0, "-1", None), (None, "x", -3.0, "-0", 0.0, "0.5", None), (2, None, 0.0, "-1e3", 0.5, "", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    rules = rules_by_name(df, "t", ["a", "b"], rates=True, no_personal=True, required=["hit_rate", "other_rate"])
    assert found(evaluate(df, rules)) == {
        ("non_negative", "paid_amount"): (6, 2), ("non_negative", "late_fee"): (6, 2), ("unit_range", "hit_rate"): (6, 2),
        ("unit_range", "strategy"): (6, 2), ("key_present", "a,b"): (6, 3), ("unique_key", "a,b"): (6, 3),
        ("column_present", "hit_rate"): (6, 0), ("column_present", "other_rate"): (6, 1), ("no_personal_field", "address"): (6, 1),
    }


def test_tables_without_key_rows_or_columns(spark):
    df = spark.createDataFrame([(1, "x", -1.0, "1", 2.0, None, None)] * 3, SCHEMA)
    assert found(evaluate(df, TableRules("t", non_negative=["paid_amount", "gone"]))) == {("non_negative", "paid_amount"): (3, 1 * 3)}
    assert found(evaluate(df, TableRules("t", key=["gone"]))) == {("column_present", "gone"): (3, 1)}
    assert found(evaluate(df, TableRules("t"))) == {("none", ""): (3, 0)}
    empty = evaluate(df.limit(0), TableRules("t", key=["a"], non_negative=["paid_amount"], unit_range=["hit_rate"]))
    assert set(found(empty).values()) == {(0, 0)} and len(found(empty)) == 4
    assert set(found(evaluate(df.limit(0), TableRules("t", non_negative=["paid_amount"]))).values()) == {(0, 0)}


def test_a_table_is_read_once_and_combined_before_its_shuffle(spark, tmp_path):
    spark.createDataFrame([(i % 3, "x", 1.0, "1", .5, None, None) for i in range(50)], SCHEMA).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    checked = evaluate(df, rules_by_name(df, "t", ["a"], rates=True, no_personal=True))
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Join") == 0
    assert found(checked)["unique_key", "a"] == (50, 47)


def test_references_meet_in_one_aggregate(spark):
    child = spark.createDataFrame([(1, "p"), (1, "q"), (7, "p"), (7, "p"), (None, "r"), (8, None)], "parent_id long, other string")
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    other = spark.createDataFrame([("p",), ("q",), ("r",)], "code string")
    declared = [
        Reference("child", "parent_id", "parent", "id"), Reference("child", "other", "other", "code"), Reference("other", "code", "other", "code"),
        Reference("child", "parent_id", "absent", "id"), Reference("nowhere", "x", "parent", "id"),
    ]
    df = unmet_references({"child": child, "parent": parent, "other": other}, declared[:3] + declared[4:])
    rows = {r.check_name: (r.checked, r.missing_count, r.orphan_rows) for r in df.collect()}
    assert rows == {
        "child.parent_id": (True, 3, 4), "child.other": (True, 1, 1), "other.code": (True, 0, 0), "nowhere.x": (False, None, None),
    }
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "LeftAnti" not in plan  # the one join puts the names of the references beside the counts
    # One column may refer to two tables; each reference is judged by its own.
    both = unmet_references({"child": child, "parent": parent, "wider": spark.createDataFrame([(1,), (7,), (8,)], "id long")},
                            [declared[0], Reference("child", "parent_id", "wider", "id")]).collect()
    assert sorted((r.check_name, r.missing_count) for r in both) == [("child.parent_id", 1), ("child.parent_id", 3)]
    lone = unmet_references({"child": child}, declared[3:]).collect()
    assert len(lone) == 2 and not any(r.checked for r in lone)
    assert unmet_references({"child": child.limit(0), "parent": parent}, declared[:1]).first().missing_count == 0
