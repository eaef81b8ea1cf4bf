"""Golden answers on small raw logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracemill.log import LogSpec
from tracemill.operators import profile as Q
from tracemill.operators import trace as T

DECISIONS = {"O_Accepted": 2, "A_Denied": 1, "A_Cancelled": 0}
SPEC = LogSpec()
T0 = dt.datetime(2024, 1, 1, 9, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def log_a(spark):
    rows = [
        ("c1", "A_Create", "complete", at(0), 1, 5000.0, "Car"),
        ("c1", "W_Check", "complete", at(1), 2, 5000.0, "Car"),
        ("c1", "O_Accepted", "complete", at(2), 3, 5000.0, "Car"),
        ("c1", "A_Pending", "complete", at(3), 4, 5000.0, "Car"),
        ("c2", "A_Create", "complete", at(0), 1, 0.0, None),
        ("c2", "A_Cancelled", "complete", at(5), 2, 0.0, "Boat"),
        ("c3", "A_Create", "complete", at(0), 1, 700.0, "Car"),
        ("c4", "A_Create", "complete", at(0), 1, 900.0, "Tax"),
        ("c4", "A_Cancelled", "complete", at(4), 2, 900.0, "Tax"),
        ("c4", "A_Denied", "complete", at(4), 3, 900.0, "Tax"),
    ]
    df = spark.createDataFrame(
        rows, "case_id string, activity string, lifecycle string, ts timestamp, seq int, amount double, goal string"
    )
    return T.activity_token(df, SPEC)


def test_outcomes(log_a):
    out = {r.case_id: r for r in T.outcome_table(log_a, SPEC, DECISIONS).collect()}
    assert {k: v.outcome for k, v in out.items()} == {"c1": 2, "c2": 0, "c4": 1}
    assert out["c4"].n_decisions == 2 and out["c4"].n_distinct_decisions == 2
    assert out["c1"].outcome_pos == 2 and out["c1"].outcome_lifecycle == "complete"


def test_outcomes_of_a_log_without_decisions_keep_the_schema(log_a):
    full = T.outcome_table(log_a, SPEC, DECISIONS)
    none = T.outcome_table(log_a.filter("case_id = 'c3'"), SPEC, DECISIONS)
    assert none.count() == 0 and none.schema == full.schema


def test_cut_next_and_remaining(log_a):
    cut = T.cut_at_decision(log_a, SPEC, DECISIONS)
    assert cut.count() == 9
    out = T.remaining_and_elapsed(T.next_activity(cut, SPEC, "token"), SPEC)
    c1 = out.filter("case_id = 'c1'").orderBy("seq").collect()
    assert [r.next_token for r in c1] == ["W_Check+complete", "O_Accepted+complete", "[END]"]
    assert [r.remaining_seconds for r in c1] == [120.0, 60.0, 0.0]
    assert [r.elapsed_seconds for r in c1] == [0.0, 60.0, 120.0]


def test_cut_report_and_validation(log_a):
    r = T.cut_report(log_a, SPEC, DECISIONS).first()
    assert (r.cases_with_outcome, r.cases_with_multiple_outcome_events, r.events_removed) == (3, 1, 1)
    assert r.share_removed == pytest.approx(1 / 9)
    none = T.cut_report(log_a.filter("case_id = 'c3'"), SPEC, DECISIONS).first()
    assert none.share_removed == 0.0 and none.events_after_cut == 1
    cut = T.next_activity(T.cut_at_decision(log_a, SPEC, DECISIONS), SPEC, "token")
    ok = T.validate_cut(cut, SPEC, DECISIONS, "next_token").first()
    assert (ok.cases, ok.events_after_decision, ok.cases_without_end) == (4, 0, 0)
    raw = T.next_activity(log_a, SPEC, "token")
    assert T.validate_cut(raw, SPEC, DECISIONS, "next_token").first().events_after_decision == 1


def test_case_table_equals_its_parts(log_a):
    statics = {"amount": "amount", "goal": "goal"}
    fast = T.case_table(log_a, SPEC, statics, DECISIONS)
    cut = T.cut_at_decision(log_a, SPEC, DECISIONS)
    slow = T.case_metadata(cut, SPEC, statics, T.outcome_table(log_a, SPEC, DECISIONS))
    cols = sorted(slow.columns)
    assert sorted(map(str, fast.select(*cols).collect())) == sorted(map(str, slow.select(*cols).collect()))
    # The first non-null goal is taken, not the first row's.
    assert {r.case_id: r.goal for r in fast.collect()}["c2"] == "Boat"
    kept = T.drop_truncated(fast)
    assert {r.case_id for r in kept.collect()} == {"c1", "c2", "c4"}


def test_lifecycle_filter_variant(spark):
    rows = [
        ("b1", "A_SUBMITTED", "COMPLETE", at(0), 1), ("b1", "W_Call", "START", at(1), 2),
        ("b1", "A_APPROVED", "COMPLETE", at(9.9166666), 3), ("b1", "W_After", "COMPLETE", at(12), 4),
        ("b2", "A_SUBMITTED", "COMPLETE", at(0), 1), ("b2", "A_CANCELLED", "COMPLETE", at(2), 2),
        ("b3", "A_SUBMITTED", "COMPLETE", at(0), 1),
    ]
    df = spark.createDataFrame(rows, "case_id string, activity string, lifecycle string, ts timestamp, seq int")
    d = {"A_APPROVED": 2, "A_DECLINED": 1, "A_CANCELLED": 0}
    kept = T.filter_lifecycle(df, SPEC, "COMPLETE")
    assert T.lifecycle_report(df, SPEC, "COMPLETE").first().share_dropped == pytest.approx(1 / 7)
    assert [r.activity for r in T.dropped_labels(df, SPEC, F.col("lifecycle") == "COMPLETE").collect()] == ["W_Call"]
    out = T.outcome_table(kept, SPEC, d)
    assert {r.case_id: r.outcome for r in out.collect()} == {"b1": 2, "b2": 0}
    assert T.cut_report(kept, SPEC, d).first().events_removed == 1


def test_carry_state_resets_as_a_unit(spark):
    rows = [("x", i, i, m, a, b) for i, (m, a, b) in enumerate(
        [(0, None, None), (1, 5.0, 2.0), (0, None, None), (1, None, 3.0), (0, 9.0, 9.0)])]
    df = spark.createDataFrame(rows, "case_id string, t long, seq int, m int, a double, b double").withColumn("ts", F.timestamp_seconds("t"))
    out = T.carry_state(df, LogSpec(activity="m", lifecycle=None), "m", ["a", "b"]).orderBy("seq").collect()
    assert [(r.state_present, r.state_a, r.state_b) for r in out] == [(0, 0, 0), (1, 5, 2), (1, 5, 2), (1, 0, 3), (1, 0, 3)]


def test_zero_missing_mask_and_calendar(spark):
    df = spark.createDataFrame([(0.0, None), (3.0, None), (None, 1.0)], "s double, c double")
    out = T.any_present_mask(T.zero_as_missing(df, "s"), ["s", "c"]).collect()
    assert [r.present for r in out] == [0, 1, 1]
    monday = spark.createDataFrame([(dt.datetime(2024, 1, 1, 6),)], "ts timestamp")
    r = T.calendar_cycle(monday, SPEC).first()
    assert (r.weekday_sin, r.weekday_cos) == pytest.approx((0.0, 1.0))
    assert (r.hour_sin, r.hour_cos) == pytest.approx((1.0, 0.0))


def test_checks_report_violations(log_a):
    df = log_a.withColumn("outcome", F.when(F.col("case_id") != "c3", 7))
    got = {r.rule: r.violations for r in T.check_events(df, ["case_id"], "seq", "outcome", ["case_id"], SPEC).collect()}
    assert got == {"index_not_monotonic": 0, "outcome_missing": 1, "outcome_unknown": 9}
    with pytest.raises(ValueError, match="missing required"):
        T.check_events(df, ["case_id"], "seq", "outcome", ["nowhere"], SPEC)


def test_attribute_stability_counts_null_as_a_value(log_a):
    r = Q.attribute_stability(log_a, SPEC, "goal").first()
    assert (r.cases, r.changing_cases) == (4, 1)
    assert {x.case_id for x in Q.attribute_history(log_a, SPEC, "goal").collect()} == {"c2"}


def test_prefix_cap_of_a_log_within_the_cap(log_a):
    r = Q.prefix_cap(log_a, SPEC, DECISIONS, "activity", q=1.0).first()
    assert (r.cap, r.beyond, r.max_gap, r.longest) == (4, 0, 0, 4)
