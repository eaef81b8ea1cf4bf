"""Queries over traces."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window, functions as F

from queries.bindings import (
    CASES, CUT, E, E_DECISIONS, EP, L, L_DECISIONS, L_KEY, LD, LP, O, OFFER, STATICS,
    log_e, log_l, log_lo, measured, micros, order_cases, with_,
)
from queries.registry import query
from tracemill.operators import trace as T

KEYS = "case_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("T01_activity_token", with_(L) + f"SELECT {KEYS}, activity || '+' || lifecycle AS act_token FROM l")
def activity_token(spark, sf):
    df, spec = log_l(spark, sf)
    return T.activity_token(df, spec, "act_token").select(*L_KEY, "act_token")


@query("T02_filter_lifecycle", with_(L) + """
SELECT count(*) AS events_before, count(*) FILTER (WHERE lifecycle = 'F') AS events_after,
  round(count(*) FILTER (WHERE lifecycle <> 'F' OR lifecycle IS NULL) / count(*), 8) AS share_dropped FROM l""")
def filter_lifecycle(spark, sf):
    df, spec = log_l(spark, sf)
    return T.lifecycle_report(df, spec, "F").withColumn("share_dropped", F.round("share_dropped", 8))


@query("T02_filter_lifecycle_rows", with_(L) + f"SELECT {KEYS}, token FROM l WHERE lifecycle = 'F'")
def filter_lifecycle_rows(spark, sf):
    df, spec = log_l(spark, sf)
    return T.filter_lifecycle(df, spec, "F").select(*L_KEY, "token")


@query("T03_dropped_labels", with_(E, EP) + """
, t AS (SELECT case_id || '/' || activity AS activity, amount FROM e)
SELECT activity, count(*) AS events_before FROM t GROUP BY activity
HAVING count(*) FILTER (WHERE amount >= 20) = 0""")
def dropped_labels(spark, sf):
    df, spec = log_e(spark, sf)
    df = df.withColumn("activity", F.concat_ws("/", "case_id", "activity"))
    return T.dropped_labels(df, spec, F.col("amount") >= 20)


@query("T04_event_position", with_(L, LP) + f"""
SELECT {KEYS}, pos, count(*) OVER (PARTITION BY case_id) AS trace_len,
  round((pos + 1) / count(*) OVER (PARTITION BY case_id), 8) AS rel_pos FROM lp""")
def event_position(spark, sf):
    df, spec = log_l(spark, sf)
    out = T.event_position(df, spec)
    return out.select(*L_KEY, "pos", "trace_len", F.round("rel_pos", 8).alias("rel_pos"))


@query("T05_outcome_table", with_(L, LP, LD) + """
SELECT case_id, max(token) FILTER (WHERE pos = dpos) AS outcome_event,
  max(epoch_us(ts)) FILTER (WHERE pos = dpos) AS outcome_us, max(dpos) AS outcome_pos,
  max(lifecycle) FILTER (WHERE pos = dpos) AS outcome_lifecycle,
  max(cls) FILTER (WHERE pos = dpos) AS outcome,
  count(*) AS n_decisions, count(DISTINCT token) AS n_distinct_decisions
FROM ld WHERE cls IS NOT NULL GROUP BY case_id""")
def outcome_table(spark, sf):
    df, spec = log_l(spark, sf)
    out = T.outcome_table(df, spec, L_DECISIONS, "token")
    return out.withColumn("outcome_us", micros("outcome_time")).drop("outcome_time")


@query("T05_outcome_table_events", with_(E, EP) + """
, d AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS rn,
  count(*) OVER (PARTITION BY case_id) AS n_decisions FROM ep WHERE cls IS NOT NULL)
SELECT d.case_id, activity AS outcome_event, pos AS outcome_pos, cls AS outcome, n_decisions,
  n AS n_distinct_decisions
FROM d JOIN (SELECT case_id, count(DISTINCT activity) AS n FROM d GROUP BY case_id) c ON c.case_id = d.case_id
WHERE rn = 1""")
def outcome_table_events(spark, sf):
    df, spec = log_e(spark, sf)
    return T.outcome_table(df, spec, E_DECISIONS).drop("outcome_time", "outcome_lifecycle")


@query("T06_decision_lifecycles", with_(L) + """
SELECT activity, count(DISTINCT lifecycle) AS n_lifecycles FROM l WHERE activity IN ('R', 'A', 'N')
GROUP BY activity HAVING count(DISTINCT lifecycle) > 1""")
def decision_lifecycles(spark, sf):
    df, spec = log_l(spark, sf)
    return T.decision_lifecycles(df, spec, ["R", "A", "N"])


@query("T07_cut_at_decision", with_(CUT) + f"SELECT {KEYS}, token, epoch_us(ts) AS us FROM lc")
def cut_at_decision(spark, sf):
    df, spec = log_l(spark, sf)
    return T.cut_at_decision(df, spec, L_DECISIONS, "token").select(*L_KEY, "token", micros("ts").alias("us"))


@query("T08_cut_report", with_(L, LP, LD) + """
, c AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE pos > dpos) AS removed,
  count(cls) AS d, count(DISTINCT CASE WHEN cls IS NOT NULL THEN token END) AS dd FROM ld GROUP BY case_id)
SELECT count(*) FILTER (WHERE d > 0) AS cases_with_outcome,
  count(*) FILTER (WHERE d > 1) AS cases_with_multiple_outcome_events,
  count(*) FILTER (WHERE dd > 1) AS cases_with_multiple_distinct_outcomes,
  CAST(sum(n) AS BIGINT) AS events_before_cut, CAST(sum(n) - sum(removed) AS BIGINT) AS events_after_cut,
  CAST(sum(removed) AS BIGINT) AS events_removed,
  round(CASE WHEN sum(n) FILTER (WHERE d > 0) IS NULL THEN 0.0
    ELSE CAST(sum(removed) AS DOUBLE) / sum(n) FILTER (WHERE d > 0) END, 8) AS share_removed FROM c""")
def cut_report(spark, sf):
    df, spec = log_l(spark, sf)
    return T.cut_report(df, spec, L_DECISIONS, "token").withColumn("share_removed", F.round("share_removed", 8))


@query("T09_validate_cut", with_(CUT) + """
, n AS (SELECT *, coalesce(lead(token) OVER (PARTITION BY case_id ORDER BY pos), '[END]') AS nxt,
  max(pos) OVER (PARTITION BY case_id) AS mp FROM lc)
SELECT count(DISTINCT case_id) AS cases, count(*) FILTER (WHERE pos > dpos) AS events_after_decision,
  count(*) FILTER (WHERE pos = mp AND nxt <> '[END]') AS cases_without_end FROM n""")
def validate_cut(spark, sf):
    df, spec = log_l(spark, sf)
    cut = T.next_activity(T.cut_at_decision(df, spec, L_DECISIONS, "token"), spec, "token")
    return T.validate_cut(cut, spec, L_DECISIONS, "next_token", "token")


@query("T10_next_activity", with_(CUT) + f"""
SELECT {KEYS}, token, coalesce(lead(token) OVER (PARTITION BY case_id ORDER BY pos), '[END]') AS next_token FROM lc""")
def next_activity(spark, sf):
    df, spec = log_l(spark, sf)
    cut = T.cut_at_decision(df, spec, L_DECISIONS, "token")
    return T.next_activity(cut, spec, "token").select(*L_KEY, "token", "next_token")


@query("T11_remaining_time", with_(CUT) + f"""
SELECT {KEYS}, (max(epoch_us(ts)) OVER (PARTITION BY case_id) - epoch_us(ts)) / 1e6 AS remaining_seconds,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY case_id)) / 1e6 AS elapsed_seconds FROM lc""")
def remaining_time(spark, sf):
    df, spec = log_l(spark, sf)
    cut = T.cut_at_decision(df, spec, L_DECISIONS, "token")
    return T.remaining_and_elapsed(cut, spec).select(*L_KEY, "remaining_seconds", "elapsed_seconds")


@query("T12_time_since_previous", with_(E) + """
SELECT case_id, seq, round(coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY case_id ORDER BY ts, seq)) / 1e6, 0.0), 6)
  AS since_previous FROM e""")
def time_since_previous(spark, sf):
    df, spec = log_e(spark, sf)
    out = T.time_since_previous(df, spec)
    return out.select("case_id", "seq", F.round("since_previous", 6).alias("since_previous"))


@query("T12_negative_gaps", with_(L, LP) + """
, g AS (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY case_id ORDER BY l_partkey, pos)) / 1e6 AS gap FROM lp)
SELECT count(*) FILTER (WHERE gap < 0) AS negative_gaps, coalesce(least(min(gap), 0.0), 0.0) AS smallest_gap FROM g""")
def negative_gaps(spark, sf):
    """Order lines taken by part instead of by date: the guard counts the falls."""
    df, spec = log_l(spark, sf)
    part_order = replace(spec, ts="l_partkey", ties=("ts", *[c for c in spec.ties if c != "l_partkey"]))
    by_part = T.event_position(df, measured(spark, sf, "L by part", df, part_order))
    return T.negative_gaps(T.time_since_previous(by_part, spec, index="pos"))


@query("T13_calendar_cycle", with_(E) + """
SELECT seq, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 8) + 0.0 AS weekday_sin,
  round(cos(2 * pi() * (isodow(ts) - 1) / 7), 8) + 0.0 AS weekday_cos,
  round(sin(2 * pi() * hour(ts) / 24), 8) + 0.0 AS hour_sin,
  round(cos(2 * pi() * hour(ts) / 24), 8) + 0.0 AS hour_cos FROM e""")
def calendar_cycle(spark, sf):
    df, spec = log_e(spark, sf)
    out = T.calendar_cycle(df, spec)
    names = ["weekday_sin", "weekday_cos", "hour_sin", "hour_cos"]
    return out.select("seq", *[(F.round(c, 8) + 0.0).alias(c) for c in names])


@query("T14_case_metadata", with_(CASES) + """
SELECT case_id, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us, n_events, amount, goal, type,
  outcome, outcome_event, outcome IS NOT NULL AS has_terminal FROM cases""")
def case_metadata(spark, sf):
    df, spec = log_lo(spark, sf)
    return T.case_table(df, spec, STATICS, L_DECISIONS, "token").withColumns(
        {"start_us": micros("start_time"), "end_us": micros("end_time")}
    ).drop("start_time", "end_time")


@query("T14_first_present_attribute", with_(L, LP) + """
SELECT case_id, epoch_us(min(ts)) AS start_us, count(*) AS n_events,
  arg_min(credit, pos) FILTER (WHERE credit IS NOT NULL) AS first_credit,
  arg_min(offered, pos) FILTER (WHERE offered IS NOT NULL) AS first_offered FROM lp GROUP BY case_id""")
def first_present_attribute(spark, sf):
    df, spec = log_l(spark, sf)
    meta = T.case_metadata(df, spec, {"first_credit": "credit", "first_offered": "offered"})
    return meta.withColumn("start_us", micros("start_time")).drop("start_time", "end_time")


@query("T15_drop_truncated", with_(CASES) + """
SELECT count(*) AS cases_before, count(*) FILTER (WHERE outcome IS NULL) AS cases_truncated,
  count(*) FILTER (WHERE outcome IS NOT NULL) AS cases_kept,
  count(*) FILTER (WHERE outcome IS NOT NULL AND amount = 0) AS zero_amount_kept,
  count(*) FILTER (WHERE outcome = 0) AS cancelled_kept FROM cases""")
def drop_truncated(spark, sf):
    df, spec = log_lo(spark, sf)
    return T.truncated_report(T.case_table(df, spec, STATICS, L_DECISIONS, "token"))


@query("T15_cases_without_events", f"""WITH {O}
SELECT case_id, amount, goal FROM o WHERE case_id NOT IN (SELECT l_orderkey FROM lineitem)""")
def cases_without_events(spark, sf):
    df, _ = log_l(spark, sf)
    return order_cases(spark, sf).join(df.select("case_id"), "case_id", "left_anti").select("case_id", "amount", "goal")


@query("T16_attach_case_label", with_(CASES) + f"""
SELECT lc.case_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, d.outcome
FROM lc JOIN decided d ON d.case_id = lc.case_id""")
def attach_case_label(spark, sf):
    df, spec = log_lo(spark, sf)
    meta = T.drop_truncated(T.case_table(df, spec, STATICS, L_DECISIONS, "token"))
    cut = T.cut_at_decision(log_l(spark, sf)[0], spec, L_DECISIONS, "token")
    return T.attach_case_label(cut, spec, meta).select(*L_KEY, "outcome")


@query("T17_zero_as_missing", with_(L) + f"SELECT {KEYS}, nullif(credit, 0) AS credit FROM l")
def zero_as_missing(spark, sf):
    df, _ = log_l(spark, sf)
    return T.zero_as_missing(df, "credit").select(*L_KEY, "credit")


@query("T18_any_present_mask", with_(L) + f"""
SELECT {KEYS}, CASE WHEN nullif(credit, 0) IS NOT NULL OR offered IS NOT NULL THEN 1 ELSE 0 END AS present, 0 AS nothing FROM l""")
def any_present_mask(spark, sf):
    df, _ = log_l(spark, sf)
    out = T.any_present_mask(T.zero_as_missing(df, "credit"), ["credit", "offered"])
    return T.any_present_mask(out, [], "nothing").select(*L_KEY, "present", "nothing")


@query("T19_carry_state", with_(L, LP) + f"""
, m AS (SELECT *, last_value(CASE WHEN activity = 'N' THEN pos END IGNORE NULLS) OVER
  (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spos FROM lp)
SELECT m.case_id, m.l_linenumber, m.l_partkey, m.l_suppkey, m.l_extendedprice,
  CASE WHEN s.pos IS NULL THEN 0 ELSE 1 END AS state_present,
  coalesce(nullif(s.credit, 0), 0.0) AS state_credit, coalesce(s.cost, 0.0) AS state_cost, coalesce(s.offered, 0.0) AS state_offered
FROM m LEFT JOIN lp s ON s.case_id = m.case_id AND s.pos = m.spos""")
def carry_state(spark, sf):
    df, spec = log_l(spark, sf)
    df = T.any_present_mask(T.zero_as_missing(df, "credit"), OFFER)
    out = T.carry_state(df, spec, "present", OFFER)
    return out.select(*L_KEY, "state_present", *[f"state_{c}" for c in OFFER])


@query("T20_check_events", with_(E) + """
, x AS (SELECT seq, k, amount, lag(k) OVER (PARTITION BY resource, case_id ORDER BY ts, seq) AS prev,
  CASE activity WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 WHEN 'signup' THEN 0 WHEN 'view' THEN 3 END AS outcome FROM e)
SELECT 'index_not_monotonic' AS rule, count(*) FILTER (WHERE prev > k) AS violations FROM x
UNION ALL SELECT 'outcome_missing', count(*) FILTER (WHERE outcome IS NULL) FROM x
UNION ALL SELECT 'outcome_unknown', count(*) FILTER (WHERE outcome NOT IN (0, 1, 2)) FROM x""")
def check_events(spark, sf):
    df, spec = log_e(spark, sf)
    marked = df.withColumn("outcome", T.decision_class("activity", {**E_DECISIONS, "view": 3}))
    return T.check_events(marked, ["resource", "case_id"], "k", "outcome", ["case_id", "k", "outcome"], spec)


@query("T20_monotonic_offenders", with_(E) + """
, x AS (SELECT case_id, k, lag(k) OVER (PARTITION BY case_id ORDER BY ts, seq) AS prev FROM e)
SELECT DISTINCT case_id FROM x WHERE prev > k ORDER BY case_id LIMIT 10""")
def monotonic_offenders(spark, sf):
    df, spec = log_e(spark, sf)
    return T.monotonic_offenders(df, ["case_id"], "k", spec)


@query("decision_profile", with_(CUT) + """
, n AS (SELECT lc.*, (max(epoch_us(ts)) OVER (PARTITION BY case_id) - epoch_us(ts)) / 1e6 AS rem FROM lc WHERE dpos IS NOT NULL),
c AS (SELECT case_id, max(cls) FILTER (WHERE pos = dpos) AS outcome, count(*) AS n_events, sum(rem) AS rem FROM n GROUP BY case_id)
SELECT outcome, count(*) AS n_cases, CAST(sum(n_events) AS BIGINT) AS n_events,
  round(count(*) / (sum(count(*)) OVER ()), 8) AS case_share,
  round(sum(rem) / sum(n_events), 3) AS mean_remaining_seconds FROM c GROUP BY outcome""")
def decision_profile(spark, sf):
    """Flagship: cases, share and mean remaining time per decision class."""
    df, spec = log_l(spark, sf)
    key = spec.order_key()
    cut = T.remaining_and_elapsed(T.cut_at_decision(df, spec, L_DECISIONS, "token"), spec)
    is_decision = F.col("token").isin(*L_DECISIONS)
    per_case = cut.groupBy("case_id").agg(
        F.max_by("token", F.when(is_decision, key)).alias("label"),
        F.count(F.lit(1)).alias("n_events"),
        F.sum("remaining_seconds").alias("rem"),
    ).filter("label is not null").withColumn("outcome", T.decision_class("label", L_DECISIONS))
    out = per_case.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("n_events").alias("n_events"), F.sum("rem").alias("rem")
    )
    return out.select(
        "outcome", "n_cases", "n_events",
        # One row per decision class.
        F.round(F.col("n_cases") / F.sum("n_cases").over(Window.partitionBy()), 8).alias("case_share"),
        F.round(F.col("rem") / F.col("n_events"), 3).alias("mean_remaining_seconds"),
    )
