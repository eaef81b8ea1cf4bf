"""Queries that profile a log or its cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.bindings import (
    CASES, CUT, E, E_DECISIONS, EP, L, L_DECISIONS, LP, O, OFFER, ORD, STATICS,
    log_e, log_l, log_lo, micros, order_cases, with_,
)
from queries.registry import query
from tracemill.functions.quantiles import describe
from tracemill.operators import profile as Q
from tracemill.operators import trace as T
from tracemill.session import settle


def rounded(df, digits=6, **special):
    """Round every floating column of a result."""
    cols = []
    for f in df.schema:
        d = special.get(f.name, digits)
        cols.append(F.round(f.name, d).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name))
    return df.select(*cols)


def cases_l(spark, sf):
    df, spec = log_lo(spark, sf)
    return T.case_table(df, spec, STATICS, L_DECISIONS, "token")


# SQL text of the usual distribution columns.
def dist(x: str, d: int = 6, std: bool = True) -> str:
    s = f"round(stddev_samp({x}), {d}) AS std, " if std else ""
    return (
        f"count({x}) AS n, round(avg({x}), {d}) AS mean, {s}round(min({x}) + 0.0, {d}) AS min, "
        f"round(quantile_cont({x}, 0.25), {d}) AS p25, round(quantile_cont({x}, 0.5), {d}) AS p50, "
        f"round(quantile_cont({x}, 0.75), {d}) AS p75, round(max({x}) + 0.0, {d}) AS max"
    )


@query("Q01_log_overview", with_(E) + """
SELECT count(DISTINCT case_id) AS cases, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
  7 AS n_columns, count(DISTINCT activity) AS activities, count(DISTINCT resource) AS resources FROM e""")
def log_overview(spark, sf):
    df, spec = log_e(spark, sf)
    out = Q.log_overview(df, spec, "resource")
    return out.withColumns({"first_us": micros("first_ts"), "last_us": micros("last_ts")}).drop("first_ts", "last_ts")


@query("Q02_null_profile", with_(L) + """
SELECT 'credit' AS column_name, count(*) FILTER (WHERE credit IS NULL) AS nulls, round(count(*) FILTER (WHERE credit IS NULL) / count(*), 8) AS null_share FROM l
UNION ALL SELECT 'cost', count(*) FILTER (WHERE cost IS NULL), round(count(*) FILTER (WHERE cost IS NULL) / count(*), 8) FROM l
UNION ALL SELECT 'offered', count(*) FILTER (WHERE offered IS NULL), round(count(*) FILTER (WHERE offered IS NULL) / count(*), 8) FROM l
UNION ALL SELECT 'activity', count(*) FILTER (WHERE activity IS NULL), round(count(*) FILTER (WHERE activity IS NULL) / count(*), 8) FROM l""")
def null_profile(spark, sf):
    df, _ = log_l(spark, sf)
    return rounded(Q.null_profile(df, [*OFFER, "activity"]), 8)


@query("Q03_describe", with_(O) + f"SELECT {dist('amount', 4)} FROM o")
def describe_amount(spark, sf):
    return rounded(describe(order_cases(spark, sf), F.col("amount")), 4)


@query("Q03_describe_by_activity", with_(L) + f"SELECT activity, {dist('l_extendedprice', 3)} FROM l GROUP BY activity")
def describe_by_activity(spark, sf):
    df, _ = log_l(spark, sf)
    return rounded(describe(df, F.col("l_extendedprice"), ["activity"]), 3)


@query("Q03_value_counts", with_(L) + "SELECT offered, count(*) AS n FROM l WHERE offered IS NOT NULL GROUP BY offered")
def value_counts(spark, sf):
    return Q.value_counts(log_l(spark, sf)[0], "offered").orderBy(F.desc("n"), "offered")


@query("Q04_attribute_stability", with_(L) + """
, c AS (SELECT case_id, count(DISTINCT cost) + max(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) > 1 AS changing FROM l GROUP BY case_id)
SELECT count(*) AS cases, count(*) FILTER (WHERE changing) AS changing_cases,
  round(count(*) FILTER (WHERE changing) / count(*), 8) AS changing_share FROM c""")
def attribute_stability(spark, sf):
    df, spec = log_l(spark, sf)
    return rounded(Q.attribute_stability(df, spec, "cost"), 8)


@query("Q04_attribute_history", with_(L) + """
, c AS (SELECT case_id FROM l GROUP BY case_id
  HAVING count(DISTINCT cost) + max(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) > 1 ORDER BY case_id LIMIT 10)
SELECT DISTINCT case_id, epoch_us(ts) AS us, cost FROM l WHERE case_id IN (SELECT case_id FROM c)""")
def attribute_history(spark, sf):
    df, spec = log_l(spark, sf)
    return Q.attribute_history(df, spec, "cost").select("case_id", micros("ts").alias("us"), "cost")


_CD = """, c AS (SELECT case_id, count(cls) AS d, count(DISTINCT CASE WHEN cls IS NOT NULL THEN activity END) AS dd,
  arg_max(cls, pos) FILTER (WHERE cls IS NOT NULL) AS outcome, max(ts) AS last_ts FROM ep GROUP BY case_id) """


@query("Q05_decision_ambiguity", with_(E, EP) + _CD + """
SELECT count(*) FILTER (WHERE d > 1) AS several_events, count(*) FILTER (WHERE dd > 1) AS several_labels,
  count(*) FILTER (WHERE outcome = 0) AS class_0, count(*) FILTER (WHERE outcome = 1) AS class_1,
  count(*) FILTER (WHERE outcome = 2) AS class_2, count(outcome) AS decided,
  count(*) FILTER (WHERE outcome IS NULL) AS undecided FROM c""")
def decision_ambiguity(spark, sf):
    df, spec = log_e(spark, sf)
    return Q.decision_ambiguity(df, spec, E_DECISIONS, "activity")


@query("Q06_undecided_last_seen", with_(E, EP) + _CD
       + f", x AS (SELECT epoch_us(last_ts) / 1e6 AS s FROM c WHERE outcome IS NULL) SELECT {dist('s', 3, std=False)} FROM x")
def undecided_last_seen(spark, sf):
    df, spec = log_e(spark, sf)
    return rounded(Q.undecided_last_seen(df, spec, E_DECISIONS, "activity"), 3)


_TERM = """, p AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS len FROM ep),
t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS rn FROM p WHERE activity IN ('purchase', 'error', 'signup')),
f AS (SELECT case_id, activity AS terminal, pos, len, ts, seq FROM t WHERE rn = 1) """


@query("Q07_terminal_position", with_(E, EP) + _TERM + """
SELECT terminal, count(*) AS n_cases, round(avg(pos + 1), 6) AS mean_pos, round(avg(len), 6) AS mean_len,
  round(avg((pos + 1) / len), 6) AS mean_rel_pos FROM f GROUP BY terminal""")
def terminal_position(spark, sf):
    df, spec = log_e(spark, sf)
    return rounded(Q.terminal_position(df, spec, list(E_DECISIONS)))


@query("Q08_presence_by_terminal", with_(E, EP) + _TERM + """
, h AS (SELECT case_id, bool_or(activity = 'view') AS has FROM e GROUP BY case_id)
SELECT terminal, count(*) AS n_cases, count(*) FILTER (WHERE has) AS n_with,
  round(avg(CASE WHEN has THEN 1 ELSE 0 END), 6) AS share_with FROM f JOIN h ON h.case_id = f.case_id GROUP BY terminal""")
def presence_by_terminal(spark, sf):
    df, spec = log_e(spark, sf)
    return rounded(Q.presence_by_terminal(df, spec, list(E_DECISIONS), ["view"]))


@query("Q09_activity_by_terminal", with_(E, EP) + _TERM + """
SELECT terminal, count(*) FILTER (WHERE e.activity = 'view') AS n_view, count(*) FILTER (WHERE e.activity = 'click') AS n_click
FROM f JOIN e ON e.case_id = f.case_id GROUP BY terminal""")
def activity_by_terminal(spark, sf):
    df, spec = log_e(spark, sf)
    return Q.activity_by_terminal(df, spec, list(E_DECISIONS), ["view", "click"])


@query("Q10_relative_order", with_(E, EP) + _TERM + """
SELECT terminal, ep.activity, count(*) FILTER (WHERE ep.pos < f.pos) AS before, count(*) FILTER (WHERE ep.pos = f.pos) AS same,
  count(*) FILTER (WHERE ep.pos > f.pos) AS after
FROM ep JOIN f ON ep.case_id = f.case_id WHERE ep.activity IN ('view', 'click', 'error') GROUP BY terminal, ep.activity""")
def relative_order(spark, sf):
    df, spec = log_e(spark, sf)
    return Q.relative_order(df, spec, list(E_DECISIONS), ["view", "click", "error"])


@query("Q11_activity_frequency", with_(L) + "SELECT token, count(*) AS n FROM l GROUP BY token")
def activity_frequency(spark, sf):
    return Q.value_counts(log_l(spark, sf)[0], "token").orderBy(F.desc("n"), "token")


@query("Q11_prefix_crosstab", with_(O) + """
SELECT regexp_extract(goal, '^([0-9])-', 1) AS prefix, count(*) FILTER (WHERE type = 'F') AS "n_F",
  count(*) FILTER (WHERE type = 'O') AS "n_O", count(*) FILTER (WHERE type = 'P') AS "n_P" FROM o GROUP BY 1""")
def prefix_crosstab(spark, sf):
    return Q.prefix_crosstab(order_cases(spark, sf), "goal", r"^([0-9])-", "type", ["F", "O", "P"])


_DUR = """, c AS (SELECT case_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 86400.0 AS days FROM {} GROUP BY case_id) """


@query("Q12_case_duration", with_(L) + _DUR.format("l") + """
SELECT count(*) AS n, round(avg(days), 6) AS mean, round(quantile_cont(days, 0.5), 6) AS median,
  round(quantile_cont(days, 0.95), 6) AS p95, round(quantile_cont(days, 0.99), 6) AS p99 FROM c""")
def case_duration(spark, sf):
    df, spec = log_l(spark, sf)
    return rounded(Q.duration_summary(Q.case_duration(df, spec)))


@query("Q12_duration_histogram", with_(L) + _DUR.format("l") + """
, b AS (SELECT min(days) AS lo, quantile_cont(days, 0.99) AS hi FROM c)
, h AS (SELECT CAST(least(floor((least(days, hi) - lo) / (hi - lo) * 60), 59) AS INTEGER) AS bin, count(*) AS n FROM c, b GROUP BY 1)
SELECT CAST(x.bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(60) x(bin) LEFT JOIN h ON h.bin = x.bin""")
def duration_histogram(spark, sf):
    df, spec = log_l(spark, sf)
    return Q.duration_histogram(Q.case_duration(df, spec))


@query("Q13_prefix_cap", with_(L, LP) + """
, c AS (SELECT case_id, count(*) AS n, max(CASE WHEN cls IS NOT NULL THEN pos END) + 1 AS dl FROM lp GROUP BY case_id),
q AS (SELECT avg(n) AS mean_len, max(n) AS max_len, quantile_cont(n, 0.98) AS q_len FROM c),
g AS (SELECT *, CAST(floor(q_len) AS BIGINT) AS cap FROM q)
SELECT round(max(mean_len), 6) AS mean_len, max(max_len) AS max_len, max(q_len) AS q_len, max(cap) AS cap,
  count(*) FILTER (WHERE dl > cap) AS beyond, round(count(*) FILTER (WHERE dl > cap) / count(dl), 8) AS beyond_share,
  coalesce(max(dl - cap) FILTER (WHERE dl > cap), 0) AS max_gap,
  round(coalesce(avg(dl - cap) FILTER (WHERE dl > cap), 0.0), 6) AS mean_gap,
  coalesce(max(dl) FILTER (WHERE dl > cap), max(cap)) AS longest FROM c, g""")
def prefix_cap(spark, sf):
    df, spec = log_l(spark, sf)
    return rounded(Q.prefix_cap(df, spec, L_DECISIONS, "token"), beyond_share=8)


@query("Q14_quantile_table", with_(O) + """
SELECT min(amount) AS min, max(amount) AS max, round(avg(amount), 4) AS mean, round(quantile_cont(amount, 0.10), 4) AS p10,
  round(quantile_cont(amount, 0.25), 4) AS p25, round(quantile_cont(amount, 0.5), 4) AS p50,
  round(quantile_cont(amount, 0.75), 4) AS p75, round(quantile_cont(amount, 0.9), 4) AS p90 FROM o""")
def quantile_table(spark, sf):
    probs = {"p10": 0.10, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return rounded(Q.quantile_table(order_cases(spark, sf), "amount", probs), 4)


BAND = """, qe AS (SELECT quantile_cont(amount, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS edges FROM decided WHERE amount > 0),
banded AS (SELECT d.*, CAST(len(list_filter(list_distinct(edges), lambda x: x < amount AND x > edges[1])) AS INTEGER) AS band
  FROM decided d, qe WHERE amount > 0) """


@query("Q15_rate_by_band", with_(CASES) + BAND + """
SELECT band, count(*) AS total, count(*) FILTER (WHERE outcome = 2) AS approved, min(amount) AS amount_min,
  max(amount) AS amount_max, round(count(*) FILTER (WHERE outcome = 2) / count(*), 8) AS rate,
  round(CAST(sum(count(*) FILTER (WHERE outcome = 2)) OVER () AS DOUBLE) / sum(count(*)) OVER (), 8) AS overall_rate
FROM banded GROUP BY band""")
def rate_by_band(spark, sf):
    cases = settle(T.drop_truncated(cases_l(spark, sf)))
    return rounded(Q.rate_by_band(cases, "amount", F.col("outcome") == 2), 8, amount_min=2, amount_max=2)


@query("Q16_zero_by_type", with_(CASES) + """
SELECT type, count(*) AS n_total, count(*) FILTER (WHERE amount = 0) AS n_zero,
  round(count(*) FILTER (WHERE amount = 0) / count(*), 8) AS zero_share,
  round(count(*) FILTER (WHERE amount = 0) / CAST(sum(count(*) FILTER (WHERE amount = 0)) OVER () AS DOUBLE), 8) AS share_of_zeros,
  round(CAST(sum(count(*) FILTER (WHERE amount = 0)) OVER () AS DOUBLE) / sum(count(*)) OVER (), 8) AS overall_zero_share
FROM cases GROUP BY type""")
def zero_by_type(spark, sf):
    return rounded(Q.zero_by_type(cases_l(spark, sf), "amount", "type"), 8)


@query("Q16_zero_outcome_shares", with_(CASES) + """
, x AS (SELECT coalesce(outcome_event, 'no_outcome') AS outcome, count(*) AS n, count(*) FILTER (WHERE amount = 0) AS z FROM cases GROUP BY 1)
SELECT outcome, round(CASE WHEN z > 0 THEN z / CAST(sum(z) OVER () AS DOUBLE) END, 8) AS zero_share,
  round(n / CAST(sum(n) OVER () AS DOUBLE), 8) AS all_share FROM x""")
def zero_outcome_shares(spark, sf):
    return rounded(Q.zero_outcome_shares(cases_l(spark, sf), "amount", "outcome_event"), 8)


@query("Q16_zero_outcome_by_type", with_(CASES) + """
, x AS (SELECT type, coalesce(outcome_event, 'no_outcome') AS oc FROM cases WHERE amount = 0)
SELECT type, round(avg(CASE WHEN oc = 'R+O' THEN 1 ELSE 0 END), 8) AS "share_R+O", round(avg(CASE WHEN oc = 'A+F' THEN 1 ELSE 0 END), 8) AS "share_A+F",
  round(avg(CASE WHEN oc = 'N+F' THEN 1 ELSE 0 END), 8) AS "share_N+F", round(avg(CASE WHEN oc = 'no_outcome' THEN 1 ELSE 0 END), 8) AS share_no_outcome
FROM x GROUP BY type""")
def zero_outcome_by_type(spark, sf):
    out = Q.zero_outcome_by_type(cases_l(spark, sf), "amount", "type", "outcome_event", [*L_DECISIONS, "no_outcome"])
    return rounded(out, 8)


@query("Q17_rate_by_category", with_(CASES) + """
SELECT goal, count(*) AS total, count(*) FILTER (WHERE outcome = 2) AS approved,
  round(count(*) FILTER (WHERE outcome = 2) / count(*), 8) AS rate,
  round(CAST(sum(count(*) FILTER (WHERE outcome = 2)) OVER () AS DOUBLE) / sum(count(*)) OVER (), 8) AS overall_rate
FROM decided GROUP BY goal""")
def rate_by_category(spark, sf):
    cases = T.drop_truncated(cases_l(spark, sf))
    return rounded(Q.rate_by_category(cases, "goal", F.col("outcome") == 2), 8)


@query("Q18_first_present_position", with_(L, LP) + f"""
, c AS (SELECT case_id, min(CASE WHEN credit IS NOT NULL OR cost IS NOT NULL OR offered IS NOT NULL THEN pos END) AS x FROM lp GROUP BY case_id),
d AS (SELECT {dist('x')}, count(*) FILTER (WHERE x IS NULL) AS n_without, CAST(min(x) AS BIGINT) AS lo, CAST(max(x) AS BIGINT) AS hi FROM c)
SELECT n AS n_with, n_without, mean, std, lo AS min, p25, p50, p75, hi AS max FROM d""")
def first_present_position(spark, sf):
    df, spec = log_l(spark, sf)
    return rounded(Q.first_present_position(df, spec, OFFER))


_OCC = ", c AS (SELECT case_id, count(*) AS occurrences FROM l WHERE activity = 'N' GROUP BY case_id) "


@query("Q19_occurrences_per_case", with_(L) + _OCC + """
SELECT count(*) AS n, round(avg(occurrences), 6) AS mean, round(stddev_samp(occurrences), 6) AS std, min(occurrences) AS min,
  quantile_cont(occurrences, 0.25) AS p25, quantile_cont(occurrences, 0.5) AS p50, quantile_cont(occurrences, 0.75) AS p75,
  max(occurrences) AS max FROM c""")
def occurrences_per_case(spark, sf):
    df, spec = log_l(spark, sf)
    return rounded(Q.occurrence_summary(Q.occurrences(df, spec, "N")))


@query("Q19_occurrence_frequency", with_(L) + _OCC + """
SELECT occurrences, count(*) AS n_cases FROM c GROUP BY occurrences ORDER BY occurrences LIMIT 10""")
def occurrence_frequency(spark, sf):
    df, spec = log_l(spark, sf)
    return Q.occurrence_frequency(Q.occurrences(df, spec, "N"))


_CO = _OCC + ", co AS (SELECT o.*, coalesce(occurrences, 0) AS occurrences FROM o LEFT JOIN c ON c.case_id = o.case_id) "


def _case_occurrences(spark, sf):
    df, spec = log_l(spark, sf)
    return Q.with_occurrences(order_cases(spark, sf), Q.occurrences(df, spec, "N"), "case_id")


@query("Q20_single_or_multiple", with_(L, O) + _CO + """
SELECT CASE WHEN occurrences > 1 THEN 'multiple' ELSE 'single' END AS occurrence_group, count(amount) AS n_cases,
  round(avg(amount), 4) AS mean, round(quantile_cont(amount, 0.5), 4) AS median, round(quantile_cont(amount, 0.25), 4) AS q1,
  round(quantile_cont(amount, 0.75), 4) AS q3 FROM co WHERE occurrences >= 1 GROUP BY 1""")
def single_or_multiple(spark, sf):
    return rounded(Q.single_or_multiple(_case_occurrences(spark, sf), "amount"), 4)


@query("Q20_top_multiple_categories", with_(L, O) + _CO + """
SELECT goal, count(*) AS n_cases, round(avg(occurrences), 6) AS mean_occurrences, round(quantile_cont(amount, 0.5), 4) AS median_amount
FROM co WHERE occurrences > 1 GROUP BY goal ORDER BY n_cases DESC, goal LIMIT 10""")
def top_multiple_categories(spark, sf):
    return rounded(Q.top_multiple_categories(_case_occurrences(spark, sf), "goal", "amount"), median_amount=4)


@query("Q20_multiple_share_by_category", with_(L, O) + _CO + """
SELECT goal, count(*) AS n_cases, count(*) FILTER (WHERE occurrences > 1) AS n_multi,
  round(count(*) FILTER (WHERE occurrences > 1) / count(*), 8) AS share_multi FROM co GROUP BY goal""")
def multiple_share_by_category(spark, sf):
    return rounded(Q.multiple_share_by_category(_case_occurrences(spark, sf), "goal"), 8)


_TWO = f""", r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {ORD}) AS rn FROM l WHERE activity = 'N'),
two AS (SELECT a.case_id, a.credit AS c1, b.credit AS c2, a.cost AS k1, b.cost AS k2, a.offered AS o1, b.offered AS o2
  FROM r a JOIN r b ON a.case_id = b.case_id AND a.rn = 1 AND b.rn = 2) """


@query("Q21_first_vs_second", with_(L) + _TWO + """
, d AS (SELECT 'credit' AS attribute, nullif(c2, 0) - nullif(c1, 0) AS delta FROM two
  UNION ALL SELECT 'cost', k2 - k1 FROM two UNION ALL SELECT 'offered', o2 - o1 FROM two)
SELECT attribute, count(delta) AS comparable, count(*) FILTER (WHERE delta <> 0) AS changed,
  round(count(*) FILTER (WHERE delta <> 0) / greatest(count(delta), 1), 8) AS changed_share,
  round(quantile_cont(delta, 0.5) FILTER (WHERE delta <> 0), 6) AS median_delta,
  round(quantile_cont(abs(delta), 0.5) FILTER (WHERE delta <> 0), 6) AS median_abs_delta FROM d GROUP BY attribute""")
def first_vs_second(spark, sf):
    df, spec = log_l(spark, sf)
    return rounded(Q.first_vs_second(Q.first_two(df, spec, "N", OFFER), OFFER, ["credit"]), changed_share=8)


@query("Q22_availability_transitions", with_(L) + _TWO + """
, x AS (SELECT coalesce(c1 = 0, false) AS z1, coalesce(c2 = 0, false) AS z2,
  coalesce(k2 - k1, 0) <> 0 OR coalesce(o2 - o1, 0) <> 0 AS moved FROM two)
SELECT count(*) FILTER (WHERE z1 AND NOT z2) AS gained, count(*) FILTER (WHERE NOT z1 AND z2) AS lost,
  count(*) FILTER (WHERE z1 AND NOT z2 AND moved) AS gained_with_changes,
  count(*) FILTER (WHERE z1 AND NOT z2 AND NOT moved) AS gained_without_changes FROM x""")
def availability_transitions(spark, sf):
    df, spec = log_l(spark, sf)
    return Q.availability_transitions(Q.first_two(df, spec, "N", OFFER), "credit", ["cost", "offered"])


@query("Q23_starts_per_month", with_(L) + """
, s AS (SELECT min(ts) AS t FROM l GROUP BY case_id),
m AS (SELECT strftime(t, '%Y-%m') AS month, count(*) AS n_starts FROM s GROUP BY 1)
SELECT month, n_starts, (SELECT quantile_cont(n_starts, 0.5) FROM m) AS median_month FROM m""")
def starts_per_month(spark, sf):
    df, spec = log_l(spark, sf)
    return Q.starts_per_month(df, spec)


@query("Q24_resource_volume", with_(E) + """
, v AS (SELECT resource, count(*) AS n_events FROM e GROUP BY resource)
(SELECT resource, n_events, 'top' AS side FROM v ORDER BY n_events DESC, resource LIMIT 10)
UNION ALL (SELECT resource, n_events, 'bottom' FROM v ORDER BY n_events, resource DESC LIMIT 5)""")
def resource_volume(spark, sf):
    return Q.resource_volume(log_e(spark, sf)[0], "resource")


@query("Q24_resource_concentration", with_(E) + """
, v AS (SELECT resource, count(*) AS n FROM e GROUP BY resource),
t AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS rn FROM v)
SELECT count(*) AS resources, CAST(sum(n) AS BIGINT) AS events, CAST(0 AS DOUBLE) AS null_share, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
  min(n) AS min, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n) AS max,
  round(CAST(sum(n) FILTER (WHERE rn = 1) AS DOUBLE) / sum(n), 8) AS top1_share,
  round(CAST(sum(n) FILTER (WHERE rn <= 5) AS DOUBLE) / sum(n), 8) AS top5_share FROM t""")
def resource_concentration(spark, sf):
    return rounded(Q.resource_concentration(log_e(spark, sf)[0], "resource"), 6, top1_share=8, top5_share=8)


@query("Q25_compare_logs", with_(E, L) + """
, a AS (SELECT count(DISTINCT case_id) AS c, count(*) AS n, min(ts) AS f, max(ts) AS t, count(DISTINCT activity) AS act, count(DISTINCT l_suppkey) AS r FROM l),
b AS (SELECT count(DISTINCT case_id) AS c, count(*) AS n, min(ts) AS f, max(ts) AS t, count(DISTINCT activity) AS act, count(DISTINCT resource) AS r FROM e)
SELECT 'cases' AS metric, CAST(a.c AS VARCHAR) AS orders_log, CAST(b.c AS VARCHAR) AS users_log FROM a, b
UNION ALL SELECT 'events', CAST(a.n AS VARCHAR), CAST(b.n AS VARCHAR) FROM a, b
UNION ALL SELECT 'first_day', CAST(CAST(a.f AS DATE) AS VARCHAR), CAST(CAST(b.f AS DATE) AS VARCHAR) FROM a, b
UNION ALL SELECT 'last_day', CAST(CAST(a.t AS DATE) AS VARCHAR), CAST(CAST(b.t AS DATE) AS VARCHAR) FROM a, b
UNION ALL SELECT 'activities', CAST(a.act AS VARCHAR), CAST(b.act AS VARCHAR) FROM a, b
UNION ALL SELECT 'resources', CAST(a.r AS VARCHAR), CAST(b.r AS VARCHAR) FROM a, b""")
def compare_logs(spark, sf):
    a, sa = log_l(spark, sf)
    b, sb = log_e(spark, sf)
    return Q.compare_logs({
        "orders_log": Q.log_overview(a, sa, "l_suppkey"),
        "users_log": Q.log_overview(b, sb, "resource"),
    })


@query("Q25_outcome_alignment", with_(CUT, E, EP) + """
, a AS (SELECT max(cls) FILTER (WHERE pos = dpos) AS outcome, max(token) FILTER (WHERE pos = dpos) AS lab FROM lc WHERE dpos IS NOT NULL GROUP BY case_id),
b AS (SELECT arg_max(cls, pos) AS outcome, arg_max(activity, pos) AS lab FROM ep WHERE cls IS NOT NULL GROUP BY case_id),
ca AS (SELECT outcome, lab AS label_a, count(*) AS n_a FROM a GROUP BY 1, 2), cb AS (SELECT outcome, lab AS label_b, count(*) AS n_b FROM b GROUP BY 1, 2)
SELECT ca.outcome, label_a, label_b, n_a, n_b,
  CASE ca.outcome WHEN 2 THEN 'approved' WHEN 1 THEN 'denied' ELSE 'cancelled' END AS meaning FROM ca FULL JOIN cb ON ca.outcome = cb.outcome""")
def outcome_alignment(spark, sf):
    a, sa = log_l(spark, sf)
    b, sb = log_e(spark, sf)
    da = Q.case_decisions(a, sa, L_DECISIONS, "token").filter("outcome is not null")
    db = Q.case_decisions(b, sb, E_DECISIONS, "activity").filter("outcome is not null")
    return Q.outcome_alignment(da, db, {2: "approved", 1: "denied", 0: "cancelled"})
