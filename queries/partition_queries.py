"""Queries that partition cases over banks, with the layouts as SQL text."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from queries.bindings import CASES, L_DECISIONS, L_KEY, data_key, log_l, with_
from queries.profile_queries import cases_l, rounded
from queries.registry import query
from tracemill.operators import partition as P
from tracemill.operators import trace as T
from tracemill.plans.partitioning import AMOUNT_ONLY, WITH_GOALS, amount_split, layouts, partition, run_records
from tracemill.session import fine_shuffles, settle

DESIGN = replace(
    WITH_GOALS,
    high_goals=("1-URGENT",), low_goals=("5-LOW", "4-NOT SPECIFIED"),
    specialists={"D": "2-HIGH", "E": "3-MEDIUM"},
)
CONFIGS = [("iid", 3), ("weak", 3), ("medium", 3), ("strong", 3), ("medium", 5), ("strong", 5)]
NAMES = [f"{s}_{k}banks" for s, k in CONFIGS]
GROUPS = {
    "High rate": ["1-URGENT"], "Low rate": ["5-LOW", "4-NOT SPECIFIED"],
    "Bank D only": ["2-HIGH"], "Bank E only": ["3-MEDIUM"],
}

_DECIDED: dict[tuple, object] = {}


def decided(spark, sf):
    """Decided cases of the order-line log, settled once per session: layouts read them many times."""
    key = data_key(spark, sf)
    if key not in _DECIDED:
        with fine_shuffles(spark):
            _DECIDED[key] = settle(T.drop_truncated(cases_l(spark, sf)))
    return _DECIDED[key]


# --- the same layouts as SQL ------------------------------------------------------------------

def _hash(salt: str) -> str:
    return f"md5(concat_ws('|', '42', '{salt}', CAST(case_id AS VARCHAR)))"


def _band(p: str, src: str) -> str:
    return (
        f"{p}e AS (SELECT quantile_cont(amount, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS edges FROM {src} WHERE amount > 0), "
        f"{p}b AS (SELECT s.*, CAST(len(list_filter(list_distinct(edges), lambda x: x < amount AND x > edges[1])) AS INTEGER) AS band "
        f"FROM {src} s, {p}e WHERE amount > 0)"
    )


def _even(src: str, k: int, salt: str) -> str:
    return f"SELECT case_id, chr(CAST(64 + ntile({k}) OVER (ORDER BY {_hash(salt)}, case_id) AS INTEGER)) AS bank FROM {src}"


def _weighted(p: str, weights) -> str:
    def cut(two: bool) -> str:
        whens = " ".join(
            f"WHEN {i} THEN CAST({(w[0] + w[1]) if two else w[0]!r} AS DOUBLE)" for i, w in enumerate(weights)
        )
        return f"round_even((CASE band {whens} END) * n, 0)"

    return (
        f"{p}r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {_hash('skew')}, case_id) - 1 AS r, "
        f"count(*) OVER (PARTITION BY band) AS n FROM {p}b), "
        f"{p}w AS (SELECT case_id, amount, goal, CASE WHEN r < {cut(False)} THEN 'A' WHEN r < {cut(True)} THEN 'B' ELSE 'C' END AS bank FROM {p}r)"
    )


def _zero(src: str, mode: str) -> str:
    zero = f"(SELECT case_id FROM {src} WHERE amount = 0)"
    if mode == "even":
        return _even(zero, 3, "zero")
    if mode == "first":
        return f"SELECT case_id, 'A' AS bank FROM {zero}"
    return (
        f"SELECT case_id, CASE WHEN r < round_even(n * CAST(0.5 AS DOUBLE), 0) THEN 'A' "
        f"WHEN r < round_even(n * CAST(0.5 AS DOUBLE), 0) + round_even(n * CAST(0.25 AS DOUBLE), 0) THEN 'B' ELSE 'C' END AS bank "
        f"FROM (SELECT case_id, row_number() OVER (ORDER BY {_hash('zero')}, case_id) - 1 AS r, count(*) OVER () AS n FROM {zero})"
    )


def _in(goals) -> str:
    return "(" + ", ".join(f"'{g}'" for g in goals) + ")"


def _capped(p: str, d) -> str:
    """Closed form of the capped moves over ``{p}h`` (bank after the unlimited moves)."""
    m = d.margin
    return (
        f"{p}g AS (SELECT count(*) FILTER (WHERE bank = 'B') - count(*) FILTER (WHERE bank = 'C') AS g0 FROM {p}h), "
        f"{p}c AS (SELECT case_id, bank, CASE WHEN bank = 'B' THEN 2 ELSE 1 END AS w, "
        f"row_number() OVER (ORDER BY {_hash('low')}, case_id) AS r FROM {p}h WHERE goal IN {_in(d.low_goals)} AND bank <> 'C'), "
        f"{p}s AS (SELECT c.*, g0 - (sum(w) OVER (ORDER BY r) - w) AS gap FROM {p}c c, {p}g), "
        f"{p}f AS (SELECT min(r) AS f FROM {p}s WHERE gap < w + 1 + {m}), "
        f"{p}x AS (SELECT min(s.r) AS x FROM {p}s s, {p}f, {p}s t WHERE t.r = f AND t.bank = 'B' AND t.gap = 2 + {m} AND s.r > f AND s.bank <> 'B'), "
        f"{p}v AS (SELECT case_id FROM {p}s, {p}f, {p}x WHERE f IS NULL OR r < f OR r = x), "
        f"{p}m AS (SELECT case_id, CASE WHEN case_id IN (SELECT case_id FROM {p}v) THEN 'C' ELSE bank END AS bank FROM {p}h)"
    )


def _drops(p: str, rules) -> str:
    """Closed form of the rate enforcement over ``{p}t`` (case_id, bank, outcome)."""
    def case(f) -> str:
        return "CASE k.bank " + " ".join(f"WHEN '{r.bank}' THEN {f(r)}" for r in rules) + " END"

    where = " OR ".join(f"(bank = '{r.bank}' AND outcome = {r.drop_class})" for r in rules)
    rate = "(a - CASE WHEN k.outcome = 2 THEN k ELSE 0 END) / CAST(nullif(n - k, 0) AS DOUBLE)"
    sign = case(lambda r: 1 if r.direction == "up" else -1)
    gap = case(lambda r: f"CAST({r.gap} AS DOUBLE)")
    cap = case(lambda r: f"CAST({r.cap} AS DOUBLE)")
    return (
        f"{p}st AS (SELECT bank, count(*) AS n, count(*) FILTER (WHERE outcome = 2) AS a FROM {p}t GROUP BY bank), "
        f"{p}rf AS (SELECT a / CAST(n AS DOUBLE) AS ref FROM {p}st WHERE bank = 'B'), "
        f"{p}k AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY {_hash('drop')}, case_id) AS k FROM {p}t WHERE {where}), "
        f"{p}hit AS (SELECT k.bank, k.case_id, k.k, least(floor({cap} * n), n - 1) AS lim, "
        f"CASE WHEN {sign} = 1 THEN {rate} - ref >= {gap} ELSE {rate} - ref <= -({gap}) END AS hit "
        f"FROM {p}k k JOIN {p}st s ON s.bank = k.bank, {p}rf), "
        f"{p}sp AS (SELECT bank, min(k) FILTER (WHERE hit) AS stop FROM {p}hit GROUP BY bank), "
        f"{p}dr AS (SELECT h.bank, h.case_id FROM {p}hit h JOIN {p}sp s ON s.bank = h.bank "
        f"WHERE k <= least(coalesce(stop, lim), lim))"
    )


def layout_sql(p: str, strategy: str, k: int, d=DESIGN, src: str = "decided") -> str:
    """CTEs ending in ``{p}out (case_id, bank)``."""
    if strategy == "iid":
        return f"{p}out AS ({_even(src, k, 'iid')})"
    if k == 5:
        spec = " ".join(f"WHEN '{g}' THEN '{b}'" for b, g in d.specialists.items())
        goals = _in(d.specialists.values())
        inner = layout_sql(f"{p}i", strategy, 3, replace(d, enforcement={
            s: replace(e, cap=e.cap_five_banks) for s, e in d.enforcement.items()}), f"{p}rest")
        return (
            f"{p}rest AS (SELECT * FROM {src} WHERE goal NOT IN {goals}), {inner}, "
            f"{p}out AS (SELECT case_id, CASE goal {spec} END AS bank FROM {src} WHERE goal IN {goals} UNION ALL SELECT * FROM {p}iout)"
        )
    weights = d.weak if strategy == "weak" else d.medium
    parts = [_band(p, src), _weighted(p, weights), f"{p}z AS ({_zero(src, d.zero[strategy])})"]
    if strategy == "weak" or not (d.high_goals or d.low_goals):
        parts.append(f"{p}a AS (SELECT case_id, bank FROM {p}w UNION ALL SELECT * FROM {p}z)")
    else:
        parts.append(
            f"{p}h AS (SELECT case_id, amount, goal, CASE WHEN goal IN {_in(d.high_goals)} THEN 'A' ELSE bank END AS bank FROM {p}w)"
        )
        parts.append(_capped(p, d))
        parts.append(f"{p}a AS (SELECT * FROM {p}m UNION ALL SELECT * FROM {p}z)")
    if strategy not in d.enforcement:
        parts.append(f"{p}out AS (SELECT * FROM {p}a)")
    else:
        parts.append(f"{p}t AS (SELECT a.case_id, a.bank, s.outcome FROM {p}a a JOIN {src} s ON s.case_id = a.case_id)")
        parts.append(_drops(p, d.enforcement[strategy].rules(False)))
        parts.append(f"{p}out AS (SELECT case_id, bank FROM {p}t WHERE case_id NOT IN (SELECT case_id FROM {p}dr))")
    return ", ".join(parts)


ALL_LAYOUTS = (
    ", ".join(layout_sql(f"p{i}", s, k) for i, (s, k) in enumerate(CONFIGS))
    + ", lay AS (" + " UNION ALL ".join(
        f"SELECT d.*, o.bank, '{n}' AS config FROM decided d JOIN p{i}out o ON o.case_id = d.case_id" for i, n in enumerate(NAMES)
    ) + ")"
)
SUMMARY = """summ AS (SELECT config, bank, count(*) AS n_cases, count(*) FILTER (WHERE outcome = 0) AS n_cancelled,
  count(*) FILTER (WHERE outcome = 2) AS n_approved, count(*) FILTER (WHERE outcome = 1) AS n_denied,
  count(*) FILTER (WHERE outcome = 2) / CAST(count(*) AS DOUBLE) AS approval_rate, avg(amount) AS mean_amount,
  count(DISTINCT goal) AS n_goals, CAST(sum(n_events) AS BIGINT) AS n_events FROM lay GROUP BY config, bank),
topg AS (SELECT config, bank, goal AS top_goal FROM (SELECT config, bank, goal, row_number() OVER (PARTITION BY config, bank ORDER BY count(*) DESC, goal) AS rn
  FROM lay GROUP BY config, bank, goal) WHERE rn = 1)"""

_LAYOUTS: dict[tuple, object] = {}


def all_layouts(spark, sf):
    """Every layout at case level, settled once per session."""
    key = data_key(spark, sf)
    if key not in _LAYOUTS:
        _LAYOUTS[key] = settle(layouts(decided(spark, sf), CONFIGS, DESIGN))
    return _LAYOUTS[key]


# --- queries --------------------------------------------------------------------------------------

@query("P01_qcut", with_(CASES, _band("q", "decided")) + "SELECT case_id, band FROM qb")
def qcut(spark, sf):
    cases = decided(spark, sf).filter("amount > 0")
    return P.qcut(cases, "amount", 5).select("case_id", "band")


@query("P01_qcut_by_group", with_(CASES) + """
, e AS (SELECT type, quantile_cont(n_events, [0.0, 0.25, 0.5, 0.75, 1.0]) AS edges FROM decided GROUP BY type)
SELECT case_id, CAST(len(list_filter(list_distinct(edges), lambda x: x < n_events AND x > edges[1])) AS INTEGER) AS band
FROM decided d JOIN e ON e.type = d.type""")
def qcut_by_group(spark, sf):
    """Small integers tie often, so edges merge."""
    return P.qcut(decided(spark, sf), "n_events", 4, ["type"]).select("case_id", "band")


@query("P02_hash_rank", with_(CASES) + f"""
SELECT case_id, goal, row_number() OVER (PARTITION BY goal ORDER BY {_hash('demo')}, case_id) - 1 AS rank,
  count(*) OVER (PARTITION BY goal) AS group_size FROM decided""")
def hash_rank(spark, sf):
    out = P.hash_rank(decided(spark, sf), ["goal"], 42, "demo")
    return out.select("case_id", "goal", "rank", "group_size")


@query("P03_split_even", with_(CASES) + _even("decided", 5, "even"))
def split_even(spark, sf):
    return P.split_even(decided(spark, sf), 5, 42)


@query("P04_split_weighted", with_(CASES, _band("q", "decided"), _weighted("q", DESIGN.weak)) + "SELECT case_id, bank FROM qw")
def split_weighted(spark, sf):
    return amount_split(decided(spark, sf), DESIGN, DESIGN.weak, "case_id")


@query("P05_split_linear", with_(CASES, _band("q", "decided")) + """
SELECT case_id, CASE WHEN band <= 1 THEN 'C' WHEN band = 2 THEN 'B' ELSE 'A' END AS bank,
  CASE WHEN band <= 1 THEN 'A' WHEN band = 2 THEN 'B' ELSE 'C' END AS bank_reversed FROM qb""")
def split_linear(spark, sf):
    cut = settle(P.qcut(decided(spark, sf).filter("amount > 0").select("case_id", "amount"), "amount", 5))
    other = P.split_linear(cut, "C").withColumnRenamed("bank", "bank_reversed")
    return P.split_linear(cut).join(other, "case_id")


@query("P06_route_zero", with_(CASES) + ", x AS (" + _zero("decided", "even") + "), y AS (" + _zero("decided", "half") + "), z AS ("
       + _zero("decided", "first") + ") SELECT 'even' AS mode, * FROM x UNION ALL SELECT 'half', * FROM y UNION ALL SELECT 'first', * FROM z")
def route_zero(spark, sf):
    cases = decided(spark, sf)
    out = None
    for mode in ("even", "half", "first"):
        part = P.route_zero(cases, mode, 42).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


_BASE = with_(CASES, _band("q", "decided"), _weighted("q", DESIGN.medium),
              f"qh AS (SELECT case_id, amount, goal, CASE WHEN goal IN {_in(DESIGN.high_goals)} THEN 'A' ELSE bank END AS bank FROM qw)")


def _moved_to_a(spark, sf):
    cases = decided(spark, sf)
    base = amount_split(cases, DESIGN, DESIGN.medium, "case_id").join(cases.select("case_id", "amount", "goal"), "case_id")
    return P.reassign_category(base, DESIGN.high_goals)


@query("P07_reassign_category", _BASE + "SELECT case_id, bank FROM qh")
def reassign_category(spark, sf):
    return _moved_to_a(spark, sf).select("case_id", "bank")


@query("P08_reassign_capped", _BASE + ", " + _capped("q", DESIGN) + " SELECT case_id, bank FROM qm")
def reassign_capped(spark, sf):
    base = settle(_moved_to_a(spark, sf))
    return P.reassign_capped(base, DESIGN.low_goals, 42, DESIGN.margin).select("case_id", "bank")


_RULES = [P.GapRule("A", 1, 0.05, "up", 0.20), P.GapRule("C", 2, 0.05, "down", 0.02)]


@query("P09_enforce_rate_gap", with_(CASES, f"i AS ({_even('decided', 3, 'iid')})",
       "qt AS (SELECT i.case_id, bank, outcome FROM i JOIN decided d ON d.case_id = i.case_id)", _drops("q", _RULES))
       + "SELECT bank, case_id FROM qdr")
def enforce_rate_gap(spark, sf):
    cases = decided(spark, sf)
    labelled = settle(P.split_even(cases, 3, 42, "iid").join(cases.select("case_id", "outcome"), "case_id"))
    return P.rate_gap_drops(labelled, _RULES, 42)


def _walk_sql() -> str:
    rules = ", ".join(f"('{r.bank}', {r.drop_class}, {r.gap}::DOUBLE, {1 if r.direction == 'up' else -1}, {r.cap}::DOUBLE)" for r in _RULES)
    return with_(CASES, f"i AS ({_even('decided', 3, 'iid')})",
                 "qt AS (SELECT i.case_id, bank, outcome FROM i JOIN decided d ON d.case_id = i.case_id)") + f""", r(bank, cls, gap, sgn, cap) AS (VALUES {rules}),
  n AS (SELECT r.*, (SELECT count(*) FROM qt WHERE qt.bank = r.bank) AS size, (SELECT count(*) FROM qt WHERE qt.bank = r.bank AND outcome = 2) AS ok,
    (SELECT avg(CASE WHEN outcome = 2 THEN 1.0 ELSE 0.0 END) FROM qt WHERE bank = 'B') AS ref,
    (SELECT count(*) FROM qt WHERE qt.bank = r.bank AND outcome = r.cls) AS pool FROM r),
  steps AS (SELECT n.*, k, (ok - CASE WHEN cls = 2 THEN k ELSE 0 END) / nullif(size - k, 0)::DOUBLE AS rate FROM n, unnest(range(1, pool + 1)) u(k)),
  goal AS (SELECT bank, min(k) AS k FROM steps WHERE k <= CAST(trunc(cap * size) AS BIGINT) AND k < size AND sgn * (rate - ref) >= gap GROUP BY bank)
SELECT n.bank, pool::BIGINT AS pool, CAST(trunc(cap * size) AS BIGINT) AS "limit",
  CASE WHEN g.k IS NOT NULL THEN g.k WHEN pool <= trunc(cap * size) THEN least(pool, size - 1) ELSE least(CAST(trunc(cap * size) AS BIGINT), size - 1) END::BIGINT AS dropped,
  g.k IS NOT NULL AS target_hit, g.k IS NULL AND pool > trunc(cap * size) AS cap_hit FROM n LEFT JOIN goal g USING (bank)"""


@query("P09_gap_report", _walk_sql())
def gap_report(spark, sf):
    cases = decided(spark, sf)
    labelled = settle(P.split_even(cases, 3, 42, "iid").join(cases.select("case_id", "outcome"), "case_id"))
    return P.gap_report(labelled, _RULES, 42)


@query("P10_carve_specialists", with_(CASES) + """
SELECT case_id, CASE goal WHEN '2-HIGH' THEN 'D' WHEN '3-MEDIUM' THEN 'E' ELSE 'rest' END AS bank FROM decided""")
def carve_specialists(spark, sf):
    special, rest = P.carve_specialists(decided(spark, sf), DESIGN.specialists)
    return special.unionByName(rest.select("case_id", F.lit("rest").alias("bank")))


@query("P11_partition_layouts", with_(CASES, ALL_LAYOUTS) + "SELECT config, bank, case_id FROM lay")
def partition_layouts(spark, sf):
    return all_layouts(spark, sf).select("config", "bank", "case_id")


def _register_layout(strategy: str, k: int, design, label: str) -> None:
    @query(f"P11_partition_{label}", with_(CASES, layout_sql("q", strategy, k, design)) + "SELECT case_id, bank FROM qout")
    def one(spark, sf):
        return partition(decided(spark, sf), strategy, k, design)


for _s, _k in CONFIGS:
    _register_layout(_s, _k, DESIGN, f"{_s}_{_k}banks")
for _s in ("weak", "medium"):
    _register_layout(_s, 3, AMOUNT_ONLY, f"amount_only_{_s}")


@query("P12_check_partition", with_(CASES, layout_sql("q", "strong", 3)) + """
SELECT (SELECT count(*) FROM decided) AS cases, (SELECT count(*) FROM qout) AS assigned,
  (SELECT count(*) FROM qout WHERE case_id NOT IN (SELECT case_id FROM decided)) AS unknown,
  (SELECT count(*) FROM decided WHERE amount >= 0 AND case_id NOT IN (SELECT case_id FROM qout)) AS dropped,
  (SELECT count(*) FROM decided WHERE (amount < 0 OR amount IS NULL) AND case_id NOT IN (SELECT case_id FROM qout)) AS unrouted""")
def check_partition(spark, sf):
    cases = decided(spark, sf)
    return P.check_partition(cases, partition(cases, "strong", 3, DESIGN))


@query("P12_bank_counts", with_(CASES, layout_sql("q", "medium", 3)) + """
SELECT b.bank, count(o.bank) AS n_cases FROM (VALUES ('A'), ('B'), ('C'), ('D')) b(bank) LEFT JOIN qout o ON o.bank = b.bank GROUP BY b.bank""")
def bank_counts(spark, sf):
    return P.bank_counts(partition(decided(spark, sf), "medium", 3, DESIGN), ["A", "B", "C", "D"])


@query("P13_partition_summary", with_(CASES, ALL_LAYOUTS, SUMMARY) + """
SELECT s.config, s.bank, n_cases, n_cancelled, n_approved, n_denied, round(approval_rate, 8) AS approval_rate,
  round(mean_amount, 4) AS mean_amount, n_goals, top_goal, n_events FROM summ s JOIN topg t ON t.config = s.config AND t.bank = s.bank""")
def partition_summary(spark, sf):
    out = P.partition_summary(all_layouts(spark, sf), ["config", "bank"])
    return rounded(out, 8, mean_amount=4)


@query("P14_approval_rates", with_(CASES, ALL_LAYOUTS) + """
SELECT config, bank, count(*) AS n_cases, round(avg(CASE WHEN outcome = 2 THEN 1 ELSE 0 END), 8) AS approval_rate FROM lay GROUP BY config, bank""")
def approval_rates(spark, sf):
    return rounded(P.approval_rates(all_layouts(spark, sf), ["config", "bank"]), 8)


SPLIT = """rk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY start_time, case_id) - 1 AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {src}),
sp AS (SELECT *, CASE WHEN r < round_even(n * CAST(0.6 AS DOUBLE), 0) THEN 'train'
  WHEN r < round_even(n * CAST(0.6 AS DOUBLE), 0) + round_even(n * CAST(0.2 AS DOUBLE), 0) THEN 'val' ELSE 'test' END AS split FROM rk)"""


@query("P15_temporal_split", with_(CASES, ALL_LAYOUTS, SPLIT.format(by="config, bank", src="lay")) + "SELECT config, bank, case_id, split FROM sp")
def temporal_split(spark, sf):
    return P.temporal_split(all_layouts(spark, sf), ["config", "bank"]).select("config", "bank", "case_id", "split")


@query("P15_small_splits", with_(CASES, ALL_LAYOUTS, SPLIT.format(by="config, bank", src="lay")) + """
SELECT b.config, b.bank, s.split, count(sp.case_id) AS n_cases
FROM (SELECT DISTINCT config, bank FROM lay) b CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split)
LEFT JOIN sp ON sp.config = b.config AND sp.bank = b.bank AND sp.split = s.split GROUP BY ALL HAVING count(sp.case_id) < 500""")
def small_splits(spark, sf):
    cut = P.temporal_split(all_layouts(spark, sf), ["config", "bank"])
    return P.small_splits(cut, ["config", "bank"], 500)


_MEDIUM = with_(CASES, layout_sql("q", "medium", 3),
                "ml AS (SELECT d.*, o.bank FROM decided d JOIN qout o ON o.case_id = d.case_id)", SPLIT.format(by="bank", src="ml"))


@query("P15_split_events", _MEDIUM + """
SELECT lc.case_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, sp.bank, sp.split FROM lc JOIN sp ON sp.case_id = lc.case_id""")
def split_events(spark, sf):
    cut, cases = _medium_events(spark, sf)
    return P.split_events(cut, cases).select(*L_KEY, "bank", "split")


def _medium_events(spark, sf):
    cases = decided(spark, sf)
    assigned = cases.join(partition(cases, "medium", 3, DESIGN), "case_id")
    df, spec = log_l(spark, sf)
    return T.cut_at_decision(df, spec, L_DECISIONS, "token"), P.temporal_split(assigned)


@query("P16_central_union", _MEDIUM + """
SELECT sp.split, count(*) AS n_events, count(DISTINCT lc.case_id) AS n_cases FROM lc JOIN sp ON sp.case_id = lc.case_id GROUP BY sp.split""")
def central_union(spark, sf):
    pooled = P.central_union(P.split_events(*_medium_events(spark, sf)))
    per_case = pooled.groupBy("split", "case_id").agg(F.count(F.lit(1)).alias("n"))
    return per_case.groupBy("split").agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_cases"))


@query("P17_compare_configs", with_(CASES, ALL_LAYOUTS, SUMMARY) + """
SELECT config, bank, n_cases, round(n_cases / CAST(sum(n_cases) OVER (PARTITION BY config) AS DOUBLE), 8) AS case_share,
  round(max(approval_rate) OVER (PARTITION BY config) - min(approval_rate) OVER (PARTITION BY config), 8) AS rate_spread FROM summ""")
def compare_configs(spark, sf):
    out = P.compare_configs(P.partition_summary(all_layouts(spark, sf), ["config", "bank"]))
    return rounded(out.select("config", "bank", "n_cases", "case_share", "rate_spread"), 8)


def _enforced(s: str, k: int) -> tuple:
    e = DESIGN.enforcement.get(s)
    return (f"{s}_{k}banks", s, k, *((None,) * 3 if e is None else (e.above, e.below, e.cap_five_banks if k == 5 else e.cap)))


# One row per layout as its record has it; small splits are the warnings.
RECORDS = (
    "rl(config, strategy, n_banks, ta, tb, cap) AS (VALUES "
    + ", ".join("(" + ", ".join("CAST(NULL AS DOUBLE)" if v is None else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else repr(v) for v in _enforced(s, k)) + ")"
                for s, k in CONFIGS)
    + """), rr AS (SELECT config, avg(CASE WHEN outcome = 2 THEN 1 ELSE 0 END) FILTER (WHERE bank = 'A') AS a,
  avg(CASE WHEN outcome = 2 THEN 1 ELSE 0 END) FILTER (WHERE bank = 'B') AS b, avg(CASE WHEN outcome = 2 THEN 1 ELSE 0 END) FILTER (WHERE bank = 'C') AS c,
  count(*) AS assigned FROM lay GROUP BY config),
wl AS (SELECT config, count(*) AS n_warnings, string_agg(bank || ':' || split || ':' || n, ',' ORDER BY bank, n, split) AS small FROM (
  SELECT b.config, b.bank, s.split, count(sp.case_id) AS n FROM (SELECT DISTINCT config, bank FROM lay) b CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split)
  LEFT JOIN sp ON sp.config = b.config AND sp.bank = b.bank AND sp.split = s.split GROUP BY ALL HAVING count(sp.case_id) < 500) GROUP BY config),
rec AS (SELECT rl.*, (SELECT count(*) FROM decided) AS available, assigned, (SELECT count(*) FROM decided) - assigned AS left_out,
  CASE WHEN cap IS NOT NULL THEN (SELECT count(*) FROM decided) - assigned END AS dropped, CASE WHEN cap IS NOT NULL THEN round(a - b, 8) END AS fa,
  CASE WHEN cap IS NOT NULL THEN round(b - c, 8) END AS fb FROM rl JOIN rr USING (config))"""
)


def records(spark, sf):
    """Records of all layouts."""
    df, spec = log_l(spark, sf)
    lay = all_layouts(spark, sf)
    small = P.small_splits(P.temporal_split(lay, ["config", "bank"]), ["config", "bank"], 500)
    warned = small.select("config", F.lit("small split").alias("kind"), "bank", "split", F.col("n_cases").alias("n"))
    return run_records(decided(spark, sf), lay, CONFIGS, DESIGN, T.cut_report(df, spec, L_DECISIONS, "token"), warned)


@query("P17_compare_configs_provenance", with_(CASES, ALL_LAYOUTS, SUMMARY, SPLIT.format(by="config, bank", src="lay"), RECORDS) + """
SELECT s.config, bank, round(n_cases / CAST(sum(n_cases) OVER (PARTITION BY s.config) AS DOUBLE), 8) AS case_share,
  round(max(approval_rate) OVER (PARTITION BY s.config) - min(approval_rate) OVER (PARTITION BY s.config), 8) AS rate_spread,
  available AS n_cases_available_after_filters, assigned AS n_cases_assigned, left_out AS n_cases_unassigned_or_dropped, """ + ", ".join(
    f"CASE WHEN strategy = '{s}' THEN {c} END AS {s}_{n}" for s in ("strong", "medium")
    for c, n in (("ta", "target_ab_gap"), ("tb", "target_bc_gap"), ("fa", "final_ab_gap"), ("fb", "final_bc_gap"), ("dropped", "dropped_total")))
    + " FROM summ s JOIN rec r ON r.config = s.config")
def compare_configs_provenance(spark, sf):
    """Layouts side by side with what their records say."""
    summary = P.partition_summary(all_layouts(spark, sf), ["config", "bank"]).select("config", "bank", "n_cases", "approval_rate")
    out = P.compare_configs(summary, records=records(spark, sf))
    return rounded(out.drop("n_cases", "approval_rate"), 8)


CASE_TABLE = """be AS (SELECT config, quantile_cont(amount, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) FILTER (WHERE amount > 0) AS edges FROM lay GROUP BY config),
ct AS (SELECT sp.config, bank, split, case_id, amount, CASE goal WHEN '1-URGENT' THEN 'High rate' WHEN '5-LOW' THEN 'Low rate'
  WHEN '4-NOT SPECIFIED' THEN 'Low rate' WHEN '2-HIGH' THEN 'Bank D only' WHEN '3-MEDIUM' THEN 'Bank E only' ELSE 'Other' END AS goal_group,
  CASE WHEN amount > 0 THEN (['Q1 low', 'Q2', 'Q3', 'Q4', 'Q5 high'])[1 + len(list_filter(list_distinct(edges), lambda x: x < amount AND x > edges[1]))]
  ELSE 'Zero' END AS amount_band FROM sp JOIN be ON be.config = sp.config)"""


@query("P18_case_table", with_(CASES, ALL_LAYOUTS, SPLIT.format(by="config, bank", src="lay"), CASE_TABLE)
       + "SELECT config, bank, split, case_id, goal_group, amount_band FROM ct")
def case_table(spark, sf):
    cut = P.temporal_split(all_layouts(spark, sf), ["config", "bank"])
    return P.case_table(cut, GROUPS).select("config", "bank", "split", "case_id", "goal_group", "amount_band")


@query("P19_category_share", with_(CASES, ALL_LAYOUTS, SPLIT.format(by="config, bank", src="lay"), CASE_TABLE) + "SELECT config, bank, " + ", ".join(
    f"round(100 * (count(DISTINCT case_id) FILTER (WHERE amount_band = '{b}') / CAST(count(DISTINCT case_id) AS DOUBLE)), 6) AS \"{b}\"" for b in P.AMOUNT_BANDS)
    + " FROM ct GROUP BY config, bank")
def category_share(spark, sf):
    return rounded(P.category_share(P.case_table(all_layouts(spark, sf), GROUPS), "amount_band", P.AMOUNT_BANDS))


@query("P20_rates_pivot", with_(CASES, ALL_LAYOUTS, SUMMARY) + "SELECT config, " + ", ".join(
    f"round(max(approval_rate) FILTER (WHERE bank = '{b}'), 8) AS \"{b}\"" for b in P.BANKS) + " FROM summ GROUP BY config")
def rates_pivot(spark, sf):
    summary = P.partition_summary(all_layouts(spark, sf), ["config", "bank"])
    return rounded(P.rates_pivot(summary, "approval_rate", P.BANKS), 8)


@query("P20_share_pivot", with_(CASES, ALL_LAYOUTS, SUMMARY)
       + ", sh AS (SELECT config, bank, n_cases / CAST(sum(n_cases) OVER (PARTITION BY config) AS DOUBLE) AS s FROM summ) SELECT config, "
       + ", ".join(f"round(coalesce(max(s) FILTER (WHERE bank = '{b}'), CAST(0 AS DOUBLE)), 8) AS \"{b}\"" for b in P.BANKS)
       + " FROM sh GROUP BY config")
def share_pivot(spark, sf):
    summary = P.compare_configs(P.partition_summary(all_layouts(spark, sf), ["config", "bank"]))
    return rounded(P.rates_pivot(summary, "case_share", P.BANKS, 0.0), 8)


@query("P20_overall_rate", with_(CASES) + "SELECT round(avg(CASE WHEN outcome = 2 THEN 1 ELSE 0 END), 8) AS overall_rate FROM decided")
def overall_rate(spark, sf):
    return rounded(P.overall_rate(P.partition_summary(all_layouts(spark, sf), ["config", "bank"])), 8)


@query("P20_dropped_by_config", with_(CASES, ALL_LAYOUTS) + """
SELECT config, (SELECT count(*) FROM decided) - count(*) AS dropped FROM lay GROUP BY config""")
def dropped_by_config(spark, sf):
    return P.dropped_by_config(decided(spark, sf), all_layouts(spark, sf), NAMES)


@query("P21_reconcile_counts", _MEDIUM + """
, a AS (SELECT (SELECT count(*) FROM cases) AS initial, (SELECT count(*) FROM decided) AS filtered, (SELECT count(*) FROM qout) AS assigned,
  (SELECT count(*) FROM (SELECT DISTINCT bank FROM qout) b, (VALUES ('train'), ('val'), ('test')) s(split)
    WHERE (SELECT count(*) FROM sp WHERE sp.bank = b.bank AND sp.split = s.split) < 200) AS warnings)
SELECT 'initial' AS step, initial AS n FROM a UNION ALL SELECT 'filtered', filtered FROM a UNION ALL SELECT 'assigned', assigned FROM a
UNION ALL SELECT 'dropped', filtered - assigned FROM a UNION ALL SELECT 'warnings', warnings FROM a""")
def reconcile_counts(spark, sf):
    cases = decided(spark, sf)
    assigned = settle(cases.join(partition(cases, "medium", 3, DESIGN), "case_id"))
    return P.reconcile_counts(cases_l(spark, sf), assigned, P.temporal_split(assigned))


@query("P21_warnings", with_(CASES, f"i AS ({_even('decided', 3, 'iid')})", "ml AS (SELECT d.*, i.bank FROM i JOIN decided d ON d.case_id = i.case_id)",
       SPLIT.format(by="bank", src="ml")) + f""", rep AS ({_walk_sql()})
SELECT 'cap' AS kind, bank, NULL AS split, dropped AS n FROM rep WHERE cap_hit
UNION ALL SELECT 'small split', b.bank, s.split, count(sp.case_id) FROM (SELECT DISTINCT bank FROM ml) b CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split)
LEFT JOIN sp ON sp.bank = b.bank AND sp.split = s.split GROUP BY ALL HAVING count(sp.case_id) < 5000""")
def partition_warnings(spark, sf):
    cases = decided(spark, sf)
    labelled = settle(cases.join(P.split_even(cases, 3, 42, "iid"), "case_id"))
    return P.partition_warnings(P.gap_report(labelled, _RULES, 42), P.small_splits(P.temporal_split(labelled), least=5000))
