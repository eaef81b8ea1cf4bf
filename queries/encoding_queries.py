"""Queries that harmonise, encode and summarise canonical events."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.bindings import CASES, E, L, L_DECISIONS, data_key, log_e, log_l, measured, micros, table, with_
from queries.partition_queries import DESIGN, SPLIT, decided, layout_sql
from queries.profile_queries import rounded
from queries.registry import query
from tracemill.functions.labels import clean_token
from tracemill.functions.ordered import Latest, Whole, over_trace
from tracemill.operators import additive as A
from tracemill.operators import encode as V
from tracemill.operators import harmonize as H
from tracemill.operators import partition as P
from tracemill.operators import profile as Q
from tracemill.log import LogSpec
from tracemill.plans.partitioning import partition
from tracemill.plans.preparation import canonical_events, labelled_events
from tracemill.session import fine_shuffles, settle

# The cap of prefixes is the data's own: the 98th percentile of trace length (operator Q13).
CAP = "(SELECT cap FROM pcap)"
MAPPING = H.SourceMapping(
    columns={
        "case_id": "case_id", "timestamp": "ts", "raw_activity": "activity", "lifecycle": "lifecycle",
        "raw_activity_token": "token", "next_activity_raw": "next_token", "resource": "l_suppkey",
        "time_delta": "elapsed_seconds", "remaining_time": "remaining_seconds", "outcome": "outcome",
        "requested_amount_value": "amount", "loan_goal": "goal", "application_type": "type",
        "credit_score_value": "credit", "monthly_cost_value": "cost", "offered_amount_value": "offered",
    },
    defaults={"requested_amount_mask": 1, "loan_goal_mask": 1, "application_type_mask": 1},
    offer_sources=("credit_score_value", "monthly_cost_value", "offered_amount_value"),
)
LABELS = {"R": "O_returned", "A": "A_accepted"}
OVERRIDES = {"N+O": "W_open+O"}
FIELDS = {
    "canonical_activity_token": V.reserved_tokens(activity=True),
    "next_activity_target": V.reserved_tokens(target=True),
    "resource": V.reserved_tokens(),
    "loan_goal": V.reserved_tokens(),
    "application_type": V.reserved_tokens(),
}
NUMERIC = {
    "time_delta": None, "requested_amount_value": "requested_amount_mask", "weekday_sin": None,
    "credit_score_value": "offer_feature_mask", "monthly_cost_value": "offer_feature_mask",
    "offered_amount_value": "offer_feature_mask",
}
KEYS = ["dataset_id", "client_id", "split", "case_id"]


def prefix_cap(spark, sf) -> int:
    key = (data_key(spark, sf), "prefix_cap")
    if key not in _CACHE:
        df, spec = log_l(spark, sf)
        with fine_shuffles(spark):
            _CACHE[key] = Q.prefix_cap(df, spec, L_DECISIONS, "token").first()["cap"]
    return _CACHE[key]

_CACHE: dict[tuple, object] = {}


def _once(spark, sf, name, build):
    """Settled once per session: fits and encodings read these tables many times."""
    key = (data_key(spark, sf), name)
    if key not in _CACHE:
        with fine_shuffles(spark):
            _CACHE[key] = settle(build())
    return _CACHE[key]


def _canonical(spark, sf):
    cases = decided(spark, sf)
    assigned = P.temporal_split(cases.join(partition(cases, "iid", 3, DESIGN), "case_id"))
    df, spec = log_l(spark, sf)
    events = labelled_events(df, spec, L_DECISIONS, "token", "token")
    return canonical_events(
        events, assigned.select("case_id", "bank", "split", "outcome", "amount", "goal", "type"), spec, MAPPING, "orders"
    )


def canonical(spark, sf):
    return _once(spark, sf, "canonical", lambda: _canonical(spark, sf))


EVENT_SPEC = LogSpec(case="case_id", activity="raw_activity", ts="event_index", ties=())


def event_spec(spark, sf) -> LogSpec:
    """Canonical events are ordered by their index; hot cases are measured once."""
    return measured(spark, sf, "canonical", canonical(spark, sf), EVENT_SPEC)


def mapped(spark, sf):
    def build():
        out = H.apply_label_map(canonical(spark, sf), LABELS, OVERRIDES)
        return over_trace(out, event_spec(spark, sf), [Whole("n_events", F.lit(1).cast("long"), "sum")], KEYS)

    return _once(spark, sf, "mapped", build)


def train(spark, sf):
    return mapped(spark, sf).filter("split = 'train'")


def vocab(spark, sf):
    return _once(spark, sf, "vocab", lambda: V.fit_vocab(train(spark, sf), FIELDS))


def scaler(spark, sf):
    return _once(spark, sf, "scaler", lambda: V.fit_scaler(train(spark, sf), NUMERIC))


CANON = ", ".join([
    CASES, layout_sql("q", "iid", 3),
    "ml AS (SELECT d.*, o.bank FROM decided d JOIN qout o ON o.case_id = d.case_id)", SPLIT.format(by="bank", src="ml"),
    """canon AS (SELECT 'orders' AS dataset_id, sp.bank AS client_id, sp.split, CAST(lc.case_id AS VARCHAR) AS case_id, pos AS event_index,
  ts, activity AS raw_activity, lifecycle, token AS raw_activity_token,
  coalesce(lead(token) OVER (PARTITION BY lc.case_id ORDER BY pos), '[END]') AS next_activity_raw, CAST(l_suppkey AS VARCHAR) AS resource,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY lc.case_id)) / 1e6 AS time_delta,
  coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY lc.case_id ORDER BY pos)) / 1e6, 0.0) AS time_since_previous,
  (max(epoch_us(ts)) OVER (PARTITION BY lc.case_id) - epoch_us(ts)) / 1e6 AS remaining_time, sp.outcome AS outcome,
  sin(2 * pi() * (isodow(ts) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS weekday_cos,
  sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sp.amount AS requested_amount_value, sp.goal AS loan_goal, sp.type AS application_type,
  nullif(credit, 0) AS credit_score_value, cost AS monthly_cost_value, offered AS offered_amount_value,
  CASE WHEN nullif(credit, 0) IS NOT NULL OR cost IS NOT NULL OR offered IS NOT NULL THEN 1 ELSE 0 END AS offer_feature_mask,
  count(*) OVER (PARTITION BY lc.case_id) AS n_events
  FROM lc JOIN sp ON sp.case_id = lc.case_id)""",
])


def _tok(label: str, token: str, life: str) -> str:
    return (
        f"CASE WHEN {token} = 'N+O' THEN 'W_open+O' WHEN {label} = 'R' THEN 'O_returned+' || {life} "
        f"WHEN {label} = 'A' THEN 'A_accepted+' || {life} ELSE '[OTHER_ACTIVITY]' END"
    )


MAPPED = f"""mp AS (SELECT *, CASE raw_activity WHEN 'R' THEN 'O_returned' WHEN 'A' THEN 'A_accepted' ELSE '[OTHER_ACTIVITY]' END AS canonical_activity_label,
  {_tok('raw_activity', 'raw_activity_token', 'lifecycle')} AS canonical_activity_token,
  CASE WHEN next_activity_raw = '[END]' THEN '[END]' ELSE
  {_tok("split_part(next_activity_raw, '+', 1)", 'next_activity_raw', "split_part(next_activity_raw, '+', 2)")} END AS next_activity_target FROM canon),
pcap AS (SELECT CAST(floor(quantile_cont(n, 0.98)) AS BIGINT) AS cap FROM (SELECT count(*) AS n FROM lp GROUP BY case_id))"""
_OFFSETS = {f: len(r) for f, r in FIELDS.items()}
VOCAB = (
    "tk AS (" + " UNION ALL ".join(
        f"SELECT DISTINCT '{f}' AS field, {f} AS token, {n} AS off FROM mp WHERE split = 'train'" for f, n in _OFFSETS.items()
    ) + "), rs AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS field, '{t}' AS token, {i} AS id" for f, r in FIELDS.items() for i, t in enumerate(r)
    ) + """), vc AS (SELECT field, token, CAST(id AS BIGINT) AS id FROM rs UNION ALL
  SELECT field, token, row_number() OVER (PARTITION BY field ORDER BY token) - 1 + off FROM tk
  WHERE (field, token) NOT IN (SELECT field, token FROM rs))"""
)


def _masked(c: str) -> str:
    return f"CASE WHEN offer_feature_mask = 1 THEN {c} END" if NUMERIC[c] == "offer_feature_mask" else c


SCALER = "sc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST(0 AS DOUBLE) AS mean, CAST(1 AS DOUBLE) AS std" if c == "weekday_sin" else
    f"SELECT '{c}', coalesce(avg({_masked(c)}), CAST(0 AS DOUBLE)), coalesce(nullif(stddev_pop({_masked(c)}), 0), CAST(1 AS DOUBLE)) FROM mp WHERE split = 'train'"
    for c in ["weekday_sin", *[k for k in NUMERIC if k != "weekday_sin"]]
) + ")"
M = with_(CANON, MAPPED)
MV = with_(CANON, MAPPED, VOCAB)
MS = with_(CANON, MAPPED, SCALER)
MVS = with_(CANON, MAPPED, VOCAB, SCALER)


# --- harmonisation --------------------------------------------------------------------------------

_CYC = ["weekday_sin", "weekday_cos", "hour_sin", "hour_cos"]


@query("C01_to_canonical", with_(CANON) + """
SELECT dataset_id, client_id, split, case_id, event_index, epoch_us(ts) AS us, raw_activity, lifecycle, raw_activity_token, next_activity_raw, resource,
  time_delta, time_since_previous, remaining_time, CAST(outcome AS BIGINT) AS outcome, requested_amount_value, loan_goal, application_type,
  credit_score_value, monthly_cost_value, offered_amount_value, offer_feature_mask, """
       + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _CYC) + " FROM canon")
def to_canonical(spark, sf):
    df = _canonical(spark, sf)
    return df.withColumns({"us": micros("timestamp"), **{c: F.round(c, 6) + 0.0 for c in _CYC}}).drop(
        "timestamp", "offer_present", "requested_amount_mask", "loan_goal_mask", "application_type_mask", "number_of_terms_value"
    )


@query("C02_clean_token", """
SELECT doc_id, CASE WHEN lang IS NULL OR lang IN ('', 'nan') THEN '[MISSING]' ELSE lang END AS lang,
  CASE WHEN quality IS NULL THEN '[MISSING]' ELSE CAST(quality AS VARCHAR) END AS quality
FROM documents LEFT JOIN labels USING (doc_id)""")
def clean_tokens(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("doc_id", clean_token(F.col("lang")).alias("lang"), clean_token(F.col("quality")).alias("quality"))


@query("C03_apply_label_map", M + """
SELECT case_id, event_index, canonical_activity_label, canonical_activity_token, next_activity_target,
  1 AS next_activity_mask, 1 AS remaining_time_mask FROM mp""")
def apply_label_map(spark, sf):
    out = H.apply_label_map(canonical(spark, sf), LABELS, OVERRIDES)
    return out.select(
        "case_id", "event_index", "canonical_activity_label", "canonical_activity_token", "next_activity_target",
        "next_activity_mask", "remaining_time_mask",
    )


@query("C04_label_map_report", M + """
, u AS (SELECT raw_activity AS label, 1 AS now FROM mp UNION ALL SELECT split_part(next_activity_raw, '+', 1), 0 FROM mp WHERE next_activity_raw <> '[END]')
SELECT label, CAST(sum(now) AS BIGINT) AS n_events, (SELECT count(*) FROM mp WHERE canonical_activity_label = '[OTHER_ACTIVITY]') AS fallback_count,
  2 AS approved_count FROM u WHERE label NOT IN ('R', 'A') GROUP BY label""")
def label_map_report(spark, sf):
    return H.label_map_report(mapped(spark, sf), LABELS)


_PARTS = """pm AS (SELECT DISTINCT p_type || '_' || p_name AS raw, CASE WHEN p_size > 40 THEN '[OTHER_ACTIVITY]'
  WHEN p_size > 20 THEN 'PROMO_' || p_brand ELSE p_type || '_' || p_brand END AS canonical, p_size <= 3 AS is_override FROM part),
al AS (SELECT DISTINCT p_type || '_' || p_brand AS label FROM part WHERE p_size <= 20)"""


@query("C05_check_label_map", "WITH " + _PARTS + """
, x AS (SELECT pm.*, CASE WHEN is_override THEN split_part(canonical, '+', 1) ELSE canonical END AS lab FROM pm),
y AS (SELECT *, lab IN (SELECT label FROM al) AS ok, CASE WHEN lab LIKE '%\\_%' ESCAPE '\\' THEN split_part(lab, '_', 1) ELSE '' END AS b,
  split_part(raw, '_', 1) AS a FROM x)
SELECT raw, canonical, 'unknown_label' AS rule FROM y WHERE NOT is_override AND NOT ok AND canonical <> '[OTHER_ACTIVITY]'
UNION ALL SELECT raw, canonical, 'reserved_label' FROM y WHERE canonical = '[OTHER_ACTIVITY]'
UNION ALL SELECT raw, canonical, 'crossed_prefix' FROM y WHERE b <> '' AND b <> a""")
def check_label_map(spark, sf):
    part = table(spark, sf, "part")
    home = F.concat_ws("_", "p_type", "p_brand")
    mapping = part.select(
        F.concat_ws("_", "p_type", "p_name").alias("raw"),
        F.when(F.col("p_size") > 40, "[OTHER_ACTIVITY]").when(F.col("p_size") > 20, F.concat(F.lit("PROMO_"), "p_brand"))
        .otherwise(home).alias("canonical"),
        (F.col("p_size") <= 3).alias("is_override"),
    ).distinct()
    return H.check_label_map(mapping, part.filter("p_size <= 20").select(home.alias("label")))


_JOINT = "j AS (SELECT 'lines' AS dataset_id, 'lines:' || activity AS client_id, case_key FROM (SELECT activity, CAST(case_id AS VARCHAR) AS case_key FROM l) " \
         "UNION ALL SELECT 'users', 'users:' || activity, case_id FROM e)"


@query("C06_union_sources", "WITH " + ", ".join([E, L, _JOINT])
       + " SELECT dataset_id, client_id, count(*) AS n_events, count(DISTINCT case_key) AS n_cases FROM j GROUP BY dataset_id, client_id")
def union_sources(spark, sf):
    joint = _joint(spark, sf)
    per_case = joint.groupBy("dataset_id", "client_id", "case_key").agg(F.count(F.lit(1)).alias("n"))
    return per_case.groupBy("dataset_id", "client_id").agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_cases"))


def _joint(spark, sf):
    shape = lambda df: df.select(F.col("activity").alias("client_id"), F.col("case_id").cast("string").alias("case_key"))
    return H.union_sources({"lines": shape(log_l(spark, sf)[0]), "users": shape(log_e(spark, sf)[0])})


@query("C06_missing_banks", "WITH " + ", ".join([E, L, _JOINT]) + """
, w AS (SELECT * FROM (VALUES ('lines', 'lines:R'), ('lines', 'lines:X'), ('users', 'users:view'), ('users', 'users:R')) v(dataset_id, client_id))
SELECT * FROM w WHERE (dataset_id, client_id) NOT IN (SELECT dataset_id, client_id FROM j)""")
def missing_banks(spark, sf):
    return H.missing_banks(_joint(spark, sf), [("lines", "R"), ("lines", "X"), ("users", "view"), ("users", "R")])


ALIASES = {"ring": ["cold ring", "gold ring"], "gear": ["the gear", "gear"], "gizmo": ["small gizmos"], "nothing": ["zzzz qqqq xxxx"]}
_WORDS = "array_to_string(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({drop})), ' ')"
_SHARED = "list_sum(list_transform(list_distinct(string_split({a}, ' ')), lambda w: least(len(list_filter(string_split({a}, ' '), lambda y: y = w)), len(list_filter(string_split({b}, ' '), lambda y: y = w)))))"
_DICE = "CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0 * " + _SHARED + " / CAST(len(string_split({a}, ' ')) + len(string_split({b}, ' ')) AS DOUBLE) END"
_SIM = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN CAST(1 AS DOUBLE) ELSE 1.0 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"


def _columns_sql(similarity, score="CASE WHEN score >= 0.72 THEN round(score, 6) END"):
    pairs = ", ".join(f"('{f}', '{x}')" for f, many in ALIASES.items() for x in many)
    return (f"WITH a(field, alias) AS (VALUES {pairs}), n AS (SELECT p_name, min(p_partkey) AS pos FROM part GROUP BY p_name), "
            + "w AS (SELECT *, " + _WORDS.format(x="p_name", drop="'case', 'event', 'value'") + " AS t FROM n), "
            + "s AS (SELECT field, p_name, pos, max(" + similarity.format(a="t", b="alias") + ") AS score FROM w, a GROUP BY field, p_name, pos), "
            + "r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, pos) AS rn FROM s) "
            + "SELECT field, CASE WHEN score >= 0.72 THEN p_name END AS column_name, " + score + " AS score FROM r WHERE rn = 1")


def _column_names(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("position"))


@query("C07_match_columns", _columns_sql(_SIM, "round(score, 6)"))
def match_columns(spark, sf):
    return rounded(H.match_columns(_column_names(spark, sf), ALIASES, every=True))


@query("C07_match_columns_words", _columns_sql(_DICE))
def match_columns_words(spark, sf):
    return rounded(H.match_columns(_column_names(spark, sf), ALIASES, mode="word"))


CANONICAL_LABELS = {
    "ECONOMY_widget": "red or blue widget", "ECONOMY_ring": "small ring", "PROMO_gear": "cold gear", "PROMO_bolt": "an old bolt",
    "SMALL_gizmo": "new gizmo", "LARGE_anvil": "large blue anvil", "STANDARD_hot_ring": "hot ring", "STANDARD_gear": "red gear",
}
_DROP8 = "'case', 'event', 'value', 'a', 'o', 'w'"
_DROP5 = "'case', 'event', 'value'"


def _labels_sql(similarity, score="CASE WHEN score >= 0.55 THEN round(score, 6) END"):
    return ("WITH c(i, label, text) AS (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(CANONICAL_LABELS.items())) + "), "
            + "r AS (SELECT DISTINCT p_brand AS dataset_id, p_type || '_' || p_name AS label FROM part), "
            + "p AS (SELECT r.dataset_id, r.label, c.i, c.label AS canon, " + _WORDS.format(x="r.label", drop=_DROP8) + " AS t, "
            + _WORDS.format(x="c.label", drop=_DROP8) + " AS t1, " + _WORDS.format(x="c.text", drop=_DROP5) + " AS t2 "
            + "FROM r LEFT JOIN c ON split_part(c.label, '_', 1) = split_part(r.label, '_', 1)), "
            + "s AS (SELECT *, CASE WHEN canon IS NOT NULL THEN greatest(" + similarity.format(a="t", b="t1") + ", " + similarity.format(a="t", b="t2") + ") END AS score FROM p), "
            + "k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, label ORDER BY score DESC, i) AS rn FROM s) "
            + "SELECT dataset_id, label, CASE WHEN score >= 0.55 THEN canon END AS canonical, " + score + " AS score FROM k WHERE rn = 1")


def _raw_labels(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("dataset_id"), F.concat_ws("_", "p_type", "p_name").alias("label"))


@query("C08_match_labels", _labels_sql(_SIM, "round(score, 6)"))
def match_labels(spark, sf):
    return rounded(H.match_labels(_raw_labels(spark, sf), CANONICAL_LABELS, every=True))


@query("C08_match_labels_words", _labels_sql(_DICE))
def match_labels_words(spark, sf):
    return rounded(H.match_labels(_raw_labels(spark, sf), CANONICAL_LABELS, mode="word"))


_DL = """dl AS (SELECT d.source AS dataset_id, CAST(d.doc_id AS VARCHAR) AS k, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _doc_labels(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("dataset_id"), F.col("doc_id").cast("string").alias("k"), "doc_id", "lang").join(
        table(spark, sf, "labels"), "doc_id", "left"
    )


@query("C09_score_columns", "WITH " + _DL + """
, x AS (SELECT dataset_id, CASE WHEN quality = 1 THEN 'q' ELSE 'p' END AS t, CASE WHEN toxic IS NULL THEN '' WHEN toxic = 0 THEN 'q' ELSE 'p' END AS d FROM dl)
SELECT dataset_id, count(*) AS total_fields, count(*) FILTER (WHERE d = t) AS exact, count(*) FILTER (WHERE d <> '' AND d <> t) AS wrong,
  count(*) FILTER (WHERE d = '') AS unresolved, round(count(*) FILTER (WHERE d = t) / count(*), 6) AS accuracy,
  round(count(*) FILTER (WHERE d <> '') / count(*), 6) AS coverage FROM x GROUP BY dataset_id""")
def score_columns(spark, sf):
    docs = _doc_labels(spark, sf).withColumn("run", F.col("dataset_id"))
    truth = docs.select("run", "dataset_id", F.col("k").alias("field"), F.when(F.col("quality") == 1, "q").otherwise("p").alias("column_name"))
    draft = docs.select("run", "dataset_id", F.col("k").alias("field"),
                        F.when(F.col("toxic").isNull(), "").when(F.col("toxic") == 0, "q").otherwise("p").alias("column_name"))
    return rounded(H.score_columns(truth, draft, ["run"]).withColumnRenamed("run", "dataset_id"))


@query("C09_score_labels", "WITH " + _DL + """
, t AS (SELECT dataset_id, lang || '_' || k AS label, CASE WHEN quality = 1 THEN 'en_q' ELSE lang || '_p' END AS t FROM dl WHERE quality IS NOT NULL),
d AS (SELECT dataset_id, lang || '_' || k AS label, CASE WHEN toxic = 0 THEN 'en_q' WHEN lang <> 'de' THEN 'fr_p' END AS d FROM dl WHERE lang <> 'es'),
b AS (SELECT t.label IS NOT NULL AS in_t, d.label IS NOT NULL AS in_d, t, d, coalesce(t.label, d.label) AS label FROM t FULL JOIN d ON t.dataset_id = d.dataset_id AND t.label = d.label)
SELECT count(*) FILTER (WHERE in_t) AS total_labels, count(*) FILTER (WHERE in_t AND d = t) AS correct, count(*) FILTER (WHERE in_t AND d <> t) AS wrong,
  count(*) FILTER (WHERE in_t AND d IS NULL) AS missing, count(*) FILTER (WHERE NOT in_t AND d IS NOT NULL) AS extra,
  count(*) FILTER (WHERE in_d AND d IS NULL) AS unresolved,
  count(*) FILTER (WHERE in_t AND d <> t AND split_part(label, '_', 1) <> split_part(d, '_', 1)) AS cross_prefix,
  round(count(*) FILTER (WHERE in_t AND d = t) / count(*) FILTER (WHERE in_t), 6) AS accuracy FROM b""")
def score_labels(spark, sf):
    docs = _doc_labels(spark, sf).withColumn("label", F.concat_ws("_", "lang", "k"))
    truth = docs.filter("quality is not null").select(
        "dataset_id", "label", F.when(F.col("quality") == 1, "en_q").otherwise(F.concat("lang", F.lit("_p"))).alias("canonical"))
    draft = docs.filter("lang <> 'es'").select(
        "dataset_id", "label", F.when(F.col("toxic") == 0, "en_q").when(F.col("lang") != "de", "fr_p").alias("canonical"))
    return rounded(H.score_labels(truth, draft))


@query("C10_score_field_sets", """
WITH t AS (SELECT DISTINCT l_returnflag AS profile, l_partkey AS field FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'N'),
d AS (SELECT DISTINCT l_returnflag AS profile, l_partkey AS field FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'A'),
tc AS (SELECT profile, count(*) AS cap FROM t GROUP BY profile), dc AS (SELECT profile, count(*) AS cap FROM d GROUP BY profile),
g AS (SELECT p_partkey AS field FROM part WHERE p_size <= 40),
b AS (SELECT coalesce(t.profile, d.profile) AS profile, coalesce(t.field, d.field) AS field, t.field IS NOT NULL AS in_t, d.field IS NOT NULL AS in_d
  FROM t FULL JOIN d ON t.profile = d.profile AND t.field = d.field),
p AS (SELECT b.profile, count(*) FILTER (WHERE in_t AND in_d) AS tp, count(*) FILTER (WHERE NOT in_t) AS fp, count(*) FILTER (WHERE NOT in_d) AS fn,
  count(*) FILTER (WHERE in_d AND field NOT IN (SELECT field FROM g)) AS illegal FROM b WHERE profile IN (SELECT profile FROM tc) GROUP BY b.profile),
c AS (SELECT p.*, tc.cap AS tc, dc.cap AS dc FROM p JOIN tc ON tc.profile = p.profile LEFT JOIN dc ON dc.profile = p.profile)
SELECT count(*) AS profiles, round(count(dc) / count(*), 6) AS coverage, count(*) FILTER (WHERE fp = 0 AND fn = 0 AND tc = dc) AS exact_profiles,
  count(*) FILTER (WHERE tc = dc) AS cap_matches, round(CAST(sum(tp) AS DOUBLE) / (sum(tp) + sum(fp)), 6) AS precision,
  round(CAST(sum(tp) AS DOUBLE) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * CAST(sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1,
  CAST(sum(illegal) AS BIGINT) AS illegal_fields FROM c""")
def score_field_sets(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("profile"), F.col("l_partkey").alias("field"), "l_linestatus")
    truth = lines.filter("l_linestatus = 'F' and profile <> 'N'").select("profile", "field").distinct()
    draft = lines.filter("l_linestatus = 'O' and profile <> 'A'").select("profile", "field").distinct()
    caps = lambda df: df.groupBy("profile").agg(F.count(F.lit(1)).alias("cap"))
    catalog = table(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("field"))
    return rounded(H.score_field_sets(truth, draft, caps(truth), caps(draft), catalog))


_RUNS = """rn AS (SELECT 'S' || (s_nationkey % 4) AS strategy, 'f' || (l_suppkey % 30) AS file_name, s_acctbal < 5000 AS is_variant, s_acctbal > 1000 AS valid,
  avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label_accuracy, avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS column_accuracy,
  count(*) FILTER (WHERE l_discount > 0.09 AND l_tax > 0.07) AS cross_prefix, count(*) FILTER (WHERE l_quantity = 1) AS wrong_column,
  count(*) FILTER (WHERE l_quantity = 50) AS wrong_label, count(*) FILTER (WHERE l_quantity = 49) AS missing_label,
  count(*) FILTER (WHERE l_linenumber = 7) AS extra_label, count(*) FILTER (WHERE l_quantity = 2) AS unresolved_label, l_suppkey
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey, l_suppkey, s_acctbal),
cur AS (SELECT * FROM rn WHERE NOT (is_variant AND file_name IN (SELECT file_name FROM rn WHERE NOT is_variant)))"""
_ERR = ["wrong_column", "wrong_label", "missing_label", "extra_label", "unresolved_label"]


def _score_rows(spark, sf):
    """One scored draft per supplier, from its order lines."""
    lines = table(spark, sf, "lineitem")
    per = lines.groupBy("l_suppkey").agg(
        F.avg((F.col("l_returnflag") == "R").cast("int")).alias("label_accuracy"),
        F.avg((F.col("l_linestatus") == "O").cast("int")).alias("column_accuracy"),
        F.count_if((F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07)).alias("cross_prefix"),
        F.count_if(F.col("l_quantity") == 1).alias("wrong_column"), F.count_if(F.col("l_quantity") == 50).alias("wrong_label"),
        F.count_if(F.col("l_quantity") == 49).alias("missing_label"), F.count_if(F.col("l_linenumber") == 7).alias("extra_label"),
        F.count_if(F.col("l_quantity") == 2).alias("unresolved_label"),
    )
    return per.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("S"), (F.col("s_nationkey") % 4).cast("string")).alias("strategy"),
        F.concat(F.lit("f"), (F.col("l_suppkey") % 30).cast("string")).alias("file_name"),
        (F.col("s_acctbal") < 5000).alias("is_variant"), (F.col("s_acctbal") > 1000).alias("valid"),
        "label_accuracy", "column_accuracy", "cross_prefix", *_ERR, "l_suppkey",
    )


@query("C11_repeat_summary", "WITH " + _RUNS + """
, z AS (SELECT *, cross_prefix + wrong_column + wrong_label AS blocking, cross_prefix + wrong_column + wrong_label + missing_label + extra_label + unresolved_label AS burden FROM cur)
SELECT strategy, count(*) AS runs, count(*) FILTER (WHERE valid) AS valid_runs, count(*) FILTER (WHERE burden = 0) AS clean_runs,
  round(avg(label_accuracy), 6) AS label_accuracy_mean, round(avg(column_accuracy), 6) AS column_accuracy_mean,
  CAST(sum(blocking) AS BIGINT) AS blocking_sum, round(avg(blocking), 6) AS blocking_mean, CAST(sum(burden) AS BIGINT) AS burden_sum, round(avg(burden), 6) AS burden_mean, """
       + ", ".join(f"CAST(sum({e}) AS BIGINT) AS {e}_sum, round(avg({e}), 6) AS {e}_mean" for e in _ERR) + " FROM z GROUP BY strategy")
def repeat_summary(spark, sf):
    return rounded(H.repeat_summary(H.drop_superseded(_score_rows(spark, sf))))


@query("C12_rank_strategies", "WITH " + _RUNS + """
SELECT strategy, file_name, l_suppkey, row_number() OVER (ORDER BY valid DESC, label_accuracy DESC, column_accuracy DESC, file_name || '/' || l_suppkey DESC) AS rank FROM rn""")
def rank_strategies(spark, sf):
    rows = _score_rows(spark, sf).withColumn("file", F.concat_ws("/", "file_name", F.col("l_suppkey").cast("string")))
    out = H.rank_strategies(rows, "valid", "label_accuracy", "column_accuracy", "file")
    return out.select("strategy", "file_name", "l_suppkey", "rank")


_NUM13 = ["time_delta", "remaining_time", "credit_score_value"]


@query("C13_context_profile", with_(CANON) + """
, f AS (SELECT case_id, raw_activity, lifecycle, outcome, split, time_delta, remaining_time, credit_score_value FROM canon),
ln AS (SELECT count(*) AS n FROM f GROUP BY case_id)
""" + " UNION ALL ".join(
    f"SELECT 'column' AS section, '{c}' AS name, '{t}:missing' AS stat, CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) AS value FROM f "
    f"UNION ALL SELECT 'column', '{c}', '{t}:total', CAST(count(*) AS DOUBLE) FROM f "
    f"UNION ALL SELECT 'column', '{c}', '{t}:missing_rate', round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) FROM f"
    for c, t in (("case_id", "string"), ("raw_activity", "string"), ("lifecycle", "string"), ("outcome", "bigint"), ("split", "string"),
                 ("time_delta", "double"), ("remaining_time", "double"), ("credit_score_value", "double"))
) + "".join(
    f" UNION ALL SELECT '{s}', CAST({c} AS VARCHAR), 'count', CAST(count(*) AS DOUBLE) FROM f WHERE {c} IS NOT NULL GROUP BY {c}"
    for s, c in (("outcome", "outcome"), ("activity", "raw_activity"), ("lifecycle", "lifecycle"))
) + "".join(
    f" UNION ALL SELECT 'trace_length', 'events', '{k}', {v} FROM ln" for k, v in (
        ("case_count", "CAST(count(*) AS DOUBLE)"), ("event_count", "CAST(sum(n) AS DOUBLE)"), ("min", "CAST(min(n) AS DOUBLE)"),
        ("p50", "quantile_cont(n, 0.5)"), ("p95", "round(quantile_cont(n, 0.95), 6)"), ("p98", "round(quantile_cont(n, 0.98), 6)"),
        ("max", "CAST(max(n) AS DOUBLE)"), ("mean", "round(avg(n), 6)"))
) + "".join(
    f" UNION ALL SELECT 'train_moment', '{c}', '{k}', {v} FROM f WHERE split = 'train'" for c in _NUM13
    for k, v in (("count", f"CAST(count({c}) AS DOUBLE)"), ("sum", f"round(sum({c}), 0)"), ("sum_squared", f"round(sum({c} * {c}) / 1e9, 2)"))
))
def context_profile(spark, sf):
    df = canonical(spark, sf).select("case_id", "raw_activity", "lifecycle", "outcome", "split", *_NUM13)
    out = H.context_profile(df, "case_id", {"activity": "raw_activity", "lifecycle": "lifecycle"}, "outcome", _NUM13, "split")
    return out.withColumn(
        "value",
        F.when(F.col("stat") == "sum_squared", F.round(F.col("value") / 1e9, 2)).when(F.col("stat") == "sum", F.round("value", 0))
        .otherwise(F.round("value", 6)),
    )


_OV = "pr AS (SELECT DISTINCT l_returnflag || l_linestatus AS dataset_id, CAST(l_partkey AS VARCHAR) AS column_name FROM lineitem)"


@query("C14_context_overlap", "WITH " + _OV + """
, c AS (SELECT column_name, count(*) AS n FROM pr GROUP BY column_name), t AS (SELECT count(DISTINCT dataset_id) AS k FROM pr)
SELECT 'shared' AS scope, NULL AS dataset_id, column_name FROM c, t WHERE n = k
UNION ALL SELECT 'specific', pr.dataset_id, pr.column_name FROM pr JOIN c ON c.column_name = pr.column_name, t WHERE n < k""")
def context_overlap(spark, sf):
    lines = table(spark, sf, "lineitem")
    return H.context_overlap(lines.select(F.concat("l_returnflag", "l_linestatus").alias("dataset_id"), F.col("l_partkey").cast("string").alias("column_name")))


@query("C14_context_overview", """
SELECT l_returnflag AS dataset_id, count(DISTINCT l_partkey) AS n_columns, count(DISTINCT l_linestatus) AS n_labels,
  count(DISTINCT l_orderkey) AS n_cases, count(*) AS n_events FROM lineitem GROUP BY l_returnflag""")
def context_overview(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("dataset_id", F.col("l_returnflag"))
    cases = lines.groupBy("dataset_id", "l_orderkey").agg(F.count(F.lit(1)).alias("n_events"))
    return H.context_overview(
        lines.select("dataset_id", F.col("l_partkey").alias("column_name")), lines.select("dataset_id", F.col("l_linestatus").alias("label")), cases
    )


@query("C15_check_profile", """
WITH f AS (SELECT DISTINCT l_returnflag AS profile, l_partkey AS field FROM lineitem),
c AS (SELECT l_returnflag AS profile, CAST(sum(l_tax) * 100 AS BIGINT) - CASE WHEN l_returnflag = 'N' THEN CAST(sum(l_tax) * 100 AS BIGINT) ELSE 0 END AS cap FROM lineitem GROUP BY l_returnflag),
g AS (SELECT p_partkey AS field FROM part WHERE p_size <= 45), x AS (SELECT p_partkey AS field FROM part WHERE p_size = 7),
a AS (SELECT DISTINCT p_name AS label FROM part WHERE p_size > 25), w AS (SELECT DISTINCT p_name AS label FROM part WHERE p_brand < 'Brand#11')
SELECT 'unknown_field' AS rule, profile || '.' || field AS subject FROM f WHERE field NOT IN (SELECT field FROM g)
UNION ALL SELECT 'forbidden_field', profile || '.' || field FROM f WHERE field IN (SELECT field FROM x)
UNION ALL SELECT 'cap_not_positive', profile FROM c WHERE cap <= 0
UNION ALL SELECT 'unknown_label', label FROM a WHERE label NOT IN (SELECT label FROM w)
UNION ALL SELECT 'missing_label', label FROM w WHERE label NOT IN (SELECT label FROM a)""")
def check_profile(spark, sf):
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    fields = lines.select(F.col("l_returnflag").alias("profile"), F.col("l_partkey").alias("field"))
    total = (F.sum("l_tax") * 100).cast("long")
    caps = lines.groupBy(F.col("l_returnflag").alias("profile")).agg(total.alias("t")).select(
        "profile", F.when(F.col("profile") == "N", 0).otherwise(F.col("t")).alias("cap"))
    key = lambda cond: part.filter(cond).select(F.col("p_partkey").alias("field"))
    name = lambda cond: part.filter(cond).select(F.col("p_name").alias("label"))
    return H.check_profile(fields, caps, key("p_size <= 45"), key("p_size = 7"), name("p_size > 25"), name("p_brand < 'Brand#11'"))


# --- encoding -------------------------------------------------------------------------------------

@query("V01_fit_vocab", MV + "SELECT field, token, id FROM vc")
def fit_vocab(spark, sf):
    return V.fit_vocab(train(spark, sf), FIELDS)


@query("V02_encode", MV + "SELECT case_id, event_index, " + ", ".join(
    f"coalesce((SELECT id FROM vc WHERE field = '{c}' AND token = mp.{c}), 1) AS {c}_id" for c in FIELDS) + " FROM mp")
def encode(spark, sf):
    out = V.encode(mapped(spark, sf), vocab(spark, sf), list(FIELDS))
    return out.select("case_id", "event_index", *[f"{c}_id" for c in FIELDS])


@query("V03_fit_scaler", MS + "SELECT field, round(mean, 4) AS mean, round(std, 4) AS std FROM sc")
def fit_scaler(spark, sf):
    return rounded(V.fit_scaler(train(spark, sf), NUMERIC), 4)


@query("V04_scale", MS + "SELECT case_id, event_index, " + ", ".join(
    f"round(CAST(CAST(coalesce(({c} - (SELECT mean FROM sc WHERE field = '{c}')) / (SELECT std FROM sc WHERE field = '{c}'), CAST(0 AS DOUBLE)) AS FLOAT) AS DOUBLE), 4) + 0.0 AS {c}_scaled"
    for c in NUMERIC) + " FROM mp")
def scale(spark, sf):
    out = V.scale(mapped(spark, sf), scaler(spark, sf), list(NUMERIC))
    return out.select("case_id", "event_index", *[(F.round(F.col(f"{c}_scaled").cast("double"), 4) + 0.0).alias(f"{c}_scaled") for c in NUMERIC])


@query("V05_prefix_index", M + f"""
, n AS (SELECT dataset_id, client_id, split, case_id, count(*) AS n_events FROM mp GROUP BY ALL)
SELECT dataset_id, client_id, split, case_id, n_events, unnest(range(1, least(n_events, {CAP}) + 1)) AS prefix_length,
  unnest(range(0, least(n_events, {CAP}))) AS label_pos FROM n""")
def prefix_index(spark, sf):
    return V.prefix_index(mapped(spark, sf), KEYS, prefix_cap(spark, sf))


@query("V06_prefix_counts", M + f"""
, n AS (SELECT dataset_id, client_id, case_id, count(*) AS n FROM mp GROUP BY ALL)
SELECT dataset_id, client_id, count(*) AS cases, CAST(sum(n) AS BIGINT) AS events, CAST(sum(least(n, {CAP})) AS BIGINT) AS prefixes, max(n) AS max_length
FROM n GROUP BY GROUPING SETS ((dataset_id, client_id), ())""")
def prefix_counts(spark, sf):
    return V.prefix_counts(mapped(spark, sf), prefix_cap(spark, sf))


@query("V05_prefix_index_all", M + """
, n AS (SELECT dataset_id, client_id, split, case_id, count(*) AS n_events FROM mp GROUP BY ALL)
SELECT dataset_id, client_id, split, case_id, n_events, unnest(range(1, n_events + 1)) AS prefix_length, unnest(range(0, n_events)) AS label_pos FROM n""")
def prefix_index_all(spark, sf):
    return V.prefix_index(mapped(spark, sf), KEYS, None)


@query("V06_prefix_counts_all", M + """
, n AS (SELECT dataset_id, client_id, case_id, count(*) AS n FROM mp GROUP BY ALL)
SELECT dataset_id, client_id, count(*) AS cases, CAST(sum(n) AS BIGINT) AS events, CAST(sum(n) AS BIGINT) AS prefixes, max(n) AS max_length
FROM n GROUP BY GROUPING SETS ((dataset_id, client_id), ())""")
def prefix_counts_all(spark, sf):
    return V.prefix_counts(mapped(spark, sf), None)


@query("V06_train_outcome_counts", M + """
SELECT CAST(outcome AS BIGINT) AS outcome, count(DISTINCT case_id) AS cases FROM mp WHERE split = 'train' GROUP BY outcome""")
def train_outcome_counts(spark, sf):
    return V.train_outcome_counts(mapped(spark, sf))


def _encoded(spark, sf):
    out = V.encode(mapped(spark, sf), vocab(spark, sf), ["canonical_activity_token", "loan_goal"])
    return V.scale(out, scaler(spark, sf), ["time_delta", "requested_amount_value"])


_PAD = f"array_to_string(list_transform(range(1, {CAP} + 1), lambda j: CASE WHEN j <= k THEN {{a}}[j] ELSE 0 END), ',')"


def _sql_scaled(c: str) -> str:
    return (
        f"CAST(round(CAST(CAST(coalesce(({c} - (SELECT mean FROM sc WHERE field = '{c}')) / (SELECT std FROM sc WHERE field = '{c}'), CAST(0 AS DOUBLE)) AS FLOAT) AS DOUBLE) * 1000) AS BIGINT)"
    )


def _thousandths(col):
    return F.array_join(F.transform(col, lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",")


@query("V07_prefix_arrays", MVS + f"""
, ev AS (SELECT case_id, event_index, coalesce((SELECT id FROM vc WHERE field = 'canonical_activity_token' AND token = mp.canonical_activity_token), 1) AS a,
  coalesce((SELECT id FROM vc WHERE field = 'loan_goal' AND token = mp.loan_goal), 1) AS g, {_sql_scaled('time_delta')} AS t, {_sql_scaled('requested_amount_value')} AS r FROM mp WHERE event_index < {CAP}),
ar AS (SELECT case_id, count(*) AS n, list(a ORDER BY event_index) AS a, list(g ORDER BY event_index) AS g, list(t ORDER BY event_index) AS t, list(r ORDER BY event_index) AS r FROM ev GROUP BY case_id),
pf AS (SELECT *, unnest(range(1, n + 1)) AS k FROM ar)
SELECT case_id, CAST(k AS INTEGER) AS prefix_length, {_PAD.format(a='a')} AS tokens, {_PAD.format(a='g')} AS goals, {_PAD.format(a='t')} AS deltas, {_PAD.format(a='r')} AS amounts,
  array_to_string(list_transform(range(1, {CAP} + 1), lambda j: CASE WHEN j <= k THEN 1 ELSE 0 END), ',') AS mask FROM pf""")
def prefix_arrays(spark, sf):
    out = V.prefix_arrays(
        _encoded(spark, sf), KEYS, "event_index", ["canonical_activity_token_id", "loan_goal_id"],
        ["time_delta_scaled", "requested_amount_value_scaled"], prefix_cap(spark, sf),
    )
    return out.select(
        "case_id", "prefix_length", F.array_join("canonical_activity_token_id", ",").alias("tokens"), F.array_join("loan_goal_id", ",").alias("goals"),
        _thousandths("time_delta_scaled").alias("deltas"), _thousandths("requested_amount_value_scaled").alias("amounts"),
        F.array_join("padding_mask", ",").alias("mask"),
    )


_STATE = ["credit_score_value", "offered_amount_value"]


@query("V08_prefix_state_arrays", MS + f"""
, cs AS (SELECT *, last_value(CASE WHEN offer_feature_mask = 1 THEN event_index END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS si FROM mp),
st AS (SELECT cs.case_id, cs.event_index, cs.si IS NOT NULL AS present, s.credit_score_value, s.offered_amount_value FROM cs LEFT JOIN mp s ON s.case_id = cs.case_id AND s.event_index = cs.si WHERE cs.event_index < {CAP}),
sv AS (SELECT case_id, event_index, CASE WHEN present THEN 1 ELSE 0 END AS m, {_sql_scaled('credit_score_value')} AS c, {_sql_scaled('offered_amount_value')} AS o FROM st),
ar AS (SELECT case_id, count(*) AS n, list(m ORDER BY event_index) AS m, list(c ORDER BY event_index) AS c, list(o ORDER BY event_index) AS o FROM sv GROUP BY case_id),
pf AS (SELECT *, unnest(range(1, n + 1)) AS k FROM ar)
SELECT case_id, CAST(k AS INTEGER) AS prefix_length, {_PAD.format(a='c')} AS credit, {_PAD.format(a='o')} AS offered, {_PAD.format(a='m')} AS state_mask FROM pf""")
def prefix_state_arrays(spark, sf):
    state = F.struct(*[F.col(c).alias(c) for c in _STATE])
    out = over_trace(mapped(spark, sf), event_spec(spark, sf), [Latest("__state", F.col("offer_feature_mask") == 1, state)], KEYS)
    out = out.withColumns({
        "state_present": F.when(F.col("__state").isNotNull(), 1).otherwise(0), **{f"carried_{c}": F.col("__state")[c] for c in _STATE},
    })
    scaled = V.scale_state(out, scaler(spark, sf), _STATE)
    arrays = V.prefix_state_arrays(scaled, KEYS, "event_index", [f"state_{c}" for c in _STATE], "state_present", prefix_cap(spark, sf))
    return arrays.select(
        "case_id", "prefix_length", _thousandths("state_credit_score_value").alias("credit"),
        _thousandths("state_offered_amount_value").alias("offered"), F.array_join("state_mask", ",").alias("state_mask"),
    )


def _pop(cap: str = CAP) -> str:
    return f"pop AS (SELECT remaining_time AS s FROM mp WHERE split = 'train' AND event_index < {cap} AND event_index < n_events - 1 AND remaining_time > 0)"


@query("V09_prefix_labels", MV + f", {_pop()}" + f"""
, tp AS (SELECT avg(ln(1 + s)) AS c, stddev_pop(ln(1 + s)) AS d FROM pop)
SELECT case_id, event_index + 1 AS prefix_length, CAST(outcome AS BIGINT) AS outcome_label,
  coalesce((SELECT id FROM vc WHERE field = 'next_activity_target' AND token = mp.next_activity_target), 1) AS next_label,
  CASE WHEN next_activity_target IN (SELECT token FROM vc WHERE field = 'next_activity_target') THEN 1 ELSE 0 END AS next_mask,
  round((ln(1 + remaining_time) - c) / d, 6) + 0.0 AS remaining_label, CASE WHEN event_index = n_events - 1 THEN 0 ELSE 1 END AS remaining_mask
FROM mp, tp WHERE event_index < {CAP}""")
def prefix_labels(spark, sf):
    pop = V.target_population(mapped(spark, sf), "event_index", "n_events", prefix_cap(spark, sf), "remaining_time")
    out = V.prefix_labels(
        mapped(spark, sf), KEYS, "event_index", "n_events", prefix_cap(spark, sf), "next_activity_target", "remaining_time", "outcome",
        vocab(spark, sf), target=V.fit_target(pop, "log", "zscore"),
    )
    return rounded(out.drop("dataset_id", "client_id", "split")).withColumn("remaining_label", F.col("remaining_label") + 0.0)


_MODES = [("raw", "raw"), ("raw", "median"), ("raw", "zscore"), ("log", "raw"), ("log", "median"), ("log", "zscore")]


def _fit_sql(t: str, s: str) -> str:
    x = "ln(1 + s)" if t == "log" else "s"
    med = "quantile_disc(s, 0.5)"
    medt = f"ln(1 + {med})" if t == "log" else med
    if s == "zscore":
        body = f"avg({x}) AS center, stddev_pop({x}) AS scale, CAST(0 AS DOUBLE) AS mu, CAST(0 AS DOUBLE) AS ms"
    else:
        sc = "CAST(1 AS DOUBLE)" if s == "raw" else f"greatest({medt}, 1.0)"
        body = f"CAST(0 AS DOUBLE) AS center, {sc} AS scale, {medt} / {sc} AS mu, CAST({med} AS DOUBLE) AS ms"
    return (
        f"SELECT transform, scaling, round(center, 4) AS center, round(scale, 4) AS scale, round(mu, 6) AS median_model_units, round(ms, 4) AS median_seconds, n_values "
        f"FROM (SELECT '{t}' AS transform, '{s}' AS scaling, {body}, count(*) AS n_values FROM pop)"
    )


@query("V10_fit_target", M + f", {_pop()} " + " UNION ALL ".join(_fit_sql(t, s) for t, s in _MODES))
def fit_target(spark, sf):
    pop = V.target_population(mapped(spark, sf), "event_index", "n_events", prefix_cap(spark, sf), "remaining_time")
    out = None
    for t, s in _MODES:
        one = V.fit_target(pop, t, s)
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4, median_model_units=6)


@query("V11_transform_target", M + f", {_pop()}" + """
, tp AS (SELECT avg(ln(1 + s)) AS c, stddev_pop(ln(1 + s)) AS d FROM pop)
SELECT case_id, event_index, round((ln(1 + remaining_time) - c) / d, 6) + 0.0 AS units, round(remaining_time, 3) AS seconds FROM mp, tp""")
def transform_target(spark, sf):
    """Forward and back again: the inverse gives the seconds."""
    events = mapped(spark, sf)
    target = V.fit_target(V.target_population(events, "event_index", "n_events", prefix_cap(spark, sf), "remaining_time"), "log", "zscore")
    out = V.inverse_target(V.transform_target(events, target, "remaining_time", "units"), target, "units", "seconds")
    return out.select("case_id", "event_index", (F.round("units", 6) + 0.0).alias("units"), F.abs(F.round("seconds", 3)).alias("seconds"))


@query("V12_class_weights", M + """
, oc AS (SELECT outcome, count(DISTINCT case_id) AS n FROM mp WHERE split = 'train' GROUP BY outcome)
SELECT CAST(outcome AS INTEGER) AS class_id, n, round(sqrt(CAST(sum(n) OVER () AS DOUBLE) / (3 * n)), 6) AS weight FROM oc""")
def class_weights(spark, sf):
    labels = train(spark, sf).select("case_id", "outcome").distinct()
    return rounded(V.class_weights(labels, "outcome", 3, 0.5))


@query("V13_label_support", MV + f"""
, x AS (SELECT client_id, (SELECT id FROM vc WHERE field = 'next_activity_target' AND token = mp.next_activity_target) AS next_label FROM mp WHERE split = 'train' AND event_index < {CAP})
SELECT client_id, next_label, count(*) AS n FROM x WHERE next_label IS NOT NULL GROUP BY client_id, next_label""")
def label_support(spark, sf):
    labels = V.prefix_labels(
        train(spark, sf), KEYS, "event_index", "n_events", prefix_cap(spark, sf), "next_activity_target", "remaining_time", "outcome", vocab(spark, sf))
    return V.label_support(labels, "next_label", "next_mask", "client_id")


@query("V14_mask_scores", """
WITH s AS (SELECT DISTINCT label, label // 5 AS ds FROM embeddings WHERE embedding[1] > 0)
SELECT vec_id, array_to_string(list_transform(range(0, 10), lambda i: CASE WHEN i IN (SELECT label FROM s WHERE s.ds = e.label // 5)
  THEN CAST(CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR) ELSE 'x' END), ',') AS scores FROM embeddings e"""
       .replace("i IN (SELECT label FROM s WHERE s.ds = e.label // 5)", "list_contains(sup, i)")
       .replace("FROM embeddings e", "FROM embeddings e JOIN (SELECT ds, list(label) AS sup FROM s GROUP BY ds) q ON q.ds = e.label // 5"))
def mask_scores(spark, sf):
    df = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.floor(F.col("label") / 5).alias("ds"), F.slice("embedding", 1, 10).alias("scores"))
    seen = V.label_support(df.withColumn("m", (F.col("scores")[0] > 0).cast("int")), "label", "m", "ds")
    out = V.mask_scores(df, "scores", V.dense_support(seen, "label", 10, "ds"), "ds")
    text = F.transform("scores", lambda x: F.coalesce(F.round(x.cast("double") * 1000).cast("long").cast("string"), F.lit("x")))
    return out.select("vec_id", F.array_join(text, ",").alias("scores"))


@query("V15_encoding_identity")
def encoding_identity(spark, sf):
    return V.encoding_identity(
        {"vocab": vocab(spark, sf), "scaler": scaler(spark, sf), "events": mapped(spark, sf)}, {"cap": prefix_cap(spark, sf), "fields": sorted(FIELDS)})


@query("V15_vocab_identity", MV + """
, h AS (SELECT sha256(CAST(json_object('field', field, 'id', id, 'token', token) AS VARCHAR)) AS h FROM vc)
SELECT sha256('version=1|[{"part":"vocab","n":' || count(*) || ',"h":"' || CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) || '"}]') AS identity FROM h""")
def vocab_identity(spark, sf):
    """The identity of the vocabulary alone, which has a plain SQL form."""
    return V.encoding_identity({"vocab": vocab(spark, sf)}, {"version": 1})


# --- additive statistics --------------------------------------------------------------------------

_CAT = ["canonical_activity_token", "next_activity_target", "resource", "loan_goal"]


def _stats(spark, sf, cap=0):
    """Local statistics with the data's cap, another one, or none."""
    return A.local_stats(mapped(spark, sf), prefix_cap(spark, sf) if cap == 0 else cap, _CAT, NUMERIC)


def _moment_sql(family: str, field: str, x: str, where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT client_id, '{family}' AS family, '{field}' AS field, '{k}' AS key, {v} AS value FROM mp WHERE {where} GROUP BY client_id HAVING {v} IS NOT NULL"
        for k, v in (("count", f"CAST(count({x}) AS DOUBLE)"), ("sum", f"sum({x})"), ("sum_squared", f"sum(({x}) * ({x}))"))
    )


def _stats_sql(name: str, cap: str | int) -> str:
    fits = f"event_index < {cap} AND event_index < n_events - 1 AND remaining_time > 0"
    return f"{name} AS (" + " UNION ALL ".join([
        *[f"SELECT client_id, 'counts' AS family, '{f}' AS field, '' AS key, CAST({v} AS DOUBLE) AS value FROM (SELECT client_id, case_id, count(*) AS n FROM mp GROUP BY client_id, case_id) GROUP BY client_id"
          for f, v in (("cases", "count(*)"), ("events", "sum(n)"), ("prefixes", f"sum(least(n, {cap}))"), ("max_length", "max(n)"))],
        "SELECT client_id, 'outcomes', 'outcome', CAST(outcome AS VARCHAR), CAST(count(DISTINCT case_id) AS DOUBLE) FROM mp WHERE split = 'train' GROUP BY client_id, outcome",
        *[f"SELECT client_id, 'tokens', '{c}', {c}, CAST(count(*) AS DOUBLE) FROM mp WHERE split = 'train' GROUP BY client_id, {c}" for c in _CAT],
        *[_moment_sql("moments", c, _masked(c), "split = 'train'") for c in NUMERIC],
        _moment_sql("target", "remaining_time_raw", f"CASE WHEN {fits} THEN remaining_time END", "split = 'train'"),
    ]) + ")"


_MERGED = "mg AS (SELECT family, field, key, CASE WHEN field = 'max_length' THEN max(value) ELSE sum(value) END AS value FROM ls GROUP BY family, field, key)"
# Sums reach 1e18 here: compare them at ten significant digits.
_SIG = "CASE WHEN abs(value) >= 1e6 THEN round(value / pow(10, floor(log10(abs(value)))), 8) ELSE round(value, 6) END"


def _sig(df):
    v = F.col("value")
    big = F.round(v / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v)))), 8)
    return df.withColumn("value", F.when(F.abs(v) >= 1e6, big).otherwise(F.round(v, 6)))


@query("A01_local_stats", M + ", " + _stats_sql("ls", CAP) + f" SELECT client_id, family, field, key, {_SIG} AS value FROM ls")
def local_stats(spark, sf):
    return _sig(_stats(spark, sf))


@query("A01_local_stats_all", M + ", " + _stats_sql("ls", 1_000_000_000) + f" SELECT client_id, family, field, key, {_SIG} AS value FROM ls")
def local_stats_all(spark, sf):
    return _sig(_stats(spark, sf, None))


@query("A02_merge_stats", M + ", " + _stats_sql("ls", CAP) + f", {_MERGED} SELECT family, field, key, {_SIG} AS value FROM mg")
def merge_stats(spark, sf):
    return _sig(A.merge_stats(_stats(spark, sf)))


_CATV = {c: FIELDS[c] for c in _CAT}


@query("A02_merge_stats_per_client", M + ", " + _stats_sql("ls", CAP) + f""", {_MERGED}
SELECT NULL AS client_id, family, field, key, {_SIG} AS value FROM mg
UNION ALL SELECT client_id, family, field, key, {_SIG} FROM ls WHERE family = 'counts'""")
def merge_stats_per_client(spark, sf):
    """Totals (no client) and the counts of each client."""
    return _sig(A.merge_stats(_stats(spark, sf), "client_id"))


@query("A03_vocab_from_counts", MV + "SELECT field, token, id FROM vc WHERE field <> 'application_type'")
def vocab_from_counts(spark, sf):
    """Must equal the vocabulary fitted on the pooled train events."""
    return A.vocab_from_counts(settle(A.merge_stats(_stats(spark, sf))), _CATV)


@query("A04_scaler_from_moments", MS + "SELECT field, round(mean, 3) AS mean, round(std, 3) AS std FROM sc")
def scaler_from_moments(spark, sf):
    """Must equal the scaler fitted on the pooled train events."""
    return rounded(A.scaler_from_moments(A.merge_stats(_stats(spark, sf))), 3)


@query("A04_target_from_moments", M + f", {_pop()}" + """
SELECT 'raw' AS transform, 'zscore' AS scaling, round(avg(s), 3) AS center, round(stddev_pop(s), 2) AS scale, count(*) AS n_values FROM pop""")
def target_from_moments(spark, sf):
    return rounded(A.target_from_moments(A.merge_stats(_stats(spark, sf)), "raw", "zscore"), 3, scale=2)


@query("A05_compare_stats", M + ", " + _stats_sql("ls", CAP) + ", " + _stats_sql("l2", 5) + """
, j AS (SELECT coalesce(a.client_id, b.client_id) AS client_id, coalesce(a.family, b.family) AS family, a.value AS a, b.value AS b
  FROM ls a FULL JOIN l2 b ON a.client_id = b.client_id AND a.family = b.family AND a.field = b.field AND a.key = b.key),
k AS (SELECT *, coalesce(abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-9), false) AS near FROM j)
SELECT client_id, family, bool_and(near) AS matches, count(*) FILTER (WHERE NOT near) AS n_different, count(*) AS n_entries FROM k GROUP BY client_id, family""")
def compare_stats(spark, sf):
    """Two prefix caps: counts and target moments differ, the rest must match."""
    return A.compare_stats(_stats(spark, sf), _stats(spark, sf, 5), by=["client_id"])


def _record_sql(n: str, cap: str | int) -> str:
    """The central record of one prefix cap, without any sums per client."""
    def entries(family: str, bank: str, pairs: dict[str, str], src: str, where: str = "true") -> str:
        made = ", ".join(f"{{'f': '{f}', 'v': CAST({v} AS DOUBLE)}}" for f, v in pairs.items())
        return f"SELECT {family} AS family, {bank} AS bank, u.f AS field, '' AS key, u.v AS value, NULL AS text FROM (SELECT *, unnest([{made}]) AS u FROM {src} WHERE {where})"

    fits = f"split = 'train' AND event_index < {cap} AND event_index < n_events - 1 AND remaining_time > 0"
    return f"""{n}c AS (SELECT client_id, case_id, count(*) AS n FROM mp GROUP BY ALL),
{n}g AS (SELECT client_id, count(*) AS cases, sum(n) AS events, sum(least(n, {cap})) AS prefixes, max(n) AS longest FROM {n}c GROUP BY GROUPING SETS ((client_id), ())),
{n}t AS (SELECT avg(remaining_time) AS center, stddev_pop(remaining_time) AS scale, count(*) AS n FROM mp WHERE {fits}),
{n} AS ({entries("CASE WHEN client_id IS NULL THEN 'counts' ELSE 'per_bank_counts' END", "client_id", {"cases": "cases", "events": "events", "prefixes": "prefixes"}, f"{n}g")}
UNION ALL {entries("'prefix'", "NULL", {"cap": str(cap), "padding": str(cap), "max_length": "longest"}, f"{n}g", "client_id IS NULL")}
UNION ALL SELECT 'outcomes', NULL, 'outcome', CAST(outcome AS VARCHAR), count(DISTINCT case_id), NULL FROM mp WHERE split = 'train' GROUP BY outcome
UNION ALL SELECT 'vocabularies', NULL, field, token, id, NULL FROM vc WHERE field <> 'application_type'
UNION ALL SELECT 'scalers', NULL, field, 'mean', mean, NULL FROM sc UNION ALL SELECT 'scalers', NULL, field, 'std', std, NULL FROM sc
UNION ALL SELECT 'target', NULL, 'remaining_time', 'center', center, NULL FROM {n}t UNION ALL SELECT 'target', NULL, 'remaining_time', 'scale', scale, NULL FROM {n}t
UNION ALL SELECT 'target', NULL, 'remaining_time', 'n_values', n, NULL FROM {n}t
UNION ALL SELECT 'target', NULL, 'remaining_time', 'transform', NULL, 'raw' UNION ALL SELECT 'target', NULL, 'remaining_time', 'scaling', NULL, 'zscore')"""


# Merged sums must give the central record of the same cap; against that of another cap four families differ.
_RECORDS = MVS + ", " + _record_sql("ra", CAP) + ", " + _record_sql("rb", 5) + """
, j AS (SELECT 'same cap' AS central, a.family, true AS ok FROM ra a
  UNION ALL SELECT 'cap of five', coalesce(a.family, b.family), a.family IS NOT NULL AND b.family IS NOT NULL AND a.text IS NOT DISTINCT FROM b.text
    AND (a.value IS NOT DISTINCT FROM b.value OR (a.family IN ('scalers', 'target') AND coalesce(abs(a.value - b.value) <= greatest(1e-9 * greatest(abs(a.value), abs(b.value)), 1e-9), false)))
  FROM ra a FULL JOIN rb b ON a.family = b.family AND a.bank IS NOT DISTINCT FROM b.bank AND a.field = b.field AND a.key IS NOT DISTINCT FROM b.key),
ck AS (SELECT central, family, bool_and(ok) AS matches, count(*) FILTER (WHERE NOT ok) AS n_different, count(*) AS n_entries FROM j GROUP BY central, family) """


def _metadata_checks(spark, sf):
    cap = prefix_cap(spark, sf)
    sums = _once(spark, sf, "merged_sums", lambda: A.merge_stats(_stats(spark, sf), "client_id"))
    merged = _once(spark, sf, "merged_record", lambda: A.merged_metadata(sums, _CATV, cap, "raw", "zscore"))
    out = None
    for name, c in (("same cap", cap), ("cap of five", 5)):
        events = mapped(spark, sf)
        target = V.fit_target(V.target_population(events, "event_index", "n_events", c, "remaining_time"), "raw", "zscore")
        words = vocab(spark, sf).filter(F.col("field").isin(*_CAT))
        central = _once(spark, sf, f"central_record_{name}", lambda: A.metadata_record(
            V.prefix_counts(events, c), V.train_outcome_counts(events), words, scaler(spark, sf), target, c))
        one = A.compare_metadata(merged, central).withColumn("central", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("A05_compare_metadata", _RECORDS + "SELECT central, family, matches, n_different, n_entries FROM ck")
def compare_metadata(spark, sf):
    """The record rebuilt from the clients' sums against centrally fitted ones."""
    return _metadata_checks(spark, sf)


@query("A05_metadata_verdict", _RECORDS + """
SELECT central, bool_and(matches) AS matches, coalesce(string_agg(family, ',' ORDER BY family) FILTER (WHERE NOT matches), '') AS differences FROM ck GROUP BY central""")
def metadata_verdict(spark, sf):
    return A.metadata_verdict(_metadata_checks(spark, sf), ["central"]).withColumn("differences", F.array_join("differences", ","))


_CHECKS = """, j AS (SELECT coalesce(a.client_id, b.client_id) AS run, coalesce(a.family, b.family) AS family,
  coalesce(abs(a.value - b.value) <= greatest(1e-9 * greatest(abs(a.value), abs(b.value)), 1e-9), false) AS near
  FROM ls a FULL JOIN l2 b ON a.client_id = b.client_id AND a.family = b.family AND a.field = b.field AND a.key = b.key),
ck AS (SELECT CASE WHEN family IN ('counts', 'target') THEN 'capped' ELSE 'uncapped' END AS dataset, run, family, bool_and(near) AS matches FROM j GROUP BY run, family) """


def _checks(spark, sf):
    out = A.compare_stats(_stats(spark, sf), _stats(spark, sf, 5), by=["client_id"])
    return out.select(
        F.when(F.col("family").isin("counts", "target"), "capped").otherwise("uncapped").alias("dataset"),
        F.col("client_id").alias("run"), "family", "matches",
    )


@query("A06_check_summary", M + ", " + _stats_sql("ls", CAP) + ", " + _stats_sql("l2", 5) + _CHECKS + """
SELECT family, count(*) FILTER (WHERE matches) AS passed, count(*) FILTER (WHERE NOT matches) AS failed FROM ck GROUP BY family""")
def check_summary(spark, sf):
    return A.check_summary(_checks(spark, sf))


@query("A06_match_summary", M + ", " + _stats_sql("ls", CAP) + ", " + _stats_sql("l2", 5) + _CHECKS + """
, r AS (SELECT dataset, run, bool_and(matches) AS ok, count(*) AS n FROM ck GROUP BY dataset, run)
SELECT dataset, count(*) AS runs, count(*) FILTER (WHERE ok) AS matched, count(*) FILTER (WHERE NOT ok) AS mismatched, CAST(sum(n) AS BIGINT) AS reports,
  bool_and(ok) AS all_match FROM r GROUP BY GROUPING SETS ((dataset), ())""")
def match_summary(spark, sf):
    checks = settle(_checks(spark, sf))
    return A.match_summary(checks, checks.groupBy("dataset", "run").agg(F.count(F.lit(1)).alias("n_reports")))


def _vec_sql(value: str) -> str:
    return (
        "WITH v AS (SELECT label // 4 AS g, CAST(label + 1 AS DOUBLE) AS w, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), "
        "u AS (SELECT *, CASE WHEN x > 0.4 THEN 1.0 ELSE 0.0 END AS c FROM v), "
        f"m AS (SELECT g, i, {value} AS m FROM u GROUP BY g, i) "
        "SELECT g, array_to_string(list(CAST(round(m * 1e6) AS BIGINT) ORDER BY i), ',') AS mean FROM m GROUP BY g"
    )


def _vec_mean(spark, sf, mode):
    df = table(spark, sf, "embeddings").select(
        F.floor(F.col("label") / 4).cast("int").alias("g"), (F.col("label") + 1).alias("w"), F.col("embedding").alias("v"),
        F.transform("embedding", lambda x: F.when(x.cast("double") > 0.4, 1.0).otherwise(0.0)).alias("c"),
    )
    out = A.group_weighted_vector_mean(df, ["g"], "v", "w", mode, "c")
    return out.select("g", F.array_join(F.transform("mean", lambda x: F.round(x * 1e6).cast("long").cast("string")), ",").alias("mean"))


@query("A07_vector_mean_sample", _vec_sql("sum(CAST(x AS DOUBLE) * w) / sum(w)"))
def vector_mean_sample(spark, sf):
    return _vec_mean(spark, sf, "sample")


@query("A07_vector_mean_equal", _vec_sql("avg(CAST(x AS DOUBLE))"))
def vector_mean_equal(spark, sf):
    return _vec_mean(spark, sf, "equal")


@query("A07_vector_mean_contribution", _vec_sql(
    "CASE WHEN sum(c) >= 0.5 THEN sum(CAST(x AS DOUBLE) * c) / CAST(sum(c) AS DOUBLE) ELSE sum(CAST(x AS DOUBLE) * w) / sum(w) END"))
def vector_mean_contribution(spark, sf):
    return _vec_mean(spark, sf, "contribution")
