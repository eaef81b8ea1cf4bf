"""Queries over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.bindings import table, with_
from queries.encoding_queries import CANON, CAP, MAPPED, mapped, prefix_cap
from queries.profile_queries import rounded
from queries.registry import query
from tracemill.operators import encode as V
from tracemill.operators import metrics as M

K = 3


def predictions(spark, sf):
    """One prediction per prefix; scores are plain functions of the event's features."""
    df = mapped(spark, sf).filter(F.col("event_index") < prefix_cap(spark, sf))
    scores = F.array(F.col("remaining_time") / 4e7, F.col("requested_amount_value") / 2.5e5, F.lit(0.9).cast("double"))
    return df.select(
        "dataset_id", "client_id", "split", "case_id", F.col("event_index").alias("label_pos"),
        (F.col("event_index") + 1).alias("prefix_length"), F.col("outcome").alias("y"), scores.alias("scores"),
        "loan_goal", F.col("remaining_time").alias("true_seconds"), (F.col("time_delta") * 1.1 - 864000.0).alias("pred_seconds"),
        F.when(F.col("event_index") == F.col("n_events") - 1, 0).otherwise(1).alias("time_mask"),
    ).withColumns({"p": M.argmax(F.col("scores")), "probs": M.softmax(F.col("scores"))})


PRED = f"""pr AS (SELECT dataset_id, client_id, split, case_id, event_index AS label_pos, event_index + 1 AS prefix_length, outcome AS y, loan_goal,
  remaining_time / 4e7 AS s0, requested_amount_value / 2.5e5 AS s1, CAST(0.9 AS DOUBLE) AS s2, remaining_time AS true_seconds,
  time_delta * CAST(1.1 AS DOUBLE) - 864000 AS pred_seconds, CASE WHEN event_index = n_events - 1 THEN 0 ELSE 1 END AS time_mask, n_events,
  CASE WHEN remaining_time / 4e7 >= greatest(requested_amount_value / 2.5e5, 0.9) THEN 0 WHEN requested_amount_value / 2.5e5 >= 0.9 THEN 1 ELSE 2 END AS p
  FROM mp WHERE event_index < {CAP})"""
P = with_(CANON, MAPPED, PRED)


def per_class_sql(cells: str, p: str = "", classes: int | None = K) -> str:
    """CTEs ``{p}pc`` (per class) and ``{p}hl`` (headline) over ``{cells}`` (grp, y, p, n)."""
    dense = "" if classes is None else f" UNION ALL SELECT grp, c, 0, 0, 0 FROM (SELECT DISTINCT grp FROM {cells}), (SELECT unnest(range(0, {classes})) AS c)"
    return (
        f"{p}fl AS (SELECT grp, y AS c, CASE WHEN y = p THEN n ELSE 0 END AS tp, n AS sup, 0 AS prd FROM {cells} UNION ALL SELECT grp, p, 0, 0, n FROM {cells}{dense}), "
        f"{p}sm AS (SELECT grp, c, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(sup) AS BIGINT) AS sup, CAST(sum(prd) AS BIGINT) AS prd FROM {p}fl GROUP BY grp, c), "
        f"{p}pc AS (SELECT grp, CAST(c AS INTEGER) AS class_id, coalesce(tp / CAST(nullif(prd, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(sup, 0) AS DOUBLE), 0) AS recall, "
        f"coalesce(2 * tp / CAST(nullif(prd + sup, 0) AS DOUBLE), 0) AS f1, sup AS support, tp FROM {p}sm), "
        f"{p}hl AS (SELECT grp, CAST(sum(support) AS BIGINT) AS n, sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, "
        f"avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy FROM {p}pc GROUP BY grp)"
    )


_HL = ["accuracy", "macro_f1", "weighted_f1", "balanced_accuracy"]
_HLR = ", ".join(f"round({c}, 6) AS {c}" for c in _HL)
_CELLS = "cf AS (SELECT {g} AS grp, y, p, count(*) AS n FROM pr GROUP BY ALL)"


@query("M01_confusion", P + ", " + _CELLS.format(g="client_id") + """
, gr AS (SELECT grp, y, p FROM (SELECT DISTINCT grp FROM cf), (SELECT unnest(range(0, 3)) AS y), (SELECT unnest(range(0, 3)) AS p))
SELECT gr.grp AS client_id, CAST(gr.y AS INTEGER) AS y, CAST(gr.p AS INTEGER) AS p, coalesce(n, 0) AS n FROM gr LEFT JOIN cf ON cf.grp = gr.grp AND cf.y = gr.y AND cf.p = gr.p""")
def confusion(spark, sf):
    return M.confusion(predictions(spark, sf), "y", "p", K, ["client_id"])


@query("M02_per_class", P + ", " + _CELLS.format(g="client_id") + ", " + per_class_sql("cf") + """
SELECT grp AS client_id, class_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, tp FROM pc""")
def per_class(spark, sf):
    return rounded(M.per_class(M.confusion(predictions(spark, sf), "y", "p", K, ["client_id"]), ["client_id"]))


@query("M03_headline", P + ", " + _CELLS.format(g="split") + ", " + per_class_sql("cf") + f"SELECT grp AS split, n, {_HLR} FROM hl")
def headline(spark, sf):
    return rounded(M.outcome_metrics(predictions(spark, sf), "y", "p", K, ["split"]))


_AUC = """, e AS (SELECT exp(s0 - m) AS e0, exp(s1 - m) AS e1, exp(s2 - m) AS e2, {g} AS grp, y FROM (SELECT *, greatest(s0, s1, s2) AS m FROM pr)),
x AS (SELECT grp, y, c, (CASE c WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END) / (e0 + e1 + e2) AS s FROM e, (SELECT unnest(range(0, 3)) AS c)),
h AS (SELECT grp, c, s, count(*) FILTER (WHERE y = c) AS pos, count(*) FILTER (WHERE y <> c) AS neg FROM x GROUP BY grp, c, s),
w AS (SELECT *, sum(neg) OVER (PARTITION BY grp, c ORDER BY s) - neg / 2 AS b FROM h),
au AS (SELECT grp, c, sum(pos * b) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) AS auc FROM w GROUP BY grp, c) """


@query("M04_macro_auc_ovr", P + _AUC.format(g="client_id") + "SELECT grp AS client_id, round(avg(auc), 6) AS macro_auc_ovr FROM au GROUP BY grp")
def macro_auc(spark, sf):
    return rounded(M.macro_auc(predictions(spark, sf), "y", "probs", K, ["client_id"]))


@query("M04_class_auc", P + _AUC.format(g="split") + "SELECT grp AS split, CAST(c AS INTEGER) AS class_id, round(auc, 6) AS auc FROM au")
def class_auc(spark, sf):
    return rounded(M.class_auc(predictions(spark, sf), "y", "probs", K, ["split"]))


def next_predictions(spark, sf):
    scores = F.slice("embedding", 1, 10)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("y"), (F.col("label") % 3).alias("grp"), M.argmax(scores).alias("p"), M.top_ids(scores).alias("top"),
        (F.col("embedding")[10] > 0).cast("int").alias("mask"), scores.alias("scores"), F.col("embedding").alias("embedding"),
    )


_NEXT = """WITH v AS (SELECT vec_id, label AS y, label % 3 AS grp, CASE WHEN embedding[11] > 0 THEN 1 ELSE 0 END AS mask, embedding[1:10] AS sc FROM embeddings),
u AS (SELECT *, unnest(sc) AS s, unnest(range(0, 10)) AS i FROM v),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rn FROM u),
nx AS (SELECT vec_id, any_value(y) AS y, any_value(grp) AS grp, any_value(mask) AS mask, max(i) FILTER (WHERE rn = 1) AS p, list(i ORDER BY rn) FILTER (WHERE rn <= 3) AS top FROM t GROUP BY vec_id)"""


@query("M05_next_label_metrics", _NEXT + ", cf AS (SELECT grp, y, p, count(*) AS n FROM nx WHERE mask = 1 GROUP BY ALL), " + per_class_sql("cf", classes=None) + """
SELECT b.grp, b.n, round(top1, 6) AS top1_accuracy, round(top3, 6) AS top3_accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1
FROM (SELECT grp, count(*) AS n, avg(CASE WHEN p = y THEN 1 ELSE 0 END) AS top1, avg(CASE WHEN list_contains(top, y) THEN 1 ELSE 0 END) AS top3 FROM nx WHERE mask = 1 GROUP BY grp) b JOIN hl ON hl.grp = b.grp""")
def next_label_metrics(spark, sf):
    return rounded(M.next_label_metrics(next_predictions(spark, sf), "y", "p", "top", "mask", ["grp"]))


@query("M06_duration_metrics", P + """
SELECT client_id, count(*) FILTER (WHERE time_mask = 1) AS n, round(avg(abs(greatest(pred_seconds, 0) - true_seconds)) FILTER (WHERE time_mask = 1), 3) AS mae,
  round(sqrt(avg(pow(greatest(pred_seconds, 0) - true_seconds, 2)) FILTER (WHERE time_mask = 1)), 3) AS rmse FROM pr GROUP BY client_id""")
def duration_metrics(spark, sf):
    return rounded(M.duration_metrics(predictions(spark, sf), "true_seconds", "pred_seconds", "time_mask", ["client_id"]), 3)


@query("M07_prediction_frame", _NEXT + """
, o AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[12] AS DOUBLE) AS r FROM embeddings),
e AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM o)
SELECT e.vec_id, CASE WHEN a >= greatest(b, c) THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS outcome_pred, round(ea / (ea + eb + ec), 6) AS prob_0,
  round(eb / (ea + eb + ec), 6) AS prob_1, round(ec / (ea + eb + ec), 6) AS prob_2, CAST(p AS INTEGER) AS next_pred, array_to_string(top, ',') AS next_top3,
  round(exp(r * 2 + 1) - 1, 6) AS remaining_pred_raw, round(greatest(exp(r * 2 + 1) - 1, 0.0), 6) AS remaining_pred_clamped FROM e JOIN nx ON nx.vec_id = e.vec_id""")
def prediction_frame(spark, sf):
    df = table(spark, sf, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 3).alias("o"), F.slice("embedding", 1, 10).alias("n"), F.col("embedding")[11].alias("r"))
    target = spark.createDataFrame([("log", 1.0, 2.0)], "transform string, center double, scale double")
    out = M.prediction_frame(df, "o", "n", "r", target, ["vec_id"])
    out = out.select(
        "vec_id", "outcome_pred", *[F.col("outcome_probs")[i].alias(f"prob_{i}") for i in range(3)], "next_pred",
        F.array_join("next_top3", ",").alias("next_top3"), "remaining_pred_raw", "remaining_pred_clamped",
    )
    return rounded(out)


@query("M08_metrics_by_prefix_bucket", P + """
, bk AS (SELECT *, CASE WHEN prefix_length = 1 THEN '1' WHEN prefix_length <= 5 THEN '2-5' WHEN prefix_length <= 10 THEN '6-10' WHEN prefix_length <= 20 THEN '11-20' ELSE '21+' END AS bucket FROM pr),
cf AS (SELECT bucket AS grp, y, p, count(*) AS n FROM bk GROUP BY ALL), """ + per_class_sql("cf") + f"""
, d AS (SELECT bucket, avg(abs(greatest(pred_seconds, 0) - true_seconds)) FILTER (WHERE time_mask = 1) AS mae FROM bk GROUP BY bucket)
SELECT b.bucket, coalesce(n, 0) AS n, {_HLR}, round(mae, 3) AS mae FROM (VALUES ('1'), ('2-5'), ('6-10'), ('11-20'), ('21+')) b(bucket) LEFT JOIN hl ON hl.grp = b.bucket LEFT JOIN d ON d.bucket = b.bucket""")
def metrics_by_prefix_bucket(spark, sf):
    out = M.metrics_by_prefix_bucket(predictions(spark, sf), "y", "p", K, "true_seconds", "pred_seconds", "time_mask")
    return rounded(out, mae=3)


@query("M09_metrics_by_owner", P + ", cf AS (SELECT client_id AS grp, y, p, count(*) AS n FROM pr GROUP BY ALL UNION ALL SELECT 'pooled', y, p, count(*) FROM pr GROUP BY y, p), "
       + per_class_sql("cf") + f"SELECT grp AS client_id, n, {_HLR} FROM hl")
def metrics_by_owner(spark, sf):
    return rounded(M.metrics_by_owner(predictions(spark, sf), "y", "p", K))


def _dist(x: str, d: int = 4) -> str:
    return (
        f"count({x}) AS count, round(avg({x}), {d}) AS mean, round(quantile_cont({x}, 0.5), {d}) AS median, round(quantile_cont({x}, 0.1), {d}) AS p10, "
        f"round(quantile_cont({x}, 0.25), {d}) AS p25, round(quantile_cont({x}, 0.75), {d}) AS p75, round(quantile_cont({x}, 0.9), {d}) AS p90"
    )


@query("M10_distribution_summary", P + f"SELECT client_id, {_dist('pred_seconds', 3)} FROM pr GROUP BY client_id")
def distribution_summary(spark, sf):
    return rounded(M.distribution_summary(predictions(spark, sf), "pred_seconds", ["client_id"]), 3)


_POP = f"pop AS (SELECT remaining_time AS s FROM mp WHERE split = 'train' AND event_index < {CAP} AND event_index < n_events - 1 AND remaining_time > 0)"


@query("M11_target_diagnostics", with_(CANON, MAPPED, _POP) + f"""
, tp AS (SELECT avg(ln(1 + s)) AS c, stddev_pop(ln(1 + s)) AS d FROM pop),
u AS (SELECT 'seconds' AS unit, s AS x FROM pop UNION ALL SELECT 'model_units', (ln(1 + s) - c) / d FROM pop, tp)
SELECT unit, {_dist('x')}, 'log' AS transform, 'zscore' AS scaling, (SELECT round(c, 6) FROM tp) AS center, (SELECT round(d, 6) FROM tp) AS scale FROM u GROUP BY unit""")
def target_diagnostics(spark, sf):
    pop = V.target_population(mapped(spark, sf), "event_index", "n_events", prefix_cap(spark, sf), "remaining_time").filter("seconds > 0")
    out = M.target_diagnostics(pop, V.fit_target(pop, "log", "zscore"))
    return rounded(out, 4, center=6, scale=6).withColumns({c: F.col(c) + 0.0 for c in ("mean", "median")})


@query("M12_prediction_diagnostics", P + """
SELECT round(avg(greatest(pred_seconds, 0)), 3) AS pred_mean_seconds, round(quantile_cont(greatest(pred_seconds, 0), 0.5), 3) AS pred_median_seconds,
  round(100 * avg(CASE WHEN pred_seconds < 0 THEN 1 ELSE 0 END), 6) AS percent_clamped_to_zero FROM pr WHERE time_mask = 1""")
def prediction_diagnostics(spark, sf):
    return rounded(M.prediction_diagnostics(predictions(spark, sf), "pred_seconds", "time_mask"), 3, percent_clamped_to_zero=6)


@query("M13_baseline_diagnostics", P + ", " + _POP + """
, md AS (SELECT CAST(quantile_disc(s, 0.5) AS DOUBLE) AS tr FROM pop), te AS (SELECT quantile_cont(true_seconds, 0.5) AS ts FROM pr WHERE time_mask = 1)
SELECT round(max(tr), 3) AS train_median_seconds, round(avg(abs(true_seconds - tr)), 3) AS train_median_mae_seconds, round(max(ts), 3) AS test_median_seconds,
  round(avg(abs(true_seconds - ts)), 3) AS test_median_mae_seconds FROM pr, md, te WHERE time_mask = 1""")
def baseline_diagnostics(spark, sf):
    pop = V.target_population(mapped(spark, sf), "event_index", "n_events", prefix_cap(spark, sf), "remaining_time")
    median = V.fit_target(pop, "raw", "raw").select("median_seconds")
    return rounded(M.baseline_diagnostics(predictions(spark, sf), "true_seconds", "time_mask", median), 3)


def _marked(spark, sf):
    return M.mark_final_prefix(predictions(spark, sf), mapped(spark, sf))


@query("M14_mark_final_prefix", P + "SELECT case_id, prefix_length, label_pos = n_events - 1 AS is_final FROM pr")
def mark_final_prefix(spark, sf):
    return _marked(spark, sf).select("case_id", "prefix_length", "is_final")


_MET = ["macro_f1", "weighted_f1", "balanced_accuracy"]


@query("M15_final_prefix_inflation", P + """
, mk AS (SELECT *, label_pos = n_events - 1 AS fin FROM pr),
cf AS (SELECT client_id AS grp, y, p, count(*) AS n FROM mk GROUP BY ALL UNION ALL SELECT 'all', y, p, count(*) FROM mk GROUP BY y, p),
cg AS (SELECT client_id AS grp, y, p, count(*) AS n FROM mk WHERE NOT fin GROUP BY ALL UNION ALL SELECT 'all', y, p, count(*) FROM mk WHERE NOT fin GROUP BY y, p), """
       + per_class_sql("cf", "a") + ", " + per_class_sql("cg", "b") + """
, ct AS (SELECT client_id AS grp, fin, y = p AS ok FROM mk UNION ALL SELECT 'all', fin, y = p FROM mk),
cc AS (SELECT grp, count(*) AS n_prefixes, count(*) FILTER (WHERE fin) AS n_final, avg(CASE WHEN ok THEN 1 ELSE 0 END) FILTER (WHERE fin) AS fa FROM ct GROUP BY grp)
SELECT cc.grp AS scope, n_prefixes, n_final, round(n_final / n_prefixes, 6) AS final_share, round(fa, 6) AS final_accuracy, """
       + ", ".join(f"round(ahl.{m}, 6) AS {m}, round(bhl.{m}, 6) AS {m}_excluding_final, round(ahl.{m} - bhl.{m}, 6) + 0.0 AS {m}_inflation" for m in _MET)
       + " FROM cc JOIN ahl ON ahl.grp = cc.grp JOIN bhl ON bhl.grp = cc.grp")
def final_prefix_inflation(spark, sf):
    """Clients stand in for the source datasets of a joint run."""
    out = rounded(M.final_prefix_inflation(_marked(spark, sf), "y", "p", K, "client_id"))
    return out.withColumns({f"{m}_inflation": F.col(f"{m}_inflation") + 0.0 for m in _MET})


_RUNSQL = """, rr AS (SELECT client_id AS run_name, loan_goal AS run, avg(CASE WHEN y = p THEN 1 ELSE 0 END) AS raw,
  avg(CASE WHEN y = p THEN 1 ELSE 0 END) FILTER (WHERE label_pos <> n_events - 1) AS cor FROM pr GROUP BY ALL),
pp AS (SELECT l.run_name, l.run AS left_run, r.run AS right_run, l.raw - r.raw AS raw_delta, l.cor - r.cor AS corrected_delta
  FROM rr l JOIN rr r ON l.run_name = r.run_name AND l.run < r.run) """


def _run_scores(spark, sf):
    ok = (F.col("y") == F.col("p")).cast("int")
    return _marked(spark, sf).groupBy(F.col("client_id").alias("run_name"), F.col("loan_goal").alias("run")).agg(
        F.avg(ok).alias("raw"), F.avg(F.when(~F.col("is_final"), ok)).alias("cor"))


@query("M16_run_pairs", P + _RUNSQL + """
SELECT run_name, left_run, right_run, round(raw_delta, 6) + 0.0 AS raw_delta, round(corrected_delta, 6) + 0.0 AS corrected_delta, (raw_delta > 0) = (corrected_delta > 0) AS sign_kept FROM pp""")
def run_pairs(spark, sf):
    pairs = M.run_pairs(_run_scores(spark, sf), ["run_name"], "run", "raw", "cor")
    return rounded(pairs).withColumns({c: F.col(c) + 0.0 for c in ("raw_delta", "corrected_delta")})


@query("M16_sign_agreement", P + _RUNSQL + """
SELECT count(*) AS comparisons, count(*) FILTER (WHERE (raw_delta > 0) = (corrected_delta > 0)) AS kept,
  count(*) FILTER (WHERE (raw_delta > 0) <> (corrected_delta > 0)) AS flipped FROM pp""")
def sign_agreement(spark, sf):
    return M.sign_agreement(_run_scores(spark, sf), ["run_name"], "run", "raw", "cor")


@query("M17_owner_lookup", P + "SELECT case_id, prefix_length, client_id FROM pr")
def owner_lookup(spark, sf):
    pooled = predictions(spark, sf).drop("client_id")
    owners = mapped(spark, sf).select("dataset_id", "case_id", "client_id")
    return M.owner_lookup(pooled, owners).select("case_id", "prefix_length", "client_id")


@query("M18_masked_means", P + """
, q AS (SELECT client_id, count(*) AS n, avg(CASE WHEN y = p THEN 0 ELSE 1 END) AS a, coalesce(avg(abs(pred_seconds - true_seconds) / 1e6) FILTER (WHERE time_mask = 1), 0) AS b FROM pr GROUP BY client_id)
SELECT client_id, n, round(a, 6) AS mean_loss_outcome, round(b, 6) AS mean_loss_time, round(a * 1.0 + b * 0.5, 6) AS weighted_total FROM q""")
def masked_means(spark, sf):
    df = predictions(spark, sf).withColumns({
        "loss_outcome": (F.col("y") != F.col("p")).cast("int"), "loss_time": F.abs(F.col("pred_seconds") - F.col("true_seconds")) / 1e6})
    return rounded(M.masked_means(df, {"loss_outcome": (None, 1.0), "loss_time": ("time_mask", 0.5)}, ["client_id"]))
