"""Queries over run tables and run reports derived from the order lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queries.bindings import data_key, table
from queries.profile_queries import rounded
from queries.registry import query
from tracemill.operators import runs as R
from tracemill.session import shared_folder
from tracemill.sources.reports import read_run_reports

KEY = ["script_id", "dataset", "run_name", "regime", "strategy", "run_bank", "use_dp", "dp_target_epsilon"]


def _lines(spark, sf):
    """Order lines tagged with the run and bank they stand for."""
    tx = F.round(F.col("l_tax") * 100).cast("int")
    letter = F.when(F.col("l_discount") <= 0.03, "A").when(F.col("l_discount") <= 0.06, "B").otherwise("C")
    dataset = F.when(F.col("l_returnflag") == "R", "alpha").when(F.col("l_returnflag") == "A", "beta").otherwise("joint")
    source = F.when(F.col("l_quantity") <= 25, "alpha").otherwise("beta")
    bank = F.when(F.col("l_returnflag") == "N", F.concat_ws(":", source, letter)).otherwise(letter)
    central = tx <= 1
    return table(spark, sf, "lineitem").select(
        F.when(central, "central").otherwise("federated").alias("script_id"),
        dataset.alias("dataset"),
        F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("run_name"),
        F.when(tx == 0, "centralized").when(tx == 1, "local").when(tx <= 5, "federated").otherwise("federated_dp").alias("regime"),
        F.when(central, "").when(F.col("l_linestatus") == "F", "fedavg").otherwise("fedprox").alias("strategy"),
        F.when(tx == 1, bank).otherwise("").alias("run_bank"),
        (tx >= 6).alias("use_dp"),
        F.when(tx >= 6, tx.cast("double")).alias("dp_target_epsilon"),
        bank.alias("bank"),
        F.when(F.col("l_returnflag") == "N", source).otherwise(dataset).alias("source_dataset"),
        "l_quantity", "l_extendedprice", "l_discount",
    )


def _facts():
    big, dear = F.col("l_quantity") > 25, F.col("l_extendedprice") > 50000
    return [
        (F.avg("l_quantity") / 50).alias("outcome_macro_f1"),
        (F.avg("l_discount") * 10).alias("next_activity_top1"),
        F.avg("l_extendedprice").alias("rt_mae"),
        F.count(F.lit(1)).alias("n_prefixes"),
        F.least(F.count_if(F.col("l_quantity") == 50), F.lit(20)).cast("int").alias("best_round"),
        F.array(
            F.array(F.count_if(~big & ~dear), F.count_if(~big & dear)), F.array(F.count_if(big & ~dear), F.count_if(big & dear))
        ).alias("matrix"),
    ]


def runs(spark, sf):
    out = _lines(spark, sf).groupBy(*KEY).agg(*_facts()).drop("matrix")
    return out.withColumnRenamed("run_bank", "bank").withColumns(
        {"max_rounds": F.lit(20), "best_epoch": F.lit(None).cast("int"), "max_epochs": F.lit(None).cast("int")}
    )


def banks(spark, sf):
    return _lines(spark, sf).groupBy(*KEY, "bank", "source_dataset").agg(*_facts()).drop("matrix", "best_round", "run_bank")


_LN = """WITH ln AS (SELECT *, CAST(round(l_tax * 100) AS INTEGER) AS tx, CASE WHEN l_discount <= 0.03 THEN 'A' WHEN l_discount <= 0.06 THEN 'B' ELSE 'C' END AS letter,
  CASE l_returnflag WHEN 'R' THEN 'alpha' WHEN 'A' THEN 'beta' ELSE 'joint' END AS dataset, CASE WHEN l_quantity <= 25 THEN 'alpha' ELSE 'beta' END AS src FROM lineitem),
tg AS (SELECT CASE WHEN tx <= 1 THEN 'central' ELSE 'federated' END AS script_id, dataset, 'r' || l_linenumber AS run_name,
  CASE WHEN tx = 0 THEN 'centralized' WHEN tx = 1 THEN 'local' WHEN tx <= 5 THEN 'federated' ELSE 'federated_dp' END AS regime,
  CASE WHEN tx <= 1 THEN '' WHEN l_linestatus = 'F' THEN 'fedavg' ELSE 'fedprox' END AS strategy,
  CASE WHEN tx = 1 THEN CASE WHEN l_returnflag = 'N' THEN src || ':' || letter ELSE letter END ELSE '' END AS run_bank,
  tx >= 6 AS use_dp, CASE WHEN tx >= 6 THEN CAST(tx AS DOUBLE) END AS dp_target_epsilon,
  CASE WHEN l_returnflag = 'N' THEN src || ':' || letter ELSE letter END AS bank, CASE WHEN l_returnflag = 'N' THEN src ELSE dataset END AS source_dataset,
  l_quantity, l_extendedprice, l_discount FROM ln),
rn AS (SELECT script_id, dataset, run_name, regime, strategy, run_bank AS bank, use_dp, dp_target_epsilon, avg(l_quantity) / 50 AS outcome_macro_f1, avg(l_discount) * 10 AS next_activity_top1,
  avg(l_extendedprice) AS rt_mae, count(*) AS n_prefixes, CAST(least(count(*) FILTER (WHERE l_quantity = 50), 20) AS INTEGER) AS best_round FROM tg GROUP BY ALL),
bk AS (SELECT script_id, dataset, run_name, regime, strategy, use_dp, dp_target_epsilon, bank, source_dataset, avg(l_quantity) / 50 AS outcome_macro_f1, avg(l_discount) * 10 AS next_activity_top1,
  avg(l_extendedprice) AS rt_mae, count(*) AS n_prefixes, run_bank FROM tg GROUP BY ALL) """


def _report_frame(spark, sf):
    """Nested run reports; banks of a run are at most six map entries."""
    block = lambda seconds: F.struct(
        F.when(F.col("regime") != "local", F.col("n_prefixes")).alias("n_prefixes"),
        F.struct(F.col("outcome_macro_f1").alias("macro_f1"), F.col("matrix").alias("confusion_matrix")).alias("outcome"),
        F.struct(F.col("next_activity_top1").alias("top1_accuracy")).alias("next_activity"),
        F.struct(F.when(~seconds, F.col("rt_mae")).alias("mae"), F.when(seconds, F.col("rt_mae")).alias("mae_seconds")).alias("remaining_time"),
    )
    lines = _lines(spark, sf)
    fed = F.col("script_id") == "federated"
    pooled = lines.groupBy(*KEY).agg(*_facts()).withColumn("test", block(fed))
    per_bank = (
        lines.filter("regime <> 'local'").groupBy(*KEY, "bank").agg(*_facts())
        .withColumn("b", block(fed)).groupBy(*KEY)
        .agg(F.map_from_entries(F.collect_list(F.struct("bank", "b"))).alias("per_bank_test"))
    )
    key = [c for c in KEY if c != "dp_target_epsilon"]
    on = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in key] + [F.col("p.dp_target_epsilon").eqNullSafe(F.col("q.dp_target_epsilon"))]
    both = pooled.alias("p").join(per_bank.alias("q"), on, "left").select("p.*", "q.per_bank_test")
    return both.select(
        F.when(~fed, "baselines").when(F.col("use_dp"), "privacy").otherwise("federated").alias("subtree"),
        "script_id",
        F.struct(
            "dataset", "run_name", F.when(~fed, F.col("regime")).alias("regime"), "strategy", F.nullif("run_bank", F.lit("")).alias("bank"),
            F.when(F.col("use_dp"), "True").otherwise("false").alias("use_dp"), "dp_target_epsilon", F.lit(20).alias("max_rounds"),
        ).alias("config"),
        F.struct("test", "per_bank_test").alias("metrics"),
        F.struct(F.struct("best_round").alias("best_round")).alias("diagnostics"),
    )


_WRITTEN: dict[tuple, str] = {}


def reports(spark, sf):
    """Reports written as JSON once per session and read back through the source."""
    key = data_key(spark, sf)
    if key not in _WRITTEN:
        root = f"{shared_folder(spark).rstrip('/')}/tracemill/reports-{uuid.uuid4().hex}"
        _report_frame(spark, sf).write.partitionBy("subtree").json(root)
        _WRITTEN[key] = root
    trees = [f"subtree={s}" for s in ("baselines", "federated", "privacy")]
    return read_run_reports(spark, _WRITTEN[key], trees, ["secure"], "*.json", multi_line=False)


@query("S08_read_run_reports", _LN + """
SELECT script_id, CASE WHEN script_id = 'central' THEN 'subtree=baselines' WHEN use_dp THEN 'subtree=privacy' ELSE 'subtree=federated' END AS subtree, count(*) AS n_reports FROM rn GROUP BY ALL""")
def read_reports(spark, sf):
    return reports(spark, sf).groupBy("script_id", F.substring_index("report_path", "/", 1).alias("subtree")).agg(F.count(F.lit(1)).alias("n_reports"))


_M = ["outcome_macro_f1", "next_activity_top1", "rt_mae"]
_MR = ", ".join(f"round({c}, {5 if c == 'rt_mae' else 8}) AS {c}" for c in _M)


@query("R01_run_rows", _LN + f"SELECT script_id, dataset, run_name, regime, strategy, bank, use_dp, dp_target_epsilon, {_MR}, n_prefixes, best_round, 20 AS max_rounds FROM rn")
def run_rows(spark, sf):
    out = R.run_rows(reports(spark, sf))
    return rounded(out.select(
        "script_id", "dataset", "run_name", "regime", "strategy", "bank", "use_dp", "dp_target_epsilon", *_M, "n_prefixes", "best_round", "max_rounds"), 8, rt_mae=5)


@query("R02_bank_rows", _LN + f"SELECT script_id, dataset, run_name, regime, strategy, bank, source_dataset, {_MR}, n_prefixes FROM bk")
def bank_rows(spark, sf):
    out = R.bank_rows(reports(spark, sf))
    return rounded(out.select("script_id", "dataset", "run_name", "regime", "strategy", "bank", "source_dataset", *_M, "n_prefixes"), 8, rt_mae=5)


_RUN = ["dataset", "run_name", "regime", "strategy"]


@query("R03_spreads", _LN + """
SELECT dataset, run_name, regime, strategy, round(min(outcome_macro_f1), 6) AS worst_f1, round(max(outcome_macro_f1), 6) AS best_f1, round(max(outcome_macro_f1) - min(outcome_macro_f1), 6) AS f1_spread,
  round(max(rt_mae), 3) AS worst_mae, round(min(rt_mae), 3) AS best_mae, round(max(rt_mae) - min(rt_mae), 3) AS mae_spread FROM bk GROUP BY dataset, run_name, regime, strategy""")
def spreads(spark, sf):
    return rounded(R.spreads(banks(spark, sf), _RUN), 6, worst_mae=3, best_mae=3, mae_spread=3)


_LAYOUT = {
    "alpha": [(f"r{i}", ["A", "B", "C"]) for i in range(1, 9)],
    "joint": [(f"r{i}", ["alpha:A", "beta:A", "gamma:A"]) for i in range(1, 4)],
}


@query("R04_missing_runs", _LN + ", ex(script_id, dataset, run_name, regime, strategy, bank) AS (VALUES " + ", ".join(
    f"('{s}', '{d}', '{r}', '{g}', '{t}', '{b}')" for d, rows in _LAYOUT.items() for r, bb in rows
    for s, g, t, b in [("central", "centralized", "", ""), *[("central", "local", "", x) for x in bb], ("federated", "", "fedavg", ""), ("federated", "", "fedprox", "")]
) + """), sn AS (SELECT script_id, dataset, run_name, CASE WHEN script_id = 'central' THEN regime ELSE '' END AS regime, strategy, bank FROM rn WHERE NOT use_dp)
SELECT * FROM ex EXCEPT SELECT * FROM sn""")
def missing_runs(spark, sf):
    return R.missing_runs(R.expected_runs(spark, _LAYOUT), runs(spark, sf))


@query("R05_quality_flags", _LN + """
, q AS (SELECT dataset, run_name, regime, strategy, dp_target_epsilon, bank AS run_bank, CASE WHEN best_round >= 20 THEN CAST('nan' AS DOUBLE) ELSE outcome_macro_f1 END AS f FROM rn),
b AS (SELECT * FROM bk),
s AS (SELECT dataset, run_name, regime, strategy, count(*) AS k, count(DISTINCT source_dataset) FILTER (WHERE source_dataset IN ('alpha', 'gamma')) AS n FROM b GROUP BY ALL),
j AS (SELECT q.*, s.k, s.n FROM q LEFT JOIN s USING (dataset, run_name, regime, strategy))
SELECT dataset, run_name, regime, strategy, '' AS bank, 'not_finite' AS flag, count(*) AS n FROM j WHERE isnan(f) GROUP BY ALL
UNION ALL SELECT dataset, run_name, regime, strategy, '', 'no_bank_rows', count(*) FROM j WHERE regime <> 'local' AND k IS NULL GROUP BY ALL
UNION ALL SELECT dataset, run_name, regime, strategy, '', 'incomplete_sources', count(*) FROM j WHERE regime <> 'local' AND dataset = 'joint' AND k IS NOT NULL AND n < 2 GROUP BY ALL
UNION ALL SELECT dataset, run_name, regime, strategy, bank, 'zero_prefixes', count(*) FROM b WHERE n_prefixes = 0 GROUP BY ALL
UNION ALL SELECT dataset, run_name, regime, strategy, bank, 'low_accuracy', count(*) FROM b WHERE next_activity_top1 < 0.45 GROUP BY ALL""")
def quality_flags(spark, sf):
    r = runs(spark, sf).withColumn(
        "outcome_macro_f1", F.when(F.col("best_round") >= 20, F.lit(float("nan"))).otherwise(F.col("outcome_macro_f1"))
    )
    flags = R.quality_flags(r, banks(spark, sf), _RUN, ["alpha", "gamma"], low=0.45)
    return flags.groupBy(*_RUN, "bank", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("R06_top_rows", _LN + """
(SELECT 'best' AS side, dataset, run_name, strategy, dp_target_epsilon, round(rt_mae, 3) AS rt_mae FROM rn WHERE script_id = 'federated' ORDER BY rn.rt_mae, dataset, run_name LIMIT 5)
UNION ALL (SELECT 'worst', dataset, run_name, strategy, dp_target_epsilon, round(rt_mae, 3) FROM rn WHERE script_id = 'federated' ORDER BY rn.rt_mae DESC, dataset, run_name LIMIT 5)""")
def top_rows(spark, sf):
    fed = runs(spark, sf).filter("script_id = 'federated'")
    out = None
    for side, desc in (("best", False), ("worst", True)):
        one = R.top_rows(fed, "rt_mae", 5, desc, ["dataset", "run_name"]).withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("side", "dataset", "run_name", "strategy", "dp_target_epsilon", "rt_mae"), 3)


@query("R07_delta_vs_reference", _LN + """
, p AS (SELECT *, row_number() OVER (PARTITION BY dataset, run_name ORDER BY outcome_macro_f1 DESC, strategy) AS k FROM rn WHERE script_id = 'federated' AND NOT use_dp)
SELECT c.dataset, c.run_name, p.strategy AS best_strategy, round(c.outcome_macro_f1, 6) AS central_f1, round(p.outcome_macro_f1, 6) AS federated_f1,
  round(p.outcome_macro_f1 - c.outcome_macro_f1, 6) + 0.0 AS delta_f1, round(c.rt_mae, 3) AS central_mae, round(p.rt_mae, 3) AS federated_mae, round(p.rt_mae - c.rt_mae, 3) + 0.0 AS delta_mae
FROM rn c JOIN p ON p.dataset = c.dataset AND p.run_name = c.run_name AND p.k = 1 WHERE c.regime = 'centralized'""")
def delta_vs_reference(spark, sf):
    return rounded(R.delta_vs_reference(runs(spark, sf)), 6, central_mae=3, federated_mae=3, delta_mae=3)


@query("R08_strategy_delta", _LN + """
SELECT a.dataset, a.run_name, round(a.outcome_macro_f1, 6) AS fedavg_f1, round(b.outcome_macro_f1, 6) AS fedprox_f1, round(a.rt_mae, 3) AS fedavg_mae, round(b.rt_mae, 3) AS fedprox_mae,
  round(b.outcome_macro_f1 - a.outcome_macro_f1, 6) + 0.0 AS delta_f1, round(b.rt_mae - a.rt_mae, 3) + 0.0 AS delta_mae
FROM rn a JOIN rn b ON a.dataset = b.dataset AND a.run_name = b.run_name WHERE a.script_id = 'federated' AND b.script_id = 'federated' AND NOT a.use_dp AND NOT b.use_dp AND a.strategy = 'fedavg' AND b.strategy = 'fedprox'""")
def strategy_delta(spark, sf):
    return rounded(R.strategy_delta(runs(spark, sf)), 6, fedavg_mae=3, fedprox_mae=3, delta_mae=3)


@query("R09_source_balance", _LN + """
, s AS (SELECT run_name, regime, strategy, source_dataset, count(*) AS banks, CAST(sum(n_prefixes) AS DOUBLE) AS n_prefixes, avg(outcome_macro_f1) AS f, avg(next_activity_top1) AS t, avg(rt_mae) AS m
  FROM bk WHERE dataset = 'joint' GROUP BY ALL)
SELECT run_name, regime, strategy, source_dataset, banks, n_prefixes, round(n_prefixes / sum(n_prefixes) OVER (PARTITION BY run_name, regime, strategy), 6) AS prefix_share,
  round(f, 6) AS mean_f1, round(t, 6) AS mean_top1, round(m, 3) AS mean_mae FROM s""")
def source_balance(spark, sf):
    return rounded(R.source_balance(banks(spark, sf)), 6, mean_mae=3)


@query("R10_fairness_rank", _LN + """
SELECT dataset, run_name, regime, strategy, round(max(outcome_macro_f1) - min(outcome_macro_f1), 6) AS f1_spread, round(max(rt_mae) - min(rt_mae), 3) AS mae_spread
FROM bk GROUP BY dataset, run_name, regime, strategy ORDER BY max(outcome_macro_f1) - min(outcome_macro_f1) DESC, max(rt_mae) - min(rt_mae) DESC LIMIT 10""")
def fairness_rank(spark, sf):
    out = R.fairness_rank(R.spreads(banks(spark, sf), _RUN), 10, _RUN)
    return rounded(out.select(*_RUN, "f1_spread", "mae_spread"), 6, mae_spread=3)


@query("R11_at_budget", _LN + "SELECT dataset, run_name, regime, strategy, bank, best_round FROM rn WHERE NOT use_dp AND best_round >= 20")
def at_budget(spark, sf):
    return R.at_budget(runs(spark, sf)).select(*_RUN, "bank", "best_round")


_LOSS = """, ls AS (SELECT r.dataset, r.run_name, r.strategy, r.dp_target_epsilon, (b.outcome_macro_f1 - r.outcome_macro_f1) / abs(b.outcome_macro_f1) * 100 AS fl,
  (r.rt_mae - b.rt_mae) / abs(b.rt_mae) * 100 AS ml FROM rn r JOIN rn b ON b.dataset = r.dataset AND b.run_name = r.run_name AND b.script_id = 'federated' AND NOT b.use_dp AND b.strategy = 'fedprox'
  WHERE r.script_id = 'federated' AND r.use_dp) """
_LM = {"outcome_macro_f1": False, "rt_mae": True}


@query("R12_relative_loss", _LN + _LOSS + "SELECT dataset, run_name, strategy, dp_target_epsilon, round(fl, 5) + 0.0 AS outcome_macro_f1_loss, round(ml, 5) + 0.0 AS rt_mae_loss FROM ls")
def relative_loss(spark, sf):
    return rounded(R.relative_loss(runs(spark, sf), _LM), 5)


@query("R12_mean_loss", _LN + _LOSS + "SELECT dp_target_epsilon, count(*) AS runs, round(avg(fl), 5) + 0.0 AS outcome_macro_f1_loss, round(avg(ml), 5) + 0.0 AS rt_mae_loss FROM ls GROUP BY dp_target_epsilon")
def mean_loss(spark, sf):
    return rounded(R.mean_loss(R.relative_loss(runs(spark, sf), _LM), list(_LM)), 5)


@query("R13_append_averages", _LN + """
, b AS (SELECT dataset, run_name, bank, n_prefixes, outcome_macro_f1, rt_mae, n_prefixes AS n_support FROM bk WHERE regime = 'local')
SELECT dataset, run_name, bank, n_prefixes, round(outcome_macro_f1, 6) AS outcome_macro_f1, round(rt_mae, 3) AS rt_mae, n_support FROM b
UNION ALL SELECT dataset, run_name, 'unweighted_average', CAST(sum(n_prefixes) AS BIGINT), round(avg(outcome_macro_f1), 6), round(avg(rt_mae), 3), CAST(sum(n_support) AS BIGINT) FROM b GROUP BY dataset, run_name
UNION ALL SELECT dataset, run_name, 'prefix_weighted_average', CAST(sum(n_prefixes) AS BIGINT), round(sum(outcome_macro_f1 * n_prefixes) / sum(n_prefixes), 6), round(sum(rt_mae * n_prefixes) / sum(n_prefixes), 3), CAST(sum(n_support) AS BIGINT) FROM b GROUP BY dataset, run_name""")
def append_averages(spark, sf):
    local = banks(spark, sf).filter("regime = 'local'").withColumn("n_support", F.col("n_prefixes"))
    return rounded(R.append_averages(local, ["outcome_macro_f1", "rt_mae"], ["n_support"], by=["dataset", "run_name"]), 6, rt_mae=3)


@query("R14_best_step", """
WITH h AS (SELECT l_returnflag AS run, CAST(round(l_discount * 100) AS INTEGER) AS step, avg(l_extendedprice) AS loss, avg(l_quantity) AS f1 FROM lineitem GROUP BY ALL)
SELECT run, 'best_loss' AS name, 'loss' AS metric, arg_min(step, loss) AS step, round(min(loss), 3) AS value FROM h GROUP BY run
UNION ALL SELECT run, 'best_f1', 'f1', arg_max(step, f1), round(max(f1), 3) FROM h GROUP BY run""")
def best_step(spark, sf):
    history = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("run"), F.round(F.col("l_discount") * 100).cast("int").alias("step")
    ).agg(F.avg("l_extendedprice").alias("loss"), F.avg("l_quantity").alias("f1"))
    specs = {"best_loss": ("loss", True), "best_f1": ("f1", False), "best_other": ("absent", True)}
    return rounded(R.best_step(history, specs, by=["run"]), 3)


@query("R15_round_summary", """
WITH c AS (SELECT l_linenumber AS round, l_suppkey, avg(l_discount) AS loss, CASE WHEN count(*) > 85 THEN avg(l_tax) END AS extra, count(*) AS w FROM lineitem GROUP BY ALL)
SELECT round, count(*) AS clients, round(coalesce(sum(loss * w) / sum(w), 0), 6) AS loss_mean, round(min(loss), 6) AS loss_min, round(max(loss), 6) AS loss_max,
  round(coalesce(sum(extra * w) / sum(w) FILTER (WHERE extra IS NOT NULL), 0), 6) AS extra_mean, round(coalesce(min(extra), 0), 6) AS extra_min, round(coalesce(max(extra), 0), 6) AS extra_max FROM c GROUP BY round""")
def round_summary(spark, sf):
    clients = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("round"), "l_suppkey").agg(
        F.avg("l_discount").alias("loss"), F.when(F.count(F.lit(1)) > 85, F.avg("l_tax")).alias("extra"), F.count(F.lit(1)).alias("train_prefix_count"))
    return rounded(R.round_summary(clients, ["loss", "extra"]))


@query("R16_group_means", _LN + """
SELECT CASE WHEN dataset = 'joint' THEN 'joint' ELSE 'single' END AS scope, count(*) AS runs, round(avg(outcome_macro_f1), 6) AS mean_outcome_macro_f1,
  round(avg(next_activity_top1), 6) AS mean_next_activity_top1, round(avg(rt_mae), 3) AS mean_rt_mae FROM rn WHERE NOT use_dp GROUP BY 1""")
def group_means(spark, sf):
    return rounded(R.group_means(runs(spark, sf), _M), 6, mean_rt_mae=3)


@query("R17_flatten_metrics", _LN + """
SELECT script_id, dataset, run_name, strategy, dp_target_epsilon, CASE WHEN regime <> 'local' THEN n_prefixes END AS n_prefixes, round(outcome_macro_f1, 6) AS outcome_macro_f1,
  round(next_activity_top1, 6) AS next_activity_top1_accuracy, CASE WHEN script_id = 'central' THEN round(rt_mae, 3) END AS remaining_time_mae FROM rn""")
def flatten_metrics(spark, sf):
    kept = reports(spark, sf).select("*", "config.dataset", "config.run_name", "config.strategy", "config.dp_target_epsilon")
    out = R.flatten_metrics(kept, ["script_id", "dataset", "run_name", "strategy", "dp_target_epsilon"], ["0"])
    return rounded(out.select(
        "script_id", "dataset", "run_name", "strategy", "dp_target_epsilon", "n_prefixes", "outcome_macro_f1", "next_activity_top1_accuracy", "remaining_time_mae"
    ), 6, remaining_time_mae=3)
