"""Comparison of runs: flattening of reports, completeness, deltas and rankings.

Run tables have one row per run or per bank of a run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

METRICS = ("outcome_macro_f1", "next_activity_top1", "rt_mae")
_OUTCOME = "struct<macro_f1:double,weighted_f1:double,balanced_accuracy:double,confusion_matrix:array<array<bigint>>," \
    "per_class:map<string,struct<precision:double,recall:double,f1:double,support:bigint>>>"
_BLOCK = (
    f"struct<n_prefixes:bigint,outcome:{_OUTCOME},"
    "next_activity:struct<top1_accuracy:double,top3_accuracy:double>,"
    "remaining_time:struct<mae:double,mae_seconds:double,rmse:double,rmse_seconds:double>>"
)
# Layout of a run report.
REPORT_SCHEMA = (
    "script_id string,"
    "config struct<dataset:string,run_name:string,heterogeneity:string,n_clients:int,regime:string,strategy:string,"
    "bank:string,seed:int,learning_rate:double,fedprox_mu:double,use_dp:string,dp_target_epsilon:double,"
    "max_epochs:int,max_rounds:int,local_epochs:int>,"
    f"metrics struct<validation:{_BLOCK},test:{_BLOCK},per_bank_test:map<string,{_BLOCK}>>,"
    "diagnostics struct<best_epoch:struct<best_total_validation_loss:struct<epoch:int>>,"
    "best_round:struct<best_round:int,dp_epsilon_spent:double>>,"
    "rounds struct<best_round:int>"
)


@dataclass(frozen=True)
class ScriptIds:
    """How reports name the script that wrote them."""

    central: str = "central"
    federated: str = "federated"


def truthy(c: Column) -> Column:
    """Booleans that may come as text."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def finite(c: Column) -> Column:
    """The number, or null when it is not finite."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def prefix_count(block: Column) -> Column:
    """Declared prefix count, else the total of the confusion matrix."""
    cells = F.flatten(block["outcome"]["confusion_matrix"])
    return F.coalesce(
        block["n_prefixes"],
        F.when(F.size(cells) > 0, F.aggregate(cells, F.lit(0).cast("long"), lambda a, b: a + b)),
    )


def _either(a: Column, b: Column) -> Column:
    """First value unless it is missing or 0, as old and new key names are read."""
    return F.when(a.isNull() | (a == 0), F.coalesce(b, a)).otherwise(a)


def headline_columns(block: Column) -> dict[str, Column]:
    """Headline metrics of a metric block, old and new key names accepted."""
    rt = block["remaining_time"]
    return {
        "outcome_macro_f1": block["outcome"]["macro_f1"],
        "outcome_weighted_f1": block["outcome"]["weighted_f1"],
        "outcome_balanced_accuracy": block["outcome"]["balanced_accuracy"],
        "next_activity_top1": block["next_activity"]["top1_accuracy"],
        "rt_mae": _either(rt["mae_seconds"], rt["mae"]),
        "rt_rmse": _either(rt["rmse_seconds"], rt["rmse"]),
        "n_prefixes": prefix_count(block),
    }


def _regime(ids: ScriptIds) -> Column:
    named = F.nullif(F.col("config.regime"), F.lit(""))
    federated = F.when(truthy(F.col("config.use_dp")), "federated_dp").otherwise("federated")
    return F.coalesce(named, F.when(F.col("script_id") == ids.federated, federated), F.lit(""))


def run_rows(reports: DataFrame, ids: ScriptIds = ScriptIds()) -> DataFrame:
    """One flat row per report: identity, settings, best step and headline test metrics."""
    c = lambda n: F.col(f"config.{n}")
    return reports.select(
        "script_id", c("dataset").alias("dataset"), c("run_name").alias("run_name"),
        c("heterogeneity").alias("heterogeneity"), c("n_clients").alias("n_clients"), _regime(ids).alias("regime"),
        F.coalesce(c("strategy"), F.lit("")).alias("strategy"), F.coalesce(c("bank"), F.lit("")).alias("bank"),
        c("seed").alias("seed"), c("learning_rate").alias("learning_rate"), c("fedprox_mu").alias("fedprox_mu"),
        truthy(c("use_dp")).alias("use_dp"), c("dp_target_epsilon").alias("dp_target_epsilon"),
        F.col("diagnostics.best_round.dp_epsilon_spent").alias("dp_epsilon_spent"),
        c("max_epochs").alias("max_epochs"), c("max_rounds").alias("max_rounds"), c("local_epochs").alias("local_epochs"),
        F.col("diagnostics.best_epoch.best_total_validation_loss.epoch").alias("best_epoch"),
        F.coalesce("diagnostics.best_round.best_round", "rounds.best_round").alias("best_round"),
        *[v.alias(n) for n, v in headline_columns(F.col("metrics.test")).items()],
        "report_path",
    )


def bank_rows(reports: DataFrame, ids: ScriptIds = ScriptIds()) -> DataFrame:
    """One row per bank of a run; a local run without the map gives its pooled block.

    The source dataset is the qualifier of ``dataset:bank``.
    """
    regime = _regime(ids)
    local = (regime == "local") & (F.coalesce(F.col("config.bank"), F.lit("")) != "")
    blocks = F.when(F.coalesce(F.size("metrics.per_bank_test"), F.lit(0)) > 0, F.col("metrics.per_bank_test")).when(
        local, F.create_map(F.coalesce("config.bank", F.lit("")), F.col("metrics.test"))
    )
    flat = reports.select(
        "script_id", F.col("config.dataset").alias("dataset"), F.col("config.run_name").alias("run_name"),
        regime.alias("regime"), F.coalesce("config.strategy", F.lit("")).alias("strategy"),
        F.explode(blocks).alias("bank", "block"), "report_path",
    )
    return flat.select(
        "script_id", "dataset", "run_name", "regime", "strategy", "bank",
        F.when(F.instr("bank", ":") > 0, F.substring_index("bank", ":", 1)).otherwise(F.col("dataset")).alias("source_dataset"),
        *[v.alias(n) for n, v in headline_columns(F.col("block")).items()],
        "report_path",
    )


def spreads(banks: DataFrame, run: Sequence[str]) -> DataFrame:
    """Worst, best and spread over the banks of a run; high F1 and low error are good."""
    f1, rt = finite(F.col("outcome_macro_f1")), finite(F.col("rt_mae"))
    return banks.groupBy(*run).agg(
        F.min(f1).alias("worst_f1"), F.max(f1).alias("best_f1"), (F.max(f1) - F.min(f1)).alias("f1_spread"),
        F.max(rt).alias("worst_mae"), F.min(rt).alias("best_mae"), (F.max(rt) - F.min(rt)).alias("mae_spread"),
    )


def expected_runs(
    spark: SparkSession, layouts: Mapping[str, Sequence[tuple[str, Sequence[str]]]],
    strategies: Sequence[str] = ("fedavg", "fedprox"), ids: ScriptIds = ScriptIds(),
) -> DataFrame:
    """Expected grid: per layout one central run, one local run per bank and one run per strategy."""
    rows = []
    for dataset, runs in layouts.items():
        for run_name, banks in runs:
            rows.append((ids.central, dataset, run_name, "centralized", "", ""))
            rows += [(ids.central, dataset, run_name, "local", "", b) for b in banks]
            rows += [(ids.federated, dataset, run_name, "", s, "") for s in strategies]
    return spark.createDataFrame(
        rows, "script_id string, dataset string, run_name string, regime string, strategy string, bank string"
    )


def missing_runs(expected: DataFrame, runs: DataFrame, ids: ScriptIds = ScriptIds()) -> DataFrame:
    """Expected runs without an observed non-private run; private runs never fill a slot."""
    central = F.col("script_id") == ids.central
    pooled = F.col("regime") == "centralized"
    seen = runs.filter(~truthy(F.col("use_dp")) & F.col("script_id").isin(ids.central, ids.federated)).select(
        "script_id", "dataset", "run_name",
        F.when(central, F.col("regime")).otherwise("").alias("regime"),
        F.when(central, F.lit("")).otherwise(F.col("strategy")).alias("strategy"),
        F.when(central & ~pooled, F.col("bank")).otherwise("").alias("bank"),
    ).distinct()
    return expected.join(seen, expected.columns, "left_anti")


def quality_flags(
    runs: DataFrame, banks: DataFrame, run: Sequence[str], required_sources: Sequence[str], low: float = 0.05,
    joint: str = "joint", regime: str = "regime",
) -> DataFrame:
    """Warnings ``(run…, bank, flag)``: not finite, no bank rows, incomplete sources, no prefixes, low accuracy."""
    run = list(run)
    nums = [f.name for f in runs.schema if f.dataType.simpleString() in ("double", "float")]
    bad = F.lit(False)
    for c in nums:
        x = F.col(c).cast("double")
        bad = bad | F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(False))
    per = banks.groupBy(*run).agg(F.collect_set(F.when(F.col("source_dataset").isin(*required_sources), F.col("source_dataset"))).alias("__src"))
    names = list(dict.fromkeys([*run, regime, "dataset"]))
    seen = runs.select(*names, bad.alias("__bad")).join(per, run, "left")
    pooled = F.col(regime) != "local"
    flags = F.array_compact(F.array(
        F.when(F.col("__bad"), F.lit("not_finite")),
        F.when(pooled & F.col("__src").isNull(), F.lit("no_bank_rows")),
        F.when(
            pooled & (F.col("dataset") == joint) & F.col("__src").isNotNull() & (F.size("__src") < len(required_sources)),
            F.lit("incomplete_sources"),
        ),
    ))
    of_runs = seen.select(*run, F.lit("").alias("bank"), F.explode(flags).alias("flag"))
    bank_flags = F.array_compact(F.array(
        F.when(F.col("n_prefixes") == 0, F.lit("zero_prefixes")),
        F.when(finite(F.col("next_activity_top1")) < low, F.lit("low_accuracy")),
    ))
    return of_runs.unionByName(banks.select(*run, "bank", F.explode(bank_flags).alias("flag")))


def top_rows(rows: DataFrame, metric: str, n: int = 5, desc: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Best or worst ``n`` rows by a finite metric; ties by name."""
    known = rows.filter(finite(F.col(metric)).isNotNull())
    return known.orderBy(F.desc(metric) if desc else F.asc(metric), *ties).limit(n)


def _public(runs: DataFrame, ids: ScriptIds) -> DataFrame:
    return runs.filter((F.col("script_id") == ids.federated) & ~truthy(F.col("use_dp")))


def delta_vs_reference(
    runs: DataFrame, split: Sequence[str] = ("dataset", "run_name"), ids: ScriptIds = ScriptIds()
) -> DataFrame:
    """Central run against the best federated run by F1, per split: both values and deltas.

    Ties for the best go to the first strategy in name order.
    """
    split = list(split)
    f1, rt = finite(F.col("outcome_macro_f1")), finite(F.col("rt_mae"))
    best = (
        _public(runs, ids).filter(f1.isNotNull()).groupBy(*split)
        .agg(F.min(F.struct((-f1).alias("k"), F.col("strategy").alias("s"), f1.alias("f"), rt.alias("r"))).alias("b"))
    )
    central = runs.filter((F.col("script_id") == ids.central) & (F.col("regime") == "centralized")).select(
        *split, f1.alias("central_f1"), rt.alias("central_mae")
    )
    return central.join(best, split).select(
        *split, F.col("b.s").alias("best_strategy"), "central_f1", F.col("b.f").alias("federated_f1"),
        (F.col("b.f") - F.col("central_f1")).alias("delta_f1"), "central_mae", F.col("b.r").alias("federated_mae"),
        (F.col("b.r") - F.col("central_mae")).alias("delta_mae"),
    )


def strategy_delta(
    runs: DataFrame, first: str = "fedavg", second: str = "fedprox", split: Sequence[str] = ("dataset", "run_name"),
    ids: ScriptIds = ScriptIds(),
) -> DataFrame:
    """Second minus first strategy per split where both exist, in one aggregation."""
    f1, rt = finite(F.col("outcome_macro_f1")), finite(F.col("rt_mae"))
    at = lambda s, v: F.max(F.when(F.col("strategy") == s, v))
    wide = _public(runs, ids).groupBy(*split).agg(
        at(first, f1).alias(f"{first}_f1"), at(second, f1).alias(f"{second}_f1"),
        at(first, rt).alias(f"{first}_mae"), at(second, rt).alias(f"{second}_mae"),
        F.bool_or(F.col("strategy") == first).alias("__a"), F.bool_or(F.col("strategy") == second).alias("__b"),
    )
    return wide.filter("__a and __b").drop("__a", "__b").withColumns(
        {
            "delta_f1": F.col(f"{second}_f1") - F.col(f"{first}_f1"),
            "delta_mae": F.col(f"{second}_mae") - F.col(f"{first}_mae"),
        }
    )


def source_balance(banks: DataFrame, run: Sequence[str] = ("run_name", "regime", "strategy"), joint: str = "joint") -> DataFrame:
    """Per run and source of joint runs: banks, prefixes, share of the run and mean metrics."""
    run = list(run)
    mean = lambda c: F.avg(finite(F.col(c)))
    per = banks.filter(F.col("dataset") == joint).groupBy(*run, "source_dataset").agg(
        F.count(F.lit(1)).alias("banks"),
        F.coalesce(F.sum(finite(F.col("n_prefixes"))), F.lit(0.0)).alias("n_prefixes"),
        mean("outcome_macro_f1").alias("mean_f1"), mean("next_activity_top1").alias("mean_top1"), mean("rt_mae").alias("mean_mae"),
    )
    w = Window.partitionBy(*run)  # one row per source of a run
    return per.withColumn("prefix_share", F.try_divide(F.col("n_prefixes"), F.sum("n_prefixes").over(w)))


def fairness_rank(spread: DataFrame, n: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """Runs with the widest bank spread, F1 first, then error; nulls as 0."""
    known = spread.filter(F.col("f1_spread").isNotNull() | F.col("mae_spread").isNotNull())
    return known.orderBy(
        F.desc(F.coalesce("f1_spread", F.lit(0.0))), F.desc(F.coalesce("mae_spread", F.lit(0.0))), *ties
    ).limit(n)


def at_budget(runs: DataFrame) -> DataFrame:
    """Non-private runs whose best step reached the budget (rounds, else epochs)."""
    some = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit(0)), F.col(b))
    return runs.filter(~truthy(F.col("use_dp")) & (some("best_round", "best_epoch") >= some("max_rounds", "max_epochs")))


def relative_loss(
    runs: DataFrame, metrics: Mapping[str, bool], reference: str = "fedprox",
    split: Sequence[str] = ("dataset", "run_name"), ids: ScriptIds = ScriptIds(),
) -> DataFrame:
    """Percent loss of private runs against the non-private reference run of their split.

    ``metrics`` maps columns to whether lower is better; a base of 0 gives null.
    """
    split = list(split)
    base = _public(runs, ids).filter(F.col("strategy") == reference).groupBy(*split).agg(
        *[F.max(finite(F.col(m))).alias(f"__{m}") for m in metrics]
    )
    private = runs.filter((F.col("script_id") == ids.federated) & truthy(F.col("use_dp")))
    cols = []
    for m, lower in metrics.items():
        x, b = finite(F.col(m)), F.col(f"__{m}")
        delta = x - b if lower else b - x
        cols.append((F.try_divide(delta, F.abs(b)) * 100).alias(f"{m}_loss"))
    return private.join(base, split).select(*split, "strategy", "dp_target_epsilon", *cols)


def mean_loss(losses: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean loss per privacy level over splits with a value."""
    return losses.groupBy("dp_target_epsilon").agg(
        F.count(F.lit(1)).alias("runs"), *[F.avg(f"{m}_loss").alias(f"{m}_loss") for m in metrics]
    )


def append_averages(
    rows: DataFrame, means: Sequence[str], supports: Sequence[str] = (), name: str = "bank", weight: str = "n_prefixes",
    by: Sequence[str] = (),
) -> DataFrame:
    """Bank rows plus an unweighted and a weighted average row per group; supports are summed."""
    by = list(by)
    w = F.col(weight).cast("double")

    def average(label: str, mean) -> DataFrame:
        grouped = rows.groupBy(*by) if by else rows.groupBy()
        return grouped.agg(
            F.lit(label).alias(name), F.sum(weight).alias(weight),
            *[mean(F.col(c)).alias(c) for c in means],
            *[F.sum(c).alias(c) for c in supports],
        )

    plain = average("unweighted_average", F.avg)
    weighted = average(
        "prefix_weighted_average", lambda c: F.try_divide(F.sum(c * w), F.sum(F.when(c.isNotNull(), w)))
    )
    keep = [*by, name, weight, *means, *supports]
    return rows.select(*keep).unionByName(plain.select(*keep)).unionByName(weighted.select(*keep))


def best_step(history: DataFrame, specs: Mapping[str, tuple[str, bool]], step: str = "step", by: Sequence[str] = ()) -> DataFrame:
    """Step and value of each metric's best; the first step on ties.

    ``specs`` maps a name to (column, lower is better); absent columns are skipped.
    """
    specs = {n: s for n, s in specs.items() if s[0] in history.columns}
    facts = []
    for n, (c, lower) in specs.items():
        x = F.col(c).cast("double")
        order = F.struct((x if lower else -x).alias("k"), F.col(step).alias("s"), x.alias("v"))
        facts.append(F.min(F.when(x.isNotNull() & ~F.isnan(x), order)).alias(n))
    grouped = history.groupBy(*by) if by else history.groupBy()
    wide = grouped.agg(*facts)
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(c).alias("metric"), F.col(n)["s"].alias(step), F.col(n)["v"].alias("value"))
        for n, (c, _) in specs.items()
    ])
    return wide.select(*by, F.explode(rows).alias("x")).select(*by, "x.*").filter(F.col("value").isNotNull())


def round_summary(clients: DataFrame, metrics: Sequence[str], weight: str = "train_prefix_count", by: Sequence[str] = ("round",)) -> DataFrame:
    """Per round: weighted mean over clients that report a metric, its minimum and maximum; 0 when absent."""
    cols = []
    for m in metrics:
        x = F.col(m).cast("double")
        w = F.when(x.isNotNull(), F.col(weight).cast("double"))
        mean = F.when(F.sum(w) > 0, F.sum(x * w) / F.sum(w))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        cols += [zero(mean).alias(f"{m}_mean"), zero(F.min(x)).alias(f"{m}_min"), zero(F.max(x)).alias(f"{m}_max")]
    return clients.groupBy(*by).agg(F.count(F.lit(1)).alias("clients"), *cols)


def group_means(runs: DataFrame, metrics: Sequence[str], joint: str = "joint") -> DataFrame:
    """Mean of finite metrics over non-private joint runs and over single-dataset runs."""
    scope = F.when(F.col("dataset") == joint, "joint").otherwise("single")
    return runs.filter(~truthy(F.col("use_dp"))).groupBy(scope.alias("scope")).agg(
        F.count(F.lit(1)).alias("runs"), *[F.avg(finite(F.col(m))).alias(f"mean_{m}") for m in metrics]
    )


def flatten_metrics(reports: DataFrame, keep: Sequence[str], classes: Sequence[str], block: str = "metrics.test") -> DataFrame:
    """Nested metric block to prefixed flat columns."""
    b = F.col(block)
    cols = [b["n_prefixes"].alias("n_prefixes")]
    cols += [b["outcome"][m].alias(f"outcome_{m}") for m in ("macro_f1", "weighted_f1", "balanced_accuracy")]
    cols += [
        F.try_element_at(b["outcome"]["per_class"], F.lit(c))[m].alias(f"outcome_class_{c}_{m}")
        for c in classes for m in ("precision", "recall", "f1", "support")
    ]
    cols += [b["next_activity"][m].alias(f"next_activity_{m}") for m in ("top1_accuracy", "top3_accuracy")]
    cols += [b["remaining_time"][m].alias(f"remaining_time_{m}") for m in ("mae", "rmse")]
    return reports.select(*keep, *cols)
