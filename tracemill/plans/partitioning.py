"""Layouts of cases over banks: random, weak, medium and strong."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tracemill.functions.quantiles import with_scalars
from tracemill.operators import partition as P
from tracemill.session import settle

STRATEGIES = ("iid", "weak", "medium", "strong")


@dataclass(frozen=True)
class Enforcement:
    """Targets of the rate enforcement: A above B, C below B, and the drop caps."""

    above: float
    below: float
    cap: float
    cap_five_banks: float

    def rules(self, five: bool) -> list[P.GapRule]:
        cap = self.cap_five_banks if five else self.cap
        return [
            P.GapRule("A", P.DENIED, self.above, "up", cap),
            P.GapRule("C", P.APPROVED, self.below, "down", cap),
        ]


@dataclass(frozen=True)
class Design:
    """Everything that shapes the layouts of one log."""

    weak: Sequence[Sequence[float]]
    medium: Sequence[Sequence[float]]
    zero: Mapping[str, str]
    high_goals: Sequence[str] = ()
    low_goals: Sequence[str] = ()
    specialists: Mapping[str, str] = field(default_factory=dict)
    enforcement: Mapping[str, Enforcement] = field(default_factory=dict)
    margin: int = 0
    seed: int = 42
    mode: str = "stratified_quintile"
    strategies: Sequence[str] = STRATEGIES


# The layout design of the log with goals.
WITH_GOALS = Design(
    weak=((0.30, 0.30, 0.40), (0.35, 0.30, 0.35), (0.40, 0.35, 0.25), (0.45, 0.40, 0.15), (0.50, 0.40, 0.10)),
    medium=((0.05, 0.30, 0.65), (0.20, 0.30, 0.50), (0.40, 0.40, 0.20), (0.55, 0.35, 0.10), (0.75, 0.20, 0.05)),
    zero={"weak": "even", "medium": "half", "strong": "first"},
    high_goals=("Remaining debt home", "Boat", "Caravan / Camper", "Unknown"),
    low_goals=(
        "Tax payments", "Not speficied", "Other, see explanation",
        "Extra spending limit", "Motorcycle", "Business goal",
    ),
    specialists={"D": "Home improvement", "E": "Existing loan takeover"},
    enforcement={
        "medium": Enforcement(0.05, 0.07, 0.08, 0.10),
        "strong": Enforcement(0.10, 0.15, 0.25, 0.25),
    },
)

# The layout design of the log without goals.
AMOUNT_ONLY = Design(
    weak=((0.55, 0.30, 0.15), (0.48, 0.32, 0.20), (0.40, 0.35, 0.25), (0.32, 0.39, 0.29), (0.26, 0.34, 0.40)),
    medium=((0.85, 0.10, 0.05), (0.75, 0.15, 0.10), (0.45, 0.35, 0.20), (0.20, 0.40, 0.40), (0.10, 0.35, 0.55)),
    zero={"weak": "first", "medium": "first"},
    strategies=("iid", "weak", "medium"),
)


def amount_split(cases: DataFrame, design: Design, weights: Sequence[Sequence[float]], case: str) -> DataFrame:
    """Banks of positive-amount cases from their amount quintile."""
    # Ranking reads the bands twice.
    cut = settle(P.qcut(cases.filter("amount > 0").select(case, "amount"), "amount", 5))
    if design.mode == "stratified_quintile":
        return P.split_weighted(cut, weights, design.seed, case=case)
    if design.mode == "linear_quintile":
        return P.split_linear(cut, case=case)
    raise ValueError(f"unknown split mode: {design.mode!r}")


def _three_banks(cases: DataFrame, strategy: str, design: Design, five: bool, case: str) -> DataFrame:
    weights = design.weak if strategy == "weak" else design.medium
    base = amount_split(cases, design, weights, case)
    zero = P.route_zero(cases, design.zero[strategy], design.seed, case=case)
    if strategy == "weak" or not (design.high_goals or design.low_goals):
        out = base.unionByName(zero)
    else:
        facts = cases.select(case, "amount", "goal")
        base = settle(P.reassign_category(base.join(facts, case), design.high_goals))
        moved = P.reassign_capped(base, design.low_goals, design.seed, design.margin, case=case)
        out = moved.select(case, "bank").unionByName(zero)
    if strategy not in design.enforcement:
        return out
    labelled = settle(out.join(cases.select(case, "outcome"), case))
    rules = design.enforcement[strategy].rules(five)
    return P.enforce_rate_gap(labelled, rules, design.seed, case=case).select(case, "bank")


def partition(cases: DataFrame, strategy: str, k: int, design: Design, case: str = "case_id") -> DataFrame:
    """Assignment ``(case, bank)`` of one layout.

    ``cases`` is read several times: pass a settled table. Five banks exist for
    random, medium and strong layouts; specialists then leave the pool first.
    """
    if strategy not in design.strategies:
        raise ValueError(f"unknown strategy: {strategy!r}")
    if strategy == "iid":
        return P.split_even(cases, k, design.seed, "iid", case)
    if k == 3:
        return _three_banks(cases, strategy, design, False, case)
    if k == 5 and strategy in ("medium", "strong") and design.specialists:
        special, rest = P.carve_specialists(cases, design.specialists, case=case)
        return special.unionByName(_three_banks(rest, strategy, design, True, case))
    raise ValueError(f"{strategy!r} does not support {k} banks")


def layouts(
    cases: DataFrame, configs: Sequence[tuple[str, int]], design: Design, case: str = "case_id"
) -> DataFrame:
    """Several layouts stacked, with a ``config`` column and the case facts."""
    parts = [
        partition(cases, s, k, design, case).withColumn("config", F.lit(f"{s}_{k}banks")) for s, k in configs
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cases.join(out, case)


def run_records(
    cases: DataFrame, layouts: DataFrame, configs: Sequence[tuple[str, int]], design: Design, cut: DataFrame,
    warnings: DataFrame | None = None,
) -> DataFrame:
    """What each layout was made from and how it ended, one row per layout in the form ``sources.tables.RECORD``.

    ``layouts`` are assigned cases with ``config``, ``bank`` and ``outcome``; ``cut`` is the one row of
    ``trace.cut_report``; ``warnings`` are rows ``(config, kind, bank, split, n)``, a handful per layout. Gaps are
    between the final approval rates of A and B and of B and C, null where a bank is empty; ``dropped`` counts the cases
    the enforcement left out, those without a usable amount not among them. One pass over ``layouts`` and one over ``cases``.
    """
    spark = cases.sparkSession
    rows = []
    for strategy, k in configs:
        e = design.enforcement.get(strategy)
        cap = None if e is None else (e.cap_five_banks if k == 5 else e.cap)
        rows.append((f"{strategy}_{k}banks", strategy, k, None if e is None else e.above, None if e is None else e.below, cap))
    names = spark.createDataFrame(
        rows, "config string, strategy string, n_banks long, target_ab_gap double, target_bc_gap double, cap double"
    )
    ok = (F.col("outcome") == P.APPROVED).cast("int")
    ends = layouts.groupBy("config").agg(
        F.count(F.lit(1)).alias("assigned"), F.count_if(F.col("amount") >= 0).alias("__kept"),
        *[F.avg(F.when(F.col("bank") == b, ok)).alias(f"__{b}") for b in "ABC"]
    )
    known = cases.agg(F.count(F.lit(1)).alias("available"), F.count_if(F.col("amount") >= 0).alias("__routable"))
    out = with_scalars(with_scalars(names.join(ends, "config", "left"), known), cut.select(F.struct("*").alias("trace_cut")))
    assigned = F.coalesce("assigned", F.lit(0).cast("long"))
    enforcement = F.when(F.col("cap").isNotNull(), F.struct(
        "cap", (F.col("__routable") - F.coalesce("__kept", F.lit(0).cast("long"))).alias("dropped"),
        (F.col("__A") - F.col("__B")).alias("final_ab_gap"), (F.col("__B") - F.col("__C")).alias("final_bc_gap"),
        "target_ab_gap", "target_bc_gap",
    ))
    settings = {"margin": design.margin, "mode": design.mode, "seed": design.seed}
    entry = "array<struct<bank:string,kind:string,n:bigint,split:string>>"
    out = out.select(
        "config", "strategy", "n_banks", F.struct(*[F.lit(v).alias(n) for n, v in settings.items()]).alias("settings"),
        F.struct("available", assigned.alias("assigned"), (F.col("available") - assigned).alias("left_out")).alias("cases"),
        enforcement.alias("enforcement"), "trace_cut",
    )
    if warnings is None:
        return out.withColumn("warnings", F.array().cast(entry))
    listed = warnings.groupBy("config").agg(F.array_sort(F.collect_list(F.struct("bank", "kind", "n", "split"))).alias("warnings"))
    return out.join(listed, "config", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast(entry)))
