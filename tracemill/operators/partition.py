"""Distribution-controlled case partitioning.

Input is one row per decided case; an assignment is a frame ``(case, bank)``.
Random order is a seeded hash order, so every split can be reproduced anywhere.
Ranks over whole banks run through hash or time segments, never in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.functions.ordered import hash_ranked, ranked as range_ranked
from tracemill.functions.quantiles import banded, with_scalars
from tracemill.session import settle

APPROVED, DENIED, CANCELLED = 2, 1, 0


def bank_names(k: int) -> list[str]:
    """A, B, C, … for ``k`` banks; after Z come AA, AB, …."""
    if k < 1:
        raise ValueError(f"at least one bank is needed, not {k}")

    def name(i: int) -> str:
        return (name(i // 26 - 1) if i >= 26 else "") + chr(ord("A") + i % 26)

    return [name(i) for i in range(k)]


BANKS = tuple(bank_names(5))


def qcut(df: DataFrame, col: str, q: int, by: Sequence[str] = (), name: str = "band") -> DataFrame:
    """Quantile band per row, see :func:`tracemill.functions.quantiles.banded`."""
    return banded(df, col, q, by, name)


def hash_rank(df: DataFrame, by: Sequence[str], seed: int, salt: str, case: str = "case_id") -> DataFrame:
    """Reproducible shuffle inside groups: 0-based ``rank`` and ``group_size``."""
    return hash_ranked(df, list(by), case, seed, salt)


def _even_index(rank: Column, n: Column, k: int) -> Column:
    small = F.floor(n / k)
    larger = n - small * k
    cut = larger * (small + 1)
    return F.when(rank < cut, F.floor(rank / (small + 1))).otherwise(
        larger + F.floor(F.try_divide(rank - cut, small))
    )


def _bank(index: Column, banks: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b in banks]), (index + 1).cast("int"))


def split_even(df: DataFrame, k: int, seed: int, salt: str = "even", case: str = "case_id") -> DataFrame:
    """Near-equal random groups; the first groups take the remainder."""
    ranked = hash_ranked(df, [], case, seed, salt)
    index = _even_index(F.col("rank"), F.col("group_size"), k)
    return ranked.select(case, _bank(index, bank_names(k)).alias("bank"))


def split_weighted(
    df: DataFrame, weights: Sequence[Sequence[float]], seed: int, band: str = "band", case: str = "case_id"
) -> DataFrame:
    """Per band, cumulative weights (half to even) cut the hash order into A, B and C."""
    ranked = hash_ranked(df, [band], case, seed, "skew")

    def cut(upto: int) -> Column:
        sums = [row[0] if upto == 1 else row[0] + row[1] for row in weights]
        at = F.element_at(F.array(*[F.lit(float(s)) for s in sums]), (F.col(band) + 1).cast("int"))
        return F.least(F.rint(at * F.col("group_size")), F.col("group_size"))

    bank = F.when(F.col("rank") < cut(1), "A").when(F.col("rank") < cut(2), "B").otherwise("C")
    return ranked.select(case, bank.alias("bank"))


def split_linear(df: DataFrame, high_bank: str = "A", band: str = "band", case: str = "case_id") -> DataFrame:
    """Whole quintiles to banks; ``high_bank`` takes the two highest."""
    if high_bank not in ("A", "C"):
        raise ValueError(f"unsupported bank for high amounts: {high_bank!r}")
    order = "CCBAA" if high_bank == "A" else "AABCC"
    return df.select(case, _bank(F.col(band), list(order)).alias("bank"))


def route_zero(df: DataFrame, mode: str, seed: int, amount: str = "amount", case: str = "case_id") -> DataFrame:
    """Banks of zero-amount cases: ``even`` thirds, ``half`` 50/25/25, ``first`` all to A."""
    zero = df.filter(F.col(amount) == 0)
    if mode == "even":
        return split_even(zero, 3, seed, "zero", case)
    if mode == "first":
        return zero.select(case, F.lit("A").alias("bank"))
    if mode == "half":
        ranked = hash_ranked(zero, [], case, seed, "zero")
        n, r = F.col("group_size"), F.col("rank")
        a, b = F.rint(n * 0.50), F.rint(n * 0.25)
        return ranked.select(case, F.when(r < a, "A").when(r < a + b, "B").otherwise("C").alias("bank"))
    raise ValueError(f"unknown zero routing: {mode!r}")


def reassign_category(
    df: DataFrame, goals: Sequence[str], bank: str = "A", goal: str = "goal", amount: str = "amount"
) -> DataFrame:
    """Move listed goals with a positive amount to one bank, without a limit."""
    moves = F.col(goal).isin(*goals) & (F.col(amount) > 0)
    return df.withColumn("bank", F.when(moves, F.lit(bank)).otherwise(F.col("bank")))


def reassign_capped(
    df: DataFrame, goals: Sequence[str], seed: int, margin: int = 0,
    goal: str = "goal", amount: str = "amount", case: str = "case_id",
) -> DataFrame:
    """Move low goals to C in hash order while C stays smaller than B by more than ``margin``.

    A move from B costs the gap two, any other one. Rows move while the gap
    before them allows it; if the first refusal is a B row met with a gap of
    ``2 + margin``, one later row from elsewhere still fits. ``df`` holds the
    positive-amount cases with their bank; it is read three times, so callers
    settle it first.
    """
    sizes = df.agg(
        F.count_if((F.col(amount) > 0) & (F.col("bank") == "B")).alias("__b"),
        F.count_if((F.col(amount) > 0) & (F.col("bank") == "C")).alias("__c"),
    ).select((F.col("__b") - F.col("__c")).alias("__gap0"))
    candidate = (
        F.coalesce(F.col(goal).isin(*goals), F.lit(False)) & (F.col("bank") != "C") & (F.col(amount) > 0)
    )
    from_b = F.col("bank") == "B"
    weight = F.when(from_b, 2).otherwise(1)
    ranked = with_scalars(
        hash_ranked(df.filter(candidate), [], case, seed, "low", running={"__upto": weight}), sizes
    )
    gap = F.col("__gap0") - (F.col("__upto") - weight)
    # Read three times below, so the candidates are ranked once and written.
    ranked = settle(
        ranked.select(
            case, F.col("rank").alias("__rank"), gap.alias("__gap"), from_b.alias("__from_b"), weight.alias("__w")
        )
    )
    refused = F.col("__gap") < F.col("__w") + 1 + margin
    stop = ranked.agg(
        F.min(F.when(refused, F.struct("__rank", "__gap", "__from_b"))).alias("__stop")
    )
    at = with_scalars(ranked, stop)
    fits_later = F.col("__stop.__from_b") & (F.col("__stop.__gap") == 2 + margin)
    extra = at.agg(
        F.min(F.when(fits_later & (F.col("__rank") > F.col("__stop.__rank")) & ~F.col("__from_b"), F.col("__rank")))
        .alias("__extra")
    )
    moved = with_scalars(at, extra).filter(
        F.col("__stop").isNull()
        | (F.col("__rank") < F.col("__stop.__rank"))
        | (F.col("__rank") == F.col("__extra"))
    )
    marked = df.join(moved.select(case, F.lit(True).alias("__moved")), case, "left")
    return marked.withColumn("bank", F.when(F.col("__moved"), "C").otherwise(F.col("bank"))).drop("__moved")


@dataclass(frozen=True)
class GapRule:
    """Drop ``drop_class`` cases of ``bank`` until its rate is ``gap`` away from the reference bank."""

    bank: str
    drop_class: int
    gap: float
    direction: str
    cap: float


def _gap_pool(
    df: DataFrame, rules: Sequence[GapRule], seed: int, ref_bank: str, outcome: str, case: str,
) -> tuple[DataFrame, DataFrame]:
    """(droppable cases in hash order with ``__hit`` and ``__limit``, one row per bank with its limit)."""
    ok = F.col(outcome) == APPROVED
    stats = df.groupBy("bank").agg(F.count(F.lit(1)).alias("__n"), F.count_if(ok).alias("__a"))
    ref = stats.agg(F.max(F.when(F.col("bank") == ref_bank, F.col("__a") / F.col("__n"))).alias("__ref"))
    picked = F.lit(False)
    gap, cap, up = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("boolean")
    for r in rules:
        if r.direction not in ("up", "down"):
            raise ValueError(f"unknown direction: {r.direction!r}")
        here = F.col("bank") == r.bank
        picked = picked | (here & (F.col(outcome) == r.drop_class))
        gap = F.when(here, F.lit(r.gap)).otherwise(gap)
        cap = F.when(here, F.lit(r.cap)).otherwise(cap)
        up = F.when(here, F.lit(r.direction == "up")).otherwise(up)
    stats = stats.withColumn("__limit", F.floor(cap * F.col("__n")))
    pool = hash_ranked(df.filter(picked), ["bank"], case, seed, "drop").select(
        "bank", case, (F.col("rank") + 1).alias("__k"), F.col(outcome).alias("__class")
    )
    # One row per rule on the right; joined by shuffle, each bank would be one task.
    named = stats.filter(F.col("bank").isin(*{r.bank for r in rules}))
    pool = with_scalars(pool.join(F.broadcast(named), "bank"), ref)
    left = F.col("__n") - F.col("__k")
    rate = F.try_divide(F.col("__a") - F.when(F.col("__class") == APPROVED, F.col("__k")).otherwise(0), left)
    diff = rate - F.col("__ref")
    hit = F.when(up, diff >= gap).otherwise(diff <= -gap)
    # A bank keeps its last case.
    pool = pool.withColumns({"__hit": hit, "__most": F.least("__limit", F.col("__n") - 1)})
    return pool.select("bank", case, "__k", "__hit", "__most"), stats.select("bank", "__limit")


def rate_gap_drops(
    df: DataFrame, rules: Sequence[GapRule], seed: int, ref_bank: str = "B",
    outcome: str = "outcome", case: str = "case_id",
) -> DataFrame:
    """Cases dropped by each rule, in hash order; :func:`gap_report` tells how each rule ended.

    After ``k`` drops a bank's rate is a function of ``k``, so the stopping point
    is the smallest ``k`` that reaches the gap, at most ``int(cap * n)`` and
    ``n - 1``. The reference rate is that of ``ref_bank`` before any drop.
    """
    pool = settle(_gap_pool(df, rules, seed, ref_bank, outcome, case)[0])
    stops = pool.groupBy("bank").agg(F.min(F.when(F.col("__hit"), F.col("__k"))).alias("__stop"))
    return pool.join(F.broadcast(stops), "bank").filter(F.col("__k") <= F.least("__stop", "__most")).select("bank", case)


def gap_report(
    df: DataFrame, rules: Sequence[GapRule], seed: int, ref_bank: str = "B",
    outcome: str = "outcome", case: str = "case_id",
) -> DataFrame:
    """One row per rule: pool, limit (``int(cap * n)``), dropped, target_hit and cap_hit.

    The cap is hit when a further candidate meets it; a pool that ends first is no
    cap hit. A rule for a bank without cases has zeros.
    """
    pool, limits = _gap_pool(df, rules, seed, ref_bank, outcome, case)
    ends = pool.groupBy("bank").agg(
        F.count(F.lit(1)).alias("pool"), F.max("__most").alias("__most"),
        F.min(F.when(F.col("__hit") & (F.col("__k") <= F.col("__most")), F.col("__k"))).alias("__stop"),
    )
    names = df.sparkSession.createDataFrame([(r.bank,) for r in rules], "bank string")
    out = names.join(limits, "bank", "left").join(ends, "bank", "left")
    zero = F.lit(0).cast("long")
    pool_, limit = F.coalesce("pool", zero), F.coalesce("__limit", zero)
    hit = F.col("__stop").isNotNull()
    return out.select(
        "bank", pool_.alias("pool"), limit.alias("limit"),
        F.coalesce("__stop", F.least(pool_, F.coalesce("__most", zero))).alias("dropped"),
        hit.alias("target_hit"), ((pool_ > limit) & ~hit).alias("cap_hit"),
    )


def enforce_rate_gap(df: DataFrame, rules: Sequence[GapRule], seed: int, case: str = "case_id", **kw: str) -> DataFrame:
    """Assignment without the cases the rules drop."""
    return df.join(rate_gap_drops(df, rules, seed, case=case, **kw).select(case), case, "left_anti")


def carve_specialists(
    df: DataFrame, specialists: Mapping[str, str], goal: str = "goal", case: str = "case_id"
) -> tuple[DataFrame, DataFrame]:
    """Specialist goals leave the pool first: (assignment, remaining cases)."""
    bank = F.lit(None).cast("string")
    for b, g in specialists.items():
        bank = F.when(F.col(goal) == g, F.lit(b)).otherwise(bank)
    tagged = df.withColumn("bank", bank)
    return tagged.filter("bank is not null").select(case, "bank"), tagged.filter("bank is null").drop("bank")


def check_partition(cases: DataFrame, assignment: DataFrame, amount: str = "amount", case: str = "case_id") -> DataFrame:
    """Cases known, assigned, unknown, dropped and unrouted (amount null or negative)."""
    both = cases.select(case, amount, F.lit(True).alias("__known")).join(
        assignment.select(case, "bank"), case, "full_outer"
    )
    known = F.coalesce(F.col("__known"), F.lit(False))
    lost = known & F.col("bank").isNull()
    unrouted = F.col(amount).isNull() | (F.col(amount) < 0)
    return both.agg(
        F.count_if(known).alias("cases"),
        F.count("bank").alias("assigned"),
        F.count_if(~known).alias("unknown"),
        F.count_if(lost & ~unrouted).alias("dropped"),
        F.count_if(lost & unrouted).alias("unrouted"),
    )


def bank_counts(assignment: DataFrame, banks: Sequence[str]) -> DataFrame:
    """Cases per expected bank, 0 for an empty one."""
    counted = assignment.agg(*[F.count_if(F.col("bank") == b).alias(b) for b in banks])
    return counted.unpivot([], list(banks), "bank", "n_cases")


def partition_summary(
    df: DataFrame, by: Sequence[str] = ("bank",), outcome: str = "outcome", amount: str = "amount",
    goal: str = "goal", events: str = "n_events",
) -> DataFrame:
    """Per bank: sizes, classes, approval rate, mean amount, goals, top goal, events.

    Counted per (bank, goal) first, so the second level sees few rows. Ties for
    the top goal go to the first in name order.
    """
    by = list(by)
    cells = df.groupBy(*by, goal).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(outcome) == CANCELLED).alias("c"),
        F.count_if(F.col(outcome) == APPROVED).alias("a"),
        F.count_if(F.col(outcome) == DENIED).alias("d"),
        F.sum(amount).alias("s"),
        F.count(amount).alias("m"),
        F.sum(events).alias("e"),
    )
    named = F.col(goal).isNotNull()
    return cells.groupBy(*by).agg(
        F.sum("n").alias("n_cases"),
        F.sum("c").alias("n_cancelled"),
        F.sum("a").alias("n_approved"),
        F.sum("d").alias("n_denied"),
        (F.sum("a") / F.sum("n")).alias("approval_rate"),
        F.try_divide(F.sum("s"), F.sum("m")).alias("mean_amount"),
        F.count(F.when(named, 1)).alias("n_goals"),
        F.min(F.when(named, F.struct((-F.col("n")).alias("r"), F.col(goal).alias("g"))))["g"].alias("top_goal"),
        F.sum("e").alias("n_events"),
    )


def approval_rates(df: DataFrame, by: Sequence[str] = ("bank",), outcome: str = "outcome") -> DataFrame:
    """Approved over all labelled cases, cancelled in the denominator; a missing outcome is an error."""
    missing = F.count_if(F.col(outcome).isNull())
    rate = F.avg((F.col(outcome) == APPROVED).cast("int"))
    checked = F.when(
        missing > 0, F.raise_error(F.lit("a case of a bank has no outcome")).cast("double")
    ).otherwise(rate)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cases"), checked.alias("approval_rate"))


def temporal_split(
    df: DataFrame, by: Sequence[str] = ("bank",), ratios: tuple[float, float] = (0.6, 0.2),
    start: str = "start_time", case: str = "case_id",
) -> DataFrame:
    """Train, validation and test by case start inside each group.

    Group sizes round half to even. The order of (start, case) is cut into even ranges, so cases of one day or
    one instant, and a group without a name, are spread as well.
    """
    placed = range_ranked(df, list(by), [start, case], "__rank", "__n")
    train = F.rint(F.col("__n") * F.lit(ratios[0]))
    val = F.rint(F.col("__n") * F.lit(ratios[1]))
    split = (
        F.when(F.col("__rank") < train, "train").when(F.col("__rank") < train + val, "val").otherwise("test")
    )
    return placed.withColumn("split", split).drop("__rank", "__n")


SPLITS = ("train", "val", "test")


def small_splits(df: DataFrame, by: Sequence[str] = ("bank",), least: int = 200) -> DataFrame:
    """Splits with fewer cases than ``least``, also those without any (the warning list)."""
    by = list(by)
    sizes = df.groupBy(*by).agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    return sizes.unpivot(by, list(SPLITS), "split", "n_cases").filter(F.col("n_cases") < least)


def partition_warnings(report: DataFrame, splits: DataFrame) -> DataFrame:
    """``(kind, bank, split, n)`` of a run: rules that met their cap, from ``gap_report``, and ``small_splits``."""
    caps = report.filter("cap_hit").select(
        F.lit("cap").alias("kind"), "bank", F.lit(None).cast("string").alias("split"), F.col("dropped").alias("n")
    )
    return caps.unionByName(splits.select(F.lit("small split").alias("kind"), "bank", "split", F.col("n_cases").alias("n")))


def split_events(events: DataFrame, assigned: DataFrame, case: str = "case_id") -> DataFrame:
    """Bank and split on every event; events of dropped cases disappear."""
    return events.join(assigned.select(case, "bank", "split"), case)


def central_union(events: DataFrame) -> DataFrame:
    """Pooled split: the same rows without a bank."""
    return events.drop("bank")


def compare_configs(summary: DataFrame, config: str = "config", records: DataFrame | None = None) -> DataFrame:
    """Case share of each bank in its layout and the layout's rate spread.

    With ``records`` of the runs, the 13 columns of :func:`provenance_columns` follow; layouts without a record have nulls.
    """
    if records is not None:
        summary = summary.join(provenance_columns(records).withColumnRenamed("config", config), config, "left")
    w = Window.partitionBy(config)  # one row per bank of a layout
    return summary.withColumns(
        {
            "case_share": F.col("n_cases") / F.sum("n_cases").over(w),
            "rate_spread": F.max("approval_rate").over(w) - F.min("approval_rate").over(w),
        }
    )


def provenance_columns(records: DataFrame) -> DataFrame:
    """``config`` and the 13 provenance columns of a layout comparison, from the records of ``sources.tables.read_records``.

    Gaps and drops stand in the columns of the layout's own strategy, null in the others.
    """
    e = {
        "target_ab_gap": "target_ab_gap", "target_bc_gap": "target_bc_gap", "final_ab_gap": "final_ab_gap",
        "final_bc_gap": "final_bc_gap", "dropped_total": "dropped",
    }
    return records.select(
        "config", F.col("cases.available").alias("n_cases_available_after_filters"),
        F.col("cases.assigned").alias("n_cases_assigned"), F.col("cases.left_out").alias("n_cases_unassigned_or_dropped"),
        *[
            F.when(F.col("strategy") == s, F.col(f"enforcement.{c}")).alias(f"{s}_{name}")
            for s in ("strong", "medium") for name, c in e.items()
        ],
    )


def goal_group(goal: str, groups: Mapping[str, Sequence[str]], other: str = "Other") -> Column:
    """Named group of a goal, ``other`` for unlisted or missing goals."""
    out = F.lit(other)
    for name, goals in reversed(list(groups.items())):
        out = F.when(F.col(goal).isin(*goals), F.lit(name)).otherwise(out)
    return out


# Names of the amount bands, lowest first.
AMOUNT_BANDS = ("Zero", "Q1 low", "Q2", "Q3", "Q4", "Q5 high")


def case_table(
    layouts: DataFrame, groups: Mapping[str, Sequence[str]], amount: str = "amount", goal: str = "goal",
    config: str = "config",
) -> DataFrame:
    """All layouts at case level with goal group and amount band per layout.

    Only positive amounts are banded; every other amount is in the zero band.
    """
    positive = layouts.withColumn("__pos", F.when(F.col(amount) > 0, F.col(amount)))
    cut = qcut(positive, "__pos", 5, [config], "__band")
    name = F.when(F.col("__band").isNull(), F.lit(AMOUNT_BANDS[0])).otherwise(
        _bank(F.col("__band") + 1, AMOUNT_BANDS)
    )
    return cut.withColumns({"amount_band": name, "goal_group": goal_group(goal, groups)}).drop("__band", "__pos")


def category_share(cases: DataFrame, category: str, order: Sequence[str], case: str = "case_id") -> DataFrame:
    """Distinct cases per (layout, bank, category) in percent of the row, absent cells 0."""
    one = cases.groupBy("config", "bank", category, case).agg(F.lit(1).alias("one"))
    counts = one.groupBy("config", "bank").agg(
        *[F.count_if(F.col(category) == c).cast("double").alias(c) for c in order]
    )
    total = sum((F.col(f"`{c}`") for c in order), F.lit(0.0))
    return counts.select(
        "config", "bank",
        *[(F.coalesce(F.try_divide(F.col(f"`{c}`"), total), F.lit(0.0)) * 100).alias(c) for c in order],
    )


def rates_pivot(summary: DataFrame, value: str, banks: Sequence[str], fill: float | None = None) -> DataFrame:
    """Layout by bank table of one value; missing banks are null or ``fill``."""
    wide = summary.groupBy("config").pivot("bank", list(banks)).agg(F.max(value))
    return wide if fill is None else wide.fillna(fill)


def overall_rate(summary: DataFrame, config: str = "iid_3banks") -> DataFrame:
    """Approval over all cases of the random layout, the stable reference."""
    return summary.filter(F.col("config") == config).agg(
        (F.sum("n_approved") / F.sum("n_cases")).alias("overall_rate")
    )


def dropped_by_config(cases: DataFrame, layouts: DataFrame, configs: Sequence[str], case: str = "case_id") -> DataFrame:
    """Cases each layout leaves out, 0 where nothing is dropped."""
    n = cases.agg(F.count(F.lit(1)).alias("__all"))
    kept = layouts.agg(*[F.count_if(F.col("config") == c).alias(c) for c in configs])
    long = kept.unpivot([], list(configs), "config", "assigned")
    return with_scalars(long, n).select("config", (F.col("__all") - F.col("assigned")).alias("dropped"))


def reconcile_counts(
    meta: DataFrame, assignment: DataFrame, splits: DataFrame | None = None, case: str = "case_id"
) -> DataFrame:
    """Initial, filtered, assigned and dropped cases, plus the number of small splits as warnings."""
    base = meta.agg(F.count(F.lit(1)).alias("initial"), F.count_if("has_terminal").alias("filtered"))
    assigned = assignment.agg(F.count(F.lit(1)).alias("assigned"))
    out = with_scalars(base, assigned)
    if splits is not None:
        out = with_scalars(out, small_splits(splits).agg(F.count(F.lit(1)).alias("warnings")))
    else:
        out = out.withColumn("warnings", F.lit(0).cast("long"))
    out = out.withColumn("dropped", F.col("filtered") - F.col("assigned"))
    steps = ["initial", "filtered", "assigned", "dropped", "warnings"]
    return out.select(*steps).unpivot([], steps, "step", "n")
