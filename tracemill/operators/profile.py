"""Profiling queries over a log or over one row per case.

Per-case facts are aggregates that combine map-side; quantiles of continuous
values are exact rank selections, quantiles of small counts use the built-in
``percentile``, whose buffer holds distinct counts only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.functions.labels import lookup, seconds_between
from tracemill.functions.ordered import Position, Whole, over_trace
from tracemill.functions.quantiles import banded, describe, quantiles, with_scalars
from tracemill.log import LogSpec
from tracemill.operators.trace import event_position


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def log_overview(df: DataFrame, spec: LogSpec, resource: str) -> DataFrame:
    """Cases, events, time range, number of columns, distinct activities and resources.

    Each distinct count reads its own column only and is a grouping of its own, so no row is multiplied.
    """
    base = df.agg(
        F.count(F.lit(1)).alias("events"), F.min(spec.ts).alias("first_ts"), F.max(spec.ts).alias("last_ts"),
        F.lit(len(df.columns)).alias("n_columns"),
    )
    for name, col in (("cases", spec.case), ("activities", spec.activity), ("resources", resource)):
        base = with_scalars(base, df.select(col).distinct().agg(F.count(col).alias(name)))
    return base.select("cases", "events", "first_ts", "last_ts", "n_columns", "activities", "resources")


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null count and share per column, in one scan of those columns."""
    counted = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counted.unpivot(["__n"], list(cols), "column_name", "nulls").select(
        "column_name", "nulls", _share(F.col("nulls"), F.col("__n")).alias("null_share")
    )


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Frequency of each non-null value."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))


def _unstable(attr: str) -> Column:
    some, none = F.count(attr) > 0, F.count_if(F.col(attr).isNull()) > 0
    return (some & none) | F.coalesce(F.min(attr) != F.max(attr), F.lit(False))


def attribute_stability(df: DataFrame, spec: LogSpec, attr: str) -> DataFrame:
    """Cases whose attribute takes more than one value, null counting as a value."""
    per_case = df.groupBy(spec.case).agg(_unstable(attr).alias("changing"))
    n = F.count(F.lit(1))
    return per_case.agg(
        n.alias("cases"),
        F.count_if("changing").alias("changing_cases"),
        _share(F.count_if("changing"), n).alias("changing_share"),
    )


def attribute_history(df: DataFrame, spec: LogSpec, attr: str, n: int = 10) -> DataFrame:
    """Value history of the first ``n`` changing cases (by id)."""
    ids = (
        df.groupBy(spec.case).agg(_unstable(attr).alias("changing"))
        .filter("changing").select(spec.case).orderBy(spec.case).limit(n)
    )
    return df.join(F.broadcast(ids), spec.case, "left_semi").select(spec.case, spec.ts, attr).distinct()


def case_decisions(df: DataFrame, spec: LogSpec, mapping: Mapping[str, int], label: str) -> DataFrame:
    """Per case: number of decision events, of distinct decision labels, last label and class."""
    dec = F.col(label).isin(*mapping)
    return df.groupBy(spec.case).agg(
        F.count_if(dec).alias("n_decisions"),
        # Bounded by the number of decision labels.
        F.size(F.collect_set(F.when(dec, F.col(label)))).alias("n_distinct"),
        F.max_by(label, F.when(dec, spec.order_key())).alias("outcome_event"),
        F.max(spec.ts).alias("last_ts"),
    ).withColumn("outcome", lookup(mapping, F.col("outcome_event")))


def decision_ambiguity(df: DataFrame, spec: LogSpec, mapping: Mapping[str, int], label: str) -> DataFrame:
    """Cases with several decision events or labels, per class and without a decision."""
    per_case = case_decisions(df, spec, mapping, label)
    return per_case.agg(
        F.count_if(F.col("n_decisions") > 1).alias("several_events"),
        F.count_if(F.col("n_distinct") > 1).alias("several_labels"),
        *[F.count_if(F.col("outcome") == c).alias(f"class_{c}") for c in sorted(set(mapping.values()))],
        F.count("outcome").alias("decided"),
        F.count_if(F.col("outcome").isNull()).alias("undecided"),
    )


def undecided_last_seen(df: DataFrame, spec: LogSpec, mapping: Mapping[str, int], label: str) -> DataFrame:
    """Distribution of the last event time of undecided cases, epoch seconds."""
    last = case_decisions(df, spec, mapping, label).filter("outcome is null")
    out = describe(last, F.unix_micros("last_ts") / 1e6)
    return out.drop("std")


def terminal_position(df: DataFrame, spec: LogSpec, terminals: Sequence[str]) -> DataFrame:
    """Per terminal activity, where its last occurrence sits (1-based position)."""
    placed = event_position(df, spec)
    at = F.max_by(
        F.struct(F.col(spec.activity).alias("terminal"), "pos", "trace_len", "rel_pos"),
        F.when(F.col(spec.activity).isin(*terminals), F.col("pos")),
    )
    last = placed.groupBy(spec.case).agg(at.alias("last")).filter("last is not null").select("last.*")
    return last.groupBy("terminal").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.avg(F.col("pos") + 1).alias("mean_pos"),
        F.avg("trace_len").alias("mean_len"),
        F.avg("rel_pos").alias("mean_rel_pos"),
    )


def _terminal_cases(df: DataFrame, spec: LogSpec, terminals: Sequence[str], facts: list[Column]) -> DataFrame:
    last = F.max_by(spec.activity, F.when(F.col(spec.activity).isin(*terminals), spec.order_key()))
    return df.groupBy(spec.case).agg(last.alias("terminal"), *facts).filter("terminal is not null")


def presence_by_terminal(df: DataFrame, spec: LogSpec, terminals: Sequence[str], listed: Sequence[str]) -> DataFrame:
    """Per terminal state: cases and cases holding any listed activity."""
    has = F.bool_or(F.coalesce(F.col(spec.activity).isin(*listed), F.lit(False))).alias("has")
    cases = _terminal_cases(df, spec, terminals, [has])
    return cases.groupBy("terminal").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if("has").alias("n_with"),
        F.avg(F.col("has").cast("int")).alias("share_with"),
    )


def activity_by_terminal(df: DataFrame, spec: LogSpec, terminals: Sequence[str], listed: Sequence[str]) -> DataFrame:
    """Crosstab of listed activities by final state, zero-filled.

    Listed events are counted per case first, so events never join to cases.
    """
    facts = [F.count_if(F.col(spec.activity) == a).alias(f"n_{a}") for a in listed]
    cases = _terminal_cases(df, spec, terminals, facts)
    return cases.groupBy("terminal").agg(*[F.sum(f"n_{a}").alias(f"n_{a}") for a in listed])


def relative_order(df: DataFrame, spec: LogSpec, terminals: Sequence[str], listed: Sequence[str]) -> DataFrame:
    """Listed events before, at and after the final terminal event of their case."""
    key = spec.order_key()
    term = F.when(F.col(spec.activity).isin(*terminals), F.struct(key.alias("k"), F.col(spec.activity).alias("a")))
    placed = over_trace(df, spec, [Whole("__term", term, "max")]).filter(
        F.col("__term").isNotNull() & F.col(spec.activity).isin(*listed)
    )
    at = F.col("__term.k")
    return placed.groupBy(F.col("__term.a").alias("terminal"), spec.activity).agg(
        F.count_if(key < at).alias("before"),
        F.count_if(key == at).alias("same"),
        F.count_if(key > at).alias("after"),
    )


def prefix_crosstab(df: DataFrame, col: str, pattern: str, by: str, values: Sequence[str]) -> DataFrame:
    """Crosstab of a label prefix (first regex group) by another column, zero-filled."""
    prefix = F.regexp_extract(col, pattern, 1)
    return df.groupBy(prefix.alias("prefix")).agg(
        *[F.count_if(F.col(by) == v).alias(f"n_{v}") for v in values]
    )


def case_duration(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Duration of each case in days."""
    days = seconds_between(F.max(spec.ts), F.min(spec.ts)) / F.lit(86400.0)
    return df.groupBy(spec.case).agg(days.alias("days"))


def duration_summary(durations: DataFrame) -> DataFrame:
    """Mean, median, 95th and 99th percentile of case duration."""
    base = durations.agg(F.count("days").alias("n"), F.avg("days").alias("mean"))
    return with_scalars(base, quantiles(durations, F.col("days"), {"median": 0.5, "p95": 0.95, "p99": 0.99}))


def duration_histogram(durations: DataFrame, bins: int = 60, clip: float = 0.99) -> DataFrame:
    """Equal-width histogram of durations clipped at a quantile: one row per bin, 0 for an empty one.

    If all durations are equal they are in the first bin.
    """
    bounds = quantiles(durations, F.col("days"), {"__low": 0.0, "__high": clip})
    x = F.least("days", "__high")
    width = F.col("__high") - F.col("__low")
    at = F.coalesce(F.floor(F.try_divide(x - F.col("__low"), width) * bins), F.lit(0))
    counted = (
        with_scalars(durations.filter(F.col("days").isNotNull()), bounds)
        .groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    axis = durations.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return axis.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def prefix_cap(df: DataFrame, spec: LogSpec, mapping: Mapping[str, int], label: str, q: float = 0.98) -> DataFrame:
    """Length cap at a quantile of case length and the decisions that lie beyond it."""
    dec = F.col(label).isin(*mapping)
    placed = over_trace(df, spec, [Position("pos")])
    cases = placed.groupBy(spec.case).agg(
        F.count(F.lit(1)).alias("n"), (F.max(F.when(dec, F.col("pos"))) + 1).alias("decision_len")
    )
    base = cases.agg(
        F.avg("n").alias("mean_len"), F.max("n").alias("max_len"), F.percentile("n", F.lit(q)).alias("q_len")
    ).withColumn("cap", F.floor("q_len"))
    over = F.col("decision_len") > F.col("cap")
    gap = F.when(over, F.col("decision_len") - F.col("cap"))
    return with_scalars(cases, base).agg(
        F.max("mean_len").alias("mean_len"),
        F.max("max_len").alias("max_len"),
        F.max("q_len").alias("q_len"),
        F.max("cap").alias("cap"),
        F.count_if(over).alias("beyond"),
        _share(F.count_if(over), F.count("decision_len")).alias("beyond_share"),
        F.coalesce(F.max(gap), F.lit(0)).alias("max_gap"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_gap"),
        F.coalesce(F.max(F.when(over, F.col("decision_len"))), F.max("cap")).alias("longest"),
    )


def quantile_table(cases: DataFrame, col: str, probs: Mapping[str, float]) -> DataFrame:
    """Min, max, mean and listed percentiles over one row per case."""
    base = cases.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))
    return with_scalars(base, quantiles(cases, F.col(col), dict(probs)))


def rate_by_band(cases: DataFrame, amount: str, approved: Column, q: int = 5) -> DataFrame:
    """Approval per amount band over positive amounts, with the overall rate."""
    positive = cases.filter(F.col(amount) > 0).withColumn("__ok", F.coalesce(approved, F.lit(False)))
    bands = banded(positive, amount, q).groupBy("band").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("__ok").alias("approved"),
        F.min(amount).alias("amount_min"),
        F.max(amount).alias("amount_max"),
    )
    every = Window.partitionBy()  # at most q rows
    return bands.select(
        "*",
        (F.col("approved") / F.col("total")).alias("rate"),
        (F.sum("approved").over(every) / F.sum("total").over(every)).alias("overall_rate"),
    )


def zero_by_type(cases: DataFrame, amount: str, kind: str) -> DataFrame:
    """Per type: cases, zero-amount cases, zero share within the type and share among zeros."""
    zero = F.col(amount) == 0
    per = cases.groupBy(kind).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(zero).alias("n_zero"))
    every = Window.partitionBy()  # one row per type
    return per.select(
        kind, "n_total", "n_zero",
        (F.col("n_zero") / F.col("n_total")).alias("zero_share"),
        _share(F.col("n_zero"), F.sum("n_zero").over(every)).alias("share_of_zeros"),
        _share(F.sum("n_zero").over(every), F.sum("n_total").over(every)).alias("overall_zero_share"),
    )


def zero_outcome_shares(cases: DataFrame, amount: str, outcome: str) -> DataFrame:
    """Outcome distribution of zero-amount cases against all cases, undecided included."""
    label = F.coalesce(F.col(outcome), F.lit("no_outcome"))
    per = cases.groupBy(label.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(amount) == 0).alias("n_zero")
    )
    every = Window.partitionBy()  # one row per outcome
    return per.select(
        "outcome",
        F.when(F.col("n_zero") > 0, F.col("n_zero") / F.sum("n_zero").over(every)).alias("zero_share"),
        (F.col("n") / F.sum("n").over(every)).alias("all_share"),
    )


def zero_outcome_by_type(cases: DataFrame, amount: str, kind: str, outcome: str, outcomes: Sequence[str]) -> DataFrame:
    """Row-normalised crosstab of outcome by type among zero-amount cases."""
    label = F.coalesce(F.col(outcome), F.lit("no_outcome"))
    zero = cases.filter(F.col(amount) == 0)
    return zero.groupBy(kind).agg(
        *[F.avg((label == o).cast("int")).alias(f"share_{o}") for o in outcomes]
    )


def rate_by_category(cases: DataFrame, category: str, approved: Column) -> DataFrame:
    """Approval per category with the overall rate, highest first."""
    per = cases.groupBy(category).agg(F.count(F.lit(1)).alias("total"), F.count_if(approved).alias("approved"))
    every = Window.partitionBy()  # one row per category
    return per.select(
        category, "total", "approved",
        (F.col("approved") / F.col("total")).alias("rate"),
        (F.sum("approved").over(every) / F.sum("total").over(every)).alias("overall_rate"),
    ).orderBy(F.desc("rate"), category)


def first_present_position(df: DataFrame, spec: LogSpec, cols: Sequence[str]) -> DataFrame:
    """Index of the first event with any listed column present, over cases."""
    present = F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()
    placed = over_trace(df, spec, [Position("pos")])
    cases = placed.groupBy(spec.case).agg(F.min(F.when(present, F.col("pos"))).alias("first_pos"))
    return cases.agg(
        F.count("first_pos").alias("n_with"),
        F.count_if(F.col("first_pos").isNull()).alias("n_without"),
        F.avg("first_pos").alias("mean"),
        F.stddev_samp("first_pos").alias("std"),
        F.min("first_pos").alias("min"),
        F.percentile("first_pos", F.lit(0.25)).alias("p25"),
        F.percentile("first_pos", F.lit(0.5)).alias("p50"),
        F.percentile("first_pos", F.lit(0.75)).alias("p75"),
        F.max("first_pos").alias("max"),
    )


def occurrences(df: DataFrame, spec: LogSpec, activity: str) -> DataFrame:
    """Events of one activity per case that has any."""
    return df.filter(F.col(spec.activity) == activity).groupBy(spec.case).agg(
        F.count(F.lit(1)).alias("occurrences")
    )


def occurrence_summary(counts: DataFrame) -> DataFrame:
    """Distribution of occurrences per case."""
    c = "occurrences"
    return counts.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        F.percentile(c, F.lit(0.25)).alias("p25"), F.percentile(c, F.lit(0.5)).alias("p50"),
        F.percentile(c, F.lit(0.75)).alias("p75"), F.max(c).alias("max"),
    )


def occurrence_frequency(counts: DataFrame, first: int = 10) -> DataFrame:
    """How many cases have 1, 2, … occurrences; the lowest ``first`` counts."""
    return counts.groupBy("occurrences").agg(F.count(F.lit(1)).alias("n_cases")).orderBy("occurrences").limit(first)


def with_occurrences(cases: DataFrame, counts: DataFrame, case: str) -> DataFrame:
    """Occurrences attached to every case, 0 where there are none."""
    return cases.join(counts, case, "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))


def single_or_multiple(cases: DataFrame, amount: str) -> DataFrame:
    """Amount statistics of cases with one against several occurrences."""
    some = cases.filter("occurrences >= 1").withColumn(
        "occurrence_group", F.when(F.col("occurrences") > 1, "multiple").otherwise("single")
    )
    base = some.groupBy("occurrence_group").agg(F.count(amount).alias("n_cases"), F.avg(amount).alias("mean"))
    qs = quantiles(some, F.col(amount), {"median": 0.5, "q1": 0.25, "q3": 0.75}, ["occurrence_group"])
    return base.join(qs, "occurrence_group", "left")


def top_multiple_categories(cases: DataFrame, category: str, amount: str, n: int = 10) -> DataFrame:
    """Categories with most multiple-occurrence cases."""
    multi = cases.filter("occurrences > 1")
    base = multi.groupBy(category).agg(
        F.count(F.lit(1)).alias("n_cases"), F.avg("occurrences").alias("mean_occurrences")
    )
    med = quantiles(multi, F.col(amount), {"median_amount": 0.5}, [category])
    return base.join(med, category, "left").orderBy(F.desc("n_cases"), category).limit(n)


def multiple_share_by_category(cases: DataFrame, category: str) -> DataFrame:
    """Share of multiple-occurrence cases per category."""
    multi = F.count_if(F.col("occurrences") > 1)
    return cases.groupBy(category).agg(
        F.count(F.lit(1)).alias("n_cases"), multi.alias("n_multi"), (multi / F.count(F.lit(1))).alias("share_multi")
    )


def first_two(df: DataFrame, spec: LogSpec, activity: str, attrs: Sequence[str]) -> DataFrame:
    """First and second occurrence of an activity side by side, cases with both.

    The rank limit is applied before the shuffle, so a hot case sends two rows
    per map task only.
    """
    w = Window.partitionBy(spec.case).orderBy(*spec.order)
    ranked = (
        df.filter(F.col(spec.activity) == activity)
        .select(spec.case, *spec.order, *attrs)
        .withColumn("__rank", F.row_number().over(w))
        .filter("__rank <= 2")
    )
    at = lambda r, a: F.max(F.when(F.col("__rank") == r, F.col(a)))
    return (
        ranked.groupBy(spec.case)
        .agg(
            F.max("__rank").alias("__n"),
            *[at(1, a).alias(f"first_{a}") for a in attrs],
            *[at(2, a).alias(f"second_{a}") for a in attrs],
        )
        .filter("__n = 2")
        .drop("__n")
    )


def first_vs_second(pairs: DataFrame, attrs: Sequence[str], zero_missing: Sequence[str] = ()) -> DataFrame:
    """Per attribute: comparable and changed pairs, median change and median absolute change."""

    def val(side: str, a: str) -> Column:
        c = F.col(f"{side}_{a}").cast("double")
        return F.nullif(c, F.lit(0.0)) if a in zero_missing else c

    deltas = pairs.select(*[(val("second", a) - val("first", a)).alias(a) for a in attrs])
    long = deltas.unpivot([], list(attrs), "attribute", "delta")
    changed = F.when(F.col("delta") != 0, F.col("delta"))
    base = long.groupBy("attribute").agg(
        F.count("delta").alias("comparable"), F.count(changed).alias("changed")
    )
    moved = long.filter("delta != 0")
    med = quantiles(moved, F.col("delta"), {"median_delta": 0.5}, ["attribute"])
    med_abs = quantiles(moved, F.abs("delta"), {"median_abs_delta": 0.5}, ["attribute"])
    out = base.join(med, "attribute", "left").join(med_abs, "attribute", "left")
    return out.withColumn("changed_share", F.col("changed") / F.greatest("comparable", F.lit(1)))


def availability_transitions(pairs: DataFrame, score: str, others: Sequence[str]) -> DataFrame:
    """Score turning from missing (0) to present and back, with and without other changes.

    As in a frame comparison, a null score is not zero.
    """
    first_zero = F.coalesce(F.col(f"first_{score}") == 0, F.lit(False))
    second_zero = F.coalesce(F.col(f"second_{score}") == 0, F.lit(False))
    moved = F.lit(False)
    for o in others:
        moved = moved | F.coalesce((F.col(f"second_{o}") - F.col(f"first_{o}")) != 0, F.lit(False))
    return pairs.agg(
        F.count_if(first_zero & ~second_zero).alias("gained"),
        F.count_if(~first_zero & second_zero).alias("lost"),
        F.count_if(first_zero & ~second_zero & moved).alias("gained_with_changes"),
        F.count_if(first_zero & ~second_zero & ~moved).alias("gained_without_changes"),
    )


def starts_per_month(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Case starts per calendar month and the median month."""
    starts = df.groupBy(spec.case).agg(F.min(spec.ts).alias("start"))
    months = starts.groupBy(F.date_format(F.date_trunc("month", "start"), "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_starts")
    )
    # One row per calendar month.
    return with_scalars(months, months.agg(F.percentile("n_starts", F.lit(0.5)).alias("median_month")))


def resource_volume(df: DataFrame, resource: str, top: int = 10, bottom: int = 5) -> DataFrame:
    """Busiest and least busy resources with their event counts."""
    per = value_counts(df, resource, "n_events")
    tag = lambda side, frame: frame.withColumn("side", F.lit(side))
    busiest = per.orderBy(F.desc("n_events"), resource).limit(top)
    least = per.orderBy("n_events", F.desc(resource)).limit(bottom)
    return tag("top", busiest).unionByName(tag("bottom", least))


def resource_concentration(df: DataFrame, resource: str) -> DataFrame:
    """Distinct resources, null share, volume distribution and share of the top one and five."""
    per = df.groupBy(resource).agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col(resource).isNotNull(), F.col("n"))
    total = F.sum("n")
    top5 = (
        per.filter(F.col(resource).isNotNull()).orderBy(F.desc("n")).limit(5)
        .agg(F.max("n").alias("__top1"), F.sum("n").alias("__top5"))
    )
    base = per.agg(
        F.count(named).alias("resources"),
        total.alias("events"),
        _share(total - F.coalesce(F.sum(named), F.lit(0)), total).alias("null_share"),
        F.sum(named).alias("__named"),
        F.avg(named).alias("mean"), F.stddev_samp(named).alias("std"), F.min(named).alias("min"),
        F.percentile(named, F.lit(0.25)).alias("p25"), F.percentile(named, F.lit(0.5)).alias("p50"),
        F.percentile(named, F.lit(0.75)).alias("p75"), F.max(named).alias("max"),
    )
    out = with_scalars(base, top5)
    return out.select(
        *[c for c in base.columns if not c.startswith("__")],
        _share(F.col("__top1"), F.col("__named")).alias("top1_share"),
        _share(F.col("__top5"), F.col("__named")).alias("top5_share"),
    )


def compare_logs(overviews: Mapping[str, DataFrame]) -> DataFrame:
    """Side-by-side headline table: one row per metric, one column per log."""
    metrics = ["cases", "events", "first_day", "last_day", "activities", "resources"]
    parts = []
    for name, o in overviews.items():
        row = o.select(
            F.lit(name).alias("log"),
            F.col("cases").cast("string").alias("cases"),
            F.col("events").cast("string").alias("events"),
            F.to_date("first_ts").cast("string").alias("first_day"),
            F.to_date("last_ts").cast("string").alias("last_day"),
            F.col("activities").cast("string").alias("activities"),
            F.col("resources").cast("string").alias("resources"),
        )
        parts.append(row.unpivot(["log"], metrics, "metric", "value"))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.groupBy("metric").pivot("log", list(overviews)).agg(F.max("value"))


def outcome_alignment(a: DataFrame, b: DataFrame, classes: Mapping[int, str]) -> DataFrame:
    """Outcome labels of two logs that share a class, with their case counts.

    ``a`` and ``b`` hold one row per decided case (``outcome``, ``outcome_event``).
    """

    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("outcome", F.col("outcome_event").alias(f"label_{side}")).agg(
            F.count(F.lit(1)).alias(f"n_{side}")
        )

    both = counted(a, "a").join(counted(b, "b"), "outcome", "full_outer")
    return both.withColumn("meaning", lookup(classes, F.col("outcome")))
