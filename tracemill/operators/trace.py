"""Operators on the events of a case: labels, cuts, targets and carried state.

Aggregates per case combine map-side and are safe for a case of any size;
ordered features go through :func:`tracemill.functions.ordered.over_trace`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.functions.labels import (
    END_TOKEN,
    any_present,
    cycle,
    lookup,
    seconds_between,
    token,
)
from tracemill.functions.ordered import Following, Latest, Position, Preceding, Whole, ordered, over_trace
from tracemill.log import LogSpec


def activity_token(df: DataFrame, spec: LogSpec, name: str = "token") -> DataFrame:
    """Add ``activity+lifecycle``; null when either is null."""
    return df.withColumn(name, token(spec.activity, spec.lifecycle))


def filter_lifecycle(df: DataFrame, spec: LogSpec, keep: str) -> DataFrame:
    """Keep one lifecycle value; null lifecycles are dropped."""
    return df.filter(F.col(spec.lifecycle) == keep)


def lifecycle_report(df: DataFrame, spec: LogSpec, keep: str) -> DataFrame:
    """Events before and after the lifecycle filter and the share dropped."""
    kept = F.count_if(F.col(spec.lifecycle) == keep)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("events_before"),
        kept.alias("events_after"),
        F.coalesce(F.try_divide(n - kept, n), F.lit(0.0)).alias("share_dropped"),
    )


def dropped_labels(df: DataFrame, spec: LogSpec, kept: Column) -> DataFrame:
    """Activities with events before a filter but none after it, in one aggregation."""
    return (
        df.groupBy(spec.activity)
        .agg(F.count(F.lit(1)).alias("events_before"), F.count_if(kept).alias("events_after"))
        .filter((F.col("events_after") == 0) & F.col(spec.activity).isNotNull())
        .select(spec.activity, "events_before")
    )


def event_position(df: DataFrame, spec: LogSpec) -> DataFrame:
    """0-based position, trace length and relative position ``(pos + 1) / length``."""
    out = over_trace(
        df, spec, [Position("pos"), Whole("trace_len", F.lit(1).cast("long"), "sum")]
    )
    return out.withColumn("rel_pos", (F.col("pos") + 1) / F.col("trace_len"))


def decision_class(label: str, mapping: Mapping[str, int]) -> Column:
    """Class id of a decision label, null for every other label."""
    return lookup(mapping, F.col(label))


def outcome_table(df: DataFrame, spec: LogSpec, mapping: Mapping[str, int], label: str | None = None) -> DataFrame:
    """Last decision event per case with its time, position and class.

    Ties in time are broken by the log order. Cases without a decision are
    absent; a log without decisions gives an empty frame of the same schema.
    """
    label = label or spec.activity
    pos = over_trace(df, spec, [Position("pos")])
    life = F.col(spec.lifecycle) if spec.lifecycle else F.lit(None).cast("string")
    last = F.max_by(
        F.struct(
            F.col(label).alias("outcome_event"),
            F.col(spec.ts).alias("outcome_time"),
            F.col("pos").alias("outcome_pos"),
            life.alias("outcome_lifecycle"),
        ),
        F.col("pos"),
    )
    return (
        pos.filter(F.col(label).isin(*mapping))
        .groupBy(spec.case)
        .agg(
            last.alias("last"),
            F.count(F.lit(1)).alias("n_decisions"),
            # Bounded by the number of decision labels.
            F.size(F.collect_set(label)).cast("long").alias("n_distinct_decisions"),
        )
        .select(
            spec.case, "last.*", lookup(mapping, F.col("last.outcome_event")).alias("outcome"),
            "n_decisions", "n_distinct_decisions",
        )
    )


def decision_lifecycles(df: DataFrame, spec: LogSpec, decisions: Sequence[str]) -> DataFrame:
    """Decision activities seen with more than one lifecycle value."""
    return (
        df.filter(F.col(spec.activity).isin(*decisions))
        .groupBy(spec.activity)
        .agg(F.count_distinct(spec.lifecycle).alias("n_lifecycles"))
        .filter(F.col("n_lifecycles") > 1)
    )


def with_decision_key(df: DataFrame, spec: LogSpec, mapping: Mapping[str, int], label: str | None = None) -> DataFrame:
    """Add the order key of the last decision of the case (null when undecided)."""
    is_decision = F.col(label or spec.activity).isin(*mapping)
    return over_trace(
        df, spec, [Whole("decision_key", F.when(is_decision, spec.order_key()), "max")]
    )


def cut_at_decision(df: DataFrame, spec: LogSpec, mapping: Mapping[str, int], label: str | None = None) -> DataFrame:
    """Drop events after the last decision; undecided cases pass untouched."""
    keyed = with_decision_key(df, spec, mapping, label)
    return keyed.filter(
        F.col("decision_key").isNull() | (spec.order_key() <= F.col("decision_key"))
    ).drop("decision_key")


def cut_report(df: DataFrame, spec: LogSpec, mapping: Mapping[str, int], label: str | None = None) -> DataFrame:
    """Seven counters of the cut; the share is over events of decided cases, 0 if none."""
    label = label or spec.activity
    keyed = with_decision_key(df, spec, mapping, label)
    decided = F.col("decision_key").isNotNull()
    per_case = keyed.groupBy(spec.case).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(decided & (spec.order_key() > F.col("decision_key"))).alias("removed"),
        F.count_if(F.col(label).isin(*mapping)).alias("decisions"),
        F.size(F.collect_set(F.when(F.col(label).isin(*mapping), F.col(label)))).alias("distinct_decisions"),
    )
    base = F.coalesce(F.sum(F.when(F.col("decisions") > 0, F.col("n"))), F.lit(0))
    removed = F.coalesce(F.sum("removed"), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_case.agg(
        F.count_if(F.col("decisions") > 0).alias("cases_with_outcome"),
        F.count_if(F.col("decisions") > 1).alias("cases_with_multiple_outcome_events"),
        F.count_if(F.col("distinct_decisions") > 1).alias("cases_with_multiple_distinct_outcomes"),
        total.alias("events_before_cut"),
        (total - removed).alias("events_after_cut"),
        removed.alias("events_removed"),
        F.coalesce(F.try_divide(removed, base), F.lit(0.0)).alias("share_removed"),
    )


def validate_cut(df: DataFrame, spec: LogSpec, mapping: Mapping[str, int], next_col: str, label: str | None = None) -> DataFrame:
    """Violations left in a cut log: events past the decision, cases not closed by the end token."""
    key = spec.order_key()
    per_case = with_decision_key(df, spec, mapping, label).groupBy(spec.case).agg(
        F.count_if(key > F.col("decision_key")).alias("late"),
        F.max_by(next_col, key).alias("last_next"),
    )
    return per_case.agg(
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("events_after_decision"),
        F.count_if(~F.col("last_next").eqNullSafe(F.lit(END_TOKEN))).alias("cases_without_end"),
    )


def next_activity(df: DataFrame, spec: LogSpec, label: str, name: str = "next_token") -> DataFrame:
    """Label of the next event of the case, the end token on the last."""
    return over_trace(df, spec, [Following(name, F.col(label), END_TOKEN)])


def remaining_and_elapsed(df: DataFrame, spec: LogSpec) -> DataFrame:
    """Seconds to the end and from the start of the case."""
    out = over_trace(
        df, spec,
        [Whole("case_end", F.col(spec.ts), "max"), Whole("case_start", F.col(spec.ts), "min")],
    )
    return (
        out.withColumn("remaining_seconds", seconds_between(F.col("case_end"), F.col(spec.ts)))
        .withColumn("elapsed_seconds", seconds_between(F.col(spec.ts), F.col("case_start")))
        .drop("case_end", "case_start")
    )


def time_since_previous(df: DataFrame, spec: LogSpec, index: str | None = None) -> DataFrame:
    """Seconds since the previous event, 0.0 on the first.

    Events are taken in the log order, or in the given order of ``index`` (a
    position in the case), where a negative gap shows a wrongly ordered source.
    """
    feature = Preceding("previous_ts", F.col(spec.ts))
    if index is None:
        out = over_trace(df, spec, [feature])
    else:
        segment = None if spec.hot is None else F.floor(F.col(index) / 1_000_000)
        out = ordered(df, [spec.case], [index], [feature], segment)
    gap = seconds_between(F.col(spec.ts), F.col("previous_ts"))
    return out.withColumn("since_previous", F.coalesce(gap, F.lit(0.0))).drop("previous_ts")


def negative_gaps(df: DataFrame, gap: str = "since_previous") -> DataFrame:
    """Guard for :func:`time_since_previous`: number of negative gaps and the worst one."""
    return df.agg(
        F.count_if(F.col(gap) < 0).alias("negative_gaps"),
        F.coalesce(F.min(gap), F.lit(0.0)).alias("smallest_gap"),
    )


def calendar_cycle(df: DataFrame, spec: LogSpec) -> DataFrame:
    """sin and cos of weekday (Monday = 0) and hour, in UTC."""
    day_sin, day_cos = cycle(F.weekday(spec.ts), 7)
    hour_sin, hour_cos = cycle(F.hour(spec.ts), 24)
    return df.withColumns(
        {"weekday_sin": day_sin, "weekday_cos": day_cos, "hour_sin": hour_sin, "hour_cos": hour_cos}
    )


def case_metadata(
    df: DataFrame, spec: LogSpec, statics: Mapping[str, str], outcomes: DataFrame | None = None
) -> DataFrame:
    """One row per case: start, end, size and first non-null static attributes.

    ``statics`` maps output names to event columns. With ``outcomes`` the class,
    the decision label and a has-terminal flag are joined on.
    """
    key = spec.order_key()
    meta = df.groupBy(spec.case).agg(
        F.min(spec.ts).alias("start_time"),
        F.max(spec.ts).alias("end_time"),
        F.count(F.lit(1)).alias("n_events"),
        *[F.min_by(src, F.when(F.col(src).isNotNull(), key)).alias(out) for out, src in statics.items()],
    )
    if outcomes is None:
        return meta
    return with_outcomes(meta, spec, outcomes)


def with_outcomes(meta: DataFrame, spec: LogSpec, outcomes: DataFrame) -> DataFrame:
    """Attach outcome, outcome label and the has-terminal flag to case rows."""
    picked = outcomes.select(spec.case, "outcome", "outcome_event", F.lit(True).alias("__has"))
    return (
        meta.join(picked, spec.case, "left")
        .withColumn("has_terminal", F.coalesce("__has", F.lit(False)))
        .drop("__has")
    )


def case_table(
    df: DataFrame, spec: LogSpec, statics: Mapping[str, str], mapping: Mapping[str, int], label: str | None = None
) -> DataFrame:
    """Case rows of the cut log with their outcome, in one shuffle.

    Equals ``case_metadata(cut_at_decision(df), outcome_table(df))``: start and
    statics only look at events up to the last decision.
    """
    label = label or spec.activity
    is_decision = F.col(label).isin(*mapping)
    # The position orders the events of a case, and compares faster than the order columns.
    keyed = over_trace(
        df, spec,
        [Position("__pos"), Whole("decision_key", F.when(is_decision, spec.order_key()), "max")],
    )
    key = F.col("__pos")
    kept = F.col("decision_key").isNull() | (spec.order_key() <= F.col("decision_key"))
    meta = keyed.groupBy(spec.case).agg(
        F.min(spec.ts).alias("start_time"),
        F.max(F.when(kept, F.col(spec.ts))).alias("end_time"),
        F.count_if(kept).alias("n_events"),
        *[
            F.min_by(src, F.when(kept & F.col(src).isNotNull(), key)).alias(out)
            for out, src in statics.items()
        ],
        F.max_by(label, F.when(is_decision, key)).alias("outcome_event"),
    )
    return meta.withColumn("outcome", lookup(mapping, F.col("outcome_event"))).withColumn(
        "has_terminal", F.col("outcome_event").isNotNull()
    )


def drop_truncated(meta: DataFrame) -> DataFrame:
    """Keep decided cases; zero amounts and cancelled cases stay."""
    return meta.filter("has_terminal").drop("has_terminal")


def truncated_report(meta: DataFrame, amount: str = "amount", cancelled: int = 0) -> DataFrame:
    """Counts of the truncation filter."""
    keep = F.col("has_terminal")
    return meta.agg(
        F.count(F.lit(1)).alias("cases_before"),
        F.count_if(~keep).alias("cases_truncated"),
        F.count_if(keep).alias("cases_kept"),
        F.count_if(keep & (F.col(amount) == 0)).alias("zero_amount_kept"),
        F.count_if(keep & (F.col("outcome") == cancelled)).alias("cancelled_kept"),
    )


def attach_case_label(df: DataFrame, spec: LogSpec, meta: DataFrame, cols: Sequence[str] = ("outcome",)) -> DataFrame:
    """Repeat case columns on every event; events of unlisted cases are dropped."""
    return df.join(meta.select(spec.case, *cols), spec.case)


def zero_as_missing(df: DataFrame, col: str) -> DataFrame:
    """Zero becomes null."""
    return df.withColumn(col, F.nullif(F.col(col), F.lit(0).cast(df.schema[col].dataType)))


def any_present_mask(df: DataFrame, cols: Sequence[str], name: str = "present") -> DataFrame:
    """1 where any source column is present, else 0; 0 when no column is listed."""
    return df.withColumn(name, any_present(cols))


def carry_state(df: DataFrame, spec: LogSpec, mask: str, cols: Sequence[str], prefix: str = "state_") -> DataFrame:
    """State of the latest masked row as a whole, carried forward.

    A null field of that row reads as 0.0, as do all fields before the first
    masked row; ``<prefix>present`` turns 1 at the first masked row and stays.
    """
    state = F.struct(*[F.col(c).alias(c) for c in cols])
    out = over_trace(df, spec, [Latest("__state", F.col(mask) == 1, state)])
    return out.withColumns(
        {
            f"{prefix}present": F.when(F.col("__state").isNotNull(), 1).otherwise(0),
            **{f"{prefix}{c}": F.coalesce(F.col("__state")[c], F.lit(0.0)) for c in cols},
        }
    ).drop("__state")


def check_events(
    df: DataFrame, keys: Sequence[str], index: str, outcome: str, required: Sequence[str], spec: LogSpec
) -> DataFrame:
    """Violations of the canonical event rules, one row per rule.

    Missing required columns raise at once. ``index`` must not fall inside a key
    in the log order, outcomes must be 0, 1 or 2.
    """
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    prev = over_trace(df, spec, [Preceding("__prev", F.col(index))], list(keys))
    counted = prev.agg(
        F.count_if(F.col("__prev") > F.col(index)).alias("index_not_monotonic"),
        F.count_if(F.col(outcome).isNull()).alias("outcome_missing"),
        F.count_if(F.col(outcome).isNotNull() & ~F.col(outcome).isin(0, 1, 2)).alias("outcome_unknown"),
    )
    return counted.unpivot([], counted.columns, "rule", "violations")


def monotonic_offenders(df: DataFrame, keys: Sequence[str], index: str, spec: LogSpec, n: int = 10) -> DataFrame:
    """Up to ``n`` keys whose index falls, for the error message."""
    prev = over_trace(df, spec, [Preceding("__prev", F.col(index))], list(keys))
    return prev.filter(F.col("__prev") > F.col(index)).select(*keys).distinct().orderBy(*keys).limit(n)
