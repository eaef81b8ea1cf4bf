"""From a raw log to canonical events in one plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tracemill.functions.labels import END_TOKEN
from tracemill.functions.ordered import Following, Whole, over_trace
from tracemill.functions.labels import seconds_between
from tracemill.log import LogSpec
from tracemill.operators import harmonize as H
from tracemill.operators import trace as T


def labelled_events(
    df: DataFrame, spec: LogSpec, decisions: Mapping[str, int], label: str, token: str
) -> DataFrame:
    """Cut at the decision and add next token, remaining and elapsed seconds.

    All features share the case partitioning and order, so the log is shuffled
    once.
    """
    cut = T.cut_at_decision(df, spec, decisions, label)
    out = over_trace(
        cut, spec,
        [
            Following("next_token", F.col(token), END_TOKEN),
            Whole("__end", F.col(spec.ts), "max"),
            Whole("__start", F.col(spec.ts), "min"),
        ],
    )
    return out.withColumns(
        {
            "remaining_seconds": seconds_between(F.col("__end"), F.col(spec.ts)),
            "elapsed_seconds": seconds_between(F.col(spec.ts), F.col("__start")),
        }
    ).drop("__end", "__start")


def canonical_events(
    events: DataFrame, cases: DataFrame, spec: LogSpec, mapping: H.SourceMapping, dataset_id: str
) -> DataFrame:
    """Canonical events of assigned cases; ``cases`` holds bank, split, outcome and case attributes."""
    joined = events.join(cases, spec.case)
    return H.to_canonical(joined, spec, mapping, dataset_id, "bank", "split")
