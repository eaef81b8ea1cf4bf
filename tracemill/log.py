"""Event-log description: which columns carry case, activity, time and order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_HOT_ROWS = 5_000_000


@dataclass(frozen=True)
class LogSpec:
    """Column roles of a log.

    ``ts`` followed by ``ties`` is a total order inside a case (rows that tie on
    all of them must be identical). ``hot`` is ``None`` for a log whose cases all
    fit one task, or a small frame ``(case, edges)`` made by :func:`measure_hot`.
    """

    case: str = "case_id"
    activity: str = "activity"
    lifecycle: str | None = "lifecycle"
    ts: str = "ts"
    ties: tuple[str, ...] = ("seq",)
    hot: DataFrame | None = None

    @property
    def order(self) -> tuple[str, ...]:
        return (self.ts, *self.ties)

    def order_key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])


def measure_hot(df: DataFrame, spec: LogSpec, hot_rows: int = DEFAULT_HOT_ROWS) -> LogSpec:
    """Look once for cases too large for one task and plan their time segments.

    The count job reads the case column only and combines map-side. A log of N
    rows has at most ``N / hot_rows`` hot cases and about ``2 N / hot_rows``
    edges, so the collected plan is bounded. Edges come from a sketch and only
    balance the work: ordered operators give the same answer for any edges.
    """
    hot = (
        df.groupBy(spec.case)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > hot_rows)
        .collect()
    )
    if not hot:
        return replace(spec, hot=None)
    spark = df.sparkSession
    type_of_case = df.schema[spec.case].dataType.simpleString()
    type_of_ts = df.schema[spec.ts].dataType.simpleString()
    names = spark.createDataFrame(
        [(r[0], r[1]) for r in hot], f"`{spec.case}` {type_of_case}, rows long"
    )
    # Each case takes as many steps as its own rows need, from one grid of quantiles.
    grid = max(-(-r[1] // hot_rows) for r in hot)
    placed = df.select(F.col(spec.case).alias("__case"), spec.ts)
    at = placed["__case"].eqNullSafe(names[spec.case])
    edges = (
        placed.join(F.broadcast(names), at)
        .groupBy(spec.case, "rows")
        .agg(F.percentile_approx(spec.ts, [i / grid for i in range(1, grid)]).alias("grid"))
        .collect()
    )

    def own(rows: int, values: list) -> list:
        steps = -(-rows // hot_rows)
        return sorted({values[-(-i * grid // steps) - 1] for i in range(1, steps)})

    planned = spark.createDataFrame(
        [(r[0], own(r[1], r[2])) for r in edges],
        f"`{spec.case}` {type_of_case}, edges array<{type_of_ts}>",
    )
    return replace(spec, hot=planned)
