"""Ordered computations that never put one key into one task.

A plain window sorts a whole key in one task, which fails when one case or one
bank holds a large share of the rows. Here every ordered feature is written in
two levels: a window inside ``(key, segment)`` and a second window over one
summary row per segment, added back to the rows. ``segment`` must grow with the
order columns. With ``segment=None`` the plain window is used.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.log import LogSpec
from tracemill.session import settle


@dataclass(frozen=True)
class Position:
    """0-based rank in the order."""

    name: str

    def local(self, w: Any, whole: Any, key: Column) -> Column:
        return F.row_number().over(w).cast("long") - 1

    def summary(self, key: Column) -> Column:
        return F.count(F.lit(1))

    def across(self, s: str, outer: Any, whole: Any) -> Column:
        return F.sum(s).over(outer.rowsBetween(Window.unboundedPreceding, -1))

    def combine(self, here: Column, there: Column) -> Column:
        return here + F.coalesce(there, F.lit(0))


@dataclass(frozen=True)
class Following:
    """Value of the next row; ``default`` on the last one."""

    name: str
    value: Column
    default: Any = None

    def local(self, w: Any, whole: Any, key: Column) -> Column:
        return F.lead(F.struct(self.value.alias("v"))).over(w)

    def summary(self, key: Column) -> Column:
        return F.min_by(F.struct(self.value.alias("v")), key)

    def across(self, s: str, outer: Any, whole: Any) -> Column:
        return F.lead(s).over(outer)

    def combine(self, here: Column, there: Column) -> Column:
        found = F.coalesce(here, there)
        if self.default is None:
            return found["v"]
        return F.when(found.isNull(), F.lit(self.default)).otherwise(found["v"])


@dataclass(frozen=True)
class Preceding:
    """Value of the previous row; null on the first one."""

    name: str
    value: Column

    def local(self, w: Any, whole: Any, key: Column) -> Column:
        return F.lag(F.struct(self.value.alias("v"))).over(w)

    def summary(self, key: Column) -> Column:
        return F.max_by(F.struct(self.value.alias("v")), key)

    def across(self, s: str, outer: Any, whole: Any) -> Column:
        return F.lag(s).over(outer)

    def combine(self, here: Column, there: Column) -> Column:
        return F.coalesce(here, there)["v"]


@dataclass(frozen=True)
class Latest:
    """Value of the latest row up to and including this one where ``when`` holds.

    The value is carried as a unit, so a null inside it stays null.
    """

    name: str
    when: Column
    value: Column

    def _marked(self) -> Column:
        return F.when(self.when, F.struct(self.value.alias("v")))

    def local(self, w: Any, whole: Any, key: Column) -> Column:
        return F.last(self._marked(), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )

    def summary(self, key: Column) -> Column:
        return F.max_by(self._marked(), F.when(self.when, key))

    def across(self, s: str, outer: Any, whole: Any) -> Column:
        return F.last(s, ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1))

    def combine(self, here: Column, there: Column) -> Column:
        return F.coalesce(here, there)["v"]


@dataclass(frozen=True)
class Running:
    """Running sum including this row."""

    name: str
    value: Column

    def local(self, w: Any, whole: Any, key: Column) -> Column:
        return F.sum(self.value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def summary(self, key: Column) -> Column:
        return F.sum(self.value)

    def across(self, s: str, outer: Any, whole: Any) -> Column:
        return F.sum(s).over(outer.rowsBetween(Window.unboundedPreceding, -1))

    def combine(self, here: Column, there: Column) -> Column:
        return here + F.coalesce(there, F.lit(0))


@dataclass(frozen=True)
class Whole:
    """One aggregate of the whole key on each of its rows: ``sum``, ``min``, ``max``, ``count``."""

    name: str
    value: Column
    how: str = "sum"

    def _fn(self) -> Any:
        return {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[self.how]

    def local(self, w: Any, whole: Any, key: Column) -> Column:
        return self._fn()(self.value).over(whole)

    def summary(self, key: Column) -> Column:
        return self._fn()(self.value)

    def across(self, s: str, outer: Any, whole: Any) -> Column:
        merge = F.sum if self.how == "count" else self._fn()
        return merge(s).over(whole)

    def combine(self, here: Column, there: Column) -> Column:
        return F.coalesce(there, here)


Feature = Position | Following | Preceding | Latest | Running | Whole


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    features: list[Feature],
    segment: Column | None = None,
    hot_only: Column | None = None,
) -> DataFrame:
    """Add ordered ``features`` per ``keys``.

    ``hot_only`` limits the second level to rows whose key has more than one
    segment. ``bounded=True`` says that keys x segments is small by
    construction, so the summary is broadcast; otherwise rows and summary meet
    in a join on the partitioning the inner window already made. With a segment,
    ``keys`` must not be null.
    """
    key = F.struct(*[F.col(c) for c in order])
    full = (Window.unboundedPreceding, Window.unboundedFollowing)
    if segment is None:
        # Whole-key aggregates take the same order, so all features share one sort and one window.
        w = Window.partitionBy(*keys).orderBy(*order)
        whole = w.rowsBetween(*full)
        return df.withColumns({f.name: f.combine(f.local(w, whole, key), F.lit(None)) for f in features})

    seg = "__segment"
    cut = df.withColumn(seg, segment)
    inner = Window.partitionBy(*keys, seg).orderBy(*order)
    inner_whole = inner.rowsBetween(*full)
    rows = cut.withColumns(
        {f"__here_{i}": f.local(inner, inner_whole, key) for i, f in enumerate(features)}
    )
    summed = cut if hot_only is None else cut.filter(hot_only)
    summary = summed.groupBy(*keys, seg).agg(
        *[f.summary(key).alias(f"__sum_{i}") for i, f in enumerate(features)]
    )
    outer = Window.partitionBy(*keys).orderBy(seg)
    outer_whole = outer.rowsBetween(*full)
    summary = summary.select(
        *keys,
        seg,
        *[f.across(f"__sum_{i}", outer, outer_whole).alias(f"__there_{i}") for i, f in enumerate(features)],
    )
    if hot_only is not None:
        summary = F.broadcast(summary)
    r, s = rows.alias("__r"), summary.alias("__s")
    on = [
        F.col(f"__r.{c}") == F.col(f"__s.{c}") if hot_only is None or c == seg
        else F.col(f"__r.{c}").eqNullSafe(F.col(f"__s.{c}"))
        for c in [*keys, seg]
    ]
    joined = r.join(s, on, "left")
    return joined.select(
        *[F.col(f"__r.{c}") for c in df.columns if c not in {f.name for f in features}],
        *[
            f.combine(F.col(f"__r.__here_{i}"), F.col(f"__s.__there_{i}")).alias(f.name)
            for i, f in enumerate(features)
        ],
    )


def over_trace(df: DataFrame, spec: LogSpec, features: list[Feature], keys: list[str] | None = None) -> DataFrame:
    """Ordered features per case; hot cases are cut into time segments."""
    keys = keys or [spec.case]
    if spec.hot is None:
        return ordered(df, keys, list(spec.order), features)
    hot = F.broadcast(spec.hot.select(F.col(spec.case).alias("__case"), F.col("edges").alias("__edges")))
    tagged = df.join(hot, df[spec.case].eqNullSafe(hot["__case"]), "left").drop("__case")
    segment = F.when(F.col("__edges").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("__edges", lambda e: e < F.col(spec.ts)))
    )
    out = ordered(
        tagged, keys, list(spec.order), features, segment, hot_only=F.col("__edges").isNotNull()
    )
    return out.drop("__edges")


def ranged(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` in the order of ``keys`` and ``order``, with ``__part`` and ``__row``.

    Spark samples the order and cuts it into ranges of even size, as for a global sort; ``__part`` grows with the
    order and ``__row`` counts the rows of a range. The ranges are as many as the session's shuffle partitions, or
    ``partitions``, whatever the keys look like: one hot or null key spreads over many. The table is written,
    because a second sample could cut elsewhere. Rows equal in keys and order share a range.
    """
    at = [*[F.col(c) for c in keys], *[F.col(c) for c in order]]
    cut = df.repartitionByRange(partitions, *at) if partitions else df.repartitionByRange(*at)
    numbered = cut.sortWithinPartitions(*at).withColumn("__id", F.monotonically_increasing_id())
    return settle(numbered).withColumns(
        {"__part": F.shiftright("__id", 33).cast("int"), "__row": F.col("__id").bitwiseAND(2**33 - 1)}
    ).drop("__id")


def ranked(
    df: DataFrame, keys: list[str], order: list[str], rank: str, size: str | None = None, partitions: int | None = None
) -> DataFrame:
    """0-based ``rank`` of each row in its key, and the key's ``size``, through one range partitioning.

    Rows are numbered where they lie; all that is added up is one count per range and key (at most
    ranges + keys rows), so nothing is sorted again. The counts are written, so that their real size decides their join and
    the rows are not shuffled for a few of them.
    """
    placed = ranged(df, keys, order, partitions)
    counts = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    outer = Window.partitionBy(*keys).orderBy("__part")
    before = F.coalesce(F.sum("__n").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = F.sum("__n").over(outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    counts = settle(counts.select(*keys, "__part", (before - F.col("__first")).alias("__shift"), totals.alias("__size")))
    p, c = placed.alias("__p"), counts.alias("__c")
    on = [F.col(f"__p.{k}").eqNullSafe(F.col(f"__c.{k}")) for k in keys] + [F.col("__p.__part") == F.col("__c.__part")]
    added = [(F.col("__row") + F.col("__shift")).alias(rank)] + ([F.col("__size").alias(size)] if size else [])
    return p.join(c, on).select(*[F.col(f"__p.{n}") for n in df.columns], *added)


def seeded_hash(seed: int, salt: str, *cols: str) -> Column:
    """Reproducible shuffle key: md5 over seed, salt and the row's identity."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.col(c).cast("string") for c in cols]))


def hash_ranked(
    df: DataFrame, by: list[str], identity: str, seed: int, salt: str,
    rank: str = "rank", size: str = "group_size", running: dict[str, Column] | None = None,
) -> DataFrame:
    """0-based rank in seeded hash order inside each group, and the group size.

    The order is spread over 4,096 hash segments per group, so no group is
    sorted in one task. ``running`` adds sums over the rows up to each row.
    """
    hashed = df.withColumn("__hash", seeded_hash(seed, salt, identity))
    features: list[Feature] = [Position(rank), Whole(size, F.lit(1).cast("long"), "sum")]
    features += [Running(n, c) for n, c in (running or {}).items()]
    return ordered(hashed, by, ["__hash", identity], features, hash_segment("__hash")).drop("__hash")


def hash_segment(col: str) -> Column:
    """First three hex digits: 4,096 even segments that grow with the hash."""
    return F.substring(col, 1, 3)
