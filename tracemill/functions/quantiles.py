"""Exact quantiles as a selection of ranks by the digits of the numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.session import settle

#: A number is selected by four digits of 16 bits, so a group never has more than 65,536 counts at a time.
DIGITS, DIGIT_BITS = 4, 16


def order_image(value: Column) -> Column:
    """Whole number of 64 bits that grows with a double: its exponent and fraction as one number, negative if it is.

    Powers of two are exact, so equal images mean equal numbers (0.0 and -0.0 are equal); null and NaN give null.
    """
    x = F.abs(value)
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(x))
    # The logarithm may be off by one next to a power of two.
    e = F.when(two(guess) > x, guess - 1).when(two(guess + 1) <= x, guess + 1).otherwise(guess)
    fraction = ((x / two(e) - 1) * 2.0**52).cast("long")
    size = (
        F.when(x == 0, F.lit(0).cast("long"))
        .when(x == float("inf"), F.lit(2047 << 52))
        .when(x < 2.0**-1022, (x * 2.0**1022 * 2.0**52).cast("long"))
        .otherwise(F.shiftleft((e + 1023).cast("long"), 52) + fraction)
    )
    return F.when(value.isNull() | F.isnan(value), None).when(value < 0, -size).otherwise(size)


def _digit(image: str, i: int) -> Column:
    """The first ``i + 1`` digits of an image as one number."""
    return F.shiftright(image, DIGIT_BITS * (DIGITS - 1 - i))


def quantiles(
    df: DataFrame,
    value: Column,
    probs: dict[str, float],
    by: Sequence[str] = (),
    lower: bool = False,
) -> DataFrame:
    """Exact quantiles per group, linear interpolation between neighbours.

    Equal values are counted before the shuffle. Ranks are then selected digit by digit: counts per digit (at
    most 65,536 a group) tell which digits hold a wanted rank, and only their values are looked at in the next round.
    So no group is ever sorted or held in one task, however narrow its range, and the answer needs four rounds at
    any size. The counted values and the wanted digits of a round are written, so ``df`` is computed once and the real size of
    the digits decides their join: few groups are broadcast, for joined by shuffle each digit of a group would be one task.
    ``lower`` takes the lower neighbour instead of interpolating. Nulls and NaN are ignored; an ungrouped empty input gives
    one row of nulls.
    """
    by = list(by)
    x = value.cast("double")
    counted = settle(
        df.select(*by, (x + F.lit(0.0)).alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
        .groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__image", order_image(F.col("__x")))
    )
    full = (Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = None
    for i in range(DIGITS):
        last = i == DIGITS - 1
        rows, group = counted, list(by)
        if wanted is not None:
            r, w = counted.alias("__r"), wanted.alias("__w")
            on = [F.col(f"__r.{k}").eqNullSafe(F.col(f"__w.{k}")) for k in by]
            rows = r.join(w, [*on, _digit("__r.__image", i - 1) == F.col("__w.__prefix")]).select(
                *[F.col(f"__r.{c}") for c in counted.columns], "__prefix", "__ranks")
            group.append("__prefix")
        digits = rows.groupBy(*group, _digit("__image", i).alias("__digit")).agg(
            F.sum("__c").alias("__c"), F.min("__x").alias("__x"), *([] if wanted is None else [F.first("__ranks").alias("__ranks")]))
        ordered = Window.partitionBy(*group).orderBy("__digit")
        digits = digits.withColumn("__upto", F.sum("__c").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        if wanted is None:
            digits = digits.withColumn("__n", F.sum("__c").over(ordered.rowsBetween(*full)))
            places = []
            for k, p in enumerate(probs.values()):
                at = F.lit(float(p)) * (F.col("__n") - 1)
                high = F.floor(at) if lower else F.ceil(at)
                places += [F.struct(F.lit(2 * k + side).alias("i"), rank.cast("long").alias("rank"), (at - F.floor(at)).alias("part"))
                           for side, rank in enumerate((F.floor(at), high))]
            digits = digits.withColumn("__ranks", F.array(*places))
        before = F.col("__upto") - F.col("__c")
        # A rank becomes the rank among the values of its digit.
        inside = F.transform(
            F.filter("__ranks", lambda t: (t["rank"] >= before) & (t["rank"] < F.col("__upto"))),
            lambda t: F.struct(t["i"].alias("i"), (t["rank"] - before).alias("rank"), t["part"].alias("part")))
        wanted = digits.select(
            *by, F.col("__digit").alias("__prefix"), inside.alias("__ranks"), *(["__x"] if last else [])
        ).filter(F.size("__ranks") > 0)
        if not last:
            wanted = settle(wanted)
    found = wanted.select(*by, "__x", F.explode("__ranks").alias("t"))
    cols, done = [], []
    for k, name in enumerate(probs):
        for side in (0, 1):
            cols.append(F.max(F.when(F.col("t.i") == 2 * k + side, F.col("__x"))).alias(f"__at{2 * k + side}"))
        cols.append(F.max(F.when(F.col("t.i") == 2 * k, F.col("t.part"))).alias(f"__part{k}"))
        low, high = F.col(f"__at{2 * k}"), F.col(f"__at{2 * k + 1}")
        done.append((low + (high - low) * F.col(f"__part{k}")).alias(name))
    grouped = found.groupBy(*by) if by else found.groupBy()
    return grouped.agg(*cols).select(*by, *done)


def describe(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of one number."""
    by = list(by)
    x = value.cast("double")
    base = df.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    qs = quantiles(df, x, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by)
    if by:
        return base.join(qs, by, "left")
    return with_scalars(base, qs)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame as scalar subqueries (no join)."""
    names = one_row.columns
    packed = one_row.select(F.struct(*names)).scalar()
    return df.withColumn("__scalars", packed).withColumns(
        {n: F.col("__scalars")[n] for n in names}
    ).drop("__scalars")


def banded(
    df: DataFrame, value: str, q: int, by: Sequence[str] = (), name: str = "band"
) -> DataFrame:
    """Quantile band of each row, labels 0..m-1.

    Edges are exact quantiles, bands are closed on the right and the lowest
    value is included. Equal edges merge, so ties may leave fewer bands; if all
    values are equal there is one band 0. Null values get a null band.
    """
    by = list(by)
    names = [f"__e{i}" for i in range(q + 1)]
    edges = quantiles(df, F.col(value), {n: i / q for i, n in enumerate(names)}, by).select(
        *by, F.array_distinct(F.array(*names)).alias("__edges")
    )
    if by:
        # One row per group; settled, so that few groups are broadcast and none of them is one task.
        joined = df.join(settle(edges), by, "left")
    else:
        joined = with_scalars(df, edges)
    inner = F.slice("__edges", F.lit(2), F.size("__edges"))
    band = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return joined.withColumn(name, F.when(F.col(value).isNotNull(), band)).drop("__edges")
