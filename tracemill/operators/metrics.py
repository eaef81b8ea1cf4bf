"""Metrics over prediction tables.

Classification metrics start from confusion counts, which combine map-side to at
most K x K rows per group; everything after that is small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.functions.ordered import Running, Whole, ordered, ranged, ranked
from tracemill.functions.quantiles import quantiles, with_scalars


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion_counts(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed ``(y, p, n)`` cells per group."""
    return df.groupBy(*by, F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )


def dense_confusion(cells: DataFrame, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """All K x K cells of every group, absent ones 0."""
    by = list(by)
    ids = F.sequence(F.lit(0), F.lit(classes - 1))
    groups = cells.select(*by).distinct() if by else cells.agg(F.count(F.lit(1)).alias("__any")).drop("__any")
    grid = groups.select(*by, F.explode(ids).alias("y")).select("*", F.explode(ids).alias("p"))
    return grid.join(cells, [*by, "y", "p"], "left").fillna(0, ["n"])


def confusion(df: DataFrame, y: str, p: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Dense K x K confusion counts per group."""
    return dense_confusion(confusion_counts(df, y, p, by), classes, by)


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion cells; 0 on zero division.

    Dense cells give all K classes, observed cells the labels seen in truth or prediction.
    """
    by = list(by)
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    flat = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("y").alias("c"), F.col("n").alias("sup"), none.alias("prd"), hit.cast("long").alias("tp")),
                F.struct(F.col("p").alias("c"), none.alias("sup"), F.col("n").alias("prd"), none.alias("tp")),
            )
        ).alias("x"),
    ).select(*by, "x.*")
    sums = flat.groupBy(*by, F.col("c").alias("class_id")).agg(
        F.sum("tp").alias("tp"), F.sum("sup").alias("support"), F.sum("prd").alias("predicted")
    )
    return sums.select(
        *by, "class_id",
        _zero(F.try_divide("tp", "predicted")).alias("precision"),
        _zero(F.try_divide("tp", "support")).alias("recall"),
        _zero(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support"))).alias("f1"),
        "support", "tp",
    )


def headline(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro F1, weighted F1 and balanced accuracy from per-class rows.

    Macro F1 averages all given classes, balanced accuracy those present in truth.
    """
    grouped = classes.groupBy(*by) if by else classes.groupBy()
    n = F.sum("support")
    return grouped.agg(
        n.alias("n"),
        _zero(F.try_divide(F.sum("tp"), n)).alias("accuracy"),
        _zero(F.avg("f1")).alias("macro_f1"),
        _zero(F.try_divide(F.sum(F.col("f1") * F.col("support")), n)).alias("weighted_f1"),
        _zero(F.avg(F.when(F.col("support") > 0, F.col("recall")))).alias("balanced_accuracy"),
    )


def outcome_metrics(df: DataFrame, y: str, p: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Headline metrics of a prediction table per group."""
    return headline(per_class(confusion(df, y, p, classes, by), by), by)


def class_auc(df: DataFrame, y: str, probs: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest ROC AUC per class with ties counted half; null without both sides.

    Rows are counted per distinct score first, and the running count of
    negatives goes through even ranges of the order, however close the scores are.
    """
    by = list(by)
    one = df.select(
        *by, F.col(y).cast("int").alias("__y"), F.posexplode(F.slice(probs, 1, classes)).alias("class_id", "score")
    )
    hit = F.col("__y") == F.col("class_id")
    per_score = one.groupBy(*by, "class_id", F.col("score").cast("double").alias("score")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    keys = [*by, "class_id"]
    placed = ordered(
        ranged(per_score, keys, ["score"]), keys, ["score"],
        [Running("below", F.col("neg")), Whole("p", F.col("pos")), Whole("q", F.col("neg"))],
        F.col("__part"),
    )
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return placed.groupBy(*by, "class_id").agg(
        F.try_divide(wins, F.max("p").cast("double") * F.max("q")).alias("auc")
    )


def macro_auc(df: DataFrame, y: str, probs: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean one-vs-rest AUC; null if any class lacks positives or negatives."""
    per = class_auc(df, y, probs, classes, by)
    grouped = per.groupBy(*by) if by else per.groupBy()
    return grouped.agg(F.when(F.count("auc") == classes, F.avg("auc")).alias("macro_auc_ovr"))


def next_label_metrics(
    df: DataFrame, y: str, p: str, top: str, mask: str, by: Sequence[str] = ()
) -> DataFrame:
    """Top-1, top-3, macro and weighted F1 over masked rows and observed labels; zeros when empty.

    ``top`` is an array of the best ids. Groups without masked rows are kept.
    """
    by = list(by)
    on = F.col(mask) == 1
    grouped = df.groupBy(*by) if by else df.groupBy()
    base = grouped.agg(
        F.count_if(on).alias("n"),
        _zero(F.avg(F.when(on, (F.col(y) == F.col(p)).cast("int")))).alias("top1_accuracy"),
        _zero(F.avg(F.when(on, F.array_contains(F.col(top), F.col(y)).cast("int")))).alias("top3_accuracy"),
    )
    scored = headline(per_class(confusion_counts(df.filter(on), y, p, by), by), by).select(
        *by, "macro_f1", "weighted_f1"
    )
    if by:
        return base.join(scored, by, "left").fillna(0.0, ["macro_f1", "weighted_f1"])
    return with_scalars(base, scored).fillna(0.0, ["macro_f1", "weighted_f1"])


def duration_metrics(df: DataFrame, true: str, pred: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE and RMSE over masked rows with predictions clamped at 0; zeros when empty."""
    err = F.when(F.col(mask) == 1, F.greatest(F.col(pred), F.lit(0.0)) - F.col(true))
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(
        F.count(err).alias("n"),
        _zero(F.avg(F.abs(err))).alias("mae"),
        _zero(F.sqrt(F.avg(err * err))).alias("rmse"),
    )


def softmax(scores: Column) -> Column:
    """Stable softmax of a score array; null scores count as minus infinity."""
    top = F.array_max(scores)
    exps = F.transform(scores, lambda s: F.coalesce(F.exp(s.cast("double") - top.cast("double")), F.lit(0.0)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, b: a + b)
    return F.transform(exps, lambda e: e / total)


def argmax(scores: Column) -> Column:
    """0-based index of the highest score, the first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_ids(scores: Column, k: int = 3) -> Column:
    """Ids of the ``k`` highest scores, the lower id first on ties; null scores last."""
    keyed = F.transform(
        scores, lambda s, i: F.struct((-F.coalesce(s.cast("double"), F.lit(float("-inf")))).alias("s"), i.alias("i"))
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["i"])


def prediction_frame(
    df: DataFrame, outcome_scores: str, next_scores: str, remaining_units: str, target: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Labels, probabilities, top-3 and clamped seconds from raw head scores.

    Top-3 is an array. With ``target`` the remaining time is first brought back
    from model units to seconds.
    """
    from tracemill.operators.encode import inverse_target

    out = df.withColumn("remaining_pred_raw", F.col(remaining_units).cast("double"))
    if target is not None:
        out = inverse_target(out, target, "remaining_pred_raw")
    return out.select(
        *keep,
        argmax(F.col(outcome_scores)).alias("outcome_pred"),
        softmax(F.col(outcome_scores)).alias("outcome_probs"),
        argmax(F.col(next_scores)).alias("next_pred"),
        top_ids(F.col(next_scores)).alias("next_top3"),
        "remaining_pred_raw",
        F.greatest("remaining_pred_raw", F.lit(0.0)).alias("remaining_pred_clamped"),
    )


# Prefix length buckets (name, from, to).
BUCKETS = (("1", 1, 1), ("2-5", 2, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21+", 21, None))


def prefix_bucket(length: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in reversed(BUCKETS):
        cond = length >= low if high is None else length.between(low, high)
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def metrics_by_prefix_bucket(
    df: DataFrame, y: str, p: str, classes: int, true: str, pred: str, mask: str, length: str = "prefix_length",
    keep_empty: bool = True,
) -> DataFrame:
    """Outcome and duration metrics per prefix bucket; empty buckets have n = 0 and no metrics."""
    tagged = df.withColumn("bucket", prefix_bucket(F.col(length)))
    scored = outcome_metrics(tagged, y, p, classes, ["bucket"])
    time = duration_metrics(tagged, true, pred, mask, ["bucket"]).select("bucket", "mae")
    both = scored.join(time, "bucket", "left")
    if not keep_empty:
        return both.filter("bucket is not null")
    spark = df.sparkSession
    names = spark.createDataFrame([(b[0],) for b in BUCKETS], "bucket string")
    return names.join(both, "bucket", "left").fillna(0, ["n"])


def metrics_by_owner(df: DataFrame, y: str, p: str, classes: int, owner: str = "client_id", pooled: str = "pooled") -> DataFrame:
    """Headline metrics per owner and pooled, from one confusion table.

    Pooled cells are summed from the owners' cells, so both agree by construction.
    """
    cells = pooled_confusion(confusion_counts(df, y, p, [owner]), owner, pooled)
    return headline(per_class(dense_confusion(cells, classes, [owner]), [owner]), [owner])


def pooled_confusion(cells: DataFrame, owner: str, pooled: str = "pooled") -> DataFrame:
    """Owner cells plus the pooled cells, in one grouping-sets pass."""
    return (
        cells.groupingSets([[owner, "y", "p"], ["y", "p"]], owner, "y", "p")
        .agg(F.sum("n").alias("n"), F.grouping(owner).alias("__g"))
        .select(F.when(F.col("__g") == 1, F.lit(pooled)).otherwise(F.col(owner)).alias(owner), "y", "p", "n")
    )


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def distribution_summary(df: DataFrame, col: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, median and p10, p25, p75, p90 over finite values; zeros when empty."""
    by = list(by)
    x = _finite((F.col(col) if isinstance(col, str) else col).cast("double"))
    valued = df.select(*by, x.alias("__v"))
    grouped = valued.groupBy(*by) if by else valued.groupBy()
    base = grouped.agg(F.count("__v").alias("count"), _zero(F.avg("__v")).alias("mean"))
    names = {"median": 0.5, "p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90}
    qs = quantiles(valued, F.col("__v"), names, by)
    out = base.join(qs, by, "left") if by else with_scalars(base, qs)
    return out.fillna(0.0, list(names))


def target_diagnostics(population: DataFrame, target: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Distribution of the train target in seconds and in model units, with the parameters."""
    from tracemill.operators.encode import transform_target

    both = transform_target(population, target, seconds, "units")
    long = both.unpivot([], [seconds, "units"], "unit", "value")
    named = long.withColumn("unit", F.when(F.col("unit") == seconds, "seconds").otherwise("model_units"))
    return with_scalars(
        distribution_summary(named, "value", ["unit"]), target.select("transform", "scaling", "center", "scale")
    )


def prediction_diagnostics(df: DataFrame, raw: str, mask: str) -> DataFrame:
    """Mean and median of the clamped prediction and the percentage that was negative."""
    valid = df.filter(F.col(mask) == 1).select(F.col(raw).cast("double").alias("raw")).withColumn(
        "clamped", F.greatest("raw", F.lit(0.0))
    )
    base = valid.agg(
        _zero(F.avg("clamped")).alias("pred_mean_seconds"),
        _zero(F.avg((F.col("raw") < 0).cast("int")) * 100).alias("percent_clamped_to_zero"),
    )
    qs = quantiles(valid, F.col("clamped"), {"pred_median_seconds": 0.5})
    return with_scalars(base, qs).fillna(0.0, ["pred_median_seconds"])


def baseline_diagnostics(df: DataFrame, true: str, mask: str, train_median: DataFrame) -> DataFrame:
    """MAE of predicting the train median and the test median everywhere.

    ``train_median`` is a one-row frame with one column.
    """
    valid = df.filter(F.col(mask) == 1).select(F.col(true).cast("double").alias("t"))
    name = train_median.columns[0]
    medians = with_scalars(
        train_median.select(F.col(name).alias("train_median_seconds")),
        quantiles(valid, F.col("t"), {"test_median_seconds": 0.5}),
    )
    scored = with_scalars(valid, medians)
    return scored.agg(
        _zero(F.max("train_median_seconds")).alias("train_median_seconds"),
        _zero(F.avg(F.abs(F.col("t") - F.col("train_median_seconds")))).alias("train_median_mae_seconds"),
        _zero(F.max("test_median_seconds")).alias("test_median_seconds"),
        _zero(F.avg(F.abs(F.col("t") - F.col("test_median_seconds")))).alias("test_median_mae_seconds"),
    )


def mark_final_prefix(
    pred: DataFrame, events: DataFrame, keys: Sequence[str] = ("dataset_id", "case_id"), pos: str = "label_pos"
) -> DataFrame:
    """Flag prefixes whose last event is the last of the case.

    Cases longer than the prefix cap stay unmarked. A predicted case without
    events raises.
    """
    sizes = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    joined = pred.join(sizes, list(keys), "left")
    flag = F.when(
        F.col("__n").isNull(), F.raise_error(F.lit("predicted case has no event count")).cast("boolean")
    ).otherwise(F.col(pos) == F.col("__n") - 1)
    return joined.withColumn("is_final", flag).drop("__n")


def final_prefix_inflation(
    marked: DataFrame, y: str, p: str, classes: int, source: str = "dataset_id", final: str = "is_final",
    total: str = "all",
) -> DataFrame:
    """Metrics with and without final prefixes and their difference, for all rows and per source.

    Corrected columns are null when no prefix or every prefix is final. Source
    rows are added only where there are several sources.
    """
    cells = confusion_counts(marked, y, p, [source, final])
    scoped = (
        cells.groupingSets([[source, final, "y", "p"], [final, "y", "p"]], source, final, "y", "p")
        .agg(F.sum("n").alias("n"), F.grouping(source).alias("__g"))
        .select(
            F.when(F.col("__g") == 1, F.lit(total)).otherwise(F.col(source)).alias("scope"),
            F.col(final).alias("final"), "y", "p", "n",
        )
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    counts = scoped.groupBy("scope").agg(
        F.sum("n").alias("n_prefixes"),
        F.coalesce(F.sum(F.when(F.col("final"), F.col("n"))), F.lit(0)).alias("n_final"),
        F.try_divide(F.sum(F.when(F.col("final"), hit)), F.sum(F.when(F.col("final"), F.col("n")))).alias("final_accuracy"),
    )

    def score(part: DataFrame, suffix: str) -> DataFrame:
        summed = part.groupBy("scope", "y", "p").agg(F.sum("n").alias("n"))
        h = headline(per_class(dense_confusion(summed, classes, ["scope"]), ["scope"]), ["scope"])
        return h.select("scope", *[F.col(c).alias(c + suffix) for c in ("macro_f1", "weighted_f1", "balanced_accuracy")])

    out = (
        counts.join(score(scoped, ""), "scope", "left")
        .join(score(scoped.filter(~F.col("final")), "_excluding_final"), "scope", "left")
    )
    fixable = (F.col("n_final") > 0) & (F.col("n_final") < F.col("n_prefixes"))
    cols = []
    for m in ("macro_f1", "weighted_f1", "balanced_accuracy"):
        without = F.when(fixable, F.col(f"{m}_excluding_final"))
        cols += [F.col(m), without.alias(f"{m}_excluding_final"), (F.col(m) - without).alias(f"{m}_inflation")]
    n_sources = scoped.filter(F.col("scope") != total).agg(F.count_distinct("scope").alias("__sources"))
    return with_scalars(out, n_sources).filter((F.col("scope") == total) | (F.col("__sources") > 1)).select(
        "scope", "n_prefixes", "n_final", (F.col("n_final") / F.col("n_prefixes")).alias("final_share"),
        "final_accuracy", *cols,
    )


def run_pairs(rows: DataFrame, split: Sequence[str], label: str, raw: str, corrected: str) -> DataFrame:
    """Every unordered pair of runs of a split with both gaps and whether the sign is kept.

    The list itself is asked for here, so pass the splits wanted; :func:`sign_agreement` counts without pairs. Rows
    without a corrected value drop out first.
    """
    known = rows.filter(F.col(corrected).isNotNull()).select(*split, label, raw, corrected)
    left, right = known.alias("l"), known.alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in split] + [F.col(f"l.{label}") < F.col(f"r.{label}")]
    gap = lambda c: F.col(f"l.{c}") - F.col(f"r.{c}")
    return left.join(right, on).select(
        *[F.col(f"l.{c}") for c in split],
        F.col(f"l.{label}").alias("left_run"), F.col(f"r.{label}").alias("right_run"),
        gap(raw).alias("raw_delta"), gap(corrected).alias("corrected_delta"),
        ((gap(raw) > 0) == (gap(corrected) > 0)).alias("sign_kept"),
    )


#: Inversions are counted by digits of this many bits of a run's place; ranks under 2^40.
INVERSION_BITS, INVERSION_LEVELS = 4, 10


def inversions(df: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """Pairs per group that two orders put the other way round: ``(by…, inversions)``.

    ``first`` and ``second`` hold each row's 0-based place in the two orders. Places of the second order are compared
    digit by digit: rows whose higher digits agree meet in one group, and a row is behind as many
    rows as came before it in the first order with a larger digit. So each row is looked at once per digit, and running
    counts go through segments of the first order, however large a group is.
    """
    by, mask = list(by), (1 << INVERSION_BITS) - 1
    sized = df.select(*by, F.col(first).alias("__a"), F.col(second).alias("__b"))
    levels = sized.select(*by, "__a", "__b", F.explode(F.sequence(F.lit(0), F.lit(INVERSION_LEVELS - 1))).alias("__level"))
    shift = F.expr(f"shiftright(__b, __level * {INVERSION_BITS})")
    rows = levels.select(
        *by, "__a", "__level", shift.bitwiseAND(mask).alias("__digit"),
        F.shiftright(shift, INVERSION_BITS).alias("__higher"))
    # Above the highest place all digits are 0 and nothing can be inverted: such levels go, by the group's size.
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    if by:
        r, z = rows.alias("__r"), sizes.alias("__z")
        rows = r.join(z, [F.col(f"__r.{k}").eqNullSafe(F.col(f"__z.{k}")) for k in by]).select("__r.*", "__n")
    else:
        rows = with_scalars(rows, sizes)
    rows = rows.filter(F.expr(f"shiftright(__n - 1, __level * {INVERSION_BITS}) > 0"))
    rows = rows.withColumn("__key", F.struct(*by) if by else F.lit(0))
    counts = [Running(f"__c{d}", (F.col("__digit") == d).cast("long")) for d in range(1, mask + 1)]
    placed = ordered(rows, ["__key", "__level", "__higher"], ["__a"], counts, F.floor(F.col("__a") / 4096))
    larger = sum((F.when(F.col("__digit") < d, F.col(f"__c{d}")).otherwise(0) for d in range(1, mask + 1)), F.lit(0).cast("long"))
    grouped = placed.groupBy(*by) if by else placed.groupBy()
    return grouped.agg(F.sum(larger).alias("inversions"))


def sign_agreement(rows: DataFrame, split: Sequence[str], label: str, raw: str, corrected: str) -> DataFrame:
    """Comparisons, kept signs and flips over all pairs of runs of each split, counted without forming a pair.

    A sign is kept if "the run of smaller label is better" says the same of both scores; equal scores count as not better. That
    is so exactly if the orders by (raw, label) and (corrected, label) agree on the pair, so flips are the inversions
    between the two. A label names one run of a split. Rows without a corrected value drop out; without a raw value
    they are compared but neither kept nor flipped.
    """
    split = list(split)
    known = rows.filter(F.col(corrected).isNotNull() & F.col(label).isNotNull())
    for c in split:
        known = known.filter(F.col(c).isNotNull())
    known = known.select(*split, label, raw, corrected)
    pairs = lambda n: n * (n - 1) / 2
    n = known.groupBy(*split).agg(F.count(F.lit(1)).alias("n"), F.count(raw).alias("m"))
    n = n.agg(
        F.coalesce(F.sum(pairs(F.col("n"))).cast("long"), F.lit(0).cast("long")).alias("comparisons"),
        F.coalesce(F.sum(pairs(F.col("m"))).cast("long"), F.lit(0).cast("long")).alias("__both"))
    placed = ranked(known.filter(F.col(raw).isNotNull()), split, [raw, label], "__first")
    placed = ranked(placed, split, [corrected, label], "__second")
    flips = inversions(placed, split, "__first", "__second").agg(
        F.coalesce(F.sum("inversions"), F.lit(0).cast("long")).alias("flipped"))
    return with_scalars(n, flips).select("comparisons", (F.col("__both") - F.col("flipped")).alias("kept"), "flipped")


def owner_lookup(pred: DataFrame, owners: DataFrame, keys: Sequence[str] = ("dataset_id", "case_id"), owner: str = "client_id") -> DataFrame:
    """Bank of each pooled prefix; a prefix without one raises."""
    joined = pred.join(owners.select(*keys, F.col(owner).alias("__owner")).distinct(), list(keys), "left")
    found = F.when(
        F.col("__owner").isNull(), F.raise_error(F.lit("prefix without an owner")).cast("string")
    ).otherwise(F.col("__owner").cast("string"))
    return joined.withColumn(owner, found).drop("__owner")


def masked_means(
    df: DataFrame, heads: Mapping[str, tuple[str | None, float]], by: Sequence[str] = ()
) -> DataFrame:
    """Mean of each loss column over its own mask, 0 when empty, and the weighted total.

    ``heads`` maps a loss column to (mask column or none, weight).
    """
    grouped = df.groupBy(*by) if by else df.groupBy()
    means = {
        c: _zero(F.avg(F.col(c).cast("double") if m is None else F.when(F.col(m) == 1, F.col(c).cast("double"))))
        for c, (m, _) in heads.items()
    }
    out = grouped.agg(F.count(F.lit(1)).alias("n"), *[v.alias(f"mean_{c}") for c, v in means.items()])
    total = sum((F.col(f"mean_{c}") * F.lit(w) for c, (_, w) in heads.items()), F.lit(0.0))
    return out.withColumn("weighted_total", total)
