"""Leakage-safe prefix encoding: vocabularies, scalers, prefixes and targets.

Everything that is fitted sees train events only and comes back as a small
frame, so a fit can be written, read and joined like any other table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.functions.contract import CYCLIC_FIELDS
from tracemill.functions.labels import END_TOKEN, MISSING_TOKEN, OTHER_TOKEN, PAD_TOKEN, UNK_TOKEN, clean_token
from tracemill.functions.ordered import ranked
from tracemill.functions.quantiles import quantiles, with_scalars

TRANSFORMS = ("raw", "log")
SCALINGS = ("raw", "median", "zscore")

#: A field of at most this many tokens is sent to every task; one of more has keys enough to be dealt over tasks.
SMALL_FIELD = 10_000


def reserved_tokens(activity: bool = False, target: bool = False) -> list[str]:
    """Reserved tokens in id order."""
    out = [PAD_TOKEN, UNK_TOKEN, MISSING_TOKEN]
    if activity or target:
        out.append(OTHER_TOKEN)
    if target:
        out.append(END_TOKEN)
    return out


def _vocabulary(tokens: DataFrame, reserved: Mapping[str, Sequence[str]]) -> DataFrame:
    """Ids for distinct ``(field, token)``: reserved first, then tokens in byte order."""
    spark = tokens.sparkSession
    fixed = spark.createDataFrame(
        [(f, t, i) for f, many in reserved.items() for i, t in enumerate(many)], "field string, token string, id long"
    )
    free = tokens.join(F.broadcast(fixed.select("field", "token")), ["field", "token"], "left_anti")
    placed = ranked(free, ["field"], ["token"], "pos")
    offset = F.lit(None).cast("long")
    for f, many in reserved.items():
        offset = F.when(F.col("field") == f, F.lit(len(many))).otherwise(offset)
    return fixed.unionByName(placed.select("field", "token", (F.col("pos") + offset).alias("id")))


def _long_tokens(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    cleaned = df.select(*keep, *[clean_token(F.col(c)).alias(c) for c in fields])
    return cleaned.unpivot(list(keep), list(fields), "field", "token")


def fit_vocab(train: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Vocabulary ``(field, token, id)`` of train events.

    ``fields`` maps each column to its reserved tokens, see
    :func:`reserved_tokens`. Null, empty and ``"nan"`` count as missing.
    """
    return _vocabulary(_long_tokens(train, list(fields)).distinct(), fields)


def _field_ids(vocab: DataFrame, fields: Mapping[str, str], token: str) -> dict[str, DataFrame]:
    """Tokens and ids of each field, as ``token`` and the column ``fields`` names.

    The size of the whole vocabulary says nothing about one field: beside many resources there may be five activities,
    and joined by shuffle each of them would be one task at any size. So the tokens of each field are counted first.
    """
    counted = vocab.filter(F.col("field").isin(*fields)).groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()
    large = {r["field"] for r in counted if r["n"] > SMALL_FIELD}
    sides = {
        c: vocab.filter(F.col("field") == c).select(F.col("token").alias(token), F.col("id").alias(name))
        for c, name in fields.items()
    }
    return {c: side if c in large else F.broadcast(side) for c, side in sides.items()}


def encode(df: DataFrame, vocab: DataFrame, fields: Sequence[str], suffix: str = "_id") -> DataFrame:
    """Token ids per field; unseen tokens become the unknown id.

    Pass a settled vocabulary: it is read once to count the tokens of each field, and for a field
    of many its file size decides between broadcast and shuffle join.
    """
    out = df
    sides = _field_ids(vocab, {c: f"{c}{suffix}" for c in fields}, "__token")
    for c in fields:
        side = sides[c]
        out = out.withColumn("__token", clean_token(F.col(c))).join(side, "__token", "left").drop("__token")
        out = out.withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), F.lit(1).cast("long")))
    return out


def fit_scaler(train: DataFrame, columns: Mapping[str, str | None], identity: Sequence[str] = CYCLIC_FIELDS) -> DataFrame:
    """``(field, mean, std)`` over non-null values under each column's mask.

    Population deviation, 0 becomes 1; no values gives (0, 1); ``identity``
    columns are left unscaled.
    """
    facts = []
    for c, mask in columns.items():
        x = F.col(c).cast("double")
        x = x if mask is None else F.when(F.col(mask) == 1, x)
        facts.append(F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")).alias(c))
    one = train.agg(*facts)
    rows = []
    for c in columns:
        same = c in identity
        mean = F.lit(0.0) if same else F.coalesce(F.col(c)["mean"], F.lit(0.0))
        std = F.lit(1.0) if same else F.coalesce(F.nullif(F.col(c)["std"], F.lit(0.0)), F.lit(1.0))
        rows.append(F.struct(F.lit(c).alias("field"), mean.alias("mean"), std.alias("std")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """``(x - mean) / std`` as float; null becomes 0.0."""
    one = scaler.agg(
        *[F.max(F.when(F.col("field") == c, F.struct("mean", "std"))).alias(f"__{c}") for c in columns]
    )
    out = with_scalars(df, one)
    return out.withColumns(
        {
            f"{c}{suffix}": F.coalesce(
                (F.col(c).cast("double") - F.col(f"__{c}")["mean"]) / F.col(f"__{c}")["std"], F.lit(0.0)
            ).cast("float")
            for c in columns
        }
    ).drop(*[f"__{c}" for c in columns])


def prefix_index(df: DataFrame, keys: Sequence[str], cap: int | None) -> DataFrame:
    """One row per case and prefix length up to the cap; events stay in the source."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"))
    top = F.col("n_events") if cap is None else F.least("n_events", F.lit(cap))
    k = F.explode(F.sequence(F.lit(1).cast("long"), top))
    return sizes.select(*keys, "n_events", k.alias("prefix_length")).withColumn(
        "label_pos", F.col("prefix_length") - 1
    )


def _within(index: str, cap: int | None) -> Column:
    return F.lit(True) if cap is None else F.col(index) < cap


def prefix_counts(df: DataFrame, cap: int | None, dataset: str = "dataset_id", client: str = "client_id",
                  split: str = "split", case: str = "case_id") -> DataFrame:
    """Cases, events, prefixes and longest trace per client and in total (null client)."""
    sizes = df.groupBy(dataset, client, split, case).agg(F.count(F.lit(1)).alias("n"))
    sized = sizes.withColumn("p", F.col("n") if cap is None else F.least("n", F.lit(cap)))
    return (
        sized.groupingSets([[dataset, client], []], dataset, client)
        .agg(
            F.count_distinct(F.struct(dataset, case)).alias("cases"),
            F.sum("n").alias("events"),
            F.sum("p").alias("prefixes"),
            F.max("n").alias("max_length"),
        )
    )


def train_outcome_counts(df: DataFrame, outcome: str = "outcome", keys: Sequence[str] = ("dataset_id", "client_id", "case_id")) -> DataFrame:
    """Cases per outcome in the train split, one per (dataset, client, case)."""
    one = df.filter("split = 'train'").groupBy(*keys).agg(F.first(outcome, ignorenulls=True).alias(outcome))
    return one.groupBy(outcome).agg(F.count(F.lit(1)).alias("cases"))


def _case_arrays(
    df: DataFrame, keys: Sequence[str], index: str, cap: int, row: Mapping[str, Column], extra: Sequence[Column] = ()
) -> DataFrame:
    """Case rows with an ordered array of at most ``cap`` events and the full length.

    The length is counted apart from the array, so events beyond the cap are
    dropped before they are collected. Padded arrays need a cap: it is the size of
    every array, so the caller chooses it by the memory of a task. Without one,
    :func:`prefix_index` beside the event table says the same without arrays.
    """
    one = F.struct(F.col(index).alias("__i"), *[c.alias(n) for n, c in row.items()])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.array_sort(F.collect_list(F.when(F.col(index) < cap, one))).alias("__events"),
        *extra,
    )


def _prefixes(cases: DataFrame) -> DataFrame:
    return cases.withColumn("prefix_length", F.explode(F.sequence(F.lit(1), F.size("__events"))))


def _padded(values: Column, k: Column, cap: int, zero: Column) -> Column:
    return F.concat(F.slice(values, F.lit(1), k), F.array_repeat(zero, F.lit(cap) - k))


def prefix_arrays(
    df: DataFrame, keys: Sequence[str], index: str, ids: Sequence[str], numbers: Sequence[str], cap: int
) -> DataFrame:
    """Per prefix: one padded id array per categorical and one padded float array per number, and the mask.

    ``ids`` and ``numbers`` are encoded columns. Each case is collected once and
    sliced per prefix.
    """
    row = {c: F.col(c) for c in [*ids, *numbers]}
    k = F.col("prefix_length")
    out = _prefixes(_case_arrays(df, keys, index, cap, row))
    cols = [
        _padded(F.col(f"__events.{c}"), k, cap, F.lit(0).cast("long")).alias(c) for c in ids
    ] + [
        _padded(F.col(f"__events.{c}"), k, cap, F.lit(0.0).cast("float")).alias(c) for c in numbers
    ]
    mask = F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), F.lit(cap) - k))
    return out.select(*keys, "prefix_length", *cols, mask.alias("padding_mask"))


def scale_state(df: DataFrame, scaler: DataFrame, cols: Sequence[str], present: str = "state_present", raw_prefix: str = "carried_") -> DataFrame:
    """Scaled offer state per event: 0.0 before the first offer and for fields it left null."""
    scaled = scale(df, scaler.select(F.concat(F.lit(raw_prefix), "field").alias("field"), "mean", "std"),
                   [f"{raw_prefix}{c}" for c in cols])
    return scaled.withColumns(
        {f"state_{c}": F.when(F.col(present) == 1, F.col(f"{raw_prefix}{c}_scaled")).otherwise(F.lit(0.0).cast("float")) for c in cols}
    )


def prefix_state_arrays(
    df: DataFrame, keys: Sequence[str], index: str, state: Sequence[str], present: str, cap: int
) -> DataFrame:
    """Per prefix: padded state arrays and the padded present mask; no state columns give empty arrays."""
    k = F.col("prefix_length")
    row = {c: F.col(c) for c in state} | {present: F.col(present)}
    out = _prefixes(_case_arrays(df, keys, index, cap, row))
    if not state:
        mask = F.array_repeat(F.lit(0), cap)
    else:
        mask = _padded(F.col(f"__events.{present}"), k, cap, F.lit(0))
    cols = [_padded(F.col(f"__events.{c}"), k, cap, F.lit(0.0).cast("float")).alias(c) for c in state]
    return out.select(*keys, "prefix_length", *cols, mask.alias("state_mask"))


def prefix_labels(
    df: DataFrame, keys: Sequence[str], index: str, n_events: str, cap: int | None, next_token: str, remaining: str,
    outcome: str, vocab: DataFrame, target_field: str = "next_activity_target", target: DataFrame | None = None,
) -> DataFrame:
    """Labels of each prefix, taken from its last event.

    Position is the event index, so no join to a prefix table is needed: the
    prefix of length ``k`` is the event at ``k - 1``. An unseen next token has
    mask 0, as has the remaining time on the last event of the case.
    """
    at = df.filter(_within(index, cap))
    side = _field_ids(vocab, {target_field: "next_label"}, "__t")[target_field]
    out = at.withColumn("__t", clean_token(F.col(next_token))).join(side, "__t", "left").drop("__t")
    last = F.col(index) == F.col(n_events) - 1
    seconds = F.col(remaining).cast("double")
    labelled = out.select(
        *keys,
        (F.col(index) + 1).alias("prefix_length"),
        F.col(outcome).alias("outcome_label"),
        F.coalesce("next_label", F.lit(1).cast("long")).alias("next_label"),
        F.when(F.col("next_label").isNull(), 0).otherwise(1).alias("next_mask"),
        seconds.alias("remaining_label"),
        F.when(last, 0).otherwise(1).alias("remaining_mask"),
    )
    return labelled if target is None else transform_target(labelled, target, "remaining_label")


def _transformed(x: Column, transform: str) -> Column:
    if transform not in TRANSFORMS:
        raise ValueError(f"unknown transform: {transform!r}")
    return F.log1p(x) if transform == "log" else x


def target_population(df: DataFrame, index: str, n_events: str, cap: int | None, remaining: str, split: str = "split") -> DataFrame:
    """Train prefix targets within the cap, without the last event of a case."""
    return df.filter(
        (F.col(split) == "train") & _within(index, cap) & (F.col(index) < F.col(n_events) - 1)
    ).select(F.col(remaining).cast("double").alias("seconds"))


def _not_negative(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("remaining time contains negative values")).cast("double")).otherwise(x)


def fit_target(population: DataFrame, transform: str = "raw", scaling: str = "zscore") -> DataFrame:
    """One row of target parameters fitted on positive values.

    Negative values raise; no values give (0, 1). The lower median is kept for
    the scalings that start from it.
    """
    if scaling not in SCALINGS:
        raise ValueError(f"unknown scaling: {scaling!r}")
    x = _not_negative(F.col("seconds"))
    values = population.select(x.alias("s")).filter("s > 0").withColumn("t", _transformed(F.col("s"), transform))
    base = values.agg(F.avg("t").alias("__mean"), F.stddev_pop("t").alias("__std"), F.count(F.lit(1)).alias("n_values"))
    if scaling == "zscore":
        mean = F.coalesce("__mean", F.lit(0.0))
        std = F.when(F.col("__std").isNull(), F.lit(1.0)).otherwise(F.greatest("__std", F.lit(1e-6)))
        return base.select(
            F.lit(transform).alias("transform"), F.lit(scaling).alias("scaling"), mean.alias("center"),
            std.alias("scale"), F.lit(0.0).alias("median_model_units"), F.lit(0.0).alias("median_seconds"), "n_values",
        )
    # Both transforms grow with the value, so one rank selection gives both medians.
    base = with_scalars(base, quantiles(values, F.col("s"), {"__med": 0.5}, lower=True))
    med = _transformed(F.coalesce("__med", F.lit(0.0)), transform)
    spread = F.lit(1.0) if scaling == "raw" else F.greatest(med, F.lit(1.0))
    return base.select(
        F.lit(transform).alias("transform"), F.lit(scaling).alias("scaling"), F.lit(0.0).alias("center"),
        spread.alias("scale"), (med / spread).alias("median_model_units"),
        F.coalesce("__med", F.lit(0.0)).alias("median_seconds"), "n_values",
    )


def transform_target(df: DataFrame, target: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Seconds to model units; null becomes 0.0, negative values raise."""
    with_t = with_scalars(df, target.select(F.struct("transform", "center", "scale").alias("__t")))
    x = _not_negative(F.col(col).cast("double"))
    t = F.when(F.col("__t.transform") == "log", F.log1p(x)).otherwise(x)
    units = (t - F.col("__t.center")) / F.greatest(F.col("__t.scale"), F.lit(1e-6))
    return with_t.withColumn(out or col, F.coalesce(units, F.lit(0.0))).drop("__t")


def inverse_target(df: DataFrame, target: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Model units back to seconds."""
    with_t = with_scalars(df, target.select(F.struct("transform", "center", "scale").alias("__t")))
    t = F.col(col).cast("double") * F.col("__t.scale") + F.col("__t.center")
    s = F.when(F.col("__t.transform") == "log", F.expm1(t)).otherwise(t)
    return with_t.withColumn(out or col, s).drop("__t")


def class_weights(labels: DataFrame, col: str, classes: int, power: float = 1.0) -> DataFrame:
    """``(N / (K n_c)) ** power`` per class; an absent class raises."""
    counted = labels.groupBy(F.col(col).cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    wide = counted.agg(
        F.sum("n").alias("__total"),
        *[F.coalesce(F.max(F.when(F.col("class_id") == c, F.col("n"))), F.lit(0)).alias(f"__{c}") for c in range(classes)],
    )
    rows = []
    for c in range(classes):
        w = F.pow(F.col("__total") / (F.lit(float(classes)) * F.nullif(F.col(f"__{c}"), F.lit(0))), F.lit(float(power)))
        checked = F.when(
            F.col(f"__{c}") == 0, F.raise_error(F.lit(f"class {c} is absent from the labels")).cast("double")
        ).otherwise(w)
        rows.append(F.struct(F.lit(c).alias("class_id"), F.col(f"__{c}").alias("n"), checked.alias("weight")))
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def label_support(df: DataFrame, label: str, mask: str, dataset: str = "dataset_id") -> DataFrame:
    """Target ids that occur in train among masked-in rows, with their counts, per dataset."""
    return df.filter(F.col(mask) == 1).groupBy(dataset, label).agg(F.count(F.lit(1)).alias("n"))


def dense_support(support: DataFrame, label: str, classes: int, dataset: str = "dataset_id") -> DataFrame:
    """Per dataset an array of counts over all ids; a dataset without support raises."""
    counts = support.groupBy(dataset).agg(
        F.sum("n").alias("__n"),
        F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("long"), "n"))).alias("__m"),
    )
    arr = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long")),
        lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0).cast("long")),
    )
    ok = F.when(F.col("__n") > 0, arr).otherwise(
        F.raise_error(F.lit("dataset without label support")).cast("array<bigint>")
    )
    return counts.select(dataset, ok.alias("support"))


def mask_scores(df: DataFrame, scores: str, support: DataFrame, dataset: str = "dataset_id", valid: str | None = None) -> DataFrame:
    """Scores of ids outside the row's dataset support become null (minus infinity).

    ``support`` has one row per dataset. Rows without a valid target are left alone.
    """
    joined = df.join(support.select(dataset, F.col("support").alias("__s")), dataset, "left")
    cut = F.transform(F.col(scores), lambda s, i: F.when(F.get("__s", i) > 0, s))
    if valid is not None:
        cut = F.when(F.col(valid) == 1, cut).otherwise(F.col(scores))
    return joined.withColumn(scores, cut).drop("__s")


def encoding_identity(parts: Mapping[str, DataFrame], settings: Mapping[str, object]) -> DataFrame:
    """Stable key of everything that shapes an encoding.

    Each part is fingerprinted by an order-free sum of row hashes and its row
    count; the key hashes those with the sorted settings.
    """
    prints = None
    for name in sorted(parts):
        df = parts[name]
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
        part = df.agg(
            F.lit(name).alias("part"),
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h"),
        )
        prints = part if prints is None else prints.unionByName(part)
    text = F.concat_ws(";", *[F.lit(f"{k}={settings[k]!r}") for k in sorted(settings)])
    # One row per part.
    packed = prints.agg(F.array_sort(F.collect_list(F.struct("part", "n", "h"))).alias("p"))
    return packed.select(
        F.sha2(F.concat_ws("|", text, F.to_json("p")), 256).alias("identity")
    )
