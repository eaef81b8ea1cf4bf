"""Additive statistics per client and what can be rebuilt from their sums.

Statistics are long rows ``(client_id, family, field, key, value)``. Everything
except the maximum trace length adds up over clients, so the server side is a
sum with map-side combine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.functions.contract import CYCLIC_FIELDS
from tracemill.operators.encode import _long_tokens, _not_negative, _transformed, _vocabulary

MAX_KEY = "max_length"


def _rows(client: str, family: str, entries: list[tuple[str, str, Column]]) -> list[Column]:
    return [
        F.col(client),
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(family).alias("family"), F.lit(f).alias("field"), F.lit(k).alias("key"),
                    v.cast("double").alias("value"),
                )
                for f, k, v in entries
            ])
        ).alias("x"),
    ]


def local_stats(
    df: DataFrame, cap: int | None, categorical: Sequence[str], numeric: Mapping[str, str | None],
    transform: str = "raw", client: str = "client_id", case: str = "case_id", index: str = "event_index",
    n_events: str = "n_events", outcome: str = "outcome", remaining: str = "remaining_time",
) -> DataFrame:
    """Counts, train outcomes, train token counts, train moments and target moments per client.

    ``numeric`` maps columns to their mask (or none). Validation and test events
    add to the counts only.
    """
    n = F.count(F.lit(1))
    sizes = df.groupBy(client, "split", case).agg(n.alias("n"))
    counts = sizes.groupBy(client).agg(
        n.alias("c"), F.sum("n").alias("e"), F.sum("n" if cap is None else F.least("n", F.lit(cap))).alias("p"), F.max("n").alias("m")
    ).select(*_rows(client, "counts", [
        ("cases", "", F.col("c")), ("events", "", F.col("e")), ("prefixes", "", F.col("p")), (MAX_KEY, "", F.col("m")),
    ])).select(client, "x.*")

    train = df.filter("split = 'train'")
    outcomes = (
        train.groupBy(client, case).agg(F.first(outcome, ignorenulls=True).cast("string").alias("key"))
        .groupBy(client, "key").agg(n.cast("double").alias("value"))
        .select(client, F.lit("outcomes").alias("family"), F.lit("outcome").alias("field"), "key", "value")
    )
    tokens = (
        _long_tokens(train, categorical, [client]).groupBy(client, "field", "token")
        .agg(n.cast("double").alias("value"))
        .select(client, F.lit("tokens").alias("family"), "field", F.col("token").alias("key"), "value")
    )

    masked = {
        ("moments", c): F.col(c).cast("double") if m is None else F.when(F.col(m) == 1, F.col(c).cast("double"))
        for c, m in numeric.items()
    }
    seconds = _not_negative(F.col(remaining).cast("double"))
    last = F.col(index) == F.col(n_events) - 1
    fits = (F.lit(True) if cap is None else F.col(index) < cap) & ~last & (seconds > 0)
    masked[("target", f"remaining_time_{transform}")] = F.when(fits, _transformed(seconds, transform))
    # Feature and target moments come from one pass over the train events.
    facts, entries = [], []
    for i, ((family, name), v) in enumerate(masked.items()):
        facts.append(F.struct(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).alias(f"__{i}"))
        entries += [
            F.struct(F.lit(family).alias("family"), F.lit(name).alias("field"), F.lit(k).alias("key"),
                     F.col(f"__{i}")[part].cast("double").alias("value"))
            for k, part in (("count", "n"), ("sum", "s"), ("sum_squared", "q"))
        ]
    moments = (
        train.groupBy(client).agg(*facts).select(client, F.explode(F.array(*entries)).alias("x"))
        .select(client, "x.*").filter("value is not null")
    )
    return counts.unionByName(outcomes).unionByName(tokens).unionByName(moments)


def merge_stats(stats: DataFrame, client: str | None = None) -> DataFrame:
    """Sum over clients; the maximum trace length merges by maximum.

    With ``client`` named, the counts of each client stay beside the totals, whose client is null. Only
    rows of the counts are doubled for that, tokens and moments are not. A client without a name then raises.
    """
    merged = F.when(F.col("field") == MAX_KEY, F.max("value")).otherwise(F.sum("value"))
    keys = ["family", "field", "key"]
    if client is None:
        return stats.groupBy(*keys).agg(merged.alias("value"))
    named = F.when(F.col(client).isNull(), F.raise_error(F.lit("a client has no name")).cast("string")).otherwise(
        F.col(client).cast("string")
    )
    total = F.lit(None).cast("string")
    scope = F.when(F.col("family") == "counts", F.array(total, named)).otherwise(F.array(total))
    return stats.select(F.explode(scope).alias(client), *keys, "value").groupBy(client, *keys).agg(merged.alias("value"))


def vocab_from_counts(merged: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Vocabulary rebuilt from merged token counts."""
    tokens = merged.filter(F.col("family") == "tokens").select("field", F.col("key").alias("token"))
    return _vocabulary(tokens.filter(F.col("field").isin(*fields)), fields)


def _from_moments(merged: DataFrame, family: str) -> DataFrame:
    at = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    wide = merged.filter(F.col("family") == family).groupBy("field").agg(
        at("count").alias("n"), at("sum").alias("s"), at("sum_squared").alias("q")
    )
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0)
    var = F.greatest(F.try_divide(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0))
    std = F.when(F.col("n") > 0, F.sqrt(var))
    return wide.select("field", "n", mean.alias("mean"), std.alias("std"))


def scaler_from_moments(merged: DataFrame, identity: Sequence[str] = CYCLIC_FIELDS) -> DataFrame:
    """``(field, mean, std)``: deviation 0 becomes 1, no values give (0, 1), cyclic columns stay unscaled."""
    same = F.col("field").isin(*identity)
    return _from_moments(merged, "moments").select(
        "field",
        F.when(same, 0.0).otherwise(F.col("mean")).alias("mean"),
        F.when(same, 1.0).otherwise(F.coalesce(F.nullif(F.col("std"), F.lit(0.0)), F.lit(1.0))).alias("std"),
    )


def target_from_moments(merged: DataFrame, transform: str, scaling: str) -> DataFrame:
    """Target parameters from summed moments; median scaling is not additive and raises.

    Clients must have sent one and the same transform.
    """
    if scaling == "median":
        raise ValueError("median scaling cannot be rebuilt from additive statistics")
    if scaling not in ("raw", "zscore"):
        raise ValueError(f"unknown scaling: {scaling!r}")
    t = _from_moments(merged, "target")
    name = f"remaining_time_{transform}"
    mixed = F.when(
        (F.count(F.lit(1)) > 1) | F.coalesce(F.max("field") != name, F.lit(False)),
        F.raise_error(F.lit("clients sent mixed target settings")).cast("double"),
    )
    center = F.coalesce(mixed, F.max("mean"), F.lit(0.0))
    scale = F.coalesce(mixed, F.nullif(F.max("std"), F.lit(0.0)), F.lit(1.0))
    if scaling == "raw":
        center, scale = F.coalesce(mixed, F.lit(0.0)), F.lit(1.0)
    return t.agg(
        F.lit(transform).alias("transform"), F.lit(scaling).alias("scaling"), center.alias("center"),
        scale.alias("scale"), F.coalesce(F.max("n"), F.lit(0.0)).cast("long").alias("n_values"),
    )


def compare_stats(a: DataFrame, b: DataFrame, tol: float = 1e-9, by: Sequence[str] = ()) -> DataFrame:
    """Per family whether both sides hold the same keys and equal values within ``tol``.

    ``n_different`` counts the differing entries; the tolerance is relative and absolute.
    """
    key = [*by, "family", "field", "key"]
    both = a.select(*key, F.col("value").alias("a")).join(b.select(*key, F.col("value").alias("b")), key, "full_outer")
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(
        F.lit(tol) * F.greatest(F.abs("a"), F.abs("b")), F.lit(tol)
    )
    bad = F.count_if(~F.coalesce(near, F.lit(False)))
    return both.groupBy(*by, "family").agg(
        (bad == 0).alias("matches"), bad.alias("n_different"), F.count(F.lit(1)).alias("n_entries")
    )


def differences(a: DataFrame, b: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Entries that differ between two statistics."""
    key = ["family", "field", "key"]
    both = a.select(*key, F.col("value").alias("a")).join(b.select(*key, F.col("value").alias("b")), key, "full_outer")
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(tol) * F.greatest(F.abs("a"), F.abs("b")), F.lit(tol))
    return both.filter(~F.coalesce(near, F.lit(False)))


#: Families of a metadata record; each is one check of a comparison.
FAMILIES = ("counts", "outcomes", "per_bank_counts", "prefix", "scalers", "target", "vocabularies")
#: Families of real numbers, which compare within a tolerance. All others must be equal.
REAL = ("scalers", "target")


def metadata_record(
    counts: DataFrame, outcomes: DataFrame, vocab: DataFrame, scaler: DataFrame, target: DataFrame, cap: int | None,
    client: str = "client_id", outcome: str = "outcome",
) -> DataFrame:
    """Everything an encoding was fitted to, as rows ``(family, bank, field, key, value, text)``.

    ``counts`` is what ``encode.prefix_counts`` returns (null client: total), ``outcomes`` what ``train_outcome_counts``
    returns; the fits are those of ``encode`` or the ones rebuilt from sums. ``bank`` is null but for counts per bank.
    """
    def entry(family: Column, field: str, key: Column, value: Column | None = None, text: Column | None = None,
              bank: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            family.alias("family"), (none if bank is None else bank).cast("string").alias("bank"), F.lit(field).alias("field"),
            key.alias("key"), (none if value is None else value).cast("double").alias("value"),
            (none if text is None else text).cast("string").alias("text"),
        )

    def rows(df: DataFrame, entries: Column) -> DataFrame:
        return df.select(F.explode(entries).alias("x")).select("x.*")

    blank, bank = F.lit(""), F.col(client)
    family = F.when(bank.isNull(), "counts").otherwise("per_bank_counts")
    sums = [entry(family, c, blank, F.col(c), bank=bank) for c in ("cases", "events", "prefixes")]
    length = F.lit(cap)
    settings = [
        entry(F.lit("prefix"), "cap", blank, length), entry(F.lit("prefix"), "padding", blank, length),
        entry(F.lit("prefix"), MAX_KEY, blank, F.col(MAX_KEY)),
    ]
    ids = vocab.select(
        F.lit("vocabularies").alias("family"), F.lit(None).cast("string").alias("bank"), "field", F.col("token").alias("key"),
        F.col("id").cast("double").alias("value"), F.lit(None).cast("string").alias("text"),
    )
    scales = scaler.select("field", F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in ("mean", "std")
    ])).alias("x")).select(
        F.lit("scalers").alias("family"), F.lit(None).cast("string").alias("bank"), "field", "x.key", "x.value",
        F.lit(None).cast("string").alias("text"),
    )
    aim = [entry(F.lit("target"), "remaining_time", F.lit(k), F.col(k)) for k in ("center", "scale", "n_values")]
    aim += [entry(F.lit("target"), "remaining_time", F.lit(k), text=F.col(k)) for k in ("transform", "scaling")]
    return (
        rows(counts, F.when(bank.isNull(), F.array(*sums, *settings)).otherwise(F.array(*sums)))
        .unionByName(rows(outcomes, F.array(entry(F.lit("outcomes"), "outcome", F.col(outcome).cast("string"), F.col("cases")))))
        .unionByName(ids).unionByName(scales).unionByName(rows(target, F.array(*aim)))
    )


def merged_metadata(
    merged: DataFrame, fields: Mapping[str, Sequence[str]], cap: int | None, transform: str, scaling: str, client: str = "client_id",
) -> DataFrame:
    """The record rebuilt from sums alone; ``merged`` keeps clients, see :func:`merge_stats`, and is read five times (settle it)."""
    at = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    counts = merged.filter("family = 'counts'").groupBy(client).agg(
        *[at(c).alias(c) for c in ("cases", "events", "prefixes", MAX_KEY)]
    )
    outcomes = merged.filter("family = 'outcomes'").select(F.col("key").alias("outcome"), F.col("value").alias("cases"))
    return metadata_record(
        counts, outcomes, vocab_from_counts(merged, fields), scaler_from_moments(merged),
        target_from_moments(merged, transform, scaling), cap, client,
    )


def compare_metadata(a: DataFrame, b: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Two records as seven rows ``(family, matches, n_different, n_entries)``, one per family, also for one without entries.

    Scalers and target parameters may differ by ``tol``, relative or absolute; everything else must be equal.
    Both sides meet in one grouping by key, which is null-safe and adds up map-side; an entry on one side only, or more than
    once on a side, differs.
    """
    key = ["family", "bank", "field", "key"]
    sides = a.select(*key, "value", "text", F.lit(True).alias("__a")).unionByName(
        b.select(*key, "value", "text", F.lit(False).alias("__a"))
    )
    of = lambda c, side: F.max(F.when(F.col("__a") == side, F.col(c)))
    both = sides.groupBy(*key).agg(
        of("value", True).alias("x"), of("value", False).alias("y"), of("text", True).eqNullSafe(of("text", False)).alias("text"),
        ((F.count_if("__a") == 1) & (F.count_if(~F.col("__a")) == 1)).alias("once"),
    )
    x, y = F.col("x"), F.col("y")
    near = F.abs(x - y) <= F.greatest(F.lit(tol) * F.greatest(F.abs(x), F.abs(y)), F.lit(tol))
    equal = x.eqNullSafe(y) | (F.col("family").isin(*REAL) & F.coalesce(near, F.lit(False)))
    per = both.groupBy("family").agg(
        F.count_if(~(F.col("once") & F.col("text") & equal)).alias("n_different"), F.count(F.lit(1)).alias("n_entries")
    )
    names = a.sparkSession.createDataFrame([(f,) for f in FAMILIES], "family string")
    zero = F.lit(0).cast("long")
    out = names.join(per, "family", "left")
    bad = F.coalesce("n_different", zero)
    return out.select("family", (bad == 0).alias("matches"), bad.alias("n_different"), F.coalesce("n_entries", zero).alias("n_entries"))


def metadata_verdict(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether all checks hold, and the families that differ, in name order."""
    grouped = checks.groupBy(*by) if by else checks.groupBy()
    # At most as many entries as families.
    return grouped.agg(
        F.every("matches").alias("matches"), F.array_sort(F.collect_set(F.when(~F.col("matches"), F.col("family")))).alias("differences")
    )


def check_summary(checks: DataFrame) -> DataFrame:
    """Passed and failed runs per check; input ``(dataset, run, family, matches)``."""
    return checks.groupBy("family").agg(
        F.count_if("matches").alias("passed"), F.count_if(~F.col("matches")).alias("failed")
    )


def match_summary(checks: DataFrame, reports: DataFrame) -> DataFrame:
    """Per dataset and overall (null dataset): runs, matched, mismatched and client reports.

    ``reports`` holds ``(dataset, run, n_reports)``; a run matches when all its checks do.
    """
    runs = checks.groupBy("dataset", "run").agg(F.every("matches").alias("ok")).join(reports, ["dataset", "run"], "left")
    return runs.groupingSets([["dataset"], []], "dataset").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("ok").alias("matched"),
        F.count_if(~F.col("ok")).alias("mismatched"),
        F.coalesce(F.sum("n_reports"), F.lit(0)).alias("reports"),
        F.every("ok").alias("all_match"),
    )


def group_weighted_vector_mean(
    df: DataFrame, group: Sequence[str], vec: str, weight: str, mode: str = "sample", contribution: str | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Element-wise mean of client vectors per group.

    ``sample`` weighs by ``weight``, ``equal`` does not, ``contribution`` weighs
    each element by its own contribution where those sum to ``threshold`` and
    falls back to the sample mean elsewhere. Elements are summed map-side, so
    vectors of a group are never gathered. A non-positive total weight or
    unequal lengths raise.
    """
    if mode not in ("sample", "equal", "contribution"):
        raise ValueError(f"unknown mode: {mode!r}")
    group = list(group)
    one = F.transform(F.col(vec), lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("v")))
    if mode == "contribution":
        if contribution is None:
            raise ValueError("contribution mode needs a contribution column")
        one = F.transform(
            F.col(vec),
            lambda x, i: F.struct(
                i.alias("i"), x.cast("double").alias("v"), F.get(contribution, i).cast("double").alias("c")
            ),
        )
    flat = df.select(*group, F.col(weight).cast("double").alias("__w"), F.explode(one).alias("e"))
    v, w = F.col("e.v"), F.col("__w")
    total = F.sum(w)
    sample = F.sum(v * w) / F.when(total > 0, total).otherwise(
        F.raise_error(F.lit("total weight is not positive")).cast("double")
    )
    if mode == "equal":
        value = F.avg(v)
    elif mode == "sample":
        value = sample
    else:
        c = F.col("e.c")
        value = F.when(F.sum(c) >= threshold, F.sum(v * c) / F.sum(c)).otherwise(sample)
    per = flat.groupBy(*group, F.col("e.i").alias("i")).agg(value.alias("value"), F.count(F.lit(1)).alias("n"))
    # As many rows per group as a vector has elements.
    packed = per.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("i", "value"))).alias("p"), F.min("n").alias("lo"), F.max("n").alias("hi")
    )
    ok = F.when(F.col("lo") == F.col("hi"), F.col("p.value")).otherwise(
        F.raise_error(F.lit("vectors have unequal lengths")).cast("array<double>")
    )
    return packed.select(*group, ok.alias("mean"))
