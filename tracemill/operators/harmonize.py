"""Harmonise columns and activity labels across logs, and score mapping drafts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.functions.contract import (
    DERIVED, OFFER_FIELDS, REQUIRED, SPARK_TYPES,
)
from tracemill.functions.labels import (
    END_TOKEN, MISSING_TOKEN, OTHER_TOKEN, after_last, any_present, before_last, clean_token, cycle, seconds_between,
)
from tracemill.functions.ordered import Position, Preceding, over_trace, ranked
from tracemill.functions.quantiles import with_scalars
from tracemill.log import LogSpec


@dataclass(frozen=True)
class SourceMapping:
    """How one log becomes canonical: field to column, approved defaults, offer columns."""

    columns: Mapping[str, str]
    defaults: Mapping[str, object] = field(default_factory=dict)
    offer_sources: Sequence[str] = ()


def _coerce(name: str, value: Column) -> Column:
    kind = REQUIRED[name]
    return clean_token(value) if kind == "string" else value.cast(SPARK_TYPES[kind])


def to_canonical(
    df: DataFrame, spec: LogSpec, mapping: SourceMapping, dataset_id: str,
    client: str | Column, split: str | Column,
) -> DataFrame:
    """Canonical events of one log.

    ``client`` and ``split`` are columns, so all splits of a log go through one
    plan. Events are indexed in the log order; the gap to the previous event is
    0.0 on the first. Fields without source and default are absent, except offer
    fields, which become null.
    """
    if not mapping.columns.get("case_id"):
        raise ValueError(f"case id mapping is missing for {dataset_id}")
    unknown = sorted(set(mapping.columns) - set(REQUIRED))
    if unknown:
        raise ValueError(f"unknown canonical fields: {unknown}")
    placed = over_trace(df, spec, [Position("__index"), Preceding("__prev", F.col(spec.ts))])
    day_sin, day_cos = cycle(F.weekday(spec.ts), 7)
    hour_sin, hour_cos = cycle(F.hour(spec.ts), 24)
    cols = {
        "dataset_id": F.lit(dataset_id),
        "client_id": (F.col(client) if isinstance(client, str) else client).cast("string"),
        "split": (F.col(split) if isinstance(split, str) else split).cast("string"),
        "event_index": F.col("__index"),
        "time_since_previous": F.coalesce(seconds_between(F.col(spec.ts), F.col("__prev")), F.lit(0.0)),
        "weekday_sin": day_sin, "weekday_cos": day_cos, "hour_sin": hour_sin, "hour_cos": hour_cos,
    }
    for name in REQUIRED:
        if name in DERIVED:
            continue
        if mapping.columns.get(name):
            cols[name] = _coerce(name, F.col(mapping.columns[name]))
        elif name in mapping.defaults:
            cols[name] = _coerce(name, F.lit(mapping.defaults[name]))
        elif name in OFFER_FIELDS:
            cols[name] = F.lit(None).cast("double")
    cols["credit_score_value"] = F.nullif(cols["credit_score_value"], F.lit(0.0))
    out = placed.select(*[c.alias(n) for n, c in cols.items()])
    mask = any_present(list(mapping.offer_sources))
    return out.withColumn("offer_feature_mask", mask).withColumn("offer_present", F.col("offer_feature_mask"))


def _literal_frame(spark: SparkSession, pairs: Mapping[str, str], key: str, value: str) -> DataFrame:
    """Reviewed lookup as a frame of known size, so the planner chooses the join."""
    rows = [(str(k), str(v)) for k, v in pairs.items()]
    return spark.createDataFrame(rows, f"`{key}` string, `{value}` string")


def flatten_labels(by_dataset: Mapping[str, Mapping[str, str]], dataset_aware: bool = False) -> dict[str, str]:
    """Raw label to canonical label over all logs; the last log wins on a clash.

    With ``dataset_aware`` keys are ``dataset|label`` and nothing clashes.
    """
    out: dict[str, str] = {}
    for dataset, labels in by_dataset.items():
        for raw, canon in labels.items():
            out[f"{dataset}|{raw}" if dataset_aware else raw] = canon
    return out


def apply_label_map(
    df: DataFrame, labels: Mapping[str, str], overrides: Mapping[str, str] | None = None, dataset_aware: bool = False
) -> DataFrame:
    """Canonical activity label and token, and the next-activity target.

    Unknown labels fall back to the other-activity token without a lifecycle. An
    exact token override wins even then. The end token is kept as it is.
    """
    spark = df.sparkSession
    overrides = overrides or {}
    key = (lambda c: F.concat_ws("|", "dataset_id", c)) if dataset_aware else (lambda c: c)
    raw, life = clean_token(F.col("raw_activity")), clean_token(F.col("lifecycle"))
    nxt = clean_token(F.col("next_activity_raw"))
    out = df.withColumns(
        {
            "__label": raw, "__life": life, "__token": clean_token(F.col("raw_activity_token")), "__next": nxt,
        }
    ).withColumns(
        {
            "__next_label": before_last(F.col("__next")),
            "__next_life": F.coalesce(F.nullif(after_last(F.col("__next")), F.lit("")), F.lit(MISSING_TOKEN)),
            "__key": key(F.col("__label")),
        }
    ).withColumn("__next_key", key(F.col("__next_label")))
    lab = _literal_frame(spark, labels, "__k", "__v")
    ovr = _literal_frame(spark, overrides, "__k", "__v")

    def attach(frame: DataFrame, table: DataFrame, on: str, name: str) -> DataFrame:
        # The map comes from the caller's memory, and a log has few labels: joined by shuffle, each would be one task.
        side = table.select(F.col("__k").alias(on), F.col("__v").alias(name))
        return frame.join(F.broadcast(side), on, "left")

    out = attach(out, lab, "__key", "__canon")
    out = attach(out, lab, "__next_key", "__next_canon")
    out = attach(out, ovr, "__token", "__override")
    out = attach(out, ovr, "__next", "__next_override")

    def canonical(label: str, lifecycle: str) -> Column:
        known = F.col(label).isNotNull() & (F.col(label) != OTHER_TOKEN)
        return F.when(known, F.concat(F.col(label), F.lit("+"), F.col(lifecycle))).otherwise(F.lit(OTHER_TOKEN))

    target = F.when(F.col("__next") == END_TOKEN, F.lit(END_TOKEN)).otherwise(
        F.coalesce("__next_override", canonical("__next_canon", "__next_life"))
    )
    return out.withColumns(
        {
            "canonical_activity_label": F.coalesce("__canon", F.lit(OTHER_TOKEN)),
            "canonical_activity_token": F.coalesce("__override", canonical("__canon", "__life")),
            "next_activity_target": target,
            "next_activity_mask": F.lit(1),
            "remaining_time_mask": F.lit(1),
        }
    ).select(
        *df.columns, "canonical_activity_label", "canonical_activity_token",
        "next_activity_target", "next_activity_mask", "remaining_time_mask",
    )


def label_map_report(mapped: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Unresolved labels (current or next) with their event counts, and the totals.

    One row per unresolved label; ``approved_count`` and ``fallback_count`` repeat.
    """
    known = _literal_frame(mapped.sparkSession, labels, "label", "__v").select("label")
    nxt = clean_token(F.col("next_activity_raw"))
    counted = mapped.select(
        F.explode(
            F.array(
                F.struct(clean_token(F.col("raw_activity")).alias("label"), F.lit(1).alias("now")),
                F.struct(before_last(F.when(nxt != END_TOKEN, nxt)).alias("label"), F.lit(0).alias("now")),
            )
        ).alias("x")
    ).select("x.*").filter("label is not null").groupBy("label").agg(F.sum("now").alias("n_events"))
    unresolved = counted.join(known, "label", "left_anti")
    fallback = mapped.agg(
        F.count_if(F.col("canonical_activity_label") == OTHER_TOKEN).alias("fallback_count"),
        F.lit(len(labels)).alias("approved_count"),
    )
    return with_scalars(unresolved, fallback)


def origin(value: Column) -> Column:
    """Origin prefix of a label: text before the first underscore, empty without one."""
    return F.when(F.instr(value, "_") > 0, F.substring_index(value, "_", 1)).otherwise(F.lit(""))


def check_label_map(mapping: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of a label map that break a rule.

    ``mapping`` holds ``(raw, canonical, is_override)``, ``allowed`` one ``label``
    column. Rules: canonical label must be allowed, the other-activity token must
    not be a group, and a prefix must not turn into another prefix.
    """
    label = F.when(F.col("is_override"), F.substring_index("canonical", "+", 1)).otherwise(F.col("canonical"))
    checked = mapping.withColumn("__label", label).join(
        allowed.select(F.col("label").alias("__label"), F.lit(True).alias("__ok")).distinct(), "__label", "left"
    )
    a, b = origin(F.substring_index("raw", "+", 1)), origin(F.col("__label"))
    rules = F.array(
        F.when(~F.col("is_override") & F.col("__ok").isNull() & (F.col("canonical") != OTHER_TOKEN), F.lit("unknown_label")),
        F.when(F.col("canonical") == OTHER_TOKEN, F.lit("reserved_label")),
        F.when((a != "") & (b != "") & (a != b), F.lit("crossed_prefix")),
    )
    return checked.select("raw", "canonical", F.explode(F.array_compact(rules)).alias("rule"))


def union_sources(sources: Mapping[str, DataFrame], client: str = "client_id") -> DataFrame:
    """Joint run over several logs; client ids become ``dataset:bank``."""
    out = None
    for name, df in sources.items():
        one = df.withColumn("dataset_id", F.lit(name)).withColumn(client, F.concat_ws(":", F.lit(name), client))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no source given")
    return out


def missing_banks(joint: DataFrame, expected: Sequence[tuple[str, str]], client: str = "client_id") -> DataFrame:
    """Expected ``(dataset, bank)`` pairs that have no events."""
    want = joint.sparkSession.createDataFrame(
        [(d, f"{d}:{b}") for d, b in expected], f"dataset_id string, `{client}` string"
    )
    return want.join(joint.select("dataset_id", client).distinct(), ["dataset_id", client], "left_anti")


# Words ignored when names are compared.
_IGNORED = ("case", "event", "value")
_ORIGINS = ("a", "o", "w")


def name_words(value: Column, drop: Sequence[str] = _IGNORED) -> Column:
    """Lower-case words of a name without the ignored ones."""
    words = F.split(F.trim(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*drop))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length; 1.0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _entries(words: Column, mode: str) -> Column:
    """Index entries of a name with their counts: words, or pairs of characters with a mark at both ends."""
    if mode == "word":
        entries = words
    else:
        text = F.concat(F.lit("\u0001"), F.array_join(words, " "), F.lit("\u0001"))
        entries = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, 2))
    distinct = F.transform(F.array(entries), lambda all_: F.transform(
        F.array_distinct(all_), lambda e: F.struct(e.alias("entry"), F.size(F.filter(all_, lambda x: x == e)).alias("c"))))
    return distinct[0]


def _similar_names(left: DataFrame, right: DataFrame, mode: str, threshold: float, scope: Sequence[str] = ()) -> DataFrame:
    """``(__l, __r, score)`` of the pairs that reach the threshold, through an index of what their names share.

    Both sides hold an id (``__l``, ``__r``), the ``words`` of a name and the ``scope`` columns, which must agree. Names meet on
    shared entries only, whose counts are summed per pair; pairs that share too few to reach the threshold are never scored.
    ``word`` scores twice the shared words over all words. ``character`` scores 1 - edit distance / longer length: one
    edit changes two pairs of characters, so a pair within reach shares at least longer + 1 - 2 edits.
    """
    if mode not in ("character", "word"):
        raise ValueError(f"unknown similarity mode: {mode!r}")
    if mode == "character" and threshold < 0.5:
        raise ValueError("character similarity needs a threshold of 0.5 or more")

    def posted(df: DataFrame, id_: str, side: str) -> DataFrame:
        size = F.size("words") if mode == "word" else F.length(F.array_join("words", " "))
        return df.select(id_, *scope, size.alias(f"__n{side}"), F.explode(_entries(F.col("words"), mode)).alias("e")).select(
            id_, *scope, f"__n{side}", F.col("e.entry").alias("__entry"), F.col("e.c").alias(f"__c{side}"))

    met = posted(left, "__l", "a").join(posted(right, "__r", "b"), [*scope, "__entry"])
    shared = met.groupBy("__l", "__r").agg(
        F.sum(F.least("__ca", "__cb")).alias("__shared"), F.first("__na").alias("__na"), F.first("__nb").alias("__nb"))
    if mode == "word":
        score = 2 * F.col("__shared") / (F.col("__na") + F.col("__nb"))
        return shared.withColumn("score", score).filter(F.col("score") >= threshold).select("__l", "__r", "score")
    longest = F.greatest("__na", "__nb")
    edits = F.floor((1 - F.lit(threshold)) * longest + 1e-9)
    near = shared.filter(F.col("__shared") >= longest + 1 - 2 * edits).select("__l", "__r")
    text = lambda df, id_, name: df.select(id_, F.array_join("words", " ").alias(name))
    scored = near.join(text(left, "__l", "__ta"), "__l").join(text(right, "__r", "__tb"), "__r")
    score = edit_similarity(F.col("__ta"), F.col("__tb"))
    return scored.withColumn("score", score).filter(F.col("score") >= threshold).select("__l", "__r", "score")


def _scored_names(left: DataFrame, right: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """``(__l, __r, score)`` by edit distance of every pair of the same ``scope``, however little the names share.

    ``right`` is a list from the caller's memory, so pairs are scored where the names of ``left`` are.
    """
    text = lambda df, id_, name: df.select(id_, *scope, F.array_join("words", " ").alias(name))
    listed = F.broadcast(text(right, "__r", "__tb"))
    named = text(left, "__l", "__ta")
    pairs = named.join(listed, list(scope)) if scope else named.crossJoin(listed)
    return pairs.select("__l", "__r", edit_similarity(F.col("__ta"), F.col("__tb")).alias("score"))


def match_columns(
    names: DataFrame, aliases: Mapping[str, Sequence[str]], threshold: float = 0.72, mode: str = "character",
    name: str = "name", position: str = "position", every: bool = False,
) -> DataFrame:
    """Best source column per canonical field.

    ``names`` holds the distinct column names with their position; ties keep the first. Names and aliases meet through
    :func:`_similar_names`, so the pairs scored grow with what they share. Fields without a name at the threshold come back
    with a null column and score. With ``every`` (characters only) each name is scored with each alias, and a field below the
    threshold keeps the score of its best name.
    """
    if every and mode != "character":
        raise ValueError("every pair is scored by characters")
    spark = names.sparkSession
    pairs = [(i, f, a.split()) for i, (f, a) in enumerate((f, a) for f, many in aliases.items() for a in many)]
    listed = spark.createDataFrame(pairs, "__r int, field string, words array<string>")
    cleaned = names.select(F.struct(F.col(position).alias("p"), F.col(name).alias("n")).alias("__l"), name_words(F.col(name)).alias("words"))
    found = _scored_names(cleaned, listed.drop("field")) if every else _similar_names(cleaned, listed.drop("field"), mode, threshold)
    best = found.join(listed.select("__r", "field"), "__r").groupBy("field").agg(
        F.max(F.struct("score", (-F.col("__l.p")).alias("p"), F.col("__l.n").alias("n"))).alias("b"))
    fields = spark.createDataFrame([(f,) for f in aliases], "field string")
    return fields.join(best, "field", "left").select(
        "field", F.when(F.col("b.score") >= threshold, F.col("b.n")).alias("column_name"), F.col("b.score").alias("score"))


def match_labels(
    raw: DataFrame, canonical: Mapping[str, str], mode: str = "character", threshold: float = 0.55, every: bool = False,
) -> DataFrame:
    """Best canonical label per distinct raw label of the same prefix.

    ``raw`` holds ``(dataset_id, label)`` of all splits, ``canonical`` maps the
    contract's labels to their descriptions. Labels meet those of their prefix through :func:`_similar_names`. The
    score is the better of label and description; ties keep the first label listed. Labels that reach the threshold
    with none come back with a null label and score. With ``every`` (characters only) each label is scored with each of its
    prefix, and one below the threshold keeps its best score; the score is null only without a label of the prefix.
    """
    if every and mode != "character":
        raise ValueError("every pair is scored by characters")
    drop = (*_IGNORED, *_ORIGINS)
    spark = raw.sparkSession
    listed = spark.createDataFrame(
        [(2 * i + side, i, c, text, c.split("_", 1)[0] if "_" in c else "")
         for i, (c, d) in enumerate(canonical.items()) for side, text in enumerate((c, d))],
        "__r int, i int, canonical string, text string, prefix string")
    words = F.when(F.col("__r") % 2 == 0, name_words(F.col("text"), drop)).otherwise(name_words(F.col("text")))
    right = listed.select("__r", "prefix", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    distinct = raw.select("dataset_id", "label").distinct()
    left = distinct.select("label").distinct().select(
        F.col("label").alias("__l"), origin(F.col("label")).alias("prefix"), name_words(F.col("label"), drop).alias("words"))
    found = _scored_names(left, right, ["prefix"]) if every else _similar_names(left, right, mode, threshold, ["prefix"])
    best = found.join(listed.select("__r", "i", "canonical"), "__r").groupBy(F.col("__l").alias("label")).agg(
        F.max(F.struct("score", (-F.col("i")).alias("i"), F.col("canonical").alias("c"))).alias("b"))
    return distinct.join(best, "label", "left").select(
        "dataset_id", "label", F.when(F.col("b.score") >= threshold, F.col("b.c")).alias("canonical"), F.col("b.score").alias("score"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def score_columns(truth: DataFrame, draft: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact, wrong and unresolved columns of a draft; both hold ``(dataset_id, field, column_name)``."""
    key = [*by, "dataset_id", "field"]
    both = truth.select(*key, F.col("column_name").alias("t")).join(
        draft.select(*key, F.col("column_name").alias("d")), key, "left"
    )
    open_ = F.coalesce(F.col("d"), F.lit("")) == ""
    n = F.count(F.lit(1))
    grouped = both.groupBy(*by) if by else both
    return grouped.agg(
        n.alias("total_fields"),
        F.count_if(~open_ & (F.col("d") == F.col("t"))).alias("exact"),
        F.count_if(~open_ & (F.col("d") != F.col("t"))).alias("wrong"),
        F.count_if(open_).alias("unresolved"),
        _ratio(F.count_if(~open_ & (F.col("d") == F.col("t"))), n).alias("accuracy"),
        _ratio(F.count_if(~open_), n).alias("coverage"),
    )


def score_labels(truth: DataFrame, draft: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Correct, wrong, missing, extra, unresolved and prefix-crossing labels of a draft.

    Both hold ``(dataset_id, label, canonical)``; a draft row with a null
    canonical label is unresolved, not a mapping.
    """
    key = [*by, "dataset_id", "label"]
    t = truth.select(*key, F.col("canonical").alias("t"), F.lit(True).alias("in_t"))
    d = draft.select(*key, F.col("canonical").alias("d"), F.lit(True).alias("in_d"))
    both = t.join(d, key, "full_outer")
    in_t, has = F.coalesce(F.col("in_t"), F.lit(False)), F.col("d").isNotNull()
    same = F.col("d") == F.col("t")
    crossed = origin(F.col("label")) != origin(F.col("d"))
    grouped = both.groupBy(*by) if by else both
    return grouped.agg(
        F.count_if(in_t).alias("total_labels"),
        F.count_if(in_t & has & same).alias("correct"),
        F.count_if(in_t & has & ~same).alias("wrong"),
        F.count_if(in_t & ~has).alias("missing"),
        F.count_if(~in_t & has).alias("extra"),
        F.count_if(F.coalesce(F.col("in_d"), F.lit(False)) & ~has).alias("unresolved"),
        F.count_if(in_t & has & ~same & crossed).alias("cross_prefix"),
        _ratio(F.count_if(in_t & has & same), F.count_if(in_t)).alias("accuracy"),
    )


def score_field_sets(
    truth: DataFrame, draft: DataFrame, truth_caps: DataFrame, draft_caps: DataFrame, catalog: DataFrame
) -> DataFrame:
    """Micro precision, recall and F1 of the fields a draft selects per profile.

    Field frames hold ``(profile, field)``, cap frames ``(profile, cap)``,
    ``catalog`` the legal ``field`` list. Only profiles of the truth count; a
    profile matches exactly when its field set and cap are both equal.
    """
    t = truth.select("profile", "field").distinct().withColumn("t", F.lit(1))
    d = draft.select("profile", "field").distinct().withColumn("d", F.lit(1))
    legal = catalog.select("field", F.lit(1).alias("legal")).distinct()
    both = t.join(d, ["profile", "field"], "full_outer").join(legal, "field", "left")
    per = both.groupBy("profile").agg(
        F.count_if(F.col("t").isNotNull() & F.col("d").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("d").isNull()).alias("fn"),
        F.count_if(F.col("d").isNotNull() & F.col("legal").isNull()).alias("illegal"),
    )
    caps = truth_caps.select("profile", F.col("cap").alias("tc")).join(
        draft_caps.select("profile", F.col("cap").alias("dc"), F.lit(1).alias("drafted")), "profile", "left"
    )
    per = caps.join(per, "profile", "left").fillna(0, ["tp", "fp", "fn", "illegal"])
    same_cap = F.col("tc").eqNullSafe(F.col("dc")) & F.col("drafted").isNotNull()
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return per.agg(
        F.count(F.lit(1)).alias("profiles"),
        F.coalesce(F.try_divide(F.count("drafted"), F.count(F.lit(1))), F.lit(0.0)).alias("coverage"),
        F.count_if((F.col("fp") == 0) & (F.col("fn") == 0) & same_cap).alias("exact_profiles"),
        F.count_if(same_cap).alias("cap_matches"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.sum("illegal").alias("illegal_fields"),
    )


_ERRORS = ("cross_prefix", "wrong_column", "wrong_label", "missing_label", "extra_label", "unresolved_label")


def drop_superseded(scores: DataFrame) -> DataFrame:
    """Variant rows go where a current row of the same file name exists."""
    current = scores.filter(~F.col("is_variant")).select("file_name").distinct()
    return scores.join(current.withColumn("__current", F.lit(True)), "file_name", "left").filter(
        ~(F.col("is_variant") & F.col("__current").isNotNull())
    ).drop("__current")


def repeat_summary(scores: DataFrame) -> DataFrame:
    """Per strategy: runs, valid and clean runs, mean accuracies and error sums."""
    z = {e: F.coalesce(F.col(e), F.lit(0)) for e in _ERRORS}
    blocking = z["cross_prefix"] + z["wrong_column"] + z["wrong_label"]
    burden = blocking + z["missing_label"] + z["extra_label"] + z["unresolved_label"]
    sums = []
    for e in _ERRORS[1:]:
        sums += [F.sum(z[e]).alias(f"{e}_sum"), F.avg(z[e]).alias(f"{e}_mean")]
    return scores.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.coalesce("valid", F.lit(False))).alias("valid_runs"),
        F.count_if(burden == 0).alias("clean_runs"),
        F.avg(F.coalesce("label_accuracy", F.lit(0.0))).alias("label_accuracy_mean"),
        F.avg(F.coalesce("column_accuracy", F.lit(0.0))).alias("column_accuracy_mean"),
        F.sum(blocking).alias("blocking_sum"), F.avg(blocking).alias("blocking_mean"),
        F.sum(burden).alias("burden_sum"), F.avg(burden).alias("burden_mean"),
        *sums,
    )


def rank_strategies(scores: DataFrame, valid: str, first: str, second: str, name: str) -> DataFrame:
    """Rank by validity, two qualities and name, all descending, from 1.

    The order is total, so the descending rank is the size minus the ascending
    position. The scores are read once, in ranges of the order.
    """
    keyed = scores.withColumns(
        {
            "__v": F.coalesce(F.col(valid).cast("int"), F.lit(0)),
            "__a": F.coalesce(F.col(first).cast("double"), F.lit(0.0)),
            "__b": F.coalesce(F.col(second).cast("double"), F.lit(0.0)),
        }
    )
    placed = ranked(keyed, [], ["__v", "__a", "__b", name], "__pos", "__n")
    return placed.withColumn("rank", F.col("__n") - F.col("__pos")).drop("__v", "__a", "__b", "__pos", "__n")


def context_profile(
    df: DataFrame, case: str, labels: Mapping[str, str], outcome: str, numeric: Sequence[str], split: str,
    train: str = "train",
) -> DataFrame:
    """Aggregate-only summary of a log as ``(section, name, stat, value)``.

    Holds no rows, ids or times: null rates of every column, label frequencies,
    outcome counts, trace lengths, and count, sum and square sum of numeric
    columns over the train split only.
    """
    text = {f.name: f.dataType.simpleString() for f in df.schema}
    cols = list(df.columns)
    n = F.count(F.lit(1))
    nulls = df.agg(n.alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    missing = nulls.select(
        F.explode(
            F.array(*[
                F.struct(
                    F.lit("column").alias("section"), F.lit(c).alias("name"), F.lit(f"{text[c]}:{stat}").alias("stat"),
                    v.alias("value"),
                )
                for c in cols
                for stat, v in (
                    ("missing", F.col(c).cast("double")), ("total", F.col("__n").cast("double")),
                    ("missing_rate", F.try_divide(F.col(c), F.col("__n"))),
                )
            ])
        ).alias("x")
    ).select("x.*")

    def counts(section: str, col: str) -> DataFrame:
        return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("name")).agg(
            n.cast("double").alias("value")
        ).select(F.lit(section).alias("section"), "name", F.lit("count").alias("stat"), "value")

    lengths = df.groupBy(case).agg(n.alias("len")).agg(
        n.cast("double").alias("case_count"), F.sum("len").cast("double").alias("event_count"),
        F.min("len").cast("double").alias("min"), F.percentile("len", F.lit(0.5)).alias("p50"),
        F.percentile("len", F.lit(0.95)).alias("p95"), F.percentile("len", F.lit(0.98)).alias("p98"),
        F.max("len").cast("double").alias("max"), F.avg("len").alias("mean"),
    )
    length_rows = lengths.unpivot([], lengths.columns, "stat", "value").select(
        F.lit("trace_length").alias("section"), F.lit("events").alias("name"), "stat", "value"
    )
    x = lambda c: F.col(c).cast("double")
    moments = df.filter(F.col(split) == train).agg(
        *[F.struct(F.count(x(c)).cast("double").alias("count"), F.sum(x(c)).alias("sum"),
                   F.sum(x(c) * x(c)).alias("sum_squared")).alias(c) for c in numeric]
    ).select(
        F.explode(
            F.array(*[
                F.struct(F.lit("train_moment").alias("section"), F.lit(c).alias("name"), F.lit(s).alias("stat"),
                         F.col(f"{c}.{s}").alias("value"))
                for c in numeric for s in ("count", "sum", "sum_squared")
            ])
        ).alias("x")
    ).select("x.*").filter("value is not null")
    out = missing.unionByName(length_rows).unionByName(moments).unionByName(counts("outcome", outcome))
    for section, col in labels.items():
        out = out.unionByName(counts(section, col))
    return out


def context_overlap(columns: DataFrame) -> DataFrame:
    """Columns shared by all logs or specific to some; input ``(dataset_id, column_name)``.

    A specific column has one row per log that holds it, a shared one a single row.
    """
    pairs = columns.select("dataset_id", "column_name").distinct()
    total = pairs.agg(F.count_distinct("dataset_id").alias("__all"))
    per = with_scalars(pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_datasets")), total)
    shared = per.filter("n_datasets = __all").select(
        F.lit("shared").alias("scope"), F.lit(None).cast("string").alias("dataset_id"), "column_name"
    )
    own = pairs.join(per.filter("n_datasets < __all"), "column_name").select(
        F.lit("specific").alias("scope"), "dataset_id", "column_name"
    )
    return shared.unionByName(own)


def context_overview(columns: DataFrame, labels: DataFrame, cases: DataFrame) -> DataFrame:
    """Per log: number of columns, activity labels, cases and events."""
    c = columns.groupBy("dataset_id").agg(F.count_distinct("column_name").alias("n_columns"))
    a = labels.groupBy("dataset_id").agg(F.count_distinct("label").alias("n_labels"))
    s = cases.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("n_events").alias("n_events"))
    return c.join(a, "dataset_id", "left").join(s, "dataset_id", "left")


def check_profile(
    fields: DataFrame, caps: DataFrame, catalog: DataFrame, forbidden: DataFrame,
    labels: DataFrame, expected_labels: DataFrame,
) -> DataFrame:
    """Violations of the profile rules as ``(rule, subject)``.

    ``fields`` is ``(profile, field)``, ``caps`` ``(profile, cap)``, the others
    one column each. Labels must equal the expected labels both ways.
    """

    def rows(rule: str, df: DataFrame, subject: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), subject.alias("subject"))

    of_profile = F.concat_ws(".", "profile", "field")
    lab, want = labels.select("label").distinct(), expected_labels.select("label").distinct()
    return (
        rows("unknown_field", fields.distinct().join(catalog.select("field"), "field", "left_anti"), of_profile)
        .unionByName(rows("forbidden_field", fields.distinct().join(forbidden.select("field"), "field", "left_semi"), of_profile))
        .unionByName(rows("cap_not_positive", caps.filter("cap is null or cap <= 0"), F.col("profile")))
        .unionByName(rows("unknown_label", lab.join(want, "label", "left_anti"), F.col("label")))
        .unionByName(rows("missing_label", want.join(lab, "label", "left_anti"), F.col("label")))
    )
