"""Encoding fits, prefixes, targets and their additive counterparts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions.ordered import Whole, over_trace
from tracemill.log import LogSpec
from tracemill.operators import additive as A
from tracemill.operators import encode as V
from tracemill.session import settle

KEYS = ["dataset_id", "client_id", "split", "case_id"]
FIELDS = {"token": V.reserved_tokens(activity=True), "target": V.reserved_tokens(target=True), "resource": V.reserved_tokens()}
NUMERIC = {"delta": None, "amount": "amount_mask", "weekday_sin": None}


@pytest.fixture(scope="module")
def events(spark):
    rows = []

    def case(client, split, cid, tokens, amount, outcome):
        n = len(tokens)
        for i, t in enumerate(tokens):
            nxt = tokens[i + 1] if i + 1 < n else "[END]"
            rows.append(("ds", client, split, cid, i, t, nxt, f"u{i}" if i else None, 60.0 * i, amount, 0 if amount is None else 1,
                         0.5, outcome, 60.0 * (n - 1 - i)))

    case("A", "train", "c1", ["a+s", "b+s", "a+s", "z+s"], 10.0, 2)
    case("A", "train", "c2", ["b+s", "z+s"], None, 1)
    case("B", "train", "c3", ["a+s", "a+s", "z+s"], 30.0, 0)
    case("B", "val", "c4", ["a+s", "new+s", "z+s"], 99.0, 2)
    df = spark.createDataFrame(
        rows, "dataset_id string, client_id string, split string, case_id string, event_index long, token string, target string, "
        "resource string, delta double, amount double, amount_mask int, weekday_sin double, outcome int, remaining_time double",
    )
    spec = LogSpec(ts="event_index", ties=(), activity="token")
    return over_trace(df, spec, [Whole("n_events", F.lit(1).cast("long"), "sum")], KEYS)


@pytest.fixture(scope="module")
def train(events):
    return events.filter("split = 'train'")


def ids(vocab, field):
    return {r.token: r.id for r in vocab.filter(F.col("field") == field).collect()}


def test_vocabulary_is_train_only_and_ordered(train):
    v = V.fit_vocab(train, FIELDS)
    assert ids(v, "token") == {"[PAD]": 0, "[UNK]": 1, "[MISSING]": 2, "[OTHER_ACTIVITY]": 3, "a+s": 4, "b+s": 5, "z+s": 6}
    assert ids(v, "target") == {"[PAD]": 0, "[UNK]": 1, "[MISSING]": 2, "[OTHER_ACTIVITY]": 3, "[END]": 4, "a+s": 5, "b+s": 6, "z+s": 7}
    assert ids(v, "resource") == {"[PAD]": 0, "[UNK]": 1, "[MISSING]": 2, "u1": 3, "u2": 4, "u3": 5}


def test_encode_unseen_is_unknown(events, train):
    v = V.fit_vocab(train, FIELDS)
    out = V.encode(events.filter("case_id = 'c4'"), v, ["token", "resource"]).orderBy("event_index").collect()
    assert [r.token_id for r in out] == [4, 1, 6] and [r.resource_id for r in out] == [2, 3, 4]


def test_few_tokens_of_a_large_vocabulary_are_not_few_tasks(spark, events, train, monkeypatch):
    v, kept = settle(V.fit_vocab(train, FIELDS)), settle(events)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString()
    read = lambda df, *cols: sorted(df.select("case_id", *cols).collect())

    def both():
        enc = V.encode(kept, v, ["token", "resource"])
        return enc, V.prefix_labels(kept, KEYS, "event_index", "n_events", None, "target", "remaining_time", "outcome", v, "target")

    try:
        # A vocabulary above the limit of broadcasts, as many resources make it.
        spark.conf.set(key, "-1")
        enc, labels = both()
        assert joins(enc).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in joins(enc)
        assert "BroadcastHashJoin" in joins(labels) and "SortMergeJoin" not in joins(labels)
        # More resources than the limit: that field alone is dealt by its tokens.
        monkeypatch.setattr(V, "SMALL_FIELD", 7)
        wider = v.unionByName(spark.range(100, 103).select(F.lit("resource").alias("field"), F.col("id").cast("string").alias("token"), "id"))
        dealt = V.encode(kept, wider, ["token", "resource"])
        assert joins(dealt).count("BroadcastHashJoin") == 1 and joins(dealt).count("SortMergeJoin") == 1
        cols = ("event_index", "token_id", "resource_id")
        assert read(dealt, *cols) == read(enc, *cols) and dealt.count() == events.count()
    finally:
        spark.conf.set(key, before)


def test_scaler_masks_and_identity(train):
    s = {r.field: (r["mean"], r["std"]) for r in V.fit_scaler(train, NUMERIC).collect()}
    deltas = [0, 60, 120, 180, 0, 60, 0, 60, 120]
    assert s["delta"] == pytest.approx((np.mean(deltas), np.std(deltas)))
    amounts = [10.0] * 4 + [30.0] * 3
    assert s["amount"] == pytest.approx((np.mean(amounts), np.std(amounts)))
    assert s["weekday_sin"] == (0.0, 1.0)
    empty = V.fit_scaler(train.filter("1 = 0"), {"delta": None}).first()
    assert (empty["mean"], empty["std"]) == (0.0, 1.0)
    same = V.fit_scaler(train.filter("case_id = 'c3'"), {"amount": None}).first()
    assert (same["mean"], same["std"]) == (30.0, 1.0)


def test_scale_null_is_zero(events, train):
    s = V.fit_scaler(train, NUMERIC)
    out = V.scale(events, s, ["amount"])
    assert {r.amount_scaled for r in out.filter("amount is null").collect()} == {0.0}


def test_prefix_index_keeps_events_beyond_the_cap(events):
    rows = V.prefix_index(events, KEYS, 3).filter("case_id = 'c1'").orderBy("prefix_length").collect()
    assert [(r.prefix_length, r.label_pos, r.n_events) for r in rows] == [(1, 0, 4), (2, 1, 4), (3, 2, 4)]
    assert V.prefix_index(events, KEYS, None).count() == 12
    total = V.prefix_counts(events, 3).filter("client_id is null").first()
    assert (total.cases, total.events, total.prefixes, total.max_length) == (4, 12, 11, 4)


def test_prefix_arrays_pad_and_cap(events, train):
    v, s = V.fit_vocab(train, FIELDS), V.fit_scaler(train, NUMERIC)
    enc = V.scale(V.encode(events, v, ["token"]), s, ["weekday_sin"])
    out = V.prefix_arrays(enc, KEYS, "event_index", ["token_id"], ["weekday_sin_scaled"], 3).filter("case_id = 'c1'").orderBy("prefix_length").collect()
    assert [r.token_id for r in out] == [[4, 0, 0], [4, 5, 0], [4, 5, 4]]
    assert [r.padding_mask for r in out] == [[1, 0, 0], [1, 1, 0], [1, 1, 1]]
    assert out[0].weekday_sin_scaled == [0.5, 0.0, 0.0]
    wide = V.prefix_arrays(enc, KEYS, "event_index", ["token_id"], [], 2_000).filter("case_id = 'c1'").first()
    assert len(wide.token_id) == 2_000
    # Without a cap, labels and counts take all prefixes.
    assert V.prefix_counts(events, None).filter("client_id is null").first().prefixes == 12
    none = V.prefix_state_arrays(enc.withColumn("p", F.lit(1)), KEYS, "event_index", [], "p", 2).first()
    assert none.state_mask == [0, 0]


def test_labels_mask_unseen_targets_and_last_events(events, train):
    v = V.fit_vocab(train, FIELDS)
    out = V.prefix_labels(events, KEYS, "event_index", "n_events", 3, "target", "remaining_time", "outcome", v, "target")
    c4 = {r.prefix_length: r for r in out.filter("case_id = 'c4'").collect()}
    assert [c4[k].next_mask for k in (1, 2, 3)] == [0, 1, 1] and c4[1].next_label == 1
    assert [c4[k].remaining_mask for k in (1, 2, 3)] == [1, 1, 0]
    c1 = {r.prefix_length: r.remaining_mask for r in out.filter("case_id = 'c1'").collect()}
    assert c1 == {1: 1, 2: 1, 3: 1}  # the last event lies beyond the cap


VALUES = [0.0, 5.0, 60.0, 60.0, 3600.0, 86400.0, 12.5]


@pytest.mark.parametrize("transform", ["raw", "log"])
@pytest.mark.parametrize("scaling", ["raw", "median", "zscore"])
def test_target_round_trip(spark, transform, scaling):
    df = spark.createDataFrame([(v,) for v in VALUES], "seconds double")
    t = V.fit_target(df, transform, scaling)
    p = t.first()
    pos = np.array(sorted(v for v in VALUES if v > 0))
    tr = np.log1p(pos) if transform == "log" else pos
    med = tr[(len(tr) - 1) // 2]
    want = {"raw": (0.0, 1.0), "median": (0.0, max(med, 1.0)), "zscore": (tr.mean(), tr.std())}[scaling]
    assert (p.center, p["scale"]) == pytest.approx(want) and p.n_values == len(pos)
    assert p.median_seconds == pytest.approx(0.0 if scaling == "zscore" else pos[(len(pos) - 1) // 2])
    back = V.inverse_target(V.transform_target(df, t, "seconds", "units"), t, "units", "again").collect()
    assert [r.again for r in back] == pytest.approx(VALUES)


def test_target_failures(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,)], "seconds double")
    with pytest.raises(Exception, match="negative"):
        V.fit_target(df).collect()
    with pytest.raises(ValueError, match="unknown transform"):
        V.fit_target(df, "sqrt")
    empty = V.fit_target(df.filter("seconds > 9")).first()
    assert (empty.center, empty["scale"], empty.n_values) == (0.0, 1.0, 0)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(2,)], "y int")
    assert [r.weight for r in V.class_weights(df, "y", 3).orderBy("class_id").collect()] == pytest.approx([10 / 18, 10 / 9, 10 / 3])
    assert {r.weight for r in V.class_weights(df, "y", 3, 0.0).collect()} == {1.0}
    with pytest.raises(Exception, match="absent"):
        V.class_weights(df.filter("y < 2"), "y", 3).collect()


def test_mask_scores_leave_rows_without_target(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0], 1), ("a", [1.0, 2.0, 3.0], 0)], "dataset_id string, scores array<double>, ok int")
    support = spark.createDataFrame([("a", [1, 0, 2])], "dataset_id string, support array<bigint>")
    got = [r.scores for r in V.mask_scores(df, "scores", support, valid="ok").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [[1.0, None, 3.0], [1.0, 2.0, 3.0]]))


def test_additive_equals_central(events, train):
    stats = A.local_stats(events, 3, list(FIELDS), NUMERIC)
    tokens = {r.key for r in stats.filter("family = 'tokens' and field = 'token'").collect()}
    assert "new+s" not in tokens and "a+s" in tokens
    merged = A.merge_stats(stats)
    for got, want in (
        (A.vocab_from_counts(merged, FIELDS), V.fit_vocab(train, FIELDS)),
        (A.scaler_from_moments(merged), V.fit_scaler(train, NUMERIC)),
    ):
        a = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got.collect())
        b = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want.collect())
        assert a == b
    pop = V.target_population(events, "event_index", "n_events", 3, "remaining_time")
    a, b = A.target_from_moments(merged, "raw", "zscore").first(), V.fit_target(pop, "raw", "zscore").first()
    assert (a.center, a["scale"], a.n_values) == pytest.approx((b.center, b["scale"], b.n_values))
    assert all(r.matches for r in A.compare_stats(merged, A.merge_stats(stats)).collect())
    assert A.differences(merged, A.merge_stats(A.local_stats(events, 2, list(FIELDS), NUMERIC))).count() > 0
    with pytest.raises(ValueError, match="median"):
        A.target_from_moments(merged, "raw", "median")
    with pytest.raises(Exception, match="mixed target"):
        A.target_from_moments(merged, "log", "zscore").collect()


def test_merged_record_equals_the_central_one(events, train):
    stats = A.local_stats(events, 3, list(FIELDS), NUMERIC)
    merged = A.merge_stats(stats, "client_id")
    mine = {(r.client_id, r.field): r.value for r in merged.filter("family = 'counts'").collect()}
    assert mine["A", "cases"] == 2 and mine["B", "events"] == 6 and mine[None, "cases"] == 4 and mine[None, "max_length"] == 4
    assert merged.filter("client_id is not null and family <> 'counts'").count() == 0
    target = V.fit_target(V.target_population(events, "event_index", "n_events", 3, "remaining_time"), "raw", "zscore")
    fits = (V.train_outcome_counts(events), V.fit_vocab(train, FIELDS), V.fit_scaler(train, NUMERIC), target)
    central = A.metadata_record(V.prefix_counts(events, 3), *fits, 3)
    record = A.merged_metadata(merged, FIELDS, 3, "raw", "zscore")
    checks = A.compare_metadata(record, central)
    assert [r.family for r in checks.orderBy("family").collect()] == list(A.FAMILIES)
    assert tuple(A.metadata_verdict(checks).first()) == (True, [])
    capped = A.compare_metadata(record, A.metadata_record(V.prefix_counts(events, 2), *fits, 2))
    assert tuple(A.metadata_verdict(capped).first()) == (False, ["counts", "per_bank_counts", "prefix"])
    # Tolerance is for real numbers only; entries of one side and repeated ones differ.
    big = central.withColumn("value", F.when(F.col("family") == "counts", 1e12).otherwise(F.col("value")))
    off = big.withColumn("value", F.when(F.col("family").isin("counts", "scalers"), F.col("value") + 1e-10 * F.abs("value")).otherwise(F.col("value")))
    off = off.withColumn("value", F.when(F.col("family") == "counts", F.col("value") + 1).otherwise(F.col("value")))
    less = off.filter("family <> 'target' or key <> 'transform'").unionByName(off.filter("family = 'outcomes'"))
    assert tuple(A.metadata_verdict(A.compare_metadata(big, less)).first()) == (False, ["counts", "outcomes", "target"])
    assert A.compare_metadata(central.limit(0), central.limit(0)).filter("matches and n_entries = 0").count() == 7
    with pytest.raises(Exception, match="no name"):
        A.merge_stats(stats.withColumn("client_id", F.lit(None).cast("string")), "client_id").collect()


def test_vector_means(spark):
    df = spark.createDataFrame([("g", [1.0, 10.0], 1, [1.0, 0.0]), ("g", [3.0, 20.0], 3, [1.0, 0.0])], "g string, v array<double>, w int, c array<double>")
    mean = lambda mode: A.group_weighted_vector_mean(df, ["g"], "v", "w", mode, "c").first()["mean"]
    assert mean("sample") == [2.5, 17.5] and mean("equal") == [2.0, 15.0] and mean("contribution") == [2.0, 17.5]
    bad = df.withColumn("v", F.when(F.col("w") == 1, F.array(F.lit(1.0))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="unequal"):
        A.group_weighted_vector_mean(bad, ["g"], "v", "w").collect()
    with pytest.raises(Exception, match="not positive"):
        A.group_weighted_vector_mean(df.withColumn("w", F.lit(0)), ["g"], "v", "w").collect()


def test_identity_depends_on_content_not_order(events):
    a = V.encoding_identity({"e": events}, {"cap": 3}).first()[0]
    assert a == V.encoding_identity({"e": events.orderBy(F.desc("event_index"))}, {"cap": 3}).first()[0]
    assert a != V.encoding_identity({"e": events}, {"cap": 4}).first()[0]
    assert a != V.encoding_identity({"e": events.filter("case_id <> 'c2'")}, {"cap": 3}).first()[0]


def test_tables_kept_for_a_session_are_cut_finer_than_its_shuffles(spark, tmp_path):
    from queries import encoding_queries as E

    own = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = [spark.conf.get(k, None) for k in own]
    # About 40 MB that do not pack, through a session of 4 shuffle partitions.
    wide = spark.range(1_000_000).select("id", F.md5(F.col("id").cast("string")).alias("a"))
    kept = E._once(spark, str(tmp_path), "wide", lambda: wide.repartition("id"))
    rows = [r.n for r in kept.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(rows) > 4 and max(rows) < 250_000 and sum(rows) == 1_000_000
    assert [spark.conf.get(k, None) for k in own] == before


def test_fine_shuffles_keep_what_the_session_names(spark):
    from tracemill.session import fine_shuffles

    size, pieces = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(size, "1m")
    try:
        with fine_shuffles(spark):
            assert spark.conf.get(size) == "1m" and int(spark.conf.get(pieces)) >= 400
            with fine_shuffles(spark):
                pass
            assert spark.conf.get(pieces, None) is not None
        assert spark.conf.get(size) == "1m" and spark.conf.get(pieces, None) is None
    finally:
        spark.conf.unset(size)
