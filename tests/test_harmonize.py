"""Canonical mapping, label maps and draft scoring."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.log import LogSpec
from tracemill.operators import harmonize as H

SPEC = LogSpec(case="case:concept:name", activity="concept:name", lifecycle="lifecycle:transition", ts="time:timestamp", ties=("n",))
COLUMNS = {
    "case_id": "case", "timestamp": "ts", "raw_activity": "activity", "lifecycle": "life", "raw_activity_token": "token",
    "next_activity_raw": "nxt", "resource": "res", "time_delta": "delta", "remaining_time": "rem", "outcome": "outcome",
}


@pytest.fixture(scope="module")
def split_rows(spark):
    t = dt.datetime(2024, 1, 1, 8)
    rows = [
        ("x1", t, "A_Create", "complete", "A_Create+complete", "O_Create+complete", None, 0.0, 1200.0, 2, 1, None, None),
        ("x1", t + dt.timedelta(minutes=10), "O_Create", "complete", "O_Create+complete", "O_Accepted+complete", "u1", 600.0, 600.0, 2, 2, 0.0, 10.0),
        ("x1", t + dt.timedelta(minutes=20), "O_Accepted", "complete", "O_Accepted+complete", "[END]", "nan", 1200.0, 0.0, 2, 3, None, None),
    ]
    return spark.createDataFrame(
        rows, "case string, ts timestamp, activity string, life string, token string, nxt string, res string, delta double, rem double, "
        "outcome int, n int, score double, cost double",
    )


def canon(df, **kw):
    m = H.SourceMapping({**COLUMNS, **kw.pop("columns", {})}, kw.pop("defaults", {}), kw.pop("offers", ()))
    return H.to_canonical(df, LogSpec(case="case", ts="ts", ties=("n",)), m, "ds", F.lit("A"), F.lit("train"))


def test_canonical_events(split_rows):
    out = canon(
        split_rows, columns={"credit_score_value": "score", "monthly_cost_value": "cost"}, defaults={"requested_amount_mask": 0},
        offers=("credit_score_value", "monthly_cost_value"),
    ).orderBy("event_index").collect()
    assert [r.event_index for r in out] == [0, 1, 2]
    assert [r.time_since_previous for r in out] == [0.0, 600.0, 600.0]
    assert [r.resource for r in out] == ["[MISSING]", "u1", "[MISSING]"]
    assert [r.credit_score_value for r in out] == [None, None, None]
    assert [r.offer_feature_mask for r in out] == [0, 1, 0] and [r.offer_present for r in out] == [0, 1, 0]
    assert {r.requested_amount_mask for r in out} == {0} and {r.offered_amount_value for r in out} == {None}


def test_canonical_without_offers_and_case_id(split_rows):
    assert {r.offer_feature_mask for r in canon(split_rows).collect()} == {0}
    with pytest.raises(ValueError, match="case id"):
        H.to_canonical(split_rows, SPEC, H.SourceMapping({"timestamp": "ts"}), "ds", F.lit("A"), F.lit("train"))


def test_label_map_rules(split_rows):
    events = canon(split_rows)
    out = H.apply_label_map(events, {"A_Create": "A_Made", "O_Accepted": "O_Done"}, {"O_Create+complete": "O_Special+x"})
    rows = out.orderBy("event_index").collect()
    # An unmapped label is [OTHER_ACTIVITY] without lifecycle, yet its exact override wins.
    assert [r.canonical_activity_label for r in rows] == ["A_Made", "[OTHER_ACTIVITY]", "O_Done"]
    assert [r.canonical_activity_token for r in rows] == ["A_Made+complete", "O_Special+x", "O_Done+complete"]
    assert [r.next_activity_target for r in rows] == ["O_Special+x", "O_Done+complete", "[END]"]
    plain = H.apply_label_map(events, {"A_Create": "A_Made"}).orderBy("event_index").collect()
    assert [r.canonical_activity_token for r in plain] == ["A_Made+complete", "[OTHER_ACTIVITY]", "[OTHER_ACTIVITY]"]
    report = {r.label: r for r in H.label_map_report(H.apply_label_map(events, {"A_Create": "A_Made"}), {"A_Create": "A_Made"}).collect()}
    assert set(report) == {"O_Create", "O_Accepted"} and report["O_Create"].fallback_count == 2


def test_flatten_last_log_wins_unless_aware():
    maps = {"a": {"X": "A_One"}, "b": {"X": "A_Two"}}
    assert H.flatten_labels(maps) == {"X": "A_Two"}
    assert H.flatten_labels(maps, True) == {"a|X": "A_One", "b|X": "A_Two"}


def test_label_without_lifecycle_and_last_plus(spark):
    from tracemill.functions.labels import after_last, before_last

    df = spark.createDataFrame([("a+b+c",), ("plain",), ("x+",)], "t string")
    got = [(r.a, r.b) for r in df.select(before_last(F.col("t")).alias("a"), after_last(F.col("t")).alias("b")).collect()]
    assert got == [("a+b", "c"), ("plain", None), ("x", "")]


def test_map_checks(spark):
    m = spark.createDataFrame(
        [("A_x", "A_y", False), ("A_x", "O_y", False), ("W_q", "[OTHER_ACTIVITY]", False), ("O_t+s", "W_z+s", True), ("plain", "A_y", False)],
        "raw string, canonical string, is_override boolean")
    allowed = spark.createDataFrame([("A_y",)], "label string")
    got = {(r.raw, r.canonical, r.rule) for r in H.check_label_map(m, allowed).collect()}
    # The reserved token has a prefix of its own, so as a group it breaks both rules.
    assert got == {("A_x", "O_y", "unknown_label"), ("A_x", "O_y", "crossed_prefix"), ("W_q", "[OTHER_ACTIVITY]", "reserved_label"),
                   ("W_q", "[OTHER_ACTIVITY]", "crossed_prefix"), ("O_t+s", "W_z+s", "crossed_prefix")}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("mode, threshold", [("character", 0.5), ("character", 0.72), ("word", 0.4), ("word", 0.72)])
def test_index_finds_what_scoring_all_pairs_finds(spark, mode, threshold):
    rng = random.Random(threshold)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(150)})
    aliases = {f"f{i}": [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(2)] for i in range(40)}

    def score(a, b):
        if mode == "character":
            return 1 - distance(a, b) / max(len(a), len(b))
        x, y = Counter(a.split()), Counter(b.split())
        return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))

    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, position int")
    got = {r.field: (r.column_name, r.score) for r in H.match_columns(df, aliases, threshold, mode).collect()}
    hits = 0
    for f, many in aliases.items():
        best, n = max(((max(score(n, a) for a in many), n) for n in names), key=lambda x: (x[0], -names.index(x[1])))
        assert got[f][0] == (n if best >= threshold else None)
        assert got[f][1] == (pytest.approx(best) if best >= threshold else None)
        hits += best >= threshold
    assert 5 < hits


def test_names_meet_only_on_what_they_share(spark):
    names = spark.createDataFrame([(f"{'xyz'[i % 3]}{i:04d}", i) for i in range(900)], "name string, position int")
    listed = spark.createDataFrame([(0, ["x0000"])], "__r int, words array<string>")
    left = names.select(F.col("name").alias("__l"), H.name_words(F.col("name")).alias("words"))
    assert H._similar_names(left, listed, "character", 0.9).collect() == [("x0000", 0, 1.0)]
    plan = H._similar_names(left, listed, "character", 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (__entry" in plan and "Join Cross" not in plan and "Python" not in plan and "PythonUDF" not in plan
    with pytest.raises(ValueError, match="0.5"):
        H.match_columns(names, {"a": ["b"]}, 0.3)


@pytest.mark.parametrize("mode", ["character", "word"])
def test_match_labels_stays_in_prefix(spark, mode):
    raw = spark.createDataFrame([("d", "A_ACCEPTED"), ("d", "W_Complete application"), ("d", "Q_none"), ("d", "A_ACCEPTED")], "dataset_id string, label string")
    canonical = {"A_Accepted": "application accepted", "O_Accepted": "offer accepted", "W_Complete_application": "complete the application"}
    got = {r.label: r for r in H.match_labels(raw, canonical, mode).collect()}
    assert got["A_ACCEPTED"].canonical == "A_Accepted" and got["A_ACCEPTED"].score == 1.0
    assert got["W_Complete application"].canonical == "W_Complete_application"
    assert got["Q_none"].canonical is None and got["Q_none"].score is None
    with pytest.raises(ValueError, match="unknown similarity"):
        H.match_labels(raw, canonical, "sound")


def test_every_pair_keeps_the_best_score_below_the_threshold(spark):
    names = spark.createDataFrame([("abcd", 1), ("wxyz", 2), ("", 3)], "name string, position int")
    got = {r.field: (r.column_name, r.score) for r in H.match_columns(names, {"f": ["abzz", "qqqq"], "g": ["abcd"], "h": ["1"]}, every=True).collect()}
    # Nothing shared is a score of zero, and the first name keeps it.
    assert got == {"f": (None, 0.5), "g": ("abcd", 1.0), "h": (None, 0.0)}
    raw = spark.createDataFrame([("d", "A_abcd"), ("d", "A_qqqq"), ("d", "B_none")], "dataset_id string, label string")
    got = {r.label: (r.canonical, r.score) for r in H.match_labels(raw, {"A_abzz": "abxx", "O_abcd": "abcd"}, every=True).collect()}
    assert got == {"A_abcd": (None, 0.5), "A_qqqq": (None, 0.0), "B_none": (None, None)}
    with pytest.raises(ValueError, match="characters"):
        H.match_labels(raw, {"A_b": "b"}, "word", every=True)


def test_labels_meet_their_map_where_the_events_are(spark):
    # Three labels over many partitions: a shuffle by label would leave three tasks.
    events = spark.range(30).select(
        F.lit("d").alias("dataset_id"), F.concat(F.lit("A_"), (F.col("id") % 3).cast("string")).alias("raw_activity"), F.lit("x").alias("lifecycle"),
        F.concat(F.lit("A_"), (F.col("id") % 3).cast("string"), F.lit("+x")).alias("raw_activity_token"),
        F.concat(F.lit("A_"), (F.col("id") % 2).cast("string"), F.lit("+x")).alias("next_activity_raw"))
    out = H.apply_label_map(events, {"A_1": "A_one"}, {"A_2+x": "A_two+x"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 4 and "hashpartitioning" not in plan
    assert out.filter("canonical_activity_token = 'A_one+x'").count() == 10 and out.filter("canonical_activity_token = 'A_two+x'").count() == 10


def test_joint_sources(spark):
    a = spark.createDataFrame([("A",), ("B",)], "client_id string")
    joint = H.union_sources({"x": a, "y": a.filter("client_id = 'A'")})
    assert {(r.dataset_id, r.client_id) for r in joint.collect()} == {("x", "x:A"), ("x", "x:B"), ("y", "y:A")}
    assert [r.client_id for r in H.missing_banks(joint, [("x", "A"), ("y", "B")]).collect()] == ["y:B"]


def test_repeat_summary_drops_superseded_variants(spark):
    rows = [("s1", "f1", False, True, 1.0, 1.0, 0, 0, 0, 0, 0, 0), ("s1", "f1", True, True, 0.0, 0.0, 9, 9, 9, 9, 9, 9), ("s2", "f2", True, False, 0.5, None, 1, 0, 2, 3, None, 0)]
    df = spark.createDataFrame(rows, "strategy string, file_name string, is_variant boolean, valid boolean, label_accuracy double, column_accuracy double, "
                               "cross_prefix int, wrong_column int, wrong_label int, missing_label int, extra_label int, unresolved_label int")
    got = {r.strategy: r for r in H.repeat_summary(H.drop_superseded(df)).collect()}
    assert got["s1"].runs == 1 and got["s1"].clean_runs == 1 and got["s1"].burden_sum == 0
    assert got["s2"].blocking_sum == 3 and got["s2"].burden_sum == 6 and got["s2"].column_accuracy_mean == 0.0
