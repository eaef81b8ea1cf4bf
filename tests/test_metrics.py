"""Metrics against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import metrics as M


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(1)
    n = 240
    y, p = rng.integers(0, 3, n), rng.integers(0, 3, n)
    probs = np.round(rng.dirichlet(np.ones(3), n), 1)
    return [(f"b{i % 3}", int(y[i]), int(p[i]), [float(v) for v in probs[i]], int(rng.random() < 0.7)) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark, arrays):
    return spark.createDataFrame(arrays, "client_id string, y int, p int, probs array<double>, mask int")


def f1s(pairs, classes):
    out = {}
    for c in classes:
        tp = sum(a == b == c for a, b in pairs)
        prd, sup = sum(b == c for _, b in pairs), sum(a == c for a, _ in pairs)
        out[c] = (2 * tp / (prd + sup) if prd + sup else 0.0, tp / sup if sup else 0.0, sup)
    return out


def test_headline_and_owner_slices(frame, arrays):
    got = {r.client_id: r for r in M.metrics_by_owner(frame, "y", "p", 3).collect()}
    assert set(got) == {"b0", "b1", "b2", "pooled"}
    for owner, r in got.items():
        pairs = [(a[1], a[2]) for a in arrays if owner in (a[0], "pooled")]
        want = f1s(pairs, range(3))
        assert r.accuracy == pytest.approx(np.mean([a == b for a, b in pairs]))
        assert r.macro_f1 == pytest.approx(np.mean([w[0] for w in want.values()]))
        assert r.weighted_f1 == pytest.approx(sum(w[0] * w[2] for w in want.values()) / len(pairs))
        assert r.balanced_accuracy == pytest.approx(np.mean([w[1] for w in want.values() if w[2]]))
    cells = M.confusion_counts(frame, "y", "p", ["client_id"])
    pooled = M.pooled_confusion(cells, "client_id").groupBy("client_id").agg(F.sum("n").alias("n"))
    n = {r.client_id: r.n for r in pooled.collect()}
    assert n["pooled"] == n["b0"] + n["b1"] + n["b2"] == 240


def test_confusion_is_dense(frame):
    one = frame.filter("y = 0 and p = 1")
    rows = {(r.y, r.p): r.n for r in M.confusion(one, "y", "p", 3).collect()}
    assert len(rows) == 9 and rows[(0, 1)] > 0 and rows[(2, 2)] == 0


def test_auc_equals_pair_counting(frame, arrays):
    got = {r.class_id: r.auc for r in M.class_auc(frame, "y", "probs", 3).collect()}
    for c in range(3):
        pos = [a[3][c] for a in arrays if a[1] == c]
        neg = [a[3][c] for a in arrays if a[1] != c]
        assert got[c] == pytest.approx(np.mean([(x > z) + 0.5 * (x == z) for x in pos for z in neg]))
    assert M.macro_auc(frame, "y", "probs", 3).first()[0] == pytest.approx(np.mean(list(got.values())))
    assert M.macro_auc(frame.filter("y < 2"), "y", "probs", 3).first()[0] is None


def test_next_label_metrics_use_observed_labels(spark):
    df = spark.createDataFrame([(5, 5, [5, 1, 2], 1), (7, 1, [1, 7, 2], 1), (9, 9, [9, 0, 1], 0)], "y int, p int, top array<int>, mask int")
    r = M.next_label_metrics(df, "y", "p", "top", "mask").first()
    assert (r.n, r.top1_accuracy, r.top3_accuracy) == (2, 0.5, 1.0)
    assert r.macro_f1 == pytest.approx(1 / 3) and r.weighted_f1 == 0.5
    empty = M.next_label_metrics(df.withColumn("mask", F.lit(0)), "y", "p", "top", "mask").first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0, 0.0)


def test_duration_metrics_clamp(spark):
    df = spark.createDataFrame([(10.0, -5.0, 1), (0.0, 4.0, 1), (9.0, 0.0, 0)], "t double, p double, m int")
    r = M.duration_metrics(df, "t", "p", "m").first()
    assert (r.n, r.mae) == (2, 7.0) and r.rmse == pytest.approx(np.sqrt((100 + 16) / 2))
    assert tuple(M.duration_metrics(df.filter("m = 0"), "t", "p", "m").first()) == (0, 0.0, 0.0)
    d = M.prediction_diagnostics(df, "p", "m").first()
    assert (d.pred_mean_seconds, d.pred_median_seconds, d.percent_clamped_to_zero) == (2.0, 2.0, 50.0)


def test_scores_to_predictions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [0.1, 0.4, 0.4, 0.9], -2.0)], "o array<double>, n array<double>, u double")
    r = M.prediction_frame(df, "o", "n", "u").first()
    assert r.outcome_pred == 1 and r.next_pred == 3 and r.next_top3 == [3, 1, 2]
    e = np.exp([1.0, 3.0, 3.0])
    assert r.outcome_probs == pytest.approx(list(e / e.sum()))
    assert (r.remaining_pred_raw, r.remaining_pred_clamped) == (-2.0, 0.0)


def test_prefix_buckets_keep_empty(spark):
    df = spark.createDataFrame([(1, 0, 0, 5.0, 7.0, 1), (3, 1, 0, 5.0, 5.0, 0), (12, 2, 2, 1.0, 2.0, 1), (25, 1, 1, 4.0, 0.0, 1)],
                               "prefix_length int, y int, p int, t double, s double, m int")
    got = {r.bucket: r for r in M.metrics_by_prefix_bucket(df, "y", "p", 3, "t", "s", "m").collect()}
    assert {b: r.n for b, r in got.items()} == {"1": 1, "2-5": 1, "6-10": 0, "11-20": 1, "21+": 1}
    assert got["1"].mae == 2.0 and got["2-5"].mae == 0.0 and got["21+"].mae == 4.0 and got["6-10"].accuracy is None
    assert M.metrics_by_prefix_bucket(df, "y", "p", 3, "t", "s", "m", keep_empty=False).count() == 4


def test_final_prefixes(spark):
    events = spark.createDataFrame([("d", "short")] * 2 + [("d", "long")] * 9, "dataset_id string, case_id string")
    pred = spark.createDataFrame(
        [("d", "short", 0, 0, 0), ("d", "short", 1, 0, 1), ("d", "long", 0, 1, 1), ("d", "long", 1, 1, 0), ("d", "long", 2, 2, 2)],
        "dataset_id string, case_id string, label_pos int, y int, p int")
    marked = M.mark_final_prefix(pred, events)
    flags = {(r.case_id, r.label_pos): r.is_final for r in marked.collect()}
    assert [k for k, v in flags.items() if v] == [("short", 1)]
    r = M.final_prefix_inflation(marked, "y", "p", 3).collect()
    assert len(r) == 1 and (r[0].n_final, r[0].final_accuracy) == (1, 0.0) and r[0].macro_f1_inflation < 0
    none = M.final_prefix_inflation(marked.filter("not is_final"), "y", "p", 3).first()
    assert none.n_final == 0 and none.macro_f1_inflation is None and none.final_accuracy is None
    with pytest.raises(Exception, match="no event count"):
        M.mark_final_prefix(pred, events.filter("case_id = 'long'")).collect()


def test_sign_agreement(spark):
    rows = [("s", "a", 0.60347934, 0.59265940), ("s", "b", 0.59, 0.5930), ("s", "c", 0.5, 0.4), ("s", "d", 0.7, None)]
    df = spark.createDataFrame(rows, "split string, run string, raw double, cor double")
    pairs = M.run_pairs(df, ["split"], "run", "raw", "cor")
    assert pairs.count() == 3
    flip = pairs.filter("not sign_kept").first()
    assert (flip.left_run, flip.right_run) == ("a", "b")
    assert tuple(M.sign_agreement(df, ["split"], "run", "raw", "cor").first()) == (3, 2, 1)


@pytest.mark.parametrize("levels", [2, 5, 40])
def test_sign_agreement_equals_all_pairs_with_ties(spark, levels):
    rng = np.random.default_rng(levels)
    rows = [(s, f"r{i:03d}", float(rng.integers(levels)) if rng.random() > 0.05 else None,
             float(rng.integers(levels)) if rng.random() > 0.1 else None) for s in ("a", "b|", "|b") for i in range(90)]
    df = spark.createDataFrame(rows, "split string, run string, raw double, cor double")
    pairs = M.run_pairs(df, ["split"], "run", "raw", "cor")
    want = pairs.agg(F.count(F.lit(1)), F.count_if("sign_kept"), F.count_if(~F.col("sign_kept"))).first()
    assert tuple(M.sign_agreement(df, ["split"], "run", "raw", "cor").first()) == tuple(want)
    assert tuple(M.sign_agreement(df.limit(0), ["split"], "run", "raw", "cor").first()) == (0, 0, 0)


def test_sign_agreement_of_one_large_split(spark):
    rng = np.random.default_rng(2)
    n = 100_000
    raw, cor = rng.permutation(n), rng.permutation(n) // 3
    df = spark.createDataFrame([("s", f"{i:06d}", float(raw[i]), float(cor[i])) for i in range(n)],
                               "split string, run string, raw double, cor double")
    # By merging: flips are inversions of (cor, label) in the order of (raw, label).
    order = np.lexsort((np.arange(n), cor))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    seq, flips = place[np.argsort(raw)], 0
    width = 1
    while width < n:
        for s in range(0, n, 2 * width):
            left, right = np.sort(seq[s:s + width]), seq[s + width:s + 2 * width]
            flips += len(left) * len(right) - int(np.searchsorted(left, right).sum())
        width *= 2
    total = n * (n - 1) // 2
    assert tuple(M.sign_agreement(df, ["split"], "run", "raw", "cor").first()) == (total, total - flips, flips)


def test_auc_of_a_million_close_scores_spreads_evenly(spark):
    df = spark.range(1_000_000).select((F.rand(3) * 0.0025).alias("s"), (F.col("id") % 2).cast("int").alias("y")).select(
        "y", F.array(F.lit(1.0) - F.col("s"), F.col("s")).alias("p"))
    from tracemill.functions.ordered import ranged

    scores = df.select(F.lit(1).alias("class_id"), F.col("p")[1].alias("score"))
    sizes = sorted(r["count"] for r in ranged(scores, ["class_id"], ["score"]).groupBy("__part").count().collect())
    assert len(sizes) > 2 and max(sizes) < 2 * sizes[len(sizes) // 2]
    assert M.macro_auc(df, "y", "p", 2).first()[0] == pytest.approx(0.5, abs=0.002)



def test_owner_lookup_fails_on_unknown(spark):
    owners = spark.createDataFrame([("d", "c1", "A")], "dataset_id string, case_id string, client_id string")
    pred = spark.createDataFrame([("d", "c1"), ("d", "c9")], "dataset_id string, case_id string")
    assert M.owner_lookup(pred.filter("case_id = 'c1'"), owners).first().client_id == "A"
    with pytest.raises(Exception, match="without an owner"):
        M.owner_lookup(pred, owners).collect()


def test_distribution_ignores_infinite(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("inf"),), (float("nan"),), (None,)], "x double")
    r = M.distribution_summary(df, "x").first()
    assert (r["count"], r.mean, r.median) == (2, 2.0, 2.0)
    assert tuple(M.distribution_summary(df.filter("x is null"), "x").first()) == (0, 0, 0, 0, 0, 0, 0)


def test_masked_means(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (3.0, 9.0, 0)], "a double, b double, m int")
    r = M.masked_means(df, {"a": (None, 1.0), "b": ("m", 0.5)}).first()
    assert (r.mean_a, r.mean_b, r.weighted_total) == (2.0, 2.0, 3.0)
