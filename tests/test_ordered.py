"""The two-level path must equal the plain window for every feature."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions.ordered import (
    Following, Latest, Position, Preceding, Running, Whole, over_trace, ranged, ranked,
)
from tracemill.functions.quantiles import banded, describe, order_image, quantiles
from tracemill.log import LogSpec, measure_hot

def features():
    return [
        Position("pos"),
        Following("nxt", F.col("v"), None),
        Following("nxt_end", F.col("label"), "[END]"),
        Preceding("prev", F.col("v")),
        Latest("state", F.col("m") == 1, F.struct("v", "label")),
        Running("run", F.col("w")),
        Whole("total", F.col("w"), "sum"),
        Whole("first_ts", F.col("ts"), "min"),
        Whole("n", F.col("v"), "count"),
    ]


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        # One case holds a third of the rows; times tie often.
        case = "hot" if i % 3 == 0 else f"c{rng.randrange(40)}"
        v = None if rng.random() < 0.2 else rng.randrange(9)
        rows.append((case, rng.randrange(60), i, v, f"a{rng.randrange(4)}", int(rng.random() < 0.3), rng.randrange(5)))
    return spark.createDataFrame(
        rows, "case_id string, t long, seq long, v int, label string, m int, w long"
    ).withColumn("ts", F.timestamp_seconds("t"))


@pytest.mark.parametrize("hot_rows", [5, 20, 150])
def test_hot_cases_equal_plain_window(log, hot_rows):
    spec = LogSpec(lifecycle=None, activity="label")
    hot = measure_hot(log, spec, hot_rows)
    assert hot.hot is not None
    assert measure_hot(log, spec).hot is None
    plain = over_trace(log, spec, features())
    cut = over_trace(log, hot, features())
    assert plain.columns == cut.columns
    a, b = sorted(map(str, plain.collect())), sorted(map(str, cut.collect()))
    assert a == b and len(a) == 600


def texts(df):
    """Rows as sorted text; sums in another order may differ in the last digits."""
    rows = df.select(*sorted(df.columns)).collect()
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


def test_trace_operators_on_hot_cases(log):
    from tracemill.operators import profile as Q
    from tracemill.operators import trace as T
    from tracemill.plans.preparation import labelled_events

    spec = LogSpec(lifecycle=None, activity="label")
    hot = measure_hot(log, spec, 10)
    d = {"a0": 2, "a1": 1}
    for op in (
        lambda s: T.outcome_table(log, s, d),
        lambda s: T.cut_at_decision(log, s, d),
        lambda s: T.next_activity(log, s, "label"),
        lambda s: T.carry_state(log.withColumn("v", F.col("v").cast("double")), s, "m", ["v"]),
        lambda s: T.time_since_previous(log, s),
        lambda s: T.remaining_and_elapsed(log, s),
        lambda s: T.case_table(log, s, {"v": "v"}, d),
        lambda s: T.cut_report(log, s, d),
        lambda s: T.event_position(log, s),
        lambda s: Q.prefix_cap(log, s, d, "label", 0.5),
        lambda s: Q.relative_order(log, s, ["a0"], ["a1", "a2"]),
        lambda s: Q.first_present_position(log, s, ["v"]),
        lambda s: labelled_events(log, s, d, "label", "label"),
        lambda s: T.check_events(log, ["case_id"], "v", "m", [], s),
    ):
        a, b = op(spec), op(hot)
        assert texts(a) == texts(b)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 101, 1000):
        xs = np.round(rng.normal(0, 500, n), 1)
        df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
        ps = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.98, "e": 1.0}
        got = quantiles(df, F.col("x"), ps).first()
        for k, p in ps.items():
            assert got[k] == pytest.approx(np.quantile(xs, p), abs=1e-9)
        assert quantiles(df, F.col("x"), {"m": 0.5}, lower=True).first()["m"] == np.sort(xs)[(n - 1) // 2]


def test_quantiles_by_group_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", -2.0)], "g string, x double")
    got = {r["g"]: r["m"] for r in quantiles(df, F.col("x"), {"m": 0.5}, ["g"]).collect()}
    assert got == {"a": 2.0, "b": -2.0}
    assert quantiles(df.filter("x > 9"), F.col("x"), {"m": 0.5}).first()["m"] is None
    row = describe(df.filter("x > 9"), F.col("x")).first()
    assert row["n"] == 0 and row["p50"] is None


def sizes_of(placed):
    return sorted(r["count"] for r in placed.groupBy("__part").count().collect())


@pytest.mark.parametrize("values", [
    [f"User_{i:06d}" for i in range(20_000)], [f"{i:08d}" for i in range(20_000)], ["same"] * 50 + [f"same{i}" for i in range(20_000)],
])
@pytest.mark.parametrize("key", ["k", None])
def test_ranges_are_even_and_ranks_right(spark, values, key):
    # A small second key beside a hot or null one.
    rows = [(key, v, i) for i, v in enumerate(values)] + [("z", "a", -1), ("z", "b", -2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, v string, i int")
    got = {r.i: (r.pos, r.n) for r in ranked(df, ["key"], ["v", "i"], "pos", "n", 20).collect()}
    want = {i: (n, len(values)) for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert got == {**want, -1: (0, 2), -2: (1, 2)}
    # Ranges follow the number asked for, not the keys; no row is compared with an edge.
    sizes = sizes_of(ranged(df, ["key"], ["v", "i"], 20))
    assert len(sizes) > 15 and max(sizes) < 2 * sizes[len(sizes) // 2]
    assert len(sizes_of(ranged(df, ["key"], ["v", "i"], 60))) > 45


def test_ranges_of_one_start_day_and_nulls(spark):
    df = spark.range(5000).select(
        F.lit("bank").alias("bank"), F.timestamp_micros(F.lit(10**15) + F.col("id") % 100).alias("start_time"), F.col("id").alias("case_id"))
    assert max(sizes_of(ranged(df, ["bank"], ["start_time", "case_id"], 20))) < 2 * 250
    holes = df.withColumn("start_time", F.when(F.col("case_id") % 2 == 0, F.col("start_time")))
    got = [r["case_id"] for r in ranked(holes, ["bank"], ["start_time", "case_id"], "pos", None, 7).orderBy("pos").collect()]
    assert got == [*range(1, 5000, 2), *sorted(range(0, 5000, 2), key=lambda i: (i % 100, i))]
    assert ranked(df.limit(0), ["bank"], ["case_id"], "pos", "n").count() == 0


def test_order_image_equals_the_bits_of_a_double(spark):
    rng = np.random.default_rng(11)
    bits = rng.integers(0, 2047 << 52, 4000)
    xs = np.concatenate([bits.view(np.float64), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1021, 1024), 0),
                         [0.0, 1.0, np.inf, 5e-324, np.pi, 0.0025]])
    df = spark.createDataFrame([(float(x),) for x in np.concatenate([xs, -xs])] + [(None,), (float("nan"),)], "x double")
    for r in df.select("x", order_image(F.col("x")).alias("v")).collect():
        if r["x"] is None or r["x"] != r["x"]:
            assert r["v"] is None
        else:
            want = int(np.abs(np.float64(r["x"])).view(np.int64))
            assert r["v"] == (-want if r["x"] < 0 else want), r["x"]


@pytest.mark.parametrize("low, high", [(0.0, 0.0025), (1.7e9, 1.7e9 + 365 * 86400), (-1e-300, 1e-300)])
def test_quantiles_of_narrow_ranges(spark, low, high):
    xs = np.random.default_rng(4).uniform(low, high, 50_000)
    df = spark.createDataFrame([(float(x), "a" if i % 3 else None) for i, x in enumerate(xs)], "x double, g string")
    ps = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.98, "e": 1.0}
    got = quantiles(df, F.col("x"), ps).first()
    assert all(got[k] == pytest.approx(np.quantile(xs, p), rel=1e-12) for k, p in ps.items())
    parts = {r["g"]: r for r in quantiles(df, F.col("x"), ps, ["g"]).collect()}
    for g, rest in (("a", [1, 2]), (None, [0])):
        part = xs[np.isin(np.arange(len(xs)) % 3, rest)]
        assert all(parts[g][k] == pytest.approx(np.quantile(part, p), rel=1e-12) for k, p in ps.items())


def test_null_case_can_be_hot(spark):
    rows = [(None, i) for i in range(60)] + [("a", i) for i in range(30)] + [("b", i) for i in range(5)]
    df = spark.createDataFrame(rows, "case_id string, seq int").withColumn("ts", F.timestamp_seconds(F.col("seq").cast("long")))
    spec = measure_hot(df, LogSpec(), 10)
    edges = {r[0]: len(r[1]) for r in spec.hot.collect()}
    assert edges == {None: 5, "a": 2}
    got = {(r.case_id, r.seq): r.pos for r in over_trace(df, spec, [Position("pos")]).collect()}
    assert got == {(c, i): i for c, i in rows}


def test_few_groups_are_not_few_tasks(spark):
    """Quantiles, bands and ranks of few groups are broadcast to the rows, which no key shuffles."""
    df = spark.range(4000).select((F.col("id") % 2).cast("string").alias("g"), (F.col("id") / 7).alias("x"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    banded_ = banded(df, "x", 4, ["g"])
    assert "BroadcastHashJoin" in plan(banded_) and "hashpartitioning(g" not in plan(banded_)
    assert sorted((r["g"], r["band"], r["n"]) for r in banded_.groupBy("g", "band").agg(F.count("x").alias("n")).collect()) == [
        (g, b, 500) for g in "01" for b in range(4)]
    # The values are counted once and the wanted digits sent to them.
    last = plan(quantiles(df, F.col("x"), {"m": 0.5}, ["g"]))
    assert "Range" not in last and "BroadcastHashJoin" in last and "SortMergeJoin" not in last
    placed = ranked(df, ["g"], ["x"], "r", "n")
    assert "BroadcastHashJoin" in plan(placed) and "hashpartitioning" not in plan(placed)
    assert sorted(r["r"] for r in placed.filter("g = '1'").collect()) == list(range(2000))
