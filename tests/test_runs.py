"""Run reports and comparisons."""

import json

import pytest

from tracemill.operators import runs as R
from tracemill.sources.reports import read_run_reports


def report(root, folder, name, script, config, test, banks=None, diagnostics=None):
    path = root / folder / name
    path.mkdir(parents=True)
    body = {"script_id": script, "config": config, "metrics": {"test": test, "per_bank_test": banks or {}}, "diagnostics": diagnostics or {}}
    (path / f"{script}_run_report.json").write_text(json.dumps(body, indent=2))


def block(f1, mae, n=None, matrix=None, seconds=False):
    out = {"outcome": {"macro_f1": f1, "per_class": {"0": {"f1": f1, "support": 4}}}, "next_activity": {"top1_accuracy": 0.5},
           "remaining_time": {"mae_seconds" if seconds else "mae": mae}}
    if n is not None:
        out["n_prefixes"] = n
    if matrix:
        out["outcome"]["confusion_matrix"] = matrix
    return out


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    base = {"dataset": "d1", "run_name": "iid_3banks"}
    report(root, "baselines", "d1_iid/central", "central", {**base, "regime": "centralized"}, block(0.8, 10.0, 100), {"A": block(0.7, 9.0, 60), "B": block(0.9, 12.0, 40)})
    report(root, "baselines", "d1_iid/local_A", "central", {**base, "regime": "local", "bank": "A"}, block(0.6, 11.0, None, [[3, 1], [0, 6]]))
    report(root, "federated", "d1_iid/avg", "federated", {**base, "strategy": "fedavg", "use_dp": False, "max_rounds": 5}, block(0.75, 12.0, 100, seconds=True),
           diagnostics={"best_round": {"best_round": 5}})
    report(root, "federated", "d1_iid/prox", "federated", {**base, "strategy": "fedprox", "use_dp": "false", "max_rounds": 9}, block(0.85, 8.0, 100),
           {"d1:A": block(0.85, 8.0, 0)}, {"best_round": {"best_round": 5}})
    report(root, "privacy", "d1_iid/dp", "federated", {**base, "run_name": "weak_3banks", "strategy": "fedavg", "use_dp": "True", "dp_target_epsilon": 8.0}, block(0.5, 20.0, 100))
    report(root, "secure", "d1_iid/x", "federated", base, block(0.1, 1.0, 1))
    return root


TREES = ["baselines", "federated", "privacy"]


@pytest.fixture(scope="module")
def read(spark, reports):
    return read_run_reports(spark, str(reports), TREES, ["secure"])


def test_discovery_and_forbidden_subtree(spark, reports, read):
    paths = {r.report_path for r in read.collect()}
    assert len(paths) == 5 and "baselines/d1_iid/central/central_run_report.json" in paths
    with pytest.raises(Exception, match="forbidden"):
        read_run_reports(spark, str(reports), [*TREES, "secure"], ["secure"]).collect()


def test_run_rows(read):
    rows = {r.report_path.split("/")[2]: r for r in R.run_rows(read).collect()}
    assert rows["local_A"].n_prefixes == 10  # from the confusion matrix
    assert rows["avg"].rt_mae == 12.0 and rows["prox"].rt_mae == 8.0
    assert (rows["avg"].regime, rows["dp"].regime, rows["central"].regime) == ("federated", "federated_dp", "centralized")
    assert rows["dp"].use_dp and not rows["prox"].use_dp


def test_bank_rows_and_spreads(read):
    banks = R.bank_rows(read)
    got = {(r.regime, r.bank): r for r in banks.collect()}
    assert set(got) == {("centralized", "A"), ("centralized", "B"), ("local", "A"), ("federated", "d1:A")}
    assert got[("federated", "d1:A")].source_dataset == "d1"
    s = {r.regime: r for r in R.spreads(banks, ["regime"]).collect()}["centralized"]
    assert (s.worst_f1, s.best_f1, s.worst_mae, s.best_mae) == (0.7, 0.9, 12.0, 9.0)


def test_private_run_does_not_fill_a_slot(spark, read):
    layout = {"d1": [("iid_3banks", ["A", "B"]), ("weak_3banks", [])]}
    missing = {(r.run_name, r.regime, r.strategy, r.bank) for r in R.missing_runs(R.expected_runs(spark, layout), R.run_rows(read)).collect()}
    assert missing == {("iid_3banks", "local", "", "B"), ("weak_3banks", "centralized", "", ""), ("weak_3banks", "", "fedavg", ""), ("weak_3banks", "", "fedprox", "")}


def test_comparisons(read):
    runs = R.run_rows(read)
    d = R.delta_vs_reference(runs).first()
    assert d.best_strategy == "fedprox" and d.delta_f1 == pytest.approx(0.05) and d.delta_mae == pytest.approx(-2.0)
    s = R.strategy_delta(runs).first()
    assert s.delta_f1 == pytest.approx(0.1) and s.delta_mae == pytest.approx(-4.0)
    assert [r.strategy for r in R.at_budget(runs).collect()] == ["fedavg"]
    assert R.relative_loss(runs, {"outcome_macro_f1": False}).count() == 0  # no reference in the private run's split
    flags = {(r.flag, r.bank) for r in R.quality_flags(runs, R.bank_rows(read), ["dataset", "run_name", "regime", "strategy"], ["d1"]).collect()}
    assert flags == {("zero_prefixes", "d1:A"), ("no_bank_rows", "")}


def test_relative_loss_direction(spark):
    rows = [("federated", "d", "r", "fedprox", False, None, 0.8, 10.0), ("federated", "d", "r", "fedprox", True, 4.0, 0.6, 15.0)]
    df = spark.createDataFrame(rows, "script_id string, dataset string, run_name string, strategy string, use_dp boolean, dp_target_epsilon double, f double, m double")
    r = R.relative_loss(df, {"f": False, "m": True}).first()
    assert (r.f_loss, r.m_loss) == pytest.approx((25.0, 50.0))


def test_averages_and_best_steps(spark):
    df = spark.createDataFrame([("A", 1, 0.2, 3), ("B", 3, 0.6, 5)], "bank string, n_prefixes long, f double, s_support long")
    got = {r.bank: r for r in R.append_averages(df, ["f"], ["s_support"]).collect()}
    assert got["unweighted_average"].f == pytest.approx(0.4) and got["prefix_weighted_average"].f == pytest.approx(0.5)
    assert got["prefix_weighted_average"].s_support == 8 and got["unweighted_average"].n_prefixes == 4
    h = spark.createDataFrame([(1, 3.0, 0.1), (2, 1.0, 0.9), (3, 1.0, 0.9)], "step int, loss double, f1 double")
    best = {r.name: (r.step, r.value) for r in R.best_step(h, {"l": ("loss", True), "f": ("f1", False), "x": ("none", True)}).collect()}
    assert best == {"l": (2, 1.0), "f": (2, 0.9)}


def test_round_summary_weighs_reporting_clients(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, 1), (1, 3.0, None, 3), (2, 2.0, None, 2)], "round int, a double, b double, train_prefix_count int")
    got = {r.round: r for r in R.round_summary(df, ["a", "b"]).collect()}
    assert (got[1].a_mean, got[1].b_mean, got[1].a_max) == (2.5, 5.0, 3.0) and got[2].b_mean == 0.0


def test_flatten(read):
    flat = R.flatten_metrics(read.filter("script_id = 'central'"), ["script_id"], ["0", "1"]).collect()
    assert {r.outcome_class_0_support for r in flat} == {4} and {r.outcome_class_1_f1 for r in flat} == {None}
