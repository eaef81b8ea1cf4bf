"""Held-out accuracy of the classifiers, and their defined results on odd input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracemill.llm import language, quality, toxicity
from tracemill.llm.common import fold
from tracemill.llm.features import Hasher


def auc(score, label):
    score, label = np.array(score), np.array(label)
    rank = np.argsort(np.argsort(score)) + 1
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


@pytest.fixture(scope="module")
def data(spark):
    d = "/root/testdata/sf0.01"
    return d, {r["doc_id"]: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}, {
        r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}


def held(doc_id, parts, rest):
    return zlib.crc32(str(doc_id).encode()) % parts == rest


def test_language(spark, data):
    rows = entry.queries()["op2_language"](spark, data[0]).collect()
    assert len(rows) == len(data[2]) and all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == data[2][r["doc_id"]] for r in out) / len(out) > 0.97


def test_quality(spark, data):
    rows = entry.queries()["op3_quality"](spark, data[0]).collect()
    assert len(rows) == len(data[2]) and all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    out = [r for r in rows if held(r["doc_id"], 4, 2) and r["doc_id"] in data[1]]
    assert all(r["held_out"] for r in out)
    assert auc([r["score"] for r in out], [data[1][r["doc_id"]]["quality"] for r in out]) > 0.95


def test_toxicity(spark, data):
    rows = entry.queries()["op4_toxicity"](spark, data[0]).collect()
    assert len(rows) == len(data[2]) and all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    out = [r for r in rows if held(r["doc_id"], 3, 1) and r["doc_id"] in data[1]]
    assert all(r["held_out"] for r in out)
    assert auc([r["score"] for r in out], [data[1][r["doc_id"]]["toxic"] for r in out]) > 0.8
    clean = [r for r in out if not data[1][r["doc_id"]]["toxic"]]
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.03


def test_odd_rows_and_no_labels(spark, odd):
    none = spark.createDataFrame([(2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    never = F.lit(False)
    got = language.identify(odd, fold(F.col("doc_id"), 5) == 0).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 5))
    assert by[6]["lang_pred"] in ("en", "de", "es", "fr", "und")
    for f, base in ((quality.classify, 0.5), (toxicity.scores, 0.5)):
        rows = f(odd, none, never).collect()
        assert len(rows) == odd.count() and all(r["score"] == base and r["predicted"] == 0 for r in rows)
        assert f(odd.limit(0), none, never).count() == 0
    assert language.identify(odd.limit(0), never).count() == 0
    assert toxicity.drop_toxic(odd, none, never).count() == odd.count()


def test_labels_of_held_out_rows_are_not_learned(spark, docs_of):
    docs = docs_of(["good fine text"] * 40 + ["bad awful words"] * 40)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    none = quality.classify(docs, labels, F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.5}
    rows = quality.classify(docs, labels, F.col("doc_id") % 2 == 0).collect()
    assert all((r["score"] > 0.5) == (r["doc_id"] < 40) for r in rows)


def test_pu_model_separates_without_negative_labels():
    rng = np.random.default_rng(0)
    xp = np.zeros((300, 6), np.uint8)
    xp[np.arange(300), rng.integers(0, 3, 300)] = 1
    xu = np.zeros((3000, 6), np.uint8)
    xu[:, 3:] = rng.random((3000, 3)) < 0.4
    xu[np.arange(300), rng.integers(0, 3, 300)] = 1
    w, b = toxicity.fit(xp, xu, 0.1, np.zeros(6))
    assert (w[:3] + b > 0).all() and (w[3:] + b < 0).all()


def test_pieces_and_features_do_not_depend_on_piece_size(monkeypatch):
    from tracemill.llm import features

    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcé\U0001F600") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    whole = quality.counts(Hasher(), text)
    monkeypatch.setattr(features, "PIECE", 500)
    parts = quality.counts(Hasher(), text)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert len(quality.counts(Hasher(), "")[0]) == 0 and len(language.counts(Hasher(), "123 ?!")[0]) == 0
