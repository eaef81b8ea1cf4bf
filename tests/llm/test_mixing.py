"""Mixes against their targets and the SQL form."""

import pytest

from tracemill.llm.mixing import mix, source_targets, variety
import __spark_entry__ as entry
from tests.oracle import compare, duck


def test_query_equals_sql(spark, sf_dir):
    assert compare(entry.queries()["op9_mix_sources"](spark, sf_dir), duck(sf_dir), entry.oracle_sql()["op9_mix_sources"], exact=False) is None


def plain_targets(sizes, weights=(5, 2, 1), repeat=3):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > repeat * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = float(repeat * sizes[s])
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 2, "c": 100, None: 7}, {"z": 0, "é": 5, "Z": 900, "zz": 1, "m": 40}, {"x": 12}, {"x": 0},
])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_taken_meets_target_and_repeats(spark, docs_of):
    texts = [("w " * (1 + i * 37 % 211), "abcdefg"[i % 7]) for i in range(1400)] + [("v " * 9000, "a"), (None, "b"), ("", None)]
    docs = docs_of(texts)
    rows = mix(docs).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 300 for t, n in by.values())
    again = mix(docs.repartition(7, "n_chars"), slots=16, rounds=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_preference_makes_unequal_chances(spark, docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([("w " * 50, "a") for _ in range(600)] + [("w " * 50, "b") for _ in range(3000)])
    liked = F.when(F.col("doc_id") % 2 == 0, 1.6).otherwise(0.4)
    rows = mix(docs, preference=liked).filter("source = 'b'").collect()
    even = sum(r["taken"] for r in rows if r["doc_id"] % 2 == 0)
    assert sum(r["taken"] for r in rows) == pytest.approx(rows[0]["target"], abs=50)
    assert even / sum(r["taken"] for r in rows) == pytest.approx(0.8, abs=0.05)


def test_varied_texts_come_first_and_targets_hold(spark, docs_of):
    from pyspark.sql import functions as F

    varied, dull = " ".join(f"w{i}" for i in range(50)), "w " * 50
    docs = docs_of([((varied, dull)[i % 2], "ab"[i >= 600]) for i in range(3600)])
    rows = mix(docs, preference=variety(F.col("text"))).collect()
    for source in "ab":
        here = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in here) == pytest.approx(here[0]["target"], abs=50)
        if source == "b":
            liked = sum(r["copies"] for r in here if r["doc_id"] % 2 == 0)
            # Inclusion probabilities 0.9 and 0.31.
            assert liked / sum(r["copies"] for r in here) == pytest.approx(0.74, abs=0.05)
    # A source that is taken three times is so whatever the preference.
    assert {r["copies"] for r in rows if r["source"] == "a"} == {3}


def test_odd_rows_and_empty(odd):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and all(r["size"] >= r["taken"] / 3 for r in rows)
    assert mix(odd).columns.count("size") == 1
    assert mix(odd.limit(0)).count() == 0
