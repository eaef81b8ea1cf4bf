"""Periodic runs against a search over all periods and starts."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
from tracemill.llm.periods import periodic_runs, run_digest, runs_of


def brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def row(w):
    runs, drop = brute(w), set()
    for s, n, q in runs:
        drop.update(range(s + q, s + n))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def planted(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_random_texts_many_at_once(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(300):
        w = []
        while len(w) < rng.randint(0, 80):
            unit = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 6))]
            w += unit * rng.randint(1, 8) + unit[:rng.randint(0, len(unit))]
        texts.append(w)
    got = runs_of([np.array(t, np.int64) for t in texts])
    assert got == [brute(t) for t in texts] and sum(map(len, got)) > 100


def test_long_runs_and_nested_ones():
    unit = [1, 1, 1, 1, 1, 1, 2] * 5 + [3]
    texts = [[7] * 30_000, unit * 6, [1, 2] * 4_000 + [1, 2, 3] * 4_000, list(range(5000)) * 4, list(range(5000)) * 5]
    got = runs_of([np.array(t, np.int64) for t in texts])
    assert got[0] == [(0, 30_000, 1)] and got[1] == brute(texts[1]) and len(got[1]) > 30
    assert got[2] == [(0, 8002, 2), (8000, 12_000, 3)]
    assert got[3:] == [[(0, 20_000, 5000)], [(0, 25_000, 5000)]]


def test_odd_rows_and_empty(odd):
    rows = {}
    for r in run_digest(periodic_runs(odd)).collect():
        rows.setdefault(r["doc_id"], []).append(tuple(r)[1:8])
    for r in odd.collect():
        assert rows[r["doc_id"]][0] == row([x.decode() for x in (r["text"] or "").encode().split()])
    assert len(rows[3]) == 2 and rows[2][0][:5] == (1, 0, 12_000, 3, 4_000_000)
    assert run_digest(periodic_runs(odd.limit(0))).count() == 0


def test_collapsed_text_and_ties(docs_of):
    out = periodic_runs(docs_of(["a b a b a b a b x c c c c c c c c", "no run here"])).orderBy("doc_id").collect()
    assert [tuple(r) for r in out[0]["runs"]] == [(0, 8, 2), (9, 8, 1)] and out[0]["collapsed"] == "a b x c"
    assert out[1]["runs"] == [] and out[1]["collapsed"] == "no run here"
    tie = run_digest(periodic_runs(docs_of(["b b b b b b x a a a a a a"]))).first()
    assert (tie["n_runs"], tie["start"], tie["exponent_milli"]) == (2, 0, 6000)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:8] for r in entry.queries()["op11_runs"](spark, sf_dir).collect()}
    assert got == {r["doc_id"]: row(planted(*r)) for r in docs} and sum(1 for v in got.values() if v[0]) > 3
