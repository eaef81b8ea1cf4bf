"""Repeated strings against a brute-force count of all of them."""

import hashlib
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from tracemill.llm.repeats import remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                cover[k:k + length] = b"\1" * length
        spans = sum(1 for j, c in enumerate(cover) if c and (j == 0 or not cover[j - 1]))
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(docs, length, gram, spark_rows=None):
    rows = docs.collect()
    got = sorted(map(tuple, remove_repeats(docs, length, gram).collect()), key=str)
    want = sorted(((r["doc_id"], *b) for r, b in zip(rows, brute([r["text"] for r in rows], length))), key=str)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_random_copies(docs_of, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 90))) for _ in range(30)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    check(docs_of(texts), 40, 12)


def test_runs_overlaps_and_edges(docs_of):
    base = "".join(random.Random(5).choice("abcdefgh") for _ in range(300))
    texts = [
        "a" * 500, "a" * 199, "ab" * 300, base, base[:200], base[50:260] + "zz", base[:100], None, "", base[1:], base[1:],
        "x" + base[80:280] + "y" + base[80:280],
    ]
    check(docs_of(texts), 200, 64)


def test_odd_rows_and_empty(odd):
    check(odd.select("doc_id", "text", "start", "n", "core"), 200, 64)
    assert remove_repeats(odd.limit(0)).count() == 0


def test_spans_and_text(docs_of):
    shared = "".join(random.Random(9).choice("abcdefgh") for _ in range(220))
    a, b = remove_repeats(docs_of(["one " + shared + " two", "three " + shared]), with_text=True).orderBy("doc_id").collect()
    assert [(s["start"], s["end"]) for s in a["spans"]] == [(2, 224)]
    assert a["kept_text"] == "on two" and b["kept_text"] == "thre"


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: b for r, b in zip(docs, brute([r["text"] for r in docs], 200))}
    got = {r["doc_id"]: tuple(r)[1:5] for r in entry.queries()["op1_repeats"](spark, sf_dir).collect()}
    assert got == want and any(b[1] for b in want.values())
