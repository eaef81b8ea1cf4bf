"""Fingerprints and components against a plain all-pairs computation."""

import random

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from tracemill.llm.common import components
from tracemill.llm.simhash import RADIUS, clusters, keep_one, near_duplicates, near_links, fingerprint


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(rows):
    """{(doc_id, fingerprint): smallest reachable id} of (doc_id, text) rows."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= RADIUS:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        best[r] = min((x for x in (best.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{fps[i]:016x}", best[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in entry.queries()["op8_simhash"](spark, sf_dir).collect()), key=str)
    assert got == plain_components(rows)
    assert any(r[0] != r[2] for r in got)


def test_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_duplicates(odd).collect()), key=str) == plain_components(rows)
    assert near_duplicates(odd.limit(0)).count() == 0
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    # Blank texts and the shortest ones link by their fingerprints; of the repeated row one stays.
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(
        {c for _, _, c in plain_components(rows) if c is not None})


@pytest.mark.parametrize("shard_rows", [200_000, 7])
def test_links_equal_all_pairs(spark, shard_rows):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, 3, 2**64 - 1} | set(base)
    for b in base:
        for _ in range(rng.randint(0, 12)):
            for i in rng.sample(range(64), rng.randint(1, 3)):
                b ^= 1 << i
            fps.add(b)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {(r["node"], r["root"]) for r in components(near_links(df, shard_rows)).collect()}
    signed = {f: int(np.uint64(f).astype(np.int64)) for f in fps}
    links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= RADIUS]
    group = {f: {f} for f in fps}
    for a, b in links:
        if group[a] is not group[b]:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
    assert got == {(signed[f], min(signed[x] for x in group[f])) for f in fps if len(group[f]) > 1}


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i % 977}" for i in range(150_000))
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_clusters_take_the_smallest_id(spark):
    df = spark.createDataFrame([(9, 0), (4, 1), (7, 3), (1, 2**40 - 1), (None, 0)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in clusters(df).collect()}
    assert got == {0: 4, 1: 4, 3: 4, 2**40 - 1: 1}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}
