"""Collocations against plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tracemill.llm import phrases
from tracemill.llm.blocks import pack
from tracemill.llm.phrases import collocation_sql, collocations, phrase_counts


def brute(rows, least=30, reported=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    gone = set()
    for (lang, w), c in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * c >= 80 * f[lang, w[i:i + m]]:
                    gone.add((lang, w[i:i + m]))
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(found)[:reported]))


def texts(seed, count=150):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "é", "漢字", "a", "B", "\U0001F600x", ""]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", ":", "\x0b"]
    return ["".join(rng.choice(vocabulary[:rng.choice([2, 5, 10])]) + rng.choice(ends[:rng.choice([1, 3, 9])])
                    for _ in range(rng.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("reported", [2000, 7])
def test_random_texts(docs_of, seed, reported):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "de", None]), "s", 0) for i, t in enumerate(texts(seed))]
    got = sorted(map(tuple, collocations(docs_of(rows), 30, reported).collect()))
    assert got == brute([(r[2], r[1]) for r in rows], 30, reported) and len(got) > 15


def test_blocks_and_clashing_fingerprints(docs_of, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 300)
    monkeypatch.setattr(phrases, "BUCKET_PHRASES", 50)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts(5))]
    want = brute([(r[2], r[1]) for r in rows])
    block = phrases._Block({
        "words": [b"\n", b"a", b"b"], "codes": pack(np.array([0, 1, 2, 1, 2, 0])), "places": 6, "lang": "en"})
    at = block.longer(block.frequent_words(np.sort(block.word_prints())))
    assert at.tolist() == [1, 2, 3] and dict(block.texts(at, 2)) == {b"a b": 2, b"b a": 1}
    # All fingerprints of a length clash, in every block and over blocks.
    monkeypatch.setattr(phrases._Block, "prints", lambda self, at, n: np.zeros(len(at), np.int64))
    monkeypatch.setattr(phrases._Block, "word_prints", lambda self: np.ones(len(self.words), np.int64))
    assert dict(block.texts(at, 2)) == {b"a b": 2, b"b a": 1}
    assert sorted(map(tuple, collocations(docs_of(rows)).collect())) == want


def test_many_languages_share_a_task(docs_of, monkeypatch):
    monkeypatch.setattr(phrases, "HELD_WORDS", 100)
    rows = [(i, "one two three, one two " * (1 + i % 3), f"l{i % 9}", "s", 0) for i in range(200)]
    assert sorted(map(tuple, collocations(docs_of(rows)).collect())) == brute([(r[2], r[1]) for r in rows])


def test_one_phrase_everywhere_and_long_text(docs_of):
    rows = ["Same old words. " * 3, "same old words " * 5000] * 20
    got = [tuple(r) for r in collocations(docs_of(rows)).collect()]
    assert sorted(got) == brute([("en", t) for t in rows])


def test_odd_rows_and_empty(odd):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, collocations(odd, 2).collect())) == brute(rows, 2)
    assert collocations(odd.limit(0)).count() == 0
    counts, sizes = phrase_counts(odd.filter("doc_id = 1"))
    assert counts.count() == 0 and sizes.count() == 0


def test_sql_and_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()
    want = brute([tuple(r) for r in docs])
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, entry.queries()["op12_phrases"](spark, sf_dir).select(cols).collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(con.sql(collocation_sql()).fetchall()) == want
