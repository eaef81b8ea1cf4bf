"""Base counts against plain Python; lists learned from planted rules."""

import random
import re
from collections import Counter

import __spark_entry__ as entry
from tracemill.llm.rules import FEATURES, learn, measure, quality_rules


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i:i + 8])] > 1:
            cover |= set(range(i, i + 8))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    n = len(w)
    return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_query(spark, sf_dir):
    want = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = entry.queries()["op7_quality_rules"](spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r[c] for c in BASE) for r in rows} == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_repeats_and_odd_texts(docs_of, odd):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["a " * 500, "x\ry\r\nx\ry\r\n" * 20, "l1 # *\n\n \nl1 # *\n", "\x0b\x0c a\u00a0b c\u2028d " * 9, None, ""]
    got = {r["doc_id"]: tuple(r[c] for c in BASE) for r in measure(docs_of(texts)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    rows = measure(odd).collect()
    assert sorted((str(r["doc_id"]), *[r[c] for c in BASE]) for r in rows) == sorted(
        (str(r["doc_id"]), *plain(r["text"])) for r in odd.collect())


def test_learned_list_finds_planted_rules():
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        x = [rng.random() for _ in FEATURES]
        bad = (x[1] > 0.8 and x[4] <= 0.5) or x[5] > 0.95
        rows.append((int(bad), x))
    rules = learn(rows)

    def rejects(x):
        return any(all((x[FEATURES.index(f)] > v) == (op == ">") for f, op, v in r.tests) for r in rules)

    wrong = sum(rejects(x) != bool(b) for b, x in rows)
    assert rules and wrong < 60
    assert all(r.rejected >= 0.95 * r.of for r in rules)
    assert learn([]) == [] and learn([(0, [0.0] * len(FEATURES))] * 50) == []


def test_without_labels_and_empty(spark, odd):
    labels = spark.createDataFrame([(2, None), (None, 0)], "doc_id long, quality int")
    rows = quality_rules(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality_rules(odd.limit(0), labels).count() == 0
