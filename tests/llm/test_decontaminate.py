"""Spaced seeds: their guarantee, and overlaps against a comparison of all alignments."""

import random
from itertools import combinations

import __spark_entry__ as entry
from tracemill.llm import decontaminate as d


def plain(docs, items):
    """{(doc_id, item_id): most equal words} over every alignment of every pair."""
    out = {}
    for i, text in docs:
        w = d.tokens(text)
        for b, item in items:
            v = d.tokens(item)
            if len(v) < d.MIN_ITEM_WORDS:
                continue
            span, least = d.needed(len(v))
            for start in range(-len(v) + 1, len(w)):
                pairs = [(w[start + k], v[k]) for k in range(len(v)) if 0 <= start + k < len(w)]
                same = [a == c for a, c in pairs]
                if any(sum(same[k:k + span]) >= least for k in range(len(same) - span + 1)):
                    out[i, b] = max(out.get((i, b), 0), sum(same))
    return out


def found(df):
    return {(r["doc_id"], r["item_id"]): r["equal_words"] for r in df.collect()}


def test_masks_tolerate_two_substitutions():
    def hit(masks, n, wrong):
        return any(
            all(s + i not in wrong for i, m in enumerate(mask) if m == "1") for mask in masks for s in range(n - len(mask) + 1)
        )

    assert all(hit(d.MASKS, 13, set(c)) for k in range(3) for c in combinations(range(13), k))
    for n in range(d.MIN_ITEM_WORDS, 13):
        wrong = n - d.needed(n)[1]
        assert all(hit(d.SHORT_MASKS, n, set(c)) for c in combinations(range(n), wrong))


def test_substitutions_parts_and_short_items(spark, docs_of):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 5, 8, 12, 13, 20, 45)]
    texts = [None, "", "a b c"]
    for item in items * 6:
        v = item.split()
        for k in rng.sample(range(len(v)), min(len(v), rng.randint(0, 4))):
            v[k] = word()
        s = rng.randint(0, len(v) // 2)
        texts.append(" ".join([word() for _ in range(rng.randint(0, 30))] + v[s:] + [word() for _ in range(9)]))
    bench = spark.createDataFrame([*enumerate(items), (9, None), (None, items[4])], "item_id long, text string")
    want = plain(list(enumerate(texts)), [*enumerate(items), (9, None), (None, items[4])])
    assert found(d.find_leaks(docs_of(texts), bench)) == want and len(want) > 15
    # Several blocks of the benchmark give the same.
    assert found(d.find_leaks(docs_of(texts), bench, block_chars=60)) == want
    left = {r["doc_id"] for r in d.drop_leaks(docs_of(texts), bench).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}


def test_case_and_punctuation_do_not_hide(spark, docs_of):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = "X, " + item.title().replace(" ", ", ").replace("Five", "FIVE!!") + "."
    assert found(d.find_leaks(docs_of([text, item.replace(" ", "")]), bench)) == {(0, 1): 14}


def test_few_words_and_scripts_without_spaces(spark, docs_of):
    four, chinese = "Photosynthesis converts light energy", "春天的花园里有许多红色和黄色的花"
    bench = spark.createDataFrame([(1, four), (2, chinese), (3, "is it so?"), (4, "春天的花园")], "item_id long, text string")
    texts = [
        f"so {four.lower()}, he said", "photosynthesis converts some light energy", f"他说{chinese}还有很多树",
        "is it so?", "花园里没有春天的花", chinese.replace("红", "蓝"), f"{chinese[:9]} or {chinese[9:]}",
    ]
    assert found(d.find_leaks(docs_of(texts), bench)) == {(0, 1): 4, (2, 2): 16, (2, 4): 5, (5, 2): 15, (5, 4): 5, (6, 4): 5}
    left = {r["doc_id"] for r in d.drop_leaks(docs_of(texts), bench).collect()}
    assert left == {1, 3, 4}


def test_odd_rows_and_empty(spark, odd):
    bench = spark.createDataFrame([(1, "same row twice over and on")], "item_id long, text string")
    assert d.find_leaks(odd, bench).count() == 0
    assert sorted(map(str, d.drop_leaks(odd, bench).collect())) == sorted(map(str, odd.collect()))
    short = spark.createDataFrame([(1, "word other thing word other")], "item_id long, text string")
    assert found(d.find_leaks(odd, short)) == {(2, 1): 5}
    assert d.find_leaks(odd, bench.limit(0)).count() == 0 and d.drop_leaks(odd.limit(0), bench).count() == 0


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    held = [(i, t, set(d.tokens(t))) for i, t in docs]
    got = found(entry.queries()["op6_decontaminate"](spark, sf_dir))
    # All alignments where enough words agree at all, else there is none.
    want = {}
    for b, item in items:
        v = set(d.tokens(item))
        near = [(i, t) for i, t, w in held if len(v & w) >= min(8, len(v))]
        want |= plain([x for x in near if len(x[1]) < 3000], [(b, item)])
    small = {i for i, t in docs if len(t) < 3000}
    assert {k: n for k, n in got.items() if k[0] in small} == want and want
