"""Quality rules: a decision list learned from labelled statistics. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.common import bound, words

#: Characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: Labelled rows a list is learned from, at most; drawn by a hash of the id.
FIT_ROWS = 20_000
FEATURES = (
    "mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio",
    "mark_ratio", "words_per_line",
)


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, from the array of window hashes.

    Windows are sorted by (hash, place); places next to an equal hash are kept and
    sorted, and each covers the words up to the next place, ``WINDOW`` at most.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(a: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(a, k - 1)["h"] == x["h"])
            after = F.get(a, k + 1)["h"] == x["h"]
            return before | F.coalesce(after, F.lit(False))

        return F.array_sort(F.transform(F.filter(a, twin), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    return bound(bound(pairs, places), covered)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` with base counts, the ``FEATURES`` and ``base_failed`` for each row.

    A null text has no words. All work stays inside a row, whole texts are read:
    repeated windows are found by sorting hashes of the row's own windows, so a
    long text costs ``n log n``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))
    hashes = F.when(
        F.size("w") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", "").alias("joined"),
        F.size(F.array_distinct("w")).alias("n_distinct"), hashes.alias("h"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )

    def without(pattern: str) -> Column:
        return (F.length("joined") - F.length(F.regexp_replace("joined", pattern, ""))).cast("long")

    rows = rows.select(
        "doc_id", "n_words", F.length("joined").cast("long").alias("word_chars"), "n_distinct",
        without(SYMBOLS).alias("n_symbols"), without("[A-Z]").alias("n_upper"), without("[!?.,;:]").alias("n_marks"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("h") == F.size(F.array_distinct("h")), F.lit(0).cast("long"))
        .otherwise(_repeated_words(F.col("h"))).alias("n_repeat_words"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("n_distinct", "n_words").alias("distinct_ratio"), ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_marks", "n_words").alias("mark_ratio"), ratio("n_words", "n_lines").alias("words_per_line"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds; rows that meet all of them are rejected."""

    tests: tuple[tuple[str, str, float], ...]
    rejected: int
    of: int

    def __str__(self) -> str:
        return " AND ".join(f"{f} {op} {v:.6g}" for f, op, v in self.tests) + f"  -- {self.rejected} of {self.of}"

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, v in self.tests:
            out = out & (F.col(f) > v if op == ">" else F.col(f) <= v)
        return out


def labelled_sample(measured: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[tuple[int, list[float]]]:
    """About ``rows`` labelled rows that pass the base rules, all where there are fewer: (is bad, features)."""
    known = labels.filter(F.col("quality").isNotNull()).select("doc_id", "quality").distinct()
    passed = measured.filter(~F.col("base_failed")).join(known, "doc_id")
    share = min(1.0, rows / max(1, passed.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30))
    picked = passed.filter(place < int(share * (1 << 30))).select(
        F.xxhash64("doc_id").alias("o"), (F.col("quality") == 0).cast("int").alias("bad"), *FEATURES
    )
    return [(r["bad"], [float(r[f]) for f in FEATURES]) for r in sorted(picked.collect())]


def learn(sample: list[tuple[int, list[float]]], bins: int = 24, max_rules: int = 12, max_tests: int = 4,
          min_rows: int = 5, min_precision: float = 0.95) -> list[Rule]:
    """Sequential covering: grow a rule, prune it, remove what it covers, go on.

    Two rows of three grow a rule: the threshold test with the best gain (positives
    kept times the rise of the log precision) is added until no bad row is mixed
    with good ones. The third row prunes: trailing tests go while the precision
    there doesn't fall. Learning stops when a pruned rule is right in less than
    ``min_precision`` of all rows it covers, or covers fewer than ``min_rows``. No
    labels of both kinds give an empty list, which rejects nothing.
    """
    import numpy as np

    if not sample:
        return []
    bad = np.array([b for b, _ in sample], bool)
    x = np.array([v for _, v in sample])
    grows = np.arange(len(bad)) % 3 != 2
    tests = []
    for k, name in enumerate(FEATURES):
        edges = np.unique(np.concatenate([
            np.quantile(x[:, k], np.linspace(0, 1, bins + 1)),
            np.quantile(x[bad, k], np.linspace(0, 1, bins + 1)) if bad.any() else [],
        ]))
        for lo, hi in zip(edges, edges[1:]):
            v = float((lo + hi) / 2)
            tests += [((name, ">", v), x[:, k] > v), ((name, "<=", v), x[:, k] <= v)]
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < max_rules and (left & grows & bad).any() and tests:
        inside, chosen = left & grows, []
        while len(chosen) < max_tests and (inside & ~bad).any():
            p, n = (inside & bad).sum(), (inside & ~bad).sum()
            now = np.log2(p / (p + n)) if p else -np.inf
            best, gain = None, 0.0
            for t in tests:
                meets = inside & t[1]
                q, m = (meets & bad).sum(), (meets & ~bad).sum()
                if q >= min_rows and (g := q * (np.log2(q / (q + m)) - now)) > gain + 1e-9:
                    best, gain = t, g
            if best is None:
                break
            chosen.append(best)
            inside &= best[1]

        def right(ts, rows):
            meets = rows.copy()
            for _, m in ts:
                meets &= m
            return meets, ((meets & bad).sum() + 1) / (meets.sum() + 2)

        check = left & ~grows
        while len(chosen) > 1 and right(chosen[:-1], check)[1] >= right(chosen, check)[1]:
            chosen.pop()
        meets = right(chosen, left)[0] if chosen else np.zeros(len(bad), bool)
        hit = int((meets & bad).sum())
        if hit < min_rows or hit < min_precision * meets.sum():
            break
        rules.append(Rule(tuple(t for t, _ in chosen), hit, int(meets.sum())))
        left &= ~meets
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the first rule met or null) as one ordered conditional each."""
    kept, which = F.lit(True), F.lit(None).cast("int")
    if rules:
        kept = F.when(rules[0].column(), F.lit(False))
        which = F.when(rules[0].column(), F.lit(1))
        for i, r in enumerate(rules[1:], 2):
            kept, which = kept.when(r.column(), F.lit(False)), which.when(r.column(), F.lit(i))
        kept = kept.otherwise(F.lit(True))
    return kept, which


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and the rule that rejected, one row per row of ``docs``.

    Base rules come first and the learned list judges the rest. Null and empty
    texts fail the base rules. Without labels only the base rules reject. Texts are
    read once; learning and judging use the measured numbers.
    """
    from tracemill.session import settle

    measured = settle(measure(docs))
    kept, which = verdict(learn(labelled_sample(measured, labels, fit_rows)))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return measured.select(
        *base, (~F.col("base_failed") & kept).alias("kept"),
        F.when(~F.col("base_failed"), which).alias("rule_no"), *FEATURES,
    )
