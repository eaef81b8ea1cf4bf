"""Periodic runs of words: maximal pairs of repeats, read off the tree of common prefixes of a text's suffixes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracemill.llm.common import bound, words

#: A run has at least this many words and this many periods.
RUN_WORDS, RUN_PERIODS = 6, 4
#: Shortest repeat a run can rest on: a run of period q is a pair of equal strings of max(6 - q, 3 q) words or more.
LEAST_REPEAT = 5
#: Words whose suffixes are sorted together; a longer document is sorted alone.
BLOCK_WORDS = 400_000


def suffix_levels(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of many texts at once, and the ranks by their first 1, 2, 4, ... words.

    ``keys`` are equal where word and text are equal, ``ends`` is the end of each place's text. Doubling
    sorts only places whose prefix is not unique yet; equal ranks at a level mean equal words of one text.
    """
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[group].astype(np.int32)
    levels, width = [rank], 1
    open_ = np.flatnonzero(size[group] > 1)
    while open_.size:
        after = open_ + width
        second = np.where(after < ends[open_], rank[np.minimum(after, len(rank) - 1)], -1)
        order = np.lexsort((second, rank[open_]))
        at, first, second = open_[order], rank[open_[order]], second[order]
        row = np.arange(len(at))
        new_first = np.r_[True, first[1:] != first[:-1]]
        new = new_first | np.r_[True, second[1:] != second[:-1]]
        start = np.maximum.accumulate(np.where(new, row, 0))
        rank = rank.copy()
        rank[at] = first + start - np.maximum.accumulate(np.where(new_first, row, 0))
        levels.append(rank)
        open_ = at[np.diff(np.r_[np.flatnonzero(new), len(at)])[np.cumsum(new) - 1] > 1]
        width *= 2
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    return order, levels


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Number of equal words from the places ``a`` and ``b`` on."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        out += np.where(inside & (levels[i][x] == levels[i][y]), 1 << i, 0)
    return out


class _Places:
    """Places below a node of the prefix tree, sorted, as a whole and by the word to their left."""

    def __init__(self, place: int, left: int):
        self.every, self.by_left = [place], {left: [place]}

    def add(self, place: int, left: int) -> None:
        insort(self.every, place)
        insort(self.by_left.setdefault(left, []), place)

    def differing(self, low: int, high: int, left: int) -> Iterator[int]:
        """Places in ``[low, high]`` with another word to their left; stretches of the same word are passed over by counts."""
        every, same = self.every, self.by_left.get(left, [])
        todo = [(bisect_left(every, low), bisect_right(every, high), bisect_left(same, low), bisect_right(same, high))]
        while todo:
            i, j, s, t = todo.pop()
            if j - i == t - s:
                continue
            if s == t:
                yield from every[i:j]
                continue
            mid = (i + j) // 2
            cut = bisect_left(same, every[mid], s, t)
            todo += [(i, mid, s, cut), (mid, j, cut, t)]


def maximal_pairs(places: list[int], prefixes: list[int], lefts: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(place, distance, length)`` of the maximal pairs of equal strings near enough to be a run.

    ``places`` are suffixes in order, ``prefixes[i]`` is what ``places[i]`` and the next one have in common. The
    tree of prefix intervals is built bottom up with a stack; where two subtrees meet, the strings of
    a pair end differently, and pairs are taken only between places with different words to their left.
    The smaller side is searched in the larger one, within a third of the length.
    """

    def meet(a: _Places, b: _Places, length: int):
        if len(a.every) < len(b.every):
            a, b = b, a
        reach = length // (RUN_PERIODS - 1)
        found = []
        for left, own in b.by_left.items():
            for x in own:
                for y in a.differing(x - reach, x + reach, left):
                    distance = abs(x - y)
                    if length >= RUN_WORDS - distance:
                        found.append((min(x, y), distance, length))
        for left, own in b.by_left.items():
            for x in own:
                a.add(x, left)
        return a, found

    stack: list[tuple[int, _Places]] = []
    for i, place in enumerate(places):
        node = _Places(place, lefts[i])
        following = prefixes[i] if i < len(prefixes) else -1
        while stack and stack[-1][0] >= following:
            length, below = stack.pop()
            node, found = meet(below, node, length)
            yield from found
            if length == following:
                break
        if following >= 0:
            stack.append((following, node))


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each text, given as arrays of word numbers; sorted by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    word = np.concatenate(texts).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = (np.cumsum(sizes) - sizes)[owner]
    order, levels = suffix_levels(owner * (word.max() + 1) + word, begin + sizes[owner])
    if len(levels) < 3:
        return out
    # Neighbours in order that share four words; a chain of five or more is a set of repeats.
    near = np.flatnonzero(levels[2][order[1:]] == levels[2][order[:-1]])
    shared = np.zeros(len(order), np.int64)
    shared[near] = common_prefixes(order[near], order[near + 1], levels)
    linked = shared >= LEAST_REPEAT
    ends = np.flatnonzero(linked & ~np.r_[linked[1:], False]) + 2
    starts = np.flatnonzero(linked & ~np.r_[False, linked[:-1]])
    left = np.where(np.arange(len(word)) > begin, np.r_[-1, word[:-1]], -1)
    worth = _worth(order, shared, left, starts, ends)
    for s, e in zip(starts[worth].tolist(), ends[worth].tolist()):
        at = order[s:e]
        best: dict[tuple[int, int], int] = {}
        for place, distance, length in maximal_pairs(at.tolist(), shared[s:e - 1].tolist(), left[at].tolist()):
            whole = (place, distance + length)
            best[whole] = min(distance, best.get(whole, distance))
        for (place, length), period in best.items():
            out[owner[place]].append((place - int(begin[place]), length, period))
    return [_smallest_periods(found) for found in out]


def _worth(order, shared, left, starts, ends) -> np.ndarray:
    """Which sets of repeats can hold a run: two places within a third of their longest repeat, and two words to the left."""
    if not len(starts):
        return np.zeros(0, bool)
    sizes = ends - starts
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    first = np.cumsum(sizes) - sizes
    place, group = order[at], np.repeat(np.arange(len(starts)), sizes)
    longest = np.maximum.reduceat(np.where(np.r_[group[1:] == group[:-1], False], shared[at], 0), first)
    lefts = np.maximum.reduceat(left[place], first) != np.minimum.reduceat(left[place], first)
    place = place[np.lexsort((place, group))]
    gap = np.r_[np.diff(place), 0]
    gap[np.r_[first[1:], len(gap)] - 1] = np.iinfo(np.int64).max
    return lefts & (np.minimum.reduceat(gap, first) * (RUN_PERIODS - 1) <= longest)


def _smallest_periods(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """A stretch is found under multiples of its period too, in other sets of repeats: the smallest stays."""
    best: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        best[start, length] = min(period, best.get((start, length), period))
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def _solve(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(held: list[tuple[object, list[bytes], np.ndarray]]) -> pa.RecordBatch:
        runs = runs_of([codes for _, _, codes in held])
        kept = []
        for (_, parts, _), found in zip(held, runs):
            if found:
                edge = np.zeros(len(parts) + 1, np.int64)
                for start, length, period in found:
                    edge[start + period] += 1
                    edge[start + length] -= 1
                parts = [parts[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            kept.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
        structs = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in held], id_type), pa.array([len(c) for _, _, c in held], pa.int64()),
             pa.array(structs, run_type), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    held, size, known = [], 0, defaultdict()
    known.default_factory = known.__len__
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            parts = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            held.append((doc_id, parts, np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))))
            size += len(parts)
            if size >= BLOCK_WORDS:
                yield rows(held)
                held, size = [], 0
                known.clear()
    if held:
        yield rows(held)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of every text and what is left of it: ``doc_id, n_words, runs, collapsed``.

    Words are stretches of anything but the six ASCII blanks. A run is a stretch of at least six words and four of its smallest
    periods that can't be made longer; ``runs`` holds ``(start, length, period)`` by start, then period.
    ``collapsed`` are the words that no run contains after its first period, joined by one space. Each text
    stands alone, so nothing is shuffled; texts are sorted many at a time. A null, empty or blank text has no word and no run;
    repeated rows give repeated results, a null id stays null, other columns are ignored, an empty table gives an empty one.
    """
    id_type = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _solve(batches, to_arrow_type(id_type)),
        f"doc_id {id_type.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, "
        "collapsed string")


def with_tail_period(docs: DataFrame) -> DataFrame:
    """``doc_id`` and text, where in one of ten documents the words from some place on are made periodic.

    With h the crc32 of the id and g = floor(h / 10), if h % 10 = 0 each word i >= a = g % n becomes word
    a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)). A null id or a text without words is left alone.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(parts: Column) -> Column:
        n = F.size(parts).cast("long")
        return bound(F.struct((g % n).alias("a"), (F.lit(1) + F.floor((n - g % n) / (3 + g % 8))).alias("p")), lambda v: F.array_join(
            F.concat(F.slice(parts, F.lit(1), v["a"].cast("int")), F.transform(
                F.sequence(v["a"], n - 1), lambda i: F.element_at(parts, (v["a"] + (i - v["a"]) % v["p"] + 1).cast("int")))), " "))

    planted = (h % 10 == 0) & (F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return docs.select("doc_id", F.when(planted, bound(words(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def run_digest(runs: DataFrame) -> DataFrame:
    """Counts, strongest run and checksums of ``periodic_runs``.

    The strongest run has the greatest length to period ratio, compared as whole numbers; ties go to the smaller start,
    then period. Without a run its four fields are null.
    """
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
        lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    return runs.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit("")), 256)
        .alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )
