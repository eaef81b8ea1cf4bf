"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: An overlap: this many aligned words (all words of a shorter item) of which ``SIMILAR`` are equal.
OVERLAP_WORDS = 13
SIMILAR = 0.8
MIN_ITEM_WORDS = 5
#: Shorter items are looked up word for word if they hold this many letters and digits; fewer say too little.
MIN_ITEM_CHARS = 13
#: 1 is a compared word, 0 an ignored one. Any 13 words with two substitutions hold a hit of one of these.
MASKS = ("11010111", "1110011001")
#: For items of 5 to 12 words: any 5 words with one substitution hold a hit.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
#: Benchmark characters in one pass over the documents; a larger benchmark takes several passes.
BLOCK_CHARS = 4_000_000
CHUNK_CHARS = 2_000_000
#: Words 0 after each document of a chunk, so that no mask spans two documents.
PAD = 10
#: Scripts written without spaces: each letter is a word. Thai to Khmer, kana, ideographs.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; single letters of scripts without spaces."""
    return WORD.findall((text or "").lower())


def needed(n: int) -> tuple[int, int]:
    """(aligned words, equal words) that make an overlap with an item of ``n`` words."""
    span = min(n, OVERLAP_WORDS)
    return span, -(-int(span * SIMILAR * 1000) // 1000)


@dataclass
class Index:
    """Seed hashes of benchmark items, sorted; word 0 stands for words no item has."""

    vocabulary: dict[str, int]
    items: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    masks: tuple[str, ...]


def _mix(mask: str) -> list[tuple[int, np.uint64]]:
    rng = np.random.default_rng(int(mask, 2))
    return [(i, np.uint64(int(rng.integers(1, 2**63)) * 2 + 1)) for i, m in enumerate(mask) if m == "1"]


def seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a mask laid on a sequence of word numbers; places with word 0 under the mask are left out."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.ones(n, bool)
    for i, _ in _mix(mask):
        known &= ids[i:i + n] != 0
    at = np.flatnonzero(known)
    h = np.full(len(at), int(mask, 2), np.uint64)
    for i, k in _mix(mask):
        h += ids[at + i].astype(np.uint64) * k
        h ^= h >> np.uint64(29)
    return at, h


def masks_of(words: list[str]) -> tuple[str, ...]:
    """Masks that find an item of these words; none if it says too little."""
    if len(words) >= MIN_ITEM_WORDS:
        return MASKS if len(words) >= OVERLAP_WORDS else SHORT_MASKS
    return ("1" * len(words),) if sum(map(len, words)) >= MIN_ITEM_CHARS else ()


def build(texts: list[str | None]) -> Index:
    """Index of a bounded list of benchmark texts."""
    vocabulary: dict[str, int] = {}
    items, h, item, place, used = [], [], [], [], set()
    for b, t in enumerate(texts):
        words = tokens(t)
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64)
        items.append(ids)
        for mask in masks_of(words):
            used.add(mask)
            at, hs = seeds(ids, mask)
            h.append(hs)
            place.append(at)
            item.append(np.full(len(at), b))
    empty = np.zeros(0, np.int64)
    hashes = np.concatenate([*h, empty.astype(np.uint64)])
    order = np.argsort(hashes, kind="stable")
    return Index(
        vocabulary, items, hashes[order], np.concatenate([*item, empty])[order], np.concatenate([*place, empty])[order],
        tuple(sorted(used)),
    )


def overlaps(ids: np.ndarray, offsets: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """(document, item, most equal words) for each verified pair of a chunk.

    ``ids`` holds the documents one after another, document d at ``offsets[d]:offsets[d + 1]``
    with ``PAD`` words 0 after each. A hit fixes how item and document align; all
    of the item is compared along it and each stretch of the asked length counted.
    """
    if not len(index.hashes):
        return
    gate = np.zeros(1 << 20, bool)
    gate[(index.hashes >> np.uint64(44)).astype(np.int64)] = True
    found = []
    for mask in index.masks:
        at, h = seeds(ids, mask)
        some = gate[(h >> np.uint64(44)).astype(np.int64)]
        at, h = at[some], h[some]
        lo, hi = np.searchsorted(index.hashes, h, "left"), np.searchsorted(index.hashes, h, "right")
        n = hi - lo
        if not n.sum():
            continue
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        found.append(np.stack([np.searchsorted(offsets, at, "right") - 1, index.item[which], at - index.place[which]]))
    if not found:
        return
    best: dict[tuple[int, int], int] = {}
    for d, b, start in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist():
        words = index.items[b]
        span, least = needed(len(words))
        lo, hi = max(start, int(offsets[d])), min(start + len(words), int(offsets[d + 1]) - PAD)
        if hi - lo < span:
            continue
        equal = np.concatenate([[0], np.cumsum(ids[lo:hi] == words[lo - start:hi - start])])
        if (equal[span:] - equal[:-span]).max() >= least:
            best[d, b] = max(best.get((d, b), 0), int(equal[-1]))
    for (d, b), equal in best.items():
        yield d, b, equal


def _scan(batches: Iterator[pa.RecordBatch], index: Index, handle) -> Iterator[pa.RecordBatch]:
    pad = np.zeros(PAD, np.int64)
    get = index.vocabulary.get
    for batch in batches:
        texts, s = batch.column("text").to_pylist(), 0
        while s < len(texts):
            e, held = s, 0
            while e < len(texts) and (e == s or held < CHUNK_CHARS):
                held += len(texts[e] or "")
                e += 1
            parts, offsets = [], [0]
            for t in texts[s:e]:
                ws = tokens(t)
                parts += [np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)), pad]
                offsets.append(offsets[-1] + len(ws) + len(pad))
            hits = list(overlaps(np.concatenate(parts), np.array(offsets), index))
            if (out := handle(batch.slice(s, e - s), hits)) is not None and out.num_rows:
                yield out
            s = e


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list]:
    """Benchmark rows in lists of about ``block_chars`` characters, so the index sent to the tasks has a bound."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // block_chars + 1
    part = F.pmod(F.xxhash64("text", "item_id"), F.lit(n))
    for i in range(n):
        rows = benchmark.filter(part == i).select("item_id", "text").distinct().collect() if n > 1 else (
            benchmark.select("item_id", "text").distinct().collect()
        )
        yield sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, item_words, equal_words`` for each document row and item that overlap.

    An overlap is ``OVERLAP_WORDS`` aligned words (a shorter item: all its words) of
    which ``SIMILAR`` are equal, so some words may be replaced; ``equal_words`` counts the
    equal words along the best alignment. Items under ``MIN_ITEM_WORDS`` words are found word for word;
    those of fewer than ``MIN_ITEM_CHARS`` letters and digits besides, and null or empty texts, overlap
    with nothing. In scripts without spaces each letter is a word. Whole texts are read, nothing is
    shuffled. Repeated rows each give their rows; columns but ids and texts aren't read.
    """
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
        f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, item_words long, equal_words long"
    )
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for rows in blocks(benchmark, block_chars):
        index = build([r["text"] for r in rows])
        ids = [r["item_id"] for r in rows]

        def leaks(batches, index=index, ids=ids):
            def handle(batch, hits):
                if not hits:
                    return None
                d = pa.array([h[0] for h in hits], pa.int64())
                return pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(d), pa.array([ids[h[1]] for h in hits], id_type),
                    pa.array([len(index.items[h[1]]) for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()),
                ], names=["doc_id", "item_id", "item_words", "equal_words"])

            return _scan(batches, index, handle)

        part = docs.select("doc_id", "text").mapInArrow(leaks, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, unchanged. Row by row, without a shuffle."""
    for rows in blocks(benchmark, block_chars):
        index = build([r["text"] for r in rows])

        def clean(batches, index=index):
            def handle(batch, hits):
                bad = {h[0] for h in hits}
                return batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64()))

            return _scan(batches, index, handle)

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
