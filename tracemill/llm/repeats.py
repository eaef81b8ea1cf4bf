"""Repeated byte strings over a corpus by prefix-free parsing.

The corpus order of suffixes is never laid out as a whole. A trigger (the place of
least rolling hash in a window as long as the asked string) cuts the texts into
phrases: all starts that share a trigger, with the bytes their strings cover. Two
equal strings have equal triggers at equal distance, so the suffixes of two
phrases can only meet in corpus order if their triggers agree. Spark therefore

1. counts triggers, and keeps phrases whose trigger occurs twice or more;
2. builds the dictionary of distinct phrases with their number in the parse: a
   phrase that occurs twice repeats with all its suffixes;
3. cuts the remaining dictionary phrases of a shared trigger into short ones, by
   the distance of a start to the trigger, and does the same with them: what all
   strings of a short phrase cover is its trigger now;
4. puts the suffixes of what is still open into one order and finds equal
   neighbours. Only equality counts, so the order is that of a 128-bit digest of
   the string, which lets a grouped count, combined map-side, take the place of
   merging the suffix arrays; no trigger, phrase or string shared by many texts is
   gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.common import row_key, settle_and_free
from tracemill.session import settle

LENGTH = 200
#: Bytes of a trigger. Longer ones tell more texts apart in step 1 and make more phrases.
GRAM = 64
#: Starts of a short phrase.
STEP = 16
CHUNK = 1 << 20
#: ``ahead`` is how far before its trigger a phrase starts.
PHRASE = "core long, phrase long, _k1 long, _k2 long, start int, n short, ahead short"


class Parser:
    """Phrases of the texts of a chunk."""

    def __init__(self, length: int, gram: int):
        rng = np.random.default_rng(7)
        self.length, self.gram = length, gram
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            def powers(b: int) -> np.ndarray:
                steps = np.full(max(n, CHUNK), b, np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)

            self.power, self.inverse = powers(self.base), powers(pow(self.base, -1, 2**64))

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(trigger hash, text, first start, number of starts, distance to the trigger) per phrase of texts ``offsets[i]:offsets[i + 1]``."""
        n, length, gram = len(data), self.length, self.gram
        none = np.zeros(0, np.int64)
        if n < length:
            return none.view(np.uint64), none, none, none, none
        self._grow(n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.power[:n], out=run[1:])
        h = (run[gram:] - run[:-gram]) * self.inverse[:n - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        # Least hash first, of equal ones the leftmost: the place sits in the low half.
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width, left = 1, length - gram + 1
        while 2 * width <= left:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if left > width:
            low = np.minimum(low[:width - left], low[left - width:])
        trigger = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(trigger)]
        end = offsets[1:][text] - length
        at = np.arange(len(trigger))
        first = at <= end
        first[1:] &= (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
        start = np.flatnonzero(first)
        text = text[start]
        stop = np.minimum(np.append(start[1:], n), offsets[1:][text] - length + 1)
        return h[trigger[start]], text, start, stop - start, trigger[start] - start


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(batch, first row, bytes, offsets) of about ``CHUNK`` bytes, whole texts each."""
    for batch in batches:
        data, offsets = _bytes(batch.column("text"))
        s = 0
        while s < batch.num_rows:
            e = max(s + 1, int(np.searchsorted(offsets, offsets[s] + CHUNK, "right")) - 1)
            yield batch, s, data[offsets[s]:offsets[e]], offsets[s:e + 1] - offsets[s]
            s = e


def _parse(length: int, gram: int, full: bool):
    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length, gram)
        for _, _, data, offsets in _chunks(batches):
            core, n = np.unique(parser.phrases(data, offsets)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(n)], names=["core", "n"])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        parser, digest = Parser(length, gram), xxhash.xxh3_64_intdigest
        for batch, first, data, offsets in _chunks(batches):
            core, text, start, n, ahead = parser.phrases(data, offsets)
            view = memoryview(data)
            phrase = np.array(
                [digest(view[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist())], np.uint64
            )
            row = pa.array(first + text)
            yield pa.RecordBatch.from_arrays([
                pa.array(core.view(np.int64)), pa.array(phrase.view(np.int64)), batch.column("_k1").take(row),
                batch.column("_k2").take(row), pa.array((start - offsets[text]).astype(np.int32)),
                pa.array(n.astype(np.int16)), pa.array(ahead.astype(np.int16)),
            ], names=["core", "phrase", "_k1", "_k2", "start", "n", "ahead"])

    return phrases if full else triggers


def _short(length: int, step: int):
    """The short phrases of the given phrases of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, offsets = _bytes(batch.column("text"))
            view = memoryview(data)
            rows = []
            for i, (asked, k1, k2) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("probes", "_k1", "_k2")])):
                o = int(offsets[i])
                for s in asked or ():
                    trigger, end = s["start"] + s["ahead"], s["start"] + s["n"]
                    at = s["start"]
                    while at < end:
                        part = (trigger - at) // step
                        stop = min(end, trigger - part * step + 1)
                        # Covered by every string that starts at this distance to the trigger.
                        core = o + trigger - part * step
                        rows.append((
                            digest(view[core:core + length + 1 - step], part), digest(view[o + at:o + stop + length - 1]),
                            k1, k2, at, stop - at, s["lone"],
                        ))
                        at = stop
            if rows:
                core, phrase, *rest = zip(*rows)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (core, phrase)]
                    + [pa.array(c, t) for c, t in zip(rest, types)],
                    names=["core", "phrase", "_k1", "_k2", "start", "n", "lone"],
                )

    return run


def _suffixes(length: int):
    """Digest, row and place of every string that starts in the given phrases of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            data, offsets = _bytes(batch.column("text"))
            view = memoryview(data)
            digests, rows = [], []
            for i, (asked, k1, k2) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("probes", "_k1", "_k2")])):
                o = int(offsets[i])
                for s in asked or ():
                    for a in range(s["start"], s["start"] + s["n"]):
                        digests.append(digest(view[o + a:o + a + length]))
                        rows.append((k1, k2, a, s["lone"]))
            if rows:
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(d[:, j])) for j in (0, 1)] + [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    names=["d1", "d2", "_k1", "_k2", "start", "lone"],
                )

    return run


def covered(spans: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under strings that start in ``(start, n)``."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    out: list[tuple[int, int]] = []
    for s, n in spans.tolist():
        e = s + n + length - 1
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _removed(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column("text"))
            marks = batch.column("marks")
            rows = []
            for i in range(batch.num_rows):
                a, b = int(offsets[i]), int(offsets[i + 1])
                runs = []
                if marks[i].is_valid and len(marks[i]):
                    v = marks[i].values
                    runs = covered(np.stack([v.field("start").to_numpy(), v.field("n").to_numpy()], 1).astype(np.int64), length)
                parts, at = [], a
                for s, e in runs:
                    parts.append(data[at:a + s].tobytes())
                    at = a + e
                parts.append(data[at:b].tobytes())
                kept = b"".join(parts)
                row = (b - a, sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept.decode("utf-8", "replace"), [{"start": s, "end": e} for s, e in runs]) if with_text else row)
            columns = list(zip(*rows)) if rows else [[]] * (6 if with_text else 4)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["doc_id", *names[:len(columns)]],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Take out every byte under a ``length``-byte string that starts elsewhere too, in any text or the same one.

    One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with
    ``with_text`` also the remaining text (a cut character is replaced) and the removed spans.
    Strings are judged on the input and never cross texts. Null and empty texts
    have 0 bytes, texts under ``length`` bytes lose nothing. Repeated rows are copies of each other.
    """
    keyed = docs.select("doc_id", "text", *row_key(docs))
    counts = docs.select("text").mapInArrow(_parse(length, gram, False), "core long, n long")
    # Written, so that the join below can split a trigger that very many texts share.
    again = settle_and_free(counts.groupBy("core").agg(F.sum("n").alias("n")).filter("n > 1").select("core"))
    parsed = keyed.select("_k1", "_k2", "text").mapInArrow(_parse(length, gram, True), PHRASE)
    shared = settle_and_free(parsed.join(again, "core").withColumn("lone", F.lit(True)))
    whole, probes = _dictionary(shared, ["start", "n", "ahead"])
    asked = keyed.join(probes.hint("shuffle_hash"), ["_k1", "_k2"])
    short = asked.select("_k1", "_k2", "text", "probes").mapInArrow(
        _short(length, min(STEP, length - gram + 1)), "core long, phrase long, _k1 long, _k2 long, start int, n short, lone boolean"
    )
    whole_short, probes = _dictionary(settle_and_free(short), ["start", "n"])
    asked = keyed.join(probes.hint("shuffle_hash"), ["_k1", "_k2"])
    found = asked.select("doc_id", "_k1", "_k2", "text", "probes").mapInArrow(
        _suffixes(length), "d1 long, d2 long, _k1 long, _k2 long, start int, lone boolean"
    )
    equal = found.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("d1", "d2")
    single = found.filter("lone").join(equal, ["d1", "d2"]).select("_k1", "_k2", "start", F.lit(1).cast("short").alias("n"))
    whole = whole.unionByName(whole_short)
    marks = whole.unionByName(single).distinct().groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    out = keyed.join(marks.hint("shuffle_hash"), ["_k1", "_k2"], "left")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += ", kept_text string, spans array<struct<start:long,end:long>>"
    return out.select("doc_id", "_k1", "_k2", "text", "marks").mapInArrow(_removed(length, with_text), schema)


def _dictionary(shared: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose phrase repeats, per text the phrases to look into) of phrases with their triggers.

    Looked into is one row of every distinct phrase whose trigger has other phrases
    too; it is ``lone`` if what is found there has yet to be marked.
    """
    row = F.struct("_k1", "_k2", *place, "lone")
    book = settle_and_free(
        shared.groupBy("core", "phrase").agg(F.count(F.lit(1)).alias("times"), F.min(row).alias("at"))
    )
    several = settle(book.groupBy("core").agg(F.count(F.lit(1)).alias("phrases")).filter("phrases > 1").select("core"))
    open_ = book.join(several, "core").select("at.*", "times").withColumn("lone", F.col("lone") & (F.col("times") == 1))
    probes = settle_and_free(open_.groupBy("_k1", "_k2").agg(F.collect_list(F.struct(*place, "lone")).alias("probes")))
    whole = shared.filter("lone").join(book.filter("times > 1").select("core", "phrase"), ["core", "phrase"])
    return whole.select("_k1", "_k2", "start", "n"), probes
