"""Hashed words and character n-grams of a text, with numpy, for the text classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Longer texts are hashed in pieces of this many characters, cut at a blank where there is one.
PIECE = 1 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


class Hasher:
    """Character classes and powers for one task."""

    def __init__(self):
        points = [chr(i) for i in range(0x10000)]
        self.blank = {
            "letter": np.array([not c.isalpha() for c in points]),
            "alnum": np.array([not c.isalnum() for c in points]),
            "word": np.array([c in " \t\n\r\x0b\x0c" for c in points]),
        }
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            def powers(b: int) -> np.ndarray:
                steps = np.full(max(n, 4096), b, np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)

            self.power, self.inverse = powers(_BASE), powers(pow(_BASE, -1, 2**64))

    def pieces(self, text: str, keep: str) -> Iterator[np.ndarray]:
        """Code points between blanks; ``keep`` is letter, alnum (others become blanks) or word (only blanks do).

        Runs of blanks become one, and each piece starts and ends with a blank.
        """
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = 0
        while s < len(codes):
            e = min(s + PIECE, len(codes))
            part = codes[s:e]
            blank = self._blank(part, keep)
            if e < len(codes) and (cut := np.flatnonzero(blank)).size:
                e = s + int(cut[-1]) + 1
                part, blank = codes[s:e], blank[:e - s]
            s = e
            stays = ~blank
            stays[1:] |= ~blank[:-1]
            stays[0] = not blank[0]
            part = np.where(blank, np.uint32(32), part)[stays]
            end = 2 if len(part) and part[-1] != 32 else 1
            out = np.full(len(part) + end, 32, np.uint64)
            out[1:len(part) + 1] = part
            yield out

    def _blank(self, codes: np.ndarray, keep: str) -> np.ndarray:
        blank = self.blank[keep].take(codes, mode="clip")
        if keep != "word" and codes.max() > 0xFFFF:
            high = codes > 0xFFFF
            test = str.isalpha if keep == "letter" else str.isalnum
            values, back = np.unique(codes[high], return_inverse=True)
            blank[high] = np.array([not test(chr(c)) for c in values])[back]
        return blank

    def words(self, codes: np.ndarray, starts: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
        """A hash of each word of a piece, and of the first ``n`` characters of each word that long, for ``n`` in ``starts``."""
        at = np.flatnonzero(codes == 32)
        if len(at) < 2:
            return (np.zeros(0, np.uint64),) * (1 + len(starts))
        self._grow(len(codes))
        run = np.cumsum(codes * self.power[:len(codes)], dtype=np.uint64)
        first, size = at[:-1] + 1, np.diff(at) - 1
        out = [mixed((run[at[1:] - 1] - run[at[:-1]]) * self.inverse[first] + size.astype(np.uint64) * _K)]
        for n in starts:
            some = first[size >= n]
            h = (run[some + n - 1] - run[some - 1]) * self.inverse[some]
            out.append(mixed(h + _salt(n + 7919)))
        return tuple(out)

    @staticmethod
    def ngrams(codes: np.ndarray, orders: tuple[int, ...]) -> list[np.ndarray]:
        """Per order the hashes of that many code points without a blank inside (one may be at either end)."""
        out, h = [], np.zeros(len(codes), np.uint64)
        blanks = np.cumsum(codes == 32)
        for n in range(1, max(orders) + 1):
            size = len(codes) - n + 1
            if size <= 0:
                break
            h = h[:size] * _K + codes[n - 1:]
            if n in orders:
                g = h
                if n > 2:
                    g = h[blanks[n - 2:n - 2 + size] == blanks[:size]]
                out.append(mixed(g + _salt(n)))
        return out


def _salt(n: int) -> np.uint64:
    return np.uint64(n * _BASE % 2**64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(_BASE)
    return h ^ (h >> np.uint64(29))


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def score_texts(docs: DataFrame, score: Callable[[], Callable[[str | None], tuple]], fields: str,
                keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ``fields`` that ``score()(text)`` gives, row by row on whole texts.

    ``score`` is called once per task and returns the function for one text.
    """
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = score()
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column("text")]
            columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * len(names)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, *names])

    columns = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*[f"`{c}`" for c in columns]).mapInArrow(run, f"{kept}, {fields}")


def drawn(df: DataFrame, by: Column, key: Column, rows: int) -> tuple[list, dict]:
    """About ``rows`` rows of each value of ``by``, all where there are fewer, and the number of rows per value.

    Rows are drawn by a hash of ``key``, so a draw repeats. Meant for few values of ``by``.
    """
    df = df.withColumn("_by", by)
    count = {r["_by"]: r["count"] for r in df.groupBy("_by").count().collect()}
    if not count:
        return [], {}
    share = F.lit(0.0)
    for value, n in count.items():
        share = F.when(F.col("_by").eqNullSafe(F.lit(value)), F.lit(min(1.0, rows / n))).otherwise(share)
    place = F.pmod(F.xxhash64(key, F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.filter(place < share).collect(), count
