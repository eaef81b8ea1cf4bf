"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.features import Hasher, drawn, score_texts, slots

BITS = 15
ORDERS = (1, 2, 3)
#: Texts per language that a model is fitted on, about; longer texts than ``FIT_CHARS`` aren't drawn.
FIT_ROWS = 800
FIT_CHARS = 20_000
UNKNOWN = "und"


def counts(hasher: Hasher, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the letter n-grams of a whole text; none if it has no letter."""
    found = []
    for piece in hasher.pieces(text.lower(), "letter"):
        if len(piece) > 1:
            found += hasher.ngrams(piece, ORDERS)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.bincount(slots(np.concatenate(found), BITS), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def weighed(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of a text with length one."""
    x = (1 + np.log(n)) * idf[at]
    return x / np.linalg.norm(x)


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slots and a bias, by class
    temperature: float

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return weighed(at, n, self.idf) @ self.weights[at] + self.weights[-1]

    def predict(self, at: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        p = softmax(self.logits(at, n) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each slot, and texts with a letter, over all rows: tasks sum first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, texts = Hasher(), np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            for t in batch.column("text"):
                at, _ = counts(hasher, t.as_py() or "")
                total[at] += 1
                texts += len(at) > 0
        total[-1] = texts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    found = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    for r in found.collect():
        out[r["slot"]] = r["n"]
    return out[:-1], int(out[-1])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: list[str], idf: np.ndarray, epochs: int = 4,
        alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2, seed: int = 3) -> Model:
    """Follow the regularised leader, per coordinate, with elastic-net penalties; then a temperature.

    One row in five is kept from training and sets the temperature that makes its
    log loss least.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    size = ((1 << BITS) + 1, len(classes))
    z, n = np.zeros(size), np.zeros(size)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    data = [(np.append(a, size[0] - 1), np.append(weighed(a, c, idf), 1.0), y) for a, c, y in rows]
    for _ in range(epochs):
        for i in rng.permutation(order[len(rows) // 5:]):
            at, x, y = data[i]
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    model = Model(classes, idf, weights(z, n).astype(np.float32), 1.0)
    if len(held):
        logits = np.stack([data[i][1] @ model.weights[data[i][0]] for i in held])
        ys = np.array([data[i][2] for i in held])

        def loss(log_t: float) -> float:
            s = logits / np.exp(log_t)
            s = s - s.max(1, keepdims=True)
            return float(-(s[np.arange(len(ys)), ys] - np.log(np.exp(s).sum(1))).mean())

        model.temperature = float(np.exp(min(np.linspace(-3, 3, 121), key=loss)))
    return model


def learn(docs: DataFrame, held_out: Column, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from the rows of ``docs`` with a language and outside ``held_out``; None if there are none.

    Document frequencies cover all those rows; the weights are fitted on about
    ``fit_rows`` of each language.
    """
    known = docs.filter(~held_out & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    short = known.filter(F.length("text").between(1, FIT_CHARS))
    sample, _ = drawn(short, F.col("lang"), F.xxhash64("doc_id", "text"), fit_rows)
    if not sample:
        return None
    frequency, texts = document_frequency(known)
    idf = np.log((1 + texts) / (1 + frequency)) + 1
    hasher = Hasher()
    classes = sorted({r["lang"] for r in sample})
    rows = [(*counts(hasher, r["text"]), classes.index(r["lang"])) for r in sorted(
        sample, key=lambda r: (str(r["doc_id"]), r["text"]))]
    rows = [r for r in rows if len(r[0])]
    return fit(rows, classes, idf) if rows else None


def identify(docs: DataFrame, held_out: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    The score is the calibrated probability of the predicted language. Null texts
    and texts without a letter, and all texts where nothing could be learned, get
    ``und`` and 0. Repeated rows get equal results; other columns aren't read.
    """
    model = learn(docs, held_out, fit_rows)

    def score():
        hasher = Hasher()

        def one(text: str | None) -> tuple[str, float]:
            at, n = counts(hasher, text or "")
            return model.predict(at, n) if model is not None and len(at) else (UNKNOWN, 0.0)

        return one

    out = score_texts(docs.select("doc_id", "text", held_out.alias("held_out")), score, "lang_pred string, score double",
                      ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")
