"""Quality classifier: supervised subword embeddings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.features import Hasher, drawn, score_texts, slots

BITS = 15
DIM = 16
ORDERS = (3, 4)
#: Labels of each value that a model is fitted on, about; longer texts than ``FIT_CHARS`` are left out.
FIT_ROWS = 2_500
FIT_CHARS = 20_000
THRESHOLD = 0.7
#: Slots of a word that equals the word before it, and of any word: the share of repeats.
REPEAT, ANY = 0, 1


def counts(hasher: Hasher, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of words, of 3 and 4 characters inside words, and of immediately repeated words."""
    found, repeats, n_words, last = [], 0, 0, None
    for piece in hasher.pieces(text, "word"):
        (words,) = hasher.words(piece)
        if not len(words):
            continue
        found += [words, *hasher.ngrams(piece, ORDERS)]
        repeats += int((words[1:] == words[:-1]).sum()) + int(last is not None and words[0] == last)
        n_words += len(words)
        last = words[-1]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.bincount(slots(np.concatenate(found), BITS), minlength=1 << BITS)
    # Weighs as much as the n-grams of the repeated words.
    total[REPEAT] += 8 * repeats
    total[ANY] += n_words
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def score(self, at: np.ndarray, n: np.ndarray) -> float:
        """Probability of label 1; a text without features has the mean vector zero."""
        z = self.bias
        if len(at):
            z = (n / n.sum()) @ self.vectors[at] @ self.weights + self.bias
        return float(1 / (1 + np.exp(np.clip(z[0] - z[1], -50, 50))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float, epochs: int = 8, rate: float = 0.8, seed: int = 5) -> Model:
    """Stochastic gradient descent on the log loss of the softmax over the mean vector of a text.

    ``prior`` is the share of label 1 among all labels; the bias is moved from the share in ``rows`` to it.
    """
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)), np.zeros((DIM, 2)), np.zeros(2))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, n, y = rows[i]
            x = n / n.sum()
            mean = x @ model.vectors[at]
            z = mean @ model.weights + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = rate * (1 - done / steps)
            back = model.weights @ p
            model.weights -= lr * np.outer(mean, p)
            model.bias -= lr * 0.1 * p
            # A text's features share its step, as in averaging models.
            model.vectors[at] -= lr * (x / x.max())[:, None] * back[None, :]
            done += 1
    share = sum(y for *_, y in rows) / len(rows)
    if 0 < share < 1 and 0 < prior < 1:
        model.bias += np.log([(1 - prior) / (1 - share), prior / share])
    model.vectors = model.vectors.astype(np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from labelled rows outside ``held_out``; None where a label is missing altogether."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out).select("doc_id", "quality").distinct()
    drawn_labels, count = drawn(known, F.col("quality"), F.col("doc_id"), fit_rows)
    if not drawn_labels:
        return None
    # About ``fit_rows`` labels of each value, so they may go to every task.
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in drawn_labels], known.schema)
    texts = docs.filter(F.length("text").between(1, FIT_CHARS)).select("doc_id", "text")
    sample = texts.join(F.broadcast(picked), "doc_id").collect()
    hasher = Hasher()
    rows = [(*counts(hasher, r["text"]), int(r["quality"] > 0)) for r in sorted(
        sample, key=lambda r: (str(r["doc_id"]), r["text"], r["quality"]))]
    rows = [r for r in rows if len(r[0])]
    if len({y for *_, y in rows}) < 2:
        return None
    good = sum(n for q, n in count.items() if q > 0)
    return fit(rows, good / sum(count.values()))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD,
             fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Scores read the text only. Null and empty texts have no feature and get the
    probability the bias gives; without labels of both kinds every score is 0.5.
    Repeated rows get equal results; other columns aren't read.
    """
    model = learn(docs, labels, held_out, fit_rows)

    def score():
        hasher = Hasher()

        def one(text: str | None) -> tuple[float, int]:
            s = 0.5 if model is None else model.score(*counts(hasher, text or ""))
            return s, int(s >= threshold)

        return one

    out = score_texts(docs.select("doc_id", "text", held_out.alias("held_out")), score, "score double, predicted long",
                      ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "score", F.col("predicted").cast("int").alias("predicted"))
