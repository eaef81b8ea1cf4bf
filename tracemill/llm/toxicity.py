"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.features import Hasher, score_texts
from tracemill.session import settle

#: Hashed features: lower-case words, their first characters, and five characters inside words.
STARTS = (3, 4, 5, 6, 7)
ORDERS = (5,)
#: Confirmed toxic texts and unlabelled texts that a model is fitted on, about; texts over ``FIT_CHARS`` aren't drawn.
FIT_POSITIVE = 2_000
FIT_UNLABELLED = 20_000
FIT_CHARS = 20_000
#: Features looked at, and features kept.
CANDIDATES = 20_000
FEATURES = 1_000
GATE = 20
THRESHOLD = 0.7


def hashes(hasher: Hasher, text: str) -> Iterator[np.ndarray]:
    for piece in hasher.pieces(text.lower(), "alnum"):
        yield from hasher.words(piece, STARTS)
        yield from hasher.ngrams(piece, ORDERS)


class Lookup:
    """Places of known hashes (sorted) in a text; a bit table turns most others away."""

    def __init__(self, known: np.ndarray):
        self.known, self.gate = known, np.zeros(1 << GATE, bool)
        self.gate[self._slot(known)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - GATE)).astype(np.int64)

    def __call__(self, hasher: Hasher, text: str) -> np.ndarray:
        if not len(self.known):
            return np.zeros(0, np.int64)
        hit = []
        for h in hashes(hasher, text):
            h = h[self.gate[self._slot(h)]]
            if len(h):
                at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
                hit.append(at[self.known[at] == h])
        return np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int64)


def frequent(texts: DataFrame, least: int, limit: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` hashes held by most of the texts, at least ``least``, sorted, with their numbers of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            each = [np.unique(np.concatenate(list(hashes(hasher, t.as_py())) or [np.zeros(0, np.uint64)])) for t in batch.column("text")]
            h, n = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    rows = (
        texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(limit).collect()
    )
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["n"] for r in rows], np.int64)[order]


def held(texts: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all ``texts`` each known hash occurs, and the number of texts. Tasks sum first."""
    find = Lookup(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                total[find(hasher, t.as_py() or "")] += 1
            total[-1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(len(known) + 1, np.int64)
    for r in texts.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out[:-1], int(out[-1])


def choose(p: np.ndarray, n_p: int, u: np.ndarray, n_u: int, prior: float, limit: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Places of the most telling candidates, and for each the log odds a text with it gains.

    Of the texts that hold a feature the share ``prior * P(held | toxic) / P(held)`` is toxic. Features are
    ranked by how much of the toxic texts they tell and how far that share, lowered for
    small counts, lies above the prior.
    """
    rate = p / max(1, n_p)
    toxic = np.minimum(1.0, prior * rate / np.maximum(u / max(1, n_u), 1e-12))
    sure = toxic - 2 * np.sqrt(toxic * (1 - toxic) / np.maximum(p, 1) + 1 / np.maximum(p, 1) ** 2)
    gain = np.where(sure > max(0.5, 2 * prior), rate * (sure - prior), 0.0)
    best = np.argsort(-gain, kind="stable")[:limit]
    best = np.sort(best[gain[best] > 0])
    s = np.clip(sure[best], 0.01, 0.99)
    return best, np.log(s / (1 - s)) - np.log(prior / (1 - prior))


def fit(xp: np.ndarray, xu: np.ndarray, prior: float, start: np.ndarray, steps: int = 150, rate: float = 0.03,
        decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk, with the sigmoid loss, by Adam on all rows from ``start``.

    Risk: ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``. The unlabelled texts count as negative
    less what the toxic ones among them would add; where that difference falls below zero it
    is held at zero, which keeps the model from fitting unlabelled texts as negatives.
    Equal rows are summed first. ``xp`` and ``xu`` hold 0 or 1.
    """
    (xp, np_), (xu, nu) = (np.unique(x, axis=0, return_counts=True) for x in (xp, xu))
    xp, xu = xp.astype(np.float32), xu.astype(np.float32)
    wp, wu = prior * np_ / np_.sum(), nu / nu.sum()
    w, bias = start.astype(float), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        pp = 1 / (1 + np.exp(-np.clip(xp @ w + bias, -50, 50)))
        pu = 1 / (1 + np.exp(-np.clip(xu @ w + bias, -50, 50)))
        slope = wp * pp * (1 - pp)
        ep, eu = -slope, np.zeros(len(pu))
        if wu @ pu > wp @ pp:
            ep, eu = ep - slope, wu * pu * (1 - pu)
        g = np.append(xp.T @ ep + xu.T @ eu + decay * w, ep.sum() + eu.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - d[:-1], bias - d[-1]
    return w, bias


@dataclass
class Model:
    find: Lookup
    weights: np.ndarray
    bias: float

    def score(self, hasher: Hasher, text: str) -> float:
        z = self.weights[self.find(hasher, text)].sum() + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _matrix(rows: list, n: int) -> np.ndarray:
    out = np.zeros((len(rows), n), np.uint8)
    for i, r in enumerate(rows):
        out[i, r["at"]] = 1
    return out


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, positives: int = FIT_POSITIVE,
          unlabelled: int = FIT_UNLABELLED) -> tuple[Model | None, float]:
    """A model and the class prior; no model without a confirmed toxic text.

    Outside ``held_out`` only: labels say which texts are confirmed toxic and, by their
    share, the prior; unlabelled are all documents, whatever their label. Features come from the
    drawn toxic texts, their frequency from all unlabelled texts, the weights from the two draws.
    """
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out).select("doc_id", "toxic").distinct()
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_toxic = sum(n for t, n in shares.items() if t > 0)
    prior = n_toxic / max(1, sum(shares.values()))
    if not 0 < prior < 1:
        return None, prior
    everything = docs.filter(~held_out).select("doc_id", "text")
    texts = everything.filter(F.length("text").between(1, FIT_CHARS))
    key = F.xxhash64("doc_id", "text")
    some = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) < int(min(1.0, positives / n_toxic) * (1 << 30))
    # About ``positives`` ids at most, so they may go to every task.
    picked = known.filter("toxic > 0").filter(some).select("doc_id").distinct()
    toxic = settle(texts.join(F.broadcast(picked), "doc_id"))
    n_p = toxic.count()
    if not n_p:
        return None, prior
    candidates, p = frequent(toxic, max(4, n_p // 200))
    u, n_u = held(everything, candidates)
    best, start = choose(p, n_p, u, n_u, prior)
    candidates = candidates[best]
    find = Lookup(candidates)

    def places():
        hasher = Hasher()
        return lambda text: (find(hasher, text).tolist(),)

    xp = score_texts(toxic, places, "at array<long>").collect()
    share = F.pmod(key, F.lit(1 << 30)) < int(min(1.0, unlabelled / max(1, n_u)) * (1 << 30))
    xu = score_texts(texts.filter(share), places, "at array<long>").collect()
    if not xu:
        return None, prior
    weights, bias = fit(_matrix(xp, len(candidates)), _matrix(xu, len(candidates)), prior, start)
    return Model(find, weights, bias), prior


def _scorer(docs: DataFrame, labels: DataFrame, held_out: Column, **limits):
    model, prior = learn(docs, labels, held_out, **limits)

    def one():
        hasher = Hasher()
        return lambda text: min(prior, 0.5) if model is None else model.score(hasher, text or "")

    return one


def scores(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, **limits) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Scores read the text only. Null and empty texts hold no feature and get the
    probability the bias gives; where nothing could be learned every score is the share of toxic
    labels, 0.5 at most.
    Repeated rows get equal results; other columns aren't read.
    """
    one = _scorer(docs, labels, held_out, **limits)

    def score():
        f = one()
        return lambda text: (s := f(text), int(s >= threshold))

    out = score_texts(docs.select("doc_id", "text", held_out.alias("held_out")), score, "score double, predicted long",
                      ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "score", F.col("predicted").cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, **limits) -> DataFrame:
    """The rows of ``docs`` scored under ``threshold``, unchanged. Row by row, without a shuffle."""
    one = _scorer(docs, labels, held_out, **limits)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = one()
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < threshold for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
