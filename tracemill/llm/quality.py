"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text is shared by all grades; ordered thresholds part the grades:
P(grade <= k) = logistic(threshold_k - weights . x). x counts the text's words and its byte trigrams, hashed to ``BUCKETS``
places, as log(1 + n), scaled to length 1. From the model come the expected grade and the tail probability
P(grade >= ``least``) by which documents are selected.

It is fitted on the driver with at most about ``LEARN`` labelled documents a grade, of at most ``common.LEARN_BYTES`` together (the stated
bounds of the sample), outside the held-out fold, by full-batch Adam steps in numpy. Every document is scored on its whole text.

Nulls: a null text is an empty one, whose x is 0, so that the thresholds alone decide. Null ratings teach nothing; several ratings of
one document count as the largest. With fewer than two grades nothing can be told apart: every document gets the one grade (0
without any) and tail probability 1. Repeated rows are each returned; other columns stay in ``row``. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import CHUNK, chunks, word_hashes
from .common import labelled_texts

BUCKETS = 1 << 12
LEARN = 1500
STEPS = 150
#: The tail probability from which a document is accepted: low, so that clean documents stay.
ACCEPT = 0.3


def features(texts: list[bytes]) -> np.ndarray:
    """One row a text, of length 1 (0 for a text without words)."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for begin, end in chunks([len(t) for t in texts]):
        hashes, owner = word_hashes(texts[begin:end])
        edges = np.searchsorted(owner, np.arange(end - begin + 1))
        places = (hashes >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
        for i in range(end - begin):
            if edges[i] < edges[i + 1]:
                x = _grams(texts[begin + i]) + np.bincount(places[edges[i] : edges[i + 1]], minlength=BUCKETS)
                x = np.log1p(x.astype(np.float32))
                out[begin + i] = x / np.linalg.norm(x)
    return out


def _grams(text: bytes) -> np.ndarray:
    """The counts of the byte trigrams of a text with a blank at either end, worked on in parts."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text) + 2, CHUNK):
        part = (b" " if not at else b"") + text[max(at - 1, 0) : at + CHUNK + 1] + (b" " if at + CHUNK + 1 > len(text) else b"")
        raw = np.frombuffer(part, np.uint8).astype(np.int64)
        if len(raw) > 2:
            counts += np.bincount(((raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) * 40503 >> 4) & (BUCKETS - 1), minlength=BUCKETS)
    return counts


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Ordinal:
    """grades[k] for k = 0..K-1, K-1 ordered thresholds and one weight vector."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    @classmethod
    def fit(cls, x: np.ndarray, y: list[int], steps: int = STEPS, rate: float = 0.15, decay: float = 1e-5) -> Ordinal:
        grades = sorted(set(y))
        if len(grades) < 2:
            return cls(grades or [0], np.zeros(BUCKETS, np.float32), np.empty(0))
        place = np.searchsorted(grades, y)
        share = np.full(len(y), 1.0 / len(y))
        k = len(grades) - 1
        # thresholds: the first, and the logarithms of the steps between them, so that they stay in order
        params = np.concatenate([np.zeros(x.shape[1]), [-(k - 1) / 2.0], np.zeros(k - 1)])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for t in range(1, steps + 1):
            w, cut = params[: x.shape[1]], params[x.shape[1] :]
            theta = cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])
            s = x @ w.astype(np.float32)
            upper = np.concatenate([theta, [np.inf]])[place] - s
            lower = np.concatenate([[-np.inf], theta])[place] - s
            pu, pl = np.where(np.isinf(upper), 1.0, _logistic(upper)), np.where(np.isinf(lower), 0.0, _logistic(lower))
            p = np.maximum(pu - pl, 1e-12)
            du, dl = pu * (1 - pu), pl * (1 - pl)
            ds = share * (du - dl) / p  # of the loss, by s
            dtheta = np.zeros(k)
            np.add.at(dtheta, place[place < k], -(share * du / p)[place < k])
            np.add.at(dtheta, place[place > 0] - 1, (share * dl / p)[place > 0])
            dcut = np.concatenate([[dtheta.sum()], np.exp(cut[1:]) * dtheta[::-1].cumsum()[::-1][1:]])
            gradient = np.concatenate([x.T @ ds.astype(np.float32) + decay * w, dcut])
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            params -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        cut = params[x.shape[1] :]
        return cls(grades, params[: x.shape[1]].astype(np.float32), cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))]))

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) in column k."""
        s = (x @ self.weights)[:, None]
        return np.concatenate([np.ones((len(x), 1)), 1.0 - _logistic(self.thresholds[None, :] - s)], axis=1)


def fit(docs: DataFrame, labels: DataFrame, rating: str = "quality", learn: int = LEARN, id_col="doc_id", text_col="text") -> Ordinal:
    rows = labelled_texts(docs, labels, rating, learn, id_col=id_col, text_col=text_col)
    return Ordinal.fit(features([r[1].encode("utf-8", "surrogatepass") for r in rows]), [r[2] for r in rows])


def _graded(model, least: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        at = len(known.grades) - 1 if least is None else int(np.searchsorted(known.grades, least))
        steps = np.diff(np.array(known.grades, float))
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            expected, tail = [], []
            for begin in range(0, len(texts), 256):
                tails = known.tails(features(texts[begin : begin + 256]))
                expected.append(known.grades[0] + tails[:, 1:] @ steps)
                tail.append(tails[:, at] if at < len(known.grades) else np.zeros(len(tails)))
            join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), join(expected), join(tail)], ["row", "expected_grade", "tail"])

    return run


def grade(docs: DataFrame, model: Ordinal, least: int | None = None, text_col="text") -> DataFrame:
    """row (the input's columns), expected_grade and tail = P(grade >= ``least``), by default of the best grade."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_graded(shared, least), f"row {rows.schema['row'].dataType.simpleString()}, expected_grade double, tail double")


def accepted(docs: DataFrame, model: Ordinal, threshold: float = ACCEPT, least: int | None = None, text_col="text") -> DataFrame:
    """The documents whose tail probability reaches the threshold, in the input's columns."""
    return grade(docs, model, least, text_col).where(F.col("tail") >= threshold).select("row.*")
