"""Quality classifier: ordinal (cumulative-link) regression on graded ratings.

One vector of hashed-text weights w is shared by all grades, ordered thresholds part them:
P(grade <= k) = sigmoid(theta_k - w.x). A text gets its expected grade and the tail
probabilities P(grade >= k), on which selections are made. Thresholds are kept in order by
positive gaps. Fitted with full gradient steps on a bounded sample (``PER_GRADE`` whole
texts of each grade); all texts are scored.

Defined cases: a null or blank text has no features and gets what the thresholds alone say; null grades
and ids are not learned from; with fewer than two grades the expected grade is that grade (or null) and tails are 1 or 0;
repeated rows are scored alike; an empty table gives an empty result; older columns of the added names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.llm import linear

DIM = 2**18
PER_GRADE = 4000  # rated texts of each grade that are learned from
COMMON = 0.01  # features in a smaller share of the sample and of every grade are not used: they only name single texts
LENGTH = 4.0  # of a feature vector


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    theta: np.ndarray
    idf: np.ndarray

    def tails(self, row: linear.Counts) -> np.ndarray:
        """P(grade >= k) for the second grade on."""
        f, v = linear.weigh(row, self.idf, LENGTH)
        return _sigmoid(v @ self.weights[f] - self.theta)

    def tails_of(self, texts: pa.Array, features: linear.WordFeatures) -> np.ndarray:
        """``tails`` of each text."""
        s, _ = features.scores(texts, self.idf, LENGTH, self.weights)
        return _sigmoid(s - self.theta[None, :])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[linear.Counts], y: np.ndarray, grades: int, steps: int = 300, rate: float = 0.05, l2: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch gradient steps with moment estimates. Rows of a
    grade weigh by the inverse root of its size, so rare grades count."""
    f, v = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    cols, at = np.unique(f, return_inverse=True)
    n, k, inner = len(rows), len(cols), grades - 1
    c = np.sqrt(n / grades / np.maximum(np.bincount(y, minlength=grades), 1))[y]
    c /= c.sum()
    share = np.cumsum(np.bincount(y, weights=c, minlength=grades))[:-1]
    logit = np.log(share / (1 - share))
    p = np.r_[np.zeros(k), logit[0], np.log(np.maximum(np.diff(logit), 1e-2))]  # weights, first threshold, log gaps
    mean, square = np.zeros_like(p), np.zeros_like(p)
    top, low = np.minimum(y, inner - 1), np.maximum(y - 1, 0)
    for t in range(1, steps + 1):
        gaps = np.exp(p[k + 1 :])
        theta = np.cumsum(np.r_[p[k], gaps])
        s = np.bincount(row, v * p[:k][at], n)
        hi = np.where(y < inner, _sigmoid(theta[top] - s), 1.0)
        lo = np.where(y > 0, _sigmoid(theta[low] - s), 0.0)
        prob = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        g_w = np.bincount(at, v * (c * (dhi - dlo) / prob)[row], k) + l2 * p[:k]
        g_t = np.bincount(top, np.where(y < inner, -c * dhi / prob, 0), inner) + np.bincount(low, np.where(y > 0, c * dlo / prob, 0), inner)
        back = np.cumsum(g_t[::-1])[::-1]  # a threshold holds the first one and all gaps up to it
        g = np.r_[g_w, back[0], back[1:] * gaps]
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        p -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    w = np.zeros(DIM)
    w[cols] = p[:k]
    return w, np.cumsum(np.r_[p[k], np.exp(p[k + 1 :])])


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_grade: int = PER_GRADE) -> Model:
    """Learned from the texts whose id has a ``grade`` in ``graded``."""
    known = graded.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("label"))
    labels, rows = linear.labelled_sample(docs, id_col, text_col, known, per_grade, linear.WordFeatures(DIM))
    grades = sorted(set(labels))
    y = np.array([grades.index(x) for x in labels], int)
    idf = linear.inverse_frequency(rows, DIM, COMMON, y)
    if len(grades) < 2:
        return Model(grades, np.zeros(DIM, np.float32), np.zeros(0), idf.astype(np.float32))
    w, theta = fit([linear.weigh(r, idf, LENGTH) for r in rows], y, len(grades))
    return Model(grades, w.astype(np.float32), theta, idf.astype(np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``p_ge_<grade>`` for the second grade on."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    tails = [f"p_ge_{g}" for g in model.grades[1:]]

    def make():
        own, features = sent.value, linear.WordFeatures(DIM)
        steps = np.diff(own.grades)

        def run(texts):
            p = own.tails_of(texts, features)
            first = own.grades[0] if own.grades else None
            expected = [None if first is None else float(first + (x * steps).sum()) for x in p]
            return [expected, *[[float(x[k]) for x in p] for k in range(len(tails))]]

        return run

    return linear.with_scores(docs, text_col, [("expected_grade", "double"), *[(t, "double") for t in tails]], make)


def rate(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of all documents by a model of the ``graded`` ones (id, grade)."""
    return score(docs, train(docs, graded, id_col, text_col), text_col)
