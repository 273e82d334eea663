"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow the regularised leader with an elastic net on a bounded sample
(``PER_LANGUAGE`` whole texts of each language), a fifth of which is kept apart to fit the temperature
of the probabilities. Every whole text is scored.

Defined cases: a null text or one without letters is ``und`` with score 0, as is every text when no
row is labelled; null labels and null ids are not learned from; ties go to the first
language in alphabetical order; repeated rows are scored alike; an empty table gives an
empty result; older columns ``lang_pred`` and ``score`` are replaced, others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale.llm import linear

DIM = 2**15
PER_LANGUAGE = 1000  # labelled texts of each language that are learned from
NONE = "und"


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # (DIM, classes), mostly zero
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def probabilities(self, row: linear.Counts) -> np.ndarray:
        f, v = linear.weigh(row, self.idf)
        return linear.softmax((v @ self.weights[f] + self.bias) / self.temperature)


def train(docs: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    features = linear.CharFeatures(DIM)
    labels, rows = linear.labelled_sample(docs, id_col, text_col, docs.select(F.col(id_col).alias("id"), label.cast("string").alias("label")), per_language, features)
    some = [i for i, r in enumerate(rows) if len(r[0])]
    labels, rows = [labels[i] for i in some], [rows[i] for i in some]
    classes = sorted(set(labels))
    y = np.array([classes.index(x) for x in labels], int)
    idf = linear.inverse_frequency(rows, DIM)
    rows = [linear.weigh(r, idf) for r in rows]
    apart = np.random.default_rng(3).random(len(rows)) < 0.2
    fit = np.flatnonzero(~apart)
    w, b = linear.ftrl([rows[i] for i in fit], y[fit], len(classes), DIM)
    scores = np.array([rows[i][1] @ w[rows[i][0]] + b for i in np.flatnonzero(apart)]).reshape(int(apart.sum()), len(classes))
    return Model(classes, w.astype(np.float32), b, idf.astype(np.float32), linear.temperature(scores, y[apart]))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the calibrated probability)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages weights

    def make():
        own, features = sent.value, linear.CharFeatures(DIM)

        def run(texts):
            names, scores = [], []
            for t in texts.to_pylist():
                row = features(t)
                p = own.probabilities(row) if len(row[0]) and own.classes else np.zeros(0)
                names.append(own.classes[int(p.argmax())] if len(p) else NONE)
                scores.append(float(min(1.0, p.max())) if len(p) else 0.0)
            return [names, scores]

        return run

    return linear.with_scores(docs, text_col, [("lang_pred", "string"), ("score", "double")], make)


def held_out(id_col: str = "doc_id") -> Column:
    """A third of the ids, by checksum, that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, the model being learned from the rest of their labels."""
    model = train(docs.where(~held_out(id_col)), F.col(label_col), id_col, text_col)
    return predict(docs.withColumn("held_out", held_out(id_col)), model, text_col)
