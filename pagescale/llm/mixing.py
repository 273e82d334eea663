"""Mixing to target weights with soft memberships.

A multinomial classifier, learned from a labelled table, gives every document posteriors over the
domains. Among the rates r >= 0 whose expected domain tokens s = sum r_i tokens_i p_i come to the
targets, the ones nearest to equal rates r0 are fitted:

    least  RIDGE / 2 * sum tokens_i (r_i - r0)^2 + 1/2 (s - target) M^-1 (s - target)

with M, the token-weighted mean of p p', so that all domains, however small, weigh the same. The
solution is r_i = max(0, r0 - p_i . x) for one vector x of as many numbers as domains, the least point of
a convex dual function; Newton steps find it. A step is one aggregation over the table
of posteriors that tries several lengths (their sums go to the driver), and no table
of rates is ever rewritten or lost. Steps end when the residual is below ``TOLERANCE`` of the budget in every
domain, or when the dual gradient vanishes: then the residual is the least that rates can
reach, up to the ridge, however slowly it fell before. Where it is not below the tolerance, the ridge is
lowered as far as ``LEAST`` to see whether the targets are within reach; if none of that meets them, they
are not, and the first fit stays, as a lower ridge only puts huge rates on few texts.

Defined cases: null or blank texts have 0 tokens and the classifier's prior; null labels and ids are not
learned from; a target for a domain that no label names cannot be met and is left as residual;
without labels or tokens all rates are 1; repeated rows are rated alike; an empty table
gives an empty result; older columns of the added names are replaced, others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale.llm import linear
from pagescale.session import materialise

DIM = 2**18
PER_DOMAIN = 3000  # labelled texts of each domain that are learned from
COMMON = 0.005  # features in a smaller share of the sample and of every domain are not used
TOLERANCE = 1e-3  # of the budget, for each domain
RIDGE, LEAST = TOLERANCE**2, TOLERANCE**2 * 1e-6  # weight of unequal rates beside the squared residual
EXACT = 1e-9  # dual gradient, whitened, at which a fit is optimal
LENGTHS = (1.0, 0.5, 0.25, 0.125, 1 / 32, 1 / 256)  # of a Newton step, tried in one pass


@dataclass
class Fit:
    """The domains, the step vectors that define the rates, and how close they came."""

    domains: list[str]
    start: float
    steps: list[np.ndarray] = field(default_factory=list)
    natural: np.ndarray | None = None  # expected domain tokens at rate 1
    reached: np.ndarray | None = None
    target: np.ndarray | None = None

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.full(len(p), self.start)
        for g in self.steps:
            r = np.maximum(0.0, r - p @ g)
        return r


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def posteriors_of(self, texts: pa.Array, features: linear.WordFeatures) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, and its number of words."""
        s, words = features.scores(texts, self.idf, 4.0, self.weights)
        return (linear.softmax((s + self.bias) / self.temperature) if self.domains else s), words


def classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_domain: int = PER_DOMAIN) -> Classifier:
    """Learned from the texts whose id has a ``domain`` in ``labelled``; a fifth of the sample sets the temperature."""
    known = labelled.select(F.col(id_col).alias("id"), F.col("domain").cast("string").alias("label"))
    labels, rows = linear.labelled_sample(docs, id_col, text_col, known, per_domain, linear.WordFeatures(DIM))
    domains = sorted(set(labels))
    y = np.array([domains.index(x) for x in labels], int)
    idf = linear.inverse_frequency(rows, DIM, COMMON, y)
    rows = [linear.weigh(r, idf, 4.0) for r in rows]
    apart = np.random.default_rng(3).random(len(rows)) < 0.2
    fit = np.flatnonzero(~apart)
    w, b = linear.ftrl([rows[i] for i in fit], y[fit], len(domains), DIM, alpha=0.1, l1=0.3, l2=1.0)
    scores = np.array([rows[i][1] @ w[rows[i][0]] + b for i in np.flatnonzero(apart)]).reshape(int(apart.sum()), len(domains))
    return Classifier(domains, w.astype(np.float32), b, idf.astype(np.float32), linear.temperature(scores, y[apart]))


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` (words) and ``posteriors`` (in the order of the model's domains)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own, features = sent.value, linear.WordFeatures(DIM)

        def run(texts):
            p, words = own.posteriors_of(texts, features)
            return [words, p.tolist()]

        return run

    return linear.with_scores(docs, text_col, [("tokens", "bigint"), ("posteriors", "array<double>")], make)


def _totals(table: DataFrame, fit: Fit, tried: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each vector that ``tried`` has as the only step: expected domain tokens, the sums of tokens p p' of
    the rows with a rate, and of tokens r^2. Without ``tried`` for the rates as they are."""
    d = len(fit.domains)
    fits = [fit] if tried is None else [Fit(fit.domains, fit.start, [x]) for x in tried]
    size = d + d * d + 1

    def run(batches):
        sums = np.zeros((len(fits), size))
        for b in batches:
            p = b.column(1).flatten().to_numpy().reshape(-1, d)
            t = b.column(0).to_numpy().astype(float)
            for k, f in enumerate(fits):
                r = f.rates(p)
                sums[k] += np.r_[(r * t) @ p, ((p * (t * (r > 0))[:, None]).T @ p).ravel(), (t * r) @ r]
        yield pa.RecordBatch.from_arrays([pa.array(range(sums.size), pa.int32()), pa.array(sums.ravel())], ["k", "x"])

    sums = dict(table.select("tokens", "posteriors").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x")).collect())
    flat = np.array([sums.get(k, 0.0) for k in range(len(fits) * size)]).reshape(len(fits), size)
    return [(x[:d], x[d:-1].reshape(d, d), float(x[-1])) for x in flat]


def fit_rates(table: DataFrame, domains: list[str], weights: dict[str, float], budget: float | None = None) -> Fit:
    """Fit over a written table with ``tokens`` and ``posteriors``. ``weights`` are the target
    shares of the domains, ``budget`` the tokens to reach (all tokens if not given)."""
    fit = Fit(domains, 1.0)
    if not domains:
        return fit
    ((natural, moments, _),) = _totals(table, fit)
    total = natural.sum()
    fit.natural, budget = natural, total if budget is None else budget
    share = np.array([weights.get(d, 0.0) for d in domains])
    fit.target = budget * share / (sum(weights.values()) or 1.0)
    fit.reached = natural
    if not total:
        return fit
    fit.start = budget / total
    x, fit.reached = descend(lambda tried: _totals(table, fit, tried), moments, fit.target, total, TOLERANCE * budget)
    fit.steps.append(x)
    return fit


def descend(totals, moments: np.ndarray, target: np.ndarray, total: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The vector x of the rates, and what they reach: ``most`` off the target, or as near as rates come.
    ``totals`` maps vectors to what ``_totals`` gives."""
    m = moments / total + 1e-9 * np.eye(len(target))
    goal, root = target / total, np.linalg.cholesky(m)
    met = lambda found: np.abs(found[0] - target).max() <= most

    def value(x, found, ridge):
        s, h, square = found
        g = goal - s / total + ridge * (m @ x)
        return square / total / 2 + x @ goal + ridge / 2 * x @ m @ x, g, h / total + ridge * m

    def newton(x, found, ridge):
        scale = 1.0
        while True:
            f, g, h = value(x, found, ridge)
            if met(found) or np.linalg.norm(np.linalg.solve(root, g)) <= EXACT * goal.sum():
                return x, found
            step = -np.linalg.solve(h, g)
            tried = [x + a * scale * step for a in LENGTHS]
            seen = totals(tried)
            fs = [value(y, s, ridge)[0] for y, s in zip(tried, seen, strict=True)]
            k = int(np.argmin(fs))
            if fs[k] < f:
                x, found, scale = tried[k], seen[k], 1.0
            elif scale * np.abs(step).max() <= 1e-12 * max(1.0, np.abs(x).max()):
                return x, found  # no length is better in double precision
            else:
                scale *= LENGTHS[-1] / 2

    x = np.zeros(len(target))
    first = last = newton(x, totals([x])[0], RIDGE)
    ridge = RIDGE / 100
    while not met(last[1]) and ridge >= LEAST * 0.99:
        last, ridge = newton(*last, ridge), ridge / 100
    x, found = last if met(last[1]) else first
    return x, found[0]


def with_rates(table: DataFrame, fit: Fit) -> DataFrame:
    """``table`` (with ``posteriors``) and the ``rate`` of each row."""
    columns = [c for c in table.columns if c != "rate"]
    at = columns.index("posteriors")
    d = len(fit.domains)
    base = table.select(columns)

    def run(batches):
        for b in batches:
            p = b.column(at).flatten().to_numpy().reshape(b.num_rows, d)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fit.rates(p))], [*columns, "rate"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("rate", T.DoubleType())]))


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def mix(docs: DataFrame, labelled: DataFrame, weights, budget=None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Fit]:
    """(id, text_key, tokens, posteriors, rate) of every document, and the fit. ``weights`` (shares by domain) and
    ``budget`` (tokens) can be functions of the natural domain tokens (a dict). ``text_key`` tells rows of one id apart."""
    model = classifier(docs, labelled, id_col, text_col)
    table = with_posteriors(docs.select(id_col, text_col), model, text_col)
    table = materialise(table.select(id_col, text_key(text_col).alias("text_key"), "tokens", "posteriors"))
    if callable(budget) or callable(weights):
        start = _totals(table, Fit(model.domains, 1.0))[0][0] if model.domains else np.zeros(0)
        natural = dict(zip(model.domains, start.tolist(), strict=True))
        weights, budget = (x(natural) if callable(x) else x for x in (weights, budget))
    fit = fit_rates(table, model.domains, weights, budget)
    return with_rates(table, fit), fit


def draw(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", seed: int = 11, text_col: str = "text", most: int | None = None) -> DataFrame:
    """Each document as often as its rate says: the whole part always, the rest by a fixed draw of its id; with
    ``most`` no more often than that. A row's rate is that of its id and text; rows without an id are drawn by their texts."""
    key, fixed = F.col("key"), F.lit(seed)
    times = rates.select(F.col(id_col).alias("id"), F.col("text_key").alias("key"), "rate").groupBy("id", "key").agg(F.max("rate").alias("rate"))
    u = F.pmod(F.when(F.col("id").isNull(), F.xxhash64(key, fixed)).otherwise(F.xxhash64("id", fixed)), F.lit(2**30)) / F.lit(float(2**30))
    n = F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    times = times.withColumn("n", (n if most is None else F.least(n, F.lit(most))).cast("int")).where("n > 0").toDF("id2", "key2", "rate", "n")
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.struct(*docs.columns).alias("row"))
    both = rows.join(times.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("id2")) & F.col("key").eqNullSafe(F.col("key2")))
    return both.select("row", F.explode(F.sequence(F.lit(1), "n"))).select("row.*")
