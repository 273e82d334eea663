"""Rates for skewed targets against a brute-force solver; null ids through the draw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagescale.llm import linear, mixing

SKEWED = [([0.9, 0.08, 0.02], [0.2, 0.3, 0.5]), ([0.6, 0.3, 0.1], [0.97, 0.02, 0.01]), ([0.6, 0.3, 0.1], [0.1, 0.8, 0.1])]


def corpus(natural, n=30_000, sharp=6.0, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.choice(len(natural), n, p=natural)
    s = rng.standard_normal((n, len(natural)))
    s[np.arange(n), y] += sharp
    return linear.softmax(s + np.log(natural)), rng.integers(20, 400, n).astype(float)


def plain_totals(p, t):
    def totals(tried):
        out = []
        for x in tried:
            r = np.maximum(0, 1.0 - p @ x)
            out.append(((r * t) @ p, (p * (t * (r > 0))[:, None]).T @ p, float((t * r) @ r)))
        return out
    return totals


@pytest.mark.parametrize("natural,target", SKEWED)
@pytest.mark.parametrize("sharp", [1.5, 3.0, 6.0])
def test_skewed_targets_are_met(natural, target, sharp):
    p, t = corpus(natural, sharp=sharp)
    passes = []
    totals = lambda tried: passes.append(1) or plain_totals(p, t)(tried)
    x, reached = mixing.descend(totals, (p * t[:, None]).T @ p, t.sum() * np.array(target), t.sum(), mixing.TOLERANCE * t.sum())
    assert np.abs(reached / t.sum() - target).max() <= mixing.TOLERANCE and len(passes) <= 40
    assert np.allclose(reached, (np.maximum(0, 1 - p @ x) * t) @ p)


def test_targets_out_of_reach_come_as_near_as_brute_force():
    p, t = corpus([0.6, 0.3, 0.1], 400)
    p = 0.7 * p + 0.1  # no text is purer than 0.8
    w, target = t / t.sum(), np.array([0.95, 0.03, 0.02])
    m = (p * w[:, None]).T @ p
    white = np.linalg.inv(np.linalg.cholesky(m))
    _, reached = mixing.descend(plain_totals(p, t), (p * t[:, None]).T @ p, t.sum() * target, t.sum(), mixing.TOLERANCE * t.sum())
    a = white @ (p * np.sqrt(w)[:, None]).T  # unknowns are r * sqrt(w); the ridge is a row for each
    full = np.vstack([a, np.sqrt(mixing.RIDGE) * np.eye(len(t))])
    goal = np.r_[white @ target, np.sqrt(mixing.RIDGE) * np.sqrt(w)]
    best = last = np.zeros(len(t))
    for k in range(200_000):  # accelerated projected gradient on the rates themselves
        y = best + k / (k + 3) * (best - last)
        last, best = best, np.maximum(0, y - full.T @ (full @ y - goal) / 1.01)
    assert np.abs(reached / t.sum() - p.T @ (best * np.sqrt(w))).max() <= 1e-5
    assert np.abs(reached / t.sum() - target).max() > mixing.TOLERANCE


def test_skewed_fit_over_a_table(spark):
    p, t = corpus([0.9, 0.08, 0.02], 3000)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "tokens long, posteriors array<double>").repartition(4)
    fit = mixing.fit_rates(table, ["a", "b", "c"], {"a": 0.2, "b": 0.3, "c": 0.5})
    assert np.abs(fit.reached - fit.target).max() <= mixing.TOLERANCE * t.sum()
    assert np.allclose((fit.rates(p) * t) @ p, fit.reached) and (fit.rates(p) >= 0).all()


def test_rows_without_an_id_are_drawn(spark, docs):
    d = docs((None, "a"), (None, "b"), (None, "c d"), (None, "c d"), (1, "a"), (2, None), (None, None))
    rate = {"a": 2.0, "b": 0.0, "c d": 1.0, None: 3.0}
    rates = d.select("doc_id", mixing.text_key("text").alias("text_key"), "text").collect()
    rates = spark.createDataFrame([(r.doc_id, r.text_key, rate[r.text]) for r in rates], "doc_id long, text_key long, rate double")
    got = mixing.draw(d, rates)
    assert got.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(0, "a")] * 2 + [(0, "c d")] * 2 + [(1, "a")] * 2 + [(2, "")] * 3 + [(0, "")] * 3)


def test_rows_without_an_id_pass_the_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    some = table.where("doc_id < 20").withColumn("doc_id", F.lit(None).cast("bigint"))
    mixed = corpus_pipeline.secret_scan(spark, corpus_pipeline.near_duplicates(spark, table.unionByName(some), sf), sf)
    n = lambda out: {(r.doc_id is None, r.text): r["count"] for r in out.groupBy("doc_id", "text").count().collect()}
    drawn = n(corpus_pipeline.mixture(spark, mixed, sf))
    texts = {r.text for r in some.collect()}
    assert len([t for t in texts if (True, t) in drawn]) >= 0.7 * len(texts)
