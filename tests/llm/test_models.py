"""Learned operators: held-out accuracy, odd rows, targets; and the pipeline."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pagescale.llm import langid, linear, mixing, quality, registered

SF = "/root/testdata/sf0.01"
ODD = [(9001, None), (9002, ""), (9003, "12 34 !!"), (9004, "the " * 20000), (None, "le la les des une"), (9005, "der die das"), (9005, "der die das")]


def test_language_accuracy_and_odd_rows(spark, docs):
    table = registered.table(spark, SF, "documents")
    out = langid.identify(table.unionByName(docs(*ODD))).cache()
    share = out.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share >= 0.98
    odd = {r.doc_id: r for r in out.where("doc_id > 9000").collect()}
    assert all((odd[i].lang_pred, odd[i].score) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert out.where("score < 0 or score > 1").isEmpty() and out.count() == table.count() + len(ODD)
    assert set(table.columns) < set(out.columns)


def test_language_without_labels(spark, docs):
    out = langid.identify(docs(*ODD).withColumn("score", F.lit("clash")))
    assert {r.lang_pred for r in out.collect()} == {"und"} and dict(out.dtypes)["score"] == "double"
    assert langid.identify(docs((1, "x")).limit(0)).collect() == []


def test_character_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Über den   Wolken, 12 muß die Freiheit wohl grenzenlos sein" * 5
    whole = linear.CharFeatures(2**15)(text)
    monkeypatch.setattr(linear.CharFeatures, "CHUNK", 7)
    parts = linear.CharFeatures(2**15)(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    s = rng.standard_normal((400, 3)) * 8
    s[np.arange(400), y] += 4
    t = linear.temperature(s, y)
    loss = lambda k: -np.log(linear.softmax(s / k)[np.arange(400), y]).mean()
    assert loss(t) <= min(loss(1.0), loss(t * 1.2), loss(t / 1.2))


def graded(spark, docs, n=400):
    rnd = random.Random(4)
    rows, grades = [], []
    for i in range(n):
        g = i % 3
        w = [rnd.choice("lorem ipsum dolor sit amet sed quia".split()) for _ in range(rnd.randint(20, 60))]
        w += [["awful", "nasty"], ["###", "|"], []][g] * 2
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        grades.append((i, g))
    return docs(*rows), spark.createDataFrame(grades, "doc_id long, grade int")


def test_quality_orders_held_out_grades(spark, docs):
    d, g = graded(spark, docs)
    model = quality.train(d.where("doc_id < 300"), g)
    assert np.all(np.diff(model.theta) > 0)
    out = quality.score(d.where("doc_id >= 300"), model).join(g, "doc_id").collect()
    assert np.mean([round(r.expected_grade) == r.grade for r in out]) >= 0.95
    assert all(0 <= r.p_ge_2 <= r.p_ge_1 <= 1 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 for r in out)
    odd = quality.score(docs(*ODD), model)
    assert odd.count() == len(ODD) and odd.where("expected_grade is null").isEmpty()


def test_quality_on_labels_and_with_one_grade(spark, docs):
    out = registered.op4(spark, SF).join(registered.table(spark, SF, "labels"), "doc_id")
    r = {x.toxic: x for x in out.groupBy("toxic").agg(F.avg("expected_grade").alias("e"), F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert r[0].e > r[1].e + 1 and r[0].k > 0.98 and r[1].k < 0.3
    one = quality.rate(docs(*ODD), spark.createDataFrame([(9004, 2)], "doc_id long, grade int"))
    assert {x.expected_grade for x in one.collect()} == {2.0}
    none = quality.rate(docs(*ODD), spark.createDataFrame([], "doc_id long, grade int"))
    assert {x.expected_grade for x in none.collect()} == {None}


def test_mixing_reaches_the_targets(spark, docs):
    d, g = graded(spark, docs)
    label = g.select("doc_id", F.concat(F.lit("d"), "grade").alias("domain"))
    out, fit = mixing.mix(d, label, {"d0": 0.1, "d1": 0.3, "d2": 0.6})
    rows = out.collect()
    p, t, r = np.array([x.posteriors for x in rows]), np.array([x.tokens for x in rows]), np.array([x.rate for x in rows])
    reached = (r * t) @ p
    assert np.abs(reached - fit.target).max() <= mixing.TOLERANCE * t.sum() * 1.01 and (r >= 0).all()
    assert np.abs(reached - fit.reached).max() < 1e-6 * t.sum()
    drawn = mixing.draw(d, out)
    assert drawn.columns == d.columns
    n = {x.doc_id: x["count"] for x in drawn.groupBy("doc_id").count().collect()}
    assert all(int(x.rate) <= n.get(x.doc_id, 0) <= int(x.rate) + 1 for x in rows)


def test_mixing_odd_rows(spark, docs):
    d, g = graded(spark, docs, 60)
    label = g.select("doc_id", F.concat(F.lit("d"), "grade").alias("domain"))
    out, _ = mixing.mix(d.unionByName(docs(*ODD)), label, {"d0": 1.0, "unknown": 1.0})
    assert out.count() == 60 + len(ODD) and out.where("rate < 0 or rate is null").isEmpty()
    assert {r.tokens for r in out.where("doc_id in (9001, 9002)").collect()} == {0}
    none, fit = mixing.mix(docs(*ODD), label.limit(0), {"d0": 1.0})
    assert {r.rate for r in none.collect()} == {1.0} and fit.domains == []
    assert mixing.mix(docs((1, "x")).limit(0), label, {"d0": 1.0})[0].collect() == []


def test_pipeline(spark, tmp_path):
    """The stages on the given table and odd rows, each against what it must keep."""
    table = registered.table(spark, SF, "documents")
    odd = spark.createDataFrame([(50001, None, None, "s", 0), (50002, "", None, "s", 0), (50003, "1 2 3", None, "s", 5)], table.schema)
    docs = table.unionByName(odd).unionByName(table.where("doc_id = 3"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
    lang, near, secret, mix, tok = seen
    assert all(x.columns == table.columns for x in seen[:4])
    assert {r.doc_id for r in table.select("doc_id").collect()} == {r.doc_id for r in lang.select("doc_id").collect()}  # only odd rows go
    import test_copies
    want, _, _ = test_copies.plain_classes([(r.doc_id, r.text) for r in lang.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(want.values()))
    import test_texts
    assert secret.count() == near.count() and not any(test_texts.spans(r.text) for r in secret.collect())
    bad = {r.doc_id for r in registered.table(spark, SF, "labels").where("toxic = 1").collect()}
    good = {r.doc_id for r in registered.table(spark, SF, "labels").where("toxic = 0").collect()}
    n = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    start = {r.doc_id for r in near.collect()}
    assert len([i for i in good & start if i in n]) >= 0.95 * len(good & start)
    assert len([i for i in bad & start if i not in n]) >= 0.5 * len(bad & start)
    assert tok.count() == mix.count() and tok.where("decoded_sha256 is null or length(ids) <> 4 * n_tokens").isEmpty()
