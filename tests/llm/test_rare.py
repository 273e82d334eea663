"""Marks of a rare class beside large ones."""

import random

import numpy as np

from pagescale.llm import linear, quality


def test_a_rare_grade_keeps_its_marks():
    rnd, features = random.Random(3), linear.WordFeatures(quality.DIM)
    y = np.repeat([0, 1, 2], [75, 4000, 4000])
    fill = [f"word{k}" for k in range(300)]
    rows = [features(" ".join([*rnd.sample(fill, 20), *(["zqawful"] if g == 0 else [])])) for g in y]
    idf = linear.inverse_frequency(rows, quality.DIM, quality.COMMON, y)
    assert linear.weigh(features("zqawful"), idf)[0].size
    w, theta = quality.fit([linear.weigh(r, idf, quality.LENGTH) for r in rows], y, 3)
    model = quality.Model([0, 1, 2], w, theta, idf)
    held = lambda more: model.tails(features(" ".join([*rnd.sample(fill, 20), *more])))[0]
    assert np.mean([held(["zqawful"]) < 0.5 for _ in range(50)]) >= 0.95 and np.mean([held([]) >= 0.5 for _ in range(50)]) >= 0.95


def test_scores_of_a_batch_are_those_of_each_text():
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(5)
    words = ["River", "stone,", "GARDEN", "a", "\u00e9t\u00e9", "12-34", "||", "x" * 300 + "Y" * 300, "\x1cq", "(end)"]
    texts = [" ".join(rnd.choice(words, rnd.integers(0, 40))) for _ in range(70)] + [None, "", " \n ", "stone stone  stone"]
    f = linear.WordFeatures(512)
    idf, w = np.where(rnd.random(512) < 0.5, rnd.random(512), 0).astype(np.float32), rnd.standard_normal((512, 3)).astype(np.float32)
    for rows, cells in ((2048, 2**24), (7, 10)):
        f.ROWS, f.CELLS = rows, cells
        s, n = f.scores(pa.array(texts, pa.string()), idf, 4.0, w)
        for t, own, k in zip(texts, s, n, strict=True):
            at, v = linear.weigh(f(t), idf.astype(float), 4.0)
            assert np.allclose(own, v @ w[at].astype(float)) and k == len((t or "").split())
    assert f._word("x" * 64 + "1") != f._word("x" * 64)  # whole words, not their beginnings
    assert f.scores(pa.array(["a"]), idf, 4.0, np.zeros((512, 0)))[0].shape == (1, 0)


def test_the_sample_of_a_hot_label_is_cut_before_it_is_ranked(spark, docs):
    d = docs(*[(i, f"w{i}") for i in range(3000)])
    labels = spark.createDataFrame([(i, "hot" if i % 50 else "rare") for i in range(3000)], "id long, label string")
    got, rows = linear.labelled_sample(d, "doc_id", "text", labels, 20, linear.WordFeatures(64))
    assert got.count("hot") == 20 and got.count("rare") == 20 and len(rows) == 40
