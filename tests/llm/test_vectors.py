"""Clustering and whitening against plain versions."""

import hashlib

import numpy as np
import pytest

from pagescale.llm import clustering, whitening

KIND = "vec_id long, embedding array<float>, label int"


def plain_clusters(rows, k=16, rounds=3, dim=64):
    """(vec_id, cluster, distance) rows and centroids by all distances, in Python integers."""
    x = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in first]

    def assign():
        a = np.array([v for _, v in x], dtype=np.int64).reshape(-1, dim)
        d = np.array([((a - np.array(c)) ** 2).sum(1) for c in cents]).T
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        number, _ = assign()
        for j in range(len(cents)):
            own = [x[i][1] for i in np.flatnonzero(number == j)]
            if own:
                cents[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    number, d = assign()
    return [(i, int(j), int(s)) for (i, _), j, s in zip(x, number, d, strict=True)], cents


@pytest.mark.parametrize("seed,spread", [(1, 0.02), (2, 0.5), (3, 0.0)])
def test_clusters_are_those_of_all_distances(spark, seed, spread):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.3, (9, 64))
    v = (base[rng.integers(0, 9, 700)] + rng.normal(0, spread, (700, 64)) if spread else base[rng.integers(0, 9, 700)]).astype(np.float32)
    rows = [(int(i), r.tolist()) for i, r in enumerate(v)] + [(5, v[5].tolist()), (None, v[6].tolist()), (900, None), (901, [1.0] * 63), (902, [float("nan")] + [0.0] * 63), (903, [None] + [0.0] * 63), (904, [])]
    out, cents = clustering.cluster(spark.createDataFrame([(i, r, 0) for i, r in rows], KIND).withColumnRenamed("label", "cluster").repartition(5))
    want, plain = plain_clusters(rows)
    assert cents.tolist() == plain
    got = out.collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(want, key=key)
    per = {}
    for _, j, d in want:
        per[j] = per.get(j, 0) + d
    for r in got:
        assert (r["cluster_inertia"], r["inertia"]) == (per[r["cluster"]], sum(per.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, plain[r["cluster"]])).encode()).hexdigest()
    if seed == 1:
        assert np.mean([r["computed"] for r in got]) < 4  # bounds leave few of the 16


@pytest.mark.parametrize("lead", [1, 7, 64])
def test_bounds_never_pass_over_the_nearest(lead):
    rng = np.random.default_rng(lead)
    x = rng.integers(-40, 40, (3000, 64)) * rng.integers(0, 2, 64)
    x[:500] = x[0]
    c = x[rng.integers(0, 3000, 40)] + rng.integers(-1, 2, (40, 64))
    c[7] = c[3]
    turn = clustering.Rotation(len(x), x.sum(0).astype(float), (x.T @ x).astype(float), lead)
    number, best, computed = clustering.nearest(x, *turn(x), c, turn)
    d = np.array([((x - r) ** 2).sum(1) for r in c]).T
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all() and computed.mean() <= 40


def test_small_and_empty_tables(spark):
    few = [(i, [float(i % 2)] * 64, 0) for i in range(5)]
    out, cents = clustering.cluster(spark.createDataFrame(few, KIND))
    assert len(cents) == 5 and sorted((r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()) == sorted(plain_clusters([r[:2] for r in few])[0])
    for fn in (lambda d: clustering.cluster(d)[0], whitening.whiten):
        got = fn(spark.createDataFrame([(1, None, 0)], KIND))
        assert got.collect() == [] and got.columns[0] == "vec_id"
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e9] * 64, 0)], KIND))


@pytest.mark.parametrize("kind", ["plain", "clustered", "wide", "flat", "pairs"])
def test_spectrum(kind):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    e = {"plain": rng.random(48), "clustered": np.r_[np.full(20, 3.0), np.full(27, 1.0), 2.0], "wide": 10.0 ** -rng.uniform(0, 14, 48), "flat": np.r_[rng.random(5), np.zeros(43)], "pairs": np.repeat(rng.random(24), 2)}[kind]
    a = (q * e) @ q.T
    got, v = whitening.spectrum((a + a.T) / 2)
    assert np.abs(v.T @ v - np.eye(48)).max() < 1e-13
    assert np.abs(got - np.sort(e)[::-1]).max() < 1e-13 and np.abs(a @ v - v * got).max() < 1e-13
    assert np.abs(whitening.polar(a - 0.5 * np.eye(48)) - (q * np.sign(e - 0.5)) @ q.T).max() < 1e-10 or kind == "wide"


@pytest.mark.parametrize("dim,n,most", [(24, 900, 32), (64, 400, 32), (5, 40, 3), (64, 20, 32)])
def test_whitening(spark, dim, n, most):
    rng = np.random.default_rng(dim + n)
    v = (rng.standard_normal((n, dim)) * rng.uniform(0.1, 2, dim) + 0.3 * rng.standard_normal((n, 1))).astype(np.float32)
    rows = [(i, r.tolist(), 0) for i, r in enumerate(v)] + [(None, v[3].tolist(), 0), (4, v[4].tolist(), 0), (n, None, 0), (n + 1, [float("inf")] * dim, 0), (n + 2, [None] * dim, 0), (n + 3, [], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, KIND).withColumnRenamed("label", "n").repartition(4), most).collect()
    x = np.floor(64 * np.r_[v, v[3:5]].astype(float)).astype(np.int64) + 1_000_000
    m, s = len(x), x.sum(0)
    y = (m * x - s) / m
    e, q = np.linalg.eigh(y.T @ y / m)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, dim, n - 1)
    dev = ((m * x - s) ** 2).sum(1)
    ids = list(range(n)) + [None, 4]
    assert len(got) == m * k
    first = {}
    for r in got:
        first.setdefault((r["vec_id"], r["component"]), r)
        assert r["n"] == m and r["identity_error"] < 1e-4
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9
    w = y @ q[:, :k] / np.sqrt(e[:k])
    mine = np.array([[first[(i, c)]["whitened"] for c in range(1, k + 1)] for i in ids])
    sign = np.sign((mine * w).sum(0))
    assert np.abs(mine * sign - w).max() < 1e-6
    assert [first[(i, 1)]["deviation"] for i in ids] == dev.tolist()


def test_lengths_are_spaces_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(3 + i % 3).astype(np.float32).tolist(), 0) for i in range(90)] + [(1000, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, KIND)
    want = sorted(tuple(r) for r in whitening.whiten(df).select("vec_id", "component", "n", "deviation").collect())
    assert len(want) == 30 * (3 + 4 + 5) and {r[2] for r in want} == {30}
    monkeypatch.setattr(whitening, "BLOCK", 1)
    assert sorted(tuple(r) for r in whitening.whiten(df).select("vec_id", "component", "n", "deviation").collect()) == want


def test_exact_deviation_beyond_64_bits_of_the_steps():
    w = whitening.Whitening(3, np.array([3, 0]), np.eye(2), 2)
    big = np.array([[2**61, 5]])
    assert w.deviation(big) == [(3 * 2**61 - 3) ** 2 + 15**2]
