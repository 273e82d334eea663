"""SimHash, embeddings and top-k against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from pagescale.llm import embdedup, simhash, topk


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


TEXTS = [(1, "A b c d"), (2, "a B c d"), (3, None), (4, ""), (5, " \t\n "), (6, "one two"), (7, "one"), (8, "É é x y z"), (8, "É é x y z"), (9, "w " * 3000), (10, "a b c d"), (11, "\x0b\x0ca\x1cb c")]


def test_fingerprints_and_classes(spark, docs):
    rnd = random.Random(1)
    base = [rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(400)]
    rows = list(TEXTS)
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(400)] = "x" + str(rnd.randrange(9))
        rows.append((100 + i, " ".join(w)))
    got = simhash.near_duplicates(docs(*rows)).collect()
    fp = {i: plain_fingerprint(t) for i, t in rows}
    want = classes(sorted(fp), [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3])
    assert len(got) == len(rows)
    for r in got:
        assert (int(r.fingerprint, 16), r.component_id, r.kept) == (fp[r.doc_id], want[r.doc_id], r.doc_id == want[r.doc_id]), r


@pytest.mark.parametrize("seed,hot", [(1, 16384), (2, 16384), (3, 3), (4, 10)])
def test_every_pair_within_the_radius_is_linked(spark, seed, hot):
    rnd = random.Random(seed)
    fps = {rnd.getrandbits(64) for _ in range(30)}
    for f in list(fps)[:10]:
        for _ in range(8):
            g = f
            for _ in range(rnd.randint(1, 5)):
                g ^= 1 << rnd.randrange(64)
            fps.add(g)
    fps = [simhash._signed(f) for f in sorted(fps)]
    table = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, rep long")
    rows = simhash._bucket_rows(table, 3)
    big = rows.groupBy("t", "key").count().where(f"count > {hot}").select("t", "key")
    edges = simhash._edges(rows.join(big, ["t", "key"], "left_anti"), 3).unionByName(simhash._edges(simhash._cover_again(rows.join(big, ["t", "key"], "left_semi"), 3), 3))
    got = classes(range(len(fps)), [(r.u, r.v) for r in edges.collect()])
    want = classes(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= 3])
    assert got == want


@pytest.mark.parametrize("small", [0, 2, 64])
def test_links_of_buckets(monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(small)
    base = rng.integers(-(2**63), 2**63 - 1, 12, dtype=np.int64)
    group = np.sort(rng.integers(0, 12, 300))
    fp = base[group] ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 64, (300, 2)), axis=1)
    u, v = simhash._links(fp, np.arange(300), group, 3)
    near = [(a, b) for a in range(300) for b in range(a) if group[a] == group[b] and bin((int(fp[a]) ^ int(fp[b])) & (2**64 - 1)).count("1") <= 3]
    assert classes(range(300), list(zip(u.tolist(), v.tolist(), strict=True))) == classes(range(300), near)


def test_covering_masks_guarantee():
    masks = simhash.covering_masks(3, list(range(64)))
    rnd = random.Random(3)
    for _ in range(2000):
        diff = sum(1 << p for p in rnd.sample(range(64), 3))
        assert any(not m & diff for m in masks)


def test_null_ids_and_empty_table(spark, docs):
    got = simhash.near_duplicates(docs((None, "a b c"), (1, "a b c")).withColumnRenamed("lang", "component_id")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (1, 1)}
    assert simhash.near_duplicates(docs((1, "x")).limit(0)).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long, n_links long")


ODD = [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] + [0.0] * 7), (904, [float("inf")] + [0.0] * 7), (905, []), (906, [1.0, 2.0])]


def cloud(seed, n=150, d=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[n // 2 :] = x[: n - n // 2] + rng.standard_normal((n - n // 2, d)) * rng.choice([0, 0.05, 0.3, 0.5], (n - n // 2, 1))
    return [(i, x[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("per_cell,home,visit", [(1024, 2048, 8192), (20, 16, 32)])
def test_embedding_links(spark, monkeypatch, per_cell, home, visit):
    monkeypatch.setattr(embdedup, "PER_CELL", per_cell)
    monkeypatch.setattr(embdedup, "HOME", home)
    monkeypatch.setattr(embdedup, "VISIT", visit)
    rows = cloud(1) + ODD + [(3, cloud(1)[3][1])]
    got = embdedup.link_duplicates(vectors(spark, [(*r, None, 5) for r in rows])).collect()
    good = [(i, np.array(v, float)) for i, v in cloud(1) + [(3, cloud(1)[3][1])]]
    cos = np.array([[a @ b / np.sqrt((a @ a) * (b @ b)) for _, b in good] for _, a in good])
    n = {}
    for k, (i, _) in enumerate(good):
        n[i] = int((cos[k] >= 0.9).sum()) - 1
    want = classes(sorted({r[0] for r in rows}), [(good[a][0], good[b][0]) for a in range(len(good)) for b in range(a) if cos[a, b] >= 0.9])
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (n.get(r.vec_id, 0), want[r.vec_id], want[r.vec_id] == r.vec_id), r
    assert embdedup.link_duplicates(vectors(spark, [(None, [1.0, 0.0], None, None)])).collect()[0].component_id is None
    assert embdedup.link_duplicates(vectors(spark, [])).collect() == []


@pytest.mark.parametrize("dim,inner", [(64, 3), (64, 64)])
def test_embedding_links_of_low_inner_dimension(spark, monkeypatch, dim, inner):
    """Many cells, vectors of a subspace: every link of every vector is met."""
    monkeypatch.setattr(embdedup, "PER_CELL", 30)
    rng = np.random.default_rng(inner)
    x = (rng.standard_normal((1200, inner)) @ rng.standard_normal((inner, dim))).astype(np.float32)
    got = embdedup.link_duplicates(vectors(spark, [(i, v.tolist(), None, None) for i, v in enumerate(x)])).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    want = classes(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if b < a])
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(near[i].sum()) - 1, want[i]) for i in range(len(x))}


@pytest.mark.parametrize("rows_in,queries_in,first", [(8192, 512, 256), (16, 4, 3)])
def test_top_k(spark, monkeypatch, rows_in, queries_in, first):
    monkeypatch.setattr(topk, "ROWS", rows_in)
    monkeypatch.setattr(topk, "QUERIES", queries_in)
    monkeypatch.setattr(topk, "FIRST", first)
    rows = cloud(2) + ODD + [(7, cloud(2)[9][1])]  # a repeated id with another vector
    df = topk.quantised(vectors(spark, [(*r, None, 5) for r in rows]))
    from pyspark.sql import functions as F
    got = topk.top_k(df, F.col("id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    v = [(i, np.floor(64 * np.array(x, float)).astype(int)) for i, x in cloud(2) + [(7, cloud(2)[9][1])]]
    want = []
    for q, a in v:
        if q % 20 == 0:
            s = {}
            for c, b in v:
                if c != q:
                    s[c] = max(s.get(c, -(10**9)), int(a @ b))
            want += [(q, k + 1, c, -m) for k, (m, c) in enumerate(sorted((-m, c) for c, m in s.items())[:5])]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == sorted(want)
    assert topk.top_k(topk.quantised(vectors(spark, [])), F.col("id") % 20 == 0).collect() == []
    few = topk.top_k(topk.quantised(vectors(spark, [(0, [1.0], None, None), (2, [1.0], None, None), (1, [1.0], None, None)])), F.col("id") % 20 == 0)
    assert [(r["rank"], r.vec_id, r.score) for r in few.orderBy("rank").collect()] == [(1, 1, 4096), (2, 2, 4096)]


@pytest.mark.parametrize("first", [3, 40, 1000])
def test_open_rows_of_several_queries_meet_in_one_product(monkeypatch, first):
    """Ties, a query's own row and queries with fewer than k rows, with true bounds of any width."""
    monkeypatch.setattr(topk, "FIRST", first)
    rng = np.random.default_rng(3)
    x, ids = np.floor(rng.normal(size=(200, 3)) * 4), rng.permutation(200)
    true = x[:9] @ x.T
    bound = true + rng.integers(0, 5, true.shape)
    bound[np.arange(9), np.arange(9)] = -np.inf
    bound[8, 2:] = -np.inf
    got = list(topk.best(x[:9], x, ids, bound, 5))
    for j, (i, s) in enumerate(got):
        want = sorted((-true[j, c], ids[c]) for c in range(200) if np.isfinite(bound[j, c]))[:5]
        assert [(-b, a) for a, b in zip(i, s, strict=True)] == want
    assert [len(i) for i, _ in got] == [5] * 8 + [2]
