"""Nearest labels and sweeps against plain versions."""

import random

import pytest

from pagescale.operators import cells as C
from pagescale.operators import graph as G


def plain_spread(seeds, h, w, limit):
    out = {}
    for y in range(h + 1):
        for x in range(w + 1):
            best = min((((y - a) ** 2 + (x - b) ** 2, l) for a, b, l in seeds), default=(limit * limit, 0))
            if best[0] < limit * limit:
                out[(y, x)] = best[1]
    return out


@pytest.mark.parametrize("limit,n", [(1, 30), (2.5, 30), (7, 12), (30, 8), (200, 5), (9999999, 3)])
def test_spread_is_the_nearest_label(spark, limit, n):
    rnd = random.Random(int(limit) + n)
    rows, want = [], {}
    for page in range(3):
        h, w = rnd.randint(5, 60), rnd.randint(5, 60)
        seeds = [(rnd.randint(0, h), rnd.randint(0, w), rnd.randint(-5, 10**12)) for _ in range(n)]
        seeds += [(*seeds[0][:2], seeds[0][2] + 1), (h, w, 7), (0, 0, 7)]  # two labels in one cell; ties
        rows += [(page, *s) for s in seeds]
        want |= {(page, y, x): l for (y, x), l in plain_spread(seeds, h, w, limit).items()}
    df = spark.createDataFrame(rows, "page int, y long, x long, label long").repartition(3)
    got = C.spread_labels(df, ["page"], limit)
    assert {(r["page"], r["y"], r["x"]): r["label"] for r in got.collect()} == want
    assert got.count() == len(want)


def test_spread_to_given_bounds(spark):
    df = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 9, 6)], "page int, y long, x long, label long")
    bounds = spark.createDataFrame([(1, 2, 4)], "page int, _h long, _w long")
    got = {(r["y"], r["x"]): r["label"] for r in C.spread_labels(df, ["page"], 3, bounds).collect()}
    assert got == {k: 5 for k in plain_spread([(0, 0, 5)], 2, 4, 3)}  # what lies outside offers nothing
    assert C.spread_labels(df.limit(0), ["page"], 3).collect() == []


def plain_sweep(boxes, axis):
    i, j = (1, 0) if axis == "x" else (0, 1)
    pairs, spans = set(), {}
    for b in boxes:
        for at in range(b[1 + i], max(b[1 + i] + 1, b[3 + i])):
            spans.setdefault(at, []).append((b[1 + j], b[0]))
    for own in spans.values():
        own.sort()
        pairs |= {(a[1], b[1]) for a, b in zip(own, own[1:])}
    return pairs


@pytest.mark.parametrize("axis", ["x", "y"])
def test_sweep_pairs_see_each_other(spark, axis):
    rnd = random.Random(6)
    boxes = [(k, y, x, y + rnd.choice([0, 1, 4, 30]), x + rnd.choice([0, 1, 9, 60])) for k, (y, x) in enumerate((rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(80))]
    df = spark.createDataFrame([(1, *b) for b in boxes], "page int, id long, y0 long, x0 long, y1 long, x1 long")
    got = {(r["a"], r["b"]) for r in G.sweep_pairs(df, ["page"], axis).collect()}
    assert got == plain_sweep(boxes, axis)
    far = 10**9  # wide boxes cost what they see, not their width
    wide = spark.createDataFrame([(1, 1, 0, 0, 1, far), (1, 2, 5, 10, 6, far), (1, 3, 9, 20, 10, 30)], "page int, id long, y0 long, x0 long, y1 long, x1 long")
    assert {(r["a"], r["b"]) for r in G.sweep_pairs(wide, ["page"], "x").collect()} == {(1, 2), (2, 3)}


def plain_topsort(place, edges):
    """Always the first line by place that waits for none; in a cycle the first of all left."""
    left, out = set(place), {}
    while left:
        free = [i for i in left if not any(b == i and a in left and a != b for a, b in edges)]
        i = min(free or left, key=lambda k: place[k])
        out[i] = len(out)
        left.remove(i)
    return out


def test_topsort_is_the_plain_order(spark, monkeypatch):
    rnd = random.Random(11)
    rows, edges, want = [], [], {}
    for page in range(14):
        n = rnd.randint(1, 24)
        ids = rnd.sample(range(100), n)
        place = {i: k for k, i in enumerate(ids)}
        true = rnd.sample(ids, n)
        for _ in range(rnd.randint(0, 3 * n)):
            a, b = sorted(rnd.sample(range(n), 2)) if n > 1 else (0, 0)
            a, b = true[a], true[b]
            if page >= 11 and rnd.random() < 0.3:
                a, b = b, a  # pages with cycles
            edges.append((page, a, b))
        edges += [(page, ids[0], ids[0]), (page, 777, ids[0])]
        if page == 3:
            edges += [(page, a, b) for a, b in zip(ids[1:], ids)]  # every line against its place
        rows += [(page, i, k) for i, k in place.items()]
        own = [(a, b) for p, a, b in edges if p == page and a in place and b in place]
        want |= {(page, i): r for i, r in plain_topsort(place, own).items()}
    monkeypatch.setattr(G, "_divided", lambda lines, keys: lines)
    df = spark.createDataFrame(rows, "page int, id long, rank long").repartition(3)
    got = G.topsort(df, spark.createDataFrame(edges, "page int, a long, b long"), ["page"]).collect()
    assert {(r["page"], r["id"]): r["rank"] for r in got} == want


def test_every_pair_of_the_first_rule_follows_from_the_edges(spark):
    """Lines that overlap in x go by height, lines of equal height among them too."""
    rnd = random.Random(13)
    lines = [(k, y, x, y + rnd.randint(1, 4), x + rnd.randint(1, 25)) for k, (y, x) in enumerate((rnd.randint(0, 12) * 2, rnd.randint(0, 60)) for _ in range(40))]
    df = spark.createDataFrame([(1, *b) for b in lines], "page int, id long, y0 long, x0 long, y1 long, x1 long")
    edges = {(r["a"], r["b"]) for r in G.reading_order(df, ["page"]).collect()}
    after = {i: {b for a, b in edges if a == i} for i, *_ in lines}
    grown = True
    while grown:
        more = {i: own | {k for j in own for k in after[j]} for i, own in after.items()}
        grown, after = more != after, more
    for u in lines:
        for v in lines:
            if u[1] < v[1] and u[2] < v[4] and u[4] > v[2]:
                assert v[0] in after[u[0]], (u, v)
