import random

import pytest
from pyspark.sql import functions as F

from pagescale.operators import diff as D
from pagescale.operators import graph as G
from pagescale.operators import joins as J
from pagescale.operators import locate
from pagescale.operators import metrics as M
from pagescale.operators import quality as Q
from pagescale.operators import sequence as S
from pagescale.operators.blocks import Scan, islands, scan
from pagescale.operators.ranking import first_per_key


def test_scan_blocks_agree_with_plain_windows(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aaab"), i, rnd.choice([None, rnd.randint(0, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    kinds = ["sum", "prev", "next", "max_before", "min_after", "max_after", "total"]
    a, b = (scan(df, ["k"], ["i"], blk, **{k: Scan(k, F.col("v")) for k in kinds}).orderBy("i").collect() for blk in (F.floor(F.col("i") / 7), None))
    for x, y in zip(a, b):
        for k in kinds:
            assert (x[k] or 0) == (y[k] or 0), (k, x, y)


def test_islands(spark):
    rnd = random.Random(2)
    iv = sorted((s, s + rnd.randint(0, 5), i) for i, s in enumerate(rnd.sample(range(200), 60)))
    want, reach, n = {}, None, 0
    for s, e, i in iv:
        if reach is None or s > reach:
            n += 1
        want[i] = n
        reach = e if reach is None else max(reach, e)
    df = spark.createDataFrame([(1, s, e, i) for s, e, i in iv], "k int, s bigint, e bigint, i bigint")
    got = islands(df, ["k"], "s", "e", ["s", "i"], F.floor(F.col("s") / 16)).collect()
    assert {r["i"]: r["island"] for r in got} == want


def test_first_per_key_under_skew(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("k"), "id")
    got = first_per_key(df, ["k"], [F.asc("id")], 3).collect()
    assert sorted((r["k"], r["id"]) for r in got) == [("cold", 0), ("cold", 10), ("cold", 20), ("hot", 1), ("hot", 2), ("hot", 3)]


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("", ""), ("a", ""), ("abd", "abc")], "pred string, truth string")
    r = df.select(M.set_acc("pred", "truth").alias("s"), M.nedit("pred", "truth").alias("n")).collect()
    assert (r[0]["s"], r[0]["n"], r[1]["s"], r[1]["n"]) == (None, None, None, 1.0)
    assert abs(r[2]["s"] - 2 / 3) < 1e-9 and abs(r[2]["n"] - 1 / 3) < 1e-9


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "page int, id bigint, y0 bigint, x0 bigint, y1 bigint, x1 bigint")


def rand_boxes(seed, n=60, size=200, big=30):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        y, x = rnd.randrange(size), rnd.randrange(size)
        out.append((y, x, y + rnd.randint(1, big), x + rnd.randint(1, big)))
    return out


def test_overlap_join_brute(spark):
    b = rand_boxes(3)
    want = {(i, j) for i in range(len(b)) for j in range(i + 1, len(b))
            if b[i][2] >= b[j][0] and b[j][2] >= b[i][0] and b[i][3] >= b[j][1] and b[j][3] >= b[i][1]}
    got = J.overlap_join(boxes(spark, b), ["page"]).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_drop_nested(spark):
    b = [(0, 0, 10, 10), (0, 0, 10, 10), (2, 2, 8, 8), (3, 3, 4, 4), (20, 20, 30, 30)]
    assert sorted(r["id"] for r in J.drop_nested(boxes(spark, b), ["page"]).collect()) == [1, 4]


def test_components_brute(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    parent = {i: i for i in range(401)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.createDataFrame([(i,) for i in parent], "id bigint")
    got = G.components(nodes, spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r["id"]: r["label"] for r in got} == {i: find(i) for i in parent}


@pytest.mark.parametrize("conn", [4, 8])
def test_label_cells_brute(spark, conn):
    rnd = random.Random(conn)
    ink = {(y, x) for y in range(14) for x in range(14) if rnd.random() < 0.5}
    step = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    seen, want = {}, 0
    for c in sorted(ink):
        if c in seen:
            continue
        want += 1
        todo = [c]
        while todo:
            p = todo.pop()
            if p in seen:
                continue
            seen[p] = want
            todo += [(p[0] + dy, p[1] + dx) for dy, dx in step if (p[0] + dy, p[1] + dx) in ink]
    df = spark.createDataFrame([(1, y, x) for y, x in ink], "page int, y bigint, x bigint")
    groups = {}
    for r in G.label_cells(df, ["page"], conn).collect():
        groups.setdefault((r["comp"]["y"], r["comp"]["x"]), set()).add(seen[(r["y"], r["x"])])
    assert len(groups) == want and all(len(g) == 1 for g in groups.values())


def test_merge_intersected_closure(spark):
    got = G.merge_intersected(boxes(spark, rand_boxes(5, 40, 300, 20)), ["page"]).collect()
    assert sum(r["n"] for r in got) == 40
    for i, a in enumerate(got):
        for b in got[i + 1:]:
            assert a["y1"] < b["y0"] or b["y1"] < a["y0"] or a["x1"] < b["x0"] or b["x1"] < a["x0"]


def column_page(seed):
    """A heading, two columns of lines, a heading, two more columns."""
    rnd = random.Random(seed)
    out, y = [], 0
    for _ in range(2):
        out.append((y, 0, y + 2, 180))
        n = rnd.randint(2, 4)
        for col in (0, 100):
            out += [(y + 4 + 3 * i, col, y + 6 + 3 * i, col + 80) for i in range(n)]
        y += 4 + 3 * n + 2
    return out


def reference_rule(b):
    def before(u, v):
        if u[1] < v[3] and u[3] > v[1]:
            return u[0] < v[0]
        if any(w[2] >= min(u[0], v[0]) and w[0] <= max(u[2], v[2]) and w[1] < u[3] and w[3] > v[1] for w in b):
            return False
        return u[3] < v[1]
    return {(i, j) for i in range(len(b)) for j in range(len(b)) if i != j and before(b[i], b[j])}


def closure(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_reading_order_same_closure(spark, seed):
    b = column_page(seed)
    df = boxes(spark, b)
    edges = G.reading_order(df, ["page"])
    got = {(r["a"], r["b"]) for r in edges.collect()}
    want = reference_rule(b)
    assert got <= want
    assert closure(got) == closure(want)
    ranked = G.topsort(df, edges, ["page"])
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == list(range(len(b)))
    assert G.order_faults(edges, ranked, ["page"]).isEmpty()


def test_topsort_obeys_its_edges(spark):
    df = boxes(spark, [(0, 40, 1, 50), (5, 0, 6, 12), (10, 10, 11, 30), (15, 28, 16, 42)])
    edges = G.reading_order(df, ["page"])
    ranked = G.topsort(df, edges, ["page"])
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == [1, 2, 0, 3]
    assert G.order_faults(edges, ranked, ["page"]).isEmpty()
    cycle = spark.createDataFrame([(edges.first()["page"], a, b) for a, b in ((2, 1), (1, 2), (3, 0))], "page bigint, a bigint, b bigint")
    ranked = G.topsort(df, cycle, ["page"])
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == [3, 0, 1, 2]
    assert {(r["a"], r["b"]) for r in G.order_faults(cycle, ranked, ["page"]).collect()} == {(2, 1)}


def test_topsort_random_graphs(spark):
    import random
    rnd = random.Random(8)
    df = boxes(spark, [(rnd.randrange(50), rnd.randrange(50), 60, 60) for _ in range(40)])
    order = rnd.sample(range(40), 40)
    pairs = [(order[i], order[j]) for i in range(40) for j in range(i) if rnd.random() < 0.1]
    edges = spark.createDataFrame([(df.first()["page"], b, a) for a, b in pairs], "page bigint, a bigint, b bigint")
    ranked = G.topsort(df, edges, ["page"])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(40))
    assert G.order_faults(edges, ranked, ["page"]).isEmpty()


def test_xy_cut_many_even_lines(spark):
    b = [(3 * i, 0, 3 * i + 1, 9) for i in range(130)]
    got = G.xy_cut(boxes(spark, b), ["page"], 2, 2, "widest").collect()
    assert len({tuple(r["leaf"]) for r in got}) == 130


def test_split_merged_lines(spark):
    b = [(0, 0, 3, 5), (1, 6, 2, 9), (5, 0, 8, 5), (6, 6, 9, 9), (2, 10, 6, 12), (12, 0, 14, 4)]
    got = {r["id"]: (r["lines_hit"], r["line"]) for r in G.split_merged_lines(boxes(spark, b), ["page"]).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (1, 8), 3: (1, 8), 4: (1, 2), 5: (1, 14)}
    wide = {r["id"]: r["lines_hit"] for r in G.split_merged_lines(boxes(spark, b + [(0, 20, 9, 22)]), ["page"]).collect()}
    assert wide[6] == 2


@pytest.mark.parametrize("mode", ["all", "widest"])
def test_xy_cut_leaves(spark, mode):
    b = [(0, 0, 2, 50), (10, 0, 12, 20), (13, 0, 15, 20), (10, 30, 12, 50), (13, 30, 15, 50)]
    got = {r["id"]: tuple(r["leaf"]) for r in G.xy_cut(boxes(spark, b), ["page"], 5, 5, mode).collect()}
    assert len(got) == 5 and got[1] == got[2] and got[3] == got[4] and len(set(got.values())) == 3


def test_group_boxes_empty_band(spark):
    b = [(0, 0, 2, 10), (5, 0, 7, 10), (12, 0, 14, 10)]
    ink = spark.createDataFrame([(1, 9, 4)], "page int, y bigint, x bigint")
    got = {r["id"]: r["group"] for r in G.group_boxes(boxes(spark, b), ink, ["page"]).collect()}
    assert got[0] == got[1] != got[2]


def test_diff_round_trips(spark):
    texts = [(1, "a\nb\nc\nd\nx"), (2, "a\nc\nb\nd\ny\nx"), (3, "q"), (4, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 4)], "a bigint, b bigint")
    d = D.line_diff(pairs, D.doc_lines(docs))
    t = dict(texts)
    for side, k in ((1, "a"), (2, "b")):
        for r in D.diff_text(d, side).collect():
            assert r["text"] == t[r[k]]
    src = docs.withColumnRenamed("doc_id", "a")
    back = D.from_delta(D.to_delta(d.where("length(text) > 0")), src)
    assert back.exceptAll(d.where("length(text) > 0").select(back.columns)).isEmpty()
    e = D.make_edits(d, 1)
    got = locate.apply_edits(pairs.join(src, "a"), e, ["a", "b"]).collect()
    assert all(r["text"] == t[r["b"]] and "F" not in r["applied"] for r in got)
    assert D.edits_from_text(D.edits_to_text(e)).select(e.columns).exceptAll(e).isEmpty()


def test_worked_diff_examples(spark):
    d = spark.createDataFrame([(1, 2, 1, 0, "The "), (1, 2, 2, 1, "big "), (1, 2, 3, 0, "cat")], "a bigint, b bigint, seq bigint, op int, text string")
    locs = spark.createDataFrame([(1, 2, 1), (1, 2, 4)], "a bigint, b bigint, loc bigint")
    assert {r["loc"]: r["loc2"] for r in D.map_positions(d, locs).collect()} == {1: 1, 4: 8}
    d = spark.createDataFrame([(1, 2, 1, 0, "abc"), (1, 2, 2, -1, "de"), (1, 2, 3, 1, "ing")], "a bigint, b bigint, seq bigint, op int, text string")
    assert D.to_delta(d).first()["delta"] == "=3\t-2\t+ing"
    with pytest.raises(Exception, match="delta length"):
        D.from_delta(D.to_delta(d), spark.createDataFrame([(1, "abcdef")], "a bigint, text string")).collect()


def test_clean_diff(spark):
    d = spark.createDataFrame([(1, 2, 1, -1, "abcd"), (1, 2, 2, 0, "x"), (1, 2, 3, 1, "efgh"), (1, 2, 4, 0, "a long equal part")], "a bigint, b bigint, seq bigint, op int, text string")
    got = [(r["op"], r["text"]) for r in D.clean_diff(d, "semantic").orderBy("seq").collect()]
    assert got == [(-1, "abcdx"), (1, "xefgh"), (0, "a long equal part")]


def test_greedy_decode_and_quality(spark):
    post = spark.createDataFrame([(1, t, c, p) for t, c, p in [(1, "a", .9), (2, "a", .9), (3, "-", .9), (4, "a", .8), (5, "b", .8), (6, "b", .1)]], "s int, t bigint, cls string, p double")
    assert [(r["t"], r["cls"]) for r in S.decode_greedy(post, "s", "-", 0.25).orderBy("t").collect()] == [(4, "a"), (5, "b")]
    df = spark.createDataFrame([(1, 0), (2, 5), (3, None)], "id int, v int")
    rule = Q.Rule("flag", "v", Q.is_bool(), "must be 0 or 1")
    assert [r["id"] for r in Q.check(df, [rule], ["id"]).orderBy("id").collect()] == [2, 3]
    with pytest.raises(Exception, match="flag: v=5 must be 0 or 1"):
        Q.check(df.where("id < 3"), [rule], ["id"], "strict").collect()
