"""Work that was left out or that grew too fast (findings of round 4)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import closure, reference_rule

from pagescale.operators import cells as C
from pagescale.operators import graph as G


def pages(seed, n=4, most=22):
    """Lines of any height and width, among them headings over some columns, empty and turned-about boxes."""
    rnd = random.Random(seed)
    out = []
    for p in range(n):
        for i in range(rnd.randint(1, most)):
            y, x = rnd.randint(-5, 40), rnd.randint(-3, rnd.choice([20, 60, 200]))
            out.append((p, i, y, x, y + rnd.choice([0, 1, 1, 2, 9, -1]), x + rnd.choice([0, 1, 5, 12, 40, -2])))
    return out


BOXES = "page int, id bigint, y0 bigint, x0 bigint, y1 bigint, x1 bigint"


@pytest.mark.parametrize("rows,cells", [(4096, 1 << 18), (5, 16)])
def test_reading_order_has_all_pairs_of_its_rules(spark, monkeypatch, rows, cells):
    """pairs of the second rule were left out that no others imply, and pairs that others imply."""
    monkeypatch.setattr(G, "ROWS", rows)
    monkeypatch.setattr(G, "CELLS", cells)
    own = pages(5)
    df = spark.createDataFrame([*own, (None, 0, 0, 0, 1, 1), (None, 1, 0, 5, 1, 9)], BOXES)
    got, few = ([(r["page"], r["a"], r["b"]) for r in G.reading_order(df, ["page"], implied=i).collect()] for i in (True, False))
    want = {(p, a, b) for p in range(4) for a, b in reference_rule([r[2:] for r in own if r[0] == p])}
    assert sorted(got) == sorted(want)
    assert set(few) < want and len(few) == len(set(few))
    for p in range(4):
        assert closure({k[1:] for k in few if k[0] == p}) == closure({k[1:] for k in want if k[0] == p})


def test_reading_order_of_repeated_ids(spark):
    """A pair comes once, a line without an id separates others but has no pairs."""
    df = spark.createDataFrame([(1, 7, 0, 0, 1, 5), (1, 7, 2, 0, 3, 5), (1, 7, 2, 0, 3, 5), (1, 8, 1, 10, 2, 15), (1, None, 0, 4, 3, 11), (1, 9, 30, 20, 31, 25)], BOXES)
    assert sorted((r["a"], r["b"]) for r in G.reading_order(df, ["page"]).collect()) == [(7, 9), (8, 9)]


def test_visited_cells_do_not_multiply_a_batch(monkeypatch):
    """a batch of vectors came out once for each visited cell; now a row for each, in pieces that CELLS bounds."""
    import pyarrow as pa

    from pagescale.llm import embdedup as E
    monkeypatch.setattr(E, "CELLS", 256)
    x = np.random.default_rng(1).standard_normal((300, 16))
    c = x[:64] / np.linalg.norm(x[:64], axis=1)[:, None]

    class Table:
        def select(self, *cols):
            return self

        def mapInArrow(self, run, kinds):
            return list(run([pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([1] * 300), pa.array(x.tolist())], ["rep", "n", "v"])]))

    homes = E._coded(Table(), {16: c}, 0.9)
    cells = np.concatenate([b.column(4).to_numpy() for b in homes])
    groups = E._grouped(c, np.bincount(cells, minlength=64), 80)
    own = E._coded(Table(), {16: c}, 0.9, {16: groups})
    assert sum(b.num_rows for b in homes) == sum(b.num_rows for b in own) == 300 and max(b.num_rows for b in own) <= 4
    assert max(np.bincount(groups[cells])) <= 80 and len(set(groups)) < 16
    home, visit = E._near(x / np.linalg.norm(x, axis=1)[:, None], c, 0.9)
    assert np.concatenate([b.column(4).to_numpy() for b in own]).tolist() == groups[home].tolist()
    assert [set(v) for b in own for v in b.column(5).to_pylist()] == [set(groups[v]) for v in visit]


def test_boxes_are_written_once_for_their_children(spark, monkeypatch):
    """a box is held against those of a small tile, and rounds read boxes that are written; the tile does not change the rows."""
    from pagescale.operators import joins as J
    rnd = random.Random(4)
    rows = [(1, i, y, x, y + rnd.randint(1, 30), x + rnd.randint(1, 90)) for i, (y, x) in enumerate((rnd.randint(0, 60), rnd.randint(0, 200)) for _ in range(120))]
    df = spark.createDataFrame(rows, BOXES)
    seen, pairs = [], J.contains_join
    monkeypatch.setattr(J, "contains_join", lambda a, b, keys, size=None: seen.append((a.inputFiles(), size)) or pairs(a, b, keys, size))
    got = [sorted(r["id"] for r in J.filter_children(df, ["page"], 3, size).collect()) for size in (None, {"y": 2, "x": 16})]
    assert got[0] == got[1] and all(files for files, _ in seen) and seen[1][1] == {"y": 2, "x": 16}


def seen(boxes, axis):
    """Pairs of ids next to each other in some column (axis x) or row; nulls first along the other axis."""
    i, j = (3, 5) if axis == "x" else (2, 4)
    along = 5 - i
    pairs = set()
    own = [b for b in boxes if b[1] is not None and b[i] is not None]
    for at in {p for b in own for p in (b[i], max(b[i] + 1, b[j] if b[j] is not None else b[i] + 1))}:
        held = sorted((b for b in own if b[i] <= at < max(b[i] + 1, b[j] if b[j] is not None else b[i] + 1)),
                      key=lambda b: (b[along] is not None, b[along] or 0, b[1]))
        pairs |= {(a[0], a[1], b[1]) for a, b in zip(held, held[1:], strict=False)}
    return pairs


@pytest.mark.parametrize("axis", ["x", "y"])
def test_sweep_reads_the_boxes_once(spark, monkeypatch, axis):
    """each axis made the boxes a dozen times from the texts, in windows over every column of every box."""
    monkeypatch.setattr(G, "CELLS", 50)
    own = [(0, i, *b[2:]) for i, b in enumerate(pages(9, 6, 22))] + [(0, 3, 1, 1, 9, 30), (0, 4, None, 2, 5, 9), (0, None, 0, 0, 5, 5), (0, 200, 4, 3, None, None)]
    found = G.sweep_pairs(spark.createDataFrame([*own, (None, 1, 0, 0, 1, 1), (None, 2, 2, 0, 3, 1)], BOXES), ["page"], axis)
    assert {tuple(r) for r in found.collect()} == seen(own, axis)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [{"y": 1, "x": 16}, {"y": 7, "x": 3}])
def test_cells_in_boxes_on_tiles_of_any_size(spark, size):
    """a cell was held against all boxes of a tile of 64 x 64."""
    rnd = random.Random(3)
    own = pages(2)
    cells = [(p, rnd.randint(-5, 50), rnd.randint(-5, 90)) for p in range(4) for _ in range(150)]
    got = C.cells_in_boxes(spark.createDataFrame([*cells, (None, 0, 0)], "page int, y bigint, x bigint"), spark.createDataFrame(own, BOXES), ["page"], ["id"], size)
    want = sorted((p, y, x, b[1]) for p, y, x in cells for b in own if b[0] == p and b[2] <= y < b[4] and b[3] <= x < b[5])
    assert sorted((r["page"], r["y"], r["x"], r["id"]) for r in got.collect()) == want


@pytest.mark.parametrize("run", [4096, 4])
def test_runs_are_made_in_one_reading_of_the_cells(spark, monkeypatch, run):
    """the cells of a grid were sorted in windows, and each labelled cell moved to its cell."""
    monkeypatch.setattr(G, "RUN", run, raising=False)
    rnd = random.Random(8)
    own = [(p, rnd.randint(-2, 3), rnd.randint(-6, 14)) for p in range(3) for _ in range(60)]
    df = spark.createDataFrame([*own, (None, 0, 0), (0, None, 1), (0, 1, None)], "page int, y bigint, x bigint")
    runs = G.cell_runs(df, ["page"])
    assert "Window" not in runs._jdf.queryExecution().executedPlan().toString()
    got = {(r["page"], r["y0"], x) for r in runs.collect() if r["page"] is not None and r["y0"] is not None for x in range(r["x0"], r["x1"])}
    assert got == set(own)
    starts = {(r["page"], r["y0"], r["x0"]) for r in runs.collect() if r["page"] is not None and r["y0"] is not None}
    assert starts == {(p, y, x) for p, y, x in own if (p, y, x - 1) not in set(own)}
    lab = G.label_cells(df, ["page"])
    assert lab.columns == ["page", "y", "x", "comp"]
    assert sorted((r["page"], r["y"], r["x"]) for r in lab.collect()) == sorted(own)  # a cell that comes twice stays twice
    of = {(r["page"], r["y"], r["x"]): r["comp"] for r in lab.collect()}
    for (p, y, x), c in of.items():
        assert of[c["page"], c["y"], c["x"]] == c
        assert all(of.get(k, c) == c for k in ((p, y + 1, x), (p, y, x + 1)))
