"""Operators on cell tables: one row per inked cell (grid key, y, x, label)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale.functions.numeric import with_group
from pagescale.operators.blocks import Scan, scan
from pagescale.session import materialise

GRID = {"y": 64, "x": 64}  # tile that cells and boxes meet on


def projection(cells: DataFrame, key: str, axis: str, side: str | None = None, out: str = "v") -> DataFrame:
    """Ink per row (axis y) or column (axis x): (key, pos, v), empty positions as 0.
    With ``side`` (a column, same for a whole grid) the inverted form side - ink. The ink, a row per inked row or column, is
    written once: what reads the profile, often several times, does not make the cells again."""
    ink = materialise(cells.groupBy(key, F.col(axis).alias("pos")).agg(F.count("*").alias(out), *([F.max(side).alias("_s")] if side else [])))
    top = ink.groupBy(key).agg(F.max("pos").alias("_n"), *([F.max("_s").alias("_s")] if side else []))
    dense = top.select(key, *(["_s"] if side else []), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))).alias("pos"))
    got = dense.join(ink.select(key, "pos", out), [key, "pos"], "left").withColumn(out, F.coalesce(out, F.lit(0)))
    return (got.withColumn(out, F.col("_s") - F.col(out)) if side else got).select(key, "pos", out)


def find_objects(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box (half-open), cell count and centre of mass per label."""
    return cells.groupBy(*keys, "label").agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"),
        F.count("*").alias("n"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def remove_noise(cells: DataFrame, keys: list[str], minsize: int, border: int | None = None) -> DataFrame:
    """Drop components of fewer than ``minsize`` cells; with ``border`` also those of a
    box area below 1.2 * minsize whose middle is nearer than that to the page's edge.
    The components are hashed, so the cells, the larger side by far, are not sorted."""
    obj = find_objects(cells, keys)
    keep = F.col("n") >= minsize
    if border is not None:
        page = cells.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
        obj = obj.join(page.hint("shuffle_hash"), keys)
        cy, cx = (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2
        edge = (cx < border) | (cx > F.col("_w") - border) | (cy < border) | (cy > F.col("_h") - border)
        keep = keep & ~(((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")) < 1.2 * minsize) & edge)
    return cells.join(obj.where(keep).select(*keys, "label").hint("shuffle_hash"), keys + ["label"], "left_semi")


def keep_marked(cells: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """Components that touch a marked cell. Marked cells and touched components are hashed, the cells are not sorted."""
    return cells.join(_touched(cells, markers, keys), keys + ["label"], "left_semi")


def remove_marked(cells: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    return cells.join(_touched(cells, markers, keys), keys + ["label"], "left_anti")


def _touched(cells, markers, keys):
    on = keys + ["y", "x"]
    return cells.join(markers.select(*on).hint("shuffle_hash"), on, "left_semi").select(*keys, "label").distinct().hint("shuffle_hash")


def correspondences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct label pairs (a, b) that share a cell."""
    on = keys + ["y", "x"]
    return a.select(*on, F.col("label").alias("a")).join(b.select(*on, F.col("label").alias("b")), on).select(*keys, "a", "b").distinct()


def propagate_labels(regions: DataFrame, labels: DataFrame, keys: list[str], conflict: int | None = None) -> DataFrame:
    """Cells of ``regions`` with the label touching their region: the largest, or with
    ``conflict`` that value where several non-zero labels touch. Untouched regions get 0."""
    pairs = correspondences(regions, labels.where("label <> 0"), keys)
    got = pairs.groupBy(*keys, F.col("a").alias("label")).agg(F.max("b").alias("_top"), F.min("b").alias("_low"))
    new = F.col("_top") if conflict is None else F.when(F.col("_top") == F.col("_low"), F.col("_top")).otherwise(conflict)
    return regions.join(got, keys + ["label"], "left").withColumn("label", F.coalesce(new, F.lit(0))).drop("_top", "_low")


def _row_distances(seeds: list[dict], width: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a row within the limit of a seed and their nearest label. A seed stands in its
    column with the squared distance from the row; steps aside go on only while they can still bring a seed nearer."""
    names, rank = np.unique([s["label"] for s in seeds], return_inverse=True)
    k, far = len(names), int(limit * limit) + 1
    cost = np.full(width, far * k + k)
    np.minimum.at(cost, [s["x"] for s in seeds], np.array([s["d2"] for s in seeds]) * k + rank)
    best, step = cost.copy(), 1
    while step < width and step * step <= min(best.max() // k, far):
        aside = step * step * k
        np.minimum(best[step:], cost[:-step] + aside, out=best[step:])
        np.minimum(best[:-step], cost[step:] + aside, out=best[:-step])
        step += 1
    x = np.flatnonzero(best // k < limit * limit)
    return x, names[best[x] % k]


def spread_labels(cells: DataFrame, keys: list[str], maxdist: float, bounds: DataFrame | None = None) -> DataFrame:
    """Each cell of the page gets the label of the nearest labelled cell closer than
    ``maxdist`` (ties: the smaller label), by an exact distance transform in two passes.

    Along a column a labelled cell is nearest to the rows up to the middle between it and its neighbours, which a scan
    finds, so a cell of the page gets one offer at most from its own column (two where the middle ties). The offers of
    a row, as many as the page is wide, then spread sideways. The rows that pass are linear in the page's cells,
    whatever the distance. ``bounds``: (keys, _h, _w), the last row and column; else those of the cells."""
    c = F.col
    if bounds is None:
        bounds = cells.groupBy(*keys).agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    one = cells.where("y >= 0 and x >= 0").groupBy(*keys, "y", "x").agg(F.min("label").alias("label"))
    near = scan(one, [*keys, "x"], ["y"], F.floor(c("y") / 4096), _up=Scan("prev", c("y")), _down=Scan("next", c("y")))
    reach = F.lit(int(maxdist))
    first = F.greatest(c("y") - reach, F.coalesce(F.ceil((c("y") + c("_up")) / 2), F.lit(0)), F.lit(0))
    last = F.least(c("y") + reach, F.coalesce(F.floor((c("y") + c("_down")) / 2), c("_h")), c("_h"))
    near = near.join(bounds.select(*keys, "_h", "_w"), keys).where(c("x") <= c("_w")).withColumn("_a", first.cast("bigint")).withColumn("_b", last.cast("bigint")).where("_a <= _b")
    offers = near.select(*keys, c("y").alias("_y"), "x", "label", "_w", F.explode(F.sequence("_a", "_b")).alias("y"))
    d = c("y") - c("_y")
    rows = offers.groupBy(*keys, "y").agg(F.max("_w").alias("_w"), F.collect_list(F.struct(c("x").cast("bigint").alias("x"), (d * d).cast("bigint").alias("d2"), c("label").cast("bigint").alias("label"))).alias("_s"))

    def run(batches):
        for b in batches:
            at, xs, labels = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (w, seeds) in enumerate(zip(b.column(len(keys) + 1).to_pylist(), b.column(len(keys) + 2).to_pylist(), strict=True)):
                x, label = _row_distances(seeds, w + 1, maxdist)
                at.append(np.full(len(x), i))
                xs.append(x)
                labels.append(label)
            take = pa.array(np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(keys) + 1)), pa.array(np.concatenate(xs)), pa.array(np.concatenate(labels))], [*keys, "y", "x", "label"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in [*keys, "y"])
    return rows.select(*keys, "y", c("_w").cast("bigint").alias("_w"), "_s").mapInArrow(run, f"{kinds}, x bigint, label bigint")


def neighbor_labels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Unordered pairs of different labels that meet across a cell side (no wrap)."""
    c = cells.select(*keys, "y", "x", "label")
    moved = c.select(*keys, F.explode(F.array(F.struct((F.col("y") + 1).alias("y"), F.col("x").alias("x")),
                                              F.struct(F.col("y").alias("y"), (F.col("x") + 1).alias("x")))).alias("_p"), F.col("label").alias("_o"))
    moved = moved.select(*keys, "_p.y", "_p.x", "_o")
    return c.join(moved, keys + ["y", "x"]).where("label <> _o").select(
        *keys, F.least("label", "_o").alias("a"), F.greatest("label", "_o").alias("b")).distinct()


def crossings(cells: DataFrame, keys: list[str], most: int = 1) -> DataFrame:
    """Times the ink starts anew going down each column, and whether the column stays
    (at most ``most``). A start is an inked cell without one above it: an anti-join,
    so no column is gathered. As in the original rule ink in row 0 starts nothing."""
    on = keys + ["y", "x"]
    below = cells.select(*keys, (F.col("y") + 1).alias("y"), "x").distinct()
    starts = cells.where("y > 0").select(*on).distinct().join(below, on, "left_anti").groupBy(*keys, "x").agg(F.count("*").alias("n"))
    cols = cells.select(*keys, "x").distinct()
    return cols.join(starts, keys + ["x"], "left").select(*keys, "x", F.coalesce("n", F.lit(0)).alias("n")) \
        .withColumn("keep", F.col("n") <= most)


# ---- cells and boxes ------------------------------------------------------

def tiles(lo: Column, hi: Column, size: int) -> Column:
    """Tile numbers a half-open range covers."""
    return F.sequence(F.floor(lo / size), F.floor(F.greatest(hi - 1, lo) / size))


def cells_in_boxes(cells: DataFrame, boxes: DataFrame, keys: list[str], ident: list[str], size: dict[str, int] | None = None) -> DataFrame:
    """Cells with the boxes that hold them: (keys, ident, box columns as b_*, y, x, ...).
    Both sides meet on page tiles, so a big page is many join keys. A cell is held against all boxes of its tile, so ``size``
    should not be far above that of the many boxes; the rows do not depend on it. The boxes are hashed, so that the cells are not sorted."""
    size = size or GRID
    b = boxes.select(*keys, *ident, *[F.col(c).alias(f"b_{c}") for c in ("y0", "x0", "y1", "x1")])
    b = b.withColumn("_ty", F.explode(tiles(F.col("b_y0"), F.col("b_y1"), size["y"]))).withColumn("_tx", F.explode(tiles(F.col("b_x0"), F.col("b_x1"), size["x"])))
    c = cells.withColumn("_ty", F.floor(F.col("y") / size["y"])).withColumn("_tx", F.floor(F.col("x") / size["x"]))
    return c.join(b.hint("shuffle_hash"), keys + ["_ty", "_tx"]).where("y >= b_y0 and y < b_y1 and x >= b_x0 and x < b_x1").drop("_ty", "_tx")


def crop_cells(cells: DataFrame, boxes: DataFrame, keys: list[str], ident: list[str], v: str, margin: int = 0, bg=0) -> DataFrame:
    """Cut boxes (with a margin) out of a grid: every cell of the cut, re-based to its
    corner, with ``v`` or the background."""
    b = boxes.select(*keys, *ident, (F.col("y0") - margin).alias("y0"), (F.col("x0") - margin).alias("x0"),
                     (F.col("y1") + margin).alias("y1"), (F.col("x1") + margin).alias("x1"))
    grid = b.withColumn("y", F.explode(F.expr("sequence(y0, y1 - 1)"))).withColumn("x", F.explode(F.expr("sequence(x0, x1 - 1)")))
    got = grid.join(cells.select(*keys, "y", "x", v), keys + ["y", "x"], "left")
    return got.select(*keys, *ident, (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), F.coalesce(v, F.lit(bg)).alias(v))


def read_marks(cells: DataFrame, boxes: DataFrame, keys: list[str], ident: list[str], shift=(0, 0), pad: int = 5,
               share: float = 0.8, least: int = 12) -> DataFrame:
    """Ink count of each shifted, padded box and whether it is marked:
    count > max(share * page's largest count, least)."""
    page = cells.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    dy, dx = shift
    b = boxes.join(page, keys).select(*keys, *ident, F.greatest(F.col("y0") + dy - pad, F.lit(0)).alias("y0"), F.greatest(F.col("x0") + dx - pad, F.lit(0)).alias("x0"),
                                      F.least(F.col("y1") + dy + pad, F.col("_h")).alias("y1"), F.least(F.col("x1") + dx + pad, F.col("_w")).alias("x1"))
    n = cells_in_boxes(cells.select(*keys, "y", "x"), b, keys, ident).groupBy(*keys, *ident).agg(F.count("*").alias("ink"))
    n = b.select(*keys, *ident).join(n, keys + ident, "left").withColumn("ink", F.coalesce("ink", F.lit(0)))
    return with_group(n, keys, _m=F.max("ink")).withColumn("marked", F.col("ink") > F.greatest(F.col("_m") * share, F.lit(float(least)))).drop("_m")


def box_contrast(cells: DataFrame, boxes: DataFrame, keys: list[str], ident: list[str], v: str, size=None) -> DataFrame:
    """Background (median of the 12 cells around a box's corners), foreground (mean of
    its inked cells) and polarity. Background cells outside the page are clamped in. ``size``: tile of ``cells_in_boxes``."""
    from pagescale.functions.numeric import lookup_clamped
    y0, x0, y1, x1 = (F.col(c) for c in ("y0", "x0", "y1", "x1"))
    ring = []
    for y, x, sy, sx in ((y0, x0, -1, -1), (y1 - 1, x0, 1, -1), (y1 - 1, x1 - 1, 1, 1), (y0, x1 - 1, -1, 1)):
        ring += [(y + sy, x + sx), (y + sy, x), (y, x + sx)]
    pts = boxes.select(*keys, *ident, F.explode(F.array(*[F.struct(a.alias("y"), b.alias("x")) for a, b in ring])).alias("_p")) \
        .select(*keys, *ident, "_p.y", "_p.x")
    back = lookup_clamped(cells.select(*keys, "y", "x", v), pts, keys, v).groupBy(*keys, *ident).agg(F.median(v).alias("back"))
    fore = cells_in_boxes(cells.select(*keys, "y", "x", v), boxes, keys, ident, size).groupBy(*keys, *ident).agg(F.avg(v).alias("fore"))
    return back.join(fore, keys + ident).withColumn("dark", F.col("fore") < F.col("back"))
