"""Box joins. Catalyst would run an overlap join as an equi-join on the page with a
residual filter, so a big page is one task that tries all pairs. Here boxes meet on
page tiles: a page is many keys, and only boxes of one tile are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale.functions import boxes as B

TILE = {"y": 16, "x": 64}


def _sided(df: DataFrame, keys, p: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(p + c) for c in df.columns if c not in keys])


def _tile(df: DataFrame, p: str, axes, size, start_only: bool = False) -> DataFrame:
    """Tile columns; a box stands in each tile its closed range meets, or in its start's."""
    for ax in axes:
        lo, hi = F.floor(F.col(f"{p}{ax}0") / size[ax]), F.floor(F.col(f"{p}{ax}1") / size[ax])
        df = df.withColumn(f"_t{ax}", lo if start_only else F.explode(F.sequence(lo, F.greatest(lo, hi))))
    return df


def _first_shared(axes, size) -> Column:
    """A pair meeting in several tiles counts in the first one only."""
    cond = F.lit(True)
    for ax in axes:
        cond = cond & (F.col(f"_t{ax}") == F.greatest(F.floor(F.col(f"a_{ax}0") / size[ax]), F.floor(F.col(f"b_{ax}0") / size[ax])))
    return cond


def box_pairs(a: DataFrame, b: DataFrame, keys: list[str], cond: Column, axes=("y", "x"), size=None) -> DataFrame:
    """Pairs of boxes of one page with closed overlap on ``axes`` and ``cond`` over
    columns prefixed a_ and b_. Every pair comes once."""
    size = size or TILE
    ta, tb = _tile(_sided(a, keys, "a_"), "a_", axes, size), _tile(_sided(b, keys, "b_"), "b_", axes, size)
    on = list(keys) + [f"_t{ax}" for ax in axes]
    near = _first_shared(axes, size)
    for ax in axes:
        near = near & B.overlaps("a_", "b_", ax)
    return ta.join(tb, on).where(near & cond).drop(*[f"_t{ax}" for ax in axes])


def interval_join(df: DataFrame, keys: list[str], axis: str, size: int | None = None) -> DataFrame:
    """Pairs a < b (by id) of intervals on one axis that meet, ends included, with the
    merged range: (keys, a, b, lo, hi)."""
    c = F.col
    sz = {axis: size or TILE[axis]}
    p = box_pairs(df, df, keys, c("a_id") < c("b_id"), (axis,), sz)
    return p.select(*keys, c("a_id").alias("a"), c("b_id").alias("b"), F.least(f"a_{axis}0", f"b_{axis}0").alias("lo"),
                    F.greatest(f"a_{axis}1", f"b_{axis}1").alias("hi"))


def overlap_join(df: DataFrame, keys: list[str], size=None) -> DataFrame:
    """Pairs a < b of boxes that meet on both axes, ends included."""
    p = box_pairs(df, df, keys, F.col("a_id") < F.col("b_id"), size=size)
    return p.select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def contains_join(a: DataFrame, b: DataFrame, keys: list[str], size=None) -> DataFrame:
    """Pairs where box a holds box b: b stands only in the tile of its corner."""
    size = size or TILE
    ta = _tile(_sided(a, keys, "a_"), "a_", ("y", "x"), size)
    tb = _tile(_sided(b, keys, "b_"), "b_", ("y", "x"), size, start_only=True)
    return ta.join(tb, list(keys) + ["_ty", "_tx"]).where(B.contains("a_", "b_")).drop("_ty", "_tx")


def _holder_join(inner: DataFrame, holders: DataFrame, keys, cond: Column, how: str, size=None) -> DataFrame:
    """Semi or anti join of ``inner`` by boxes that hold it and fulfil ``cond`` (a_ = holder,
    b_ = inner). No pair leaves the join, and a row stops at its first holder."""
    size = size or TILE
    ta = _tile(_sided(holders, keys, "a_"), "a_", ("y", "x"), size)
    tb = _tile(_sided(inner, keys, "b_"), "b_", ("y", "x"), size, start_only=True)
    ta = ta.select(*[F.col(c).alias("h_" + c) if c in list(keys) + ["_ty", "_tx"] else F.col(c) for c in ta.columns])
    on = B.contains("a_", "b_") & cond
    for c in list(keys) + ["_ty", "_tx"]:
        on = on & (F.col(c) == F.col("h_" + c))
    out = tb.join(ta, on, how)
    return out.select(*keys, *[F.col("b_" + c).alias(c) for c in inner.columns if c not in keys])


def not_contained(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of ``a`` in no containment relation, either way, with any box of ``b``."""
    out = _holder_join(a, b, keys, F.lit(True), "left_anti")
    holds = contains_join(a, b, keys).select(*keys, F.col("a_id").alias("id")).distinct()
    return out.join(holds, list(keys) + ["id"], "left_anti")


def drop_nested(df: DataFrame, keys: list[str], size=None) -> DataFrame:
    """Drop a box another box holds; of equal boxes the one with the largest id stays. A box is held against all boxes of
    its corner's tile, so ``size`` should not be far above that of the many boxes; the rows do not depend on it."""
    same = F.lit(True)
    for c in B.BOX:
        same = same & (F.col("a_" + c) == F.col("b_" + c))
    return _holder_join(df, df, keys, (F.col("a_id") != F.col("b_id")) & (~same | (F.col("a_id") > F.col("b_id"))), "left_anti", size)


def extend_regions(comps: DataFrame, regions: DataFrame, keys: list[str], share: float = 0.55) -> DataFrame:
    """Regions stretched to the components that lie in them by more than ``share`` of
    their own area."""
    cover = B.overlap_len("a_", "b_", "x") * B.overlap_len("a_", "b_", "y")
    p = box_pairs(comps, regions, keys, cover > share * B.area("a_"))
    got = p.groupBy(*keys, F.col("b_id").alias("id")).agg(F.min("a_y0").alias("cy0"), F.min("a_x0").alias("cx0"), F.max("a_y1").alias("cy1"),
                                                          F.max("a_x1").alias("cx1"), F.count("*").alias("n"))
    j = regions.join(got, list(keys) + ["id"], "left")
    return j.select(*keys, "id", F.least("y0", "cy0").alias("y0"), F.least("x0", "cx0").alias("x0"), F.greatest("y1", "cy1").alias("y1"),
                    F.greatest("x1", "cx1").alias("x1"), F.coalesce("n", F.lit(0)).alias("n"))


def cell_neighbors(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per table cell the number of cells left of it (their right edge is its left one),
    right of it and below it, with overlap on the other axis (equi-joins on the edge,
    split by the other axis's tile)."""
    c = F.col
    out = df.select(*keys, "id")
    for name, mine, theirs, other in (("n_left", "x0", "x1", "y"), ("n_right", "x1", "x0", "y"), ("n_lower", "y1", "y0", "x")):
        a = _tile(_sided(df, keys, "a_"), "a_", (other,), TILE).withColumn("_e", c(f"a_{mine}"))
        b = _tile(_sided(df, keys, "b_"), "b_", (other,), TILE).withColumn("_e", c(f"b_{theirs}"))
        hit = (c(f"a_{other}0") < c(f"b_{other}1")) & (c(f"b_{other}0") < c(f"a_{other}1")) & _first_shared((other,), TILE)
        n = a.join(b, list(keys) + ["_e", f"_t{other}"]).where(hit).groupBy(*keys, c("a_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(n, list(keys) + ["id"], "left")
    return out.na.fill(0)


def extract_template(words: DataFrame, areas: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """Template rows (tbl, key, seq, bbox_index, x0r, x1r, y0r, y1r) take the detected
    area of their rank, cut it by their ratios, and collect the words whose middle lies
    inside: (keys, tbl, key, seq, box columns, word columns). The template is a form
    description, small by nature, and broadcast: its few ranks would gather the areas in as many tasks.
    The areas are not broadcast, but hashed, so that the words need not be sorted."""
    a = areas.select(*keys, F.col("rank").alias("bbox_index"), *B.BOX)
    cells = B.cut_boxes(a.join(F.broadcast(template), "bbox_index")).select(*keys, "tbl", "key", "seq", *B.BOX)
    w = words.withColumns({"_my": F.floor((F.col("y0") + F.col("y1")) / 2), "_mx": F.floor((F.col("x0") + F.col("x1")) / 2)})
    size = TILE
    tw = _sided(w, keys, "a_").withColumn("_ty", F.floor(F.col("a__my") / size["y"])).withColumn("_tx", F.floor(F.col("a__mx") / size["x"]))
    tc = _tile(_sided(cells, keys, "b_"), "b_", ("y", "x"), size)
    got = tw.join(tc.hint("shuffle_hash"), list(keys) + ["_ty", "_tx"]).where(B.center_in("a_", "b_"))
    return got.select(*keys, F.col("b_tbl").alias("tbl"), F.col("b_key").alias("key"), F.col("b_seq").alias("seq"),
                      *[F.col("a_" + c).alias(c) for c in words.columns if c not in keys])


def review_pivots(pivots: DataFrame, comps: DataFrame, keys: list[str], near: float, min_area: float, min_side: int = 3) -> DataFrame:
    """Cut positions kept: none of the components (large enough, sides at least
    ``min_side``) has its middle nearer than ``near``. Components offer their middle to
    the whole positions around it; the anti-join is then on equal positions."""
    big = comps.where((B.area() >= min_area) & (B.width() >= min_side) & (B.height() >= min_side))
    mid = (F.col("x0") + F.col("x1")) / 2
    lo, hi = F.floor(mid - near) + 1, F.ceil(mid + near) - 1
    hit = big.select(*keys, F.explode(F.sequence(lo, F.greatest(lo, hi))).alias("pos"), mid.alias("_m")).where(F.abs(F.col("pos") - F.col("_m")) < near)
    return pivots.join(hit.select(*keys, "pos").distinct(), list(keys) + ["pos"], "left_anti")


def rename_keys(cells: DataFrame, names: DataFrame) -> DataFrame:
    """Two-level key names through a name table (old, new); unknown names stay."""
    for c in ("tbl", "key"):
        t = names.select(F.col("old").alias(c), F.col("new").alias("_n"))
        cells = cells.join(t, c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    return cells


def estimate_scale(boxes: DataFrame, keys: list[str], lo: float = 3, hi: float = 100) -> DataFrame:
    """Median of sqrt(area) weighted by area over boxes that no smaller box overlaps
    (ties: smaller id first), values strictly inside (lo, hi)."""
    a, b = B.area("a_"), B.area("b_")
    solid = (B.overlap_len("a_", "b_", "x") > 0) & (B.overlap_len("a_", "b_", "y") > 0)
    covered = box_pairs(boxes, boxes, keys, solid & ((b < a) | ((b == a) & (F.col("b_id") < F.col("a_id"))))) \
        .select(*keys, F.col("a_id").alias("id")).distinct()
    d = boxes.join(covered, list(keys) + ["id"], "left_anti").withColumn("_s", F.sqrt(B.area().cast("double"))).where((F.col("_s") > lo) & (F.col("_s") < hi))
    return d.groupBy(*keys).agg(F.percentile("_s", F.lit(0.5), B.area()).alias("scale"))


def filter_children(df: DataFrame, keys: list[str], bound: int = 5, size=None) -> DataFrame:
    """Boxes kept by the parent rule, outermost first: a box holding at least ``bound`` live
    boxes is rejected and they live on; one holding fewer stays and they are rejected.

    The containment edges are made once and written out; each round settles every box
    that no undecided box holds, so there are as many rounds as nesting levels (the
    driver sees one count per round). Equal boxes: the smaller id holds the larger. The boxes are read in every
    round, so they are written once. As in ``drop_nested`` a box is held against all of its corner's tile, whose ``size`` the rows do not depend on."""
    from pagescale.session import by_key, materialise
    df = by_key(materialise(df), *keys)
    same = F.lit(True)
    for c in B.BOX:
        same = same & (F.col("a_" + c) == F.col("b_" + c))
    k = list(keys)
    edges = contains_join(df, df, k, size).where((F.col("a_id") != F.col("b_id")) & (~same | (F.col("a_id") < F.col("b_id")))) \
        .select(*k, F.col("a_id").alias("p"), F.col("b_id").alias("id"))
    edges = materialise(edges)
    open_ = df.select(*k, "id")
    kept = None
    while True:
        live = edges.join(open_, k + ["id"], "left_semi").join(open_.withColumnRenamed("id", "p"), k + ["p"], "left_semi")
        n = live.groupBy(*k, F.col("p").alias("id")).agg(F.count("*").alias("n"))
        roots = open_.join(live.select(*k, "id").distinct(), k + ["id"], "left_anti")
        ruled = roots.join(n, k + ["id"], "left").select(*k, "id", (F.coalesce("n", F.lit(0)) < bound).alias("stay"))
        stays = ruled.where("stay").select(*k, "id")
        gone = live.join(stays.withColumnRenamed("id", "p"), k + ["p"], "left_semi").select(*k, "id").distinct()
        stays = materialise(stays)
        open_ = materialise(open_.join(ruled.select(*k, "id"), k + ["id"], "left_anti").join(gone, k + ["id"], "left_anti"))
        kept = stays if kept is None else kept.unionByName(stays)
        if open_.isEmpty():
            return df.join(kept, k + ["id"], "left_semi")
