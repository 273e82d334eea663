"""Box columns. A box is flat half-open columns y0, x0, y1, x1 (rows, columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ["y0", "x0", "y1", "x1"]


def _int(c: Column) -> Column:
    return c.cast("bigint")


def to_boxes(df: DataFrame, layout: str, height: str | None = None) -> DataFrame:
    """Bring a layout to flat box columns.

    raster: r0, r1, c0, c1; corners: bl_x, bl_y, br_x, br_y, tr_x, tr_y, tl_x, tl_y;
    xywh: x, y, w, h; points: px0, py0, px1, py1; math: mx0, my0, mx1, my1 with the
    y axis pointing up in an image of ``height`` (y -> height - y - 1).
    """
    c = F.col
    made = {
        "raster": lambda: (c("r0"), c("c0"), c("r1"), c("c1"), ["r0", "r1", "c0", "c1"]),
        "corners": lambda: (c("tl_y"), c("bl_x"), c("bl_y"), c("br_x"),
                            [f"{k}_{a}" for k in ("bl", "br", "tr", "tl") for a in "xy"]),
        "xywh": lambda: (c("y"), c("x"), c("y") + c("h"), c("x") + c("w"), ["x", "y", "w", "h"]),
        "points": lambda: (c("py0"), c("px0"), c("py1"), c("px1"), ["px0", "py0", "px1", "py1"]),
        "math": lambda: (c(height) - c("my1") - 1, c("mx0"), c(height) - c("my0") - 1, c("mx1"), ["mx0", "my0", "mx1", "my1"]),
    }
    if layout not in made:
        raise ValueError(f"unknown layout: {layout}")
    y0, x0, y1, x1, used = made[layout]()
    rest = [n for n in df.columns if n not in used]
    return df.select(*rest, y0.alias("y0"), x0.alias("x0"), y1.alias("y1"), x1.alias("x1"))


def from_boxes(df: DataFrame, layout: str, height: str | None = None) -> DataFrame:
    """Inverse of :func:`to_boxes`."""
    y0, x0, y1, x1 = (F.col(b) for b in BOX)
    cols = {
        "raster": {"r0": y0, "r1": y1, "c0": x0, "c1": x1},
        "corners": {"bl_x": x0, "bl_y": y1, "br_x": x1, "br_y": y1, "tr_x": x1, "tr_y": y0, "tl_x": x0, "tl_y": y0},
        "xywh": {"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0},
        "points": {"px0": x0, "py0": y0, "px1": x1, "py1": y1},
        "math": {} if height is None else {"mx0": x0, "my0": F.col(height) - y1 - 1, "mx1": x1, "my1": F.col(height) - y0 - 1},
    }[layout]
    rest = [n for n in df.columns if n not in BOX and n not in cols]
    return df.select(*rest, *[v.alias(n) for n, v in cols.items()])


def width(p: str = "") -> Column:
    return F.col(p + "x1") - F.col(p + "x0")


def height(p: str = "") -> Column:
    return F.col(p + "y1") - F.col(p + "y0")


def area(p: str = "") -> Column:
    """Area; a negative side counts 0."""
    return F.greatest(width(p), F.lit(0)) * F.greatest(height(p), F.lit(0))


def aspect(p: str = "") -> Column:
    """Width over height, 100 for no height."""
    return F.when(height(p) == 0, 100.0).otherwise(F.try_divide(width(p).cast("double"), height(p)))


def box_measures(df: DataFrame) -> DataFrame:
    w, h = width(), height()
    tall = F.try_divide(h.cast("double"), w)
    return df.select("*", w.alias("width"), h.alias("height"), area().alias("area"), aspect().alias("aspect"),
                     tall.alias("tallness"), F.when(tall < 1, F.try_divide(F.lit(1.0), tall)).otherwise(tall).alias("aspect_normalized"),
                     F.greatest(w, h).alias("max_side"), F.least(w, h).alias("min_side"),
                     ((F.col("y0") + F.col("y1")) / 2).alias("ycenter"), ((F.col("x0") + F.col("x1")) / 2).alias("xcenter"))


def _set(df: DataFrame, **cols: Column) -> DataFrame:
    return df.withColumns(cols)


def shift_boxes(df: DataFrame, dy, dx, scale: int = 1) -> DataFrame:
    dy, dx = (F.col(d) if isinstance(d, str) else F.lit(d) for d in (dy, dx))
    return _set(df, y0=F.col("y0") + dy * scale, y1=F.col("y1") + dy * scale, x0=F.col("x0") + dx * scale, x1=F.col("x1") + dx * scale)


def pad_boxes(df: DataFrame, d: int) -> DataFrame:
    return _set(df, y0=F.col("y0") - d, x0=F.col("x0") - d, y1=F.col("y1") + d, x1=F.col("x1") + d)


def scale_boxes(df: DataFrame, ratio: float) -> DataFrame:
    """Scale by a ratio, cut to whole numbers towards 0."""
    return _set(df, **{b: _int(F.col(b) * ratio) for b in BOX})


def to_parent(child: DataFrame, parent: DataFrame, on) -> DataFrame:
    """Child boxes given inside a parent box, in the parent's page coordinates."""
    p = parent.select(*on, F.col("y0").alias("_py"), F.col("x0").alias("_px"))
    return shift_boxes(child.join(p, list(on)), "_py", "_px").drop("_py", "_px")


def to_ratio(child: DataFrame, parent: DataFrame, on) -> DataFrame:
    """Adds x0r, x1r, y0r, y1r: the child's ends as shares of the parent box."""
    p = parent.select(*on, *[F.col(b).alias(f"_p{b}") for b in BOX])
    j = child.join(p, list(on))
    cols = {f"{b}r": F.try_divide((F.col(b) - F.col(f"_p{b[0]}0")).cast("double"), F.col(f"_p{b[0]}1") - F.col(f"_p{b[0]}0")) for b in ("x0", "x1", "y0", "y1")}
    return j.withColumns(cols).drop(*[f"_p{b}" for b in BOX])


def cut_boxes(df: DataFrame, x0r="x0r", x1r="x1r", y0r="y0r", y1r="y1r") -> DataFrame:
    """Keep a ratio range of each axis (column names or numbers), whole numbers towards 0.
    An axis without a positive side stays as it is. (0, r) takes the left, (r, 1) the right."""
    def end(axis, r):
        lo, hi = F.col(axis + "0"), F.col(axis + "1")
        r = F.col(r) if isinstance(r, str) else F.lit(float(r))
        return _int(lo + (hi - lo) * r)

    out = {}
    for axis, a, b in (("x", x0r, x1r), ("y", y0r, y1r)):
        solid = F.col(axis + "1") - F.col(axis + "0") > 0
        out[axis + "0"] = F.when(solid, end(axis, a)).otherwise(F.col(axis + "0"))
        out[axis + "1"] = F.when(solid, end(axis, b)).otherwise(F.col(axis + "1"))
    return df.withColumns(out)


# ---- pair functions: a and b are column prefixes --------------------------

def box_union(a: str, b: str) -> list[Column]:
    return [(F.least if k.endswith("0") else F.greatest)(F.col(a + k), F.col(b + k)).alias(k) for k in BOX]


def box_intersect(a: str, b: str) -> list[Column]:
    return [(F.greatest if k.endswith("0") else F.least)(F.col(a + k), F.col(b + k)).alias(k) for k in BOX]


def overlap_len(a: str, b: str, axis: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.col(f"{a}{axis}1"), F.col(f"{b}{axis}1")) - F.greatest(F.col(f"{a}{axis}0"), F.col(f"{b}{axis}0")))


def overlap_rel(a: str, b: str, axis: str) -> Column:
    side = width if axis == "x" else height
    return overlap_len(a, b, axis).cast("double") / F.greatest(F.lit(1), side(a), side(b))


def overlaps(a: str, b: str, axis: str) -> Column:
    """Closed test: touching ends count."""
    return (F.col(f"{a}{axis}1") >= F.col(f"{b}{axis}0")) & (F.col(f"{b}{axis}1") >= F.col(f"{a}{axis}0"))


def contains(a: str, b: str) -> Column:
    """a holds b, equal ends allowed."""
    return ((F.col(a + "y0") <= F.col(b + "y0")) & (F.col(a + "y1") >= F.col(b + "y1"))
            & (F.col(a + "x0") <= F.col(b + "x0")) & (F.col(a + "x1") >= F.col(b + "x1")))


def center_in(a: str, b: str) -> Column:
    """The middle of a lies in b, ends included."""
    cy, cx = F.col(a + "y0") + F.col(a + "y1"), F.col(a + "x0") + F.col(a + "x1")
    return (cy >= 2 * F.col(b + "y0")) & (cy <= 2 * F.col(b + "y1")) & (cx >= 2 * F.col(b + "x0")) & (cx <= 2 * F.col(b + "x1"))


# ---- predicates and per-box rules -----------------------------------------

def is_hline() -> Column:
    return aspect() > 15


def is_vline() -> Column:
    return aspect() < 1 / 15


def box_rule(rule: str, lo: float = 0, hi: float = 0, scale: float = 1) -> Column:
    """Size filters by name. ``area`` strictly inside (lo, hi); ``min_sides`` wider than 3
    and higher than 4; ``any_side`` a side above lo; ``scaled`` sqrt(area) within
    [lo, hi] * scale; ``line`` width >= lo * scale and height >= hi * scale; ``noise``
    area below lo."""
    w, h, a = width(), height(), area()
    root = F.sqrt(a.cast("double"))
    return {
        "area": (a > lo) & (a < hi),
        "min_sides": (w > 3) & (h > 4),
        "any_side": (w > lo) | (h > lo),
        "scaled": (root >= lo * scale) & (root <= hi * scale),
        "line": (w >= lo * scale) & (h >= hi * scale),
        "noise": a < lo,
    }[rule]


def component_boxes(df: DataFrame, page_h: str, page_w: str, min_area: float, min_side: int = 3, grow: int = 2) -> DataFrame:
    """Components large enough, without the box that is the whole page, grown by
    ``grow`` but not past the page."""
    whole = (F.col("y0") <= 0) & (F.col("x0") <= 0) & (F.col("y1") >= F.col(page_h)) & (F.col("x1") >= F.col(page_w))
    kept = df.where((area() >= min_area) & (width() >= min_side) & (height() >= 1) & ~whole)
    return kept.withColumns({"y0": F.greatest(F.col("y0") - grow, F.lit(0)), "x0": F.greatest(F.col("x0") - grow, F.lit(0)),
                             "y1": F.least(F.col("y1") + grow, F.col(page_h)), "x1": F.least(F.col("x1") + grow, F.col(page_w))})


def date_slot(x, day_end, month_end) -> Column:
    """d left of the first pivot, m up to the second, y behind it."""
    return F.when(x < day_end, "d").when(x < month_end, "m").otherwise("y")


def reading_key(y, x, cols, step: int = 10) -> Column:
    """Reading order key that ignores height differences inside a step."""
    return F.floor(y / step) * step * cols + x


def trim_lines(df: DataFrame, keys, axis: str, size: str | None = None, margin: int = 5) -> DataFrame:
    """Limits of a line from its components. y: top ``margin`` above the highest (not
    below 0), bottom ``margin`` under the lowest (not past size - 1). x: leftmost start
    and largest right edge."""
    if axis == "x":
        return df.groupBy(*keys).agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    got = df.groupBy(*keys).agg(F.min("y0").alias("lo"), F.max("y1").alias("hi"), F.max(size).alias("_h"))
    return got.select(*keys, F.greatest(F.col("lo") - margin, F.lit(0)).alias("lo"), F.least(F.col("hi") + margin, F.col("_h") - 1).alias("hi"))


# ---- groups of boxes ------------------------------------------------------

def mbr(df: DataFrame, keys) -> DataFrame:
    """Smallest rectangle around each group of boxes."""
    return df.groupBy(*keys).agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"))


def classify_boxes(df: DataFrame, keys) -> DataFrame:
    """Adds ``type`` and ``line_height``. type: 0 text, 1 horizontal line, 2 vertical line;
    more than 6 times the page's mean text area: 3 (text, higher than twice the mean
    text height), 4 (vertical line), else 5. line_height: a text box (before the area
    rule) whose height lies within 0.66 and 1.5 of the mean."""
    df = df.withColumn("_t", F.when(is_hline(), 1).when(is_vline(), 2).otherwise(0))
    text = F.col("_t") == 0
    mean = df.groupBy(*keys).agg(F.avg(F.when(text, area())).alias("_a"), F.avg(F.when(text, height())).alias("_h"))
    d = df.join(mean, list(keys))
    big = area() > 6 * F.col("_a")
    kind = (F.when(big & text & (height() > 2 * F.col("_h")), 3).when(big & (F.col("_t") == 2), 4).when(big, 5).otherwise(F.col("_t")))
    fits = text & (height() > 0.66 * F.col("_h")) & (height() < 1.5 * F.col("_h"))
    return d.withColumn("type", kind).withColumn("line_height", fits).drop("_t", "_a", "_h")
