"""Numeric, colour and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale.operators.blocks import number_rows


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Aggregates per key joined back to the rows. The aggregate folds before its
    shuffle and AQE may split or broadcast the join, which a window over a hot key cannot."""
    table = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(table, keys)


def binarize_midrange(df: DataFrame, keys, v: str, frac: float = 0.5, scale: int = 1, of_max: bool = False) -> DataFrame:
    """Adds ``b``: ``scale`` where v > frac * (min + max) of its group (or frac * max), else 0."""
    df = with_group(df, list(keys), _lo=F.min(v), _hi=F.max(v))
    top = F.col("_hi") if of_max else F.col("_lo") + F.col("_hi")
    return df.withColumn("b", F.when(F.col(v) > F.lit(frac) * top, scale).otherwise(0)).drop("_lo", "_hi")


def norm_max(df: DataFrame, keys, v: str, out: str = "normed") -> DataFrame:
    return with_group(df, list(keys), _hi=F.max(v)).withColumn(out, F.try_divide(F.col(v), F.col("_hi"))).drop("_hi")


def softmax(df: DataFrame, keys, v: str, out: str = "soft") -> DataFrame:
    """Softmax per group with the exponent clipped to +-100."""
    df = df.withColumn("_e", F.exp(F.least(F.greatest(F.col(v), F.lit(-100.0)), F.lit(100.0))))
    return with_group(df, list(keys), _s=F.sum("_e")).withColumn(out, F.col("_e") / F.col("_s")).drop("_e", "_s")


def row_norm(col) -> Column:
    """Euclidean norm of an array column."""
    return F.sqrt(F.aggregate(_as_col(col), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def log_add(x, y) -> Column:
    """log(exp(x) + exp(y)); the larger one when they differ by more than 10."""
    x, y = _as_col(x), _as_col(y)
    return F.when(F.abs(x - y) > 10, F.greatest(x, y)).otherwise(F.ln(F.exp(x - y) + 1) + y)


def rgb2int(r, g, b) -> Column:
    r, g, b = (_as_col(c).cast("int") for c in (r, g, b))
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b).bitwiseAND(0xFFFFFF)


def int2rgb(c) -> list[Column]:
    c = _as_col(c)
    return [F.shiftright(c, s).bitwiseAND(0xFF).alias(n) for n, s in (("r", 16), ("g", 8), ("b", 0))]


def seg_black(c) -> Column:
    c = _as_col(c)
    return F.when(c == 0xFFFFFF, 0).otherwise(c)


def seg_white(c) -> Column:
    c = _as_col(c)
    return F.when(c == 0, 0xFFFFFF).otherwise(c)


# Which bytes of a label name the level.
LEVEL_MASK = {"column": 0xFF0000, "paragraph": 0xFFFF00, "line": 0xFFFFFF}


def segment_level(label, level: str) -> Column:
    """Label at a level; labels above 0x800000 are cleared before masking."""
    label = _as_col(label)
    return F.when(label > 0x800000, 0).otherwise(label).bitwiseAND(LEVEL_MASK[level])


# RGB to XYZ weights (rows r, g, b), the knee and its line.
XYZ = [[0.490, 0.177, 0.0], [0.310, 0.812, 0.01], [0.2, 0.011, 0.990]]
KNEE, SLOPE, OFFSET, KNEE_BACK = 0.008856, 7.787, 0.138, 0.206897


def rgb_to_lab(r, g, b, white: float = 255.0) -> list[Column]:
    """CIELab columns L, A, B."""
    rgb = [_as_col(c).cast("double") for c in (r, g, b)]

    def channel(j):
        total = sum(XYZ[i][j] for i in range(3)) * white
        t = (rgb[0] * XYZ[0][j] + rgb[1] * XYZ[1][j] + rgb[2] * XYZ[2][j]) / total
        return F.when(t > KNEE, F.cbrt(t)).otherwise(t * SLOPE + OFFSET)

    x, y, z = (channel(j) for j in range(3))
    return [(y * 116 - 16).alias("L"), ((x - y) * 500).alias("A"), ((y - z) * 200).alias("B")]


def _inverse3(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det],
            [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det],
            [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]


def lab_to_rgb(L, A, B, white: float = 255.0) -> list[Column]:
    """Inverse of :func:`rgb_to_lab` (columns r, g, b, not rounded)."""
    L, A, B = _as_col(L), _as_col(A), _as_col(B)
    fy = (L + 16) / 116
    fs = [fy + A / 500, fy, fy - B / 200]
    xyz = [F.when(t > KNEE_BACK, F.pow(t, F.lit(3.0))).otherwise((t - OFFSET) / SLOPE) * (sum(XYZ[i][j] for i in range(3)) * white)
           for j, t in enumerate(fs)]
    inv = _inverse3(XYZ)
    return [(xyz[0] * inv[0][j] + xyz[1] * inv[1][j] + xyz[2] * inv[2][j]).alias(n) for j, n in enumerate("rgb")]


def take_every(df: DataFrame, keys, order, block, k: int, skip: bool = False) -> DataFrame:
    """Every k-th row of a key, the first one included; ``skip`` keeps the others."""
    hit = (F.col("_rn") - 1) % k == 0
    return number_rows(df, keys, order, block, "_rn").where(~hit if skip else hit).drop("_rn")


def frange(lo, hi, step) -> Column:
    """Array of lo, lo + step, ... below hi (above it for a negative step); numbers or columns."""
    lo, hi, step = (x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi, step))
    n = F.ceil((hi - lo) / step)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: lo + i * step)) \
        .otherwise(F.array().cast("array<double>"))


def lookup_clamped(grid: DataFrame, points: DataFrame, keys, v: str, fill: str | None = None) -> DataFrame:
    """Value of ``grid`` (keys, y, x, v) at points (keys, y, x, ...). Indices outside are
    clamped to the border; with ``fill='origin'`` too large ones go to index 0 instead.
    Cells without a row are 0. Two grouped joins, no cell set is gathered; the points are hashed, so that the cells are not sorted."""
    keys = list(keys)
    size = grid.groupBy(*keys).agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))

    def index(c, m):
        if fill == "origin":
            return F.when(F.col(c) > F.col(m), 0).otherwise(F.col(c))
        return F.greatest(F.least(F.col(c), F.col(m)), F.lit(0))

    p = points.join(size.hint("shuffle_hash"), keys).withColumn("_gy", index("y", "_my")).withColumn("_gx", index("x", "_mx")).drop("_my", "_mx")
    g = grid.select(*keys, F.col("y").alias("_gy"), F.col("x").alias("_gx"), v)
    return p.hint("shuffle_hash").join(g, keys + ["_gy", "_gx"], "left").withColumn(v, F.coalesce(v, F.lit(0))) \
        .withColumnsRenamed({"_gy": "gy", "_gx": "gx"})


def testset(col, sequence: int = 0, frac: int = 10) -> Column:
    """Deterministic test-fold choice by the sine of the index."""
    h = F.floor(F.abs(F.sin(_as_col(col).cast("double"))) * 1.23456789e6).cast("bigint")
    return h % frac == sequence


def dist(a, b) -> Column:
    """Euclidean distance of two arrays."""
    sq = F.zip_with(_as_col(a), _as_col(b), lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def topk_classes(probs, k: int) -> Column:
    """The k best (prob, class index) of a probability array, best first, low index on ties."""
    ranked = F.transform(_as_col(probs), lambda p, i: F.struct((-p).alias("neg"), i.alias("class")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda s: F.struct((-s["neg"]).alias("prob"), s["class"].alias("class")))


def argmax(probs) -> Column:
    probs = _as_col(probs)
    return F.array_position(probs, F.array_max(probs)) - 1
