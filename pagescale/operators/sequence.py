"""Operators over ordered sequences: profiles, pivots, time steps, table rows.

Each takes a ``block`` width for the position, so that one long sequence is many
tasks (see ``blocks``). Results do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale.functions.numeric import with_group
from pagescale.operators.blocks import Scan, islands, number_rows, scan
from pagescale.operators.ranking import first_per_key
from pagescale.session import materialise

BLOCK = 4096


def _block(pos: str, width: int = BLOCK) -> Column:
    return F.floor(F.col(pos) / width)


def renumber_labels(cells: DataFrame, keys: list[str], width: int = 1 << 16) -> DataFrame:
    """Correspondence (keys, label, new): dense numbers in label order, background 0 stays 0."""
    labels = cells.where("label <> 0").select(*keys, "label").distinct()
    return number_rows(labels, keys, ["label"], _block("label", width), "new")


def apply_renumbering(cells: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    return cells.join(mapping, list(keys) + ["label"], "left").withColumn("label", F.coalesce("new", F.lit(0))).drop("new")


def renumber_by_xcenter(objects: DataFrame, keys: list[str], width: int | None = 1 << 16) -> DataFrame:
    """(keys, label, new): labels numbered from 1 by x-centre; a missing box goes last. ``width=None`` reads the
    objects once, in a plain window, for keys whose objects come from one input row."""
    xc = F.col("x0") + F.col("x1")
    d = objects.withColumn("_xc", F.struct(xc.isNull().alias("missing"), xc.alias("at")))
    block = None if width is None else F.coalesce(F.floor(xc / width), F.lit(1 << 40) + F.floor(F.col("label") / width))  # behind every block of a box
    return number_rows(d, keys, ["_xc", "label"], block, "new").select(*keys, "label", "new")


def ordered_by_xcenter(objects: DataFrame, keys: list[str], width: int = 1 << 16) -> DataFrame:
    """Whether x-centres do not fall along the labels, per key."""
    d = scan(objects.withColumn("_xc", F.col("x0") + F.col("x1")), keys, ["label"], _block("label", width), _p=Scan("prev", F.col("_xc")))
    return d.groupBy(*keys).agg(F.min(F.coalesce(F.col("_p") <= F.col("_xc"), F.lit(True))).alias("ordered"))


def moving_mean(df: DataFrame, keys: list[str], order: list[str], block: Column, value: str, n: int, bucket: int = 8192, out: str = "mean") -> DataFrame:
    """Mean of the last n values of each key, fewer at its start. Rows are numbered, cut
    into buckets of that number, and the last n - 1 rows of a bucket are also handed to
    the next one, so no key is one task."""
    bucket = max(bucket, n)
    d = number_rows(df, keys, order, block, "_rn")
    own = F.floor((F.col("_rn") - 1) / bucket)
    late = (F.col("_rn") - 1) % bucket >= bucket - (n - 1)
    d = d.withColumn("_b", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    from pyspark.sql import Window
    w = Window.partitionBy(*keys, "_b").orderBy("_rn").rowsBetween(-(n - 1), 0)
    return d.withColumn(out, F.avg(value).over(w)).where(F.col("_b") == own).drop("_rn", "_b")


# ---- profiles -------------------------------------------------------------

def white_runs(profile: DataFrame, keys: list[str], thres, width, block: int = BLOCK) -> DataFrame:
    """Maximal runs of positions with v < thres, at least ``width`` long: (keys, lo, hi) half-open."""
    white = profile.where(F.col("v") < thres)
    runs = islands(white, keys, "pos", "pos", ["pos"], _block("pos", block), gap=1)
    return runs.groupBy(*keys, "island").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi")) \
        .where(F.col("hi") - F.col("lo") >= width).drop("island")


def cut_projection(profile: DataFrame, keys: list[str], width, thres, block: int = BLOCK) -> DataFrame:
    """Groups between the white runs, borders included; none with fewer than two runs. The profile, a row per position, is
    written once and read by every scan, not made anew for each."""
    profile = materialise(profile)
    runs = materialise(white_runs(profile, keys, thres, width, block))
    end = profile.groupBy(*keys).agg((F.max("pos") + 1).alias("_end"))
    d = scan(runs, keys, ["lo"], _block("lo", block), _p=Scan("prev", F.col("hi")), _n=Scan("next", F.col("lo")))
    d = d.where(F.col("_p").isNotNull() | F.col("_n").isNotNull()).join(end, keys)
    head = F.when(F.col("_p").isNull(), F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("lo").alias("hi")))
    tail = F.struct(F.col("hi").alias("lo"), F.coalesce("_n", "_end").alias("hi"))
    return d.select(*keys, F.inline(F.array_compact(F.array(head, tail))))


def extrema(profile: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Strict local minima and maxima inside the profile: (keys, pos, v, kind)."""
    d = scan(profile, keys, ["pos"], _block("pos", block), _p=Scan("prev", F.col("v")), _n=Scan("next", F.col("v")))
    v, p, n = F.col("v"), F.col("_p"), F.col("_n")
    kind = F.when((v < p) & (v < n), "min").when((v > p) & (v > n), "max")
    return d.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*keys, "pos", "v", "kind")


def reduce_pivots(pivots: DataFrame, keys: list[str], gap: int, keep: str, block: int = BLOCK) -> DataFrame:
    """Clusters of positions whose neighbours lie at most ``gap`` apart keep one: ``max``,
    ``min`` or ``low`` (smallest profile value, then smallest position)."""
    d = islands(pivots, keys, "pos", "pos", ["pos"], _block("pos", block), gap=gap)
    pick = {"max": lambda: F.max("pos"), "min": lambda: F.min("pos"), "low": lambda: F.min(F.struct("v", "pos"))["pos"]}[keep]()
    return d.groupBy(*keys, "island").agg(pick.alias("pos"), F.count("*").alias("n")).drop("island")


def smooth_pivots(profile: DataFrame, keys: list[str], mode: str, thres, cf: int | None = None, block: int = BLOCK) -> DataFrame:
    """Minima of a profile that are real valleys, judged by the maxima around them.

    ``hand``: both maxima higher by ``thres``, more than ``cf`` apart, one of them more
    than 5 away, and the left one more than ``cf`` from the next but one. ``tab``: both
    higher and more than ``cf`` apart. ``dash``: either one higher, more than 11 apart,
    left to next but one more than 20. A minimum that lacks a maximum it is asked for stays.
    """
    # Fixed values of the dash form.
    cf = 11 if mode == "dash" else cf
    third_gap = 20 if mode == "dash" else cf
    e = extrema(profile, keys, block)
    mx = F.when(F.col("kind") == "max", F.struct("pos", "v"))
    e = scan(e, keys, ["pos"], _block("pos", block), _l=Scan("prev", mx), _r=Scan("next", mx))
    far = F.when(F.col("kind") == "max", F.col("_r.pos"))
    e = scan(e, keys, ["pos"], _block("pos", block), _rr=Scan("next", far))
    e = e.where("kind = 'min'")
    lv, rv, lp, rp = F.col("_l.v") - F.col("v"), F.col("_r.v") - F.col("v"), F.col("_l.pos"), F.col("_r.pos")
    thr = F.col(thres) if isinstance(thres, str) else F.lit(thres)
    high = ((lv > thr) | (rv > thr)) if mode == "dash" else ((lv > thr) & (rv > thr))
    ok = high & (rp - lp > cf)
    if mode == "hand":
        ok = ok & ((F.col("pos") - lp > 5) | (rp - F.col("pos") > 5))
    if mode in ("hand", "dash"):
        # the next-but-one maximum of the right one: missing at the end of the profile
        ok = ok & (F.col("_rr").isNull() | (F.col("_rr") - lp > third_gap))
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    return e.where(lone | ok).select(*keys, "pos", "v")


def detect_pivots(profile: DataFrame, keys: list[str], n: int, margin: int, gap: int, keep: str = "max", least: float | None = None,
                  block: int = BLOCK) -> DataFrame:
    """The n highest profile values, those near the borders or below ``least`` dropped,
    close ones reduced."""
    top = first_per_key(profile, keys, [F.desc("v"), F.asc("pos")], n)
    size = profile.groupBy(*keys).agg((F.max("pos") + 1).alias("_n"))
    d = top.join(size, keys).where((F.col("pos") > margin) & (F.col("pos") < F.col("_n") - margin))
    if least is not None:
        d = d.where(F.col("v") >= least)
    return reduce_pivots(d.drop("_n"), keys, gap, keep, block)


def step_pivots(profile: DataFrame, keys: list[str], n: int = 20, margin: int = 40, least: int = 50, gap: int = 50, block: int = BLOCK) -> DataFrame:
    """Places where the profile rises most: top n first differences, behind ``margin``,
    of at least ``least``, close ones reduced to the last."""
    d = scan(profile, keys, ["pos"], _block("pos", block), _n=Scan("next", F.col("v")))
    d = d.where(F.col("_n").isNotNull()).select(*keys, "pos", (F.col("_n") - F.col("v")).alias("v"))
    d = first_per_key(d, keys, [F.desc("v"), F.asc("pos")], n).where((F.col("pos") > margin) & (F.col("v") >= least))
    return reduce_pivots(d, keys, gap, "max", block)


def grid_pitch(profile: DataFrame, keys: list[str], height: str, share: float = 0.2, least: int = 10, block: int = BLOCK) -> DataFrame:
    """Median distance of separator positions (v > share * height, distance > least); without
    one, half the width when the first separator lies inside, else the width."""
    size = profile.groupBy(*keys).agg((F.max("pos") + 1).alias("_w"))
    sep = profile.where(F.col("v") > F.col(height) * share)
    d = scan(sep, keys, ["pos"], _block("pos", block), _p=Scan("prev", F.col("pos")))
    gap = F.col("pos") - F.col("_p")
    got = d.groupBy(*keys).agg(F.median(F.when(gap > least, gap)).alias("_m"), F.min("pos").alias("_f"))
    j = size.join(got, keys, "left")
    inside = (F.col("_f") > least) & (F.col("_f") < F.col("_w") - least)
    return j.select(*keys, F.coalesce(F.col("_m").cast("bigint"), F.when(inside, F.floor(F.col("_w") / 2)), F.col("_w")).alias("pitch"))


def is_dividable(profile: DataFrame, keys: list[str], vertical: bool = False, border: int = 20, width: str | None = None) -> DataFrame:
    """Whether a cell can be split: a position away from the borders above 7 * (mode + 1),
    or above a third of ``width`` (a column) vertically. The mode is the smallest of the most frequent values."""
    size = profile.groupBy(*keys).agg((F.max("pos") + 1).alias("_n"))
    d = profile.join(size, keys)
    if vertical:
        high = F.col("v") > F.col(width) / 3
    else:
        mode = profile.groupBy(*keys, "v").agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("c"), "v"))["v"].alias("_mode"))
        d = d.join(mode, keys)
        high = F.col("v") > (F.col("_mode") + 1) * 7
    inner = (F.col("pos") > border) & (F.col("pos") < F.col("_n") - border)
    return d.groupBy(*keys).agg(F.max(high & inner).alias("dividable"))


def trim_limits(profile: DataFrame, keys: list[str], side: str, thres: int, block: int = BLOCK) -> DataFrame:
    """First positions from both ends with v > thres. An end whose border value exceeds half
    of ``side`` uses the first position where the value steps up by more than ``thres``
    inwards instead. Nothing found leaves the end."""
    d = scan(profile, keys, ["pos"], _block("pos", block), _p=Scan("prev", F.col("v")), _n=Scan("next", F.col("v")))
    v, pos = F.col("v"), F.col("pos")
    got = d.groupBy(*keys).agg(
        F.min(F.when(v > thres, pos)).alias("_lo"), F.min(F.when(v > F.col("_p") + thres, pos)).alias("_lo_step"),
        F.max(F.when(v > thres, pos)).alias("_hi"), F.max(F.when(v > F.col("_n") + thres, pos)).alias("_hi_step"),
        F.max(F.when(F.col("_p").isNull(), v)).alias("_v0"), F.max(F.when(F.col("_n").isNull(), v)).alias("_v1"),
        F.max("pos").alias("_last"), F.max(side).alias("_s"))
    lo = F.when(F.col("_v0") > F.col("_s") / 2, F.col("_lo_step")).otherwise(F.col("_lo"))
    hi = F.when(F.col("_v1") > F.col("_s") / 2, F.col("_hi_step")).otherwise(F.col("_hi"))
    return got.select(*keys, F.coalesce(lo, F.lit(0)).alias("lo"), F.coalesce(hi, F.col("_last")).alias("hi"))


def profile_kde(profile: DataFrame, keys: list[str], n: int, h: float) -> DataFrame:
    """Gaussian density of the profile at n places spread from 0 to its last position
    (cut at 4h). A position offers itself to the places in reach; the offers fold."""
    size = profile.groupBy(*keys).agg(F.max("pos").alias("_w"), F.sum("v").alias("_n")).where("_w > 0 and _n > 0")
    d = profile.where("v > 0").join(size, keys)
    step = F.col("_w") / F.lit(float(n - 1))
    lo = F.greatest(F.ceil((F.col("pos") - 4 * h) / step), F.lit(0))
    hi = F.least(F.floor((F.col("pos") + 4 * h) / step), F.lit(n - 1))
    d = d.where(lo <= hi).withColumn("j", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    dist = F.col("pos") - F.col("j") * step
    part = F.col("v") * F.exp(-dist * dist / (2 * h * h))
    got = d.groupBy(*keys, "j").agg(F.sum(part).alias("_d"), F.max("_n").alias("_n"))
    return got.select(*keys, "j", (F.col("_d") / (F.col("_n") * h * F.sqrt(F.lit(2 * 3.141592653589793)))).alias("density"))


# ---- table cells ----------------------------------------------------------

def cells_from_pivots(px: DataFrame, py: DataFrame, size: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Cells between consecutive cut positions of both axes, page borders added.
    ``size`` has (keys, h, w). The result is the whole grid of a page."""
    size = materialise(size)  # a row per page, read eight times

    def bands(p, end, lo, hi):
        all_pos = p.select(*keys, F.col("pos").cast("bigint").alias("pos")).unionByName(size.select(*keys, F.lit(0).cast("bigint").alias("pos"))) \
            .unionByName(size.select(*keys, F.col(end).cast("bigint").alias("pos"))).distinct()
        d = scan(all_pos, keys, ["pos"], _block("pos", block), _n=Scan("next", F.col("pos")))
        return d.where(F.col("_n").isNotNull()).select(*keys, F.col("pos").alias(lo), F.col("_n").alias(hi))

    return bands(py, "h", "y0", "y1").join(bands(px, "w", "x0", "x1"), list(keys))


def edge_flags(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Edge flags l, t, r, b of table cells (keys, cy, cx, left_open, top_open). All are 1;
    a cell that cannot be parted from its left (upper) neighbour clears the edge they
    share in both. Two equi-joins on the neighbour's place."""
    on = list(keys) + ["cy", "cx"]
    right = cells.select(*keys, "cy", (F.col("cx") - 1).alias("cx"), F.col("left_open").alias("_r"))
    low = cells.select(*keys, (F.col("cy") - 1).alias("cy"), "cx", F.col("top_open").alias("_b"))
    d = cells.join(right, on, "left").join(low, on, "left")

    def flag(open_):
        return F.when(F.coalesce(open_, F.lit(False)), 0).otherwise(1)
    return d.select(*on, flag(F.col("left_open")).alias("l"), flag(F.col("top_open")).alias("t"), flag(F.col("_r")).alias("r"), flag(F.col("_b")).alias("b"))


def detect_blocks(flags: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Spanning blocks: a start has l = t = 1; its end column is the first r = 1 at or right
    of it in its row, its end row the first b = 1 at or below it in that column. The flags are
    written once for the scans."""
    flags = materialise(flags)
    row = scan(flags, list(keys) + ["cy"], ["cx"], _block("cx", block), _ex=Scan("next", F.when(F.col("r") == 1, F.col("cx"))))
    starts = row.where("l = 1 and t = 1").select(*keys, "cy", "cx", F.when(F.col("r") == 1, F.col("cx")).otherwise(F.col("_ex")).alias("ex"))
    col = scan(flags, list(keys) + ["cx"], ["cy"], _block("cy", block), _ey=Scan("next", F.when(F.col("b") == 1, F.col("cy"))))
    ends = col.select(*keys, "cy", F.col("cx").alias("ex"), F.when(F.col("b") == 1, F.col("cy")).otherwise(F.col("_ey")).alias("ey"))
    return starts.join(ends, list(keys) + ["cy", "ex"]).select(
        *keys, F.col("cy").alias("y0"), (F.col("ey") + 1).alias("y1"), F.col("cx").alias("x0"), (F.col("ex") + 1).alias("x1"))


def merge_cells(cells: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Runs of cells of a row that cannot be parted: (keys, cy, x0, x1) in cell columns."""
    d = cells.withColumn("_new", F.when(F.col("left_open"), 0).otherwise(1))
    d = scan(d, list(keys) + ["cy"], ["cx"], _block("cx", block), _g=Scan("sum", F.col("_new")))
    return d.groupBy(*keys, "cy", "_g").agg(F.min("cx").alias("x0"), (F.max("cx") + 1).alias("x1")).drop("_g")


# ---- boxes along an axis --------------------------------------------------

def group_lines(boxes: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Adds ``line`` from 1: boxes whose y ranges chain together (ends included)."""
    return islands(boxes, keys, "y0", "y1", ["y0", "x0", "id"], _block("y0", block), out="line")


def merge_intervals(boxes: DataFrame, keys: list[str], ratio: float = 5, block: int = BLOCK) -> DataFrame:
    """Word intervals (keys, lo, hi): boxes overlapping along x merge; an interval stays when
    the span to the end of the next one is more than ``ratio`` times the gap between; the
    last one stays."""
    d = islands(boxes, keys, "x0", "x1", ["x0", "id"], _block("x0", block))
    runs = d.groupBy(*keys, "island").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    runs = scan(runs, keys, ["lo"], _block("lo", block), _n=Scan("next", F.struct("lo", "hi")))
    gap, span = F.col("_n.lo") - F.col("hi"), F.col("_n.hi") - F.col("lo")
    return runs.where(F.col("_n").isNull() | (gap == 0) | (span > ratio * gap)).select(*keys, "lo", "hi")


# ---- frame posteriors -----------------------------------------------------

def best_steps(post: DataFrame, key: str) -> DataFrame:
    """Best class per time step (ties: lower class) with its probability, folded."""
    b = post.groupBy(key, "t").agg(F.min(F.struct((-F.col("p")).alias("np"), "cls")).alias("_b"))
    return b.select(key, "t", F.col("_b.cls").alias("cls"), (-F.col("_b.np")).alias("p"))


def decode_greedy(post: DataFrame, key: str, blank: str, thr: float = 0.25, block: int = BLOCK) -> DataFrame:
    """Collapse-repeat decoding, one row per emitted class: (key, t, cls). A step whose best
    value is below thr times the sequence's largest counts as blank; a class is emitted
    where it differs from the step before, so the first step emits nothing."""
    b = with_group(best_steps(post, key), [key], _top=F.max("p"))
    b = b.withColumn("cls", F.when(F.col("p") < thr * F.col("_top"), F.lit(blank)).otherwise(F.col("cls"))).drop("_top")
    b = scan(b, [key], ["t"], _block("t", block), _p=Scan("prev", F.col("cls")))
    return b.where((F.col("_p") != F.col("cls")) & (F.col("cls") != blank)).select(key, "t", "cls")


def decode_segments(post: DataFrame, key: str, blank: str, thr: float = 0.7, block: int = BLOCK) -> DataFrame:
    """Islands of steps whose blank probability is below ``thr``; each gives its largest
    value's place, class and probability: (key, segment, t, cls, p)."""
    free = post.groupBy(key, "t").agg(F.max(F.when(F.col("cls") == blank, F.col("p")).otherwise(0.0)).alias("_pb")).where(F.col("_pb") < thr)
    seg = islands(free.select(key, "t"), [key], "t", "t", ["t"], _block("t", block), gap=1, out="segment")
    top = post.join(seg, [key, "t"]).groupBy(key, "segment").agg(F.min(F.struct((-F.col("p")).alias("np"), "t", "cls")).alias("_b"))
    return top.select(key, "segment", F.col("_b.t").alias("t"), F.col("_b.cls").alias("cls"), (-F.col("_b.np")).alias("p"))


def make_target(df: DataFrame, keep: list[str], classes: Column, blank: str) -> DataFrame:
    """Blank-interleaved target of 2n + 1 steps: (keep, step, cls), made inside the row."""
    inner = F.flatten(F.transform(classes, lambda c: F.array(F.lit(blank), c)))
    return df.select(*keep, F.posexplode(F.concat(inner, F.array(F.lit(blank)))).alias("step", "cls"))
