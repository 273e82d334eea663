"""Ranks, top-k and repeatable samples.

Ranks of a possibly hot key never go through one window task: either the kept rows
fold to bounded arrays, or the rank is a two-level scan over value blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescale.operators.blocks import number_rows, rank_all

SALTS = 64


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key. A salted window keeps n per (key, salt) first, so a
    hot key is ranked in SALTS parts and the last window sees n * SALTS rows at most.
    ``order`` must be total."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
    part = df.withColumn("_s", salt)
    pre = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order))).where(F.col("_r") <= n)
    out = pre.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_s")
    return out.withColumnRenamed("_r", rank) if rank else out.drop("_r")


def sort_boxes(df: DataFrame, keys: list[str], direction: str, block_rows: int = 512) -> DataFrame:
    """Adds ``idx`` from 0 by mid-point: left-right, top-down or bottom-up; ties by id.
    Pages are cut into bands of the sort axis, so a huge page is many tasks."""
    lo, hi = ("x0", "x1") if direction == "left-right" else ("y0", "y1")
    sign = -1 if direction == "bottom-up" else 1
    mid = (F.col(lo) + F.col(hi)) * sign
    d = df.withColumn("_m", mid).withColumn("_o", F.col("id") * sign)
    return number_rows(d, keys, ["_m", "_o"], F.floor(F.col("_m") / (2 * block_rows)), "_i") \
        .withColumn("idx", F.col("_i") - 1).drop("_m", "_i", "_o")


def select_regions(df: DataFrame, keys: list[str], score: Column, least: float, nbest: int) -> DataFrame:
    """At most ``nbest`` regions per key, and of those the ones scoring above ``least``.
    ``score`` is any column: an expression or a pandas UDF."""
    d = df.withColumn("score", score).where(F.col("score") > least)
    return first_per_key(d, keys, [F.desc("score"), F.asc("id")], nbest)


def rank_areas(df: DataFrame, keys: list[str], k: int, by: str = "area", direction: str = "top-down", offset: int = 0,
               min_aspect: float | None = None, max_aspect: float | None = None) -> DataFrame:
    """Detected areas for a template: aspect filter, boxes inside another dropped, the k
    largest (or k lowest, by="low"), numbered in reading direction from 0 after dropping
    the first ``offset``. At most k rows of a page are left to number."""
    from pagescale.functions.boxes import area, aspect
    from pagescale.operators.joins import drop_nested
    d = drop_nested(df, keys)
    if min_aspect is not None:
        d = d.where(aspect() > min_aspect)
    if max_aspect is not None:
        d = d.where(aspect() < max_aspect)
    d = d.withColumn("_a", area())
    order = [F.desc("_a"), F.asc("id")] if by == "area" else [F.desc("y1"), F.asc("id")]
    d = first_per_key(d, keys, order, k).drop("_a")
    mid = F.col("y0") + F.col("y1") if direction == "top-down" else F.col("x0") + F.col("x1")
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(mid, "id")))
    return d.where(F.col("_r") > offset).withColumn("rank", F.col("_r") - offset - 1).drop("_r")


def topk(cands: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows of the k best classes per sample with their rank."""
    return first_per_key(cands, keys, [F.desc("score"), F.asc("class")], k, "rk")


def per_class_cap(df: DataFrame, label: str, order: list[Column], n: int) -> DataFrame:
    return first_per_key(df, [label], order, n, "rk")


def hash_key(ident: list[str], seed: int) -> Column:
    """A repeatable random order: md5 of the row's id and a seed."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ident], F.lit(str(seed))))


def sample_batch(df: DataFrame, ident: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in a repeatable random order (each task keeps its n, then a merge)."""
    return df.withColumn("_h", hash_key(ident, seed)).orderBy("_h").limit(n).drop("_h")


def split_dataset(df: DataFrame, ident: list[str], frac: float, mode: str = "prefix", seed: int = 0) -> DataFrame:
    """Adds ``split``. prefix: the first floor(n * frac) rows by id are train, the rest
    test. random: the id's hash below 1 - frac is train, so ``frac`` is the test share."""
    if mode == "random":
        h = F.conv(F.substring(hash_key(ident, seed), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
        return df.withColumn("split", F.when(h < 1 - frac, "train").otherwise("test"))
    total = df.agg(F.count("*").alias("n")).scalar()
    d = rank_all(df, ident, "_rn")
    return d.withColumn("split", F.when(F.col("_rn") <= F.floor(total * F.lit(frac)), "train").otherwise("test")).drop("_rn")


def select_corpus(lines: DataFrame, ident: list[str], text: str, vocab: DataFrame, n: int, mode: str = "score", seed: int = 0) -> DataFrame:
    """``n`` lines of a corpus: by the summed corpus frequency of their characters (ties:
    text desc), the first n, or n at random. Lines whose first character is outside the
    vocabulary are dropped. The count table has one row per character of the script."""
    vocab = vocab.select(F.col("ch").alias("_f")).distinct()
    d = lines.where(F.length(text) > 0).withColumn("_f", F.substring(text, 1, 1)).join(vocab, "_f", "left_semi").drop("_f")
    if mode == "head":
        return d.orderBy(*ident).limit(n)
    if mode == "random":
        return sample_batch(d, ident, n, seed)
    chars = d.select(F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    per = d.select(*ident, F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").groupBy(*ident, "ch").agg(F.count("*").alias("k"))
    score = per.join(chars, "ch").groupBy(*ident).agg(F.sum(F.col("k") * F.col("n")).alias("score"))
    return d.join(score, ident).orderBy(F.desc("score"), F.desc(text), *ident).limit(n)


# The augmentation grids (degrees, pixels).
ROTATIONS, SHIFTS, BORDERS = [-10, 0, 10], [-20, -10, 0, 10, 20], [0, 5, 10]


def augmentation_plan(df: DataFrame, ident: list[str]) -> DataFrame:
    """Each seed sample with every rotation, shift and border of the grids. The grid is
    exploded inside the row: nothing is joined."""
    out = df.select(*ident)
    for name, grid in (("rotation", ROTATIONS), ("dx", SHIFTS), ("dy", SHIFTS), ("border", BORDERS)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(g) for g in grid])))
    return out


def noise_plan(df: DataFrame, ident: list[str], backgrounds: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """A share of the samples gets a background (bg_id from 0) chosen by hash."""
    n = backgrounds.agg(F.count("*").alias("n")).scalar()
    h = F.conv(F.substring(hash_key(ident, seed), 1, 8), 16, 10).cast("bigint")
    pick = F.conv(F.substring(hash_key(ident, seed), 9, 8), 16, 10).cast("bigint")
    return df.select(*ident, F.when(h < int(ratio * 2 ** 32), pick % n).alias("bg_id"))
