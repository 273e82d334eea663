"""Vocabularies and labelled datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale.operators.blocks import number_rows, rank_all

# A character vocabulary holds at most one row per Unicode code point and may be
# broadcast. A vocabulary of longer tokens may be of any size.


def build_vocab(chars: DataFrame, ch: str = "ch", first: list[str] | None = None, pad: bool = False) -> DataFrame:
    """(ch, label): distinct values numbered from 0 (1 with ``pad``, 0 then means padding),
    in sorted order, or by first place when ``first`` names the order columns."""
    if first is None:
        d, order = chars.select(F.col(ch).alias("ch")).distinct(), ["ch"]
    else:
        d, order = chars.groupBy(F.col(ch).alias("ch")).agg(F.min(F.struct(*first)).alias("_f")), ["_f", "ch"]
    d = rank_all(d, order, "_rn")
    return d.select("ch", (F.col("_rn") - (0 if pad else 1)).alias("label"))


def map_labels(df: DataFrame, vocab: DataFrame, col: str, out: str, default) -> DataFrame:
    """Character to label (or back): left join with a vocabulary of (``col``, value); misses
    get ``default``. Spark broadcasts a small vocabulary by its size."""
    key, value = vocab.columns
    v = vocab.select(F.col(key).alias("_key"), F.col(value).alias("_val"))
    return df.join(v, F.col(col) == F.col("_key"), "left").withColumn(out, F.coalesce("_val", F.lit(default))).drop("_key", "_val")


def merge_vocab(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vocabulary ``a`` (ch, label) kept, unknown characters of ``b`` (ch, pos) added with
    the next labels in order of first place."""
    fresh = b.join(a.select("ch"), "ch", "left_anti").groupBy("ch").agg(F.min("pos").alias("_f"))
    base = a.agg(F.coalesce(F.max("label") + 1, F.lit(0)).alias("n")).scalar()
    fresh = rank_all(fresh, ["_f", "ch"], "_rn")
    return a.select("ch", "label").unionByName(fresh.select("ch", (F.col("_rn") - 1 + base).alias("label")))


def union_datasets(a: DataFrame, b: DataFrame, vocab: DataFrame) -> DataFrame:
    """Samples of two sets (id, ch, split) under one vocabulary."""
    return map_labels(a.unionByName(b), vocab.select("ch", "label"), "ch", "label", -1)


def union_domains(dfs: list[DataFrame]) -> DataFrame:
    """Union with the index of the source as ``domain``."""
    out = None
    for i, d in enumerate(dfs):
        d = d.withColumn("domain", F.lit(i).cast("bigint"))
        out = d if out is None else out.unionByName(d)
    return out


def union_offset(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    """Union with ``b``'s labels moved behind ``a``'s largest."""
    off = a.agg((F.max(label) + 1).alias("o")).scalar()
    return a.unionByName(b.withColumn(label, F.col(label) + off))


def split_by_label(df: DataFrame, cut: int, order: list[str], label: str = "label") -> DataFrame:
    """Part 0 below ``cut``, part 1 from it on, labels of each numbered in first-seen order."""
    d = df.withColumn("part", F.when(F.col(label) < cut, 0).otherwise(1).cast("bigint"))
    seen = d.groupBy("part", label).agg(F.min(F.struct(*order)).alias("_f"))
    ranks = number_rows(seen, ["part"], ["_f"], None, "_rn")  # one row per label
    ranks = ranks.select("part", label, (F.col("_rn") - 1).alias("new_label"))
    return d.join(ranks, ["part", label])


def by_label(vocab: DataFrame) -> Column:
    """The characters as one array indexed by label (a scalar sub-query), null where a label has none; of a label
    with several characters the smallest. For character vocabularies, whose labels are about as many as characters."""
    known = vocab.where("label >= 0").groupBy("label").agg(F.min("ch").alias("ch"))
    every = known.agg(F.coalesce(F.max("label"), F.lit(0)).alias("m")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m").cast("bigint"))).alias("label"))
    cells = F.array_sort(F.collect_list(F.struct("label", "ch")))
    return every.join(known, "label", "left").agg(F.transform(cells, lambda s: s["ch"]).alias("m")).scalar()


def by_code_point(vocab: DataFrame) -> Column:
    """The labels as one array indexed by code point (a scalar sub-query), null where a
    character is unknown. Its length is bounded by the largest code point, so by Unicode."""
    known = vocab.where(F.length("ch") == 1).select(F.ascii("ch").alias("cp"), "label")
    every = known.agg(F.coalesce(F.max("cp"), F.lit(0)).alias("m")).select(F.explode(F.sequence(F.lit(0), "m")).alias("cp"))
    cells = F.array_sort(F.collect_list(F.struct("cp", "label")))
    return every.join(known, "cp", "left").agg(F.transform(cells, lambda s: s["label"]).alias("m")).scalar()


def encode_text(df: DataFrame, col: str, vocab: DataFrame, default: int, out: str = "labels") -> DataFrame:
    """Label array of each string, unknown characters to ``default``; stays in the row. A
    character's label is one array access."""
    d = df.withColumn("_m", by_code_point(vocab))
    chars = F.filter(F.split(F.col(col), ""), lambda c: c != "")
    return d.withColumn(out, F.transform(chars, lambda c: F.coalesce(F.get("_m", F.ascii(c)), F.lit(default).cast("bigint")))).drop("_m")


def decode_text(df: DataFrame, col: str, vocab: DataFrame, default: str = "~", out: str = "text") -> DataFrame:
    """The string of each label array, unknown labels as ``default``; a label's character is one array access."""
    d = df.withColumn("_m", by_label(vocab))
    known = lambda i: F.when(i.between(0, F.size("_m") - 1), F.get("_m", i.cast("int")))
    return d.withColumn(out, F.array_join(F.transform(F.col(col), lambda i: F.coalesce(known(i), F.lit(default))), "")).drop("_m")


def to_coo(df: DataFrame, ident: list[str], arr: str) -> DataFrame:
    """Long form (ident, pos, label) of ragged arrays."""
    return df.select(*ident, F.posexplode(arr).alias("pos", "label"))


def coo_shape(df: DataFrame, arr: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(arr)), F.lit(0)).alias("width"))


def from_coo(coo: DataFrame, ident: list[str]) -> DataFrame:
    """Arrays again; a group is one sequence."""
    got = coo.groupBy(*ident).agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("_l"))
    return got.select(*ident, F.transform("_l", lambda s: s["label"]).alias("labels"))


def pad_batches(df: DataFrame, order: list[str], arr: str, size: int, fill: int = 0) -> DataFrame:
    """Batches of ``size`` consecutive rows; arrays padded to the widest of their batch.
    Adds ``batch`` (from 0), ``width`` and the rows missing in the last batch as ``short``."""
    d = rank_all(df, order, "_rn")
    d = d.withColumn("batch", F.floor((F.col("_rn") - 1) / size)).drop("_rn")
    w = d.groupBy("batch").agg(F.max(F.size(arr)).alias("width"), (F.lit(size) - F.count("*")).alias("short"))
    d = d.join(w, "batch")
    return d.withColumn(arr, F.concat(F.col(arr), F.array_repeat(F.lit(fill).cast("bigint"), (F.col("width") - F.size(arr)).cast("int"))))


def invert_vocab(vocab: DataFrame) -> DataFrame:
    """label -> ch with the number of characters that share the label."""
    return vocab.groupBy("label").agg(F.min("ch").alias("ch"), F.count("*").alias("n"))


def assemble_scripts(main: DataFrame, other: DataFrame, mode: str = "all", cut: int = 75) -> DataFrame:
    """Sets with a script: category below ``cut`` hiragana, else kanji; the other set is
    katakana. ``mode`` keeps one script, or all."""
    a = main.withColumn("script", F.when(F.col("label") < cut, "hiragana").otherwise("kanji"))
    d = a.unionByName(other.withColumn("script", F.lit("katakana")))
    return d if mode == "all" else d.where(F.col("script") == mode)


class TextCodec:
    """Pluggable normaliser and vocabulary of a recogniser: both are user choices."""

    def __init__(self, vocab: DataFrame, normalize=None, default: int = 0):
        self.vocab, self.normalize, self.default = vocab, normalize or (lambda c: c), default

    def encode(self, df: DataFrame, col: str, out: str = "labels") -> DataFrame:
        return encode_text(df.withColumn("_t", self.normalize(F.col(col))), "_t", self.vocab, self.default, out).drop("_t")

    def decode(self, df: DataFrame, col: str, out: str = "text") -> DataFrame:
        return decode_text(df, col, self.vocab, out=out)
