"""Readers: transcriptions, corpora, listings, records, vocabularies, templates, marks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale.functions.numeric import argmax
from pagescale.functions.text import normalize_text
from pagescale.operators.blocks import number_rows
from pagescale.sources.files import SPLIT, openable, read_records, read_rows


def clean_transcript(col, nonl: bool = True, normalize: bool = True) -> Column:
    """One trailing newline off, then the normaliser."""
    col = F.col(col) if isinstance(col, str) else col
    if nonl:
        col = F.regexp_replace(col, "\\n\\z", "")
    return normalize_text(col) if normalize else col


def read_transcripts(spark: SparkSession, path, nonl: bool = True, normalize: bool = True) -> DataFrame:
    """(path, text): one file is one row. All files of a kind two folders down (``folder/*/*.txt``), as a row each is written,
    are listed by the tasks that read them; for any other path Spark lists the files on the driver."""
    own = re.fullmatch(r"([^*?\[{]+)/\*/\*(\.[^/*?\[{\\]+)", path) if isinstance(path, str) else None
    if own and openable(own[1]):
        df = read_rows(spark, own[1], own[2]).select("path", F.col("content").cast("string").alias("text"))
    else:
        df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumn("text", clean_transcript("text", nonl, normalize))


def read_corpus(spark: SparkSession, path) -> DataFrame:
    """(path, line_no, text): line numbers from 0 per file. Files are split as Spark splits
    them; a split's lines are numbered by themselves and a table of one row per split
    gives its offset, so a huge file is never one task."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"),
                                     F.monotonically_increasing_id().alias("_i"), F.col("value").alias("text"))
    d = number_rows(d, ["path"], ["_b", "_i"], F.col("_b"), "_rn")
    return d.select("path", (F.col("_rn") - 1).alias("line_no"), "text")


def corpus_lines(df: DataFrame, ident: list[str], text: str) -> DataFrame:
    """The same for texts already in rows."""
    return df.select(*ident, F.posexplode(F.split(text, "\n")).alias("line_no", "text"))


def list_files(spark: SparkSession, root, ext=("png", "jpg"), include: str | None = None, exclude: str | None = "line|checkbox") -> DataFrame:
    """(path, length) of files below a root by extension, any case; ``include`` / ``exclude``
    are patterns on the file name. The content column is never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return filter_names(df, ext, include, exclude)


def filter_names(df: DataFrame, ext, include: str | None = None, exclude: str | None = None) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    ok = F.lower(name).rlike(r"\.(" + "|".join(ext) + ")$")
    if include:
        ok = ok & name.rlike(include)
    if exclude:
        ok = ok & ~name.rlike(exclude)
    return df.where(ok)


def expand_inputs(spark: SparkSession, args: list[str]) -> DataFrame:
    """(arg, path) of globs, ``@listfile`` entries, or of one book folder's ????/??????.png;
    an argument without files is an error."""
    out = None
    book = len(args) == 1 and not args[0].startswith("@") and not any(c in args[0] for c in "*?[")
    for arg in args:
        if arg.startswith("@"):
            d = spark.read.text(arg[1:]).where("value <> ''").select(F.col("value").alias("path"))
        else:
            d = spark.read.format("binaryFile").load(arg + "/????/??????.png" if book else arg).select("path")
        d = d.select(F.lit(arg).alias("arg"), "path")
        out = d if out is None else out.unionByName(d)
    found = {r["arg"] for r in out.select("arg").distinct().collect()}  # one job for all arguments
    if missing := [a for a in args if a not in found]:
        raise FileNotFoundError(f"{', '.join(missing)}: expansion did not yield any files")
    return out


def parse_recognition_path(df: DataFrame, col: str = "path") -> DataFrame:
    """Key columns from the parts of a recognition path: template, form, field, kind, line, truth."""
    p = F.split(col, "/")
    folder = F.element_at(p, -3)
    name = F.element_at(p, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return df.withColumns({
        "template": F.element_at(p, -6), "form": F.element_at(p, -5), "field": F.element_at(p, -4),
        "kind": F.regexp_extract(folder, r"^(.*)_line_\d+$", 1), "line": F.regexp_extract(folder, r"_line_(\d+)$", 1).try_cast("bigint"),
        "truth": F.element_at(F.split(stem, "-"), -1)})


def split_base(col) -> list[Column]:
    """Base name and all extensions: a/b.c.d -> a/b, .c.d"""
    pat = r"^((?:.*/)*[^.]*)([^/]*)"
    return [F.regexp_extract(col, pat, 1).alias("base"), F.regexp_extract(col, pat, 2).alias("ext")]


# File ending of each variant.
VARIANTS = {"bin": ".bin.png", "nrm": ".nrm.png", "rseg": ".rseg.png", "cseg": ".cseg.png", "lattice": ".lattice", "aligned": ".aligned", "costs": ".costs", "gt": ".gt.txt", "txt": ".txt"}


def pair_variants(df: DataFrame, kinds: list[str], col: str = "path") -> DataFrame:
    """One row per base name with a path column per kind. A folded conditional aggregate."""
    d = df.select(F.col(col).alias("_p"), *split_base(F.col(col)))
    return d.groupBy("base").agg(*[F.max(F.when(F.col("ext") == VARIANTS[k], F.col("_p"))).alias(k) for k in kinds])


# Record size, records to skip, place and length of the JIS code and the bitmap.
LAYOUTS = {"b576": (576, 1, 2, 2, 8, 504), "b512": (512, 1, 2, 2, 8, 504), "c2052": (2052, 1, 6, 1, 32, 2016)}


def parse_fixed_records(df: DataFrame, keep: list[str], content: str, layout) -> DataFrame:
    """(keep, rec, jis, bitmap) of big-endian fixed records; a last partial record is dropped.
    ``layout`` is a name or (size, skip, code at, code length, bitmap at, bitmap length)."""
    size, skip, at, n, bat, bn = LAYOUTS[layout] if isinstance(layout, str) else layout
    count = F.floor(F.length(content) / size)
    d = df.where(count > skip).select(*keep, content, F.explode(F.sequence(F.lit(skip).cast("bigint"), count - 1)).alias("rec"))
    start = (F.col("rec") * size).cast("int")
    code = F.conv(F.hex(F.substring(F.col(content), start + (at + 1), F.lit(n))), 16, 10).cast("bigint")
    return d.select(*keep, "rec", code.alias("jis"), F.substring(F.col(content), start + (bat + 1), F.lit(bn)).alias("bitmap"))


def read_fixed_records(spark: SparkSession, path: str, layout="b576", split: int = SPLIT) -> DataFrame:
    """(path, rec, jis, bitmap) of the record files below a path, in partitions of about ``split`` bytes of whole
    records, whatever the size of a file."""
    return read_records(spark, path, LAYOUTS[layout] if isinstance(layout, str) else layout, split)


def first_record(category, layout: str) -> Column:
    """Byte offset of a category's first record in the two per-category formats."""
    per = {"b512": 160, "c2052": 1411}[layout]
    return (F.col(category) * per + 1) * LAYOUTS[layout][0]


def parse_code_table(df: DataFrame, col: str) -> DataFrame:
    """Adds label (first field) and code (last 4 characters of the last field); rows without a
    whole first field are dropped."""
    f = F.split(F.trim(col), " ")
    d = df.withColumn("label", f[0].try_cast("int").cast("bigint")).withColumn("code", F.right(F.trim(F.element_at(f, -1)), F.lit(4)))
    return d.where("label is not null")


def read_code_table(spark: SparkSession, path) -> DataFrame:
    return parse_code_table(spark.read.text(path), "value").select("label", "code")


def parse_vocab(df: DataFrame, keep: list[str], col: str) -> DataFrame:
    return df.select(*keep, F.explode(F.from_json(col, "map<string,bigint>")).alias("ch", "label"))


def read_vocab(spark: SparkSession, path) -> DataFrame:
    """(ch, label) of a JSON map file."""
    return parse_vocab(spark.read.text(path, wholetext=True), [], "value")


TEMPLATE_JSON = "struct<tables: map<string, struct<keys: map<string, array<struct<bbox_index: bigint, x_range: array<double>, y_range: array<double>>>>>>>"


def parse_template(df: DataFrame, keep: list[str], col: str) -> DataFrame:
    """Flat template rows (keep, tbl, key, seq, bbox_index, x0r, x1r, y0r, y1r) of nested JSON."""
    d = df.select(*keep, F.explode(F.from_json(col, TEMPLATE_JSON)["tables"]).alias("tbl", "_t"))
    d = d.select(*keep, "tbl", F.explode("_t.keys").alias("key", "_k")).select(*keep, "tbl", "key", F.posexplode("_k").alias("seq", "_b"))
    return d.select(*keep, "tbl", "key", F.col("seq").cast("bigint"), "_b.bbox_index", F.col("_b.x_range")[0].alias("x0r"), F.col("_b.x_range")[1].alias("x1r"),
                    F.col("_b.y_range")[0].alias("y0r"), F.col("_b.y_range")[1].alias("y1r"))


def read_template(spark: SparkSession, path) -> DataFrame:
    return parse_template(spark.read.text(path, wholetext=True), [], "value")


def one_hot_to_id(col) -> Column:
    return argmax(col)


def read_labelled(spark: SparkSession, path, label: str = "label") -> DataFrame:
    """A dataset table; a one-hot label column becomes the class id."""
    df = spark.read.parquet(path)
    return df.withColumn(label, one_hot_to_id(label)) if dict(df.dtypes)[label].startswith("array") else df


def read_review_marks(spark: SparkSession, path, names=None) -> tuple[DataFrame, DataFrame | None]:
    """Review sheet rows (form, field_id, mark) and the field names by their line (field_id from 0)."""
    marks = spark.read.csv(path, header=True, schema="form string, field_id bigint, mark string")
    if names is None:
        return marks, None
    return marks, read_corpus(spark, names).where("text <> ''").select(F.col("line_no").alias("field_id"), F.trim("text").alias("name"))
