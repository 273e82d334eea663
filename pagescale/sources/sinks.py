"""Writers: transcriptions, results, reports, hOCR pages, datasets, template JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale.functions.text import normalize_text
from pagescale.sources.files import write_rows


def finish_transcript(col, nonl: bool = False, normalize: bool = True) -> Column:
    """Normalised text with a final newline when it has none."""
    col = F.col(col) if isinstance(col, str) else col
    col = normalize_text(col) if normalize else col
    return col if nonl else F.when((F.length(col) > 0) & ~F.endswith(col, F.lit("\n")), F.concat(col, F.lit("\n"))).otherwise(col)


def write_transcripts(df: DataFrame, path: str, key: str, text: str = "text", normalize: bool = True) -> None:
    """One text file per row under ``key=value`` folders. The writer separates rows by
    newline, which is the final newline of the one row a file has."""
    body = F.regexp_replace(finish_transcript(text, normalize=normalize), "\\n\\z", "")
    df.select(key, body.alias("value")).write.partitionBy(key).text(path)


def write_transcript_files(df: DataFrame, path: str, key: str, text: str = "text", normalize: bool = True) -> None:
    """One text file per row, ``<hashed folder>/<key>.txt``, from as many tasks as the table has."""
    write_rows(df.select(key, F.encode(finish_transcript(text, normalize=normalize), "UTF-8").alias("_content")), path, key, "_content", ".txt")


def write_goes(df: DataFrame, path: str, go: str) -> None:
    """Lines (go, value) as text files in a folder per go. There are few goes, so a task keeps a file of each open and sorts nothing."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    was = conf.get(name)
    conf.set(name, "16")
    try:
        df.select(go, "value").write.partitionBy(go).text(path)
    finally:
        conf.set(name, was)


def arrive(spark: SparkSession, made: str, path: str) -> None:
    """Whole files, written elsewhere, appear in a folder at once; an empty folder if none were written."""
    at, to = spark._jvm.org.apache.hadoop.fs.Path(made), spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        store.mkdirs(to)
    else:
        store.mkdirs(to.getParent())
        if not store.rename(at, to):
            raise OSError(f"could not move {made} to {path}")


def write_results_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_field_report(by_field: DataFrame, by_text: DataFrame, path: str) -> None:
    """The two report tables as Parquet: one row per field, one per character."""
    by_field.write.parquet(f"{path}/by_field")
    by_text.write.parquet(f"{path}/by_text")


# Page frame and line markup.
HOCR_HEAD = ('<?xml version="1.0" encoding="UTF-8"?>\n'
             '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">\n'
             '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">\n<head>\n<title>OCR Results</title>\n'
             '<meta http-equiv="content-type" content="text/html; charset=utf-8" />\n'
             '<meta name="ocr-system" content="pagescale" />\n<meta name="ocr-capabilities" content="ocr_line ocr_page" />\n</head>\n<body>\n')
HOCR_FOOT = "</body>\n</html>\n"


def hocr_span(text, ident, y0, x0, y1, x1) -> Column:
    t = F.col(text)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.concat(F.lit('<span class="ocr_line" id="line_'), F.col(ident), F.lit('" title="bbox '), F.concat_ws(" ", *[F.col(c).cast("string") for c in (x0, y0, x1, y1)]),
                    F.lit('">'), t, F.lit("</span>\n"))


def to_hocr(lines: DataFrame, page: str = "page", rank: str = "rank") -> DataFrame:
    """(page, html) of lines (page, rank, id, text, box). A page's lines are one output file."""
    span = hocr_span("text", "id", "y0", "x0", "y1", "x1")
    body = lines.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), span.alias("s")))).alias("_l"))
    return body.select(page, F.concat(F.lit(HOCR_HEAD), F.array_join(F.transform("_l", lambda x: x["s"]), ""), F.lit(HOCR_FOOT)).alias("html"))


def write_dataset(df: DataFrame, vocab: DataFrame, path: str) -> None:
    """Samples by split, and the two vocabulary maps as JSON (a character vocabulary is small)."""
    df.write.partitionBy("split").parquet(f"{path}/samples")
    for name, pair in (("char2label", F.struct("ch", F.col("label"))), ("label2char", F.struct(F.col("label").cast("string"), "ch"))):
        vocab.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(pair)))).alias("value")).write.text(f"{path}/{name}")


def write_case_folders(df: DataFrame, path: str) -> None:
    """Samples under correct / type / true_label folders."""
    df.withColumn("correct", F.col("ocr_result") == F.col("true_label")).write.partitionBy("correct", "type", "true_label").parquet(path)


def to_template_json(cells: DataFrame, keys: list[str]) -> DataFrame:
    """{table: {key: [texts]}} per document from rows (keys, tbl, key, seq, text)."""
    k = cells.groupBy(*keys, "tbl", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]).alias("_t"))
    t = k.groupBy(*keys, "tbl").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "_t")))).alias("_k"))
    by_name = F.array_sort(F.collect_list(F.struct("tbl", "_k")), lambda a, b: F.when(a["tbl"] < b["tbl"], -1).when(a["tbl"] > b["tbl"], 1).otherwise(0))
    return t.groupBy(*keys).agg(F.to_json(F.map_from_entries(by_name)).alias("json"))
