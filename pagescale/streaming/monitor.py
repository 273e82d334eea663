"""Structured Streaming forms of the stateful parts: quality monitor, scoring of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagescale.functions.text import normalize_text
from pagescale.operators.metrics import edits


def monitor_stream(sdf: DataFrame, key: str, value: str, ts: str, size: str, slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Mean and count of a metric per key in tumbling or sliding event-time windows. The
    state is one row per key and open window; late rows beyond the watermark are left out."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    agg = sdf.withWatermark(ts, watermark).groupBy(win.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", (F.col("total") / F.col("n")).alias("mean"))


def drain(sdf: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all data there is, into Parquet, and wait for the end."""
    q = sdf.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


def score_new_files(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Score newly arrived tab-separated lines (id, truth, pred): each file once, in any
    order, results appended as Parquet. The file log in the checkpoint keeps the tally."""
    raw = spark.readStream.schema("value string").text(path)
    f = F.col("_f")
    d = raw.select(F.split("value", "\t").alias("_f")).select(f[0].alias("id"), f[1].alias("truth"), f[2].alias("pred"))
    d = d.select("id", normalize_text("truth").alias("truth"), normalize_text("pred").alias("pred"))
    d = d.withColumn("errors", edits("pred", "truth")).withColumn("correct", F.col("pred") == F.col("truth"))
    return drain(d, out, checkpoint)
