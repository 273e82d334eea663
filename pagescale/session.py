"""Session helpers: local session, shared scratch folder, lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

PART = 2 << 20  # bytes of a large scan's split that go to one partition
BATCH = 8 << 20  # bytes of texts in a batch for Python


def local_session(app: str = "pagescale", cpus: str = "8", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the one it gives."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder name below the shared folder of ``spark.checkpoint.dir``.

    Where the session names none, it lies below the warehouse folder. A warehouse on a
    machine-local path is refused on a cluster, whose executors would not see each
    other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir")
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        if base.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/pagescale/{uuid.uuid4().hex}"


def materialise(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back (runs a job).

    A written table survives the loss of executors, and its real size is known
    to the planner of the next round. ``done``: tables of earlier calls that nothing reads any
    more; they are deleted once the new one is written.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    for old in done:
        if (gone := getattr(old, "_scratch", None)) is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(gone)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` only when the scan has fewer splits than cores.

    One small file is one task otherwise. A table of many splits is returned
    as it is, so a large input is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, and from now on batches that go to Python hold ``BATCH`` bytes at most, or one longer row: by default
    10,000 rows, which the executor holds outside its heap, and the Python worker too. Must hold when the query is run, so it stays set."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


def parts(df: DataFrame) -> int:
    """As many partitions as cores, or for a large scan as many as give each ``PART`` of a full split."""
    spark = df.sparkSession
    cores, splits = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    full = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return cores if splits < cores else splits * -(-full // PART)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal ``keys`` in one partition, so that joins, groups and windows on the keys and more columns
    move nothing again. Dealt over the cores, or a large scan over as many partitions as give each ``PART`` of a full split:
    what is made of a row (words, cells) is a hundred times its size, and a sort of it then fits a task's memory whatever
    the size of the table. The setting lets joins on the
    keys and more columns use this as groups and windows do; it must hold when the query is run, so it stays set."""
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(parts(df), *keys)
