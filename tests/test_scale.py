"""What the views and operators shuffle, and that missing keys and blocks change nothing."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import queries
from pagescale import session
from pagescale.operators import graph as G
from pagescale.operators import ranking as R
from pagescale.operators.blocks import Scan, scan
from pagescale.operators.sequence import renumber_by_xcenter
from pagescale.plans import views as V


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents in more splits than cores, as a large table has."""
    at = str(tmp_path_factory.mktemp("many"))
    rows = [(i, " ".join("abcdefg"[: 1 + (i * j) % 7] for j in range(60 + i % 50)), "en", "web", 0) for i in range(64)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(64).write.parquet(f"{at}/documents.parquet")
    return at


def moved(df) -> int:
    """Exchanges that are not broadcasts."""
    return len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_what_is_made_of_a_page_stays_together(spark, sf):
    """Only documents are dealt out: neither the carried values of a scan nor a join on cells move them again."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        w = V.page_words(spark, sf).drop("w")
        d = R.sort_boxes(w, ["page"], "left-right")
        c = V.cells(spark, sf)
        j = c.select("page", "y", "x", "label").join(c.select("page", "y", "x", F.col("label").alias("b")).hint("merge"), ["page", "y", "x"])
        assert moved(w) == 1
        assert moved(d) == 2
        assert moved(j) == 2
        own = {(r["page"], r["id"]): r["idx"] for r in d.collect()}
        plain = w.withColumn("i", F.row_number().over(Window.partitionBy("page").orderBy(F.col("x0") + F.col("x1"), "id")) - 1)
        assert own == {(r["page"], r["id"]): r["i"] for r in plain.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scan_moves_the_rows_once(spark):
    """One exchange of the rows, one of the blocks' aggregates and one of each for the carried values."""
    d = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert moved(scan(d, ["k"], ["id"], F.floor(F.col("id") / 8), s=Scan("sum", F.col("id")))) <= 4


@pytest.mark.parametrize("kind", ["sum", "prev", "next", "max_before", "min_after", "max_after", "total"])
def test_scan_with_missing_keys_and_blocks(spark, kind):
    rows = [(k, p, (p or 0) * 7 % 5 if (p or 0) % 3 else None, i) for i, (k, p) in enumerate((k, p) for k in (1, 2, None) for p in [None, *range(12)])]
    d = spark.createDataFrame(rows, "k bigint, pos bigint, v bigint, i bigint")
    s = Scan(kind, F.col("v"))
    got = scan(d, ["k"], ["pos", "i"], F.floor(F.col("pos") / 4), o=s)
    want = scan(d, ["k"], ["pos", "i"], None, o=s)
    read = lambda t: {r["i"]: r["o"] if kind != "sum" else r["o"] or 0 for r in t.collect()}
    assert read(got) == read(want)
    assert len(read(got)) == len(rows)


def test_hot_pointers_are_spread(spark, monkeypatch):
    """Only values on many rows have their pointer repeated."""
    monkeypatch.setattr(G, "HOT", 20)
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(30)]
    nodes = spark.createDataFrame([(i,) for e in edges for i in e], "id bigint").distinct()
    got = {r["id"]: r["label"] for r in G.components(nodes, spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 if i < 1000 else 1000 for i in got} and len(got) == 231


def test_a_pointer_of_few_rows_is_not_repeated(spark):
    d = spark.createDataFrame([(i, i % 7) for i in range(50)], "a bigint, b bigint")
    t = spark.createDataFrame([(i, i + 100) for i in range(7)], "k bigint, v bigint")
    df = G._lookup(d, "b", t, "n")
    assert {(r["a"], r["n"]) for r in df.collect()} == {(i, i % 7 + 100) for i in range(50)}
    assert "_h" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("stretch", [5, 1000])
def test_near_components_contract_stretches_first(spark, monkeypatch, stretch):
    """Chains across stretches, ids with a missing part, and the same classes as without contraction."""
    monkeypatch.setattr(G, "STRETCH", stretch)
    cut = [(p, i, p, i + 1) for p in (1, 2, None) for i in range(-20, 40) if i % 17] + [(1, 3, 2, 5), (2, 30, 2, 8)]
    e = spark.createDataFrame(cut, "a bigint, b bigint, c bigint, d bigint").coalesce(1).select(F.struct(F.col("a").alias("p"), F.col("b").alias("i")).alias("u"), F.struct(F.col("c").alias("p"), F.col("d").alias("i")).alias("v"))
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    near = {(r["id"], r["label"]) for r in G.components(nodes, e, near=True).collect()}
    assert near == {(r["id"], r["label"]) for r in G.components(nodes, e).collect()}
    assert len(near) == nodes.count()
    if stretch == 1000:  # all edges in one stretch: every vertex has one pointer, to the smallest of its class
        assert {(r["k"], r["r"]) for r in G._contracted(e.coalesce(1)).collect()} >= {x for x in near if x[0] == x[1]}


def test_a_full_split_is_dealt_in_parts(spark, sf, monkeypatch):
    """Partitions do not grow with the table: each gets PART of a split."""
    monkeypatch.setattr(session, "PART", 1024)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        docs = V.table(spark, sf, "documents")
        assert session.by_key(docs, "doc_id").rdd.getNumPartitions() == 4 * docs.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["agg18_remove_noise", "join10_keep_marked", "join10_remove_marked", "num7_lookup_clamped"])
def test_cells_are_not_sorted(spark, sf, name):
    """What meets the cells is hashed."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbering_by_xcenter_splits_texts_once(spark, sf):
    df = queries()["win2_renumber_by_xcenter"](spark, sf)
    assert df._jdf.queryExecution().executedPlan().toString().count("Generate posexplode") == 1
    boxes = spark.createDataFrame([(p, i, x, x and x + 2) for p in (1, None) for i, x in enumerate([5, None, 3, 5, 90_000])], "page int, label bigint, x0 bigint, x1 bigint")
    read = lambda d: sorted((str(r["page"]), r["label"], r["new"]) for r in d.collect())
    assert read(renumber_by_xcenter(boxes, ["page"], width=None)) == read(renumber_by_xcenter(boxes, ["page"]))


def test_batches_for_python_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(session, "BATCH", 1 << 16)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    try:
        d = session.small_batches(spark.range(0, 400, 1, 1).select(F.repeat(F.lit("abcd"), F.when(F.col("id") == 7, 100_000).otherwise(256)).alias("t")))

        def count(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

        sizes = [r["n"] for r in d.mapInArrow(count, "n bigint").collect()]
        assert sum(sizes) == 400 and max(sizes) <= 64
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch") if before is None else spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
