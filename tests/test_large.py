"""Steps that grew faster than their input or did work twice (findings F23, F28, F30, F36, F37 of round 3)."""

import re
import unicodedata

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from __spark_entry__ import queries
from pagescale.functions import text as T
from pagescale.operators import joins as J
from pagescale.plans import views as V
from pagescale.plans.layout_queries import TEMPLATE, TEMPLATE_SCHEMA
from pagescale.sources import files
from pagescale.sources import readers as R
from pagescale.sources import sinks as W

TEXTS = ["Aa bb  ccc\nlong-word-over-the-border " + "x" * 90 + " dd " * 60, " \n  two ", "ß é́ oo'ffa ~~~ 日本 \U0001F600 x", "", None, "a\tb c lso", "one"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("large"))
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "s"), (1, "other one\nof the id", "en", "s"), (None, "a bb", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{out}/documents.parquet")
    return out


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_both_ways_of_splitting_give_the_same_words(spark, sf):
    for of in (V.words, V.page_words, V.blocks):
        was, now = of(spark, sf), of(spark, sf, dealt=False)
        assert was.dtypes == now.dtypes and _rows(was) == _rows(now)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert V.split_words_in_batches(none, "text", ["doc_id"]).collect() == []


def test_clean_texts_are_normalised_as_all(spark):
    texts = [f for c in map(chr, range(0x300)) for f in (c, f"a{c}", f"{c}a", f"a{c}b", f"a {c} b")] + ["", " ", "a  b", "word " * 300_000 + "end", "word " * 300_000, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = T.clean_homographs(F.trim(F.regexp_replace("t", r"(?U)[\s\x1c-\x1f]+", " ")))
    assert df.where(~T.normalize_text("t").eqNullSafe(whole)).isEmpty()
    assert df.where(F.col("t").rlike(T.CLEAN)).count() > 400


def test_new_files_are_made_from_texts_split_once(spark, sf, monkeypatch):
    made, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **k: (made.append(self._df.inputFiles()), text(self, *a, **k))[1])
    got = queries()["str2_score_new_files"](spark, sf).first()
    assert sum(any("documents.parquet" in f for f in m) for m in made) == 1
    pairs = [tuple(r) for r in V.ocr_pairs(spark, sf).where("truth is not null").select(T.normalize_text("truth"), T.normalize_text("pred")).collect()]
    assert got["n"] == len(pairs) > 0 and got["ok"] == sum(a == b for a, b in pairs)


def test_files_of_a_go_arrive_whole(spark, tmp_path):
    spark.createDataFrame([(0, "a"), (0, "b")], "go int, value string").write.mode("overwrite").parquet(str(tmp_path / "d"))
    was = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    W.write_goes(spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "made"), "go")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == was
    for go in (0, 1):
        W.arrive(spark, str(tmp_path / "made" / f"go={go}"), str(tmp_path / "in" / str(go)))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "in" / "*")).collect()) == ["a", "b"] and (tmp_path / "in" / "1").is_dir()


def test_decoded_ligatures_are_not_gathered_from_tokens(spark, sf):
    got = queries()["txt14_decode_ligatures"](spark, sf)
    assert "posexplode(regexp_extract_all" not in _plan(got)
    back = T.decode_ligatures(T.encode_ligatures(V.lines(spark, sf), "line", ["doc_id", "y"]), ["doc_id", "y", "pos"])
    want = {}
    for r in back.collect():
        want.setdefault((r["doc_id"], r["y"]), []).append((r["pos"], r["name"] is not None, r["name"]))
    assert {(r["doc_id"], r["y"]): r["t"] for r in got.collect()} == {k: "".join(n or "" for _, _, n in sorted(v, key=lambda x: x[:2] + (x[2] or "",))) for k, v in want.items()}


def test_nested_ligatures_equal_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["\x00\x02\x03\x04-a a- ~~~~~ ooA00b ÄA", "日\U0001F600�", "", None, "x\ny"])], "id int, t string")
    rows, nest = T.encode_ligatures(df, "t", ["id"]), T.encode_ligatures(df, "t", ["id"], nested=True)
    assert _rows(rows) == _rows(nest.select("id", F.posexplode(F.arrays_zip("tokens", "codes")).alias("pos", "z")).select("id", "pos", "z.tokens", "z.codes"))
    codes = spark.createDataFrame([(-3,), (0,), (1,), (2,), (T.LIG_BASE + 3 + 70 * 82,), (0xFFFF,), (0x10000,), (None,)], "code bigint")
    nested = T.decode_ligatures(codes.select(F.array("code").alias("codes"), "code"), ["code"], nested=True)
    assert _rows(T.decode_ligatures(codes, []).select("code", "name")) == _rows(nested.select("code", F.col("names")[0]))
    twice = spark.createDataFrame([("aa", 1, 0), ("aa", 2, 1)], "name string, code bigint, seq bigint")
    with pytest.raises(ValueError, match="two codes"):
        T.encode_ligatures(df, "t", ["id"], twice, nested=True)


def test_template_ranks_do_not_gather_the_areas(spark, sf):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        areas = V.blocks(spark, sf).withColumn("rank", F.col("id"))
        got = _plan(J.extract_template(V.page_words(spark, sf), areas, spark.createDataFrame(TEMPLATE, TEMPLATE_SCHEMA), ["page"]))
        assert not re.search(r"Exchange hashpartitioning\((cast\()?bbox_index", got)
        assert len(re.findall("FileScan parquet .*documents.parquet", _plan(queries()["snk7_template_json"](spark, sf)))) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_row_files_are_listed_in_tasks(spark, tmp_path):
    rows = [(f"n {i}/é%", unicodedata.normalize("NFC", f"text {i} é日")) for i in range(300)] + [("empty", ""), ("null", None)]
    at = str(tmp_path / "t t")
    W.write_transcript_files(spark.createDataFrame(rows, "key string, text string").repartition(4), at, "key")
    (tmp_path / "t t" / "_hidden").mkdir()
    for name in ("_hidden/a.txt", "00.txt", next((tmp_path / "t t").glob("[0-9a-f]*")).name + "/b.other"):
        (tmp_path / "t t" / name).write_text("no")
    got = R.read_transcripts(spark, f"{at}/*/*.txt", nonl=False, normalize=False)
    assert not got.inputFiles() and got.rdd.getNumPartitions() > 50
    want = spark.read.text(f"{at}/*/*.txt", wholetext=True).select("_metadata.file_path", "value").where("file_path not like '%_hidden%'")
    assert _rows(got) == _rows(want) and got.count() == 300
    (tmp_path / "none").mkdir()
    assert files.read_rows(spark, str(tmp_path / "none")).collect() == []
    assert not files.openable("nosuch://a/b")


def test_lines_are_written_before_they_are_ordered(spark, sf):
    df = queries()["itr4_reading_order"](spark, sf)
    assert not [f for f in df.inputFiles() if "documents.parquet" in f]
    df.collect()
