import pytest

from pagescale.sources import readers as R
from pagescale.sources import sinks as W


def test_transcripts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "one “two”"), (2, "three\n")], "id int, text string")
    W.write_transcripts(df, str(tmp_path / "t"), "id")
    got = sorted(r["text"] for r in R.read_transcripts(spark, str(tmp_path / "t" / "id=*" / "*.txt")).collect())
    assert got == ["one ''two''", "three"]


def test_corpus_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "c.txt").write_text("\n".join(f"line {i}" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = R.read_corpus(spark, str(tmp_path / "c.txt"))
        assert got.where("text <> concat('line ', line_no)").isEmpty() and got.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_expand_inputs_and_listing(spark, tmp_path):
    for p in ("0001/010001.png", "0001/010002.png", "0002/010001.png", "0001/long_line.png", "0001/note.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    assert R.expand_inputs(spark, [str(tmp_path)]).count() == 3
    (tmp_path / "list").write_text("a.png\n\nb.png\n")
    assert [r["path"] for r in R.expand_inputs(spark, ["@" + str(tmp_path / "list")]).collect()] == ["a.png", "b.png"]
    (tmp_path / "none").write_text("")
    with pytest.raises(FileNotFoundError):
        R.expand_inputs(spark, ["@" + str(tmp_path / "none")])
    assert R.list_files(spark, str(tmp_path)).count() == 3


def test_base_names(spark):
    df = spark.createDataFrame([("a/b.c.d",)], "path string")
    assert tuple(df.select(*R.split_base("path")).first()) == ("a/b", ".c.d")


def test_fixed_records(spark, tmp_path):
    rec = b"\x00\x01\x24\x22ABCD" + b"\xff" * 504 + b"\x00" * 64
    (tmp_path / "r").write_bytes(b"\x00" * 576 + rec + rec[:100])
    got = R.read_fixed_records(spark, str(tmp_path / "r")).collect()
    assert len(got) == 1 and got[0]["jis"] == 0x2422 and bytes(got[0]["bitmap"]) == b"\xff" * 504


class Unset:
    """The session without spark.checkpoint.dir, on a given master."""

    def __init__(self, spark, master):
        self.conf, self._jvm, self._jsc = self, spark._jvm, spark._jsc
        self.sparkContext, self.master, self._spark = self, master, spark

    def get(self, key, default=None):
        return default if key == "spark.checkpoint.dir" else self._spark.conf.get(key)

    def getCheckpointDir(self):
        return None


def test_scratch_folder(spark):
    from pagescale.session import materialise, scratch_dir
    base = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:").rstrip("/")
    assert f"{base}/pagescale/" in scratch_dir(Unset(spark, "local[8]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Unset(spark, "spark://host:7077"))
    first = materialise(spark.range(5).toDF("id"))
    second = materialise(first.where("id > 1"), first)
    assert sorted(r["id"] for r in second.collect()) == [2, 3, 4]
    import os
    assert not os.path.exists(first._scratch.removeprefix("file:")) and os.path.exists(second._scratch.removeprefix("file:"))


def test_record_files_in_ranges(spark, tmp_path):
    import numpy as np
    from pagescale.sources import files

    rng = np.random.default_rng(1)
    want = {}
    for name, n, odd in (("a.bin", 5000, 0), ("sub/b.bin", 3, 17), ("c.bin", 1, 0), ("d.bin", 0, 5), ("_hidden", 9, 0)):
        data = rng.integers(0, 256, (n, 576), np.uint8)
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(data.tobytes() + b"x" * odd)
        for k in range(1, n if name[0] != "_" else 0):
            want[(name.split("/")[-1], k)] = (int(data[k, 2]) * 256 + int(data[k, 3]), data[k, 8:512].tobytes())
    got = R.read_fixed_records(spark, str(tmp_path / "r"), "b576", 300_000)
    assert got.rdd.getNumPartitions() >= 8
    assert {(r["path"].split("/")[-1], r["rec"]): (r["jis"], bytes(r["bitmap"])) for r in got.collect()} == want
    assert R.read_fixed_records(spark, "file:" + str(tmp_path / "r" / "a.bin")).count() == 4999
    whole = [x for p in files.cut([("f", 10_000), ("g", 64), ("h", 700)], 64, 1, 1000) for x in p]
    assert [sum(n for f, _, n in whole if f == g) for g in "fgh"] == [155, 0, 9]
    assert all(sum(n for _, _, n in p) <= 15 for p in files.cut([("f", 10_000), ("h", 700)], 64, 1, 1000))
    (tmp_path / "none").mkdir()
    assert R.read_fixed_records(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="FileNotFound"):
        R.read_fixed_records(spark, str(tmp_path / "not there")).collect()


def test_a_file_for_each_row(spark, tmp_path):
    rows = [(f"n {i}/é%", f"text {i}" + ("\n" if i % 2 else "")) for i in range(300)] + [("empty", ""), ("null", None)]
    df = spark.createDataFrame(rows, "key string, text string").repartition(4)
    W.write_transcript_files(df, str(tmp_path / "t"), "key")
    files = [p for p in (tmp_path / "t").glob("*/*") if p.name[0] != "."]
    assert len(files) == 302 and len(list((tmp_path / "t").iterdir())) > 50
    import urllib.parse
    got = {urllib.parse.unquote(p.name[:-4]): p.read_text() for p in files}
    assert got == {k: (t.rstrip("\n") + "\n" if t else "") for k, t in rows}
    back = R.read_transcripts(spark, str(tmp_path / "t" / "*" / "*.txt"))
    assert sorted(r["text"] for r in back.collect()) == sorted(t.rstrip("\n") for _, t in rows if t)  # an empty file has no row
    W.write_transcript_files(df.limit(3), str(tmp_path / "t"), "key")
    assert len([p for p in (tmp_path / "t").glob("*/*")]) >= 302
