import pytest
from pyspark.sql import functions as F

from pagescale.functions import text as T


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("src,want", [
    ("a_b#c~", "a~b~c~"), ('say "x"', "say ''x''"), ("`a´", "'a'"), ("“a”", "''a''"), ("‘a’", "'a'"), ("„a", ",,a"), ("a…", "a..."),
    ("5′ 6″ 7‴", "5' 6'' 7'''"), ("〃", "''"), ("µ", "μ"), ("a–b—c", "a-b-c"), ("ﬂ ﬁ ﬀ ﬃ ﬄ", "fl fi ff ffi ffl"),
    ("é", "é"), ("  a \t b \n", "a b")])
def test_normalize(spark, src, want):
    assert one(spark, src, T.normalize_text("t")) == want


def test_project(spark):
    assert one(spark, "a . . . . b", T.project_text("t")) == "a....b"
    assert one(spark, "A_1 b#é", T.project_text("t", "letdig")) == "A1b"
    assert one(spark, "straße 1", T.project_text("t", "lnc")) == "STRASSE"
    with pytest.raises(ValueError):
        T.project_text("t", "other")


def test_voicing(spark):
    assert one(spark, "がぱ", T.merge_voicing("t")) == "がぱ"
    assert one(spark, "゙か", T.merge_voicing("t")) == "か"
    assert one(spark, "が゙x", T.merge_voicing("t")) == "゚x"


def test_tokens(spark):
    assert one(spark, "a_ff_b___\x01\x02", T.gt_explode("t")) == ["a", "ff_b", "_", "_", "_", "\\"]  # the longest token wins
    assert one(spark, "a_ff_bc", T.gt_explode("t")) == ["a", "ff", "b", "c"]
    df = spark.createDataFrame([(["a", "ff", "_"],)], "t array<string>")
    assert df.select(T.gt_implode("t").alias("r")).first()["r"] == "a_ff____"
    with pytest.raises(Exception, match="cannot create ground truth"):
        spark.createDataFrame([(["abcde"],)], "t array<string>").select(T.gt_implode("t")).collect()


def test_affixes(spark):
    df = spark.createDataFrame([("1234abc", "1234xabc"), ("", "a"), ("abc", "abc"), ("fi", "i!")], "a string, b string")
    rows = df.select(T.common_prefix_len("a", "b"), T.common_suffix_len("a", "b"), T.common_overlap_len("a", "b")).collect()
    assert [tuple(r) for r in rows] == [(4, 3, 0), (0, 0, 0), (3, 3, 3), (0, 0, 1)]


def test_ligatures(spark):
    df = spark.createDataFrame([(1, "oaA-~~~xあ")], "id int, t string")
    got = T.encode_ligatures(df, "t", ["id"]).orderBy("pos").collect()
    assert [r["token"] for r in got] == ["oa", "A-", "~~~", "x", "あ"]
    assert got[2]["code"] == 0x200001 and got[4]["code"] == 0x3042
    back = T.decode_ligatures(spark.createDataFrame([(1, -3), (2, 2), (3, got[0]["code"]), (4, 0x3042), (5, got[1]["code"])], "id int, code bigint"), ["id"])
    assert [r["name"] for r in back.orderBy("id").collect()] == ["~", "<RHO>", "oa", "あ", "-A"]


def test_jis(spark):
    df = spark.createDataFrame([("2422",), ("3021",), ("ffff",)], "c string")
    assert [r["ch"] for r in T.jis_to_unicode(df, "c").orderBy("c").collect()] == ["あ", "亜", ""]


def test_overlap_of_long_texts(spark):
    import random
    import time

    from pagescale.functions import text as T

    rnd = random.Random(2)
    pairs = [("", "a"), (None, "a"), ("abc", "cab"), ("aaaa", "aa")]
    for _ in range(60):
        m = rnd.randint(0, 200)
        mid = "".join(rnd.choice("ab") for _ in range(m))
        pairs.append(("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 90))) + mid, mid + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 90)))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["n"] for r in df.select("i", T.common_overlap_len("a", "b").alias("n")).collect()}
    for i, (a, b) in enumerate(pairs):
        want = max((k for k in range(min(len(a or ""), len(b)) + 1) if k == 0 or a[-k:] == b[:k]), default=0)
        assert got[i] == want, (a, b)
    t0 = time.time()
    assert T.overlap_len("ab" * 50_000, "ba" * 50_000) == 99_999 and T.overlap_len("a" * 100_000, "a" * 99_999 + "b") == 99_999
    assert time.time() - t0 < 1
