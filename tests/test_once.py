"""Queries that read a derived table several times make it once: nothing of the documents is left in their plans."""

import pytest

from __spark_entry__ import queries
from pagescale.plans import seq_queries as Q
from pagescale.plans import views as V

TEXT = "Aa bb  ccc\nlong-word-over-the-border " + "x" * 90 + " dd " * 60


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("once"))
    rows = [(1, TEXT, "en", "s"), (1, TEXT, "en", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (None, "a bb", "en", "s"), (4, "one", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", ["win6_reduce_pivots_low", "win7_smooth_pivots_hand", "win7_smooth_pivots_dash", "win8_detect_pivots", "join8_drop_nested", "win11_detect_blocks"])
def test_texts_are_read_once(spark, sf, name):
    df = queries()[name](spark, sf)
    assert not [f for f in df.inputFiles() if "documents.parquet" in f]
    df.collect()


def test_profile_counts_ink(spark, sf):
    want = {}
    for page, y in [(r["page"], r["y"]) for r in V.cells(spark, sf).collect() if r["page"] is not None]:
        want[page, y] = want.get((page, y), 0) + 1
    for page in {p for p, _ in want}:
        for y in range(max(y for p, y in want if p == page) + 1):
            want.setdefault((page, y), 0)
    got = {(r["page"], r["pos"]): r["v"] for r in V.row_profile(spark, sf).collect() if r["page"] is not None}
    assert got == want


def test_grid_cells_count_glyphs(spark, sf):
    ink, cross = {}, set()
    for r in V.cells(spark, sf).collect():
        at = r["page"], r["y"], r["x"] // 20
        ink[at] = ink.get(at, 0) + 1
    for r in V.page_words(spark, sf).where("x1 is not null").collect():
        cross |= {(r["page"], r["y0"], c) for c in range(r["x0"] // 20 + 1, (r["x1"] - 1) // 20 + 1)}
    got = [r for r in Q.grid_cells(spark, sf).collect() if r["page"] is not None]
    assert len(got) == len({(r["page"], r["cy"], r["cx"]) for r in got}) and {(r["page"], r["cy"], r["cx"]) for r in got} >= {a for a in ink if a[0] is not None}
    for r in got:
        at, above = (r["page"], r["cy"], r["cx"]), (r["page"], r["cy"] - 1, r["cx"])
        assert r["left_open"] == (at in cross)
        assert r["top_open"] == (at in ink and above in ink and (ink[at] + ink[above]) % 3 == 0)
