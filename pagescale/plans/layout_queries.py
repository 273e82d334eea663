"""Registered queries: box joins and cell-grid operators."""

from pyspark.sql import functions as F

from pagescale.functions import boxes as B
from pagescale.operators import cells as C
from pagescale.operators import joins as J
from pagescale.operators import ranking as R
from pagescale.plans import views as V
from pagescale.plans.registry import query
from pagescale.session import by_key, materialise

PAGE = ["page"]


@query("join4_interval_join_y", """
    SELECT a.page, a.id AS a, b.id AS b, least(a.y0, b.y0) AS lo, greatest(a.y1, b.y1) AS hi
    FROM line_boxes a JOIN line_boxes b ON a.page = b.page AND b.id = a.id + 1""", "line_boxes")
def _(spark, sf):
    """Lines of consecutive rows touch (ends included)."""
    return J.interval_join(V.line_boxes(spark, sf), PAGE, "y")


@query("join4_interval_join_x", """
    SELECT page, y0, id AS a, b, x0 - 1 AS lo, hi FROM (SELECT *, lead(id) OVER w AS b, lead(x1) OVER w AS hi FROM page_words WINDOW w AS (PARTITION BY page, y0 ORDER BY id)) WHERE b IS NOT NULL""", "page_words")
def _(spark, sf):
    w = V.page_words(spark, sf).select("page", "y0", "id", (F.col("x0") - 1).alias("x0"), "x1")
    return J.interval_join(w, ["page", "y0"], "x")


@query("join5_overlap_join", """
    SELECT a.page, a.id, count(*) AS n, max(b.id) AS last FROM (SELECT *, unnest([0, 1]) AS dy FROM page_words) a
    JOIN page_words b ON a.page = b.page AND b.y0 = a.y0 + a.dy AND a.id < b.id AND a.x1 >= b.x0 AND b.x1 >= a.x0 GROUP BY a.page, a.id""", "page_words")
def _(spark, sf):
    p = J.overlap_join(V.page_words(spark, sf).drop("w"), PAGE)
    return p.groupBy("page", F.col("a").alias("id")).agg(F.count("*").alias("n"), F.max("b").alias("last"))


@query("join6_contains_join", """
    SELECT b.page, b.id AS a, w.id AS b FROM blocks b JOIN page_words w ON b.page = w.page AND w.y0 // 5 = b.id
    WHERE b.y0 <= w.y0 AND b.y1 >= w.y1 AND b.x0 <= w.x0 AND b.x1 >= w.x1""", "page_words", "blocks")
def _(spark, sf):
    p = J.contains_join(V.blocks(spark, sf), V.page_words(spark, sf).drop("w"), PAGE)
    return p.select("page", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


@query("join7_not_contained", """
    SELECT w.page, w.id FROM page_words w JOIN blocks b ON b.page = w.page AND w.y0 // 5 = b.id
    WHERE NOT (b.x0 <= w.x0 + 5 AND b.x1 >= w.x1 + 5) AND NOT (w.y0 <= b.y0 AND w.y1 >= b.y1 AND w.x0 + 5 <= b.x0 AND w.x1 + 5 >= b.x1)""", "page_words", "blocks")
def _(spark, sf):
    w = B.shift_boxes(V.page_words(spark, sf).drop("w"), 0, 5)
    return J.not_contained(w, V.blocks(spark, sf), PAGE).select("page", "id")


_NEST = """SELECT page, id, y0, x0, y1, x1, y0 // 5 AS g FROM page_words UNION ALL SELECT page, id + 10000000, y0, x0, y1, x1, id FROM blocks
    UNION ALL SELECT page, id + 20000000, y0, x0, y1, x1, id FROM blocks WHERE id % 2 = 0"""


def _nested(spark, sf):
    """Written once and dealt out by page: both sides of the join read these rows instead of splitting the texts again."""
    w, b = V.page_words(spark, sf).drop("w"), materialise(V.blocks(spark, sf))
    return by_key(materialise(w.unionByName(b.withColumn("id", F.col("id") + 10_000_000)).unionByName(b.where("id % 2 = 0").withColumn("id", F.col("id") + 20_000_000))), "page")


@query("join8_drop_nested", """
    SELECT page, id FROM nest i WHERE NOT EXISTS (SELECT 1 FROM nest j WHERE j.page = i.page AND j.g = i.g AND j.id >= 10000000 AND j.id <> i.id AND j.y0 <= i.y0 AND j.y1 >= i.y1
      AND j.x0 <= i.x0 AND j.x1 >= i.x1 AND (j.id > i.id OR (j.y0, j.x0, j.y1, j.x1) <> (i.y0, i.x0, i.y1, i.x1)))
    AND NOT EXISTS (SELECT 1 FROM nest j WHERE i.id >= 10000000 AND j.id < 10000000 AND j.page = i.page AND j.g = i.g AND j.y0 <= i.y0 AND j.y1 >= i.y1
      AND j.x0 <= i.x0 AND j.x1 >= i.x1 AND (j.y0, j.x0, j.y1, j.x1) <> (i.y0, i.x0, i.y1, i.x1))""", "page_words", "blocks", nest=_NEST)
def _(spark, sf):
    """Words, blocks and a second copy of every other block."""
    return J.drop_nested(_nested(spark, sf), PAGE, {"y": 2, "x": 16}).select("page", "id")


@query("join9_filter_children", """
    SELECT page, id + 10000000 AS id FROM n WHERE c < 5
    UNION ALL SELECT w.page, w.id FROM page_words w JOIN n ON n.page = w.page AND n.id = w.y0 // 5 WHERE c >= 5""", "page_words", "blocks",
       n="SELECT page, y0 // 5 AS id, count(*) AS c FROM page_words GROUP BY ALL")
def _(spark, sf):
    """Blocks of fewer than five words stay for their words. A block's id sorts first."""
    w, b = V.page_words(spark, sf).drop("w"), V.blocks(spark, sf)
    u = w.withColumn("id", F.col("id") + 20_000_000).unionByName(b.withColumn("id", F.col("id") + 10_000_000))
    kept = J.filter_children(u, PAGE, 5, {"y": 2, "x": 16})
    return kept.select("page", F.when(F.col("id") >= 20_000_000, F.col("id") - 20_000_000).otherwise(F.col("id")).alias("id"))


_THIRDS = """SELECT page, i AS id, h * i // 3 AS y0, 10::BIGINT AS x0, h * (i + 1) // 3 AS y1, 60::BIGINT AS x1
    FROM (SELECT page, max(y1) AS h, unnest([0, 1, 2])::BIGINT AS i FROM page_words GROUP BY page)"""


@query("box12_extend_regions", """
    SELECT t.page, t.id, least(t.y0, min(w.y0)) AS y0, least(t.x0, min(w.x0)) AS x0, greatest(t.y1, max(w.y1)) AS y1, greatest(t.x1, max(w.x1)) AS x1, count(w.id) AS n
    FROM thirds t LEFT JOIN page_words w ON w.page = t.page AND w.y0 >= t.y0 AND w.y0 < t.y1
      AND greatest(0, least(w.x1, t.x1) - greatest(w.x0, t.x0)) > 0.55 * (w.x1 - w.x0) GROUP BY t.page, t.id, t.y0, t.x0, t.y1, t.x1""", "page_words", thirds=_THIRDS)
def _(spark, sf):
    w = V.page_words(spark, sf).drop("w")
    t = w.groupBy("page").agg(F.max("y1").alias("h")).withColumn("id", F.explode(F.expr("array(0L, 1L, 2L)")))
    t = t.select("page", "id", F.floor(F.col("h") * F.col("id") / 3).alias("y0"), F.lit(10).cast("bigint").alias("x0"),
                 F.floor(F.col("h") * (F.col("id") + 1) / 3).alias("y1"), F.lit(60).cast("bigint").alias("x1"))
    return J.extend_regions(w, t, PAGE)


# A form description: 3 tables of 4 keys, each a ratio range of the area of a rank.
TEMPLATE = [(f"t{t}", f"k{k}", 0, t, k / 4, (k + 1) / 4, 0.2 * t, 1.0) for t in range(3) for k in range(4)]
_TPL = ", ".join(f"('{a}', '{b}', {c}::BIGINT, {d}::BIGINT, {e}::DOUBLE, {f}::DOUBLE, {g}::DOUBLE, {h}::DOUBLE)" for a, b, c, d, e, f, g, h in TEMPLATE)
TEMPLATE_SCHEMA = "tbl string, key string, seq bigint, bbox_index bigint, x0r double, x1r double, y0r double, y1r double"
_RANKED = """SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0 + y1, id) - 1 AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS rk FROM blocks) WHERE rk <= 3"""
_TCELLS = """SELECT page, id, tbl, key, seq, CAST(trunc(x0 + (x1 - x0) * x0r) AS BIGINT) AS x0, CAST(trunc(x0 + (x1 - x0) * x1r) AS BIGINT) AS x1,
    CAST(trunc(y0 + (y1 - y0) * y0r) AS BIGINT) AS y0, CAST(trunc(y0 + (y1 - y0) * y1r) AS BIGINT) AS y1
    FROM rareas JOIN (VALUES {0}) t(tbl, key, seq, bbox_index, x0r, x1r, y0r, y1r) ON rank = bbox_index"""
TPL_SQL = dict(rareas=_RANKED, tcells=_TCELLS.format(_TPL))
TPL_WORDS = """SELECT c.page, tbl, key, seq, w.id, w.w FROM tcells c JOIN page_words w ON w.page = c.page AND w.y0 // 5 BETWEEN c.id - 1 AND c.id + 1
    AND w.y0 + w.y1 >= 2 * c.y0 AND w.y0 + w.y1 <= 2 * c.y1 AND w.x0 + w.x1 >= 2 * c.x0 AND w.x0 + w.x1 <= 2 * c.x1"""


def template_words(spark, sf):
    """Words in the areas of a template. The blocks are held against each other, so they are written once."""
    areas = R.rank_areas(materialise(V.blocks(spark, sf, dealt=False)), PAGE, 3)
    return J.extract_template(V.page_words(spark, sf), areas, spark.createDataFrame(TEMPLATE, TEMPLATE_SCHEMA), PAGE)


@query("join16_extract_template", TPL_WORDS, "page_words", "blocks", **TPL_SQL)
def _(spark, sf):
    return template_words(spark, sf).select("page", "tbl", "key", "seq", "id", "w")


@query("join19_review_pivots", """
    SELECT page, pos FROM pivots p WHERE NOT EXISTS (SELECT 1 FROM mids m WHERE m.page = p.page AND m.spot = p.pos)""", "pivots", "page_words",
       mids="""SELECT page, spot FROM (SELECT page, (x0 + x1) / 2 AS m, unnest([(x0 + x1) // 2 - 2, (x0 + x1) // 2 - 1, (x0 + x1) // 2, (x0 + x1) // 2 + 1, (x0 + x1) // 2 + 2]) AS spot
       FROM page_words WHERE x1 - x0 >= 9) WHERE abs(spot - m) < 1.5 GROUP BY ALL""")
def _(spark, sf):
    return J.review_pivots(V.pivots(spark, sf), V.page_words(spark, sf), PAGE, 1.5, 9, 1).select("page", "pos")


@query("join20_rename_keys", """
    SELECT doc_id, 'lang-' || lang AS tbl, coalesce('lang-' || l.lang2, source) AS key FROM documents LEFT JOIN (SELECT DISTINCT lang AS lang2 FROM documents) l ON l.lang2 = source""")
def _(spark, sf):
    d = V.documents(spark, sf)
    names = d.select(F.col("lang").alias("old"), F.concat(F.lit("lang-"), "lang").alias("new")).distinct()
    return J.rename_keys(d.select("doc_id", F.col("lang").alias("tbl"), F.col("source").alias("key")), names).select("doc_id", "tbl", "key")


# ---- cells ----------------------------------------------------------------

@query("agg14_find_objects", """
    SELECT page, label, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, count(*) AS n, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx
    FROM (SELECT page, unicode(ch)::BIGINT AS label, y, x FROM cells) GROUP BY page, label""", "cells")
def _(spark, sf):
    """One object per character of a page."""
    o = C.find_objects(V.cells(spark, sf).select("page", F.ascii("ch").cast("bigint").alias("label"), "y", "x"), PAGE)
    return o.withColumns({"cy": F.round("cy", 6), "cx": F.round("cx", 6)})


@query("agg15_mbr", "SELECT doc_id, y, min(x0) AS x0, max(x1) AS x1, y AS y0, y + 1 AS y1 FROM words GROUP BY doc_id, y", "words")
def _(spark, sf):
    w = V.words(spark, sf).select("doc_id", "y", F.col("y").alias("y0"), "x0", (F.col("y") + 1).alias("y1"), "x1")
    return B.mbr(w, ["doc_id", "y"])


@query("agg16_classify_boxes", """
    SELECT page, id, CASE WHEN w * h > 6 * ma AND t = 0 AND h > 2 * mh THEN 3 WHEN w * h > 6 * ma AND t = 2 THEN 4 WHEN w * h > 6 * ma THEN 5 ELSE t END::BIGINT AS type,
           t = 0 AND h > 0.66 * mh AND h < 1.5 * mh AS line_height
    FROM typed JOIN (SELECT page, avg(CASE WHEN t = 0 THEN w * h END) AS ma, avg(CASE WHEN t = 0 THEN h END)::DOUBLE AS mh FROM typed GROUP BY page) USING (page)""", "page_words", "blocks",
       typed="""SELECT *, CASE WHEN w / h > 15 THEN 1 WHEN w / h < 1.0 / 15 THEN 2 ELSE 0 END AS t FROM (SELECT page, id, x1 - x0 AS w, y1 - y0 AS h FROM page_words
       UNION ALL SELECT page, id + 10000000, x1 - x0, y1 - y0 FROM blocks)""")
def _(spark, sf):
    u = V.page_words(spark, sf).drop("w").unionByName(V.blocks(spark, sf).withColumn("id", F.col("id") + 10_000_000))
    return B.classify_boxes(u, PAGE).select("page", "id", "type", "line_height")


@query("agg17_projection", """
    SELECT page, 'row' AS axis, pos, v FROM row_profile UNION ALL SELECT page, 'col', pos, v FROM col_profile
    UNION ALL SELECT page, 'inv', pos, 200 - v FROM row_profile""", "row_profile", "col_profile")
def _(spark, sf):
    """Both axes from one pass over the cells; the inverted form is that of the rows."""
    both = F.explode(F.array(F.struct(F.lit("row").alias("axis"), F.col("y").alias("at")), F.struct(F.lit("col").alias("axis"), F.col("x").alias("at"))))
    c = V.cells(spark, sf).select("page", both.alias("_b")).select(F.struct("page", "_b.axis").alias("k"), F.col("_b.at").alias("at"))
    p = C.projection(c, "k", "at").select("k.page", "k.axis", "pos", "v")
    inv = F.when(F.col("axis") == "row", F.struct(F.lit("inv").alias("axis"), (200 - F.col("v")).alias("v")))
    return p.select("page", "pos", F.inline(F.array_compact(F.array(F.struct("axis", "v"), inv)))).select("page", "axis", "pos", "v")


@query("agg18_remove_noise", """
    SELECT page, y, count(*) AS n FROM cells JOIN good USING (page, label) GROUP BY page, y""", "cells", "page_words",
       good="""SELECT page, id + 1 AS label FROM page_words JOIN (SELECT page, max(y1) AS h, max(x1) AS w FROM page_words GROUP BY page) s USING (page)
       WHERE x1 - x0 >= 5 AND NOT (x1 - x0 < 1.2 * 5 AND ((x0 + x1) / 2 < 8 OR (x0 + x1) / 2 > s.w - 8 OR (y0 + y1) / 2 < 8 OR (y0 + y1) / 2 > h - 8))""")
def _(spark, sf):
    return C.remove_noise(V.cells(spark, sf), PAGE, 5, 8).groupBy("page", "y").agg(F.count("*").alias("n"))


@query("agg19_estimate_scale", """
    SELECT page, round(median(s), 6) AS scale FROM (SELECT page, sqrt(a) AS s, unnest(range(0, a)) AS i FROM
      (SELECT page, (x1 - x0) * (y1 - y0) AS a FROM page_words) WHERE sqrt(a) > 2 AND sqrt(a) < 100) GROUP BY page""", "page_words")
def _(spark, sf):
    return J.estimate_scale(V.page_words(spark, sf).drop("w"), PAGE, 2, 100).withColumn("scale", F.round("scale", 6))


@query("agg24_box_contrast", """
    SELECT page, id, back, round(fore, 6) AS fore, fore < back AS dark FROM
      (SELECT r.page, r.id, median(coalesce(c.v, 0))::DOUBLE AS back FROM ring r LEFT JOIN lit c ON c.page = r.page AND c.y = r.y AND c.x = r.x GROUP BY r.page, r.id)
    JOIN (SELECT page, label - 1 AS id, avg(unicode(ch)) AS fore FROM cells GROUP BY page, label) USING (page, id)""", "cells", "page_words",
       lit="SELECT page, y, x, max(unicode(ch)) AS v FROM cells GROUP BY ALL", size="SELECT page, max(y) AS my, max(x) AS mx FROM cells GROUP BY page",
       ring="""SELECT page, id, greatest(least(o.y, my), 0) AS y, greatest(least(o.x, mx), 0) AS x FROM (SELECT page, id, unnest([
       {'y': y0 - 1, 'x': x0 - 1}, {'y': y0 - 1, 'x': x0}, {'y': y0, 'x': x0 - 1}, {'y': y1, 'x': x0 - 1}, {'y': y1, 'x': x0}, {'y': y1 - 1, 'x': x0 - 1},
       {'y': y1, 'x': x1}, {'y': y1, 'x': x1 - 1}, {'y': y1 - 1, 'x': x1}, {'y': y0 - 1, 'x': x1}, {'y': y0 - 1, 'x': x1 - 1}, {'y': y0, 'x': x1}]) AS o FROM page_words) JOIN size USING (page)""")
def _(spark, sf):
    c = V.cells(spark, sf).select("page", "y", "x", F.ascii("ch").alias("v"))
    return C.box_contrast(c, V.page_words(spark, sf).drop("w"), PAGE, ["id"], "v", {"y": 1, "x": 16}).select("page", "id", F.col("back").cast("double"), F.round("fore", 6).alias("fore"), "dark")


_MARK = "SELECT DISTINCT page, label FROM cells WHERE regexp_matches(ch, '[A-Z0-9]')"


def _markers(spark, sf):
    return V.cells(spark, sf).where(F.col("ch").rlike("[A-Z0-9]"))


@query("join10_keep_marked", "SELECT page, y, count(*) AS n FROM cells SEMI JOIN mk USING (page, label) GROUP BY page, y", "cells", mk=_MARK)
def _(spark, sf):
    return C.keep_marked(V.cells(spark, sf), _markers(spark, sf), PAGE).groupBy("page", "y").agg(F.count("*").alias("n"))


@query("join10_remove_marked", "SELECT page, y, count(*) AS n FROM cells ANTI JOIN mk USING (page, label) GROUP BY page, y", "cells", mk=_MARK)
def _(spark, sf):
    return C.remove_marked(V.cells(spark, sf), _markers(spark, sf), PAGE).groupBy("page", "y").agg(F.count("*").alias("n"))


@query("join11_correspondences", "SELECT DISTINCT page, label AS a, x // 4 + 1 AS b FROM cells", "cells")
def _(spark, sf):
    """Words against bands four columns wide."""
    c = V.cells(spark, sf)
    return C.correspondences(c, c.withColumn("label", F.floor(F.col("x") / 4) + 1), PAGE)


_SEEDS = "SELECT page, y, x, unicode(ch)::BIGINT AS v FROM cells WHERE ch IN ('a', 'e', 'i', 'o', 'u')"
for _name, _conf, _sql in (("join12_propagate_labels", -1, "CASE WHEN max(v) = min(v) THEN max(v) ELSE -1 END"), ("join12_propagate_simple", None, "max(v)")):
    @query(_name, f"SELECT page, c.label - 1 AS wid, coalesce({_sql}, 0)::BIGINT AS label FROM cells c LEFT JOIN seeds s USING (page, y, x) GROUP BY page, c.label", "cells", seeds=_SEEDS)
    def _(spark, sf, conflict=_conf):
        c = V.cells(spark, sf)
        seeds = c.where(F.col("ch").isin(*"aeiou")).select("page", "y", "x", F.ascii("ch").cast("bigint").alias("label"))
        got = C.propagate_labels(c.withColumn("wid", F.col("label") - 1), seeds, PAGE, conflict)
        return got.groupBy("page", "wid").agg(F.max("label").alias("label"))


@query("join13_spread_labels", """
    SELECT page, y, count(*) AS n, sum(label)::BIGINT AS s FROM (SELECT page, y, x, label, row_number() OVER (PARTITION BY page, y, x ORDER BY d2, label) AS rk FROM
      (SELECT c.page, c.y + dy AS y, c.x + dx AS x, label, dy * dy + dx * dx AS d2 FROM cells c, offs WHERE regexp_matches(ch, '[A-Z0-9]'))
      JOIN (SELECT page, max(y) AS h, max(x) AS w FROM cells GROUP BY page) USING (page) WHERE y BETWEEN 0 AND h AND x BETWEEN 0 AND w) WHERE rk = 1 GROUP BY page, y""", "cells",
       offs="SELECT a.i AS dy, b.i AS dx FROM range(-3, 4) a(i), range(-3, 4) b(i) WHERE a.i * a.i + b.i * b.i < 9")
def _(spark, sf):
    bounds = V.cells(spark, sf).groupBy("page").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    s = C.spread_labels(_markers(spark, sf).select("page", "y", "x", "label"), PAGE, 3, bounds)
    return s.groupBy("page", "y").agg(F.count("*").alias("n"), F.sum("label").alias("s"))


@query("join14_neighbor_labels", """
    SELECT DISTINCT page, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b FROM cells a JOIN
      (SELECT page, y + 1 AS y, x, label FROM cells UNION ALL SELECT page, y, x + 1, label FROM cells) b USING (page, y, x) WHERE a.label <> b.label""", "cells")
def _(spark, sf):
    return C.neighbor_labels(V.cells(spark, sf), PAGE)


@query("join17_read_marks", """
    SELECT page, id, ink, ink > greatest(0.8 * max(ink) OVER (PARTITION BY page), 12) AS marked FROM
      (SELECT b.page, b.id, count(c.x) AS ink FROM bx b LEFT JOIN
         (SELECT page, y, x, unnest([y // 5 - 2, y // 5 - 1, y // 5, y // 5 + 1]) AS g FROM cells) c
       ON c.page = b.page AND c.g = b.id AND c.y >= b.y0 AND c.y < b.y1 AND c.x >= b.x0 AND c.x < b.x1 GROUP BY b.page, b.id)""", "cells", "blocks",
       bx="""SELECT page, id, greatest(y0 + 1 - 5, 0) AS y0, greatest(x0 + 12 - 5, 0) AS x0, least(y1 + 1 + 5, h) AS y1, least(x1 + 12 + 5, w) AS x1
       FROM blocks JOIN (SELECT page, max(y) + 1 AS h, max(x) + 1 AS w FROM cells GROUP BY page) USING (page)""")
def _(spark, sf):
    return C.read_marks(V.cells(spark, sf), V.blocks(spark, sf), PAGE, ["id"], (1, 12))


@query("join18_crop_cells", """
    SELECT page, id, (y1 - y0 + 4) * (x1 - x0 + 4) AS n, coalesce(ink, 0)::BIGINT AS ink, coalesce(sy, 0)::BIGINT AS sy FROM blocks LEFT JOIN
      (SELECT b.page, b.id, count(*) AS ink, sum(c.y - b.y0 + 2) AS sy FROM blocks b JOIN
        (SELECT DISTINCT page, y, x, unnest([y // 5 - 1, y // 5, y // 5 + 1]) AS g FROM cells) c
       ON c.page = b.page AND c.g = b.id AND c.y >= b.y0 - 2 AND c.y < b.y1 + 2 AND c.x >= b.x0 - 2 AND c.x < b.x1 + 2 GROUP BY b.page, b.id) USING (page, id)""", "cells", "blocks")
def _(spark, sf):
    """Blocks cut out with a margin of 2, summed up per cut."""
    c = V.cells(spark, sf).select("page", "y", "x", F.lit(1).alias("v")).distinct()
    cut = C.crop_cells(c, V.blocks(spark, sf), PAGE, ["id"], "v", 2, 0)
    return cut.groupBy("page", "id").agg(F.count("*").alias("n"), F.sum("v").alias("ink"), F.sum(F.col("v") * F.col("y")).alias("sy"))
