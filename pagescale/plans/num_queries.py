"""Registered queries: numbers, colours, arrays and boxes."""

from pyspark.sql import functions as F

from pagescale.functions import boxes as B
from pagescale.functions import numeric as N
from pagescale.plans.registry import query
from pagescale.plans.views import (blocks, candidates, cells, col_profile, line_boxes, page_words, table)
from pagescale.session import materialise


@query("num1_binarize_midrange", """
    SELECT page, pos, v, CAST(CASE WHEN v > 0.5 * (lo + hi) THEN 255 ELSE 0 END AS BIGINT) AS b
    FROM col_profile JOIN (SELECT page, min(v) AS lo, max(v) AS hi FROM col_profile GROUP BY page) USING (page)""", "col_profile")
def _(spark, sf):
    return N.binarize_midrange(col_profile(spark, sf), ["page"], "v", 0.5, 255)


@query("num2_norms", """
    SELECT vec_id, class, round(score / m, 6) AS normed, round(e / s, 6) AS soft,
           round(CASE WHEN abs(score - m) > 10 THEN m ELSE ln(exp(score - m) + 1) + m END, 6) AS log_sum
    FROM (SELECT *, exp(least(greatest(score, -100), 100)) AS e, max(score) OVER p AS m, sum(exp(least(greatest(score, -100), 100))) OVER p AS s
          FROM candidates WINDOW p AS (PARTITION BY vec_id))""", "candidates")
def _(spark, sf):
    c = N.softmax(N.norm_max(candidates(spark, sf), ["vec_id"], "score"), ["vec_id"], "score")
    c = N.with_group(c, ["vec_id"], m=F.max("score"))
    return c.select("vec_id", "class", F.round("normed", 6).alias("normed"), F.round("soft", 6).alias("soft"), F.round(N.log_add("score", "m"), 6).alias("log_sum"))


@query("num2_row_norm", """
    SELECT vec_id, round(sqrt(sum(v * v)), 6) AS norm FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY vec_id""")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(N.row_norm("embedding"), 6).alias("norm"))


def _packed(spark, sf):
    c = cells(spark, sf)
    return c.select("page", "y", N.rgb2int(F.col("label") % 256, F.col("y") % 256, F.col("x") % 256).cast("bigint").alias("c"))


def _sums(df, *cols):
    return df.groupBy("page", "y").agg(*[F.sum(c).alias(c) for c in cols])


_PACKED = "SELECT page, y, ((label % 256) << 16) | ((y % 256) << 8) | (x % 256) AS c FROM cells"


@query("num3_rgb_packing", """
    SELECT page, y, sum(c)::BIGINT AS c, sum(c >> 16 & 255)::BIGINT AS r, sum(c >> 8 & 255)::BIGINT AS g, sum(c & 255)::BIGINT AS b,
           sum(CASE WHEN c = 0 THEN 16777215 ELSE c END)::BIGINT AS white, sum(CASE WHEN c = 16777215 THEN 0 ELSE c END)::BIGINT AS black
    FROM packed GROUP BY page, y""", "cells", packed=_PACKED)
def _(spark, sf):
    """Every cell packed and unpacked, summed per page row."""
    c = _packed(spark, sf)
    return _sums(c.select("*", *N.int2rgb("c"), N.seg_white("c").alias("white"), N.seg_black("c").alias("black")),
                 "c", "r", "g", "b", "white", "black")


@query("num4_segment_level", """
    SELECT page, y, sum(k & 16711680)::BIGINT AS col, sum(k & 16776960)::BIGINT AS par, sum(k)::BIGINT AS line
    FROM (SELECT page, y, CASE WHEN c > 8388608 THEN 0 ELSE c END AS k FROM packed) GROUP BY page, y""", "cells", packed=_PACKED)
def _(spark, sf):
    c = _packed(spark, sf)
    return _sums(c.select("page", "y", *[N.segment_level("c", lv).alias(n) for lv, n in (("column", "col"), ("paragraph", "par"), ("line", "line"))]),
                 "col", "par", "line")


_COLORS = "SELECT l_orderkey AS id, l_linenumber::BIGINT AS n, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem"


def colors(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"),
                                               (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"),
                                               (F.col("l_orderkey") % 256).alias("b"))


@query("num5_rgb_to_lab", """
    SELECT id, n, round(116 * fy - 16, 4) AS "L", round(500 * (fx - fy), 4) AS "A", round(200 * (fy - fz), 4) AS "B"
    FROM (SELECT id, n, CASE WHEN tx > 0.008856 THEN cbrt(tx) ELSE 7.787 * tx + 0.138 END AS fx,
                 CASE WHEN ty > 0.008856 THEN cbrt(ty) ELSE 7.787 * ty + 0.138 END AS fy,
                 CASE WHEN tz > 0.008856 THEN cbrt(tz) ELSE 7.787 * tz + 0.138 END AS fz
          FROM (SELECT id, n, (r * 0.49::DOUBLE + g * 0.31::DOUBLE + b * 0.2::DOUBLE) / 255.0::DOUBLE AS tx,
                       (r * 0.177::DOUBLE + g * 0.812::DOUBLE + b * 0.011::DOUBLE) / 255.0::DOUBLE AS ty,
                       (g * 0.01::DOUBLE + b * 0.99::DOUBLE) / 255.0::DOUBLE AS tz FROM colors))""", colors=_COLORS)
def _(spark, sf):
    return colors(spark, sf).select("id", "n", *N.rgb_to_lab("r", "g", "b")).select("id", "n", *[F.round(c, 4).alias(c) for c in "LAB"])


@query("num5_lab_to_rgb", "SELECT id, n, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM colors", colors=_COLORS)
def _(spark, sf):
    """There and back gives the colours again."""
    lab = colors(spark, sf).select("id", "n", *N.rgb_to_lab("r", "g", "b"))
    return lab.select("id", "n", *N.lab_to_rgb("L", "A", "B")).select("id", "n", *[F.round(c).cast("bigint").alias(c) for c in "rgb"])


@query("num6_take_every", """
    SELECT user_id, event_id, (rn - 1) % 3 = 0 AS taken FROM
      (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts")
    day = F.floor(F.unix_timestamp("ts") / 86400)
    cols = ["user_id", "event_id"]
    a = N.take_every(ev, ["user_id"], ["ts", "event_id"], day, 3).select(*cols, F.lit(True).alias("taken"))
    return a.unionByName(N.take_every(ev, ["user_id"], ["ts", "event_id"], day, 3, skip=True).select(*cols, F.lit(False).alias("taken")))


@query("num6_frange", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, unnest(range(0, CAST(ceil(l_quantity / 10) AS BIGINT))) * 10.0::DOUBLE AS at FROM lineitem""")
def _(spark, sf):
    """Sampling positions 0, 10, ... below each line's quantity."""
    at = F.explode(N.frange(0, F.col("l_quantity"), 10))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", at.alias("at"))


@query("num7_lookup_clamped", """
    SELECT p.page, p.id, p.gy, p.gx, coalesce(g.label, 0) AS label FROM
      (SELECT page, id, greatest(least(y0 + 1, my), 0) AS gy, greatest(least(x0 + 30, mx), 0) AS gx
       FROM page_words JOIN (SELECT page, max(y) AS my, max(x) AS mx FROM cells GROUP BY page) USING (page)) p
    LEFT JOIN cells g ON g.page = p.page AND g.y = p.gy AND g.x = p.gx""", "page_words", "cells")
def _(spark, sf):
    pts = page_words(spark, sf).select("page", "id", (F.col("y0") + 1).alias("y"), (F.col("x0") + 30).alias("x"))
    return N.lookup_clamped(cells(spark, sf), pts, ["page"], "label").select("page", "id", "gy", "gx", "label")


@query("num8_testset", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CAST(floor(abs(sin(l_orderkey)) * 1.23456789e6) AS BIGINT) % 10 = 3 AS test FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.testset("l_orderkey", 3, 10).alias("test"))


@query("num9_dist", """
    SELECT vec_id, c::BIGINT AS class, round(sqrt(sum((v - m) * (v - m))), 5) AS d
    FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    JOIN means USING (i) WHERE c = label GROUP BY vec_id, c""", "means")
def _(spark, sf):
    from pagescale.operators.scoring import centroids
    emb = table(spark, sf, "embeddings")
    cen = centroids(emb, "label", "embedding")
    return emb.join(cen, emb["label"] == cen["class"]).select("vec_id", "class", F.round(N.dist("embedding", "centroid"), 5).alias("d"))


@query("num10_topk_classes", """
    SELECT vec_id, rk, class, score FROM (SELECT vec_id, class, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS rk
    FROM candidates) WHERE rk <= 3""", "candidates")
def _(spark, sf):
    """One array of scores per vector, ten classes."""
    arr = candidates(spark, sf).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "score"))), lambda s: s["score"]).alias("p"))
    top = arr.select("vec_id", F.posexplode(N.topk_classes("p", 3)).alias("i", "s"))
    return top.select("vec_id", (F.col("i") + 1).alias("rk"), F.col("s.class").cast("string").alias("class"), F.col("s.prob").alias("score"))


# ---- boxes ----------------------------------------------------------------

def _page_size(spark, sf):
    return page_words(spark, sf).groupBy("page").agg(F.max("y1").alias("ph"), F.max("x1").alias("pw"))


_SIZE = "SELECT page, max(y1) AS ph, max(x1) AS pw FROM page_words GROUP BY page"


@query("box1_layouts", """
    SELECT page, id, x0 AS x, y0 AS y, x1 - x0 AS w, 1::BIGINT AS h, ph - y1 - 1 AS my0, ph - y0 - 1 AS my1, y1 AS bl_y, y0 AS tl_y, x0 AS bl_x, x1 AS br_x, x1 AS tr_x
    FROM page_words JOIN size USING (page)""", "page_words", size=_SIZE)
def _(spark, sf):
    """Each layout written and read back before the next."""
    b = page_words(spark, sf).drop("w").join(_page_size(spark, sf), "page")
    for layout in ("raster", "points"):
        b = B.to_boxes(B.from_boxes(b, layout), layout)
    m = B.from_boxes(b, "math", "ph")
    b = B.to_boxes(m.withColumns({"my0_": F.col("my0"), "my1_": F.col("my1")}), "math", "ph")
    c = B.from_boxes(b, "corners").withColumns({n + "_": F.col(n) for n in ("bl_y", "tl_y", "bl_x", "br_x", "tr_x")})
    x = B.from_boxes(B.to_boxes(c, "corners"), "xywh")
    return x.select("page", "id", "x", "y", "w", "h", *[F.col(n + "_").alias(n) for n in ("my0", "my1", "bl_y", "tl_y", "bl_x", "br_x", "tr_x")])


@query("box2_measures", """
    SELECT page, id, y0, x0, y1, x1, x1 - x0 AS width, y1 - y0 AS height, (x1 - x0) * (y1 - y0) AS area, (x1 - x0) / (y1 - y0) AS aspect,
           (y1 - y0) / (x1 - x0) AS tallness, CASE WHEN (y1 - y0) / (x1 - x0) < 1 THEN 1 / ((y1 - y0) / (x1 - x0)) ELSE (y1 - y0) / (x1 - x0) END AS aspect_normalized,
           greatest(x1 - x0, y1 - y0) AS max_side, least(x1 - x0, y1 - y0) AS min_side, (y0 + y1) / 2 AS ycenter, (x0 + x1) / 2 AS xcenter FROM blocks""", "blocks")
def _(spark, sf):
    return B.box_measures(blocks(spark, sf))


@query("box3_moves", """
    SELECT page, id, CAST(trunc((y0 + 2) * 0.3::DOUBLE) AS BIGINT) AS y0, CAST(trunc((x0 - 8) * 0.3::DOUBLE) AS BIGINT) AS x0,
           CAST(trunc((y1 + 4) * 0.3::DOUBLE) AS BIGINT) AS y1, CAST(trunc((x1 - 6) * 0.3::DOUBLE) AS BIGINT) AS x1 FROM page_words""", "page_words")
def _(spark, sf):
    return B.scale_boxes(B.pad_boxes(B.shift_boxes(page_words(spark, sf).drop("w"), 3, -7), 1), 0.3)


@query("box3_parents", """
    SELECT w.page, w.id, w.x0 - b.x0 AS rx0, w.y0 AS back_y0, w.x0 AS back_x0,
           round((w.x0 - b.x0) / (b.x1 - b.x0), 6) AS x0r, round((w.x1 - b.x0) / (b.x1 - b.x0), 6) AS x1r,
           round((w.y0 - b.y0) / (b.y1 - b.y0), 6) AS y0r, round((w.y1 - b.y0) / (b.y1 - b.y0), 6) AS y1r
    FROM page_words w JOIN blocks b ON w.page = b.page AND w.y0 // 5 = b.id""", "page_words", "blocks")
def _(spark, sf):
    bl = materialise(blocks(spark, sf).withColumnRenamed("id", "blk"))  # read three times
    on = ["page", "blk"]
    w = page_words(spark, sf).drop("w").withColumn("blk", F.floor(F.col("y0") / 5))
    r = B.to_ratio(w, bl, on)
    org = bl.select(*on, F.col("y0").alias("oy"), F.col("x0").alias("ox"))
    inner = B.shift_boxes(r.join(org, on), "oy", "ox", -1).withColumn("rx0", F.col("x0"))
    back = B.to_parent(inner, bl, on)
    return back.select("page", "id", "rx0", F.col("y0").alias("back_y0"), F.col("x0").alias("back_x0"), *[F.round(c, 6).alias(c) for c in ("x0r", "x1r", "y0r", "y1r")])


@query("box4_cuts", """
    SELECT page, id, CAST(trunc(y0 + (y1 - y0) * 0.25::DOUBLE) AS BIGINT) AS y0, CAST(trunc(x0 + (x1 - x0) * 0.1::DOUBLE) AS BIGINT) AS x0,
           CAST(trunc(y0 + (y1 - y0) * 0.8::DOUBLE) AS BIGINT) AS y1, CAST(trunc(x0 + (x1 - x0) * 0.65::DOUBLE) AS BIGINT) AS x1 FROM blocks""", "blocks")
def _(spark, sf):
    return B.cut_boxes(blocks(spark, sf), 0.1, 0.65, 0.25, 0.8)


@query("box5_pair_functions", """
    SELECT a.page, a.id, least(a.y0, b.y0) AS uy0, greatest(a.x1, b.x1) AS ux1, greatest(a.y0, b.y0) AS iy0, least(a.x1, b.x1) AS ix1,
           greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS ox, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS oy,
           round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, a.x1 - a.x0, b.x1 - b.x0), 6) AS rx,
           a.x1 >= b.x0 AND b.x1 >= a.x0 AS tx, a.y1 >= b.y0 AND b.y1 >= a.y0 AS ty,
           a.y0 + a.y1 >= 2 * b.y0 AND a.y0 + a.y1 <= 2 * b.y1 AND a.x0 + a.x1 >= 2 * b.x0 AND a.x0 + a.x1 <= 2 * b.x1 AS mid_in
    FROM (SELECT *, lead({'y0': y0, 'x0': x0, 'y1': y1, 'x1': x1}) OVER (PARTITION BY page ORDER BY id) AS b FROM page_words) a WHERE b IS NOT NULL""", "page_words")
def _(spark, sf):
    w = page_words(spark, sf)
    a = w.select("page", "id", *[F.col(c).alias("a_" + c) for c in B.BOX])
    b = w.select("page", (F.col("id") - 1).alias("id"), *[F.col(c).alias("b_" + c) for c in B.BOX])
    u, i = B.box_union("a_", "b_"), B.box_intersect("a_", "b_")
    return a.join(b, ["page", "id"]).select(
        "page", "id", u[0].alias("uy0"), u[3].alias("ux1"), i[0].alias("iy0"), i[3].alias("ix1"),
        B.overlap_len("a_", "b_", "x").alias("ox"), B.overlap_len("a_", "b_", "y").alias("oy"), F.round(B.overlap_rel("a_", "b_", "x"), 6).alias("rx"),
        B.overlaps("a_", "b_", "x").alias("tx"), B.overlaps("a_", "b_", "y").alias("ty"), B.center_in("a_", "b_").alias("mid_in"))


@query("box6_line_shapes", """
    SELECT page, id, (x1 - x0) / (y1 - y0) > 15 AS hline, (x1 - x0) / (y1 - y0) < 1 / 15 AS vline FROM line_boxes""", "line_boxes")
def _(spark, sf):
    return line_boxes(spark, sf).select("page", "id", B.is_hline().alias("hline"), B.is_vline().alias("vline"))


@query("box7_size_filters", """
    SELECT page, id, w * h > 50 AND w * h < 300 AS area, w > 3 AND h > 4 AS min_sides, w > 60 OR h > 60 AS any_side,
           sqrt(w * h) >= 4 AND sqrt(w * h) <= 32 AS scaled, w >= 40 AND h >= 4 AS line, w * h < 250 AS noise
    FROM (SELECT page, id, x1 - x0 AS w, y1 - y0 AS h FROM blocks)""", "blocks")
def _(spark, sf):
    rules = {"area": (50, 300), "min_sides": (), "any_side": (60,), "scaled": (0.5, 4, 8), "line": (5, 0.5, 8), "noise": (250,)}
    return blocks(spark, sf).select("page", "id", *[B.box_rule(r, *a).alias(r) for r, a in rules.items()])


@query("box8_component_boxes", """
    SELECT page, id, greatest(y0 - 2, 0) AS y0, greatest(x0 - 2, 0) AS x0, least(y1 + 2, ph) AS y1, least(x1 + 2, pw) AS x1
    FROM page_words JOIN size USING (page) WHERE (x1 - x0) * (y1 - y0) >= 4 AND x1 - x0 >= 3 AND NOT (y0 <= 0 AND x0 <= 0 AND y1 >= ph AND x1 >= pw)""",
       "page_words", size=_SIZE)
def _(spark, sf):
    b = page_words(spark, sf).join(_page_size(spark, sf), "page")
    return B.component_boxes(b, "ph", "pw", 4).select("page", "id", *B.BOX)


@query("box9_date_slot", """
    SELECT page, id, CASE WHEN x0 < pw * 0.3 THEN 'd' WHEN x0 < pw * 0.6 THEN 'm' ELSE 'y' END AS slot FROM page_words JOIN size USING (page)""",
       "page_words", size=_SIZE)
def _(spark, sf):
    b = page_words(spark, sf).join(_page_size(spark, sf), "page")
    return b.select("page", "id", B.date_slot(F.col("x0"), F.col("pw") * 0.3, F.col("pw") * 0.6).alias("slot"))


@query("box10_trim_lines", """
    SELECT page, greatest(min(y0) - 5, 0) AS top, least(max(y1) + 5, ph - 1) AS bottom, min(x0) AS lft, max(x1) AS rgt
    FROM page_words JOIN size USING (page) GROUP BY page, ph""", "page_words", size=_SIZE)
def _(spark, sf):
    w = page_words(spark, sf)
    y = B.trim_lines(w.withColumn("ph", F.col("y1")), ["page"], "y", "ph").toDF("page", "top", "bottom")
    x = B.trim_lines(w, ["page"], "x").toDF("page", "lft", "rgt")
    return y.join(x, "page")


@query("box11_reading_key", "SELECT page, id, y0 // 10 * 10 * pw + x0 AS rkey FROM page_words JOIN size USING (page)", "page_words", size=_SIZE)
def _(spark, sf):
    b = page_words(spark, sf).join(_page_size(spark, sf), "page")
    return b.select("page", "id", B.reading_key(F.col("y0"), F.col("x0"), F.col("pw")).alias("rkey"))
