"""Registered queries: ranks, top-k, samples, splits."""

from pyspark.sql import functions as F

from pagescale.operators import metrics as M
from pagescale.operators import ranking as R
from pagescale.plans import views as V
from pagescale.plans.registry import query


@query("top1_sort_boxes", """
    SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY x0 + x1, id) - 1 AS lr, row_number() OVER (PARTITION BY page ORDER BY y0 + y1, id) - 1 AS td,
           row_number() OVER (PARTITION BY page ORDER BY y0 + y1 DESC, id DESC) - 1 AS bu FROM page_words""", "page_words")
def _(spark, sf):
    w = V.page_words(spark, sf)
    for d, n in (("left-right", "lr"), ("top-down", "td"), ("bottom-up", "bu")):
        w = R.sort_boxes(w, ["page"], d).withColumnRenamed("idx", n)
    return w.select("page", "id", "lr", "td", "bu")


@query("top2_select_regions", """
    SELECT page, id, score FROM (SELECT page, id, x1 - x0 AS score, row_number() OVER (PARTITION BY page ORDER BY x1 - x0 DESC, id) AS rk
    FROM page_words) WHERE rk <= 5 AND score > 6""", "page_words")
def _(spark, sf):
    return R.select_regions(V.page_words(spark, sf), ["page"], F.col("x1") - F.col("x0"), 6, 5).select("page", "id", "score")


@query("udf2_region_score", """
    SELECT page, id, score::DOUBLE AS score FROM (SELECT page, id, sqrt((x1 - x0) * (y1 - y0)) AS score,
      row_number() OVER (PARTITION BY page ORDER BY sqrt((x1 - x0) * (y1 - y0)) DESC, id) AS rk FROM blocks) WHERE rk <= 3 AND score > 2""", "blocks")
def _(spark, sf):
    """The score is a user's pandas UDF."""
    @F.pandas_udf("double")
    def root_area(w, h):
        return (w * h) ** 0.5
    score = root_area((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double"))
    return R.select_regions(V.blocks(spark, sf), ["page"], score, 2, 3).select("page", "id", "score")


_AREAS = """SELECT *, (x1 - x0) * (y1 - y0) AS a FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM blocks o WHERE o.page = b.page AND o.id <> b.id
    AND o.y0 <= b.y0 AND o.y1 >= b.y1 AND o.x0 <= b.x0 AND o.x1 >= b.x1) AND (x1 - x0) / (y1 - y0) > 1"""


@query("top3_rank_areas", """
    SELECT page, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0 + y1, id) - 2 AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY page ORDER BY a DESC, id) AS rk FROM areas) WHERE rk <= 4) WHERE rank >= 0""", "blocks", areas=_AREAS)
def _(spark, sf):
    return R.rank_areas(V.blocks(spark, sf), ["page"], 4, "area", "top-down", 1, min_aspect=1).select("page", "id", "rank")


@query("top4_topk", """
    SELECT vec_id, class, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS rk FROM candidates) WHERE rk <= 3""", "candidates")
def _(spark, sf):
    return R.topk(V.candidates(spark, sf), ["vec_id"], 3).select("vec_id", "class", "score", "rk")


@query("top5_per_class_cap", """
    SELECT vec_id, label::BIGINT AS label, rk FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rk FROM embeddings) WHERE rk <= 5""")
def _(spark, sf):
    return R.per_class_cap(V.table(spark, sf, "embeddings").select("vec_id", "label"), "label", [F.asc("vec_id")], 5)


@query("top6_capped_wrong", """
    SELECT vec_id, real, pred FROM (SELECT *, row_number() OVER (PARTITION BY real ORDER BY vec_id) AS rk FROM ranked WHERE real <> pred)
    WHERE rk <= 3 ORDER BY real, vec_id LIMIT 1000""", "ranked")
def _(spark, sf):
    return M.capped_wrong(V.ranked(spark, sf).where("real <> pred")).select("vec_id", "real", "pred")


_VOCAB = "SELECT DISTINCT left(line, 1) AS ch FROM lines WHERE regexp_matches(line, '^[A-Z]')"
_KEPT = "SELECT doc_id, y, line FROM lines WHERE left(line, 1) IN (SELECT ch FROM vocab)"
_CH = "SELECT doc_id, y, unnest(string_split(line, '')) AS ch FROM kept"


def _vocab(spark, sf):
    return V.lines(spark, sf).where(F.col("line").rlike("^[A-Z]")).select(F.left("line", F.lit(1)).alias("ch")).distinct()


@query("top7_select_corpus", """
    SELECT doc_id, y, line, score FROM kept JOIN (SELECT doc_id, y, sum(n)::BIGINT AS score FROM chs JOIN (SELECT ch, count(*) AS n FROM chs GROUP BY ch) USING (ch)
      GROUP BY doc_id, y) USING (doc_id, y) ORDER BY score DESC, line DESC, doc_id, y LIMIT 200""", "lines", vocab=_VOCAB, kept=_KEPT, chs=_CH)
def _(spark, sf):
    return R.select_corpus(V.lines(spark, sf).select("doc_id", "y", "line"), ["doc_id", "y"], "line", _vocab(spark, sf), 200) \
        .select("doc_id", "y", "line", "score")


@query("top8_sample_batch", "SELECT doc_id, y, line FROM lines ORDER BY md5(doc_id || ':' || y || ':3') LIMIT 64", "lines")
def _(spark, sf):
    return R.sample_batch(V.lines(spark, sf).select("doc_id", "y", "line"), ["doc_id", "y"], 64, 3)


@query("top9_split_dataset", """
    SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= floor((SELECT count(*) FROM embeddings) * 0.8) THEN 'train' ELSE 'test' END AS prefix,
           CASE WHEN ('0x' || substr(md5(vec_id || ':5'), 1, 8))::BIGINT / 4294967296 < 0.8 THEN 'train' ELSE 'test' END AS random FROM embeddings""")
def _(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id")
    p = R.split_dataset(e, ["vec_id"], 0.8).withColumnRenamed("split", "prefix")
    return R.split_dataset(p, ["vec_id"], 0.2, "random", 5).withColumnRenamed("split", "random")


@query("top10_augmentation_plan", """
    SELECT vec_id, rotation, dx, dy, border FROM embeddings, (SELECT unnest([-10, 0, 10])::BIGINT AS rotation), (SELECT unnest([-20, -10, 0, 10, 20])::BIGINT AS dx),
      (SELECT unnest([-20, -10, 0, 10, 20])::BIGINT AS dy), (SELECT unnest([0, 5, 10])::BIGINT AS border)""")
def _(spark, sf):
    return R.augmentation_plan(V.table(spark, sf, "embeddings"), ["vec_id"])


@query("top10_noise_plan", """
    SELECT vec_id, CASE WHEN ('0x' || substr(md5(vec_id || ':9'), 1, 8))::BIGINT < 858993459 THEN
      ('0x' || substr(md5(vec_id || ':9'), 9, 8))::BIGINT % (SELECT count(*) FROM pages) ELSE -1 END AS bg_id FROM embeddings""")
def _(spark, sf):
    return R.noise_plan(V.table(spark, sf, "embeddings"), ["vec_id"], V.table(spark, sf, "pages"), 0.2, 9).na.fill(-1, ["bg_id"])
