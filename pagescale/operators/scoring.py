"""Classifier scores as tables: native scoring, user models, policy picks, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale.functions import numeric as N
from pagescale.session import materialise

MAX_CLASSES = 50_000  # of a block of a model, which is carried to each task whole


def vector_size(df: DataFrame, vec: str) -> int:
    """Length of the vectors (reads one row)."""
    row = df.select(F.size(vec).alias("n")).first()
    return row["n"] if row else 0


def centroids(df: DataFrame, label: str, vec: str, dims: int | None = None) -> DataFrame:
    """Mean vector per label (class, centroid). One average per component: a plain
    partial aggregation, no vector is exploded."""
    dims = vector_size(df, vec) if dims is None else dims
    mean = F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(dims)])
    return df.groupBy(F.col(label).alias("class")).agg(mean.alias("centroid"))


def model_blocks(cents: DataFrame) -> list[Column]:
    """The centroids as array values (scalar sub-queries) of about MAX_CLASSES classes at most, by hash of the class, so a
    task holds one block at a time whatever the size of the model."""
    blocks = max(1, -(-cents.count() // (MAX_CLASSES * 4 // 5)))
    own = lambda b: cents if blocks == 1 else cents.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == b)
    return [own(b).agg(F.sort_array(F.collect_list(F.struct("class", "centroid"))).alias("m")).scalar() for b in range(blocks)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def linear_scores(df: DataFrame, cents: DataFrame, ident: str, vec: str) -> DataFrame:
    """Dot product of each vector with each centroid: (ident, class, score), 6 places.
    The model enters as scalar values, block by block, so the samples are not shuffled."""
    sc = F.transform("_m", lambda c: F.struct(c["class"].cast("string").alias("class"), F.round(dot(F.col(vec), c["centroid"]), 6).alias("score")))
    out = None
    for m in model_blocks(cents):
        part = df.select(ident, vec, m.alias("_m")).select(ident, F.inline(sc))
        out = part if out is None else out.unionByName(part)
    return out


def score_batches(df: DataFrame, predict: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run a user model over Arrow batches; ``predict`` loads it once per task."""
    return df.mapInPandas(predict, schema)


def assign_clusters(points: DataFrame, cents: DataFrame, ident: list[str], vec: str) -> DataFrame:
    """Nearest centroid and its distance; the lower class wins a tie. Blocks of a large model are gone
    through one after the other, each row keeping the best so far."""
    best = F.array_min(F.transform("_m", lambda c: F.struct(N.dist(F.col(vec), c["centroid"]).alias("d"), c["class"].alias("class"))))
    blocks = model_blocks(cents)
    cols = list(dict.fromkeys([*ident, vec]))
    cur = points.select(cols)
    for i, m in enumerate(blocks):
        own = best if not i else F.least("_b", best)
        cur = cur.select(*cur.columns, m.alias("_m")).select(*cols, own.alias("_b"))
        if i + 1 < len(blocks):
            cur = materialise(cur)
    return cur.select(*ident, F.col("_b.class").alias("class"), F.col("_b.d").alias("d"))


def color_clusters(points: DataFrame, vec: str, threshold: float, k: int = 4, seed: int = 7) -> DataFrame:
    """Centroids (class, centroid) of colour points: k-means with k-means|| seeds; k
    doubles while a cluster is wider than 0.75 * threshold, at most to the number of colours. Spark ML does the work;
    only the centres (k of them) come back to the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = points.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(vec).alias("_v"))
    spark: SparkSession = points.sparkSession
    different = points.select(vec).distinct().count()
    while True:
        model = KMeans(k=k, seed=seed, maxIter=20).fit(feats)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        cents = spark.createDataFrame(rows, "class int, centroid array<double>")
        widest = assign_clusters(feats, cents, [], "_v").agg(F.max("d")).first()[0]
        if widest is None or widest <= 0.75 * threshold:
            return cents
        if k >= different:  # every colour is its own cluster
            return points.select(F.col(vec).alias("centroid")).distinct().select(F.xxhash64("centroid").alias("class"), F.col("centroid").cast("array<double>").alias("centroid"))
        k = min(2 * k, different)


def quantize(points: DataFrame, cents: DataFrame, ident: list[str], vec: str) -> DataFrame:
    """Each point with the centre of its cluster. Only distinct colours are assigned."""
    colours = points.select(vec).distinct()
    near = assign_clusters(colours, cents, [vec], vec).join(cents, "class") \
        .select(vec, "class", F.col("centroid").alias("color"))
    return points.join(near, vec).select(*ident, "class", "color")


# ---- type routing and policy picks ----------------------------------------

# Type by keyword in the path, later keyword wins, and by field configuration.
TYPE_KEYWORDS = [("number", 1), ("text", 2), ("kata", 3), ("kanji", 4)]
CONFIG_TYPES = {2: 3, 3: 4}


def route_types(df: DataFrame, path: str, config: DataFrame | None = None, on=None) -> DataFrame:
    """Adds ``type``: 1 number, 2 text, 3 kata, 4 kanji, else 0. ``config`` (on, cfg)
    of a field turns type 2 into kata (2) or kanji (3)."""
    t = F.lit(0)
    for word, code in TYPE_KEYWORDS:
        t = F.when(F.col(path).contains(word), code).otherwise(t)
    df = df.withColumn("type", t)
    if config is None:
        return df
    out = df.join(config.select(*on, "cfg"), list(on), "left")
    routed = F.col("type")
    for cfg, code in CONFIG_TYPES.items():
        routed = F.when((F.col("type") == 2) & (F.col("cfg") == cfg), code).otherwise(routed)
    return out.withColumn("type", routed).drop("cfg")


def pick_by_policy(cands: DataFrame, keys: list[str], kata: DataFrame, small_side: int = 50) -> DataFrame:
    """One answer per sample from ranked candidates (keys, type, model, cls, prob, side).

    type 0: best of model ``mix``. 1: first of the mix that is a digit or one of -(); a
    digit hands over to the best of ``number``. 2: first of the mix that is no digit, no
    '-', and outside the kata vocabulary. 3: small image with ' or 0 / o among the two
    best -> the voicing marks, else the best of ``kata``. 4: best of ``kanji``.
    Everything is one conditional aggregation, folded before its shuffle.
    """
    c = cands.join(kata.select(F.col("ch").alias("cls")).distinct().withColumn("_kata", F.lit(True)), "cls", "left")
    key = F.struct((-F.col("prob")).alias("np"), F.col("cls").alias("c"))
    mix = F.col("model") == "mix"

    def first(cond):
        return F.min(F.when(cond, key))["c"]

    is_digit, is_mark = F.col("cls").rlike("^[0-9]$"), F.col("cls").isin("-", "(", ")")
    got = c.groupBy(*keys).agg(
        F.max("type").alias("type"), F.max("side").alias("_side"),
        first(mix).alias("_mix"), first(F.col("model") == "number").alias("_number"),
        first(F.col("model") == "kata").alias("_katabest"), first(F.col("model") == "kanji").alias("_kanji"),
        first(mix & (is_digit | is_mark)).alias("_num"),
        first(mix & ~is_digit & (F.col("cls") != "-") & F.col("_kata").isNull()).alias("_text"),
        F.min(F.when(mix, key)).alias("_k1"),
        F.min(F.when(mix & F.col("cls").isin("'", "0", "o"), key)).alias("_mark"))
    # the second best of the mix: the best one is left out in a second fold
    second = c.where(mix).join(got.select(*keys, F.col("_k1.c").alias("_c1")), keys).where(F.col("cls") != F.col("_c1")) \
        .groupBy(*keys).agg(F.min(key).alias("_k2"))
    j = got.join(second, keys, "left")
    in_two = (F.col("_side") < small_side) & (F.col("_mark") <= F.coalesce("_k2", "_k1"))
    mark = F.when(in_two, F.when(F.col("_mark.c") == "'", "゙").otherwise("゚"))
    num = F.when(F.col("_num").isin("-", "(", ")"), F.col("_num")).otherwise(F.col("_number"))
    pick = (F.when(F.col("type") == 1, F.coalesce(num, F.col("_mix"))).when(F.col("type") == 2, F.coalesce("_text", "_mix"))
            .when(F.col("type") == 3, F.coalesce(mark, F.col("_katabest"), F.col("_mix"))).when(F.col("type") == 4, F.coalesce("_kanji", "_mix"))
            .otherwise(F.col("_mix")))
    return j.select(*keys, "type", pick.alias("answer"))
