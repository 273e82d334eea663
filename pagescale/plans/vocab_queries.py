"""Registered queries: vocabularies, datasets, scores, quality rules."""

from pyspark.sql import functions as F

from pagescale.functions import text as T
from pagescale.operators import quality as Q
from pagescale.operators import scoring as S
from pagescale.operators import vocab as O
from pagescale.plans import views as V
from pagescale.plans.registry import query
from pagescale.plans.text_queries import NORM

_VOCAB = "SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS label FROM (SELECT DISTINCT unnest(string_split(line, '')) AS ch FROM lines) WHERE ch <> ''"


def chars(spark, sf):
    return V.lines(spark, sf).select("doc_id", "y", "lang", F.posexplode(F.split("line", "")).alias("x", "ch")).where("ch <> ''")


def vocab(spark, sf):
    return O.build_vocab(chars(spark, sf))


@query("set5_build_vocab", "SELECT ch, label FROM vocab", "lines", vocab=_VOCAB)
def _(spark, sf):
    return vocab(spark, sf)


@query("set5_build_vocab_first_seen", """
    SELECT ch, row_number() OVER (ORDER BY min((doc_id * 100000 + y) * 100000 + x)) AS label FROM
      (SELECT doc_id, y, unnest(string_split(line, '')) AS ch, generate_subscripts(string_split(line, ''), 1) AS x FROM lines) WHERE ch <> '' GROUP BY ch""", "lines")
def _(spark, sf):
    """Numbered by first place, label 0 left for padding."""
    return O.build_vocab(chars(spark, sf), first=["doc_id", "y", "x"], pad=True)


@query("join2_map_labels", """
    SELECT lang, coalesce(v.label, -1) AS label, count(*) AS n FROM (SELECT lang, unnest(string_split(line, '')) AS ch FROM lines) c
    LEFT JOIN vv v USING (ch) WHERE ch <> '' GROUP BY ALL""", "lines", vocab=_VOCAB, vv="SELECT * FROM vocab WHERE ch BETWEEN 'a' AND 'z'")
def _(spark, sf):
    v = vocab(spark, sf).where("ch between 'a' and 'z'")
    counts = chars(spark, sf).groupBy("lang", "ch").agg(F.count("*").alias("n"))
    return O.map_labels(counts, v, "ch", "label", -1).groupBy("lang", "label").agg(F.sum("n").alias("n"))


_FIRST = """SELECT ch, min(row(doc_id, y, x)) AS pos FROM (SELECT doc_id, y, lang, unnest(string_split(line, '')) AS ch,
    generate_subscripts(string_split(line, ''), 1) - 1 AS x FROM lines) WHERE ch <> '' AND lang {0} 'en' GROUP BY ch"""


def _firsts(spark, sf, english):
    c = chars(spark, sf).where(F.col("lang") == "en" if english else F.col("lang") != "en")
    return c.groupBy("ch").agg(F.min(F.struct("doc_id", "y", "x")).alias("pos"))


@query("set1_merge_vocab", """
    SELECT ch, label FROM base UNION ALL SELECT ch, row_number() OVER (ORDER BY pos, ch) - 1 + (SELECT max(label) + 1 FROM base) FROM b WHERE ch NOT IN (SELECT ch FROM base)""",
       "lines", a=_FIRST.format("="), b=_FIRST.format("<>"), base="SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS label FROM a")
def _(spark, sf):
    base = O.build_vocab(_firsts(spark, sf, True))
    return O.merge_vocab(base, _firsts(spark, sf, False))


@query("set1_union_datasets", """
    SELECT doc_id, split, ch, label FROM (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split, substr(text, 1, 1) AS ch FROM documents) JOIN
    (SELECT ch, label FROM base UNION ALL SELECT ch, row_number() OVER (ORDER BY pos, ch) - 1 + (SELECT max(label) + 1 FROM base) FROM b WHERE ch NOT IN (SELECT ch FROM base)) USING (ch)""",
       "lines", a=_FIRST.format("="), b=_FIRST.format("<>"), base="SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS label FROM a")
def _(spark, sf):
    v = O.merge_vocab(O.build_vocab(_firsts(spark, sf, True)), _firsts(spark, sf, False))
    d = V.documents(spark, sf).select("doc_id", "lang", F.left("text", F.lit(1)).alias("ch"))
    a = d.where("lang = 'en'").select("doc_id", "ch", F.lit("train").alias("split"))
    b = d.where("lang <> 'en'").select("doc_id", "ch", F.lit("test").alias("split"))
    return O.union_datasets(a, b, v).select("doc_id", "split", "ch", "label")


@query("set2_union_domains", "SELECT doc_id, source, CASE WHEN lang = 'en' THEN 0 ELSE 1 END::BIGINT AS domain FROM documents")
def _(spark, sf):
    d = V.documents(spark, sf)
    return O.union_domains([d.where("lang = 'en'").select("doc_id", "source"), d.where("lang <> 'en'").select("doc_id", "source")])


@query("set3_union_offset", """
    SELECT 'e' AS origin, vec_id AS id, label::BIGINT AS label FROM embeddings
    UNION ALL SELECT 'd', doc_id, quality + (SELECT max(label) + 1 FROM embeddings) FROM labels""")
def _(spark, sf):
    a = V.table(spark, sf, "embeddings").select(F.lit("e").alias("origin"), F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"))
    b = V.table(spark, sf, "labels").select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("label"))
    return O.union_offset(a, b)


@query("set4_split_by_label", """
    SELECT vec_id, part, label::BIGINT AS label, new_label FROM (SELECT vec_id, label, CASE WHEN label < 4 THEN 0 ELSE 1 END::BIGINT AS part FROM embeddings) JOIN
    (SELECT label, row_number() OVER (PARTITION BY label >= 4 ORDER BY min(vec_id)) - 1 AS new_label FROM embeddings GROUP BY label) USING (label)""")
def _(spark, sf):
    return O.split_by_label(V.table(spark, sf, "embeddings").select("vec_id", "label"), 4, ["vec_id"]).select("vec_id", "part", "label", "new_label")


_ENC = "SELECT doc_id, y, generate_subscripts(string_split(line, ''), 1) - 1 AS pos, unnest(string_split(line, '')) AS ch FROM lines WHERE line <> ''"
_KNOWN = "SELECT * FROM vocab WHERE ch <> 'q'"


@query("set6_encode_text", "SELECT doc_id, y, string_agg(coalesce(label, -1)::VARCHAR, ' ' ORDER BY pos) AS labels FROM enc LEFT JOIN known USING (ch) GROUP BY doc_id, y",
       "lines", vocab=_VOCAB, known=_KNOWN, enc=_ENC)
def _(spark, sf):
    e = O.encode_text(V.lines(spark, sf).where("line <> ''").select("doc_id", "y", "line"), "line", vocab(spark, sf).where("ch <> 'q'"), -1)
    return e.select("doc_id", "y", F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"))


@query("set6_decode_text", "SELECT doc_id, y, replace(line, 'q', '~') AS text FROM lines", "lines")
def _(spark, sf):
    v = vocab(spark, sf).where("ch <> 'q'")
    e = O.encode_text(V.lines(spark, sf).select("doc_id", "y", "line"), "line", v, -1)
    return O.decode_text(e, "labels", v).select("doc_id", "y", "text")


@query("set7_to_coo", "SELECT doc_id, y, count(*) AS n, sum(pos * label)::BIGINT AS s FROM enc JOIN vocab USING (ch) GROUP BY doc_id, y", "lines", vocab=_VOCAB, enc=_ENC)
def _(spark, sf):
    """Long form of every line's labels, summed up per line."""
    e = O.encode_text(V.lines(spark, sf).select("doc_id", "y", "line"), "line", vocab(spark, sf), -1)
    return O.to_coo(e, ["doc_id", "y"], "labels").groupBy("doc_id", "y").agg(F.count("*").alias("n"), F.sum(F.col("pos") * F.col("label")).alias("s"))


@query("set7_from_coo", "SELECT doc_id, y, string_agg(label::VARCHAR, ' ' ORDER BY pos) AS labels FROM enc JOIN vocab USING (ch) GROUP BY doc_id, y", "lines", vocab=_VOCAB, enc=_ENC)
def _(spark, sf):
    e = O.encode_text(V.lines(spark, sf).select("doc_id", "y", "line"), "line", vocab(spark, sf), -1)
    back = O.from_coo(O.to_coo(e, ["doc_id", "y"], "labels"), ["doc_id", "y"])
    return back.select("doc_id", "y", F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"))


@query("set7_coo_shape", "SELECT count(*) AS n, max(length(line)) AS width FROM lines", "lines")
def _(spark, sf):
    return O.coo_shape(O.encode_text(V.lines(spark, sf).select("line"), "line", vocab(spark, sf), -1), "labels")


@query("set8_pad_batches", """
    SELECT doc_id, y, batch, max(length(line)) OVER (PARTITION BY batch) AS width, 32 - count(*) OVER (PARTITION BY batch) AS short, length(line) AS used
    FROM (SELECT *, (row_number() OVER (ORDER BY doc_id, y) - 1) // 32 AS batch FROM lines)""", "lines")
def _(spark, sf):
    d = V.lines(spark, sf).select("doc_id", "y", F.transform(F.filter(F.split("line", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint")).alias("a"))
    p = O.pad_batches(d, ["doc_id", "y"], "a", 32)
    return p.select("doc_id", "y", "batch", F.size("a").alias("width"), "short", F.size(F.filter("a", lambda c: c > 0)).alias("used"))


@query("set9_invert_vocab", "SELECT label // 2 AS label, min(ch) AS ch, count(*) AS n FROM vocab GROUP BY label // 2", "lines", vocab=_VOCAB)
def _(spark, sf):
    """Two characters share each label here."""
    return O.invert_vocab(vocab(spark, sf).withColumn("label", F.floor(F.col("label") / 2)))


@query("set10_assemble_scripts", """
    SELECT vec_id, label::BIGINT AS label, CASE WHEN label >= 7 THEN 'katakana' WHEN label < 3 THEN 'hiragana' ELSE 'kanji' END AS script FROM embeddings""")
def _(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", "label")
    return O.assemble_scripts(e.where("label < 7"), e.where("label >= 7"), "all", 3)


@query("udf3_text_codec", "SELECT doc_id, y, translate(" + NORM.format("line") + ", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM lines", "lines")
def _(spark, sf):
    """A recogniser codec with its own normaliser: clean up, then fold A-Z."""
    def norm(c):
        return F.translate(T.normalize_text(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = V.lines(spark, sf).select("doc_id", "y", "line")
    v = O.build_vocab(d.select(F.explode(F.split(norm("line"), "")).alias("ch")).where("ch <> ''"))
    codec = O.TextCodec(v, norm, -1)
    return codec.decode(codec.encode(d, "line"), "labels").select("doc_id", "y", "text")


# ---- scores ---------------------------------------------------------------

_TYPE = """CASE WHEN contains(path, 'kanji') THEN 4 WHEN contains(path, 'kata') THEN 3 WHEN contains(path, 'text') THEN 2 WHEN contains(path, 'number') THEN 1 ELSE 0 END"""


@query("inf1_route_types", f"""
    SELECT doc_id, CASE WHEN t = 2 AND doc_id % 9 = 4 THEN 3 WHEN t = 2 AND doc_id % 9 = 7 THEN 4 ELSE t END::BIGINT AS type FROM (SELECT doc_id, {_TYPE} AS t FROM paths)""", "paths")
def _(spark, sf):
    p = V.paths(spark, sf).withColumn("field", F.col("doc_id") % 9)
    config = p.select("field").distinct().withColumn("cfg", F.when(F.col("field") == 4, 2).when(F.col("field") == 7, 3).otherwise(1))
    return S.route_types(p, "path", config, ["field"]).select("doc_id", "type")


# Candidates under four models: the class's character per model, the same scores with a different tie order.
_NAMES = {"mix": "0-7o'(ab2c", "number": "0123456789", "kata": "アイウエオカキクケコ", "kanji": "一二三四五六七八九十"}
_MODELS = ", ".join("('{}', '{}')".format(m, s.replace("'", "''")) for m, s in _NAMES.items())
_MC = f"""SELECT vec_id, vec_id % 5 AS type, (vec_id * 7) % 90 AS side, model, substr(names, class::INT + 1, 1) AS cls,
    CASE WHEN model = 'mix' THEN score ELSE round(score * (class::INT % 3 + 1), 6) END AS prob FROM candidates, (VALUES {_MODELS}) m(model, names)"""
_ORD = "SELECT *, row_number() OVER (PARTITION BY vec_id, model ORDER BY prob DESC, cls) AS rk FROM mc"
_PICK = """SELECT vec_id, any_value(type) AS type, any_value(side) AS side, max(cls) FILTER (WHERE model = 'mix' AND rk = 1) AS mix, max(cls) FILTER (WHERE model = 'number' AND rk = 1) AS num,
    max(cls) FILTER (WHERE model = 'kata' AND rk = 1) AS kata, max(cls) FILTER (WHERE model = 'kanji' AND rk = 1) AS kanji,
    min_by(cls, rk) FILTER (WHERE model = 'mix' AND (cls BETWEEN '0' AND '9' OR cls IN ('-', '(', ')'))) AS n1,
    min_by(cls, rk) FILTER (WHERE model = 'mix' AND NOT cls BETWEEN '0' AND '9' AND cls <> '-' AND cls <> 'c') AS t1,
    min_by(cls, rk) FILTER (WHERE model = 'mix' AND rk <= 2 AND cls IN ('''', '0', 'o')) AS d1 FROM ord GROUP BY vec_id"""


@query("inf2_pick_by_policy", """
    SELECT vec_id, type, CASE type WHEN 1 THEN CASE WHEN n1 IN ('-', '(', ')') THEN n1 ELSE num END WHEN 2 THEN t1
      WHEN 3 THEN CASE WHEN side < 50 AND d1 = '''' THEN chr(12441) WHEN side < 50 AND d1 IN ('0', 'o') THEN chr(12442) ELSE kata END WHEN 4 THEN kanji ELSE mix END AS answer FROM pick""",
       "candidates", mc=_MC, ord=_ORD, pick=_PICK)
def _(spark, sf):
    c = V.candidates(spark, sf)
    i = F.col("class").cast("int")
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.substring(F.lit(s), i + 1, F.lit(1)).alias("cls"),
                                          F.round(F.col("score") * (F.lit(1) if m == "mix" else i % 3 + 1), 6).alias("prob")) for m, s in _NAMES.items()]))
    mc = c.select("vec_id", (F.col("vec_id") % 5).alias("type"), (F.col("vec_id") * 7 % 90).alias("side"), models.alias("r")).select("vec_id", "type", "side", "r.*")
    kata = spark.createDataFrame([(ch,) for ch in _NAMES["kata"] + "c"], "ch string")
    return S.pick_by_policy(mc, ["vec_id"], kata)


@query("inf3_linear_scores", "SELECT vec_id, class, score FROM candidates", "candidates")
def _(spark, sf):
    return V.candidates(spark, sf).select("vec_id", "class", "score")


@query("inf3_score_batches", """
    SELECT vec_id, label::BIGINT AS label, round(sum(v), 4) AS total FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY vec_id, label""")
def _(spark, sf):
    """A user model over Arrow batches: here the sum of a vector."""
    def predict(batches):
        import numpy as np
        for pdf in batches:
            m = np.stack(pdf["embedding"].to_numpy()).astype("float64")
            yield pdf[["vec_id", "label"]].assign(total=m.sum(axis=1))
    e = V.spread(V.table(spark, sf, "embeddings"), "vec_id")
    return S.score_batches(e, predict, "vec_id bigint, label bigint, total double").withColumn("total", F.round("total", 4))


@query("inf4_assign_clusters", """
    SELECT vec_id, c::BIGINT AS class, d FROM (SELECT vec_id, c, round(d, 5) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS rk FROM
      (SELECT vec_id, c, sqrt(sum((v - m) * (v - m))) AS d FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
       JOIN means USING (i) GROUP BY vec_id, c)) WHERE rk = 1""", "means")
def _(spark, sf):
    e = V.spread(V.table(spark, sf, "embeddings"), "vec_id")
    return S.assign_clusters(e, S.centroids(e, "label", "embedding"), ["vec_id"], "embedding").withColumn("d", F.round("d", 5))


def color_points(spark, sf):
    rgb = F.array(*[(F.col(c) % 256).cast("double") for c in ("l_partkey", "l_suppkey", "l_orderkey")])
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rgb.alias("rgb"))


@query("inf5_color_clusters")
def _(spark, sf):
    c = S.color_clusters(color_points(spark, sf), "rgb", 150.0)
    return c.select("class", *[F.round(F.col("centroid")[i], 3).alias(n) for i, n in enumerate("rgb")])


_PAL = "(VALUES (0, 0, 0, 0), (1, 255, 255, 255), (2, 200, 40, 40), (3, 40, 200, 40), (4, 40, 40, 200)) p(c, r, g, b)"


@query("inf6_quantize", f"""
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, c::BIGINT AS class, r::DOUBLE AS r FROM (SELECT l_orderkey, l_linenumber, c, p.r, row_number() OVER (PARTITION BY rid
      ORDER BY (l_partkey % 256 - p.r) ** 2 + (l_suppkey % 256 - p.g) ** 2 + (l_orderkey % 256 - p.b) ** 2, c) AS rk FROM (SELECT *, row_number() OVER () AS rid FROM lineitem), {_PAL}) WHERE rk = 1""")
def _(spark, sf):
    """Colours of the order lines on a palette of five."""
    pal = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [255.0, 255.0, 255.0]), (2, [200.0, 40.0, 40.0]), (3, [40.0, 200.0, 40.0]), (4, [40.0, 40.0, 200.0])],
                                "class int, centroid array<double>")
    q = S.quantize(color_points(spark, sf), pal, ["l_orderkey", "l_linenumber"], "rgb")
    return q.select("l_orderkey", "l_linenumber", "class", F.col("color")[0].alias("r"))


# ---- quality rules --------------------------------------------------------

RULES = [Q.Rule("quantity", "l_quantity", Q.in_range(1, 45), "out of range"), Q.Rule("discount", "l_discount", Q.all_of(Q.non_negative(), Q.in_range(0, 0.09)), "bad discount"),
         Q.Rule("flag", "l_returnflag", Q.any_of(Q.one_of("N"), Q.one_of("R")), "unknown flag"), Q.Rule("line", "l_linenumber", Q.in_range(1, 6), "many lines", warning=True),
         Q.Rule("tax", "l_tax", Q.is_number(), "not a number")]


@query("dq1_check", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, rule, kind FROM (SELECT *, unnest([
      CASE WHEN NOT l_quantity BETWEEN 1 AND 45 THEN {'rule': 'quantity', 'kind': 'error'} END, CASE WHEN NOT l_discount BETWEEN 0 AND 0.09 THEN {'rule': 'discount', 'kind': 'error'} END,
      CASE WHEN l_returnflag NOT IN ('N', 'R') THEN {'rule': 'flag', 'kind': 'error'} END, CASE WHEN NOT l_linenumber BETWEEN 1 AND 6 THEN {'rule': 'line', 'kind': 'warning'} END], recursive := true)
      FROM lineitem) WHERE rule IS NOT NULL""")
def _(spark, sf):
    d = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_tax")
    return Q.check(d, RULES, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "rule", "kind")


@query("dq2_check_grid", """
    SELECT page, min(v) AS lo, max(v) AS hi, max(y) + 1 AS h, max(x) + 1 AS w, max(v) <= 255 AS byte_range, false AS "binary", median(v) > avg(v) AS light,
           max(y) + 1 >= 600 AND max(x) + 1 >= 600 AS page_size, max(y) + 1 > 8 AS line_height FROM (SELECT page, y, x, unicode(ch)::BIGINT AS v FROM cells) GROUP BY page""", "cells")
def _(spark, sf):
    """Character codes as grey values."""
    return Q.check_grid(V.cells(spark, sf).select("page", "y", "x", F.ascii("ch").cast("bigint").alias("v")), ["page"], "v")


@query("dq3_check_segmentation", """
    SELECT page, true AS black_background, count(*) FILTER (WHERE label <= 65535) AS no_column FROM
      (SELECT page, ((x // 20) << 16) | label % 65536 AS label FROM cells) GROUP BY page""", "cells")
def _(spark, sf):
    c = V.cells(spark, sf).select("page", F.shiftleft(F.floor(F.col("x") / 20), 16).bitwiseOR(F.col("label") % 65536).alias("label"))
    return Q.check_segmentation(c, ["page"])


@query("dq4_check_dataset", """
    SELECT count(*) AS n, min(len(embedding)) AS min_len, max(len(embedding)) AS max_len, round(min(list_min(embedding))::DOUBLE, 5) AS lo, round(max(list_max(embedding))::DOUBLE, 5) AS hi,
           count(*) BETWEEN 1 AND 1000000000 AND min(len(embedding)) = 64 AND max(len(embedding)) = 64 AND min(list_min(embedding)) >= -10 AND max(list_max(embedding)) <= 10 AS ok FROM embeddings""")
def _(spark, sf):
    e = V.table(spark, sf, "embeddings")
    d = Q.check_dataset(e, "embedding", rows=(1, 1_000_000_000), length=64, values=(-10, 10))
    return d.withColumns({"lo": F.round(F.col("lo").cast("double"), 5), "hi": F.round(F.col("hi").cast("double"), 5)})
