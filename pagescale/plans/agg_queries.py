"""Registered queries: recognition quality, reports, label joins."""

from pyspark.sql import functions as F

from pagescale.operators import metrics as M
from pagescale.plans import views as V
from pagescale.plans.registry import query


@query("agg1_chist", """
    SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(line, '')) AS ch FROM lines) WHERE ch <> '' GROUP BY ALL
    ORDER BY n DESC, ch DESC""", "lines")
def _(spark, sf):
    c = V.lines(spark, sf).select("lang", F.explode(F.split("line", "")).alias("ch")).where("ch <> ''")
    return M.chist(c, ["lang"], "ch").orderBy(F.desc("n"), F.desc("ch"))


@query("agg2_abs_acc", "SELECT lang, source, count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0 END), 6) AS acc FROM line_pairs GROUP BY ALL", "line_pairs")
def _(spark, sf):
    return V.ocr_pairs(spark, sf, "lines").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg(M.abs_acc("pred", "truth")), 6).alias("acc"))


_SETS = """SELECT *, list_distinct(string_split(truth, '')) AS t, list_distinct(string_split(pred, '')) AS p FROM line_pairs"""


@query("agg3_set_acc", """
    SELECT lang, source, round(avg(CASE WHEN truth = '' THEN NULL ELSE len(list_filter(list_intersect(t, p), lambda x: x <> '')) / len(t) END), 6) AS acc
    FROM sets GROUP BY lang, source""", "line_pairs", sets=_SETS)
def _(spark, sf):
    return V.ocr_pairs(spark, sf, "lines").groupBy("lang", "source").agg(F.round(F.avg(M.set_acc("pred", "truth")), 6).alias("acc"))


@query("agg4_nedit", """
    SELECT lang, source, round(avg(levenshtein(truth, pred) / greatest(length(truth), length(pred))), 6) AS nedit FROM word_pairs GROUP BY ALL""", "word_pairs")
def _(spark, sf):
    return V.ocr_pairs(spark, sf).groupBy("lang", "source").agg(F.round(F.avg(M.nedit("pred", "truth")), 6).alias("nedit"))


@query("agg5_cer", """
    SELECT lang, source, count(*) AS total, count(*) FILTER (WHERE truth = pred) AS "right", sum(levenshtein(truth, pred))::BIGINT AS edits,
           round(sum(levenshtein(truth, pred)) / sum(length(truth)), 6) AS cer,
           round(avg(levenshtein(truth, pred) / greatest(1, length(truth))), 6) AS mean_err FROM word_pairs GROUP BY lang, source""", "word_pairs")
def _(spark, sf):
    s = M.summary(V.ocr_pairs(spark, sf), ["lang", "source"])
    return s.select("lang", "source", "total", "right", "edits", F.round("cer", 6).alias("cer"), F.round("mean_err", 6).alias("mean_err"))


@query("agg6_accuracy_rollup", """
    SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, 2 - (grouping(lang) + grouping(source))::BIGINT AS level,
           count(*) FILTER (WHERE truth = pred) AS "right", count(*) AS total, sum(levenshtein(truth, pred))::BIGINT AS edits,
           round(count(*) FILTER (WHERE truth = pred) / count(*), 6) AS accuracy
    FROM word_pairs GROUP BY ROLLUP (lang, source)""", "word_pairs")
def _(spark, sf):
    return M.accuracy_rollup(V.ocr_pairs(spark, sf), "lang", "source").withColumn("accuracy", F.round("accuracy", 6))


@query("agg7_field_accuracy", """
    SELECT f.form, f.field_id, count(mark) AS n, count(*) FILTER (WHERE mark = 'T') AS ok,
           round(CASE WHEN count(mark) = 0 THEN 0 ELSE 100.0 * count(*) FILTER (WHERE mark = 'T') / count(mark) END, 6) AS pct
    FROM (SELECT DISTINCT source AS form, unnest(range(0, 9)) AS field_id FROM documents) f LEFT JOIN marks m ON m.form = f.form AND m.field_id = f.field_id
    GROUP BY f.form, f.field_id""", "marks")
def _(spark, sf):
    forms = V.documents(spark, sf).select(F.col("source").alias("form")).distinct()
    fields = forms.select("form", F.explode(F.expr("sequence(0L, 8L)")).alias("field_id"))
    return M.field_accuracy(V.marks(spark, sf), fields).withColumn("pct", F.round("pct", 6))


_CONF = "SELECT real AS r, pred AS p, count(*) AS n FROM ranked GROUP BY ALL"
_PER = """SELECT class, coalesce(h, 0) / nullif(p, 0) AS prec, coalesce(h, 0) / nullif(s, 0) AS rec, s FROM
    (SELECT class, sum(CASE WHEN r = class THEN n ELSE 0 END) AS s, sum(CASE WHEN p = class THEN n ELSE 0 END) AS p,
            sum(CASE WHEN r = class AND p = class THEN n ELSE 0 END) AS h
     FROM conf JOIN (SELECT r AS class FROM conf UNION SELECT p FROM conf) c ON r = class OR p = class GROUP BY class)"""
_FULL = """SELECT class, coalesce(prec, 0) AS precision, coalesce(rec, 0) AS recall, s::BIGINT AS support,
    coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1 FROM per"""


@query("agg8_classification_report", """
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, support, round(f1, 6) AS f1 FROM (
      SELECT class, precision, recall, support, f1 FROM rep
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), sum(support)::BIGINT, avg(f1) FROM rep
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(support)::BIGINT,
                       sum(f1 * support) / sum(support) FROM rep)""", "ranked", conf=_CONF, per=_PER, rep=_FULL)
def _(spark, sf):
    r = M.classification_report(V.ranked(spark, sf))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("agg9_assemble_fields", """
    SELECT doc_id, string_agg(t, chr(10) ORDER BY y) AS w FROM
      (SELECT doc_id, y, string_agg(replace(w, chr(12), ''), ' ' ORDER BY k) AS t FROM words GROUP BY doc_id, y) GROUP BY doc_id""", "words")
def _(spark, sf):
    return M.assemble_fields(V.words(spark, sf), ["doc_id"], "y", "k", "w", " ")


@query("agg10_field_types", """
    SELECT form, field, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM (
      SELECT regexp_extract(path, '/(form[0-9]+)/', 1) AS form, regexp_extract(path, '/(field_[0-9]+)/', 1) AS field,
             unnest([CASE WHEN contains(path, 'number') THEN 'NUMBER' END, CASE WHEN contains(path, 'text') THEN 'TEXT' END, '']) AS kind FROM paths)
    WHERE kind <> '' GROUP BY ALL
    UNION ALL SELECT form, field, '' FROM (SELECT regexp_extract(path, '/(form[0-9]+)/', 1) AS form, regexp_extract(path, '/(field_[0-9]+)/', 1) AS field,
        bool_or(contains(path, 'number') OR contains(path, 'text')) AS hit FROM paths GROUP BY ALL) WHERE NOT hit""", "paths")
def _(spark, sf):
    p = V.paths(spark, sf).select(F.regexp_extract("path", "/(form[0-9]+)/", 1).alias("form"), F.regexp_extract("path", "/(field_[0-9]+)/", 1).alias("field"), "path")
    return M.field_types(p, ["form", "field"], "path")


_BAD = "SELECT row_number() OVER () AS rid, truth AS t, pred AS p FROM word_pairs WHERE truth <> pred"
_POS = """SELECT rid, t, p, i, CASE WHEN i BETWEEN 1 AND length(t) THEN substr(t, i, 1) ELSE ' ' END AS tc,
    CASE WHEN i BETWEEN 1 AND length(t) THEN substr(p, i, 1) ELSE ' ' END AS pc
    FROM (SELECT *, unnest(range(0, length(t) + 2)) AS i FROM bad WHERE length(t) = length(p))"""
_KEEP = """SELECT rid, i, tc, pc, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS g FROM
    (SELECT *, max(CASE WHEN tc <> pc THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hot FROM pos) WHERE hot = 1"""
_MID = """SELECT substr(p, pre + 1, length(p) - pre - suf) AS got, substr(t, pre + 1, length(t) - pre - suf) AS want FROM (
    SELECT *, coalesce((SELECT max(m) FROM range(1, least(length(t), length(p)) - pre + 1) r(m) WHERE right(t, m) = right(p, m)), 0) AS suf FROM (
      SELECT *, coalesce((SELECT max(m) FROM range(1, least(length(t), length(p)) + 1) r(m) WHERE left(t, m) = left(p, m)), 0) AS pre
      FROM bad WHERE length(t) <> length(p)))"""


@query("agg11_confusions", """
    SELECT got, want, count(*) AS n FROM (
      SELECT string_agg(pc, '' ORDER BY i) AS got, string_agg(tc, '' ORDER BY i) AS want FROM keep GROUP BY rid, g
      UNION ALL SELECT got, want FROM mid) GROUP BY ALL""", "word_pairs", bad=_BAD, pos=_POS, keep=_KEEP, mid=_MID)
def _(spark, sf):
    return M.confusions(V.ocr_pairs(spark, sf), 1)


@query("agg12_confusion_matrix", "SELECT real, " + ", ".join(f"count(*) FILTER (WHERE pred = '{i}') AS \"{i}\"" for i in range(10)) + " FROM ranked GROUP BY real", "ranked")
def _(spark, sf):
    return M.confusion_matrix(V.ranked(spark, sf), [str(i) for i in range(10)])


_TOP3 = """SELECT vec_id, label::VARCHAR AS real, string_agg(class, ',' ORDER BY score DESC, class) AS suggest, max_by(class, -rk) AS pred FROM
    (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS rk FROM candidates) WHERE rk <= 3 GROUP BY vec_id, label"""


def _cands(spark, sf):
    return V.candidates(spark, sf).select("vec_id", F.col("label").cast("string").alias("real"), "class", "score")


@query("agg12_wrong_cases", "SELECT vec_id, real, pred, suggest FROM top3 WHERE pred <> real", "candidates", top3=_TOP3)
def _(spark, sf):
    return M.wrong_cases(_cands(spark, sf), 3)


@query("agg13_accuracy_merged", """
    SELECT lang, count(*) AS total, count(*) FILTER (WHERE p = t OR (length(p) > 1 AND contains(p, t))) AS "right"
    FROM (SELECT lang, left(truth, 1) AS t, pred AS p FROM word_pairs) GROUP BY lang""", "word_pairs")
def _(spark, sf):
    """The first character of each word against the whole predicted word."""
    p = V.ocr_pairs(spark, sf).withColumn("truth", F.left("truth", F.lit(1)))
    return M.accuracy_merged(p, ["lang"])


@query("agg23_dataset_summary", "SELECT count(*) AS samples, count(DISTINCT real) AS classes, count(*) FILTER (WHERE real <> pred) AS wrong FROM ranked", "ranked")
def _(spark, sf):
    return M.dataset_summary(V.ranked(spark, sf), [])


# ---- label joins ----------------------------------------------------------

@query("join1_score_join", """
    SELECT doc_id, y, k, pred, truth, pred = truth AS correct FROM word_pairs WHERE truth NOT IN ('X', '-')""", "word_pairs")
def _(spark, sf):
    p = V.ocr_pairs(spark, sf)
    on = ["doc_id", "y", "k"]
    return M.score_join(p.select(*on, "pred"), p.select(*on, "truth"), on)


@query("join3_attach_prob", """
    SELECT h.c_custkey, h.form, h.txt, coalesce(p.cents::VARCHAR, '0') AS prob
    FROM char_hits h LEFT JOIN (SELECT c_custkey, cents FROM char_hits WHERE cents > 0) p USING (c_custkey)""", "char_hits")
def _(spark, sf):
    h = V.char_hits(spark, sf)
    return M.attach_prob(h.select("c_custkey", "form", "txt"), h.where("cents > 0").select("c_custkey", F.col("cents").alias("prob")), ["c_custkey"])


@query("snk3_field_report", """
    SELECT form, txt, count(*) AS n, round(avg(CASE WHEN cents > 0 THEN cents ELSE 0 END), 6) AS prob FROM char_hits GROUP BY form, txt""", "char_hits")
def _(spark, sf):
    h = V.char_hits(spark, sf)
    hits = M.attach_prob(h.select("c_custkey", "form", "txt"), h.where("cents > 0").select("c_custkey", F.col("cents").alias("prob")), ["c_custkey"])
    return M.by_text_report(hits).withColumn("prob", F.round("prob", 6))
