"""Recognition quality: joins of prediction and truth, accuracies, confusions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale.functions import text as T


def edits(a: str, b: str) -> Column:
    """Edit distance; equal strings are not compared further."""
    return F.when(F.col(a) == F.col(b), 0).otherwise(F.levenshtein(a, b))


def abs_acc(pred: str, truth: str) -> Column:
    return F.when(F.col(pred) == F.col(truth), 1.0).otherwise(0.0)


def set_acc(pred: str, truth: str) -> Column:
    """Distinct shared characters over distinct true ones; NULL for an empty truth."""
    p, t = (F.array_distinct(F.filter(F.split(F.col(c), ""), lambda x: x != "")) for c in (pred, truth))
    return F.try_divide(F.size(F.array_intersect(p, t)).cast("double"), F.nullif(F.size(t), F.lit(0)))


def nedit(pred: str, truth: str) -> Column:
    """Edit distance over the longer length; NULL when both are empty."""
    return F.try_divide(edits(pred, truth).cast("double"), F.nullif(F.greatest(F.length(pred), F.length(truth)), F.lit(0)))


def score_join(pred: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Predictions beside their truth with an exact-match flag. A truth of 'X' marks an
    unusable sample, '-' a skipped one: both are dropped before the join."""
    truth = truth.where(~F.col("truth").isin("X", "-"))
    return pred.join(truth, on).withColumn("correct", F.col("pred") == F.col("truth"))


def chist(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Counting histogram with its order: count desc, item desc (``rk`` from 1)."""
    return df.groupBy(*keys, col).agg(F.count("*").alias("n"))


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean exact, set and normalised edit accuracy plus the corpus character error
    rate (edits / true characters, and the mean of per-row e / max(1, n)) per key."""
    e = df.withColumn("_e", edits("pred", "truth")).withColumn("_n", F.length("truth"))
    return e.groupBy(*keys).agg(
        F.count("*").alias("total"), F.sum(F.when(F.col("pred") == F.col("truth"), 1).otherwise(0)).alias("right"),
        F.avg(abs_acc("pred", "truth")).alias("abs_acc"), F.avg(set_acc("pred", "truth")).alias("set_acc"),
        F.avg(F.try_divide(F.col("_e").cast("double"), F.nullif(F.greatest(F.length("pred"), F.col("_n")), F.lit(0)))).alias("nedit"),
        F.sum("_e").alias("edits"), F.try_divide(F.sum("_e").cast("double"), F.sum("_n")).alias("cer"),
        F.avg(F.col("_e") / F.greatest(F.lit(1), F.col("_n"))).alias("mean_err"))


def accuracy_rollup(df: DataFrame, *keys: str) -> DataFrame:
    """Right and total rows per folder level and overall; ``level`` is the number of keys set."""
    got = df.rollup(*keys).agg(F.sum(F.when(F.col("pred") == F.col("truth"), 1).otherwise(0)).alias("right"), F.count("*").alias("total"),
                               F.sum(edits("pred", "truth")).alias("edits"), F.grouping_id().alias("_g"))
    level = F.lit(len(keys)) - F.bit_count("_g")
    return got.select(*[F.coalesce(F.col(k), F.lit("all")).alias(k) for k in keys], level.cast("bigint").alias("level"), "right", "total", "edits",
                      (F.col("right") / F.col("total")).alias("accuracy"))


def field_accuracy(marks: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows, T rows (any case) and percentage per field; every listed field appears.
    Blank marks are no rows, and fields are matched by id."""
    m = F.upper(F.trim("mark"))
    seen = marks.where(m != "").groupBy("form", "field_id").agg(F.count("*").alias("n"), F.count_if(m == "T").alias("ok"))
    full = fields.join(seen, ["form", "field_id"], "left").na.fill(0, ["n", "ok"])
    return full.withColumn("pct", F.when(F.col("n") == 0, 0.0).otherwise(F.lit(100.0) * F.col("ok") / F.nullif(F.col("n"), F.lit(0))))


def classification_report(df: DataFrame, real: str = "real", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1, support per class, then macro and weighted means.
    The confusion counts fold first; all the rest works on classes squared rows at most."""
    pairs = df.groupBy(F.col(real).alias("r"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("r").alias("class"), F.col("n").alias("real"), F.lit(0).alias("pred"), F.when(F.col("r") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).alias("real"), F.col("n").alias("pred"), F.lit(0).alias("hit")))))
    c = sides.groupBy("class").agg(F.sum("real").alias("support"), F.sum("pred").alias("_p"), F.sum("hit").alias("_h"))
    prec = F.when(F.col("_p") == 0, 0.0).otherwise(F.try_divide(F.col("_h").cast("double"), F.col("_p")))
    rec = F.when(F.col("support") == 0, 0.0).otherwise(F.try_divide(F.col("_h").cast("double"), F.col("support")))
    c = c.select("class", prec.alias("precision"), rec.alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))), F.lit(0.0))
    c = c.withColumn("f1", f1)
    cols = ["precision", "recall", "f1"]
    macro = c.agg(*[F.avg(x).alias(x) for x in cols], F.sum("support").alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = c.agg(*[F.try_divide(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(x) for x in cols], F.sum("support").alias("support")) \
        .withColumn("class", F.lit("weighted avg"))
    return c.unionByName(macro).unionByName(weighted)


def field_types(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Kinds of content a field has, from keywords in its paths, as one sorted string."""
    low = F.lower(F.col(path))
    # Keywords of each kind.
    kinds = {"NUMBER": low.contains("number"), "TEXT": low.contains("text"), "CHECKBOX": low.rlike("checkbox|origin")}
    got = df.groupBy(*keys).agg(*[F.max(c).alias(n) for n, c in kinds.items()])
    return got.select(*keys, F.array_join(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in sorted(kinds)])), ",").alias("kinds"))


def confusions(df: DataFrame, context: int = 1, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Counts of differing contexts (got, want). Pairs of equal length are compared place
    by place, neighbouring differences closer than the context window form one region
    grown by ``context``; other pairs give the middle left between common prefix and
    suffix. Equal pairs are folded to one row with a count before any comparison; then all is
    inside the row, and one sum folds the contexts."""
    p, t = F.col(pred), F.col(truth)
    d = df.where(p != t).groupBy(p.alias("p"), t.alias("t")).agg(F.count("*").alias("n"))
    p, t = F.col("p"), F.col("t")
    d = d.select("p", "t", F.col("n").alias("times"), T.common_prefix_len(p, t).alias("pre"),
                                (F.length(p) == F.length(t)).alias("same"))
    n = F.least(F.length("p"), F.length("t")) - F.col("pre")
    rest = T.common_suffix_len(F.substring("p", F.col("pre") + 1, F.length("p")), F.substring("t", F.col("pre") + 1, F.length("t")))
    d = d.withColumn("suf", F.least(rest, n))
    pad = " " * context

    # equal length: blank out characters whose window holds no difference, split at the blanks
    def masked(side):
        a, b = F.split(F.col("p"), ""), F.split(F.col("t"), "")
        edge = F.array_repeat(F.lit(False), 2 * context)
        ring = F.concat(edge, F.zip_with(a, b, lambda x, y: x != y), edge)
        own = F.split(F.concat(F.lit(pad), F.col(side), F.lit(pad)), "")
        keep = F.transform(own, lambda c, i: F.when(F.exists(F.slice(ring, i + 1, F.lit(2 * context + 1)), lambda x: x), c).otherwise("\x00"))
        return F.filter(F.split(F.array_join(keep, ""), "\x00+"), lambda s: s != "")

    even = F.arrays_zip(masked("p").alias("got"), masked("t").alias("want"))
    mid = F.array(F.struct(*[F.substring(s, F.col("pre") + 1, F.length(s) - F.col("pre") - F.col("suf")).alias(nm) for s, nm in (("p", "got"), ("t", "want"))]))
    pairs = F.explode(F.when(F.col("same"), even).otherwise(mid)).alias("c")
    return d.select("times", pairs).groupBy("c.got", "c.want").agg(F.sum("times").alias("n"))


def wrong_cases(cands: DataFrame, k: int = 3) -> DataFrame:
    """Samples whose best class is not the real one, with the k best classes in order.
    Input (vec_id, real, class, score). The best k fold as an array of k per sample."""
    top = best_k(cands, ["vec_id", "real"], k)
    return top.where(F.col("top")[0] != F.col("real")).select("vec_id", "real", F.col("top")[0].alias("pred"), F.array_join("top", ",").alias("suggest"))


def best_k(cands: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best classes per sample (``top``: array), score desc then class. One sample
    holds one row per class of the model, so a group is the model's class count."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("class"))))
    return cands.groupBy(*keys).agg(F.transform(F.slice(ranked, 1, k), lambda s: s["class"]).alias("top"))


def confusion_matrix(df: DataFrame, classes: list[str], real: str = "real", pred: str = "pred") -> DataFrame:
    """real x predicted counts, one column per class of the given vocabulary."""
    return df.groupBy(real).pivot(pred, classes).count().na.fill(0)


def accuracy_merged(df: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Right rows when a multi-character answer may stand for any of its characters;
    rows with a true label of two or more characters are skipped."""
    d = df.where(F.length(truth) <= 1)
    ok = (F.col(pred) == F.col(truth)) | ((F.length(pred) > 1) & F.contains(F.col(pred), F.col(truth)))
    return d.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(ok).alias("right"))


def assemble_fields(hits: DataFrame, keys: list[str], line: str, order: str, txt: str, sep: str = "") -> DataFrame:
    """Answers of a field line in number order as one string, the lines of a field joined
    by newline. Form feeds and newlines inside answers are removed first. A group is one
    result value, so it is gathered; everything before it folds."""
    clean = hits.withColumn(txt, F.translate(txt, "\f\n", ""))
    per_line = clean.groupBy(*keys, line).agg(F.array_sort(F.collect_list(F.struct(order, txt))).alias("_l")) \
        .select(*keys, line, F.array_join(F.transform("_l", lambda s: s[txt]), sep).alias(txt))
    return per_line.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(line, txt))).alias("_l")) \
        .select(*keys, F.array_join(F.transform("_l", lambda s: s[txt]), "\n").alias(txt))


def attach_prob(hits: DataFrame, probs: DataFrame, on: list[str]) -> DataFrame:
    """Left join of a probability side table; '0' where there is none."""
    return hits.join(probs, on, "left").withColumn("prob", F.coalesce(F.col("prob").cast("string"), F.lit("0")))


def dataset_summary(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Samples, classes and wrong predictions (rows of real, pred)."""
    return cands.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_distinct("real").alias("classes"), F.count_if(F.col("real") != F.col("pred")).alias("wrong"))


def capped_wrong(wrong: DataFrame, per_class: int = 3, overall: int = 1000) -> DataFrame:
    """At most ``per_class`` wrong samples of a class and ``overall`` in all, lowest ids
    first. The class cap folds to arrays of that size before any shuffle."""
    from pagescale.operators.ranking import first_per_key
    kept = first_per_key(wrong, ["real"], [F.col("vec_id")], per_class)
    return kept.orderBy("real", "vec_id").limit(overall)


def by_text_report(hits: DataFrame) -> DataFrame:
    """Per character: answers and mean probability (the "by text" report)."""
    return hits.groupBy("form", "txt").agg(F.count("*").alias("n"), F.avg(F.col("prob").cast("double")).alias("prob"))
