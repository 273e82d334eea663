"""The registered queries of the training-data operators, and their check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale.llm import bpe, clustering, embdedup, langid, licenses, mixing, quality, secrets, simhash, substring, topk, webtext, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_simhash")
def op1(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op7_secrets", secrets.check_sql())
def op7(spark, sf):
    found = secrets.scan_documents(table(spark, sf, "documents"))
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


@query("op10_byte_bpe")
def op10(spark, sf):
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(table(spark, sf, "documents"), file, public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


TOPK_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) k from s)
select query_id, cast(k as integer) "rank", vec_id, score from r where k <= 20"""


@query("op3_topk", TOPK_SQL)
def op3(spark, sf):
    return topk.top_k(topk.quantised(table(spark, sf, "embeddings")), F.col("id") % 20 == 0)


EMB_SQL = """with recursive u as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) n from l group by 1), c as (select a, min(b) c from r group by 1)
select vec_id, coalesce(n, 0) n_links, c component_id, vec_id = c kept from embeddings join c on c.a = vec_id left join n on n.a = vec_id"""


@query("op5_embedding_dedup", EMB_SQL)
def op5(spark, sf):
    return embdedup.link_duplicates(table(spark, sf, "embeddings"))


REPEATS_SQL = """with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
p as (select doc_id, unnest(range(1, len(w) - 18)) s, w from d where len(w) >= 20),
k as (select doc_id, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) h from p),
f as (select *, row_number() over (partition by h order by doc_id, s) > 1 again from k),
g as (select doc_id, list(distinct x) gone from (select doc_id, unnest(range(s, s + 20)) x from f where again) group by 1)
select d.doc_id, len(w) n_words, coalesce(len(gone), 0) n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: gone is null or not list_contains(gone, i)), lambda i: w[i]), ' '), '')) kept_sha256
from d left join g using (doc_id)"""


@query("op9_substring_dedup", REPEATS_SQL)
def op9(spark, sf):
    out = substring.drop_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_langid")
def op2(spark, sf):
    out = langid.identify(table(spark, sf, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def grades(spark, sf):
    """Graded ratings: 0 toxic, 1 poor, 2 good."""
    rated = table(spark, sf, "labels")
    return rated.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


@query("op4_quality")
def op4(spark, sf):
    out = quality.rate(table(spark, sf, "documents"), grades(spark, sf))
    tails = [F.coalesce(F.col(c), F.lit(0.0)) if c in out.columns else F.lit(0.0) for c in ("p_ge_1", "p_ge_2")]
    return out.select("doc_id", "expected_grade", tails[0].alias("p_ge_1"), tails[1].alias("p_ge_2"), (tails[0] >= 0.5).alias("kept"))


#: Target shares of the expected tokens of each domain.
DOMAINS = {"good": 0.83, "poor": 0.14, "toxic": 0.03}


def domains(spark, sf):
    rated = table(spark, sf, "labels")
    return rated.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good").alias("domain"))


@query("op6_mixing")
def op6(spark, sf):
    out, fit = mixing.mix(table(spark, sf, "documents"), domains(spark, sf), DOMAINS)
    p = [F.coalesce(F.get("posteriors", F.lit(fit.domains.index(d))), F.lit(0.0)).alias(f"p_{d}") if d in fit.domains else F.lit(0.0).alias(f"p_{d}") for d in DOMAINS]
    return out.select("doc_id", "tokens", *p, "rate")


@query("op8_licenses", licenses.check_sql())
def op8(spark, sf):
    return licenses.best_license(table(spark, sf, "documents"))


@query("op11_clustering", clustering.check_sql())
def op11(spark, sf):
    out, _ = clustering.cluster(table(spark, sf, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op12_whitening")
def op12(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op13_html_extraction", webtext.check_sql())
def op13(spark, sf):
    return webtext.main_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")
