"""Registered queries: sources and sinks over data derived from the tables, streams, user functions."""

from pyspark.sql import functions as F

from pagescale.operators import metrics as M
from pagescale.operators import ranking as R
from pagescale.plans import views as V
from pagescale.plans.layout_queries import TPL_SQL, TPL_WORDS, template_words
from pagescale.plans.registry import query
from pagescale.plans.text_queries import NORM
from pagescale.plans.vocab_queries import _VOCAB, vocab
from pagescale.session import scratch_dir
from pagescale.sources import readers as S
from pagescale.sources import sinks as W
from pagescale.sources.files import write_rows
from pagescale.streaming import monitor as ST


@query("src1_transcripts", "SELECT doc_id, " + NORM.format("text") + " AS text FROM documents")
def _(spark, sf):
    """Documents as transcripts: a newline added, then read."""
    d = V.documents(spark, sf).select("doc_id", F.concat("text", F.lit("\n")).alias("text"))
    return d.select("doc_id", S.clean_transcript("text").alias("text"))


@query("src2_corpus", "SELECT doc_id, y AS line_no, line AS text FROM lines", "lines")
def _(spark, sf):
    return S.corpus_lines(V.documents(spark, sf), ["doc_id"], "text")


@query("src2_corpus_files", "SELECT source, count(*) AS n, max(n) AS longest FROM (SELECT source, length(line) AS n FROM lines) GROUP BY source", "lines")
def _(spark, sf):
    """Lines written to one folder of text files per source and read back with line numbers."""
    out = scratch_dir(spark)
    V.lines(spark, sf).select("source", F.col("line").alias("value")).write.partitionBy("source").text(out)
    c = S.read_corpus(spark, out).withColumn("source", F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/source=([^/]*)/", 1))
    return c.groupBy("source").agg((F.count_distinct("path", "line_no")).alias("n"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query("src3_expand_inputs", "SELECT path FROM paths", "paths")
def _(spark, sf):
    """Paths written as two list files, expanded again."""
    out = scratch_dir(spark)
    p = V.paths(spark, sf).select("doc_id", F.col("path").alias("value"))
    for part in (0, 1):
        p.where(F.col("doc_id") % 2 == part).select("value").write.text(f"{out}/{part}")
    return S.expand_inputs(spark, [f"@{out}/0", f"@{out}/1"]).select("path")


@query("src4_filter_names", "SELECT doc_id, path FROM paths WHERE regexp_matches(path, '-[A-Za-z]+[.]png$')", "paths")
def _(spark, sf):
    return S.filter_names(V.paths(spark, sf), ["png"], r"-[A-Za-z]+\.png$", None).select("doc_id", "path")


@query("src5_recognition_path", """
    SELECT doc_id, 't' || (doc_id % 4 + 1) AS template, 'form' || doc_id % 7 AS form, 'field_' || (doc_id % 9 + 1) AS field, ['number', 'text', 'kata', 'kanji'][doc_id % 4 + 1] AS kind,
           doc_id % 3 + 1 AS line, CASE WHEN c = '-' THEN '' ELSE c END AS truth FROM (SELECT *, translate(substr(text, 1, 1), '/' || chr(10), '__') AS c FROM documents)""")
def _(spark, sf):
    return S.parse_recognition_path(V.paths(spark, sf)).select("doc_id", "template", "form", "field", "kind", "line", "truth")


@query("src6_pair_variants", """
    SELECT '/scan/' || doc_id AS base, '/scan/' || doc_id || '.bin.png' AS bin, CASE WHEN doc_id % 2 = 0 THEN '/scan/' || doc_id || '.gt.txt' END AS gt FROM documents
    WHERE doc_id % 2 = 0 UNION ALL SELECT '/scan/' || doc_id, '/scan/' || doc_id || '.bin.png', '' FROM documents WHERE doc_id % 2 = 1""")
def _(spark, sf):
    """An image for each document, a ground truth for every second one."""
    stem = F.concat(F.lit("/scan/"), "doc_id")
    p = V.documents(spark, sf).select(F.explode(F.array(F.concat(stem, F.lit(".bin.png")), F.when(F.col("doc_id") % 2 == 0, F.concat(stem, F.lit(".gt.txt"))))).alias("path")).where("path is not null")
    return S.pair_variants(p, ["bin", "gt"]).na.fill("", ["gt"])


@query("src7_fixed_records", """
    SELECT doc_id, i AS rec, ('0x' || substr(h, CAST(i * 128 + 5 AS BIGINT), 4))::BIGINT AS jis, lower(substr(h, CAST(i * 128 + 17 AS BIGINT), 96)) AS bitmap FROM
      (SELECT doc_id, hex(encode(text)) AS h, unnest(range(1, length(hex(encode(text))) // 128)) AS i FROM documents)""")
def _(spark, sf):
    """The bytes of each text as 64-byte records after a header record."""
    d = V.documents(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    r = S.parse_fixed_records(d, ["doc_id"], "content", (64, 1, 2, 2, 8, 48))
    return r.select("doc_id", "rec", "jis", F.lower(F.hex("bitmap")).alias("bitmap"))


@query("src7_read_fixed_records", """
    SELECT doc_id, i AS rec, ('0x' || substr(h, CAST(i * 128 + 5 AS BIGINT), 4))::BIGINT AS jis, lower(substr(h, CAST(i * 128 + 17 AS BIGINT), 96)) AS bitmap FROM
      (SELECT doc_id, hex(encode(text)) AS h, unnest(range(1, length(hex(encode(text))) // 128)) AS i FROM documents)""")
def _(spark, sf):
    """The bytes of each text written to a file of its own and read back as records, 256 KB a partition."""
    out = scratch_dir(spark)
    write_rows(V.documents(spark, sf).select("doc_id", "text"), out, "doc_id", "text", ".rec")
    r = S.read_fixed_records(spark, out, (64, 1, 2, 2, 8, 48), 2**18)
    return r.select(F.regexp_extract("path", r"/(\d+)\.rec$", 1).cast("bigint").alias("doc_id"), "rec", "jis", F.lower(F.hex("bitmap")).alias("bitmap"))


@query("src8_code_table", """
    SELECT doc_id, label, right(trim(string_split(trim(s), ' ')[-1]), 4) AS code FROM (SELECT doc_id, doc_id || ' ' || translate(text, chr(10), ' ') AS s, doc_id AS label FROM documents WHERE doc_id % 3 > 0)""")
def _(spark, sf):
    """Code lines from the texts; those of every third document have no number and fall out."""
    head = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")).otherwise("x")
    d = V.documents(spark, sf).select("doc_id", F.concat_ws(" ", head, F.translate("text", "\n", " ")).alias("s"))
    return S.parse_code_table(d, "s").select("doc_id", "label", "code")


@query("src9_vocab", "SELECT lang, ch, row_number() OVER (PARTITION BY lang ORDER BY ch) - 1 AS label FROM (SELECT DISTINCT lang, unnest(string_split(line, '')) AS ch FROM lines) WHERE ch <> ''", "lines")
def _(spark, sf):
    """A vocabulary per language as a JSON map, read back."""
    c = V.lines(spark, sf).select("lang", F.explode(F.split("line", "")).alias("ch")).where("ch <> ''").distinct()
    packed = c.groupBy("lang").agg(F.array_sort(F.collect_list("ch")).alias("_c"))
    j = packed.select("lang", F.to_json(F.map_from_arrays("_c", F.transform("_c", lambda x, i: i.cast("bigint")))).alias("json"))
    return S.parse_vocab(j, ["lang"], "json")


@query("src10_template", """
    SELECT doc_id, 'table' || doc_id % 3 AS tbl, 'key' || k AS key, s AS seq, doc_id % 5 + s AS bbox_index, 0.25::DOUBLE * k AS x0r, 0.25::DOUBLE * k + 0.25 AS x1r, 0.0::DOUBLE AS y0r, 0.5::DOUBLE AS y1r
    FROM documents, range(3) a(k), range(2) b(s)""")
def _(spark, sf):
    """A template per document, as JSON."""
    def box(k, s):
        return F.concat(F.lit('{"bbox_index": '), F.col("doc_id") % 5 + s, F.lit(f', "x_range": [{0.25 * k}, {0.25 * k + 0.25}], "y_range": [0.0, 0.5]}}'))
    keys = [F.concat(F.lit(f'"key{k}": ['), box(k, 0), F.lit(", "), box(k, 1), F.lit("]")) for k in range(3)]
    j = F.concat(F.lit('{"tables": {"table'), F.col("doc_id") % 3, F.lit('": {"keys": {'), F.concat_ws(", ", *keys), F.lit("}}}}"))
    return S.parse_template(V.documents(spark, sf).select("doc_id", j.alias("json")), ["doc_id"], "json")


@query("src11_one_hot", "SELECT vec_id, label::BIGINT AS label FROM embeddings")
def _(spark, sf):
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    return V.table(spark, sf, "embeddings").select("vec_id", S.one_hot_to_id(hot).cast("bigint").alias("label"))


@query("src12_review_marks", "SELECT form, field_id, mark, count(*) AS n FROM marks GROUP BY ALL", "marks")
def _(spark, sf):
    """Marks written as CSV sheets and read back."""
    out = scratch_dir(spark)
    V.marks(spark, sf).write.option("header", True).csv(out)
    return S.read_review_marks(spark, out)[0].groupBy("form", "field_id", "mark").agg(F.count("*").alias("n"))


@query("snk1_finish_transcript", "SELECT doc_id, CASE WHEN t = '' THEN t ELSE t || chr(10) END AS text FROM (SELECT doc_id, " + NORM.format("text") + " AS t FROM documents)")
def _(spark, sf):
    return V.documents(spark, sf).select("doc_id", W.finish_transcript("text").alias("text"))


@query("snk1_write_transcripts", "SELECT doc_id, " + NORM.format("text") + " AS text FROM documents")
def _(spark, sf):
    """A transcript file per document, written and read back."""
    out = scratch_dir(spark)
    W.write_transcript_files(V.documents(spark, sf), out, "doc_id")
    back = S.read_transcripts(spark, f"{out}/*/*.txt", normalize=False)
    return back.select(F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), "text")


@query("snk2_results_csv", "SELECT doc_id, y, k, truth, pred FROM word_pairs", "word_pairs")
def _(spark, sf):
    out = scratch_dir(spark)
    W.write_results_csv(V.ocr_pairs(spark, sf).select("doc_id", "y", "k", "truth", "pred"), out)
    back = spark.read.csv(out, header=True, schema="doc_id bigint, y bigint, k bigint, truth string, pred string", escape='"',
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return back.na.fill("", ["truth", "pred"])


_SPANS = """SELECT page, rank, '<span class="ocr_line" id="line_' || rank || '" title="bbox ' || x0 || ' ' || rank || ' ' || x1 || ' ' || (rank + 1) || '">' ||
    replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span>' || chr(10) AS s
    FROM (SELECT page, y0 AS rank, min(x0) AS x0, max(x1) AS x1, string_agg(w, ' ' ORDER BY id) AS t FROM page_words GROUP BY page, y0)"""


@query("snk4_hocr", f"SELECT page, '{W.HOCR_HEAD}' || string_agg(s, '' ORDER BY rank) || '{W.HOCR_FOOT}' AS html FROM spans GROUP BY page", "page_words", spans=_SPANS)
def _(spark, sf):
    w = V.page_words(spark, sf).groupBy("page", F.col("y0").alias("rank")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_sort(F.collect_list(F.struct("id", "w"))).alias("_l"))
    ln = w.select("page", "rank", F.col("rank").alias("id"), F.col("rank").alias("y0"), "x0", (F.col("rank") + 1).alias("y1"), "x1", F.array_join(F.transform("_l", lambda s: s["w"]), " ").alias("text"))
    return W.to_hocr(ln)


@query("snk5_dataset", """
    SELECT split, label, count(*) AS n FROM (SELECT CASE WHEN ('0x' || substr(md5(vec_id || ':5'), 1, 8))::BIGINT / 4294967296 < 0.8 THEN 'train' ELSE 'test' END AS split, label::BIGINT AS label FROM embeddings) GROUP BY ALL
    UNION ALL SELECT 'vocab', label, 1 FROM vocab""", "lines", vocab=_VOCAB)
def _(spark, sf):
    """Samples and vocabulary written and read back."""
    out = scratch_dir(spark)
    d = R.split_dataset(V.table(spark, sf, "embeddings"), ["vec_id"], 0.2, "random", 5)
    W.write_dataset(d, vocab(spark, sf), out)
    n = S.read_labelled(spark, f"{out}/samples").groupBy("split", F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("n"))
    return n.unionByName(S.read_vocab(spark, f"{out}/char2label").select(F.lit("vocab").alias("split"), "label", F.lit(1).cast("bigint").alias("n")))


@query("snk6_case_folders", "SELECT correct, kind, count(*) AS n FROM (SELECT real = pred AS correct, pred AS kind FROM ranked) GROUP BY ALL", "ranked")
def _(spark, sf):
    out = scratch_dir(spark)
    d = V.ranked(spark, sf).select("vec_id", F.col("pred").alias("type"), F.col("real").alias("true_label"), F.col("pred").alias("ocr_result"))
    W.write_case_folders(d, out)
    back = spark.read.parquet(out)
    return back.groupBy(F.col("correct").cast("boolean").alias("correct"), F.col("type").cast("string").alias("kind")).agg(F.count("*").alias("n"))


@query("snk7_template_json", """
    SELECT page, '{' || string_agg('"' || tbl || '":{' || j || '}', ',' ORDER BY tbl) || '}' AS json FROM
      (SELECT page, tbl, string_agg('"' || key || '":["' || t || '"]', ',' ORDER BY key) AS j FROM
        (SELECT page, tbl, key, string_agg(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'), ' ' ORDER BY id) AS t FROM found GROUP BY page, tbl, key) GROUP BY page, tbl) GROUP BY page""",
       "page_words", "blocks", **TPL_SQL, found=TPL_WORDS)
def _(spark, sf):
    w = template_words(spark, sf).groupBy("page", "tbl", "key", "seq").agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("_l"))
    txt = F.array_join(F.transform("_l", lambda s: F.regexp_replace(s["w"], "[^A-Za-z0-9]", "")), " ")
    return W.to_template_json(w.select("page", "tbl", "key", "seq", txt.alias("text")), ["page"])


@query("snk3_by_field", """
    SELECT form, field_id, string_agg(t, chr(10) ORDER BY line_no) AS txt FROM (SELECT form, field_id, line_no, string_agg(txt, '' ORDER BY c_custkey) AS t FROM char_hits GROUP BY ALL)
    GROUP BY form, field_id""", "char_hits")
def _(spark, sf):
    """Answers of each field, line by line (the "by field" table)."""
    h = V.char_hits(spark, sf)
    return M.assemble_fields(h, ["form", "field_id"], "line_no", "c_custkey", "txt")


# ---- streams --------------------------------------------------------------

@query("str1_monitor_stream", """
    SELECT event_type, "start", n, total FROM (SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS "start", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
    WHERE "start" + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def _(spark, sf):
    """All events through a file stream; windows the watermark has closed are out."""
    src = V.events(spark, sf)
    sdf = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_dir(spark)
    ST.drain(ST.monitor_stream(sdf, "event_type", "value", "ts", "1 day"), f"{out}/table", f"{out}/log")
    got = spark.read.parquet(f"{out}/table")
    return got.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("str2_score_new_files", "SELECT count(*) AS n, count(*) FILTER (WHERE truth = pred) AS ok, sum(levenshtein(truth, pred))::BIGINT AS errors FROM w", "word_pairs",
       w="SELECT " + NORM.format("truth") + " AS truth, " + NORM.format("pred") + " AS pred FROM word_pairs")
def _(spark, sf):
    """Pairs written as files that arrive in two goes, each scored once by the same stream. The texts are
    split once, for both goes."""
    out = scratch_dir(spark)
    p = V.ocr_pairs(spark, sf, dealt=False).where("truth is not null")  # an empty line has a null word
    p = p.select((F.col("k") % 2).alias("go"), F.concat_ws("\t", F.concat_ws(".", "doc_id", "y", "k"), "truth", "pred").alias("value"))
    W.write_goes(p, f"{out}/made", "go")
    for part in (0, 1):
        W.arrive(spark, f"{out}/made/go={part}", f"{out}/in/{part}")
        ST.score_new_files(spark, f"{out}/in/*", f"{out}/scored", f"{out}/log")
    return spark.read.parquet(f"{out}/scored").agg(F.count("*").alias("n"), F.count_if("correct").alias("ok"), F.sum("errors").alias("errors"))


@query("udf1_parallel_map", "SELECT doc_id, y, length(line) AS n FROM lines", "lines")
def _(spark, sf):
    """A user function over Arrow batches, results in any order."""
    def job(batches):
        for pdf in batches:
            yield pdf[["doc_id", "y"]].assign(n=pdf["line"].str.len().astype("int64"))
    return V.lines(spark, sf).select("doc_id", "y", "line").mapInPandas(job, "doc_id bigint, y bigint, n bigint")
