"""Secret scans over an incremental blob ledger. DataFrame functions only.

Every version of every text is named by its content (SHA-256), so copies and unchanged versions are one
blob. The ledger remembers which (blob, rule version) pairs were scanned and what was found;
a scan reads only the texts of unseen pairs, and findings are joined back to all paths that
hold a blob. Hashes travel, texts do not: one path stands for each unseen blob and only those
texts are read and matched, each once.

Positions come from the regular expression itself: ``split`` gives the text between the
matches and ``regexp_extract_all`` the matches; running lengths of both are the spans, in
code points with exclusive ends.

Defined cases: a null text is the empty blob; null paths are kept and get their blob's
findings; repeated rows give repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescale.session import materialise, scratch_dir


FEW = 10_000  # new blobs (about 100 bytes each) that are broadcast


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


#: Fixed values of the base rules, in the order that breaks ties of spans.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _lengths(cut: Column, rank: int, r: Rule) -> Column:
    return F.transform(cut, lambda m, k: F.struct(
        F.lit(r.kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(r.least).alias("least"), k.alias("k"),
        F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("len"), F.length(m["value"]).alias("value")))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, kind, rank, start, end) of every match in (blob_id, text); ``rank`` is the rule's place.

    Only texts that hold a long enough run at all are split; a whole-match rule asks for the
    length in its pattern, which keeps runs of short matches (single letters) out of the arrays.
    The window runs over the matches of one rule in one text; a blob that comes in several rows counts once.
    """
    each = []
    for rank, r in enumerate(rules):
        pattern = r.pattern
        if r.group == 0 and pattern.endswith("+"):
            known = len(pattern.partition("[")[0])  # literal characters before the class
            pattern = f"{pattern[:-1]}{{{r.least - known},}}"
        cut = F.arrays_zip(
            F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(r.group)).alias("value"))
        each.append(F.when(F.col("text").rlike(pattern), _lengths(cut, rank, r)))
    found = blobs.select("blob_id", F.inline(F.flatten(F.array_compact(F.array(*each))))).where("len is not null")
    at = Window.partitionBy("blob_id", "rank").orderBy("k")
    found = found.withColumn("again", F.lag("k").over(at).eqNullSafe(F.col("k"))).where("not again")
    out = found.withColumn("end", F.sum(F.col("gap").cast("bigint") + F.col("len")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where("value >= least").select("blob_id", "kind", "rank", (F.col("end") - F.col("len")).alias("start"), "end")


def paths_of(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(path_col).alias("path"), blob_id(F.col(text_col).cast("string")).alias("blob_id"))


def _unseen(docs: DataFrame, paths: DataFrame, seen: DataFrame | None, path_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(blob_id, path) to scan, and their texts. The small side (one path of each blob) is
    hashed, texts stream by unsorted; at most FEW new blobs go to the texts, more meet them in a shuffle."""
    one = paths.groupBy("blob_id").agg(F.min("path").alias("path"))
    if seen is not None:
        one = one.join(seen.select("blob_id"), "blob_id", "left_anti")
    one = materialise(one)
    texts = docs.select(F.col(path_col).alias("p"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    side = F.broadcast(one) if one.count() <= FEW else one.hint("shuffle_hash")
    both = texts.join(side, texts["p"].eqNullSafe(one["path"]))
    return one, both.where(blob_id(F.col("text")) == F.col("blob_id")).select("blob_id", "text")


def update(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan what the ledger has not seen; (paths, findings of all blobs, blobs scanned now).

    ``ledger`` is a folder that all executors share, with the tables ``findings`` and
    ``scanned``; None starts an empty one. Findings are written before the pairs count as scanned, so a
    run that dies between repeats its scan and loses nothing; the repeats are made distinct.
    """
    spark, version = docs.sparkSession, rule_version(rules)
    ledger = ledger or scratch_dir(spark)
    paths = materialise(paths_of(docs, path_col, text_col))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/scanned")
    seen = None
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        seen = spark.read.parquet(f"{ledger}/scanned").where(F.col("rule_version") == version).distinct()
    new, texts = _unseen(docs, paths, seen, path_col, text_col)
    scan(texts, rules).distinct().withColumn("rule_version", F.lit(version)).write.mode("append").parquet(f"{ledger}/findings")
    new.select("blob_id", F.lit(version).alias("rule_version")).write.mode("append").parquet(f"{ledger}/scanned")
    findings = spark.read.parquet(f"{ledger}/findings").where(F.col("rule_version") == version).drop("rule_version").distinct()
    return paths, findings, new.select("blob_id")


def digest(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per path: n_<kind> of each rule, and the spans kind:start:end by start, then rule order.

    A blob's spans come from one text, which bounds the array. Blobs with findings meet all
    their paths in one join; a blob that many paths hold is one build row and AQE splits the paths.
    """
    spans = F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind")))
    own = findings.groupBy("blob_id").agg(
        *[F.sum((F.col("rank") == i).cast("bigint")).alias(f"n_{r.kind}") for i, r in enumerate(rules)],
        F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))
    out = paths.join(own, "blob_id", "left")
    return out.select("path", *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("bigint")).alias(f"n_{r.kind}") for r in rules], F.coalesce("spans", F.lit("")).alias("spans"))


def scan_documents(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest`` of the documents after the ledger has seen them all."""
    paths, findings, _ = update(docs, ledger, rules, path_col, text_col)
    return digest(paths, findings, rules)


def redact(docs: DataFrame, paths: DataFrame, findings: DataFrame, path_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span found in a text replaced by ``mask``; spans that overlap become one.

    Texts meet their spans by path; a path whose rows have different texts gets each row's own
    spans, as the blob is compared too. Texts without findings pass unchanged.
    """
    spans = findings.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    hit = paths.join(spans, "blob_id").select(F.col("path").alias("_path"), F.col("blob_id").alias("_blob"), "_spans").dropDuplicates(["_path", "_blob"])
    text = F.col(text_col)
    at = docs.withColumn("_id", blob_id(text.cast("string")))
    both = at.join(hit.hint("shuffle_hash"), at[path_col].eqNullSafe(hit["_path"]) & (at["_id"] == hit["_blob"]), "left")
    none = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]  # a span that begins inside the one before adds nothing but its end
        kept = F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.when(fresh, kept).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    cut = F.aggregate("_spans", none, step, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    return both.withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(cut)).select(docs.columns)


def check_sql() -> str:
    """The same digest for DuckDB over the table ``documents``, scanning every text."""
    each = " union all ".join(
        f"""select doc_id, '{r.kind}' kind, {i} rk, {r.least} least, generate_subscripts(string_split_regex(t, p{i}), 1) k,
        unnest(string_split_regex(t, p{i})) gap, unnest(list_concat(regexp_extract_all(t, p{i}, 0), [''])) m, unnest(list_concat(regexp_extract_all(t, p{i}, {r.group}), [''])) v
        from d""" for i, r in enumerate(RULES))
    pats = ", ".join("'" + r.pattern.replace("'", "''") + f"' p{i}" for i, r in enumerate(RULES))
    return f"""with d as (select doc_id, coalesce(text, '') t, {pats} from documents), m as ({each}),
    s as (select doc_id, kind, rk, v, least, length(m) n, sum(length(gap) + length(m)) over (partition by doc_id, rk order by k) e from m),
    f as (select doc_id, kind, rk, cast(e - n as bigint) s, cast(e as bigint) e from s where length(v) >= least),
    g as (select doc_id, count(*) filter (rk = 0) n_assign, count(*) filter (rk = 1) n_access, count(*) filter (rk = 2) n_hex, string_agg(kind || ':' || s || ':' || e, ',' order by s, rk) spans from f group by 1)
    select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans from documents left join g using (doc_id)"""
