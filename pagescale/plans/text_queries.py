"""Registered queries: text normalisation, projection, tokens, codes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagescale.functions import text as T
from pagescale.plans.registry import query
from pagescale.plans.views import lines, ocr_pairs, words

# SQL for the normaliser on the given texts (already NFC).
NORM = ("replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace("
        "translate(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '_#`´‘’′µ–—', '~~''''''''''μ--'), "
        "'\"', ''''''), '“', ''''''), '”', ''''''), '„', ',,'), '…', '...'), '″', ''''''), '‴', ''''''''), '〃', ''''''), "
        "'ﬂ', 'fl'), 'ﬁ', 'fi'), 'ﬀ', 'ff'), 'ﬃ', 'ffi')")
PROJ = "translate(regexp_replace(" + NORM + ", ' *([.] *){{4,}}', '....', 'g'), '~_', '')"


def _lines_query(name, column, sql):
    query(name, f"SELECT doc_id, y, {sql} AS t FROM lines", "lines")(
        lambda spark, sf: lines(spark, sf).select("doc_id", "y", column().alias("t")))


_lines_query("txt1_normalize_text", lambda: T.normalize_text("line"), NORM.format("line"))
for _kind, _sql in {
    "exact": PROJ,
    "nospace": "regexp_replace(" + PROJ + ", '\\s', '', 'g')",
    "spletdig": "regexp_replace(" + PROJ + ", '[^A-Za-z0-9 ]', '', 'g')",
    "letdig": "regexp_replace(" + PROJ + ", '[^A-Za-z0-9]', '', 'g')",
    "letters": "regexp_replace(" + PROJ + ", '[^A-Za-z]', '', 'g')",
    "digits": "regexp_replace(" + PROJ + ", '[^0-9]', '', 'g')",
    "lnc": "regexp_replace(upper(replace(" + PROJ + ", 'ß', 'ss')), '[^A-Z]', '', 'g')",
}.items():
    _lines_query(f"txt2_project_{_kind}", lambda k=_kind: T.project_text("line", k), _sql.format("line"))

_lines_query("txt3_requote", lambda: T.requote(T.normalize_text("line")), "replace(" + NORM.format("line") + ", '''''', '\"')")
for _g, _sh in ((False, ("“", "”", "‘", "’")), (True, ("”", "“", "’", "‘"))):
    _q = NORM.format("line")
    for _pat, _to in ((r"\s+''''", _sh[0]), (r"''''\s+", _sh[1]), (r"\s+,,", "„"), (r"\s+''", _sh[2]), (r"''\s+", _sh[3]), (r"\s+,", "‚")):
        _q = f"regexp_replace({_q}, '{_pat}', '{_to}', 'g')"
    _lines_query("txt3_requote_germanic" if _g else "txt3_requote_fancy",
                 lambda g=_g: T.requote_fancy(T.normalize_text("line"), g), _q)
_lines_query("txt4_normalize_nfkc", lambda: T.normalize_nfkc("line"), "line")  # the texts are NFKC already

# Kana with detached marks, from the letters of every text.
_KANA_FROM, _KANA_TO = "tkhsfpeo", "たかはさふぼ゚"
_lines_query("txt5_merge_voicing",
             lambda: T.merge_voicing(F.translate("line", _KANA_FROM, _KANA_TO)),
             "array_to_string(list_transform(regexp_extract_all(translate(line, 'tkhsfpeo', 'たかはさふほ' || chr(12441) || chr(12442)), "
             "'[^' || chr(12441) || chr(12442) || '][' || chr(12441) || chr(12442) || ']*'), lambda t: CASE WHEN length(t) = 1 THEN t "
             "ELSE chr(unicode(substr(t, length(t) - 1, 1)) + CASE WHEN substr(t, length(t), 1) = chr(12441) THEN 1 ELSE 2 END) END), '')")

_US = "translate(line, ' ,', '_' || chr(1))"
_lines_query("txt6_gt_explode", lambda: F.array_join(T.gt_explode(F.translate("line", " ,", "_\x01")), "|"),
             f"array_to_string(list_transform(regexp_extract_all({_US}, '_.{{1,4}}_|[\\s\\S]'), lambda t: "
             "translate(CASE WHEN length(t) > 1 THEN substr(t, 2, length(t) - 2) ELSE t END, chr(1) || chr(2), '_\\')), '|')")


@query("txt7_gt_implode", """
    SELECT doc_id, y, k, CASE WHEN length(w) > 4 THEN '' WHEN w = '_' THEN '___' WHEN length(w) <= 1 THEN w ELSE '_' || w || '_' END AS t,
           length(w) > 4 AS too_long FROM words""", "words")
def _(spark, sf):
    w = words(spark, sf)
    fits = F.length("w") <= 4
    return w.select("doc_id", "y", "k", F.when(fits, T.gt_implode(F.array("w"))).otherwise("").alias("t"), (~fits).alias("too_long"))


@query("txt8_valid_class_label", """
    SELECT doc_id, y, k, NOT regexp_matches(w, '[\\x00-\\x20]') AS ok, NOT regexp_matches(w, '[^\\x21-\\x7e]') AS ok_ascii FROM words""", "words")
def _(spark, sf):
    return words(spark, sf).select("doc_id", "y", "k", T.valid_class_label("w").alias("ok"),
                                   T.valid_class_label("w", True).alias("ok_ascii"))


def char_counts(spark, sf):
    """Character counts of each document's lines, the text of a row folded before the shuffle."""
    return lines(spark, sf).select("lang", F.explode(F.split("line", "")).alias("ch")).where("ch <> ''") \
        .groupBy("lang", "ch").agg(F.count("*").alias("n"))


CHARS = "SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(line, '')) AS ch FROM lines) WHERE ch <> '' GROUP BY ALL"


@query("txt9_size_category", """
    SELECT lang, coalesce(cat, 'none') AS cat, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT *, CASE WHEN contains('acemnorsuvwxyz', ch) THEN 'x' WHEN contains('ABCDEFGHIJKLMNOPQRSTUVWXYZbdfhklt!?', ch) THEN 'k'
             WHEN contains('gpqy', ch) THEN 'y' WHEN contains('.,', ch) THEN '.' WHEN contains('''"`', ch) THEN '''' END AS cat FROM chars)
    GROUP BY ALL""", "lines", chars=CHARS)
def _(spark, sf):
    return char_counts(spark, sf).groupBy("lang", F.coalesce(T.size_category("ch"), F.lit("none")).alias("cat")).agg(F.sum("n").alias("n"))


@query("txt10_fold_confusables", """
    SELECT doc_id, y, k, translate(w, 'C1I|/O0SUVWXZ''.`', 'clllloosuvwxz,,,') AS t FROM words""", "words")
def _(spark, sf):
    return words(spark, sf).select("doc_id", "y", "k", T.fold_confusables("w").alias("t"))


_SETS = ", ".join("('{}', '{}')".format(n, c.replace("'", "''")) for n, c in T.CHARSETS.items())


@query("txt11_charset_profile", f"""
    SELECT lang, charset, CAST(sum(n) AS BIGINT) AS n, count(*) AS distinct_chars
    FROM chars JOIN (VALUES {_SETS}) s(charset, members) ON contains(members, ch) GROUP BY ALL""", "lines", chars=CHARS)
def _(spark, sf):
    cs = lines(spark, sf).select("lang", F.explode(F.split("line", "")).alias("ch")).where("ch <> ''")
    return T.charset_profile(cs, "ch", ["lang"])


@query("txt12_split_bylen", """
    SELECT doc_id, y, i AS piece, CASE WHEN length(line) >= 40 THEN substr(line, CAST(i * 40 + 1 AS BIGINT), 40) ELSE line END AS line
    FROM (SELECT *, unnest(range(0, CASE WHEN length(line) >= 40 THEN (length(line) + 39) // 40 ELSE 1 END)) AS i FROM lines)""", "lines")
def _(spark, sf):
    return T.split_bylen(lines(spark, sf).select("doc_id", "y", "line"), "line", 40)


@query("txt13_combine_lines", """
    SELECT doc_id, y // 3 AS grp, string_agg(line, ' ' ORDER BY y) AS line FROM lines GROUP BY ALL HAVING count(*) = 3""", "lines")
def _(spark, sf):
    return T.combine_lines(lines(spark, sf), ["doc_id"], "y", "line", 3, " ")


_COMMON = T.LIG_COMMON.replace("'", "''")
_TOKEN = T.LIG_TOKEN.replace("'", "''")
_LIG = f"""SELECT name, code FROM (
    SELECT '~~' AS name, {T.LIG_BASE} AS code UNION ALL SELECT '~~~', {T.LIG_BASE + 1} UNION ALL SELECT '~~~~', {T.LIG_BASE + 2}
    UNION ALL SELECT f || substr('{_COMMON}', CAST(j + 1 AS BIGINT), 1), {T.LIG_BASE + 3} + 70 * i + j
    FROM (SELECT unnest(fs) AS f, generate_subscripts(fs, 1) - 1 AS i
          FROM (SELECT string_split('{_COMMON}', '') || ['oo', 'OO', '00', 'ff', 'mm'] || string_split('ÄÖÜäöüß', '') AS fs)), range(70) r(j)
    UNION ALL SELECT substr('{_COMMON}', CAST(j + 1 AS BIGINT), 1) || '-', {T.LIG_BASE + 3 + 70 * 82} + j FROM range(70) r(j)
    UNION ALL SELECT '-' || substr('{_COMMON}', CAST(j + 1 AS BIGINT), 1), {T.LIG_BASE + 3 + 70 * 82} + j FROM range(70) r(j))"""
_TOKS = f"""SELECT doc_id, y, generate_subscripts(regexp_extract_all(line, '{_TOKEN}'), 1) - 1 AS pos,
    unnest(regexp_extract_all(line, '{_TOKEN}')) AS token FROM lines"""


@query("txt14_encode_ligatures", """
    SELECT doc_id, y, pos, token, CAST(coalesce(code, unicode(token)) AS BIGINT) AS code FROM toks LEFT JOIN lig ON token = name""",
       "lines", lig=_LIG, toks=_TOKS)
def _(spark, sf):
    return T.encode_ligatures(lines(spark, sf), "line", ["doc_id", "y"])


@query("txt14_decode_ligatures", """
    SELECT doc_id, y, string_agg(CASE WHEN token LIKE '_-' AND substr(token, 1, 1) <> '-' AND code IS NOT NULL THEN '-' || substr(token, 1, 1)
                                 ELSE token END, '' ORDER BY pos) AS t
    FROM toks LEFT JOIN lig ON token = name GROUP BY doc_id, y""", "lines", lig=_LIG, toks=_TOKS)
def _(spark, sf):
    """Lines stay whole; only where a key has several lines are their tokens put in one order."""
    key = ["doc_id", "y"]
    ln = lines(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    coded = T.encode_ligatures(ln, "line", [*key, "n"], nested=True)
    back = T.decode_ligatures(coded, [*key, "n"], nested=True)
    several = F.when(F.col("n") > 1, F.transform("names", lambda s, i: F.struct(i.alias("pos"), s.alias("name"))))
    got = back.select(*key, F.array_join("names", "").alias("t"), several.alias("s")).groupBy(*key).agg(F.min("t").alias("t"), F.flatten(F.collect_list("s")).alias("s"))
    return got.select(*key, F.when(F.size("s") > 0, F.array_join(F.transform(F.array_sort("s"), lambda s: s["name"]), "")).otherwise(F.col("t")).alias("t"))


@query("txt15_line_codes", """
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY min(y)) AS code, count(*) AS copies
    FROM lines GROUP BY doc_id, line""", "lines")
def _(spark, sf):
    return T.line_codes(lines(spark, sf), ["doc_id"], ["y"], "line")


@query("txt16_common_affixes", """
    SELECT doc_id, y, k, n_pre, n_suf,
           coalesce((SELECT max(m) FROM range(1, least(length(truth), length(pred)) + 1) r(m) WHERE right(truth, m) = left(pred, m)), 0) AS n_over
    FROM (SELECT *,
      coalesce((SELECT max(m) FROM range(1, least(length(truth), length(pred)) + 1) r(m) WHERE left(truth, m) = left(pred, m)), 0) AS n_pre,
      coalesce((SELECT max(m) FROM range(1, least(length(truth), length(pred)) + 1) r(m) WHERE right(truth, m) = right(pred, m)), 0) AS n_suf
      FROM word_pairs)""", "word_pairs")
def _(spark, sf):
    p = ocr_pairs(spark, sf)
    return p.select("doc_id", "y", "k", T.common_prefix_len("truth", "pred").alias("n_pre"),
                    T.common_suffix_len("truth", "pred").alias("n_suf"), T.common_overlap_len("truth", "pred").alias("n_over"))


_PLANE = ", ".join(f"('{code}', '{ch}')" for code, ch in T.jis_plane())


@query("txt17_jis_to_unicode", f"""
    SELECT p.code, n, coalesce(j.ch, '') AS ch FROM (SELECT lower(hex(two)) AS code, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, '[!-~]{{2}}')) AS two FROM lines) GROUP BY two) p
    LEFT JOIN (VALUES {_PLANE}) j(code, ch) ON j.code = p.code""", "lines")
def _(spark, sf):
    """Each two adjacent letters of a text, read as a JIS code of the kana and kanji rows."""
    pairs = lines(spark, sf).select(F.explode(F.regexp_extract_all("line", F.lit("[!-~]{2}"), F.lit(0))).alias("two")) \
        .groupBy("two").agg(F.count("*").alias("n"))
    code = F.hex(F.encode("two", "UTF-8"))
    return T.jis_to_unicode(pairs.select(F.lower(code).alias("code"), "n"), "code")


# Rows 3 to 5 of the plane by arithmetic: letters and digits, hiragana, katakana.
@query("txt17_kana", """
    SELECT code, n, CASE WHEN hi = 35 AND chr(lo) SIMILAR TO '[0-9A-Za-z]' THEN chr(65248 + lo) WHEN hi = 36 AND lo <= 115 THEN chr(12320 + lo) WHEN hi = 37 AND lo <= 118 THEN chr(12416 + lo) ELSE '' END AS ch
    FROM (SELECT lower(hex(two)) AS code, ascii(two) AS hi, ascii(substr(two, 2, 1)) AS lo, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, '[#-%][!-~]')) AS two FROM lines) GROUP BY two)""", "lines")
def _(spark, sf):
    """Two adjacent signs, the first of # to %, read as a JIS code."""
    pairs = lines(spark, sf).select(F.explode(F.regexp_extract_all("line", F.lit("[#-%][!-~]"), F.lit(0))).alias("two")).groupBy("two").agg(F.count("*").alias("n"))
    return T.jis_to_unicode(pairs.select(F.lower(F.hex(F.encode("two", "UTF-8"))).alias("code"), "n"), "code").select("code", "n", "ch")


@query("txt18_clean_names", """
    SELECT doc_id, y, regexp_replace(line, '[ ()]', '_', 'g') AS cleaned, regexp_replace(line, '\\s', '', 'g') AS stripped FROM lines""", "lines")
def _(spark, sf):
    return lines(spark, sf).select("doc_id", "y", T.clean_names("line").alias("cleaned"), T.strip_names("line").alias("stripped"))
