"""Registered queries: document pairs, diffs, edits, passage location."""

import re

from pyspark.sql import functions as F

from pagescale.operators import diff as D
from pagescale.operators.locate import apply_edits, locate_passages, word_grams
from pagescale.plans import views as V
from pagescale.plans.registry import query

_SIDE = "SELECT a, b, y, line, n FROM doc_pairs JOIN dl ON doc_id = {0}"
_UNIQ = "SELECT a, b, line, min(y) AS {1} FROM {0} JOIN lim USING (a, b) WHERE y >= pre AND y < n - suf GROUP BY a, b, line HAVING count(*) = 1"
_NUM = "SELECT *, sum(m) OVER (PARTITION BY a, b ORDER BY y ROWS UNBOUNDED PRECEDING) - m AS g FROM (SELECT s.a, s.b, s.y, s.line, CASE WHEN t.a IS NULL THEN 0 ELSE 1 END AS m FROM {0} s LEFT JOIN mat t ON s.a = t.a AND s.b = t.b AND t.{1} = s.y)"
DIFF = {
    "dl": "SELECT doc_id, y, n, line || CASE WHEN y < n - 1 THEN chr(10) ELSE '' END AS line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)",
    "la": _SIDE.format("a"), "lb": _SIDE.format("b"),
    "pre": "SELECT a, b, coalesce(min(CASE WHEN la.line IS DISTINCT FROM lb.line THEN y END), count(*)) AS pre FROM la FULL JOIN lb USING (a, b, y) GROUP BY a, b",
    "suf": """SELECT a, b, coalesce(min(CASE WHEN p.line IS DISTINCT FROM q.line THEN i END), count(*)) AS suf FROM (SELECT *, n - 1 - y AS i FROM la) p
        FULL JOIN (SELECT *, n - 1 - y AS i FROM lb) q USING (a, b, i) GROUP BY a, b""",
    "lim": """SELECT a, b, na, nb, pre, least(suf, least(na, nb) - pre) AS suf FROM (SELECT a, b, max(n) AS na FROM la GROUP BY a, b) JOIN (SELECT a, b, max(n) AS nb FROM lb GROUP BY a, b) USING (a, b)
        JOIN pre USING (a, b) JOIN suf USING (a, b)""",
    "ua": _UNIQ.format("la", "ya"), "ub": _UNIQ.format("lb", "yb"),
    "mat": """SELECT a, b, ya, yb FROM (SELECT a, b, ya, yb, max(yb) OVER (PARTITION BY a, b ORDER BY ya ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t,
        min(yb) OVER (PARTITION BY a, b ORDER BY ya ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS l FROM ua JOIN ub USING (a, b, line)) WHERE coalesce(t < yb, true) AND coalesce(l > yb, true)
        UNION ALL SELECT a, b, i, i FROM (SELECT a, b, unnest(range(0, pre)) AS i FROM lim) UNION ALL SELECT a, b, na - i, nb - i FROM (SELECT *, unnest(range(1, suf + 1)) AS i FROM lim)""",
    "da": _NUM.format("la", "ya"), "db": _NUM.format("lb", "yb"),
    "changed": """SELECT a, b, g, -1 AS op, string_agg(line, '' ORDER BY y) AS text FROM da WHERE m = 0 GROUP BY a, b, g
        UNION ALL SELECT a, b, g, 1, string_agg(line, '' ORDER BY y) FROM db WHERE m = 0 GROUP BY a, b, g""",
    "same": """SELECT a, b, min(g) AS g, 0 AS op, string_agg(line, '' ORDER BY g) AS text FROM (SELECT d.*, sum(CASE WHEN e.a IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY d.a, d.b ORDER BY d.g ROWS UNBOUNDED PRECEDING) AS r
        FROM da d LEFT JOIN (SELECT DISTINCT a, b, g FROM changed) e ON d.a = e.a AND d.b = e.b AND d.g = e.g WHERE m = 1) GROUP BY a, b, r""",
    "df": """SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY g, CASE op WHEN -1 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS seq, op::BIGINT AS op, text
        FROM (SELECT * FROM changed UNION ALL SELECT * FROM same)""",
    "offs": """SELECT *, coalesce(sum(CASE WHEN op <= 0 THEN length(text) END) OVER w, 0)::BIGINT - CASE WHEN op <= 0 THEN length(text) ELSE 0 END AS start1,
        coalesce(sum(CASE WHEN op >= 0 THEN length(text) END) OVER w, 0)::BIGINT - CASE WHEN op >= 0 THEN length(text) ELSE 0 END AS start2
        FROM df WINDOW w AS (PARTITION BY a, b ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
}
VIEWS = ("lines", "doc_pairs")


def diffs(spark, sf):
    return D.line_diff(V.doc_pairs(spark, sf), D.doc_lines(V.documents(spark, sf)))


def sources(spark, sf):
    return V.documents(spark, sf).select(F.col("doc_id").alias("a"), "text")


@query("set11_line_multiset_diff", """
    SELECT * FROM (SELECT a, b, line, unnest([0, -1, 1])::BIGINT AS op, unnest([least(na, nb), na - nb, nb - na]) AS n FROM
      (SELECT a, b, line, count(*) FILTER (WHERE s = 1) AS na, count(*) FILTER (WHERE s = 2) AS nb FROM (SELECT *, 1 AS s FROM la UNION ALL SELECT *, 2 FROM lb) GROUP BY a, b, line)) WHERE n > 0""",
       *VIEWS, dl=DIFF["dl"], la=DIFF["la"], lb=DIFF["lb"])
def _(spark, sf):
    return D.line_multiset_diff(V.doc_pairs(spark, sf), D.doc_lines(V.documents(spark, sf)))


@query("set12_line_diff", "SELECT a, b, seq, op, text FROM df", *VIEWS, **DIFF)
def _(spark, sf):
    return diffs(spark, sf)


@query("agg25_diff_stats", """
    SELECT a, b, sum(i)::BIGINT AS inserted, sum(d)::BIGINT AS deleted, sum(e)::BIGINT AS equal, sum(greatest(i, d))::BIGINT AS distance FROM
      (SELECT a, b, r, sum(CASE WHEN op = 1 THEN length(text) ELSE 0 END) AS i, sum(CASE WHEN op = -1 THEN length(text) ELSE 0 END) AS d, sum(CASE WHEN op = 0 THEN length(text) ELSE 0 END) AS e
       FROM (SELECT *, sum(CASE WHEN op = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY a, b ORDER BY seq) AS r FROM df) GROUP BY a, b, r) GROUP BY a, b""", *VIEWS, **DIFF)
def _(spark, sf):
    return D.diff_stats(diffs(spark, sf))


@query("agg26_diff_texts", "SELECT a, b, x.text AS text1, y.text AS text2 FROM doc_pairs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b", *VIEWS)
def _(spark, sf):
    """The diff gives both documents back."""
    d = diffs(spark, sf)
    return D.diff_text(d, 1).withColumnRenamed("text", "text1").join(D.diff_text(d, 2).withColumnRenamed("text", "text2"), ["a", "b"])


@query("win19_map_positions", """
    SELECT l.a, l.b, loc, CASE WHEN op IS NULL THEN n2 + loc - n1 WHEN op = -1 THEN start2 ELSE start2 + loc - start1 END AS loc2 FROM
      (SELECT a, b, length(x.text) AS n1, length(y.text) AS n2, unnest(range(0, length(x.text) + 100, 100)) AS loc FROM doc_pairs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b) l
    LEFT JOIN offs o ON o.a = l.a AND o.b = l.b AND o.op <= 0 AND loc >= start1 AND loc < start1 + length(text)""", *VIEWS, **DIFF)
def _(spark, sf):
    locs = V.doc_pairs(spark, sf).join(sources(spark, sf), "a").select("a", "b", F.explode(F.expr("sequence(0L, length(text) + 99L, 100L)")).alias("loc"))
    return D.map_positions(diffs(spark, sf), locs)


@query("txt19_diff_html", """
    SELECT a, b, string_agg(CASE op WHEN 1 THEN '<ins style="background:#e6ffe6;">' || t || '</ins>' WHEN -1 THEN '<del style="background:#ffe6e6;">' || t || '</del>' ELSE '<span>' || t || '</span>' END, '' ORDER BY seq) AS html
    FROM (SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '&para;<br>') AS t FROM df) GROUP BY a, b""", *VIEWS, **DIFF)
def _(spark, sf):
    return D.diff_html(diffs(spark, sf))


_SAFE = ["!", "'", "(", ")", ";", "/", "?", ":", "@", "&", "=", "+", "$", ",", "#", " ", "*"]


def _enc(t):
    out = f"url_encode({t})"
    for ch in _SAFE:
        out = "replace({}, '%{:02X}', '{}')".format(out, ord(ch), ch.replace("'", "''"))
    return out


@query("set14_to_delta", f"""
    SELECT a, b, string_agg(CASE op WHEN 0 THEN '=' || length(text) WHEN -1 THEN '-' || length(text) ELSE '+' || {_enc('text')} END, chr(9) ORDER BY seq) AS delta FROM df GROUP BY a, b""", *VIEWS, **DIFF)
def _(spark, sf):
    return D.to_delta(diffs(spark, sf))


@query("set14_from_delta", "SELECT a, b, seq, op, text FROM df", *VIEWS, **DIFF)
def _(spark, sf):
    return D.from_delta(D.to_delta(diffs(spark, sf)), sources(spark, sf))


def _single(spark, sf):
    """The diff cut to one op per line, to be merged again."""
    d = diffs(spark, sf)
    parts = F.posexplode(F.regexp_extract_all("text", F.lit("[^\n]*\n|[^\n]+"), F.lit(0))).alias("i", "t")
    return d.select("a", "b", "seq", "op", parts).select("a", "b", F.struct("seq", "i").alias("seq"), "op", F.col("t").alias("text"))


@query("set13_merge_diff", "SELECT a, b, seq, op, text FROM df", *VIEWS, **DIFF)
def _(spark, sf):
    return D.merge_diff(_single(spark, sf))


_KS = "SELECT *, sum(CASE WHEN op = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY a, b ORDER BY seq) AS k, length(text) AS n FROM df"
_ES = "SELECT a, b, k, sum(CASE WHEN op = 1 THEN n ELSE 0 END) AS i, sum(CASE WHEN op = -1 THEN n ELSE 0 END) AS d FROM ks WHERE op <> 0 GROUP BY a, b, k"
_CUT = """SELECT ks.a, ks.b, seq, text, unnest(CASE WHEN op = 0 AND p.a IS NOT NULL AND q.a IS NOT NULL AND n <= greatest(p.i, p.d) AND n <= greatest(q.i, q.d) THEN [-1, 1] ELSE [op] END)::BIGINT AS op
    FROM ks LEFT JOIN es p ON p.a = ks.a AND p.b = ks.b AND p.k = ks.k - 1 LEFT JOIN es q ON q.a = ks.a AND q.b = ks.b AND q.k = ks.k"""
_RUNS = """SELECT *, sum(f) OVER (PARTITION BY a, b ORDER BY seq, o ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN lag(op = 0) OVER (PARTITION BY a, b ORDER BY seq, o) = (op = 0) THEN 0 ELSE 1 END AS f
    FROM (SELECT *, CASE op WHEN -1 THEN 0 ELSE 1 END AS o FROM cut))"""


@query("set13_clean_round", """
    SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY g, op + CASE op WHEN 0 THEN 9 ELSE 0 END) AS seq, op, text FROM
      (SELECT a, b, g, op, string_agg(text, '' ORDER BY seq) AS text FROM runs GROUP BY a, b, g, op)""", *VIEWS, **DIFF, ks=_KS, es=_ES, cut=_CUT, runs=_RUNS)
def _(spark, sf):
    return D.clean_round(diffs(spark, sf), "semantic")


def _rounds(n):
    """CTEs of n rounds one after the other, the last one as ``done``."""
    out, src = {}, "df"
    for i in range(1, n + 1):
        names = {"df": src, "ks": f"ks{i}", "es": f"es{i}", "cut": f"cut{i}", "runs": f"runs{i}"}
        put = lambda sql, names=names: re.sub(r"\b(df|ks|es|cut|runs)\b", lambda m: names[m[1]], sql)
        out |= {names[k]: put(v) for k, v in (("ks", _KS), ("es", _ES), ("cut", _CUT), ("runs", _RUNS))}
        src = f"df{i}"
        out[src] = f"""SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY g, op + CASE op WHEN 0 THEN 9 ELSE 0 END) AS seq, op, text FROM
            (SELECT a, b, g, op, string_agg(text, '' ORDER BY seq) AS text FROM runs{i} GROUP BY a, b, g, op)"""
    return out | {"done": f"SELECT * FROM {src}"}


# Six rounds; each pair is stable after fewer, and a stable diff passes a round unchanged.
@query("set13_clean_diff", "SELECT a, b, seq, op, text FROM done", *VIEWS, **DIFF, **_rounds(6))
def _(spark, sf):
    return D.clean_diff(diffs(spark, sf), "semantic")


_GS = "SELECT *, sum(CASE WHEN op = 0 AND length(text) > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY a, b ORDER BY seq) AS gg FROM offs"
_SPAN = "SELECT a, b, gg, min(seq) AS lo, max(seq) AS hi FROM gs WHERE op <> 0 GROUP BY a, b, gg"
_EDITS = """SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY start1, start2) AS edit, start1, start2, old, new,
    coalesce((SELECT right(text, 60) FROM df x WHERE x.a = e.a AND x.b = e.b AND x.seq = e.lo - 1), '') AS before, coalesce((SELECT left(text, 60) FROM df x WHERE x.a = e.a AND x.b = e.b AND x.seq = e.hi + 1), '') AS after
    FROM (SELECT a, b, gg, any_value(lo) AS lo, any_value(hi) AS hi, min(start1) AS start1, min(start2) AS start2, coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE op <= 0), '') AS old,
          coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE op >= 0), '') AS new FROM gs JOIN span USING (a, b, gg) WHERE seq BETWEEN lo AND hi GROUP BY a, b, gg) e"""


@query("set15_make_edits", "SELECT a, b, edit, start1, start2, old, new, before, after FROM edits", *VIEWS, **DIFF, gs=_GS, span=_SPAN, edits=_EDITS)
def _(spark, sf):
    return D.make_edits(diffs(spark, sf), 60)


@query("set16_apply_edits", "SELECT a, b, y.text FROM doc_pairs JOIN documents y ON y.doc_id = b", *VIEWS)
def _(spark, sf):
    """The edits of a pair turn its first document into its second."""
    e = D.make_edits(diffs(spark, sf), 60)
    docs = V.doc_pairs(spark, sf).join(sources(spark, sf), "a")
    return apply_edits(docs, e, ["a", "b"]).select("a", "b", "text")


_PREFACE = "A preface that the edits were not made for."


@query("set16_apply_edits_near", f"""
    SELECT a, b, '{_PREFACE}' || chr(10) || y.text AS text, coalesce(repeat('T', (SELECT count(*) FROM edits e WHERE e.a = doc_pairs.a AND e.b = doc_pairs.b)), '') AS applied
    FROM doc_pairs JOIN documents y ON y.doc_id = b""", *VIEWS, **DIFF, gs=_GS, span=_SPAN, edits=_EDITS)
def _(spark, sf):
    """The edits of a pair on a copy of its first document that begins with a preface: the first
    edit is looked for, the others carry its offset."""
    e = D.make_edits(diffs(spark, sf), 60)
    docs = V.doc_pairs(spark, sf).join(sources(spark, sf), "a").withColumn("text", F.concat(F.lit(_PREFACE + "\n"), "text"))
    return apply_edits(docs, e, ["a", "b"])


def _co(s, n):
    return f"CASE {n} WHEN 0 THEN ({s}) || ',0' WHEN 1 THEN ({s} + 1)::VARCHAR ELSE ({s} + 1) || ',' || ({n}) END"


@query("set17_edits_to_text", f"""
    SELECT a, b, string_agg('@@ -' || {_co('start1 - length(before)', '(length(old) + length(before) + length(after))')} || ' +' || {_co('start2 - length(before)', '(length(new) + length(before) + length(after))')} || ' @@' || chr(10)
      || CASE WHEN before = '' THEN '' ELSE ' ' || {_enc('before')} || chr(10) END || CASE WHEN old = '' THEN '' ELSE '-' || {_enc('old')} || chr(10) END
      || CASE WHEN new = '' THEN '' ELSE '+' || {_enc('new')} || chr(10) END || CASE WHEN after = '' THEN '' ELSE ' ' || {_enc('after')} || chr(10) END, '' ORDER BY edit) AS patch
    FROM edits GROUP BY a, b""", *VIEWS, **DIFF, gs=_GS, span=_SPAN, edits=_EDITS)
def _(spark, sf):
    return D.edits_to_text(D.make_edits(diffs(spark, sf), 60))


@query("set17_edits_from_text", "SELECT a, b, edit, start1, start2, old, new, before, after FROM edits", *VIEWS, **DIFF, gs=_GS, span=_SPAN, edits=_EDITS)
def _(spark, sf):
    return D.edits_from_text(D.edits_to_text(D.make_edits(diffs(spark, sf), 60)))


# ---- passages -------------------------------------------------------------

_W = """SELECT ident, row_number() OVER (PARTITION BY ident ORDER BY j) AS k, w, p FROM (SELECT *, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY ident ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p
    FROM (SELECT ident, generate_subscripts(string_split(t, ' '), 1) AS j, unnest(string_split(t, ' ')) AS w FROM {0})) WHERE w <> ''"""
_GR = "SELECT ident, p, gram FROM (SELECT ident, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS gram FROM {0} WINDOW o AS (PARTITION BY ident ORDER BY k)) WHERE gram IS NOT NULL"
_ONE = V.one_byte_sql("translate(text, chr(10), ' ')")
_LOC = dict(docs=f"SELECT doc_id AS ident, {_ONE} AS t FROM documents", pats=f"SELECT item_id AS ident, {_ONE} AS t FROM benchmark",
            dw=_W.format("docs"), dg=_GR.format("dw"))

_LIMIT = 0.1  # errors a character
# Windows by the pigeonhole rule, then the table of edit distances row by row over reversed texts.
_NEAR = dict(
    docs=f"SELECT doc_id AS ident, {_ONE} AS t FROM documents",
    pats=f"SELECT *, m // (e + 1) AS q FROM (SELECT *, length(t) AS m, CAST(floor({_LIMIT} * length(t) + 1e-9) AS BIGINT) AS e FROM (SELECT item_id, {_ONE} AS t FROM benchmark))",
    parts="SELECT item_id, m, e, q, o AS place, substr(t, o + 1, q) AS gram FROM (SELECT *, unnest(range(0, m - q + 1, q)) AS o FROM pats)",
    hits="""SELECT item_id, ident, p.m, p.e, p.m // p.q - p.e AS need, 2 * p.e + 1 AS w, g.o - p.place AS d FROM
        (SELECT ident, q, o, substr(t, o + 1, q) AS gram FROM (SELECT ident, t, q, unnest(range(0, length(t) - q + 1)) AS o FROM docs, (SELECT DISTINCT q FROM pats))) g JOIN parts p ON p.q = g.q AND p.gram = g.gram""",
    wins="""SELECT item_id, ident, any_value(m) AS m, any_value(e) AS e, k * any_value(w) AS a, (k + 2) * any_value(w) AS b FROM
        (SELECT *, unnest([CAST(floor(d / w) AS BIGINT), CAST(floor(d / w) AS BIGINT) - 1]) AS k FROM hits) GROUP BY item_id, ident, k HAVING count(*) >= any_value(need)""",
    cut="""SELECT row_number() OVER () AS w, item_id, ident, wins.m, wins.e, greatest(a, 0) AS lo, reverse(p.t) AS p, reverse(substr(d.t, greatest(a, 0) + 1, b + wins.m + wins.e - greatest(a, 0))) AS t
        FROM wins JOIN pats p USING (item_id) JOIN docs d USING (ident)""",
    dp="""WITH RECURSIVE r(w, i, j, d) AS (SELECT w, 0::BIGINT, unnest(range(0, length(t) + 1)), 0::BIGINT FROM cut UNION ALL
        SELECT w, i + 1, j, j + min(x - j) OVER (PARTITION BY w ORDER BY j ROWS UNBOUNDED PRECEDING) FROM
          (SELECT r.w, i, j, least(d + 1, coalesce(lag(d) OVER (PARTITION BY r.w ORDER BY j) + CASE WHEN substr(p, i + 1, 1) = substr(t, j, 1) THEN 0 ELSE 1 END, i + 1)) AS x FROM r JOIN cut USING (w) WHERE i < m))
        SELECT item_id, ident, lo + length(t) - j AS x, d, m FROM r JOIN cut USING (w) WHERE i = m AND d <= e""")


def _one(df):
    """Texts of one byte a character, line breaks kept."""
    return df.withColumn("text", V.one_byte("text", "\n"))


@query("join21_locate_passages", """
    SELECT item_id, ident AS doc_id, x, d AS errors, round(d / m, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, ident ORDER BY d, x) AS rk FROM dp) WHERE rk = 1""", **_NEAR)
def _(spark, sf):
    """Every benchmark passage in every document, with up to one error in ten characters."""
    got = locate_passages(_one(V.table(spark, sf, "benchmark")), _one(V.documents(spark, sf).select("doc_id", "text")), _LIMIT)
    return got.withColumn("score", F.round("score", 6))


@query("join21_seeds", "SELECT ident AS doc_id, count(*) AS grams, min(p) AS first, max(p) AS last FROM dg GROUP BY ident", **_LOC)
def _(spark, sf):
    g = word_grams(_one(V.documents(spark, sf).select("doc_id", "text")), "doc_id", "text", 4)
    return g.groupBy("doc_id").agg(F.count("*").alias("grams"), F.min("p").alias("first"), F.max("p").alias("last"))
