"""Document pairs line by line: diffs, clean-up, deltas, edits.

A diff is the table (a, b, seq, op, text) with op -1 deleted, 0 equal, 1 inserted. The
lines of a pair are two documents, so its rows come from two input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescale.operators.blocks import Scan, number_rows, scan

PAIR = ["a", "b"]


def doc_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, y, line, n): lines with their newline, and the line count of the document."""
    parts = F.split("text", "\n")
    d = docs.select("doc_id", F.size(parts).cast("bigint").alias("n"), F.posexplode(parts).alias("y", "line"))
    return d.select("doc_id", F.col("y").cast("bigint"), F.when(F.col("y") < F.col("n") - 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("line"), "n")


def pair_lines(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b, s, y, line, n): the lines of both documents of a pair, s = 0 for a, 1 for b."""
    sides = pairs.select("a", "b", F.inline(F.array(F.struct(F.col("a").alias("doc_id"), F.lit(0).alias("s")), F.struct(F.col("b").alias("doc_id"), F.lit(1).alias("s")))))
    return sides.join(lines, "doc_id").select("a", "b", "s", "y", "line", "n")


def line_multiset_diff(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b, op, line, n): lines both documents hold, only a, only b, with how often. The
    copies of a line fold to two counts before anything is compared."""
    n = pair_lines(pairs, lines).groupBy("a", "b", "line").agg(F.count_if(F.col("s") == 0).alias("na"), F.count_if(F.col("s") == 1).alias("nb"))
    ops = F.inline(F.filter(F.array(F.struct(F.lit(0).alias("op"), F.least("na", "nb").alias("n")), F.struct(F.lit(-1).alias("op"), (F.col("na") - F.col("nb")).alias("n")),
                                    F.struct(F.lit(1).alias("op"), (F.col("nb") - F.col("na")).alias("n"))), lambda s: s["n"] > 0))
    return n.select("a", "b", "line", ops)


def match_lines(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of :func:`pair_lines` with ``m`` = 1 where a line is matched: the common start and
    end, and between them the lines unique on both sides that no other such line crosses.

    One join, then windows that all contain (a, b): the rows are shuffled once. The rows
    of a pair come from two input rows, so a pair is a bounded group."""
    d = pair_lines(pairs, lines).withColumn("i", F.col("n") - 1 - F.col("y"))
    pair = Window.partitionBy(*PAIR)
    d = d.withColumn("_na", F.max(F.when(F.col("s") == 0, F.col("n"))).over(pair)).withColumn("_nb", F.max(F.when(F.col("s") == 1, F.col("n"))).over(pair))
    for at, out in (("y", "_pre"), ("i", "_suf")):
        w = Window.partitionBy(*PAIR, at)
        same = (F.count("*").over(w) == 2) & (F.min("line").over(w) == F.max("line").over(w))
        d = d.withColumn("_same", same).withColumn(out, F.coalesce(F.min(F.when(~F.col("_same"), F.col(at))).over(pair), F.least("_na", "_nb")))
    d = d.withColumn("_suf", F.least("_suf", F.least("_na", "_nb") - F.col("_pre")))
    ends = (F.col("y") < F.col("_pre")) | (F.col("i") < F.col("_suf"))
    d = d.withColumn("_mid", ~ends)
    w = Window.partitionBy(*PAIR, "line")

    def side(k, agg, v):
        return agg(F.when(F.col("_mid") & (F.col("s") == k), v)).over(w)
    once = F.col("_mid") & (side(0, F.count, F.col("y")) == 1) & (side(1, F.count, F.col("y")) == 1)
    other = F.when(F.col("s") == 0, side(1, F.max, F.col("y"))).otherwise(side(0, F.max, F.col("y")))
    d = d.withColumn("_at", F.when(once, other))
    up = Window.partitionBy(*PAIR, "s").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*PAIR, "s").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, -1)
    clear = F.coalesce(F.max("_at").over(up) < F.col("_at"), F.lit(True)) & F.coalesce(F.min("_at").over(down) > F.col("_at"), F.lit(True))
    d = d.withColumn("m", F.when(~F.col("_mid") | (F.col("_at").isNotNull() & clear), 1).otherwise(0))
    return d.select(*PAIR, "s", "y", "line", "m")


def _concat_sorted(order: str, text: str = "text") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "")


def line_diff(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Ordered line diff. Between two matched lines stand the deleted ones, then the
    inserted ones; runs of one kind are merged. Monotone, not always minimal."""
    d = match_lines(pairs, lines)
    so_far = Window.partitionBy(*PAIR, "s").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("g", F.sum("m").over(so_far) - F.col("m"))
    d = d.withColumn("_e", F.max(1 - F.col("m")).over(Window.partitionBy(*PAIR, "g")))
    d = d.where((F.col("m") == 0) | (F.col("s") == 0))
    kind = Window.partitionBy(*PAIR, "s", "m").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_run", F.when(F.col("m") == 1, F.sum("_e").over(kind)))
    d = d.withColumn("g", F.when(F.col("m") == 1, F.min("g").over(Window.partitionBy(*PAIR, "s", "m", "_run"))).otherwise(F.col("g")))
    op = F.when(F.col("m") == 1, 0).when(F.col("s") == 0, -1).otherwise(1)
    return _resequence(d.groupBy(*PAIR, "g", op.alias("op")).agg(_concat_sorted("y", "line").alias("text")))


def _resequence(d: DataFrame) -> DataFrame:
    """Number ops by gap: deleted, inserted, then the equal run."""
    d = d.withColumn("_o", F.when(F.col("op") == -1, 0).when(F.col("op") == 1, 1).otherwise(2))
    return number_rows(d, PAIR, ["g", "_o"], None, "seq").select(*PAIR, "seq", "op", "text")


def diff_text(diffs: DataFrame, side: int) -> DataFrame:
    """Source text (side 1) or target text (side 2) of each pair."""
    keep = F.col("op") <= 0 if side == 1 else F.col("op") >= 0
    return diffs.where(keep).groupBy(*PAIR).agg(_concat_sorted("seq").alias("text"))


def diff_stats(diffs: DataFrame) -> DataFrame:
    """Inserted, deleted, equal characters and the edit distance the diff implies: per
    stretch of edits the larger of its two lengths."""
    n = F.length("text")
    d = scan(diffs, PAIR, ["seq"], None, _run=Scan("sum", F.when(F.col("op") == 0, 1).otherwise(0)))
    r = d.groupBy(*PAIR, "_run").agg(*[F.sum(F.when(F.col("op") == o, n).otherwise(0)).alias(c) for o, c in ((1, "inserted"), (-1, "deleted"), (0, "equal"))])
    return r.groupBy(*PAIR).agg(F.sum("inserted").alias("inserted"), F.sum("deleted").alias("deleted"), F.sum("equal").alias("equal"),
                                F.sum(F.greatest("inserted", "deleted")).alias("distance"))


def with_offsets(diffs: DataFrame) -> DataFrame:
    """Adds start1 and start2: where each op begins in the two texts."""
    n = F.length("text")
    d = scan(diffs, PAIR, ["seq"], None, _e1=Scan("sum", F.when(F.col("op") <= 0, n).otherwise(0)),
             _e2=Scan("sum", F.when(F.col("op") >= 0, n).otherwise(0)))
    return d.select(*PAIR, "seq", "op", "text", (F.col("_e1") - F.when(F.col("op") <= 0, n).otherwise(0)).alias("start1"),
                    (F.col("_e2") - F.when(F.col("op") >= 0, n).otherwise(0)).alias("start2"))


def map_positions(diffs: DataFrame, locs: DataFrame, tile: int = 1024) -> DataFrame:
    """Location in text 1 (a, b, loc) to its location in text 2; inside a deletion its start.
    Behind the end the distance to the end is kept. Places meet ops on text tiles."""
    d = with_offsets(diffs)
    size = d.groupBy(*PAIR).agg(F.sum(F.when(F.col("op") <= 0, F.length("text")).otherwise(0)).alias("_n1"), F.sum(F.when(F.col("op") >= 0, F.length("text")).otherwise(0)).alias("_n2"))
    d = d.where((F.col("op") <= 0) & (F.length("text") > 0)).withColumn("_end", F.col("start1") + F.length("text"))
    d = d.select(*PAIR, "op", "start1", "start2", "_end", F.explode(F.sequence(F.floor(F.col("start1") / tile), F.floor((F.col("_end") - 1) / tile))).alias("_t"))
    l = locs.join(size, PAIR).withColumn("_t", F.floor(F.col("loc") / tile))
    d = d.select(*[F.col(c).alias("d" + c) for c in d.columns])
    hit = (l["a"] == F.col("da")) & (l["b"] == F.col("db")) & (l["_t"] == F.col("d_t")) & (F.col("loc") >= F.col("dstart1")) & (F.col("loc") < F.col("d_end"))
    j = l.join(d, hit, "left")
    inside = F.when(F.col("dop") == -1, F.col("dstart2")).otherwise(F.col("dstart2") + F.col("loc") - F.col("dstart1"))
    return j.select(*PAIR, "loc", F.when(F.col("dop").isNull(), F.col("_n2") + F.col("loc") - F.col("_n1")).otherwise(inside).alias("loc2"))


def diff_html(diffs: DataFrame) -> DataFrame:
    """One HTML string per pair: ins / del / span with escaped text."""
    t = F.col("text")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&para;<br>")):
        t = F.replace(t, F.lit(old), F.lit(new))
    # The markup of each op.
    html = (F.when(F.col("op") == 1, F.concat(F.lit('<ins style="background:#e6ffe6;">'), t, F.lit("</ins>")))
            .when(F.col("op") == -1, F.concat(F.lit('<del style="background:#ffe6e6;">'), t, F.lit("</del>")))
            .otherwise(F.concat(F.lit("<span>"), t, F.lit("</span>"))))
    return diffs.withColumn("text", html).groupBy(*PAIR).agg(_concat_sorted("seq").alias("html"))


# ---- clean-up -------------------------------------------------------------

def merge_diff(diffs: DataFrame) -> DataFrame:
    """Between two equal stretches one deletion and one insertion; touching equal ops and
    empty ones merge away. Input order is ``seq`` (equal seq: deletion first)."""
    d = diffs.where(F.length("text") > 0).withColumn("_eq", F.when(F.col("op") == 0, 1).otherwise(0)).withColumn("_o", F.when(F.col("op") == -1, 0).otherwise(1))
    d = scan(d, PAIR, ["seq", "_o"], None, _p=Scan("prev", F.col("_eq")))
    turn = F.when(F.col("_p").isNull() | (F.col("_p") != F.col("_eq")), 1).otherwise(0)
    d = scan(d.withColumn("_turn", turn), PAIR, ["seq", "_o"], None, g=Scan("sum", F.col("_turn")))
    return _resequence(d.groupBy(*PAIR, "g", "op").agg(_concat_sorted("seq").alias("text")))


def clean_round(diffs: DataFrame, mode: str, edit_cost: int = 4) -> DataFrame:
    """One round: equal ops not worth keeping become a deletion and an insertion.

    semantic: no longer than the larger edit on either side. efficiency: shorter than
    ``edit_cost`` with both kinds of edit on both sides, or shorter than half of it with
    three of the four. Both sides come by equi-join on the number of the equal op."""
    n = F.length("text")
    d = scan(diffs, PAIR, ["seq"], None, _k=Scan("sum", F.when(F.col("op") == 0, 1).otherwise(0)))
    e = d.where("op <> 0").groupBy(*PAIR, "_k").agg(F.sum(F.when(F.col("op") == 1, n).otherwise(0)).alias("_i"), F.sum(F.when(F.col("op") == -1, n).otherwise(0)).alias("_d"))
    before = e.select(*PAIR, (F.col("_k") + 1).alias("_k"), F.col("_i").alias("_i0"), F.col("_d").alias("_d0"))
    after = e.select(*PAIR, "_k", F.col("_i").alias("_i1"), F.col("_d").alias("_d1"))
    j = d.join(before, PAIR + ["_k"], "left").join(after, PAIR + ["_k"], "left")
    both = F.col("_i0").isNotNull() & F.col("_i1").isNotNull()
    if mode == "semantic":
        drop = (n <= F.greatest("_i0", "_d0")) & (n <= F.greatest("_i1", "_d1"))
    elif mode == "efficiency":
        kinds = sum(((F.col(c) > 0).cast("int") for c in ("_i0", "_d0", "_i1", "_d1")), F.lit(0))
        drop = ((n < edit_cost) & (kinds == 4)) | ((n * 2 < edit_cost) & (kinds == 3))
    else:
        raise ValueError(f"unknown mode: {mode}")
    drop = (F.col("op") == 0) & both & F.coalesce(drop, F.lit(False))
    ops = F.explode(F.when(drop, F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.col("op")))).alias("op")
    return merge_diff(j.select(*PAIR, "seq", ops, "text"))


def clean_diff(diffs: DataFrame, mode: str, edit_cost: int = 4) -> DataFrame:
    """Rounds until the number of ops stays the same (one count per round on the driver). A
    round that changes a diff merges ops, so the number falls and the loop ends."""
    from pagescale.session import materialise
    d = materialise(merge_diff(diffs))
    n = d.count()
    while True:
        nxt = materialise(clean_round(d, mode, edit_cost), d)
        m = nxt.count()
        if m == n:
            return nxt
        d, n = nxt, m


# ---- deltas and edits -----------------------------------------------------

# Characters a delta leaves as they are, besides letters, digits and -._
SAFE = "!~*'();/?:@&=+$,# "


def _quote(c: Column) -> Column:
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit(" "))
    for ch in SAFE.replace("*", "").replace(" ", ""):
        c = F.replace(c, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return c


def _unquote(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def to_delta(diffs: DataFrame) -> DataFrame:
    """One string per pair: =n, -n and +text joined by tabs."""
    tok = F.when(F.col("op") == 1, F.concat(F.lit("+"), _quote(F.col("text")))).otherwise(
        F.concat(F.when(F.col("op") == 0, "=").otherwise("-"), F.length("text").cast("string")))
    got = diffs.select(*PAIR, "seq", tok.alias("t")).groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("_l"))
    return got.select(*PAIR, F.array_join(F.transform("_l", lambda s: s["t"]), "\t").alias("delta"))


def from_delta(deltas: DataFrame, text1: DataFrame) -> DataFrame:
    """The diff again from (a, b, delta) and the source texts (a, text); a delta that does
    not consume the whole text is an error."""
    d = deltas.join(text1.select("a", F.col("text").alias("_src")), "a").select(*PAIR, "_src", F.posexplode(F.split("delta", "\t")).alias("seq", "tok"))
    op = F.left("tok", F.lit(1))
    arg = F.substring("tok", 2, 2 ** 31 - 1)
    n = F.when(op == "+", 0).otherwise(arg.try_cast("int"))
    d = scan(d.withColumn("_n", n), PAIR, ["seq"], None, _end=Scan("sum", F.col("_n")), _all=Scan("total", F.col("_n")))
    good = F.col("_all") == F.length("_src")
    text = F.when(op == "+", _unquote(arg)).otherwise(F.substring(F.col("_src"), (F.col("_end") - F.col("_n") + 1).cast("int"), F.col("_n")))
    text = F.when(good, text).otherwise(F.raise_error(F.lit("delta length does not equal source text length")).cast("string"))
    return d.select(*PAIR, (F.col("seq") + 1).cast("bigint").alias("seq"), F.when(op == "+", 1).when(op == "-", -1).otherwise(0).alias("op"), text.alias("text"))


def make_edits(diffs: DataFrame, margin: int = 4) -> DataFrame:
    """Edits (a, b, edit, start1, start2, old, new, before, after). Edits with at most
    2 * margin equal characters between them become one; before and after are up to
    ``margin`` characters of context."""
    d = with_offsets(diffs)
    wide = (F.col("op") == 0) & (F.length("text") > 2 * margin)
    eq = F.when(F.col("op") == 0, F.col("text"))
    d = scan(d, PAIR, ["seq"], None, _g=Scan("sum", F.when(wide, 1).otherwise(0)), _pe=Scan("prev", eq), _ne=Scan("next", eq))
    span = d.where("op <> 0").groupBy(*PAIR, "_g").agg(
        F.min("seq").alias("_lo"), F.max("seq").alias("_hi"), F.min_by("_pe", "seq").alias("_pe"), F.max_by("_ne", "seq").alias("_ne"))
    j = d.select(*PAIR, "_g", "seq", "op", "text", "start1", "start2").join(span, PAIR + ["_g"]).where((F.col("seq") >= F.col("_lo")) & (F.col("seq") <= F.col("_hi")))
    got = j.groupBy(*PAIR, "_g").agg(
        F.min("start1").alias("start1"), F.min("start2").alias("start2"),
        F.array_sort(F.collect_list(F.struct("seq", "op", "text"))).alias("_l"), F.max("_pe").alias("_pe"), F.max("_ne").alias("_ne"))

    def side(keep):
        return F.array_join(F.transform(F.filter("_l", keep), lambda s: s["text"]), "")
    got = got.select(*PAIR, "start1", "start2", side(lambda s: s["op"] <= 0).alias("old"), side(lambda s: s["op"] >= 0).alias("new"),
                     F.coalesce(F.right("_pe", F.lit(margin)), F.lit("")).alias("before"), F.coalesce(F.left("_ne", F.lit(margin)), F.lit("")).alias("after"))
    return number_rows(got, PAIR, ["start1", "start2"], None, "edit").select(*PAIR, "edit", "start1", "start2", "old", "new", "before", "after")


def _coords(start: Column, n: Column) -> Column:
    return F.when(n == 0, F.concat(start, F.lit(",0"))).when(n == 1, (start + 1).cast("string")).otherwise(F.concat(start + 1, F.lit(","), n))


def edits_to_text(edits: DataFrame) -> DataFrame:
    """Unified text per pair: ``@@ -s,l +s,l @@`` and lines ' ', '-', '+' (escaped)."""
    c = F.length("before") + F.length("after")
    head = F.concat(F.lit("@@ -"), _coords(F.col("start1") - F.length("before"), F.length("old") + c), F.lit(" +"),
                    _coords(F.col("start2") - F.length("before"), F.length("new") + c), F.lit(" @@\n"))
    body = [F.when(F.length(n) > 0, F.concat(F.lit(s), _quote(F.col(n)), F.lit("\n"))).otherwise("") for s, n in ((" ", "before"), ("-", "old"), ("+", "new"), (" ", "after"))]
    return edits.withColumn("text", F.concat(head, *body)).groupBy(*PAIR).agg(_concat_sorted("edit").alias("patch"))


def edits_from_text(patches: DataFrame) -> DataFrame:
    """Inverse of :func:`edits_to_text` on (a, b, patch)."""
    pat = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@\n((?:[-+ ][^\n]*\n)*)"
    parts = patches.select(*PAIR, F.posexplode(F.regexp_extract_all("patch", F.lit(pat), F.lit(0))).alias("i", "_p"))

    def num(g):
        return F.regexp_extract("_p", pat, g)

    def start(s, n):
        return F.when(num(n) == "0", num(s).cast("bigint")).otherwise(num(s).cast("bigint") - 1)
    rows = F.filter(F.split(F.regexp_extract("_p", pat, 5), "\n"), lambda r: r != "")

    def of(sign):
        return _unquote(F.array_join(F.transform(F.filter(rows, lambda r: F.left(r, F.lit(1)) == sign), lambda r: F.substring(r, 2, 2 ** 31 - 1)), ""))
    first = F.when(F.left(rows[0], F.lit(1)) == " ", _unquote(F.substring(rows[0], 2, 2 ** 31 - 1))).otherwise("")
    last = F.element_at(rows, -1)
    after = F.when((F.size(rows) > 1) & (F.left(last, F.lit(1)) == " "), _unquote(F.substring(last, 2, 2 ** 31 - 1))).otherwise("")
    d = parts.select(*PAIR, (F.col("i") + 1).cast("bigint").alias("edit"), start(1, 2).alias("_s1"), start(3, 4).alias("_s2"), of("-").alias("old"), of("+").alias("new"),
                     first.alias("before"), after.alias("after"))
    return d.select(*PAIR, "edit", (F.col("_s1") + F.length("before")).alias("start1"), (F.col("_s2") + F.length("before")).alias("start2"), "old", "new", "before", "after")
