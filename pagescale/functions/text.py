"""Text operators: normalisation, projection, tokens, codes. Column in, Column out."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale.session import small_batches

# Homograph clean-up, in order; each character of the first string
# becomes the second. No result is itself the source of a later entry.
REPLACEMENTS = [
    ("_~#", "~"),
    ('"', "''"),
    ("`", "'"),
    ("“”", "''"),
    ("´", "'"),
    ("‘’", "'"),
    ("„", ",,"),
    ("…", "..."),
    ("′", "'"),
    ("″", "''"),
    ("‴", "'''"),
    ("〃", "''"),
    ("µ", "μ"),
    ("–—", "-"),
    ("ﬂ", "fl"),
    ("ﬁ", "fi"),
    ("ﬀ", "ff"),
    ("ﬃ", "ffi"),
    ("ﬄ", "ffl"),
]

# Fixed value: texts that normalising leaves alone, single blanks between characters that are on no list.
CLEAN = r"\A(?:[!$-^a-~]++ )*+[!$-^a-~]++\z"

# What each projection deletes.
PROJECTIONS = {
    "exact": None,
    "nospace": r"\s",
    "spletdig": "[^A-Za-z0-9 ]",
    "letdig": "[^A-Za-z0-9]",
    "letters": "[^A-Za-z]",
    "digits": "[^0-9]",
    "lnc": "[^A-Z]",
}

# Size class of a character, first match wins.
SIZE_CLASSES = [
    ("x", "acemnorsuvwxyz"),
    ("k", "ABCDEFGHIJKLMNOPQRSTUVWXYZbdfhklt!?"),
    ("y", "gpqy"),
    (".", ".,"),
    ("'", "'\"`"),
]

# Groups of characters that recognisers mix up; the first stands for all.
CONFUSABLE = ["cC", "l1I|/", "oO0", "sS", "uU", "vV", "wW", "xX", "zZ", ",'.`"]

# Character sets.
CHARSETS = {
    "digits": "0123456789",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "symbols": "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~",
    "xsymbols": "€¢£»«›‹÷©®†‡°∙•◦‣¶§÷¡¿▪▫",
    "german": "ÄäÖöÜüß",
    "french": "ÀàÂâÆæÇçÉéÈèÊêËëÎîÏïÔôŒœÙùÛûÜüŸÿ",
    "turkish": "ĞğŞşıſ",
    "greek": "ΑαΒβΓγΔδΕεΖζΗηΘθΙιΚκΛλΜμΝνΞξΟοΠπΡρΣσςΤτΥυΦφΧχΨψΩω",
    "portuguese": "ÁÃÌÍÒÓÕÚáãìíòóõú",
    "telugu": " ఁంఃఅఆఇఈఉఊఋఌఎఏఐఒఓఔకఖగఘఙచఛజఝఞటఠడఢణతథదధనపఫబభమయరఱలళవశషసహఽాిీుూృౄెేైొోౌ్ౘౙౠౡౢౣ౦౧౨౩౪౫౬౭౮౯",
}
CHARSETS["default"] = "".join(CHARSETS[n] for n in ("digits", "letters", "symbols", "xsymbols", "german", "french", "portuguese"))
CHARSETS["european"] = CHARSETS["default"] + CHARSETS["turkish"] + CHARSETS["greek"]


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_form(col, form: str) -> Column:
    """NFC or NFKC. Spark 4.1 has no built-in for it: an Arrow UDF changes the
    rows that hold a character the form can change; the others pass it as nulls and are taken as they are."""
    col = _as_col(col)
    floor = {"NFC": "[^\\x{0}-\\x{2FF}]", "NFKC": "[^\\x{0}-\\x{9F}]"}[form]

    @F.arrow_udf("string")
    def to_form(s: pa.Array) -> pa.Array:
        if s.null_count == len(s):
            return s
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in s.to_pylist()], pa.string())

    return F.coalesce(to_form(F.when(col.rlike(floor), col)), col)


def normalize_nfkc(col) -> Column:
    return unicode_form(col, "NFKC")


def clean_homographs(col) -> Column:
    """The replacement list: one ``translate`` for one-to-one entries, ``replace`` for the rest."""
    col = _as_col(col)
    one = [(c, r) for chars, r in REPLACEMENTS if len(r) == 1 for c in chars]
    col = F.translate(col, "".join(c for c, _ in one), "".join(r for _, r in one))
    for chars, r in REPLACEMENTS:
        if len(r) > 1:
            for c in chars:
                col = F.replace(col, F.lit(c), F.lit(r))
    return col


def normalize_text(col, nfc: bool = True) -> Column:
    """NFC, whitespace runs to one blank, trimmed ends, homographs cleaned up. Texts that hold
    nothing to change are told by one pattern and taken as they are."""
    raw = _as_col(col)
    col = unicode_form(raw, "NFC") if nfc else raw
    col = F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.when(raw.rlike(CLEAN), raw).otherwise(clean_homographs(F.trim(col)))


def project_text(col, kind: str = "exact", nfc: bool = True) -> Column:
    """Normalise, fold dot rows to four dots, drop ``~`` and ``_``, keep one class of
    characters. '#' has become '~' by then, so it vanishes too."""
    if kind not in PROJECTIONS:
        raise ValueError(f"unknown normalization: {kind}")
    col = normalize_text(col, nfc)
    col = F.regexp_replace(col, " *+(?:[.] *+){4,}+", "....")
    col = F.translate(col, "~_", "")
    if kind == "lnc":
        col = F.upper(col)
    drop = PROJECTIONS[kind]
    return col if drop is None else F.regexp_replace(col, drop, "")


def requote(col) -> Column:
    return F.replace(_as_col(col), F.lit("''"), F.lit('"'))


def requote_fancy(col, germanic: bool = False) -> Column:
    """Typographic quotes from straight ones; the blanks at a quote are eaten."""
    col = _as_col(col)
    # Fixed values: (mark, shape after blanks, shape before blanks, low mark, low shape)
    shapes = [("''", "”", "“", ",,", "„"), ("'", "’", "‘", ",", "‚")] if germanic else \
             [("''", "“", "”", ",,", "„"), ("'", "‘", "’", ",", "‚")]
    for mark, opening, closing, low, low_shape in shapes:
        for pattern, shape in ((rf"\s+{mark}", opening), (rf"{mark}\s+", closing), (rf"\s+{low}", low_shape)):
            col = F.regexp_replace(col, pattern, shape)
    return col


def char_of(code: Column) -> Column:
    """Character of a code point (``chr`` stops at 255)."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")


def merge_voicing(col) -> Column:
    """Join detached kana voicing marks to the character before: U+3099 adds 1 to it,
    U+309A adds 2. Marks at the start are dropped. After several marks in a row the
    last one counts from the mark before it, as the original rule does."""
    marks = "゙゚"
    toks = F.regexp_extract_all(_as_col(col), F.lit(f"[^{marks}][{marks}]*"), F.lit(0))

    def join(t):
        last = F.right(t, F.lit(1))
        before = F.left(F.right(t, F.lit(2)), F.lit(1))
        return F.when(F.length(t) == 1, t).otherwise(char_of(F.ascii(before) + F.when(last == "゙", 1).otherwise(2)))

    return F.array_join(F.transform(toks, join), "")


def gt_explode(col) -> Column:
    """Tokens of a ground-truth string: ``_ab_`` is one token, other characters stand alone."""
    toks = F.regexp_extract_all(_as_col(col), F.lit(r"_.{1,4}_|[\s\S]"), F.lit(0))

    def clean(t):
        t = F.when(F.length(t) > 1, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        return F.translate(t, "\x01\x02", "_\\")

    return F.transform(toks, clean)


def gt_implode(col) -> Column:
    """Inverse of :func:`gt_explode`; a token longer than 4 is an error."""
    def wrap(t):
        return (F.when(t == "_", F.lit("___"))
                .when(F.length(t) <= 1, t)
                .when(F.length(t) <= 4, F.concat(F.lit("_"), t, F.lit("_")))
                .otherwise(F.raise_error(F.concat(F.lit("cannot create ground truth transcription for: "), t)).cast("string")))
    return F.array_join(F.transform(_as_col(col), wrap), "")


def valid_class_label(col, printable_ascii: bool = False) -> Column:
    """No control characters or blank; with ``printable_ascii`` nothing outside ! to ~."""
    return ~_as_col(col).rlike(r"[^\x21-\x7e]" if printable_ascii else r"[\x00-\x20]")


def size_category(col) -> Column:
    """Size class of a single character, NULL for none."""
    col = _as_col(col)
    out = None
    for name, chars in SIZE_CLASSES:
        hit = (F.length(col) == 1) & F.lit(chars).contains(col)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def fold_confusables(col) -> Column:
    src = "".join(g[1:] for g in CONFUSABLE)
    dst = "".join(g[0] * (len(g) - 1) for g in CONFUSABLE)
    return F.translate(_as_col(col), src, dst)


def charset_profile(df: DataFrame, ch: str, keys: list[str]) -> DataFrame:
    """Characters of each set per key: count, distinct members seen. Counts characters
    first (partial aggregation), then asks for membership of the distinct ones."""
    df = df.groupBy(*keys, F.col(ch).alias("_ch")).agg(F.count("*").alias("_n"))
    member = F.array_compact(F.array(*[F.when(F.lit(chars).contains(F.col("_ch")), F.lit(n)) for n, chars in CHARSETS.items()]))
    return df.select(*keys, "_ch", "_n", F.explode(member).alias("charset")).groupBy(*keys, "charset").agg(
        F.sum("_n").alias("n"), F.count("*").alias("distinct_chars"))


def split_bylen(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose text is at least ``n`` long become pieces of ``n``; adds ``piece`` from 0."""
    c = F.col(col)
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(n))
    parts = F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(n)))).otherwise(F.array(c))
    rest = [x for x in df.columns if x != col]
    return df.select(*rest, F.posexplode(parts).alias("piece", col))


def combine_lines(df: DataFrame, keys, order: str, col: str, n: int, sep: str = "") -> DataFrame:
    """Join each ``n`` consecutive lines (``order`` counts from 0 in a key); the
    unfilled rest is dropped, every full group stays."""
    df = df.withColumn("grp", F.floor(F.col(order) / n))
    got = df.groupBy(*keys, "grp").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct(order, col))).alias("_l"))
    return got.where(F.col("_n") == n).select(*keys, "grp", F.array_join(F.transform("_l", lambda s: s[col]), sep).alias(col))


# ---- ligature codes -------------------------------------------------------

# Members of the code table and the first code of the multi-character part.
LIG_COMMON = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'\".,:;?!"
LIG_DOUBLES = ["oo", "OO", "00", "ff", "mm"]
LIG_GERMAN = "ÄÖÜäöüß"
LIG_BASE = 0x200000
LIG_TOKEN = (f"(?:{'|'.join(LIG_DOUBLES)})[{LIG_COMMON}]|~{{2,4}}|[{LIG_COMMON}{LIG_GERMAN}][{LIG_COMMON}]"
             f"|[{LIG_COMMON}]-|-[{LIG_COMMON}]|[\\s\\S]")


def ligature_table(spark: SparkSession) -> DataFrame:
    """(name, code) of the multi-character tokens, about 5,900 rows by rule."""
    groups = [["~~"], ["~~~"], ["~~~~"]]
    for firsts in (LIG_COMMON, LIG_DOUBLES, LIG_GERMAN):
        groups += [[a + b] for a in firsts for b in LIG_COMMON]
    groups += [[c + "-", "-" + c] for c in LIG_COMMON]
    rows = [(name, LIG_BASE + i, j) for i, names in enumerate(groups) for j, name in enumerate(names)]
    return spark.createDataFrame(rows, "name string, code bigint, seq bigint")


def _each(values: pa.ListArray, of, kind: pa.DataType) -> pa.ListArray:
    """Lists with ``of`` put for each value, worked out once a batch for each different one."""
    flat = values.flatten().dictionary_encode()
    new = pa.array([None if v is None else of(v) for v in flat.dictionary.to_pylist()], kind).take(flat.indices)
    ends = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), new)


def encode_ligatures(df: DataFrame, col: str, keep: list[str], table: DataFrame | None = None,
                     token: str = LIG_TOKEN, nested: bool = False) -> DataFrame:
    """Tokens, longest first, with their code: (keep, pos, token, code). Tokens outside
    the table are single characters coded by their code point. The table has a fixed
    size, so broadcasting it is safe. ``nested`` gives a row per text that has tokens, (keep, tokens, codes) in their order:
    a text's tokens need not be gathered again. Names of the table must then differ."""
    table = ligature_table(df.sparkSession) if table is None else table
    toks = F.regexp_extract_all(col, F.lit(token), F.lit(0))
    if not nested:
        toks = df.select(*keep, F.posexplode(toks).alias("pos", "token"))
        return toks.join(F.broadcast(table), F.col("token") == F.col("name"), "left").select(
            *keep, "pos", "token", F.coalesce("code", F.ascii("token").cast("bigint")).alias("code"))
    rows = table.where("name is not null").select("name", "code").collect()
    known = {r["name"]: r["code"] for r in rows}
    if len(known) < len(rows):
        raise ValueError("a name has two codes")

    @F.arrow_udf("array<bigint>")
    def code(tokens: pa.Array) -> pa.Array:
        def of(t):
            c = known.get(t)
            return c if c is not None else ord(t[0]) if t else 0
        return _each(tokens, of, pa.int64())

    return small_batches(df).select(*keep, toks.alias("tokens")).where(F.size("tokens") > 0).select(*keep, "tokens", code("tokens").alias("codes"))


def decode_ligatures(df: DataFrame, keep: list[str], table: DataFrame | None = None, nested: bool = False) -> DataFrame:
    """Adds ``name``: the table's (last one for a shared code), '~' below 0, the
    character of the code point below 0x10000, else NULL. ``nested`` adds ``names`` to rows with ``codes`` in an array."""
    table = ligature_table(df.sparkSession) if table is None else table
    names = table.groupBy("code").agg(F.max_by("name", "seq").alias("name"))
    # Names of the control codes.
    fixed = {0: "", 2: "<RHO>", 3: "<SIG>", 4: "<PHI>"}
    if nested:
        known = {r["code"]: r["name"] for r in names.where("code is not null and name is not null").collect()}

        @F.arrow_udf("array<string>")
        def name(codes: pa.Array) -> pa.Array:
            return _each(codes, lambda c: "~" if c < 0 else fixed.get(c, known.get(c, chr(c) if c < 0x10000 else None)), pa.string())

        return small_batches(df).select(*keep, "codes", name("codes").alias("names"))
    code = F.col("code")
    control = F.coalesce(*[F.when(code == c, n) for c, n in fixed.items()])
    return df.join(F.broadcast(names), "code", "left").select(
        *keep, "code", F.coalesce(F.when(code < 0, F.lit("~")), control, F.col("name"),
                                  F.when(code < 0x10000, char_of(F.greatest(code, F.lit(0))))).alias("name"))


def line_codes(df: DataFrame, keys, order, line: str) -> DataFrame:
    """One code per distinct line of a key's texts, from 1 in order of first place:
    (keys, line, code, copies). Copies fold before anything is ranked."""
    from pagescale.operators.blocks import number_rows
    first = df.groupBy(*keys, line).agg(F.min(F.struct(*order)).alias("_f"), F.count("*").alias("copies"))
    return number_rows(first, keys, ["_f"], None, "code").select(*keys, line, "code", "copies")


# ---- pair functions -------------------------------------------------------

def common_prefix_len(a, b) -> Column:
    """Number of equal leading characters: first index where the characters differ."""
    a, b = _as_col(a), _as_col(b)
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(n == 0, F.lit(0)).when(first == 0, n).otherwise(F.least(first - 1, n)).cast("bigint")


def common_suffix_len(a, b) -> Column:
    return common_prefix_len(F.reverse(_as_col(a)), F.reverse(_as_col(b)))


SHORT = 64  # overlap lengths that are all tried in the JVM


def overlap_len(a: str, b: str) -> int:
    """Longest suffix of ``a`` that is a prefix of ``b``: how far ``b`` is matched when ``a`` ends, with the
    borders of b's beginnings to fall back on, so in one pass over each."""
    n = min(len(a), len(b))
    a, b = a[len(a) - n :], b[:n]
    border, k = [0] * n, 0
    for i in range(1, n):
        while k and b[i] != b[k]:
            k = border[k - 1]
        k += b[i] == b[k]
        border[i] = k
    k = 0
    for c in a:
        while k and c != b[k]:
            k = border[k - 1]
        k += c == b[k]
    return k


def common_overlap_len(a, b) -> Column:
    """Longest suffix of ``a`` that is a prefix of ``b``. Where the shorter one has ``SHORT`` characters at most, all
    lengths are tried in the JVM; longer pairs go to an Arrow function that takes linear time. 0 where one is null."""
    a, b = _as_col(a), _as_col(b)
    n = F.least(F.length(a), F.length(b))
    sizes = F.filter(F.sequence(n, F.lit(0)), lambda k: F.right(a, k) == F.left(b, k))

    @F.pandas_udf("bigint")
    def of_long(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else overlap_len(s, t) for s, t in zip(x, y, strict=True)], dtype="Int64")

    long = of_long(F.when(n > SHORT, a), F.when(n > SHORT, b))
    return F.coalesce(F.when(n > SHORT, long).when(n > 0, F.get(sizes, F.lit(0))), F.lit(0)).cast("bigint")


def clean_names(col) -> Column:
    return F.regexp_replace(_as_col(col), "[ ()]", "_")


def strip_names(col) -> Column:
    return F.regexp_replace(_as_col(col), r"\s", "")


# ---- JIS codes ------------------------------------------------------------

def jis_plane() -> list[tuple[str, str]]:
    """(code, character) of the 94 x 94 plane, by the public ISO-2022-JP codec."""
    rows = []
    for hi in range(0x21, 0x7F):
        for lo in range(0x21, 0x7F):
            try:
                rows.append((f"{hi:02x}{lo:02x}", (b"\x1b$B" + bytes([hi, lo])).decode("iso2022_jp")))
            except UnicodeDecodeError:
                continue
    return rows


def jis_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(jis_plane(), "jis string, ch string")


def jis_to_unicode(df: DataFrame, code: str, extra: DataFrame | None = None) -> DataFrame:
    """Adds ``ch`` for a 4-digit hex JIS code: the plane's character, else that of the
    user's ``extra`` (jis, ch) table, else ''. Both tables are at most 94 x 94 rows."""
    plane = F.broadcast(jis_table(df.sparkSession))
    out = df.withColumn("_j", F.lower(code)).join(plane.withColumnRenamed("jis", "_j"), "_j", "left")
    if extra is not None:
        out = out.join(extra.select(F.lower("jis").alias("_j"), F.col("ch").alias("_x")), "_j", "left") \
            .withColumn("ch", F.coalesce("ch", "_x")).drop("_x")
    return out.withColumn("ch", F.coalesce("ch", F.lit(""))).drop("_j")
