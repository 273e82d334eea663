"""Main text of web pages by consensus paths of their host.

Every page is read into containers (body, main, article, section, div, td, ...). A container's path is the
chain of its ancestors' tags and classes, digits generalised to #, without positions and ids, so pages of one
template agree on it; containers of one path count as one. Boilerplate is told by tag, role and the words of
class and id. A path scores the prose in it outside boilerplate, times its share of text that is no link, and
somewhat more where tag or class say that it holds an article.

Each page votes for its best path. Votes fold by host and path in Spark; paths with at least one in ``SHARE`` of
their host's votes win (so a host has ``SHARE`` of them at most). The second pass takes on each page, of the winning
paths it has, the one with the largest product of votes and own score; a page that has none, or no host, takes its own best.
The text is every block in the containers of that path, in page order, outside boilerplate.

Markup is read tolerantly, as browsers do: unclosed p, li, td; stray and missing end tags; script, style and the like as
raw text to their end tag; comments. ``br`` is white space. Headings in a header of an article are its own
and stay, other headers go. A form or a box with a suspicious class that holds an article or main element is a
wrapper and stays.

Defined cases: null or blank html gives an empty text; a page with a null url votes for no one; rows are never
joined or folded by id, so repeated and null ids each keep their row; texts are read whole; an empty table gives an
empty result; columns other than id, url and html are not read.
"""

from __future__ import annotations

import functools
import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.session import materialise

SHARE = 64  # a winning path has this part of its host's votes
FEW = 200_000  # winning paths (some 100 bytes each) that are broadcast
SALTS = 16

# Elements of HTML by the way they are read.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary "
                  "table tbody td template tfoot th thead tr ul head svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body main article section div td center".split())
#: An opening tag ends open elements of these names, up to the nearest of the second ones.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)),
    "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ()),
}
# What is not part of an article.
GONE = frozenset("nav footer aside noscript template button select menu dialog fieldset search svg head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments disqus reply replies respond responses commentlist discussion".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted related recommended recommendations outbrain taboola".split())
BOXES = COMMENTS | ADVERTS | frozenset(
    "banner cookie cookies consent gdpr notice notices notification alert announcement paywall popup modal overlay newsletter subscribe subscription signup sidebar aside rail widget menu nav navbar "
    "navigation breadcrumb breadcrumbs masthead topbar footer bottombar copyright share sharing social pagination pager toolbar form login search header".split())
NEGATED = frozenset("no has with without hljs token".split())  # also the parts of highlighted code
HINTS = frozenset("article content post entry story main text body".split())

KEEP, WRAPPER, DROP, HEAD = 0, 1, 2, 3  # what an element itself says of its text

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@functools.lru_cache(maxsize=20_000)
def _kind(name: str, attributes: str) -> tuple[int, str, float]:
    """What an element says of its text, its step in a path, and the weight of its score."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2].strip("\"'").lower())
    classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").split()})
    words = [w for w in re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}") if w]
    said = set() if NEGATED.intersection(words) else set(words)
    step = ".".join([name, *classes])
    if name in ("html", "body"):
        return KEEP, step, 1.0
    if name in ("article", "main"):
        return DROP if said & COMMENTS or said & ADVERTS else KEEP, step, 1.3 if name == "article" else 1.25
    if name in GONE or said & COMMENTS:
        return DROP, step, 1.0
    if name == "header" or (name not in HEADINGS and "header" in said and not said & (BOXES - {"header"})):
        return HEAD, step, 1.0
    if name == "form" or found.get("role") in ROLES or (name not in HEADINGS and said & BOXES):
        return WRAPPER, step, 1.0
    return KEEP, step, 1.15 if said & HINTS else 1.0


class Page:
    """The blocks of a page and the containers they stand in."""

    def __init__(self, source: str | None):
        self.parent, self.path, self.steps, self.weight, self.own, self.held, self.depth = [-1], [0], ["html"], [1.0], [KEEP], [True], [0]
        self.blocks: list[tuple[int, str, int, bool]] = []  # container, text, characters in links, heading
        self._read(source or "")
        state = [KEEP]
        for i in range(1, len(self.parent)):
            up = state[self.parent[i]]
            state.append(DROP if DROP in (up, self.own[i]) or self.own[i] == WRAPPER else HEAD if HEAD in (up, self.own[i]) else KEEP)
        self.state = state
        self.blocks = [b for b in self.blocks if state[b[0]] == KEEP or (state[b[0]] == HEAD and b[3])]

    def _read(self, source: str) -> None:
        stack, opened = [("html", 0, False)], {"html": 1}  # name, container, inline boilerplate
        parts, linked, link, heading, muted = [], 0, None, 0, 0
        articles = wrappers = 0
        at, end = 0, len(source)

        def flush():
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((stack[-1][1], text, min(linked, len(text)), heading > 0))
                parts.clear()
                linked = 0

        def close(depth: int):
            nonlocal heading, articles, wrappers, link, muted
            if len(stack) - 1 > depth or not stack[-1][2]:
                flush()
            while len(stack) > depth:
                name, i, inline = stack.pop()
                opened[name] -= 1
                if inline:
                    muted -= 1
                    continue
                heading -= name in HEADINGS
                articles -= name in ("article", "main")
                wrappers -= self.own[i] == WRAPPER
            if link is not None and link > len(stack):
                link = None

        def close_open(names, stops):
            if any(opened.get(n) for n in names):
                for d in range(len(stack) - 1, 0, -1):
                    if stack[d][0] in names:
                        return close(d)
                    if stack[d][0] in stops:
                        return None

        while at < end:
            m = MARKUP.search(source, at)
            text = source[at : m.start() if m else end]
            if text and not muted:
                if "&" in text:
                    text = entities.unescape(text)
                parts.append(text)
                if link is not None:
                    linked += len(text)
            if not m:
                break
            at = m.end()
            name = m[2].lower() if m[2] else ""
            if not name:
                continue
            if m[1]:
                if name == "a":
                    link = None
                if opened.get(name) and name != "html":
                    d = len(stack) - 1
                    while stack[d][0] != name:
                        d -= 1
                    close(d)
                elif name in BLOCK:
                    flush()
                continue
            if name in RAW:
                stop = ENDS[name].search(source, at)
                at = stop.start() if stop else end
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name == "a":
                link = len(stack)
            own, step, weight = _kind(name, m[3])
            if name not in BLOCK:
                if own != KEEP and not opened.get("pre"):  # boilerplate inside a block: its text goes, the block goes on
                    stack.append((name, stack[-1][1], True))
                    opened[name] = opened.get(name, 0) + 1
                    muted += 1
                continue
            flush()
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in CLOSES:
                close_open(*CLOSES[name])
            if name in ("article", "main") and own == KEEP and wrappers:
                for _, i, _ in stack:
                    if self.own[i] == WRAPPER:
                        self.own[i] = KEEP
                wrappers = 0
            if name in ("html", "body") and opened.get(name):
                continue
            if own == HEAD and not articles:
                own = DROP if name == "header" else WRAPPER
            up = stack[-1][1]
            self.parent.append(up)
            self.own.append(DROP if muted else own)
            self.depth.append(self.depth[up] + 1)
            self.path.append(xxhash.xxh64_intdigest(f"{self.path[up]}>{step}") - 2**63)
            self.steps.append(step)
            self.weight.append(weight)
            self.held.append(name in CONTAINERS)
            stack.append((name, len(self.parent) - 1, False))
            opened[name] = opened.get(name, 0) + 1
            heading += name in HEADINGS
            articles += name in ("article", "main")
            wrappers += self.own[-1] == WRAPPER
        flush()

    def scores(self) -> dict[int, float]:
        """The score of each container path that holds any text."""
        n = len(self.parent)
        prose, linked = [0] * n, [0] * n
        for i, text, link, heading in self.blocks:
            plain = len(text) - link
            prose[i] += plain if heading or plain >= 40 or text[-1] in ".!?:;…。" else plain / 10
            linked[i] += link
        for i in range(n - 1, 0, -1):
            prose[self.parent[i]] += prose[i]
            linked[self.parent[i]] += linked[i]
        total: dict[int, list] = {}
        for i in range(n):
            if self.held[i] and self.state[i] == KEEP and prose[i] + linked[i]:
                own = total.setdefault(self.path[i], [0, 0, self.weight[i]])
                own[0] += prose[i]
                own[1] += linked[i]
        return {p: a * a / (a + b) * w for p, (a, b, w) in total.items()}

    def best(self, votes: dict[int, float] | None = None) -> int | None:
        """The path to take; deeper ones, then earlier ones, come first among equals."""
        found = self.scores()
        if votes and any(p in votes for p in found):
            found = {p: (s + 1) * votes[p] for p, s in found.items() if p in votes}
        top = max(found.values(), default=None)
        tied = {p for p, s in found.items() if s == top}
        first = {p: i for i, p in reversed(list(enumerate(self.path))) if p in tied}
        return max(tied, key=lambda p: (self.depth[first[p]], -first[p]), default=None)

    def label(self, path: int, most: int = 8) -> str:
        """The last steps of a path, to read."""
        i, out = self.path.index(path), []
        while i >= 0 and len(out) < most:
            out.append(self.steps[i])
            i = self.parent[i]
        return ">".join(reversed(out))

    def text(self, path: int | None) -> str:
        if path is None:
            return ""
        inside = []
        for i, p in enumerate(self.path):
            inside.append(p == path or (i > 0 and inside[self.parent[i]]))
        return "\n".join(b[1] for b in self.blocks if inside[b[0]])


def host(url: str = "url"):
    """The lower-case host of a url, null without one."""
    h = F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, n, label) of (host, html): how many pages of a host have their best text at a path."""
    def run(batches):
        for b in batches:
            found = [(h, p.best(), p) for h, p in zip(b.column(0).to_pylist(), map(Page, b.column(1).to_pylist()), strict=True)]
            found = [(h, path, p.label(path)) for h, path, p in found if path is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.string(), pa.int64(), pa.string()), strict=True)], ["host", "path", "label"])

    cast = pages.where(F.col("host").isNotNull()).select("host", "html").mapInArrow(run, "host string, path bigint, label string")
    return cast.groupBy("host", "path").agg(F.count("*").alias("n"), F.min("label").alias("label"))


def winners(cast: DataFrame) -> DataFrame:
    """(host, paths) of the votes: the paths that win, each with its share, at most ``SHARE`` a host."""
    salt = F.pmod("path", F.lit(SALTS).cast("bigint"))  # a host of many different paths is many groups
    total = cast.groupBy("host").agg(F.sum("n").alias("all")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    won = cast.withColumn("salt", salt).join(total, ["host", "salt"]).where(F.col("n") * SHARE >= F.col("all"))
    return won.groupBy("host").agg(F.collect_list(F.struct("path", (F.col("n") / F.col("all")).alias("share"), "label")).alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (id, url, text, n_chars, path)."""
    table = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host())
    won = materialise(winners(materialise(votes(table))))
    if won.agg(F.coalesce(F.sum(F.size("paths")), F.lit(0))).first()[0] <= FEW:
        rows = table.join(F.broadcast(won), "host", "left")
    else:  # a host may hold a third of all pages
        every = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = table.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(every.hint("shuffle_hash"), ["host", "salt"], "left")

    def run(batches):
        for b in batches:
            texts, labels = [], []
            for source, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                page = Page(source)
                path = page.best({w["path"]: w["share"] for w in own} if own else None)
                texts.append(page.text(path))
                labels.append(None if path is None else page.label(path))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(labels, pa.string())], ["id", "url", "text", "n_chars", "path"])

    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    out = rows.select("id", "url", "html", "paths").mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint, path string")
    return out.toDF(id_col, url_col, "text", "n_chars", "path")


def check_sql() -> str:
    """On the given tables every page marks its article with one element of that name, which holds all
    of it; the operator is not told. Blocks end where a p or h1 begins or ends."""
    body = r"regexp_extract(coalesce(html, ''), '<article>((?:.|\n)*?)(?:</article>|$)', 1)"
    plain = rf"regexp_replace(regexp_replace(regexp_replace({body}, '</?(?:p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g')"
    text = f'''replace(replace(replace({plain}, '&quot;', '"'), '&lt;', '<'), '&gt;', '>')'''
    text = rf"regexp_replace({text}, '&amp;?', '&', 'g')"
    return rf"""with t as (select page_id, url, array_to_string(list_filter(list_transform(string_split({text}, chr(1)), lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) t from pages)
select page_id, url, t as "text", cast(length(t) as bigint) n_chars from t"""
