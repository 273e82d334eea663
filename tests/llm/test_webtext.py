"""Main text: planted articles, a plain vote, tolerant reading, defined cases."""

import random
from collections import Counter

import pytest

from pagescale.llm import webtext
from pagescale.llm.webtext import Page

WORDS = "river stone market winter garden letter window copper silver morning shadow paper engine harbour valley".split()


def sentence(rnd, n=14):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def planted(rnd, template, i):
    """(html, expected text) of one page of a template."""
    paras = [sentence(rnd, rnd.randint(8, 40)) for _ in range(rnd.randint(2, 7))]
    title = f"{rnd.choice(WORDS)} & {rnd.choice(WORDS)} {i}"
    body = "".join(f"<p>{p}</p>" for p in paras)
    text = "\n".join([title, *paras])
    links = "".join(f'<li><a href="/{w}">{w} {sentence(rnd, 3)}</a></li>' for w in WORDS)
    heading = f"<h1>{title.replace('&', '&amp;')}</h1>"
    if template == 0:  # unlabelled columns: only links tell them apart
        return f'<html><body class="no-sidebar p{i}"><div class="c1"><ul>{links}</ul></div><div class="c2 id-{i}">{heading}{body}</div><div class="c3">{links}</div></body></html>', text
    if template == 1:  # the page wrapped in a form; comments as articles; advert and notice inside the article
        extra = '<div class="ad-box">Buy copper now, buy silver now, everything must go today.</div><div id="cookie-notice"><p>We use cookies on every window of this site.</p></div>'
        comments = "".join(f'<article class="comment"><p>{sentence(rnd, 30)}</p></article>' for _ in range(9))
        return f'<body><form action="/x"><header><h1>Site</h1>{links}</header><main><article><header>{heading}</header>{extra}{body}</article><section id="comments">{comments}</section></main></form><footer>Copyright</footer></body>', text
    # table layout, end tags left out, upper case, a script that looks like markup
    loose = "".join(f"<P>{p}" for p in paras)
    return f'<TABLE><TR><TD class=left><a href=x>{links}</a><TD class=mid>{heading}{loose}<TD class=right><script>var t="</p><article>";</script><ul>{links}</ul></TABLE>', text


def rows_of(rnd, n=60):
    rows = []
    for t in range(3):
        for i in range(n):
            html, text = planted(rnd, t, i)
            rows.append((len(rows), f"http://h{t}.example.com:80/a/{i}?q#f", html, text))
    return rows


def test_planted_articles_come_back_whole(spark):
    rows = rows_of(random.Random(3))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in webtext.main_text(df).collect()}
    for i, url, _, text in rows:
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, text, len(text)), (i, got[i])


def test_host_decides_where_a_page_alone_would_err(spark):
    rnd = random.Random(5)
    page = lambda body, box: f'<body><div class="story">{body}</div><div class="x{rnd.choice("abcdefgh")}y">{box}</div></body>'
    rows = [(i, "http://one.example.org/", page("".join(f"<p>{sentence(rnd, 40)}</p>" for _ in range(5)), "<p>Short one.</p>")) for i in range(80)]
    odd = page("<p>Only this.</p>", "".join(f"<p>{sentence(rnd, 40)}</p>" for _ in range(2)))
    rows.append((99, "http://one.example.org/odd", odd))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in webtext.main_text(df).collect()}
    assert got[99] == "Only this."
    alone = {r["page_id"]: r["text"] for r in webtext.main_text(df.where("page_id = 99").drop("url").selectExpr("page_id", "cast(null as string) url", "html")).collect()}
    assert alone[99] != "Only this."


def test_votes_and_winners_are_those_of_a_plain_count(spark, monkeypatch):
    rows = rows_of(random.Random(7), 40) + [(1000 + i, "http://h0.example.com/z", f'<body><div class="k{c}"><p>{"word " * 20}.</p></div></body>', "") for i, c in enumerate("abbcccdddd")]
    df = spark.createDataFrame([(r[1], r[2]) for r in rows], "url string, html string").withColumn("host", webtext.host())
    want = Counter((r[1].split("/")[2].split(":")[0], Page(r[2]).best()) for r in rows)
    cast = webtext.votes(df)
    assert {(r["host"], r["path"]): r["n"] for r in cast.collect()} == dict(want)
    monkeypatch.setattr(webtext, "SHARE", 20)
    total = Counter()
    for (h, _), n in want.items():
        total[h] += n
    won = {(r["host"], w["path"]) for r in webtext.winners(cast).collect() for w in r["paths"]}
    assert won == {(h, p) for (h, p), n in want.items() if n * 20 >= total[h]} and len(won) < len(want)


def test_many_winners_meet_their_pages_by_a_salted_join(spark, monkeypatch):
    rows = rows_of(random.Random(9), 10)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    want = sorted(webtext.main_text(df).collect())
    monkeypatch.setattr(webtext, "FEW", 0)
    assert sorted(webtext.main_text(df).collect()) == want


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), (" \n ", ""), ("plain & simple", "plain & simple"), ("<p>one<p>two", "one\ntwo"), ("a<br>b<br/>c", "a b c"),
    ("<div>x&nbsp;&eacute;&#8364; &lt;b&gt;</div>", "x é€ <b>"), ("<p>fo<b>ob</b>ar</p><!-- <p>no</p> -->", "foobar"), ("<p>a</p><!-- open <p>b</p>", "a"),
    ("<p>5 < 6 and 7 > 2</p>", "5 < 6 and 7 > 2"), ("<p title=it's>a</p><p title='x>y'>b</p>", "a\nb"), ("<p>a</p><div class='", "a"), ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<script>x</script><p>y</p><style>z", "y"), ("<title>t</title><h1>h</h1>", "h"), ("<nav>n</nav><p>a</p></nav></div></p>", "a"), ("<pre>a  b\n c</pre>", "a b c"),
    ("<p>Read <span class='ad'>BUY</span> on. <code>x</code></p>", "Read on. x"), ("<p>a <a class='share' href='#'>tweet</a> b</p>", "a b"),
    ("<article><header><h1>T</h1><p>menu</p></header><p>b</p><footer>f</footer></article>", "T\nb"), ("<header><h1>Site</h1></header><p>b</p>", "b"),
    ("<body><div class='with-sidebar'><p>kept</p></div></body>", "kept"), ("<pre><span class='comment'># c</span> x</pre>", "# c x"),
])
def test_reading(html, text):
    page = Page(html)
    assert page.text(page.best()) == text


def test_long_and_deep_pages():
    deep = Page("<div>" * 50_000 + "<p>core</p>")
    assert deep.text(deep.best()) == "core"
    long = " ".join(f"w{i}" for i in range(300_000))
    page = Page(f"<nav>x</nav><article><p>{long}</p></article>")
    assert page.text(page.best()) == long


def test_defined_cases(spark):
    kind = "path string, page_id long, url string, html string, host string, paths string, label string, n int, salt int"
    page = "<nav>x</nav><article><p>text</p></article>"
    rows = [("p", 1, "http://a/", page, "h", "q", "l", 1, 1), ("p", 1, "http://a/", page, "h", "q", "l", 1, 1), (None, None, None, page, None, None, None, None, None), (None, 2, "not a url", None, None, None, None, None, None), (None, 3, "http://b/", "", None, None, None, None, None)]
    got = webtext.main_text(spark.createDataFrame(rows, kind))
    assert got.columns == ["page_id", "url", "text", "n_chars", "path"]
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got.collect()) == [("1", "text", 4), ("1", "text", 4), ("2", "", 0), ("3", "", 0), ("None", "text", 4)]
    assert webtext.main_text(spark.createDataFrame([], kind)).collect() == []
