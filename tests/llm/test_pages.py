import time

import pytest
from pyspark.sql import functions as F

from inkwell.llm import html_extract, url_filter

LONG = "This paragraph is long enough to count, with commas, and it goes on for a while so that it gets points. "


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


CASES = [
    (None, ""),
    ("", ""),
    ("plain words", "plain words"),
    (page("<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>One &amp; two.</p></article><footer>&copy; x</footer>"), "Title\n\nOne & two."),
    (page("<div class='ad'>Buy, buy, buy, now, or, never</div><article><p>Short.</p></article>"), "Short."),
    (page("<article><p><b>First.<br><p>Second\n  line.</p></article>"), "First.\n\nSecond line."),
    (page(f"<div id='sidebar'><p>{LONG * 3}</p></div><div id='content'><h2>H</h2><p>{LONG}</p><ul><li>a, b</li><li>c</li></ul></div><div class='comments'><p>{LONG * 2}</p></div>"), f"H\n\n{LONG.strip()}\n\na, b\n\nc"),
    (page("<main><p>A<script>var a = '<p>no</p>';</script>b</p><style>p{}</style><form><p>Name</p></form><aside>x</aside><p>C&#233;&lt;&nbsp;d</p></main>"), "Ab\n\nCé< d"),
    (page("<header><h1>Site</h1></header><article><header><h1>Story</h1></header><p>Text.</p><p class='share-buttons'>Share</p></article>"), "Story\n\nText."),
    (page("<article><p>unclosed <i>it<p>next<td>cell</article><p>after"), "unclosed it\n\nnext\n\ncell"),
    (page("<article><p>a &lt;b&gt; &am &quo x < y</p><!-- c <p>no</p> --></article>"), "a <b> &am &quo x < y"),
    (page("<nav>only a menu</nav><script>x"), ""),
    (page("<article><div><p>x</p>loose text<p>y</p></div></article>"), "x\n\nloose text\n\ny"),
]


def test_extraction(spark):
    rows = [(i, "u", html) for i, (html, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Text", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    for i, (_, expected) in enumerate(CASES):
        assert got[i] == expected, i
    assert html_extract.extract(df).columns == ["page_id", "url", "html", "text"]
    assert html_extract.extract(df.limit(0)).count() == 0


HOSTILE = {
    "tags without an end": "<a " * 333_333, "nested": "<div>" * 200_000, "nested with text": "<div>x" * 160_000, "inline before breaks": "<b>" * 100_000 + "x<hr>" * 100_000,
    "ends that close nothing": "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "quotes without an end": "<p title=\"it's>x</p>" * 50_000, "comments": "<!--" * 250_000, "signs": "<" * 1_000_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_a_megabyte_of_anything_takes_seconds(kind):
    began = time.process_time()
    html_extract.main_text(HOSTILE[kind])
    assert time.process_time() - began < 5


def test_no_markup_stays_where_a_quote_is_missing_and_articles_are_whole():
    assert html_extract.main_text("<p title=\"it's>x</p>") == "x"
    assert html_extract.main_text("<p title='a > b < c' class=\"y\">x</p>") == "x"
    long = "<p>long text, with commas, and more of it, again and again</p>" * 30
    got = html_extract.main_text(f"<article><h1>T</h1><div class=content>{long}</div><ul><li>a</li><li>b</li></ul><p>Short end.</p></article>")
    assert got.startswith("T\n\nlong") and got.endswith("again\n\na\n\nb\n\nShort end.")
    assert html_extract.main_text(f"<div class='content no-sidebar'>{long}</div><div class=sidebar-left><p>menu, of, things</p></div>").count("long") == 30
    assert "menu" not in html_extract.main_text(f"<div class='content no-sidebar'>{long}</div><div class=sidebar-left><p>menu, of, things</p></div>")


def test_long_and_deep_pages():
    assert html_extract.main_text(page("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>")).count("\n\n") == 2999
    assert html_extract.main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"


URLS = [
    ("http://A.Example.com/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
    ("http://a.example.com/en/8", "a.example.com", "/en/8", "com/en/", "block"),
    ("https://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
    ("https://x.example.net/de/9#a://b", "x.example.net", "/de/9", "net/de/", "allow"),
    ("ftp://myexample.org/es/", "myexample.org", "/es/", "org/es/", "block"),
    ("http://org/es/1", "org", "/es/1", "org/es/", "block"),
    ("http://xorg/es/1", "xorg", "/es/1", None, "allow"),
    ("http://casino-win.example.net?x=/en/", "casino-win.example.net", "", None, "block"),
    ("http://news.example.org/EN/1", "news.example.org", "/EN/1", None, "allow"),
    ("no scheme.com/en/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://ÄB.com/en/\n1", "Äb.com", "/en/\n1", "com/en/", "block"),
]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("Host", F.lit(0))
    for r in url_filter.judge(df).collect():
        assert (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]]
        assert url_filter.parts(r["url"]) == (r["host"], r["path"])
    assert url_filter.judge(df.limit(0)).count() == 0


def test_model_tells_unseen_hosts_apart(spark):
    bad = ["www.ads-track.example.com", "casino-win.example.net", "m.spam-farm.example.org", "adult-x.example.com", "blog.cheap-pills.example.net", "free-bets.example.net"]
    good = ["tionsh.example.net", "blog.ththth.example.org", "www.garden-notes.example.com", "physics.example.org", "m.therand.example.net"]
    df = spark.createDataFrame([(i, f"https://{h}/xx/{i}") for i, h in enumerate(bad + good)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(df).orderBy("page_id").collect()] == ["block"] * len(bad) + ["allow"] * len(good)
