"""What the extraction keeps and drops, and a slow second version over the standard library's parser."""

import time
from html.parser import HTMLParser

import pytest

from inkwell.llm.html_extract import main_text

LONG = ("Some long paragraph, with commas, and words. " * 6).strip()
P = f"<p>{LONG}</p>"


def blocks(page):
    return main_text(page).replace(LONG, "P").split("\n\n")


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        (f'<article><div class="overflow-hidden">{P}</div></article>', ["P"]),
        (f'<article><div class="left-side text">{P}</div></article>', ["P"]),
        (f'<article>{P}<div class="story-share-text"><p>told</p></div></article>', ["P", "told"]),
        (f'<article>{P}<div class="no-sidebar with-comments"><p>told</p></div></article>', ["P", "told"]),
        (f"<body><section>{P}{P}{P}</section><section><h2>Two</h2><p>Short.</p></section></body>", ["P", "P", "P", "Two", "Short."]),
        (f'<body><div class="post">{P}{P}</div><p>Short closing words.</p><ul><li>one</li><li>two</li></ul></body>', ["P", "P", "Short closing words.", "one", "two"]),
        (f"<body><div>{P}{P}</div><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul></body>", ["P", "P"]),
        (f"<article><p>a</p><noscript>{P}</article>", ["a", "P"]),
        (f"<article><svg>{P}<object>{P}</article>", ["P", "P"]),
        ("<article><p>a <svg><text>t</text><svg><text>u</text></svg><text>v</text></svg> b</p><object><object>x</object>y</object><p>c</p></article>", ["a b", "c"]),
        ("<article><p>a<!-- <svg> --> b <svg>x</svg></p><p>c</p></article>", ["a b", "c"]),
        ("<article><p>the sum <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>tex</annotation></math> is big</p></article>", ["the sum x+1 is big"]),
        (f"<body><form action=/><div>{P}{P}</div></form></body>", ["P", "P"]),
        (f"<body><article>{P}</article><form><p>Your name</p><input></form></body>", ["P"]),
        (f"<body><div>{P}<form><label>Mail</label><p>Join us</p></form></div></body>", ["P"]),
        (f'<article>{P}<div class="comment-body"><p>reader</p></div><div class="social-share">s</div><div class="share">t</div><div id="cookie-notice">c</div><div class="side-box">n</div></article>', ["P"]),
        (f'<div class="site-header">H</div><div class="content">{P}</div><div class="footer-links">f</div><div class="widget">w</div>', ["P"]),
        (f'<article><div class="entry-header"><h1>T</h1></div>{P}</article>', ["T", "P"]),
    ],
)
def test_kept(page, kept):
    assert blocks(page) == kept


@pytest.mark.parametrize("unit", ["<svg>", "<object><p>x", "<noscript>a", "<form><p>x", "<div class='a-b c-d'>", "</svg>", "<!-- <svg>", "<math><mi>"])
def test_linear(unit):
    began = time.process_time()
    main_text(unit * 20_000)
    assert time.process_time() - began < 5


class _Plain(HTMLParser):
    """Articles of well-formed pages: everything in <article> in page order, blocks by block tags; menus and the like by tag and class alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = self.dropped = 0
        self.found: list[str] = [""]

    def handle_starttag(self, tag, attributes):
        if tag == "br":
            self.found[-1] += " "
        elif tag in ("script", "style", "nav", "aside", "footer", "form", "title") or dict(attributes).get("class") in ("ad", "comments"):
            self.dropped += 1
        elif tag == "article":
            self.depth += 1
        if tag not in ("b", "i", "a", "em", "br", "span"):
            self.found.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "nav", "aside", "footer", "form", "title") or tag == "div" and self.dropped:
            self.dropped = max(0, self.dropped - 1)
        if tag == "article":
            self.depth -= 1
        if tag not in ("b", "i", "a", "em", "br", "span"):
            self.found.append("")

    def handle_data(self, data):
        if self.depth and not self.dropped:
            self.found[-1] += data


def plain(page):
    parser = _Plain()
    parser.feed(page or "")
    parser.close()
    return "\n\n".join(x for x in (" ".join(b.split()) for b in parser.found) if x)


def test_the_pages_against_a_second_version(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert len(pages) >= 50 and [main_text(p) for p in pages] == [plain(p) for p in pages]


def test_written_pages_against_a_second_version():
    for k in range(60):
        inner = "".join(f"<{t}>w{k} &amp; {i} <b>x</b><br>y</{t}>" for i, t in enumerate(("h1", "p", "blockquote", "pre", "h2", "p")[: k % 6 + 1]))
        extra = ("", "<div class=ad>no</div>", "<aside>no</aside>", "<div class=comments>no</div>", "<form><p>no</p></form>")[k % 5]
        page = f"<html><head><title>t</title></head><body><nav>m</nav><article>{inner}{extra}</article><footer>f</footer></body></html>"
        assert main_text(page) == plain(page) and "no" not in main_text(page)
