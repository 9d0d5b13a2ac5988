import html
import re

import numpy as np
import pytest
import duckdb
from pyspark.sql import functions as F

from shelfweave.llm.html_extraction import extract_pages, main_text, smoothed

BODY = "This is a long sentence of the article, with enough words to count as text. " * 3
CASES = {
    "landmarks": ("<header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><article><header><h1>Title</h1>"
                  f"<div class=meta-nav>x</div></header><p>{BODY}<p>Short.<aside>ad</aside><footer>tags</footer></article>"
                  "<section id=comments><article>Nice post, thank you very much</article></section></main>"
                  "<footer>&copy; 2020</footer>", ["Title", BODY, "Short."]),
    "plain divs": (f"<div class='top-menu'><a>A</a> <a>B</a></div><div id=content><h2>Head</h2><div>{BODY}</div>"
                   f"<ul><li>one<li>two</ul><div>{BODY}</div></div><div class='cookie-notice'>We use cookies</div>",
                   ["Head", BODY, "one", "two", BODY]),
    "entities and breaks": ("<article><p>a &lt;b&gt; &amp;amp; &#233;&eacute;<br>next\n\t line &nbsp;x</article>",
                            ["a <b> &amp; éé next line x"]),
    "scripts and forms": (f"<article><p>{BODY}</p><script>var a='<p>no</p>'</script><style>p{{}}</style><form><input>"
                          "<label>Name</label></form><!-- c --><noscript>no</noscript></article>", [BODY]),
    "inline script": ("<article><p>a<script>no</script>b <span class=ad>no</span>c</p></article>", ["ab c"]),
    "hidden": (f"<article><p hidden>no</p><p style='display: none'>no</p><p>{BODY}</article>", [BODY]),
    "unclosed menu": (f"<nav><ul><li><a>x</a><article><p>{BODY}</p></article>", [BODY]),
    "no markup": ("just text", ["just text"]),
    "empty": ("", []), "only boilerplate": ("<nav>a</nav><footer>b</footer>", []),
}

LONG = "A paragraph of the main article, which goes on for a good while before it ends. " * 12
SEVERAL_ARTICLES = {
    "second part": (f"<article><p>{LONG}</p></article><article><p>{BODY}</p><p>{BODY}</p><p>The end.</p></article>",
                    [LONG, BODY, BODY, "The end."]),
    "three equal parts": (f"<article><p>{BODY}</p></article>" * 3, [BODY] * 3),
    "text beside a nested one": (f"<main><h1>Title</h1><p>{BODY}</p><article><p>{BODY}</p><p>{BODY}</p></article></main>",
                                 ["Title", BODY, BODY, BODY]),
    "title above a nested one": (f"<main><h1>Title</h1><article><p>{LONG}</p><ul><li><a>Source</a></ul></article>"
                                 "<ul><li><a>Next story</a><li><a>Older story</a></ul></main>", ["Title", LONG, "Source"]),
    "an article of links only": ("<article><p><a>one</a></p><p><a>two</a></p></article>", ["one", "two"]),
}


@pytest.mark.parametrize("name", SEVERAL_ARTICLES)
def test_all_article_elements_count(name):
    page, blocks = SEVERAL_ARTICLES[name]
    assert main_text(page) == "\n\n".join(" ".join(b.split()) for b in blocks)

SOME = "A plain paragraph of the article of middling length, as most of them are. "
MENU = "<div class=x1><ul><li><a>Home</a><li><a>News</a><li><a>Sports</a><li><a>About us</a></ul></div>"
SHORT_PARTS = [f"{SOME} Number {i}." for i in range(12)]
PLAIN_PARTS = "".join(f"<p>{s}</p>" for s in SHORT_PARTS)
WITHOUT_ARTICLE = {
    "one dominating paragraph": (f"{MENU}<div class=content><h1>Title</h1><p>{SOME * 150}</p>{PLAIN_PARTS}<p>End.</p></div>{MENU}",
                                 ["Title", SOME * 150, *SHORT_PARTS, "End."]),
    "a dominating part": (f"{MENU}<div><h1>Title</h1><div><p>{SOME * 150}</p></div><div>{PLAIN_PARTS}<p>End.</p></div></div>{MENU}",
                          ["Title", SOME * 150, *SHORT_PARTS, "End."]),
    "sibling divs, 85 and 15 percent": (f"{MENU}<h1>Title</h1><div class=a>{f'<p>{BODY}</p>' * 17}</div><div class=b>"
                                        f"{f'<p>{BODY}</p>' * 3}<p>End.</p></div>{MENU}", ["Title", *[BODY] * 20, "End."]),
    "a short article element beside": (f"<div class=c><h1>Title</h1>{f'<p>{BODY}</p>' * 9}</div>{MENU}<article><p>{SOME}</p></article>",
                                       ["Title", *[BODY] * 9, SOME]),
}


@pytest.mark.parametrize("name", WITHOUT_ARTICLE)
def test_regions_stay_whole_without_article_element(name):
    page, blocks = WITHOUT_ARTICLE[name]
    assert main_text(page) == "\n\n".join(" ".join(b.split()) for b in blocks)


NAMED_PARTS = {
    "a heading": (f"<h2 id='related-work'>Related work</h2><p>{BODY}</p>", ["Related work", BODY]),
    "a section": (f"<section id='discussion'><h2>Discussion</h2><p>{BODY}</p><p>So it goes.</p></section>", ["Discussion", BODY, "So it goes."]),
    "a paragraph": ("<p class='reply'>He gave a reply that nobody had expected of him, and left the room.</p>",
                    ["He gave a reply that nobody had expected of him, and left the room."]),
    "a div": (f"<div id='social-impact'><p>{BODY}</p></div>", [BODY]),
    "two words": (f"<div id='cookie-recipes'><p>{BODY}</p></div>", [BODY]),
    "an advert": (f"<div class='ad-box'><p>{BODY}</p></div>", []),
    "comments": (f"<section id='comments'><div class='comment'><p>{BODY}</p></div></section>", []),
    "links": ("<div class='share-links'><a>Share this story with all your friends</a> <a>Send it by mail</a></div>", []),
}


@pytest.mark.parametrize("name", NAMED_PARTS)
def test_names_inside_an_article(name):
    part, blocks = NAMED_PARTS[name]
    page = f"{MENU}<article><h1>Title</h1><p>{BODY}</p>{part}<p>{BODY}</p></article>{MENU}"
    assert main_text(page) == "\n\n".join(" ".join(b.split()) for b in ["Title", BODY, *blocks, BODY])


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, blocks = CASES[name]
    assert main_text(page) == "\n\n".join(" ".join(b.split()) for b in blocks)


def test_given_pages_equal_their_article():
    """A plain reading of the given layout: the text between the article's tags, cut at p and h1."""
    for page, text in ((h, main_text(h)) for (h,) in duckdb.sql(
            "SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        assert text == "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


def test_smoothing_keeps_a_constant():
    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0) and len(smoothed(np.ones(1))) == 1


def test_awkward_rows(spark):
    pages = spark.createDataFrame(
        [(1, None, "t"), (1, None, "t"), (2, "<p>" * 3000 + "deep", None), (3, "<" * 50, "x"), (4, "</p></div>&#xZZ;", "x")],
        "page_id LONG, html STRING, text STRING")
    rows = extract_pages(pages).collect()
    assert len(rows) == 5 and all(r.text is not None for r in rows) and [r.text for r in rows if r.page_id == 1] == ["", ""]
    assert extract_pages(pages.limit(0)).count() == 0
    assert main_text("<div>" * 20_000 + "x" * 10_000).endswith("x")
    assert extract_pages(pages, name="page_id").select(F.col("page_id")).count() == 5
