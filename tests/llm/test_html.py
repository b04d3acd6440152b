"""HTML extraction on pages whose main text is known."""

import pytest

from evidara.llm import html_extract as he

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="x">
<nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy  this</div><header>Site</header><aside>Side</aside>
<div class="cookie-notice">We use cookies</div>
<article><header><h1>Title &amp; more</h1></header><p><b>First
 bit&nbsp;&eacute;.<br><p>Second <i>one</i> <a href="/l">link</a>.</p><ul><li>x<li>y</ul><form>Mail <input></form>
<div id="comments"><p>Nice!</p></div></article><div>Loose</div><footer>&copy; host</footer></body></html>"""


def texts(html):
    return [t for _, t, s in he.read(html) if s]


def test_read():
    assert texts(PAGE) == ["Title & more", "First bit é.", "Second one link.", "x", "y"]
    assert texts("") == [] and texts("<p>a<p>b") == ["a", "b"] and texts("plain &lt;text&gt;") == ["plain <text>"]
    assert texts("<div><p>unclosed <b>bold") == ["unclosed bold"]
    assert texts("<table><tr><td>1<td>2</table>") == ["1", "2"]
    assert texts("</p></div>x<![if y]>z") is not None


BODY = "<p>The story itself, told at length.</p>"


@pytest.mark.parametrize(
    "html",
    [
        f'<body class="no-sidebar"><article>{BODY}</article></body>',
        f'<div class="content-with-sidebar"><article>{BODY}</article><div id="comments"><article>Me too</article></div></div>',
        f'<article class="post tags-x">{BODY}</article>',
        f'<div class="reader"><div class="share"><div id="related">{BODY}</div></div></div>',
        f"<html><head><title>T</title><body>{BODY}</html>",
        f'<head><meta charset="utf-8"><title>T</title><style>x</style>{BODY}',
        f"<head><title>T</title><script>x</script><noscript><img></noscript><div>{BODY}</div>",
    ],
)
def test_names_and_heads_do_not_empty_a_page(html):
    assert texts(html) == ["The story itself, told at length."]


def test_named_noise_still_goes():
    assert texts(f'<head><title>T</title></head><div>{BODY}</div><div class="comments">Nice! {BODY}</div><div class="ad">Buy</div>') == ["The story itself, told at length."]
    assert texts(f'<article>{BODY}<div class="share">Send</div></article><div class="related"><article>{BODY} Another</article></div>') == ["The story itself, told at length."]


def page(i, extra=""):
    return f'<body><div class="top">Welcome to our site</div><div class="story"><p>Story number {i} has its own words {i * 7}.</p>{extra}</div><div class="legal">All rights kept</div></body>'


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://a.example.com/{i}", page(i)) for i in range(12)]
    rows += [(100, "http://solo.example.com/", page(100)), (101, None, PAGE), (102, "http://x.org", None), (103, "http://x.org", "")]
    rows += [(200 + i, "http://same.example.com/x", page(5)) for i in range(30)] + [(3, "https://a.example.com/3", page(3))]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text")


def test_main_text(pages):
    got = pages.sparkSession.createDataFrame([], "page_id long, url string, html string")
    assert he.main_text(got).count() == 0
    rows = he.main_text(pages).collect()
    assert len(rows) == pages.count()
    by = {r.page_id: r for r in rows}
    # what every page of a host says is gone; a page or a text that stands alone says everything
    assert by[4].text == "Story number 4 has its own words 28."
    assert by[100].text == "Welcome to our site\n\nStory number 100 has its own words 700.\n\nAll rights kept"
    assert by[205].text.startswith("Welcome")
    assert by[101].text.split("\n\n") == ["Title & more", "First bit é.", "Second one link.", "x", "y"]
    assert by[102].text == "" and by[103].text == "" and by[102].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in rows)


def plain(i, extra):
    return f"<body><div><p>Story {i} is told in words like {i * 7}.</p></div>{extra}</body>"


def test_boilerplate_of_few_pages_goes(spark):
    """Identical blocks go on a small host, on a small share of a large one, and where one path has most pages."""
    rows = [(i, "http://big.org/", plain(i, '<div class="legal">All rights kept</div>' if i < 4 else "")) for i in range(100)]
    rows += [(i, "http://tiny.org/", plain(i, "<div>Read on</div>")) for i in range(200, 204)]
    rows += [(i, "http://mid.org/", plain(i, f'<div class="box">{"Part of our series" if i < 320 else i}</div>' if i < 322 else "")) for i in range(300, 400)]
    got = {r.page_id: r.text for r in he.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in (0, 3, 50, 200, 203, 305, 399):
        assert got[i] == f"Story {i} is told in words like {i * 7}.", i


def test_articles_are_judged_too(spark):
    rows = [(i, "http://big.org/", f"<body><article><p>Story {i} has words like {i * 7}.</p><p>Told to you by the staff of our house.</p></article></body>") for i in range(30)]
    # one text on three pages is no boilerplate
    rows += [(i, "http://few.org/", "<body><article><p>A story that was told twice.</p></article></body>" + " " * i) for i in range(100, 103)]
    got = {r.page_id: r.text for r in he.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} has words like {i * 7}." for i in range(30))
    assert all(got[i] == "A story that was told twice." for i in range(100, 103))


def test_a_teaser_is_not_the_page():
    body = "<div><p>The body of the page stands in a div and is told at some length.</p></div>"
    assert texts(f'<body>{body}<article><a href="/x">See also this</a></article></body>') == ["The body of the page stands in a div and is told at some length."]


def extracted(spark, pages):
    return {r.page_id: r.text for r in he.main_text(spark.createDataFrame([(i, "http://h.org/x", h) for i, h in pages], "page_id long, url string, html string")).collect()}


def test_the_same_article_on_many_pages_stays(spark):
    story = "<p>A story that was told on many pages.</p><p>It has two parts.</p>"
    got = extracted(spark, [(i, f"<body><!-- {i} --><article>{story}</article></body>") for i in range(60)] + [(100 + i, f"<body><div>{story}</div><!-- {i} --></body>") for i in range(3)])
    assert set(got.values()) == {"A story that was told on many pages.\n\nIt has two parts."}


def test_a_sentence_of_half_of_the_articles_stays(spark):
    said = "<p>As we have told before, the river was high.</p>"
    got = extracted(spark, [(i, f"<body><article><p>Story {i} begins like {i * 7}.</p>{said if i < 30 else ''}<p>And ends like {i * 11}.</p></article></body>") for i in range(60)])
    assert all(("the river was high" in t) == (i < 30) for i, t in got.items())


def test_names_that_only_hold_a_noise_word():
    assert texts('<article><p>One.</p><div class="social-history">Two.</div><p class="reader">Three.</p><div class="related-posts">No</div><div id="reader-comments">No</div></article>') == ["One.", "Two.", "Three."]
