"""Main text of written pages and of every given page."""

import html
import re

from quirework.llm.html import extract, main_text

LONG = "A sentence long enough to be taken for the body of a page, and then some more of it. "


def test_parts_that_go():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><a href="/">Home</a></header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <p>not this</p> --><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Title &amp; more</h1></header><p>{LONG}<br>next&nbsp;line <b>bold</b></p><aside>side</aside><div class="ad"><div>buy</div> this</div><p>Short.</p>
    <form><p>name</p></form><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table><section id="comments"><p>nice!</p></section></article>
    <div id="sidebar">{LONG}</div><footer>&copy; me</footer></body></html>"""
    want = ["Title & more", LONG.strip() + " next line bold", "Short.", "one", "two", "a b"]
    assert main_text(page) == "\n\n".join(want)


def test_without_article_element():
    menu = "".join(f"<div><a href='{i}'>item number {i} of the menu</a></div>" for i in range(30))
    page = f"<body>{menu}<div class='nav'>x</div><div><h2>Head</h2><p>{LONG}</p><p>Tail.</p></div><footer>end</footer></body>"
    assert main_text(page) == f"Head\n\n{LONG.strip()}\n\nTail."


def test_short_text_behind_what_is_dropped():
    for gone in ("<div class='ad'>buy</div>", "<form><p>name</p></form>", "<nav><ul><li><a href='/x'>x</a></li></ul></nav>", "<aside>side</aside>"):
        page = f"<body><div><h2>Head</h2>{gone}<p>{LONG}</p>{gone}<h3>Next</h3>{gone}<p>Short.</p>{gone}<ul><li>one</li></ul>{gone}<p>Closing.</p></div><footer>end</footer></body>"
        assert main_text(page) == "\n\n".join(["Head", LONG.strip(), "Next", "Short.", "one", "Closing."])


def test_names_are_evidence_not_verdicts():
    assert main_text(f'<div class="content has-sidebar"><p>{LONG}</p></div>') == LONG.strip()
    assert main_text(f'<div class="page with-ads no-sidebar"><p>{LONG}</p><div class="sidebar-left"><p>{LONG}</p></div><div class="cookie-notice">We use</div></div>') == LONG.strip()
    page = f'<article><p>{LONG}</p><section id="related-work"><h2 id="social-history">Social history</h2><p>Text.</p></section><p class="copyright">Mine.</p><section class="comments"><p>Nice!</p></section></article>'
    assert main_text(page) == "\n\n".join([LONG.strip(), "Social history", "Text.", "Mine."])
    assert main_text("<article><p title=it's>first one</p><p>don't stop</p><p data-x = 'a>b' y=\"c>d\">end</p></article>") == "first one\n\ndon't stop\n\nend"


def test_teasers_are_not_the_article():
    page = f'<article class="teaser"><h2>Other news</h2><p>Short.</p></article><article><h1>Head</h1><p>{LONG}</p><p>Tail.</p><article class="comment"><p>First!</p></article></article><article><h3><a href="y">Read this one next</a></h3></article>'
    assert main_text(page) == f"Head\n\n{LONG.strip()}\n\nTail."
    assert main_text('<article><a href="y">Read this</a></article><article><a href="z">Or that</a></article>') == "Read this\n\nOr that"
    assert main_text("<article><p>One part.</p></article><article><p>Another part.</p></article>") == "One part.\n\nAnother part."


def test_given_pages_without_article_elements(spark, folder):
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        assert main_text(re.sub(r"(</?)article", r"\1div", r["html"])) == main_text(r["html"])


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<p>  </p>") == main_text("<script>x") == ""
    assert main_text("just text &lt;b&gt; &am") == "just text <b> &am"
    assert main_text("<nav>menu<article><p>one<p>two<b>three") == "one\n\ntwothree"
    assert main_text("<article><p title='a>b'>text</p></article>") == main_text("<article><p x=\"unclosed>text</p></article>") == "text"
    assert main_text("<div class=ad>buy<div>more</div></div><p>kept</p>") == "kept"
    assert main_text("a < b and c > d") == "a < b and c > d"
    assert len(main_text("<article>" + "<div><p>" * 20_000 + "deep" + "</div>" * 20_000)) == 4


def test_every_given_page(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    truth = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        truth[r["page_id"]] = "\n\n".join(x for x in parts if x)
    got = {r["page_id"]: r for r in extract(pages).collect()}
    assert all(got[k]["text"] == v and got[k]["n_chars"] == len(v) for k, v in truth.items()) and len(got) == len(truth)


def test_rows_as_they_are(spark):
    rows = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x</p>", "s")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in extract(rows).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert extract(rows.limit(0)).count() == 0
