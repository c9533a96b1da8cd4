"""Main text of hand-made pages."""

import numpy as np

from shapeloom.llm import pages
from shapeloom.llm.pages import main_text

LONG = "This is a long enough paragraph of the article that tells a story in many words, and then some more."


def test_marked_article():
    page = f"""<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="ad">Buy!</div><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
    <article><h1>Title &amp; more</h1><p>First   line<br>goes
    on</p><p><b>Bold<p>{LONG}</p><form><input value="x"><label>Mail</label></form><aside>Side</aside><p>x &lt; y</p>
    <section id="comments"><p>First!</p></section></article><!-- gone <p>no</p> --><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == f"Title & more\nFirst line goes on\nBold\n{LONG}\nx < y"


def test_unmarked_page():
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div>by me</div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p>" + "<ul>" + "<li><a href=x>a link</a></li>" * 9 + "</ul><p>Legal</p></body>"
    text = main_text(page).split("\n")
    assert text[-3:] == [LONG, "Short.", LONG] and "Head" in text and "Legal" not in text and "a link" not in text


def test_markup_that_is_not_closed():
    assert main_text("<article><p>one<p>two &am &amp") == "one\ntwo &am &"
    assert main_text("<p>a <b") == "a <b" and main_text("<script>x") == main_text(None) == main_text("") == main_text("<p> </p>") == ""
    assert main_text("<div class=ad>buy<article><p>text</p></article>") == "text"
    assert main_text("1 < 2 <p>3</p>").split() == ["1", "<", "2", "3"]


def test_surge_and_dive():
    assert pages.surges(np.array([0, 0, 90, 5, 0, 0, 0, 10, 0, 0, 0, 100.0]), 80) == [(0, 4), (9, 12)]
    assert pages.surges(np.zeros(4), 1) == []


def test_rows(spark):
    rows = [(1, "u", "<p>hi</p>"), (1, "u", "<p>hi</p>"), (None, None, None), (2, None, ""), (3, "v", "<article>" + "<p>word</p>" * 50_000 + "</article>")]
    data = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = pages.extract(data).collect()
    assert len(found) == 5 and all(r.n_chars == len(r.text) for r in found)
    assert max(r.n_chars for r in found) == 50_000 * 5 - 1
    assert pages.extract(data.limit(0)).count() == 0


def test_given_pages_keep_their_articles(spark):
    """Against the template of the given pages: all text of the article element, nothing else."""
    import html
    import re

    from shapeloom.llm.common import table

    given = table(spark, "/root/testdata/sf0.01", "pages")
    found = {r.page_id: r.text for r in pages.extract(given).collect()}
    for row in given.collect():
        inside = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert found[row.page_id] == "\n".join(b for b in blocks if b)


def test_the_surge_decides_between_containers():
    story = "".join(f"<p>{k} {LONG}</p>" for k in range(8))
    cards = "".join(f'<article><h3><a href="/{k}">Another story {k}</a></h3><p>A teaser of some words, no more than two lines of the page.</p></article>' for k in range(12))
    wanted = "\n".join(f"{k} {LONG}" for k in range(8))
    for page in (f"<main>{story}</main>{cards}", f"{cards}<main>{story}</main>", f"<main>{story}<section>{cards}</section></main>", f"<div>{story}</div>{cards}"):
        assert main_text(page) == wanted
    assert main_text(f"<main><p>Some words of the site.</p><article><h1>T</h1><p>by</p><p>x</p>{story}</article></main>") == "T\nby\nx\n" + wanted


def test_the_dive_ends_a_marked_article():
    links = "<ul>" + "<li><a href=x>a link</a></li>" * 9 + "</ul>"
    assert main_text(f"<article><p>{LONG}</p><p><a href=x>one source</a></p><p>{LONG}</p>{links}</article>") == f"{LONG}\none source\n{LONG}"


def test_only_real_marks_drop_text():
    assert main_text(f'<article><div class="overflow-hidden" title="The hidden valley" data-note="display:none"><p>{LONG}</p></div></article>') == LONG
    assert main_text(f'<article><p>See <a href="/hidden-gems?id=ads-2024&class=ad" data-id="share" title="class=promo">these gems</a> and {LONG}</p></article>') == f"See these gems and {LONG}"
    for attribute in ('class="layout no-sidebar"', 'class="has-header"', 'id="social-policy"', 'id=disclaimer-case', "data-class='ad'", 'aria-hidden="false"', "style='color:red; --display:none-such'"):
        assert main_text(f"<div {attribute}><p>{LONG}</p><section {attribute}><p>{LONG}</p></section></div>") == f"{LONG}\n{LONG}"
        assert main_text(f"<article><p>one <span {attribute}>two</span> three</p></article>") == "one two three"


def test_marked_and_hidden_text_goes():
    for attribute in ("hidden", 'HIDDEN=""', 'aria-hidden="true"', 'style="color:red;display: none"', 'class="box ad"', "id=ad-3", 'class="site_header"', "role=navigation", 'class="x cookie-notice"'):
        assert main_text(f"<article><p>one <span {attribute}>two</span>three</p><div {attribute}><p>{LONG}</p></div></article>") == "one three"
    assert main_text(f'<div role="main"><p>{LONG}</p></div><p>Legal matters, told in one line.</p>') == LONG


def test_an_anchor_that_is_never_closed_is_no_link():
    story = "".join(f"<p>{k} {LONG}</p>" for k in range(3))
    text = "\n".join(f"{k} {LONG}" for k in range(3))
    assert main_text(f'<body><div><p><a name="top">Intro</p>{story}</div></body>') == f"Intro\n{text}"
    # A link that is never closed ends with its block, or with the next one.
    assert main_text(f"<body><div><p>By <a href=x>me</p>{story}</div></body>").endswith(text)
    assert main_text(f"<body><ul><li><a href=x>one<li><a href=y>two<li><a href=z>three</ul>{story}</body>") == text
    # Blocks inside a link are the link's.
    cards = "".join(f"<a href={k}><div>Card {k} with a headline of many words that goes on</div><p>and more</p></a>" for k in range(4))
    assert main_text(f"<body><div>{story}</div><div>{cards}</div></body>") == text


def test_article_goes_on_behind_a_list_of_links():
    links = "<ul>" + "<li><a href=x>see also</a></li>" * 4 + "</ul>"
    for tag in ("article", "main"):
        page = f"<{tag}><p>{LONG}</p>{links}<p>The end of it.</p></{tag}>"
        assert main_text(page) == f"{LONG}\nThe end of it."


def test_tags_and_quotes():
    assert main_text("<article><p title='a > b'>one</p><p title=\"x' > y\">two</p></article>") == "one\ntwo"
    assert main_text('<article><p title="never closed>one</p><p>two</p></article>') == "one\ntwo"
    assert main_text("<article><p>one</p><!-- <p>no</p><p>gone") == "one"
    assert main_text("<article><![CDATA[<p>no</p>]]><p>one</p><?php x ?><!doctype y></article>") == "one"
    assert main_text("<article>a < b <1 </ > c</article>") == "a < b <1 </ > c"


def test_odd_markup_takes_no_longer_than_its_length():
    import time

    for piece in ("<a ", '<a href="', "<a <a '", "<", "</", "<!--", "<a<", "<div>", "</p>", "<p><div>", "&", '<a x="\'>', "<script>", "<a href=x>", "<p title='\">", "<li><a href=x>y"):
        page = piece * ((1_000_000 if piece in ("<a ", '<a href="') else 100_000) // len(piece))
        for tail in ("", ">", '">', "'>x"):
            begun = time.perf_counter()
            main_text(page + tail)
            assert time.perf_counter() - begun < 8, (piece, tail)
