"""The content region of pages without an article, and of texts in several articles."""

from __future__ import annotations

import pytest

LONG = "<p>" + "This is a sentence of the long text, and it goes on for a while. " * 40 + "</p>"


def test_title_and_lead_beside_the_long_text_stay():
    from orrery.llm.html_extract import extract_text

    got = extract_text(f"<html><body><nav>Menu</nav><h1>Title</h1><p>Lead</p><div>{LONG}{LONG}</div><div class=sidebar>Side</div><footer>Foot</footer></body></html>").split("\n\n")
    assert got[:2] == ["Title", "Lead"] and len(got) == 4
    menu = "<ul>" + "<li><a href=x>Go somewhere</a></li>" * 5 + "</ul>"
    assert "Go somewhere" not in extract_text(f"<body>{menu}<h1>Title</h1><div>{LONG}</div></body>")


def test_all_parts_of_a_text_stay_but_comments_and_teasers():
    from orrery.llm.html_extract import extract_text

    parts = "".join(f"<article><h2>Part {i}</h2>{LONG}</article>" for i in range(3))
    other = f"<article class=comment>{LONG.replace('sentence', 'opinion')}</article><article class='related teaser'>{LONG.replace('sentence', 'teaser')}</article>"
    got = extract_text(f"<html><body>{parts}{other}</body></html>")
    assert [f"Part {i}" in got for i in range(3)] == [True] * 3 and got.count("\n\n") == 5
    assert "opinion" not in got and "teaser" not in got


ARTICLE = f"<article><h1>Title</h1>{LONG}<div class='share-buttons'><a href=x>Tell all</a></div><p class='share-price'>Price 12.</p></article>"
WRAPPERS = ['<body class="single comments-open">%s', '<div class="content with-sidebar">%s</div>', '<div class="layout-has-header">%s</div>', '<div class="topic-social-science">%s</div>', "<nav><ul><li><a href=x>Home</a></ul>%s", '<div class="sidebar">%s</div>', "<form>%s</form>", "<div hidden>%s</div>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_of_wrappers_are_evidence_only(wrapper, tag):
    from orrery.llm.html_extract import extract_text

    got = extract_text(f"<html><head><title>q</title></head>{wrapper % ARTICLE.replace('article', tag)}<footer>Foot of the page</footer></html>")
    assert got.startswith("Title\n\nThis is") and got.endswith("\n\nPrice 12.") and got.count("\n\n") == 2


@pytest.mark.parametrize("name,text", [("section id=comments", 1), ("div class='related-posts'", 1), ("aside", 60), ("div class='cookieNotice'", 60), ("p class=advert", 60)])
def test_what_says_it_is_something_else_goes_beside_the_text(name, text):
    from orrery.llm.html_extract import extract_text

    own = "<p>A short article of one line that stands by itself, as notes do.</p>" * text
    other = LONG[3:-4].replace("sentence", "other")
    other = f"<{name}>{other}</{name.split()[0]}>"
    for tag in ("article", "div"):
        for body in (f"<{tag}><h1>Title</h1>{own}{other}</{tag}>", f"<{tag}><h1>Title</h1>{own}</{tag}>{other}", f"{other}<{tag}><h1>Title</h1>{own}</{tag}>"):
            got = extract_text(f"<body>{body}</body>").split("\n\n")
            assert len(got) == text + 1 and got[0] == "Title", (tag, body[:40])


def test_clusters_decide_without_an_article():
    from orrery.llm import html_extract as H

    page = f"<body><div><b>Home</b> <b>News</b> <b>About us</b></div><h1>Title</h1><div>{LONG}<div>Short.</div>{LONG * 20}</div><div><b>Imprint</b> <i>2024</i></div><div>{LONG.replace('sentence', 'second')[3:-4]}</div></body>"
    got = H.extract_text(page).split("\n\n")
    assert got[0] == "Title" and "Short." in got and len(got) == 24 and "second" in got[23]
    # With every line taken for content the page would keep its menu and imprint.
    keep, H.content_threshold = H.content_threshold, lambda ratios: -1.0
    try:
        assert len(H.extract_text(page).split("\n\n")) == 26
    finally:
        H.content_threshold = keep


def test_long_pages(spark):
    from orrery.llm.html_extract import extract_pages

    html = f"<body><nav>{'<a href=x>Menu</a>' * 20_000}</nav><article>{LONG * 2000}</article></body>"
    got = extract_pages(spark.createDataFrame([(1, "u", html), (2, "v", "<article>y</article>")], "page_id long, url string, html string")).collect()
    assert [r.text.count("\n\n") for r in got] == [1999, 0] and "Menu" not in got[0].text
