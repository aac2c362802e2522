"""HTML extraction: attributes, doubtful names, links, deep and hostile pages, and the pages of the test table by their article element."""

from __future__ import annotations

import html
import os
import re
import time

import pytest

from slotwise.llm import html_extract as H

LONG = "word " * 30
KEPT = [
    "<p title='the hidden truth'>kept</p>", "<p class='is hidden here'>kept</p>", "<section id=discussion><h2>kept</h2><p>kept three words of talk</p></section>", "<h2 id=related-work>kept</h2>", "<div class='article-header'><h2>kept</h2></div>",
    "<p>a <math><mi>kept</mi></math> b</p>", "<div hidden>kept</div>", "<p style='display:none'>kept</p>", "<p><a href=x>kept as a whole link</a></p>", "<header><p>kept</p></header>", "<p data-x='ads sidebar'>kept</p>", "<ul><li>kept</ul>", "<table><tr><td>kept</table>",
]
GONE = [
    "<div class=comments><p>gone</p></div>", "<div id=comments><p>gone this is a long comment of many words it goes on and on</p></div>", "<div class=comments><a>gone</a></div>", "<div class=ad>gone</div>", "<aside>gone</aside>", "<aside><a>gone</a></aside>", "<nav><a>gone</a></nav>",
    "<div class=related><a>gone and some more</a></div>", "<form>gone <a>x</a></form>", "<script>gone</script>", "<style>gone</style>", "<div class='cookie-notice'>gone</div>", "<footer>gone</footer>", f"<div class=advert><p>gone {LONG}</p></div>", "<!-- gone -->", "<div class='share'><a>gone</a></div>",
]


@pytest.fixture(scope="module")
def tree():
    return H.train()


def page(inner):
    return f"<html><body><nav><a>Home</a> <a>x</a></nav><article><h1>Title here</h1>{inner}<p>{LONG}</p></article><footer>foot</footer></body></html>"


@pytest.mark.parametrize("part", KEPT)
def test_article_text_stays(tree, part):
    assert "kept" in H.main_text(page(part), tree)


@pytest.mark.parametrize("part", GONE)
def test_other_parts_go(tree, part):
    assert "gone" not in H.main_text(page(part), tree)


WRAPPED = [
    "<div class='layout has-sidebar'>{}<aside class=sidebar>gone</aside></div>", "<div class='page with-sidebar'>{}<div class=sidebar>gone</div></div>", "<div class='post comments-open'>{}<div class=comments><article>gone as an article of its own</article></div></div>",
    "<div class='no-sidebar'>{}</div>", "<div class=sidebar-layout><div class='content-sidebar'>{}</div><div class=sidebar>gone <a>x</a></div></div>", "<div id=comments class=related>{}</div><div class=comments>gone</div>", "<section class='nav-open cookie-consent-hidden'>{}</section>",
]


@pytest.mark.parametrize("wrapper", WRAPPED)
@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrappers_of_the_article_take_nothing(tree, wrapper, tag):
    article = f"<{tag}><h1>Title</h1><p>{LONG * 2}</p><div class=share-price><p>{LONG}</p></div><div class=menu><p>soup of the day and bread</p></div><div class=ad>gone</div><p>last</p></{tag}>"
    got = H.main_text(f"<body><nav><a>Home</a></nav>{wrapper.format(article)}<footer>foot</footer></body>", tree)
    assert got == "\n\n".join(["Title", (LONG * 2).strip(), LONG.strip(), "soup of the day and bread", "last"])


def test_comments_in_articles_are_no_main_text(tree):
    text = "".join(f"<p>{'plain ' * 30}</p>" for _ in range(4))
    got = H.main_text(f"<body><div>{text}</div><div class=comments><article>gone one</article><article>gone two</article></div></body>", tree)
    assert "gone" not in got and got.count("plain") == 120
    got = H.main_text(f"<body><article>{text}<div class=comments><article><p>gone {LONG}</p></article></div></article></body>", tree)
    assert "gone" not in got and got.count("plain") == 120


@pytest.mark.parametrize(("name", "meaning"), [("share-price", ""), ("has-sidebar", ""), ("post-comments", "sure"), ("comment-list", "sure"), ("no-comments", ""), ("comments-open", ""), ("menu", "doubtful"), ("sidebar_left", "sure"), ("ad-slot-2", "sure"), ("headline", ""), ("x ads", "sure"), ("", "")])
def test_names(name, meaning):
    assert H._meaning(name) == meaning


def test_link_density_decides_without_an_article(tree):
    text = "".join(f"<div><p>{'plain ' * n}</p></div>" for n in (12, 40, 8, 25))
    links = "".join(f"<div><a>{'link ' * n}</a></div>" for n in (3, 14, 30))
    got = H.main_text(f"<body>{links}{text}{links}</body>", tree)
    assert "link" not in got and got.count("plain") == 85
    assert H.main_text("<article><p>one two</p><p>last</p></article>", tree) == "one two\n\nlast" and H.main_text("just text", tree) == "just text"


@pytest.mark.parametrize("part", ["<div>", "<span>x</b>", "<p>a", "<li>a", "<a>", "<a x='", '<a ="', "<b><div><span></b>", "&amp;", "<!--", "<td><table>"])
def test_time_goes_with_length(tree, part):
    began = time.perf_counter()
    H.main_text(part * 100_000, tree)
    H.main_text("<b><div>" + "<span>" * 100_000 + "</b>" * 100_000, tree)
    assert time.perf_counter() - began < 20


def test_pages_of_the_table(tree, spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    for r in spark.read.parquet(path).collect():
        body = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        parts = re.split(r"</?(?:p|h\d|div|ul|li)\b[^>]*>", re.sub(r"<!--.*?-->", "", re.sub(r"<br>", "\0 ", body[1]))) if body else []
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p).replace("\0", "")).split()) for p in parts]
        assert H.main_text(r.html, tree) == "\n\n".join(t for t in texts if t)
