import html
import itertools
import os
import random
import re
import time

import pandas as pd
import pytest

from millrace.llm import html_extraction as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this thing now, it is very good.</div>
<article><h1>Head&amp;&eacute;</h1><p><b>First   block
of text.<br><p>Second block &#8212; done.</p></article><footer>&copy; site</footer></body></html>"""


def test_template():
    assert H.main_text(PAGE) == "Head&é\nFirst block of text.\nSecond block — done."
    assert H.main_text(PAGE[: PAGE.index("</body>")]) == H.main_text(PAGE)


@pytest.mark.parametrize(
    "noise",
    [
        '<aside><p>A long side note that has many words in it and ends like a sentence does.</p></aside>',
        '<div class="cookie-notice"><p>We use cookies here. Please accept all of them to go on reading.</p></div>',
        '<section id="comments"><article class="comment"><p>I think this is a fine article and I liked reading all of it.</p></article></section>',
        '<form action="x"><p>Enter your address here to get our letters every single week.</p><input><button>Go</button></form>',
        '<div class="sidebar"><ul><li><a href="x">One</a></li><li><a href="y">Two</a></li></ul></div>',
        '<header><p>The name of the site and what it stands for, in one line.</p></header>',
        "<script>document.write('<p>no</p>')</script><noscript><p>Turn on scripts to read this page in full.</p></noscript>",
        '<div style="display: none"><p>Hidden text that nobody sees on the page at all.</p></div>',
    ],
)
def test_noise_goes(noise):
    text = "<p>The first paragraph tells what this is about, in plain words.</p><p>Short.</p><p>The last paragraph ends it.</p>"
    wanted = "The first paragraph tells what this is about, in plain words.\nShort.\nThe last paragraph ends it."
    for body in (f"<article>{text}</article>{noise}", f'{noise}<div class="post-content">{text}</div>', f"<main>{text}</main><div>{noise}</div>"):
        assert H.main_text(f"<html><body>{body}</body></html>") == wanted


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content has-sidebar"><article>{}</article></div>',
        '<form action="x"><article>{}</article></form>',
        '<form action="x"><div>{}</div></form>',
        '<div class="widget page"><main>{}</main></div>',
        '<article id="share-prices-fall">{}</article>',
    ],
)
def test_wrappers_keep_the_article(page):
    text = "The first paragraph tells what this is about, in plain words that go on for some time.\nPrivacy\nThe last paragraph ends it, and it has enough words to be one."
    first, head, last = text.split("\n")
    body = page.format(f'<p>{first}</p><h2 id="privacy">{head}</h2><p>{last}</p>')
    assert H.main_text(f'<html><body><nav><a href="/">Home</a></nav>{body}<footer>About us</footer></body></html>') == text


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<div", "</p></div>", "<!-- open", "<script>x", "<p class='a", "<>", "&amp;"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(H.main_text(page), str)


def test_long_and_deep_pages():
    assert len(H.main_text("<article>" + "<p>" + "word " * 200_000 + "</article>")) == 999_999
    assert "inside" in H.main_text("<article>" + "<div>" * 3000 + "<p>inside the deepest element of all.</p>" + "</div>" * 3000 + "</article>")


def by_sign(page):
    """The text without the cut: blocks by their own odds."""
    blocks = H.text_blocks(page)
    H.clear_wrappers(blocks)
    return "\n".join(b[0] for b in blocks if H.content_odds(*b) > 0)


def test_the_cut_decides():
    """A short paragraph, a list item and a heading go with the text around them; alone they say nothing."""
    long = "A paragraph of a story has many words in it, for it tells what happened on that day, and then it ends."
    page = f"<body><nav><a href='/'>Home</a></nav><article><h2>What came next</h2><p>{long}</p><p>Nothing.</p><ul><li>One thing</li></ul><p>{long}</p></article><div><p>Mind the gap</p></div></body>"
    assert H.main_text(page) == f"What came next\n{long}\nNothing.\nOne thing\n{long}"
    assert by_sign(page) == f"{long}\n{long}"


def test_the_cut_decides_on_the_test_pages():
    folder = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    flipped = total = 0
    for page in pd.read_parquet(folder)["html"].dropna():
        blocks = H.text_blocks(page)
        H.clear_wrappers(blocks)
        odds, edges = H.network(blocks)
        flipped += sum((x > 0) != label for x, label in zip(odds[: len(blocks)], H.minimum_cut(odds, edges)))
        total += len(blocks)
        article = re.search("<article>(.*)</article>", page, re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert H.main_text(page) == "\n".join(x for x in lines if x)
    assert flipped > 0.1 * total


def by_all_evidence(page):
    """The text without edges between blocks: a block's own odds and those of the promising element around it."""
    blocks = H.text_blocks(page)
    H.clear_wrappers(blocks)
    return "\n".join(b[0] for b in blocks if H.content_odds(*b) + (max(b[1].promise.odds, 0) if b[1].promise else 0) > 0)


LONG = "A paragraph of a story has many words in it, for it tells what happened on that day, and then it ends."
#: Where the text stands on pages that mark it by neither article, main nor a name.
PLAIN_TEMPLATES = {
    "div": '<nav><a href="/">Home</a></nav><div>{}</div><footer>&copy; site</footer>',
    "body": '<nav><a href="/">Home</a></nav>{}<footer>&copy; site</footer>',
    "table": '<table><tr><td class="menu"><a href="/">Home</a></td><td>{}</td></tr></table><div class="footer">About us</div>',
    "nested": '<div class="navbar"><a href="/">Home</a></div><div><div><section><div>{}</div></section></div></div><aside><p>' + LONG + "</p></aside>",
    "wrapper": '<div class="sidebar"><p>Sign up</p></div><div id="c17"><div>{}</div></div><div class="related"><ul><li><a href="/a">Other</a></li></ul></div>',
}


@pytest.mark.parametrize("template", PLAIN_TEMPLATES)
def test_only_the_cut_finds_short_blocks_without_marks(template):
    """A heading, a short paragraph and a quotation have all evidence but their neighbours against them."""
    body = f"<h1>What came next</h1><p>{LONG}</p><p>Nothing.</p><p>{LONG}</p><blockquote>So they say</blockquote><p>{LONG}</p>"
    page = f"<html><body>{PLAIN_TEMPLATES[template].format(body)}</body></html>"
    assert H.main_text(page) == f"What came next\n{LONG}\nNothing.\n{LONG}\nSo they say\n{LONG}"
    assert by_all_evidence(page) == f"{LONG}\n{LONG}\n{LONG}"


@pytest.mark.parametrize("marked", ["<{}div>", "", "<{}section>"])
def test_the_cut_decides_on_the_test_pages_without_their_marks(marked):
    """With the article's tag taken away, all evidence by itself seldom gives the text; the cut nearly always does."""
    folder = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    pages = pd.read_parquet(folder)["html"].dropna()
    cut = alone = 0
    for page in pages:
        wanted = H.main_text(page)
        plain = page.replace("<article>", marked.format("")).replace("</article>", marked.format("/"))
        cut += H.main_text(plain) == wanted
        alone += by_all_evidence(plain) == wanted
    assert cut > 0.95 * len(pages) and alone < 0.1 * len(pages)


@pytest.mark.parametrize(
    "page",
    ["<span>" * 80_000 + "x", "<span><p>x" * 40_000, '<a href="' * 60_000, "<a href='x\" " * 60_000, "<a " * 100_000, "</p>" * 100_000, "<div>" * 3_000 + "</p>x" * 60_000]
    + ["<ul>" + "<li>x" * 60_000, "<script>" + "</script " * 50_000, "<div class=ad>x" * 30_000, "<" * 300_000, "<!--" * 100_000, "<!x" * 100_000]
    + ["<article>" + "<li>x</li><li><a>yy</a></li><p>word word word.</p><blockquote>some</blockquote>" * 8_000],
)
def test_hostile_pages_take_linear_time(page):
    times = []
    for part in (page[: len(page) // 4], page):
        began = time.process_time()
        H.main_text(part)
        times.append(time.process_time() - began)
    assert times[1] < max(1.0, 8 * times[0])


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 3) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5}

        def cost(labels):
            return sum(max(o, 0) if not on else max(-o, 0) for o, on in zip(odds, labels)) + sum(c for (i, j), c in edges.items() if labels[i] != labels[j])

        sides = H.max_flow_sides(list(range(n)), odds, [{j: c for (a, b), c in edges.items() for j in ({a, b} - {i} if i in (a, b) else ())} for i in range(n)])
        assert cost(sides) == pytest.approx(cost(H.minimum_cut(odds, edges)))
        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(H.minimum_cut(odds, edges)) == pytest.approx(best)


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    found = H.extract(rows).collect()
    assert len(found) == 3 and {r.n_chars for r in found} == {0, len(H.main_text(PAGE))}
    assert all(r.n_chars == len(r.text) for r in found)
    assert H.extract(rows.where("false")).count() == 0
