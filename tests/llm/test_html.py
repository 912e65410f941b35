import html
import math
import random
import re
import time
from html.parser import HTMLParser

import pytest

from keyloom.llm import html_text
from keyloom.llm.queries import QUERIES


def plain(page):
    """Blocks of the page's article by plain cutting, for pages made like the table's."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts]
    return "\n".join(b for b in blocks if b)


def test_query_over_whole_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op8_html"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_boilerplate_goes_and_content_stays():
    long = "A sentence, with commas, that goes on for a while. " * 6
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div id=content><h1>Title &amp; more</h1><p>{long}<p>Short&nbsp;one.<p>{long}
    <ul><li>Item one, listed.<li>Item two, listed.</ul></div><div class=sidebar><p>Side, text.</p></div><form>Name <input></form>
    <div class="reader-comments"><p>{long}</p></div><p><a href=y>More links here</a></p><footer>&copy; all</footer><script>var a = "<p>no</p>";</script></body>"""
    got = html_text.main_text(page).split("\n")
    s = " ".join(long.split())
    assert got == ["Title & more", s, "Short one.", s, "Item one, listed.", "Item two, listed."]


def test_edges(spark):
    assert html_text.main_text("") == html_text.main_text(None) == ""
    assert html_text.main_text("<p>just text, here.") == "just text, here."
    assert html_text.main_text("no tags at all &lt;x&gt;") == "no tags at all <x>"
    assert html_text.main_text("<nav>only menu</nav>") == ""
    assert html_text.main_text("<div>" * 20000 + "deep, text." + "</div>" * 20000) == "deep, text."
    assert html_text.main_text('<article><p>a "quoted < text, &am') == 'a "quoted < text, &am'
    assert html_text.main_text("<article><p>one, <b>bold<i>x</b></i> y<br>z</p></article>") == "one, boldx y z"
    df = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<p>x, y.", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=repr) == [(1, "u", "x, y.", 5), (1, None, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


LONG = "A long sentence of the article, which has commas, stops and more. " * 5


@pytest.mark.parametrize("attr", ['class="content has-sidebar"', 'class="no-sidebar"', 'class="article-share-enabled"', 'class="col search-result"', 'class="ad-free"', 'class="post related-post"', 'id="comment-policy"', 'class="sidebar"'])
def test_names_that_do_not_make_boilerplate(attr):
    s = LONG.strip()
    assert html_text.main_text(f"<div {attr}><h1>Title</h1><p>{LONG}</p><p>Short one.</p></div><nav>Menu</nav>") == f"Title\n{s}\nShort one."


@pytest.mark.parametrize("attr", ['class="sidebar"', 'class="left ad-slot"', 'id="cookie-notice"', 'class="reader-comments"', 'class="comment-list"', 'class="related-posts"', 'role="complementary"', "hidden", 'class="share-buttons"', 'style="display: none"'])
def test_names_that_do(attr):
    s = LONG.strip()
    assert html_text.main_text(f"<body><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div {attr}><p>{LONG}</p></div></body>") == f"Title\n{s}\n{s}"


def test_headings_alone_and_more_comments_than_article():
    assert html_text.main_text("<h1>One</h1><h2>Two</h2>") == "One\nTwo"
    page = f"<article><h1>T</h1><p>{LONG}</p></article><section class=comments>{f'<p>{LONG}</p>' * 9}</section>"
    assert html_text.main_text(page) == f"T\n{LONG.strip()}"


class Plain(HTMLParser):
    """Blocks of a well-formed page of div, section, p, li and h2, with their paths as text."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.blocks, self.links = [], [], 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.links += 1
        else:
            self.stack.append((tag, self.stack[-1][1] + [len(self.blocks), tag] if self.stack else [tag]))

    def handle_endtag(self, tag):
        if tag == "a":
            self.links -= 1
        else:
            self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            path = "/".join(t for t, _ in self.stack)
            self.blocks.append((data.strip(), path, bool(self.links)))


def plain_paths(blocks):
    """Content paths by the definition: sums by path, smoothing over the row of blocks, geometric mean, mean over the path, threshold."""
    body = [b for b in blocks if not b[1].endswith("h2")]
    own = lambda p: [b for b in body if b[1] == p]
    size = lambda p: sum(len(b[0]) for b in own(p))
    free = lambda p: 1 - sum(len(b[0]) for b in own(p) if b[2]) / size(p)
    marks = lambda p: sum(sum(c in ".,;:!?" for c in b[0]) for b in own(p))
    length = [size(p) / len(own(p)) * free(p) for _, p, _ in body]
    point = [(0.2 + marks(p) / len(own(p))) * free(p) for _, p, _ in body]

    def smooth(x, i):
        near = [(j, math.exp(-0.5 * (i - j) ** 2)) for j in range(len(x)) if abs(i - j) <= 2]
        return sum(w * x[j] for j, w in near) / sum(w for _, w in near)

    fused = [math.sqrt(smooth(length, i) * smooth(point, i)) for i in range(len(body))]
    of = {p: sum(f for f, b in zip(fused, body) if b[1] == p) / len(own(p)) for _, p, _ in body}
    mean = sum(of[b[1]] * len(b[0]) for b in body) / sum(len(b[0]) for b in body)
    return {p for p in of if of[p] >= 0.25 * mean and 1 - free(p) < 0.66}


def test_pages_without_article_against_plain_tag_paths():
    for seed in range(150):
        rng = random.Random(seed)
        words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 8))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))  # noqa: B023, E731
        part = lambda tag, n, link: f"<{tag}>" + (f"<a>{words(n)}</a>" if link else words(n)) + f"</{tag}>"  # noqa: B023, E731
        block = lambda big: part(rng.choice(["p", "p", "li", "h2"]), rng.randint(*((10, 60) if big else (1, 5))), not big and rng.random() < 0.5)  # noqa: B023, E731
        parts = []
        for _ in range(rng.randint(1, 6)):
            inner = "".join(block(rng.random() < 0.6) for _ in range(rng.randint(1, 5)))
            parts.append(rng.choice([f"<section>{inner}</section>", f"<section><div>{inner}</div></section>", inner]))
        page = "<body>" + "".join(parts) + "</body>"
        blocks = Plain(page).blocks
        parsed = html_text._Page(page)
        name = {}
        for e in range(1, len(parsed.tag)):
            name[e] = (name[parsed.parent[e]] + "/" if parsed.parent[e] else "") + parsed.tag[e]
        assert [(t, name[e]) for t, e, *_ in parsed.blocks] == [(t, p) for t, p, _ in blocks]
        body = [(t, parsed.path[e], linked) for t, e, linked, heading in parsed.blocks if not heading]
        if not body:
            continue
        good, _ = html_text.content_paths(body)
        assert {name[e] for e in name if parsed.path[e] in good} == plain_paths(blocks)
        got = html_text.main_text(page).split("\n")
        assert all(t in got for t, p, _ in blocks if p in plain_paths(blocks)) or len(got) < len(blocks)


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a 'x\" ", "<!", "<!--", '<a "><b" ', "</a", "&amp", "< "])
def test_time_is_linear_where_tags_do_not_close(unit):
    began = time.monotonic()
    html_text.main_text(unit * (5_000_000 // len(unit)) if len(unit) < 9 else unit * 50_000)
    assert time.monotonic() - began < 5


@pytest.mark.parametrize("unit", ["<b>x<hr>", "<i></b>", "<b><div>x</b>", "<p><li>x", "<div>x"])
def test_time_is_linear_in_depth(unit):
    def took(n):
        began = time.monotonic()
        html_text.main_text(unit * n)
        return time.monotonic() - began

    took(1000)
    assert took(40_000) < 0.3 + 10 * took(10_000)
