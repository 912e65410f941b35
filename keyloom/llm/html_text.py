"""Main text of web pages by tag-path ratios.

A page becomes a row of blocks: the text between two block-level tags, with the
path of block-level tags from the root to its element. For every path, text
length, punctuation and link text are added up over its blocks; length per block
and punctuation per block, both less the share of text in links, are smoothed
along the page with a small Gaussian, fused as a geometric mean and averaged over
the path. Paths that reach ``SHARE`` of the page's (text-weighted) mean are content.

The content node is the innermost element that holds ``HOLDS`` of the text of
content paths: the walk down from the root ends at ``article`` or ``main``. All of
its text is taken, but for paths that are mostly links. Where only the body as a
whole holds so much, the content paths are taken, and headings that stand beside
or before them.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments never enter: they are known by tag, by role, or by a token of
their class or id that names such a thing (``sidebar``, ``cookie-notice``,
``ad-slot``, but not ``has-sidebar``, ``ad-free`` or ``search-result``). What is
known by class or id alone stays if most of the page's text is in it (in the case
of comments, notices and the like: if the page's first heading is in it, too).

Parsing takes time in proportion to the page, whatever it holds.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches

SHARE, HOLDS, LINKED, RADIUS = 0.25, 0.9, 0.66, 2
_KERNEL = [math.exp(-0.5 * k * k) for k in range(RADIUS + 1)]
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template noframes xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
_OUT_TAGS = frozenset("nav header footer aside form button select menu dialog svg canvas object audio video head fieldset datalist math".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_LAYOUT = frozenset("banner footer header login masthead menu menus nav navbar navigation pager pagination related search share sharing sidebar social toolbar widget breadcrumb breadcrumbs".split())
_KINDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense comment comments commentlist consent cookie cookies disqus form gdpr modal newsletter notice "
    "notices notification popover popup promo promotion replies reply respond signup sponsor sponsored subscribe".split()
)
_OUT_WORDS = _LAYOUT | _KINDS
#: What may follow the name of a thing in a token: a part, a place or a wrapper of it.
_PARTS = frozenset("area articles bar block bottom box button buttons container content data group holder icons inner item items left links list outer panel posts right row section slot stories thread top unit wrap wrapper".split())
_MODIFIERS = frozenset("has hide is no non not show with without".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_OPEN_ENDED = frozenset("p td th li dt dd".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_TELLS = re.compile(r"class|id|role|style|hidden", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?…。、，！？؛،]")
_SURE, _NAMED, _KIND = 1, 2, 4


def _named(value: str) -> int:
    """Whether a class or id names something that is not content."""
    found = 0
    for token in value.lower().split():
        words = _WORD.findall(token)
        if not words or not _MODIFIERS.isdisjoint(words):
            continue
        at = next((i for i, w in enumerate(words) if w in _OUT_WORDS), None)
        if at is not None and (words[-1] in _OUT_WORDS or all(w in _OUT_WORDS or w in _PARTS for w in words[at:])):
            found |= _NAMED | (_KIND if not _KINDS.isdisjoint(words) else 0)
    return found


def _unwanted(attrs: str) -> int:
    if not _TELLS.search(attrs):
        return 0
    found = 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return _SURE
        if name == "role" and value in _OUT_ROLES:
            return _SURE
        if name == "style" and _HIDDEN.search(value):
            return _SURE
        if name in ("class", "id"):
            found |= _named(value)
    return found


class _Page:
    """Elements (parent, tag path, tag, how unwanted) and blocks (text, element, characters in links, heading) of one page."""

    def __init__(self, source: str):
        self.source = source
        self.parent, self.path, self.tag, self.named = [0], [0], [""], [0]
        self.blocks: list[tuple[str, int, int, bool]] = []
        # tag, element, dropped for sure, place of the nearest block-level entry, of the nearest that ends no search for open-ended ones
        self.stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, 0)]
        self.paths: dict[tuple[int, str], int] = {}
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.text: list[str] = []
        self.links = self.in_links = 0
        self.quotes = {q: source.rfind(q) for q in "\"'"}
        self.last = source.rfind(">")
        self.scan()
        self.flush()

    def scan(self) -> None:
        source, at, text_from = self.source, 0, 0
        while 0 <= (lt := source.find("<", at)) < self.last:
            at = lt + 1
            after = source[at : at + 1]
            if source.startswith("!--", at):
                end, skip = self.comment_end(at), None
            elif source.startswith("![CDATA[", at):
                close = source.find("]]>", at)
                end = len(source) if close < 0 else close + 3
                skip = source[at + 8 : end if close < 0 else close]
            elif after in ("!", "?"):
                end, skip = source.find(">", at) + 1, None
            elif m := _NAME.match(source, at):
                end, skip = self.tag_end(m.end()), None
            else:
                continue
            self.add(source[text_from:lt])
            if skip is not None:
                self.add(skip, raw=True)
            elif after not in ("!", "?"):
                name = m[2].lower()
                if m[1]:
                    self.close(name)
                elif name in _RAW:
                    found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I).search(source, end)
                    end = found.end() if found else len(source)
                else:
                    self.start(name, source[m.end() : end - 1])
            at = text_from = end
        self.add(source[text_from:])

    def comment_end(self, at: int) -> int:
        if self.source.startswith((">", "->"), at + 3):
            return self.source.index(">", at) + 1
        ends = [i + n for close, n in (("-->", 3), ("--!>", 4)) if (i := self.source.find(close, at + 3)) >= 0]
        return min(ends, default=len(self.source))

    def tag_end(self, at: int) -> int:
        """One past the tag's ``>``: quoted ones do not count, unless nothing else closes the tag."""
        pos = at
        while m := _STOP.search(self.source, pos):
            if m[0] == ">":
                return m.end()
            if m.start() >= self.quotes[m[0]]:
                pos = m.end()
            else:
                pos = self.source.index(m[0], m.end()) + 1
        self.quotes = dict.fromkeys(self.quotes, -1)  # from here on quotes are taken as they are, so this happens once
        return self.source.index(">", at) + 1

    def add(self, raw_text: str, raw: bool = False) -> None:
        if raw_text and not self.stack[-1][2]:
            text = raw_text if raw or "&" not in raw_text else _html.unescape(raw_text)
            self.text.append(text)
            if self.links:
                self.in_links += len(text.strip())

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                element = self.stack[self.stack[-1][3]][1]
                self.blocks.append((text, element, self.in_links, self.tag[element] in _HEADINGS))
            self.text = []
        self.in_links = 0

    def pop_to(self, i: int) -> None:
        if self.stack[-1][3] >= i:
            self.flush()
        for tag, *_ in self.stack[i:]:
            self.places[tag].pop()
            self.links -= tag == "a"
        del self.stack[i:]

    def start(self, name: str, attrs: str) -> None:
        if name in _VOID:
            if name == "hr":
                self.flush()
            elif name in ("br", "wbr") and not self.stack[-1][2]:
                self.text.append(" " if name == "br" else "")
            return
        inline = name in _INLINE
        if not inline:
            self.flush()
            if self.places["p"]:
                self.close_near({"p"})
            if name in _CLOSES:
                self.close_near(_CLOSES[name])
            elif name in _HEADINGS:
                self.close_near(_HEADINGS)
        elif name == "a" and self.places["a"]:
            self.close("a")
        _, element, out, block, barrier = self.stack[-1]
        kind = 0 if out or not attrs or name in ("html", "body") else _unwanted(attrs)
        out = out or name in _OUT_TAGS or bool(kind & _SURE) or (inline and kind > 0)
        at = len(self.stack)
        if not inline:
            self.parent.append(element)
            self.path.append(self.paths.setdefault((self.path[element], name), len(self.paths) + 1))
            self.tag.append(name)
            self.named.append(kind)
            element, block = len(self.parent) - 1, at
            barrier = barrier if name in _OPEN_ENDED else at
        self.stack.append((name, element, out, block, barrier))
        self.places[name].append(at)
        self.links += name == "a"

    def close_near(self, names: frozenset[str] | set[str]) -> None:
        """End the innermost open element of these names, unless a sectioning tag is nearer."""
        at = max((self.places[n][-1] for n in names if self.places[n]), default=0)
        if at and at >= self.stack[-1][4]:
            self.pop_to(at)

    def close(self, name: str) -> None:
        places = self.places[name]
        if name == "p" and not places:
            self.flush()
        elif places and (name not in _INLINE or places[-1] > self.stack[-1][3]):
            self.pop_to(places[-1])

    def held(self, sizes: list[int]) -> list[int]:
        """Sizes of elements with all that is in them (an element comes after its parent)."""
        out = list(sizes)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def wanted(self) -> list[tuple[str, int, int, bool]]:
        """Blocks that are not in an element whose class or id names something else."""
        sizes = [0] * len(self.parent)
        for text, element, *_ in self.blocks:
            sizes[element] += len(text)
        held = self.held(sizes)
        titled = self.held([int(t in ("h1", "main")) for t in self.tag])
        out = [False] * len(self.parent)
        for e in range(1, len(out)):
            most = 2 * held[e] > held[0] and (not self.named[e] & _KIND or titled[e] > 0)
            out[e] = out[self.parent[e]] or (self.named[e] > 0 and not most)
        return [b for b in self.blocks if not out[b[1]]]


def _smooth(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - RADIUS), min(len(values), i + RADIUS + 1)
        k = [_KERNEL[abs(i - j)] for j in range(lo, hi)]
        out.append(sum(a * b for a, b in zip(k, values[lo:hi])) / sum(k))
    return out


def ratios(body: list[tuple[str, int, int]]) -> tuple[dict[int, float], dict[int, float]]:
    """Of blocks (text, path, characters in links): each path's fused ratio, and its share of text outside links."""
    size, punct, links, count = Counter(), Counter(), Counter(), Counter()
    for text, path, linked in body:
        size[path] += len(text)
        punct[path] += len(_PUNCT.findall(text))
        links[path] += min(linked, len(text))
        count[path] += 1
    free = {p: 1 - links[p] / size[p] for p in size}
    lengths = _smooth([size[p] / count[p] * free[p] for _, p, _ in body])
    points = _smooth([(0.2 + punct[p] / count[p]) * free[p] for _, p, _ in body])
    fused: Counter[int] = Counter()
    for (_, path, _), a, b in zip(body, lengths, points):
        fused[path] += math.sqrt(a * b) / count[path]
    return fused, free


def content_paths(body: list[tuple[str, int, int]]) -> tuple[set[int], set[int]]:
    """Paths that are content, and paths that are mostly links."""
    fused, free = ratios(body)
    mean = sum(fused[p] * len(t) for t, p, _ in body) / sum(len(t) for t, *_ in body)
    linked = {p for p in free if 1 - free[p] >= LINKED}
    return {p for p in fused if p not in linked and fused[p] >= SHARE * mean}, linked


def main_blocks(source: str) -> list[str]:
    """Content blocks of a page, in order."""
    page = _Page(source)
    blocks = page.wanted()
    body = [(text, page.path[e], linked) for text, e, linked, heading in blocks if not heading]
    if not body:
        return [text for text, *_ in blocks]
    good, linked = content_paths(body)
    content = [not heading and page.path[e] in good for _, e, _, heading in blocks]
    sizes = [0] * len(page.parent)
    for (text, e, *_), own in zip(blocks, content):
        if own:
            sizes[page.parent[e]] += len(text)
    held = page.held(sizes)
    largest: dict[int, int] = {}
    for e in range(1, len(held)):
        best = largest.setdefault(page.parent[e], e)
        if held[e] > held[best]:
            largest[page.parent[e]] = e
    node = 0
    while page.tag[node] not in ("article", "main") and (e := largest.get(node)) is not None and held[e] >= HOLDS * held[0] > 0:
        node = e
    if page.tag[node] not in ("", "html", "body"):
        inside = [e == node for e in range(len(held))]
        for e in range(1, len(held)):
            inside[e] = inside[e] or inside[page.parent[e]]
        return [text for text, e, _, heading in blocks if inside[e] and (heading or page.path[e] not in linked)]
    homes = {page.parent[e] for (_, e, *_), own in zip(blocks, content) if own}
    out, follows = [], False
    for (text, e, _, heading), own in zip(reversed(blocks), reversed(content)):
        if own or (heading and (follows or page.parent[e] in homes)):
            out.append(text)
        follows = follows if heading else own
    return out[::-1]


def main_text(source: str | None) -> str:
    return "\n".join(main_blocks(source)) if source else ""


def extract(df: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every row; null html counts as empty, and a page without content has an empty text.

    Rows are independent: repeated rows and further columns have no effect, no rows give no rows.
    """
    bounded_batches(df.sparkSession)
    base = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(h) for h in b.column("html").to_pylist()]
            arrays = [b.column("key"), b.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "url", "text", "n_chars"])

    kind = dict(base.dtypes)["key"]
    out = base.mapInArrow(run, f"key {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("key", key)
