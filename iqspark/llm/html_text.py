"""Main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import slices, texts_of

# Fixed values of HTML: raw-text, void and block elements, elements that a start tag closes, and those of a head.
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body canvas center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html", "head", "legend"}
P_SCOPE = ("td", "th", "li", "div", "article", "section", "blockquote", "body")
SAME = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
IN_HEAD = {"meta", "link", "title", "style", "script", "base", "noscript", "template", "head"}
#: Elements that are no candidates for the article by themselves: they hold text, not blocks.
LINES = set("p h1 h2 h3 h4 h5 h6 pre li dt dd address summary figcaption legend hr".split())
#: What an article is without: elements, and words of class, id and role: a name (comments), or the first or last part
#: of one (comment-list, site-footer, mainNav). Those of the second sort are menus or forms around a page's article at
#: times, so they go only where they hold no article or main.
NEVER = set("head nav footer aside script style noscript template iframe svg canvas object embed button select input textarea menu dialog".split())
UNLESS = {"form", "header"}
NEVER_WORDS = set("comment comments disqus replies navigation contentinfo complementary".split())
UNLESS_WORDS = set("ad ads advert adverts advertisement advertisements sponsored promo sidebar menu nav navbar breadcrumb breadcrumbs pagination notice notices cookie cookies consent newsletter popup modal footer search".split())
#: Parts of a name that say what a block has or does not have, not what it is.
SAYS_HAS = set("with has have no not without open closed enabled disabled".split())
#: Headers of a site by class, as the header element is one; an article's own header stays.
SITE_HEADERS = {"header", "site-header", "masthead", "topbar", "banner"}
#: An only article that has this share of the page's text holds the main text.
LONE_SHARE = 0.25
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


class Page:
    """The DOM of a page in document order: node k's parent stands before it, its descendants are k + 1 to end[k] - 1.

    flow has the page's texts (strings), starts (k) and ends (~k) of nodes in turn. drop: 1 for what an article never
    has, 2 for what goes unless it holds an article or main, 3 (by a part of a name only) unless it also holds most of the
    page's text.
    """

    def __init__(self, page: str):
        self.tag, self.parent, self.drop = ["#root"], [0], [0]
        self.chars, self.link_chars = [0], [0]
        self.flow: list[int | str] = []
        self.open: list[int] = [0]
        self.at: dict[str, list[int]] = defaultdict(list)  # depths at which elements of a tag are open
        self._parse(page)

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def _close(self, depth: int) -> None:
        """Ends the open nodes from a depth on."""
        while len(self.open) > depth:
            k = self.open.pop()
            self.at[self.tag[k]].pop()
            self.flow.append(~k)

    def _text(self, text: str) -> None:
        if not text:
            return
        self.flow.append(text)
        n = len(" ".join(text.split()))
        self.chars[self.open[-1]] += n
        if self.at["a"]:
            self.link_chars[self.open[-1]] += n

    def _start(self, tag: str, attrs: str, stays_open: bool) -> None:
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.drop.append(_dropped(tag, attrs, bool(self.at["article"] or self.at["main"])))
        self.chars.append(0)
        self.link_chars.append(0)
        self.flow.append(k)
        if stays_open:
            self.at[tag].append(len(self.open))
            self.open.append(k)
        else:
            self.flow.append(~k)

    def _parse(self, page: str) -> None:
        begin = pos = 0
        while m := _TOKEN.search(page, pos):
            self._text(page[begin : m.start()])
            begin = pos = m.end()
            if m[1]:
                if self.at[m[1].lower()]:
                    self._close(self.at[m[1].lower()][-1])
                continue
            if not m[2]:
                continue
            tag, attrs = m[2].lower(), m[3]
            if self.at["head"] and tag not in IN_HEAD:
                self._close(self.at["head"][-1])
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
                begin = pos = end.end() if end else len(page)
                continue
            if tag in ("html", "body") and self.at[tag]:
                continue
            if tag in CLOSES_P and self.at["p"] and self.at["p"][-1] > self._last(P_SCOPE):
                self._close(self.at["p"][-1])
            elif tag in SAME:
                same, stop = SAME[tag]
                least = self._last(stop)
                inner = [d[bisect_right(d, least)] for d in map(self.at.__getitem__, same) if d and d[-1] > least]
                if inner:
                    self._close(min(inner))
            self._start(tag, attrs, tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK))
        self._text(page[begin:])
        self._close(1)


def _says(name: str, words: set[str]) -> bool:
    """Whether one name of a class, id or role is a word, or begins or ends with it; those that only say that a block has
    such a thing (with-sidebar, no-comments, comments-open) are not."""
    if name.lower() in words:
        return True
    parts = [p.lower() for p in _PARTS.findall(name)]
    return len(parts) > 1 and not SAYS_HAS & {*parts} and (parts[0] in words or parts[-1] in words)


def _dropped(tag: str, attrs: str, in_article: bool) -> int:
    if tag in NEVER:
        return 1
    kind = 2 if tag in UNLESS and not (tag == "header" and in_article) else 0
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name = name.lower()
            if name in ("class", "id", "role"):
                said = value.strip("\"'").split()
                whole = tag in ("main", "body", "html")
                if any(x.lower() in NEVER_WORDS if whole else _says(x, NEVER_WORDS) for x in said):
                    return 1
                if whole or tag == "article":
                    continue
                if any(x.lower() in UNLESS_WORDS for x in said) or not in_article and any(x.lower() in SITE_HEADERS for x in said):
                    kind = 2
                elif not kind and any(_says(x, UNLESS_WORDS) for x in said):
                    kind = 3
            elif name == "aria-hidden" and value.strip("\"'").lower() == "true":
                return 1
        if _HIDDEN.search(_QUOTED.sub('""', attrs)):
            return 1
    return kind


def composite_density(chars: int, link_chars: int, tags: int, links: int, body_share: float) -> float:
    """Composite text density of a node (Sun, Song and Liao, 2011): C / T times the logarithm of C T / (LC LT) to the base
    ln(C LC / (C - LC) + body_share C + e). C and LC: characters, and those in links; T and LT: tags and link tags within;
    body_share: LC / C of the body. A figure of 0 counts as 1 in products and quotients; 0 for a node without text."""
    if not chars:
        return 0.0
    plain, tags, links, linked = max(chars - link_chars, 1), max(tags, 1), max(links, 1), max(link_chars, 1)
    base = math.log(math.log(chars * linked / plain + body_share * chars + math.e))
    return chars / tags * math.log(max(chars * tags / (linked * links), 1.0)) / base


class Densities:
    """Density, density sum and end of each node of a page, and which nodes go for what they are."""

    def __init__(self, page: Page):
        n = len(page.tag)
        chars, linked, tags, links, size, articles = page.chars[:], page.link_chars[:], [0] * n, [0] * n, [1] * n, [0] * n
        for k in range(n - 1, 0, -1):
            p = page.parent[k]
            if page.tag[k] == "a":
                links[k] += 1
            articles[k] += page.tag[k] in ("article", "main") and not page.drop[k]
            for x, more in ((chars, chars[k]), (linked, linked[k]), (tags, tags[k] + 1), (links, links[k]), (size, size[k]), (articles, articles[k])):
                x[p] += more
        self.end = [k + size[k] for k in range(n)]
        drop = [0 if d == 3 and 2 * (chars[k] - linked[k]) > chars[0] - linked[0] else min(d, 2) for k, d in enumerate(page.drop)]
        body = page.tag.index("body") if "body" in page.tag else 0
        share = linked[body] / chars[body] if chars[body] else 0.0
        self.density = [composite_density(chars[k], linked[k], tags[k], links[k], share) for k in range(n)]
        # shell: a menu or form around an article, of which only the way to the article is left.
        self.dropped, self.shell, self.sums = [False] * n, [False] * n, [0.0] * n
        for k in range(1, n):
            p = page.parent[k]
            self.dropped[k] = self.dropped[p] or drop[k] == 1 or (drop[k] == 2 or self.shell[p]) and not articles[k]
            self.shell[k] = (drop[k] == 2 or self.shell[p]) and not (page.tag[k] in ("article", "main") and not drop[k])
            if not self.dropped[k]:
                self.sums[page.parent[k]] += self.density[k]
        #: Characters within a node that no dropped one holds.
        self.kept_chars = [0 if self.dropped[k] else page.chars[k] for k in range(n)]
        for k in range(n - 1, 0, -1):
            self.kept_chars[page.parent[k]] += self.kept_chars[k]


def chosen(page: Page) -> list[bool]:
    """For each node, whether texts directly in it belong to the article."""
    n, d = len(page.tag), Densities(page)
    fit = [k for k in range(n) if d.sums[k] > 0 and not d.dropped[k] and not d.shell[k] and page.tag[k] not in LINES and (k == 0 or page.tag[k] in BLOCK)]
    best = max(fit, key=lambda k: (d.sums[k], -k), default=0)
    # An article that holds the subtree is taken whole, and so is the only one of a page: what stands beside it is not its.
    x = best
    while x and page.tag[x] != "article":
        x = page.parent[x]
    best = x or best
    articles = [k for k in range(n) if page.tag[k] == "article" and not d.dropped[k] and not d.shell[k]]
    lone = len(articles) == 1 and d.kept_chars[articles[0]] >= LONE_SHARE * d.kept_chars[0] > 0
    if lone:
        best = articles[0]
    # Threshold: the least density on the path from the subtree to the body; what is beside the path must reach it.
    threshold, path, x = d.density[best], {best}, best
    while x and page.tag[x] != "body":
        x = page.parent[x]
        path.add(x)
        threshold = min(threshold, d.density[x]) if x else threshold
    kept, whole = [False] * n, [False] * n
    for k in range(n):
        p = page.parent[k]
        beside = not lone and k > 0 and p in path and k not in path and d.density[k] >= threshold > 0
        whole[k] = not d.dropped[k] and (k == best or k > 0 and whole[p] or beside)
        kept[k] = (whole[k] or not lone and k in path and not d.dropped[k]) and not d.shell[k]
    return kept


def main_text(page: str | None) -> str:
    """The article's blocks joined by line feeds, as described in extract."""
    if not page:
        return ""
    dom = Page(page)
    kept = chosen(dom)
    out: list[list[str]] = [[]]
    at = 0
    for x in dom.flow:
        if isinstance(x, str):
            if kept[at]:
                out[-1].append(x)
            continue
        k = x if x >= 0 else ~x
        at = k if x >= 0 else dom.parent[k]
        if dom.tag[k] == "br":
            out[-1].append(" ")
        elif dom.tag[k] in BLOCK:
            out.append([])
    texts = (" ".join(html.unescape("".join(b)).split()) for b in out)
    return "\n".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html), from the whole html.

    Each node of the DOM has its composite text density (composite_density) and the sum of its children's. The block
    with the largest sum (of equal ones the first; the whole article element if it stands in one) is the main text;
    subtrees beside its path to the body join it if they reach the least density on that path, and text directly on the
    path does. The only article element of a page that has LONE_SHARE of its text is the main text, and nothing joins it.
    What an article never has (NEVER, UNLESS and their words: menus, forms, notices, comments) is neither a candidate nor
    part of a sum nor of the text; a word counts as a whole name of a class, id or role, or as its first or last part.
    Blocks
    are joined in page order by one line feed; white space within a block is one space; character references are
    decoded. Time is linear in the page's length, however deep its elements. A null, empty or textless page has an empty
    text; unclosed elements end where HTML ends them; rows are independent, repeated ones stay; extra columns are
    ignored.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = [main_text(h) for h in texts_of(piece.column("html"))]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("CAST(page_id AS long) page_id", "CAST(url AS string) url", "CAST(html AS string) html").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
