"""Main text of web pages: parser events, text-to-tag ratio, smoothing, clustering.

The standard library's parser streams a page's events once. Block elements cut the
text into lines; each line has its characters of text, the tags met in it, the characters of
links, and the container it stands in. Its text-to-tag ratio, smoothed by a Gaussian over
neighbouring lines, is split in two clusters (two-means on the smoothed ratios, from their
extremes; links count as tags with no text of their own). The text of the upper cluster's lines
is the weight of the containers around them, and selects the content regions:

* all outermost ``article`` and ``main`` elements that aren't mostly links, if they hold half of
  the weight at least;
* else the innermost container that holds all of it, without its parts that hold none and are
  mostly links.

All lines of the regions are kept, short ones too. Elements that are no text of an article by
the markup itself (menus, footers, asides, forms, scripts, styles, hidden ones, headers outside an
article) hold no lines; a form around most of the page is layout. Names (words of class and id)
are evidence only, and only if the whole name tells of such a part:

* outside articles the part goes, unless it holds most of the page's text or half of that in articles;
* inside an article a part named like a menu, header, notice or the like goes only if its text is mostly
  links, one named like an advert or sharing bar only if it is less than half of the article;
  reader comments go. Headings are never judged by their names;
* a part named like a discussion or like responses may be a section of an article or readers' comments: it goes if its structure is a thread's, that is if
  two or more of its children are alike in tag and class and hold most of its text.

White space inside a block becomes one space, blocks are joined by one line end in
page order, character references are decoded. Null and empty pages, and pages without
text, give an empty text; nothing is cut or capped. The work is linear in the page, however
elements are nested or left open, and whatever tags, quotes, comments or declarations aren't closed: what follows the last ``>`` is text, and a
comment or section that nothing closes ends at the next ``>``. Repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that hold no article text
OUT = frozenset("nav footer aside script style noscript template button select option textarea label iframe object svg canvas dialog head title menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: elements that may stand in the page's head; others end it
HEAD = frozenset("html head title meta link script style base noscript template".split())
CONTAINER = frozenset("article body div main section td".split())
#: start tags that end an open element of the second set
CLOSES = {t: frozenset(["p"]) for t in BLOCK - {"td", "th", "tr", "li", "dd", "dt", "option"}} | {
    "li": frozenset(["li", "p"]), "dd": frozenset(["dd", "dt", "p"]), "dt": frozenset(["dd", "dt", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: words of names by what they tell of: reader comments, adverts and the like, other parts of a page
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
THREADS = frozenset("discussion discussions feedback reactions responses talkback".split())
ADVERTS = frozenset(
    "ad ads advert adverts advertisement advertisements adslot consent cookie cookies newsletter popup promo promoted promotion share sharing signup skyscraper "
    "social sponsor sponsored subscribe".split()
)
PARTS = frozenset(
    "banner breadcrumb breadcrumbs disclaimer footer gdpr header login masthead menu modal nav navbar navigation notice notices pager pagination related "
    "search sidebar toolbar topbar widget widgets".split()
)
#: words of names that tell nothing by themselves
NEUTRAL = frozenset(
    "a an area bar block bottom box button buttons bx cell center col column container content cta field fixed form grid group heading icon icons id inner item items js left "
    "link links list main mobile module my new outer page panel primary reader row section site slot small sub text the title top ui unit user view wrap wrapper right secondary".split()
)
#: and those that tell nothing beside words of one kind
ABOUT = {"comment": frozenset("article blog entry news post posts story".split()), "thread": frozenset("article blog entry news post posts readers story user users visitor visitors".split()), "advert": frozenset("article blog entry post".split()), "part": frozenset("articles links posts reading stories topics".split())}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: elements at which the search for an open element that a start tag ends stops (a cell's own start tag looks past cells)
BARRIER = CONTAINER | (BLOCK - {"p", "li", "dd", "dt", "tr", "td", "th", "option"})
CELLS = frozenset(["tr", "td", "th"])
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_COMMENT_END = re.compile(r"--\s*>")
COMMENT, THREAD, ADVERT, PART, FORM = "comment", "thread", "advert", "part", "form"


def told(names: str) -> str | None:
    """What the names of an element tell, if all words of one of them do or are neutral."""
    found = set()
    for name in names.split():
        words = [w for w in _SPLIT.split(_CAMEL.sub(r"\1 \2", name).lower()) if w and not w.isdigit() and len(w) > 1]
        for kind, known in ((COMMENT, COMMENTS), (THREAD, THREADS), (ADVERT, ADVERTS), (PART, PARTS)):
            if not known.isdisjoint(words) and all(w in NEUTRAL or w in ABOUT[kind] or w in COMMENTS or w in THREADS or w in ADVERTS or w in PARTS for w in words):
                found.add(kind)
    return next((kind for kind in (COMMENT, THREAD, ADVERT, PART) if kind in found), None)


class Lines(HTMLParser):
    """Collects lines (text, tags, link characters, node) and nodes (parent, article, kind, inside an
    article). Nodes are containers and elements with a telling name, numbered in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, node around what follows, dropped
        self.where: dict[str, list[int]] = {}  # places of each open tag
        self.barriers, self.tables, self.containers = [-1], [-1], [-1]  # places of open barriers, those but cells, and containers
        self.nodes: list[tuple[int, bool, str | None, bool]] = [(0, False, None, False)]
        self.alike: list[tuple[str, str]] = [("", "")]  # each node's tag and class
        self.lines: list[tuple[str, int, int, int]] = []
        self.text, self.tags, self.linked = [], 0, 0
        self.dropped = self.articles = self.threads = 0

    def read(self, html: str):
        """The whole page. The parser looks for the end of each tag that isn't closed up to the page's end, so what has none isn't given to it."""
        end = html.rfind(">") + 1
        self.ends: tuple[str, int, int] | None = None
        self.feed(html[:end])
        self.close()
        if end < len(html) and self.cdata_elem is None:
            self.handle_data(unescape(html[end:]))
        self.cut()

    def closed(self) -> tuple[str, int, int]:
        """The text being parsed, and where its last comment and its last section can begin to be closed."""
        if self.ends is None or self.ends[0] is not self.rawdata:
            last = 0
            for m in _COMMENT_END.finditer(self.rawdata):
                last = m.start()
            self.ends = (self.rawdata, last - 4, self.rawdata.rfind("]]>"))
        return self.ends

    def parse_comment(self, i, report=1):
        return super().parse_comment(i, report) if i <= self.closed()[1] else -1

    def parse_marked_section(self, i, report=1):
        if self.rawdata[i : i + 9].lower() == "<![cdata[" and i <= self.closed()[2]:
            return self.rawdata.index("]]>", i) + 3
        return self.parse_bogus_comment(i)

    def node(self) -> int:
        return self.open[-1][1] if self.open else 0

    def end_head(self):
        if self.open and self.open[-1][0] == "head":
            self.pop(len(self.open) - 1)

    def cut(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.linked, self.node()))
        self.text, self.tags, self.linked = [], 0, 0

    def push(self, tag: str, node: int, dropped: bool):
        at = len(self.open)
        self.where.setdefault(tag, []).append(at)
        if tag in BARRIER:
            self.barriers.append(at)
            if tag not in CELLS:
                self.tables.append(at)
        if tag in CONTAINER:
            self.containers.append(at)
        self.open.append((tag, node, dropped))
        self.dropped += dropped

    def pop(self, upto: int):
        while len(self.open) > upto:
            tag, node, dropped = self.open.pop()
            self.where[tag].pop()
            for places in (self.barriers, self.tables, self.containers):
                if places[-1] == len(self.open):
                    places.pop()
            self.dropped -= dropped
            if node != self.node():
                self.articles -= self.nodes[node][1]
                self.threads -= self.nodes[node][2] == THREAD

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self.end_head()
        if tag in BLOCK:
            self.cut()
            # the outermost open elements that this tag ends, inside the last barrier
            last = (self.tables if tag in CELLS else self.barriers)[-1]
            ends = [p[k] for name in CLOSES.get(tag, ()) if (p := self.where.get(name)) and (k := bisect_right(p, last)) < len(p)]
            if ends:
                self.pop(min(ends))
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                self.text.append("" if tag == "wbr" else " ")
            return
        out, within = tag in OUT or tag == "header" and not self.articles, self.articles > 0
        given = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        role = given.get("role")
        article = tag in ("article", "main") or role == "main"
        kind = FORM if tag == "form" else None
        if given and tag not in ("html", "body"):
            out = out or role in ROLES or "hidden" in given or given.get("aria-hidden") == "true"
            out = out or "display:none" in given.get("style", "").replace(" ", "")
            if tag in BLOCK and tag not in HEADINGS and tag != "main":
                kind = told(given.get("class", "") + " " + given.get("id", "")) or kind
        node = self.node()
        if tag in CONTAINER or article or kind or tag == "li" and self.threads:
            self.nodes.append((node, article and kind is None, kind, within))
            self.alike.append((tag, given.get("class", "")))
            self.threads += kind == THREAD
            node = len(self.nodes) - 1
            self.articles += self.nodes[node][1]
        self.push(tag, node, out)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        places = self.where.get(tag)
        # an inline element's end tag ends nothing outside its container
        if places and (tag in CONTAINER or tag in BLOCK or places[-1] > self.containers[-1]):
            self.pop(places[-1])

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if not self.dropped:
            self.text.append(data)
            if self.where.get("a"):
                self.linked += len(data)


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(3 * sigma)
    at = np.arange(-reach, reach + 1)
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    ones = np.convolve(np.ones(len(x) + 2 * reach), kernel, "valid")
    ends = np.convolve(np.pad(np.ones(len(x)), reach), kernel, "valid")
    return np.convolve(np.pad(x, reach), kernel, "valid") / np.where(ends > 0, ends, ones)


def threshold(x: np.ndarray) -> float:
    """Two-means on a line, from the extremes."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        middle = (low + high) / 2
        upper = x >= middle
        if upper.all():
            break
        a, b = float(x[~upper].mean()), float(x[upper].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


def _summed(nodes, own: list[float]) -> list[float]:
    """For each node what it and all nodes inside it have: parents come before children."""
    out = list(own)
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i][0]] += out[i]
    return out


def _inside(nodes, chosen: list[bool]) -> list[bool]:
    """The nodes that are chosen or stand in one."""
    out = list(chosen)
    for i in range(1, len(nodes)):
        out[i] = out[i] or out[nodes[i][0]]
    return out


def _sizes(nodes, lines) -> tuple[list[float], list[float]]:
    """Characters of text and of links of each node."""
    text, links = [0.0] * len(nodes), [0.0] * len(nodes)
    for t, _, linked, node in lines:
        text[node] += len(t)
        links[node] += linked
    return _summed(nodes, text), _summed(nodes, links)


def _threads(nodes, alike, text) -> set[int]:
    """The nodes with two or more children alike that hold most of their text; of those named like a thread only."""
    kinds: dict[int, dict] = {}
    for i in range(1, len(nodes)):
        # a list's items count as children of what holds the list
        if nodes[nodes[i][0]][2] == THREAD and (alike[i][1] or alike[i][0] in ("li", "article")) and text[i]:
            sizes = kinds.setdefault(nodes[i][0], {}).setdefault(alike[i], [0, 0])
            sizes[0] += 1
            sizes[1] += text[i]
    return {i for i, by in kinds.items() if any(n > 1 and 2 * size > text[i] for n, size in by.values())}


def _no_content(nodes, lines, alike) -> list[bool]:
    """The nodes that go by their names, weighed as the module says."""
    text, links = _sizes(nodes, lines)
    threads = _threads(nodes, alike, text)
    top = [0] * len(nodes)  # the outermost article around each node
    for i in range(1, len(nodes)):
        top[i] = top[nodes[i][0]] or (i if nodes[i][1] else 0)
    inner = [0.0] * len(nodes)
    for t, _, _, node in lines:
        inner[node] += len(t) if top[node] else 0
    inner = _summed(nodes, inner)
    gone = [False] * len(nodes)
    for i, (_, _, kind, within) in enumerate(nodes):
        if kind is None or kind == THREAD and i not in threads:
            continue
        if kind == FORM:
            gone[i] = within or text[i] < 0.75 * text[0]
        elif within:
            gone[i] = kind in (COMMENT, THREAD) or kind == ADVERT and 2 * text[i] < text[top[i]] or kind == PART and 2 * links[i] >= text[i]
        elif inner[0]:
            gone[i] = 2 * inner[i] < inner[0]
        else:
            gone[i] = text[i] < 0.75 * text[0]
    return _inside(nodes, gone)


def extract(html: str, sigma: float = 1.0) -> str:
    page = Lines()
    page.read(html)
    nodes = page.nodes
    gone = _no_content(nodes, page.lines, page.alike)
    lines = [x for x in page.lines if not gone[x[3]]]
    if not lines:
        return ""
    ratio = np.array([max(0, len(t) - linked) / max(1, tags) for t, tags, linked, _ in lines], float)
    even = smooth(np.log1p(ratio), sigma)
    weight = [0.0] * len(nodes)
    for (text, _, linked, node), dense in zip(lines, even >= threshold(even)):
        weight[node] += max(0, len(text) - linked) if dense else 0
    weight = _summed(nodes, weight)
    text, links = _sizes(nodes, lines)
    linked = [2 * b >= a for a, b in zip(text, links)]
    outermost = [article and not within and not gone[i] for i, (_, article, _, within) in enumerate(nodes)]
    if 2 * sum(w for w, o in zip(weight, outermost) if o) >= weight[0] > 0:
        kept = _inside(nodes, [o and not x for o, x in zip(outermost, linked)])
    else:
        # those that hold all weight stand one in another: the last is the innermost one
        root = max(i for i, w in enumerate(weight) if w == weight[0])
        menus = _inside(nodes, [w == 0 and x and i != root for i, (w, x) in enumerate(zip(weight, linked))])
        inner = _inside(nodes, [i == root for i in range(len(nodes))])
        kept = [a and not b for a, b in zip(inner, menus)] if weight[0] else [True] * len(nodes)
    return "\n".join(t for t, _, _, node in lines if kept[node])


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
