"""Main text of HTML pages by composite text density.

Tree. A tolerant reader makes a tree of elements: a new block closes an open paragraph, a list
item, cell or term closes the one before it, an end tag without its start is left out, and
whatever is open at the end is closed. Comments, scripts, styles and other raw text are left out.

Boilerplate that says so goes first: menus, footers, sidebars, forms, notices, adverts and reader
comments by element, role or words of class and id, a page's header (headings within an article's
header stay), and hidden elements. An element that holds an ``article`` or ``main``, or a form
or header that holds most of the page, is not such boilerplate, except for comments.

Density. For every element left, with C characters, T tags, L characters in links, K links, and
those of the body (Lb, Cb),

    density = C/T * log(C/L * T/K) / log(log(C/(C - L) * L + Lb/Cb * C + e))

where zero counts are taken as one. An element's sum is that of its children's densities, text right
in it counting as one more child; one that holds no block counts as its own only child. The element
with the largest sum is the main one. The least density on its way up to the body is the
threshold: outside the main element, other elements that reach it give the one with the largest
sum among themselves and what they hold. Where the main element lies in an ``article`` or
``main``, the text is all of that; otherwise what lies between the chosen elements of one parent, and
paragraphs and headings right beside them, come along. Inside, lists and divisions that are mostly links go.

Blocks. White space within a block is one space, ``br`` included; blocks are joined by a line
break. Character references are decoded.

Scale. A row is handled alone, a few pages at a time in a task: no shuffle, nothing collected. Reading a
page and all sums are linear in its length, whatever its nesting.

Defined cases. Null html is empty, a page without text (or with nothing but boilerplate) gives
an empty text. A page without tags is one block. Of equal sums the outermost element, then the
first in the page, is taken. Repeated rows are handled each. Columns beyond the one named are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrank.llm.common import texts

# Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "html body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul caption video audio noscript object".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | {"p", "blockquote", "pre"}
SCOPES = frozenset("table td th caption button object".split())
# what a new element closes: the nearest of these that is open, if it is one of the named
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "tbody", "thead"),
    "tfoot": ("td", "th", "tr", "tbody", "thead"), "thead": ("td", "th", "tr", "tbody"),
}
CONTAINERS = frozenset(
    "li ul ol menu dl dt dd table thead tbody tfoot tr td th select option article section aside nav header footer "
    "main form body blockquote".split()
)
# What marks boilerplate.
DROPPED = frozenset(
    "nav aside footer script style head template noscript iframe object svg canvas button select textarea input "
    "label audio video map dialog menu search".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar "
    "tablist".split()
)
REMARKS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
MARKS = frozenset(
    "ad ads adbox adsense adsbygoogle advert adverts advertisement advertising advertorial sponsor sponsored sponsors "
    "promo promos promotion cookie cookies cookiebar cookiebanner cookieconsent consent gdpr notice notices banner "
    "sidebar sidebars sidenav nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar toolbar "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay "
    "pagination pager copyright skip sitemap disclaimer paywall outbrain taboola searchform searchbox alert".split()
)
HEADERS = frozenset((*((w, "header") for w in "site page global top main".split()), ("header",)))
NEGATED = frozenset("no not has with without is non after before".split())
_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
# the rest of a tag; quoted values may hold ">", a quote that is never closed does not count
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+>?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_ARTICLE, _MAIN = "article", "main"
#: Share of links from which a list or division inside the text is a menu.
LINKS = 0.7


def _marked(values: list[str], words: frozenset[str]) -> bool:
    """Whether a class or id is one of the words, alone or joined to others, unless negated."""
    for value in values:
        parts = [p.lower() for p in _WORDS.findall(value)]
        if words is MARKS and tuple(parts) in HEADERS:
            return True
        for i, part in enumerate(parts):
            if part in words and not (i and parts[i - 1] in NEGATED):
                return True
    return False


class Page:
    """The tree of a page: for each element its parent, tag and flags; and its texts in order."""

    def __init__(self, html: str):
        self.tags, self.parents = ["body"], array("q", [-1])
        self.boilerplate, self.remarks, self.hidden = bytearray(1), bytearray(1), bytearray(1)
        #: (element, text); text None stands for the border of a block, at the element it lies in
        self.pieces: list[tuple[int, str | None]] = []
        self._read(html)

    def _element(self, tag: str, parent: int, source: str) -> int:
        names, role, style = [], "", ""
        dropped = tag in DROPPED
        hidden = False
        if source:
            for name, a, b, c in _ATTRIBUTE.findall(source):
                name, value = name.lower(), a or b or c
                if name in ("class", "id"):
                    names += value.split()
                elif name == "role":
                    role = value.strip().lower()
                elif name == "style":
                    style = value.replace(" ", "").lower()
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    hidden = True
        whole = tag in ("html", "body", _ARTICLE, _MAIN)
        self.tags.append(tag)
        self.parents.append(parent)
        self.boilerplate.append(dropped or role in ROLES or (not whole and _marked(names, MARKS)))
        # an article that says it has comments is not one
        remark = any(n.lower() in REMARKS for n in names) if tag == _ARTICLE else _marked(names, REMARKS)
        self.remarks.append(remark and tag != _MAIN)
        self.hidden.append(hidden or "display:none" in style or "visibility:hidden" in style)
        if role == "main" or any(n.lower() in ("articlebody", "main-content", "maincontent") for n in names):
            self.tags[-1] = _MAIN if tag in ("div", "section") else tag
        return len(self.tags) - 1

    def _read(self, html: str) -> None:
        stack, nearest, scopes, last_block = [0], [0], [-1], [0]
        at_name: dict[str, list[int]] = {"body": [0]}
        names = ["body"]
        pieces = self.pieces

        def pop_to(depth: int) -> None:
            """Closes all elements from a depth on."""
            while len(stack) > depth:
                node = stack.pop()
                name = names.pop()
                at_name[name].pop()
                nearest.pop(), scopes.pop(), last_block.pop()
                if name in BLOCKS:
                    pieces.append((node, None))

        def push(tag: str, source: str) -> None:
            node = self._element(tag, stack[-1], source)
            depth = len(stack)
            stack.append(node)
            names.append(tag)
            at_name.setdefault(tag, []).append(depth)
            nearest.append(depth if tag in CONTAINERS else nearest[-1])
            scopes.append(depth if tag in SCOPES else scopes[-1])
            last_block.append(depth if tag in BLOCKS else last_block[-1])
            if tag in BLOCKS:
                pieces.append((node, None))

        position, size = 0, len(html)
        while position < size:
            token = _TOKEN.search(html, position)
            start = size if token is None else token.start()
            if start > position:
                pieces.append((stack[-1], unescape(html[position:start])))
            if token is None:
                break
            tag = token.group(2)
            if tag is None:
                if token.group(0) == "<!--":
                    end = html.find("-->", start + 4)
                    position = size if end < 0 else end + 3
                else:
                    end = html.find(">", start)
                    position = size if end < 0 else end + 1
                continue
            tag = tag.lower()
            position = _REST.match(html, token.end()).end()
            source = html[token.end():position].rstrip(">")
            if token.group(1):
                places = at_name.get(tag)
                if tag in ("html", "body"):
                    continue
                if tag == "p" and not (places and places[-1] > scopes[-1]):
                    pieces.append((stack[-1], None))
                    continue
                if not places or places[-1] < scopes[-1] or (tag not in BLOCKS and places[-1] < last_block[-1]):
                    continue
                pop_to(places[-1])
                continue
            if tag in ("html", "body"):
                continue
            if tag in BLOCKS:
                if at_name.get("head"):
                    pop_to(at_name["head"][-1])
                # an open paragraph holds no other block, so it is the last block if there is one
                if names[last_block[-1]] == "p":
                    pop_to(last_block[-1])
                if tag in HEADINGS and names[last_block[-1]] in HEADINGS:
                    pop_to(last_block[-1])
                for _ in CLOSES.get(tag, ()):
                    if names[nearest[-1]] in CLOSES[tag]:
                        pop_to(nearest[-1])
            if tag == "a" and at_name.get("a") and at_name["a"][-1] > scopes[-1]:
                places = at_name["a"]
                if places[-1] > last_block[-1]:
                    pop_to(places[-1])
            push(tag, source)
            if tag in RAW and not source.endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, position)
                position = size if close is None else close.start()
                continue
            if tag in VOID:
                if tag == "br":
                    pieces.append((stack[-1], " "))
                pop_to(len(stack) - 1)
        pop_to(0)


def _subtree_sums(parents: array, values: list[int]) -> list[int]:
    """Sums over each element and all below it; an element comes after its parent."""
    for i in range(len(parents) - 1, 0, -1):
        values[parents[i]] += values[i]
    return values


def _alive(page: Page) -> bytearray:
    """1 for every element that is no boilerplate and lies in none."""
    parents, tags, n = page.parents, page.tags, len(page.tags)
    size = [0] * n
    for node, text in page.pieces:
        if text and tags[node] not in DROPPED and tags[node] not in RAW:
            size[node] += len(text) - text.count(" ")
    size = _subtree_sums(parents, size)
    article = _subtree_sums(parents, [int(t in (_ARTICLE, _MAIN)) for t in tags])
    inside, alive = bytearray(n), bytearray(n)
    alive[0] = 1
    for i in range(1, n):
        up = parents[i]
        inside[i] = inside[up] or tags[up] in (_ARTICLE, _MAIN)
        if not alive[up] or page.hidden[i] or page.remarks[i] or tags[i] in RAW:
            continue
        whole = article[i] - (tags[i] in (_ARTICLE, _MAIN)) > 0
        if tags[i] in ("form", "header"):
            # what wraps the page, or an article's own heading, is kept
            alive[i] = whole or 3 * size[i] >= 2 * size[0] or (tags[i] == "header" and inside[i])
        else:
            alive[i] = not page.boilerplate[i] or (whole and tags[i] not in DROPPED)
    for i in range(1, n):
        # of an article's header only headings stay
        up = parents[i]
        if not alive[up]:
            alive[i] = 0
        elif tags[up] == "header" and inside[up] and tags[i] not in HEADINGS and tags[i] not in ("hgroup", "div"):
            if not article[up]:
                alive[i] = 0
    return alive


def density(chars: int, marks: int, link_chars: int, links: int, body: float) -> float:
    """Composite density from counts; ``body`` is the body's share of characters in links."""
    if not chars:
        return 0.0
    t, l, k = max(marks, 1), max(link_chars, 1), max(links, 1)
    base = math.log(math.log(chars / max(chars - link_chars, 1) * l + body * chars + math.e))
    return chars / t * math.log(max(chars / l * t / k, 1.0)) / base


def _sums(parents: array, tags: list[str], own: list[float], direct: list[float]) -> list[float]:
    """For each element the sum of its children's densities, ``direct`` being that of its own text."""
    sums, holds = [0.0] * len(parents), bytearray(len(parents))
    for i in range(len(parents) - 1, 0, -1):
        holds[parents[i]] |= holds[i] or tags[i] in BLOCKS
    for i in range(1, len(parents)):
        sums[parents[i]] += own[i]
    return [s + d if h else o for s, d, h, o in zip(sums, direct, holds, own)]


def _best_below(parents: array, sums: list[float]) -> list[int]:
    """For each element the one with the largest sum among itself and all below it."""
    best = list(range(len(parents)))
    for i in range(len(parents) - 1, 0, -1):
        up = parents[i]
        # children come last to first, so that the first of equal ones wins, and an element over those below it
        if sums[best[i]] > sums[best[up]] or (sums[best[i]] == sums[best[up]] and best[up] != up):
            best[up] = best[i]
    return best


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    parents, tags, n = page.parents, page.tags, len(page.tags)
    alive = _alive(page)

    in_link, chars = bytearray(n), [0] * n
    for i in range(1, n):
        in_link[i] = tags[i] == "a" or in_link[parents[i]]
    for node, text in page.pieces:
        if text and alive[node]:
            # characters as the output has them, but for the spaces at borders
            chars[node] += len(" ".join(text.split()))
    direct = list(chars)
    link_chars = [c if in_link[i] else 0 for i, c in enumerate(chars)]
    links = [int(tags[i] == "a" and alive[i]) for i in range(n)]
    marks = [int(i > 0 and alive[i]) for i in range(n)]
    for values in (chars, link_chars, links, marks):
        _subtree_sums(parents, values)
    for i in range(1, n):
        marks[i] -= alive[i]
    if not chars[0]:
        return ""
    body = link_chars[0] / chars[0]
    own = [density(*counts, body) for counts in zip(chars, marks, link_chars, links)]
    sums = _sums(parents, tags, own, [density(c, 1, 0, 0, body) for c in direct])
    best = _best_below(parents, sums)
    menu = bytearray(
        tags[i] in ("ul", "ol", "div", "section", "table", "dl") and links[i] > 1 and link_chars[i] >= LINKS * chars[i]
        for i in range(n)
    )

    chosen = best[0]
    threshold, way, article = own[chosen], chosen, None
    while way >= 0:
        threshold = min(threshold, own[way])
        if article is None and tags[way] in (_ARTICLE, _MAIN):
            article = way
        way = parents[way]

    kept = bytearray(n)
    if article is not None:
        kept[article] = 1
    else:
        _keep_dense(page, alive, menu, own, best, threshold, kept)
    return _written(page, alive, menu, kept)


def _keep_dense(
    page: Page, alive: bytearray, menu: bytearray, own: list[float], best: list[int], threshold: float, kept: bytearray,
) -> None:
    """Marks the main element, all others as dense as the threshold, and what lies between them."""
    parents, tags, n = page.parents, page.tags, len(page.tags)
    kept[best[0]] = 1
    reached = bytearray(n)
    for i in range(n):
        reached[i] = alive[i] and own[i] >= threshold and (i == 0 or reached[parents[i]])
        if reached[i] and tags[i] in BLOCKS:
            kept[best[i]] = 1
    # the first and last kept child of every parent, counting what they hold
    holds = _subtree_sums(parents, [int(k) for k in kept])
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i in range(1, n):
        if holds[i]:
            first.setdefault(parents[i], i)
            last[parents[i]] = i
    beside: dict[int, list[int]] = {}
    ended = bytearray(n)
    for i in range(1, n):
        up = parents[i]
        if not alive[i] or up not in first or holds[i]:
            continue
        if first[up] < i < last[up]:
            kept[i] = not menu[i]
        elif tags[i] not in TEXTUAL:
            # a division ends the run of paragraphs before it, and the one after the chosen ones
            if i < first[up]:
                beside.pop(up, None)
            else:
                ended[up] = 1
        elif i < first[up]:
            beside.setdefault(up, []).append(i)
        elif not ended[up]:
            kept[i] = 1
    for run in beside.values():
        for i in run:
            kept[i] = 1


def _written(page: Page, alive: bytearray, menu: bytearray, kept: bytearray) -> str:
    """The text of the kept elements, a line to a block."""
    parents, n = page.parents, len(page.tags)
    shown = bytearray(n)
    shown[0] = kept[0]
    for i in range(1, n):
        shown[i] = kept[i] or (alive[i] and not menu[i] and shown[parents[i]])
    lines, block = [], []
    for node, text in page.pieces:
        if text is None:
            if block:
                lines.append(" ".join("".join(block).split()))
                block = []
        elif shown[node]:
            block.append(text)
    lines.append(" ".join("".join(block).split()))
    return "\n".join(line for line in lines if line)


def extracted(html: Column) -> Column:
    """The main text of a column of pages."""

    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for _, part in texts(pages) for p in part], pa.string())

    return F.arrow_udf(extract, "string")(html)
