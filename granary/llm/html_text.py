"""Operator 5: the main text of web pages by minimum-cut labelling.

A page is read into blocks of text (paragraphs, headings, list items, cells). A fixed linear classifier gives each
block the log-odds of being content, from its length, punctuation and share of link text, its element, where it lies
(inside or outside the page's largest article), and what tags, classes, ids and roles above it say. The log-odds are
the capacities from the source (content) and to the sink (boilerplate). Smoothness edges join neighbouring blocks,
the weaker the further apart they are in the tree, and consecutive elements of one kind in one container. The
minimum cut is the labelling of least cost.

No feature outweighs the edges of a block among its like (FULL_EDGES), so what a name says is a hint that the text
around it can overrule: a paragraph in a box that is called "more-story" stays, a caption between paragraphs stays,
and a promotion between two paragraphs leaves because several features agree. A name counts the less the more of the
page's text its element holds, as boilerplate is no page's bulk.

Scripts, styles, titles, form controls and embedded objects are dropped with what they hold, if they are closed by
their own end tags; an unclosed one hides nothing. Character references are decoded, white space inside a block
becomes one space, and content blocks are joined in page order by one space. Null or empty html gives the empty
text; a page without content too, and an empty table no rows. Ties of the cut go to boilerplate. Unclosed and stray
tags are tolerated; reading takes time and memory in proportion to the page, however long it is and however deep its
elements nest. Repeated rows are extracted like any others, and extra columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections import deque
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds of HTML elements.
_HUSHED = set("script style noscript template title textarea select option button svg math iframe object canvas video audio label".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var picture".split())
_CONTAINERS = set("div ul ol dl table section article aside nav header footer main form body html blockquote".split())
_CLOSE_P = set("p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 blockquote pre hr figure address".split())
#: An open element of the first kind ends where one of the second kind begins.
_ENDS = {"p": _CLOSE_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

#: The classifier's weights. Edges first: to a neighbour, to the next of one kind in a container, and what is left of
#: an edge between elements of different kinds. FULL_EDGES is what holds a block among its like.
NEXT, LIKE, UNLIKE = 1.2, 0.8, 0.4
FULL_EDGES = 2 * NEXT + 2 * LIKE
PRIOR, PER_CHAR, LONG, STOP, LINKS, OUTSIDE, INSIDE, TITLE, RIGHTS, HIDDEN, FURTHER = -1.0, 0.01, 2.2, 0.4, 3.0, 1.2, 1.0, 1.2, 1.0, 3.0, 1.0
_ELEMENTS = {"p": 0.4, "h1": 0.6, "h2": 0.6, "h3": 0.6, "h4": 0.4, "blockquote": 0.4, "pre": 0.4, "figcaption": 0.2}
_TAGS = {"nav": 2.8, "footer": 2.8, "aside": 2.8, "menu": 2.8, "dialog": 2.8, "header": 2.4, "form": 2.0}
#: What names say against content: plainly, or as a hint only; and for content.
_PLAIN = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe subscription signup login share sharing social recommended recommendations pager pagination paywall disclaimer "
    "contentinfo complementary comment comments commentlist replies respond disqus feedback".split()
)
_HINTS = set("side rail foot bottom header head privacy alert overlay register follow related recirc more popular trending paging tags widget search skip legal copyright form discussion reply reviews dialog".split())
_FOR = set("article content main post entry story body text page prose".split())
_COMMENTS = set("comment comments commentlist discussion replies reply respond disqus feedback reviews".split())
_RIGHTS = re.compile(r"©|\(c\) \d{4}|all rights reserved", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@functools.lru_cache(4096)
def _says(tag: str, names: str) -> tuple[float, float, bool]:
    """What an element's tag and names say against content and for it, and whether it holds readers' comments."""
    if tag in ("html", "body"):
        return 0.0, 0.0, False
    words = {w.lower() for w in _WORD.findall(names)}
    good = 1.0 if words & _FOR else 0.0
    bad = 2.8 if words & _PLAIN else 1.4 if words & _HINTS else 0.0
    if good and not words & _PLAIN:
        bad /= 2
    return max(bad, _TAGS.get(tag, 0.0)), good, bool(words & _COMMENTS)


class Block(NamedTuple):
    text: str
    linked: int  # characters of links
    node: int


class Page(HTMLParser):
    """The blocks of a page, and its elements as arrays: parent, tag, names, depth. Element 0 is the page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.depth, self.hidden, self.shut = [0], [""], [""], [0], [False], [False]
        self.open = [0]  # elements that are open
        self.blocks_open, self.containers, self.enders = [0], [0], []  # places in open of some kinds of them
        self.at: dict[str, list[int]] = {}  # places in open by tag
        self.text: list[str] = []
        self.hush: dict[int, list[str]] = {}
        self.hushing: list[int] = []
        self.linked = 0
        self.title = ""
        self.blocks: list[Block] = []
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.blocks.append(Block(text, min(self.linked, len(text)), self.open[self.blocks_open[-1]]))
            self.text, self.linked = [], 0
        if self.hush:
            for node, parts in self.hush.items():
                if text := " ".join("".join(parts).split()):
                    self.blocks.append(Block(text, 0, node))
            self.hush = {}

    def _leave(self, place: int) -> None:
        """Close the open elements from that place on."""
        while len(self.open) > place:
            node = self.open.pop()
            self.at[self.tag[node]].pop()
            for places in (self.blocks_open, self.containers, self.enders):
                if places and places[-1] == len(self.open):
                    places.pop()
            if self.hushing and self.hushing[-1] == node:
                self.hushing.pop()

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self._flush()
            return
        block = tag not in _INLINE and tag not in _HUSHED
        if block:
            self._flush()
            for place in reversed(self.enders):
                if place < self.containers[-1]:
                    break
                if tag in _ENDS[self.tag[self.open[place]]]:
                    self._leave(place)
                    break
        names, hidden = "", False
        for k, v in attrs:
            if v and k in ("class", "id", "role"):
                names += f"{v} "
            elif k == "hidden" or v and (k == "aria-hidden" and v == "true" or k == "style" and "display:none" in v.replace(" ", "")):
                hidden = True
        place, node = len(self.open), len(self.tag)
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.names.append(names)
        self.depth.append(self.depth[self.open[-1]] + 1)
        self.hidden.append(hidden)
        self.shut.append(False)
        self.open.append(node)
        self.at.setdefault(tag, []).append(place)
        if block:
            self.blocks_open.append(place)
        if tag in _CONTAINERS:
            self.containers.append(place)
        elif tag in _ENDS:
            self.enders.append(place)
        if tag in _HUSHED:
            self.hushing.append(node)

    def handle_endtag(self, tag):
        places = self.at.get(tag)
        if tag in _VOID or not places:
            return
        if tag in _INLINE:
            if places[-1] < self.blocks_open[-1]:
                return
        elif tag not in _HUSHED or places[-1] < self.blocks_open[-1]:
            self._flush()
        self.shut[self.open[places[-1]]] = tag in _HUSHED
        self._leave(places[-1])

    def handle_data(self, data):
        if self.hushing and self.hushing[-1] > self.open[self.blocks_open[-1]]:  # no block has begun inside
            if self.tag[self.hushing[-1]] not in ("script", "style"):
                self.hush.setdefault(self.hushing[-1], []).append(data)
                if self.tag[self.hushing[-1]] == "title" and not self.title:
                    self.title = " ".join(data.split())
            return
        self.text.append(data)
        if self.at.get("a"):
            self.linked += len(data.strip())


def read(html: str) -> tuple[Page, list[Block]]:
    """The page and those of its blocks that no closed script, control or embedded object holds."""
    page = Page(html)
    gone = [False] * len(page.tag)
    for k in range(1, len(gone)):
        gone[k] = page.shut[k] or gone[page.parent[k]]
    return page, [b for b in page.blocks if not gone[b.node]]


def log_odds(page: Page, blocks: list[Block]) -> list[float]:
    """The classifier: positive for content. No summand is beyond FULL_EDGES."""
    count = len(page.tag)
    held = [0] * count
    for b in blocks:
        held[b.node] += len(b.text)
    for k in range(count - 1, 0, -1):
        held[page.parent[k]] += held[k]
    total = max(held[0], 1)
    # by element: the strongest mark above it, all marks, the best word for it, hidden, in comments, in an article
    strongest, marks, good, hidden, comments, article = [0.0] * count, [0.0] * count, [0.0] * count, [False] * count, [False] * count, [0] * count
    for k in range(1, count):
        up = page.parent[k]
        bad, fine, talk = _says(page.tag[k], page.names[k])
        if page.tag[k] == "header" and article[up]:
            bad = 0.0  # an article's own heading
        bad *= 1 - (held[k] / total) ** 2
        strongest[k], marks[k], good[k] = max(strongest[up], bad), marks[up] + bad, max(good[up], fine)
        hidden[k], comments[k] = hidden[up] or page.hidden[k], comments[up] or talk
        article[k] = k if page.tag[k] in ("article", "main") and not comments[k] else article[up]
    largest = max(set(article) - {0}, key=lambda k: (held[k], -k), default=0)
    if 2 * held[largest] < sum(held[k] for k in range(1, count) if article[k] == k and not article[page.parent[k]]):
        largest = 0  # one of many summaries
    inside = [False] * count
    for k in range(1, count):
        inside[k] = inside[page.parent[k]] or k == largest > 0
    out = []
    for b in blocks:
        n, k, tag = len(b.text), b.node, page.tag[b.node]
        odds = PRIOR + min(n * PER_CHAR, LONG) + _ELEMENTS.get(tag, 0.0) + max(good[k], INSIDE * inside[k]) - strongest[k] - min(marks[k] - strongest[k], FURTHER) - HIDDEN * hidden[k]
        odds -= LINKS * max(b.linked / n - 0.2, 0) / 0.8
        odds += STOP if b.text[-1] in ".!?…:;»”\"'" else 0.0
        if largest and not inside[k]:
            odds -= OUTSIDE
        if tag in ("h1", "h2") and page.title and (b.text in page.title or page.title in b.text):
            odds += TITLE
        if n < 200 and _RIGHTS.search(b.text):
            odds -= RIGHTS
        out.append(odds)
    return out


def smoothness(page: Page, blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between blocks that follow each other, by their distance in the tree, and between elements of one kind
    (tag and names) that follow each other in one container."""
    parent, depth = page.parent, page.depth
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple, int] = {}
    for k, b in enumerate(blocks):
        kind = page.tag[b.node], page.names[b.node]
        if k:
            # the climb costs no more than the elements that begin or end between the two blocks
            x, y, apart = blocks[k - 1].node, b.node, 0
            while x != y:
                if depth[x] >= depth[y]:
                    x = parent[x]
                else:
                    y = parent[y]
                apart += 1
            before = blocks[k - 1].node
            alike = kind == (page.tag[before], page.names[before])
            edges[k - 1, k] = NEXT / (1 + max(apart - 2, 0) / 2) * (1.0 if alike else UNLIKE)
        place = parent[b.node], *kind
        if place in last:
            pair = last[place], k
            edges[pair] = edges.get(pair, 0.0) + LIKE
        last[place] = k
    return edges


_UNIT = 64  # capacities are whole numbers of such parts


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The side of each node in a minimum cut; True: the source's (content). Capacities are rounded to 1 / _UNIT.

    A node whose terminal capacity is at least the sum of its open edges takes that side in some minimum cut; it is
    fixed, and its edges move to its neighbours' terminals. What is left is cut by blocking flows along shortest paths.
    """
    near: list[dict[int, int]] = [{} for _ in odds]
    for (a, b), w in edges.items():
        near[a][b] = near[b][a] = near[a].get(b, 0) + round(w * _UNIT)
    left = [round(o * _UNIT) for o in odds]
    side: list[bool | None] = [None] * len(odds)
    around = [sum(x.values()) for x in near]
    todo = deque(range(len(odds)))
    while todo:
        k = todo.popleft()
        if side[k] is not None or abs(left[k]) < around[k]:
            continue
        side[k] = left[k] > 0
        for j, w in near[k].items():
            if side[j] is None:
                left[j] += w if side[k] else -w
                around[j] -= w
                todo.append(j)
    rest = [k for k in range(len(odds)) if side[k] is None]
    flow = {k: {j: w for j, w in near[k].items() if side[j] is None} for k in rest}
    gives, takes = {k: max(left[k], 0) for k in rest}, {k: max(-left[k], 0) for k in rest}
    while True:
        # distances from the source over what capacity is left
        level = {k: 0 for k in rest if gives[k]}
        todo, reached = deque(level), False
        while todo:
            k = todo.popleft()
            reached = reached or takes[k] > 0
            for j, w in flow[k].items():
                if w and j not in level:
                    level[j] = level[k] + 1
                    todo.append(j)
        if not reached:
            break
        ways = {k: iter(list(flow[k])) for k in level}
        for start in [k for k in level if not level[k]]:
            path = [start]
            while path and gives[start]:
                k = path[-1]
                if takes[k]:
                    pairs = list(zip(path, path[1:], strict=False))
                    most = min([gives[start], takes[k], *(flow[a][b] for a, b in pairs)])
                    gives[start] -= most
                    takes[k] -= most
                    for a, b in pairs:
                        flow[a][b] -= most
                        flow[b][a] += most
                    cut = next((n for n, (a, b) in enumerate(pairs) if not flow[a][b]), None)
                    if cut is not None:
                        del path[cut + 1 :]
                    continue
                step = next((j for j in ways[k] if flow[k][j] and level.get(j, -1) == level[k] + 1), None)
                if step is None:
                    path.pop()
                else:
                    path.append(step)
    for k in rest:
        side[k] = k in level
    return side


def labelled(html: str) -> tuple[list[Block], list[float], list[bool]]:
    """The blocks, their log-odds, and whether each is content by the cut."""
    page, blocks = read(html)
    odds = log_odds(page, blocks)
    return blocks, odds, minimum_cut(odds, smoothness(page, blocks))


def main_text(html: str | None) -> str:
    blocks, _, side = labelled(html or "")
    return " ".join(b.text for b, content in zip(blocks, side, strict=True) if content)


def page_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page, in one pass."""

    def extract(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select(key, url, html).mapInArrow(extract, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
