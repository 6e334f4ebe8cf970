"""Main text of web pages by minimum-cut labelling of their text blocks.

The nodes of a flow network are a page's text blocks (runs of text between block-level tags) and the elements whose tag or names
promise content (article, main, post-body and the like). A linear classifier over tag, class, link and length features gives each block
log-odds of being content, by itself and by the noise around it; an element's odds are those of its tag and names. The costs
of either label become terminal capacities. Smoothness edges join blocks that are adjacent on the page, blocks that are neighbours under
the same element, and a block with the nearest promising element around it, weaker the longer the DOM path between them. The
minimum cut is the cheapest labelling, and the blocks on the source side are the content: short paragraphs, list items and headings
say little by themselves and go with what surrounds them.

Nodes whose own cost outweighs all their edges are labelled first (they keep that label in every minimum cut); the others are left to the
flow search. Tokens, elements and blocks are handled in time linear in the page, also where markup is broken, unclosed or nested deeply.

The classifier's weights are set by hand: there are no labelled pages to learn them from.

A null or empty html, or a page without content, gives an empty text. Text is never cut short. Rows are
treated alone, so repeated rows, null ids and other columns (of any name) make no difference; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.llm.common import bounded_batches

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot "
    "th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style title noscript template svg math iframe object canvas audio video select textarea head".split())
RAW_TAGS = frozenset("script style title noscript template svg iframe textarea".split())
CLOSES_ITSELF = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}
TAG_ODDS = {
    "article": 4.0, "main": 3.0, "nav": -6.0, "footer": -5.0, "aside": -5.0, "form": -5.0, "header": -4.0, "button": -5.0,
    "label": -4.0, "dialog": -5.0, "menu": -5.0, "fieldset": -4.0,
}
BLOCK_ODDS = {"p": 0.7, "h1": 1.2, "h2": 0.7, "h3": 0.7, "h4": 0.5, "h5": 0.5, "h6": 0.5, "blockquote": 0.7, "pre": 0.7, "li": -0.3}
PLAIN_NAMES = frozenset("article content entry story post body main text prose richtext articlebody postcontent entrycontent".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs byline captcha comment comments "
    "commentlist consent cookie cookies copyright dialog discussion disqus dropdown footer form gdpr hidden legal login masthead menu menubar "
    "modal nav navbar navigation navi newsletter notice notification overlay pager pagination popup privacy promo promotion promoted "
    "recommended recommendations related remark remarks replies reply respond search share sharing side sidebar signin signup skip social "
    "sponsor sponsored subscribe subscription tags teaser toolbar topbar trending warning widget widgets".split()
)
#: What any block has against it, and the capacities of edges before they weaken with the DOM path.
BIAS, ADJACENT, SIBLING, AROUND, ACROSS = -1.4, 1.2, 0.8, 1.6, 0.1
BARRIERS = frozenset("table article main body".split())

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"=\s*[\"']|>")
NAMED = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: Names that tell of another element or of its absence.
OTHER_PARTS = re.compile(r"(?<![^\s])(?:has|no|with|without)[-_]\S*", re.I)
#: Elements whose id is made from their text.
NAMED_BY_TEXT = frozenset("article h1 h2 h3 h4 h5 h6".split())
RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW_TAGS}


class Element:
    __slots__ = ("tag", "parent", "depth", "odds", "section", "promise", "link", "block", "change", "hidden")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        self.block = self if tag in BLOCK_TAGS or not parent else parent.block
        self.change, self.hidden = TAG_ODDS.get(tag, 0.0), False
        if attributes.strip() and tag not in ("html", "body"):
            named, self.hidden = name_odds(attributes, tag in NAMED_BY_TEXT)
            self.change += named
        self.settle()

    def settle(self) -> None:
        """Odds and section, from the parent's."""
        parent, change = self.parent, self.change
        self.odds, self.section, self.promise = (parent.odds, parent.section, parent.promise) if parent else (0.0, self, None)
        if self.tag == "header" and self.odds >= 3:  # of the article, not of the page
            change -= TAG_ODDS["header"] if change < 0 else 0.0
        if change < 0:
            self.odds, self.section, self.promise = min(self.odds, 0.0) + change, self, None
        elif change > 0:
            self.odds, self.section = self.odds + (change if self.odds > -2 else 0.0), self
            self.promise = self if self.odds > 0 else None


def name_odds(attributes: str, skip_id: bool) -> tuple[float, bool]:
    """Odds by class, id and role, and whether the element is hidden. A compound such as has-sidebar says what else the page has."""
    noise = plain = hidden = False
    for name, *values in NAMED.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value == "true"
        elif not (skip_id and name == "id"):
            parts = {p.lower() for p in NAME_PARTS.findall(OTHER_PARTS.sub(" ", value))}
            noise |= not parts.isdisjoint(NOISE_NAMES) or bool(parts & {"contentinfo", "complementary", "alert"})
            plain |= not parts.isdisjoint(PLAIN_NAMES)
    return -6.0 if noise or hidden else 2.5 if plain else 0.0, hidden


def clear_wrappers(blocks: list[tuple[str, Element, float]]) -> None:
    """An element that holds most of the page's unlinked text and its main part is a wrapper: its tag and names are no noise.

    The main part is known by a main or h1 or a single article; a form that holds nearly everything needs none.
    """
    held: dict[Element, float] = {}
    parts: dict[Element, list[int]] = {}  # numbers of mains and h1s, and of articles, in each element
    for text, owner, link_share in blocks:
        node = owner
        while node is not None and node not in held:
            held[node], parts[node] = 0.0, [0, 0]
            node = node.parent
        held[owner] += len(text) * (1 - link_share)
    order = sorted(held, key=lambda e: -e.depth)
    total, cleared = sum(held.values()), False
    for e in order:
        main, size = parts[e], held[e]
        if e.change < 0 and not e.hidden and ((main[0] or main[1] == 1) and size > 0.6 * total or e.tag == "form" and size > 0.9 * total):
            e.change, cleared = 0.0, True
        if e.parent is not None:
            held[e.parent] += size
            above = parts[e.parent]
            above[0] += main[0] + (e.tag in ("main", "h1") and e.change >= 0)
            above[1] += main[1] + (e.tag == "article" and e.change >= 0)
    if cleared:
        for e in reversed(order):
            e.settle()


class Tags:
    """The markup of a page in order: text before it, slash, name, attributes; name is empty for comments and at the end."""

    def __init__(self, page: str):
        self.page, self.at, self.quotes = page, 0, True

    def end_of(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` is closed; -1 if nowhere. Once a quoted value has no end, quotes mean nothing on this page."""
        start = at
        while self.quotes:
            found = QUOTE_OR_END.search(self.page, at)
            if not found:
                self.quotes = False
                break
            if found[0] == ">":
                return found.start()
            at = self.page.find(found[0][-1], found.end()) + 1
            self.quotes = at > 0
        return self.page.find(">", start)

    def skip_raw(self, tag: str) -> None:
        end = RAW_END[tag].search(self.page, self.at)
        close = self.page.find(">", end.end()) if end else -1
        self.at = close + 1 if close >= 0 else len(self.page)

    def __iter__(self) -> Iterator[tuple[str, str, str, str]]:
        page = self.page
        text_from = at = 0
        while True:
            at = page.find("<", at)
            name = TAG.match(page, at + 1) if at >= 0 else None
            if at < 0:
                yield page[text_from:], "", "", ""
                return
            if name:
                close = self.end_of(name.end())
                attributes = page[name.end() : close]
            elif page.startswith("<!--", at):
                close = page.find("-->", at + 4)
                close += 2 * (close >= 0)
            elif page[at + 1 : at + 2] in ("!", "?"):
                close = page.find(">", at)
            else:
                at += 1
                continue
            self.at = close + 1 if close >= 0 else len(page)
            if name and close >= 0:
                yield page[text_from:at], name[1], name[2].lower(), attributes
            else:
                yield page[text_from:at], "", "", ""
            text_from = at = self.at


def text_blocks(page: str) -> list[tuple[str, Element, float]]:
    """Text, nearest block element and share of link characters of each block, in page order."""
    root = Element("", None, "")
    stack, places, barriers = [root], {}, []  # open elements; depths of each tag that is open; depths of barriers
    owner, held, linked, silent = root, [], 0, 0  # silent: elements below which text is dropped
    blocks = []

    def close():
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append((text, owner, min(1.0, linked / len(text))))
            held, linked = [], 0

    def add(raw):
        nonlocal owner, linked
        text = entities.unescape(raw) if "&" in raw else raw
        if not held:
            if text.isspace():
                return
            owner = stack[-1].block
        held.append(text)
        if stack[-1].link:
            linked += len(text)

    def push(tag, attributes):
        nonlocal silent
        places.setdefault(tag, []).append(len(stack))
        if tag in BARRIERS:
            barriers.append(len(stack))
        silent += tag in SILENT_TAGS
        stack.append(Element(tag, stack[-1], attributes))

    def pop_to(depth):
        """Close the elements at ``depth`` and above."""
        nonlocal silent
        while len(stack) > depth:
            tag = stack[-1].tag
            if tag in BLOCK_TAGS:
                close()
            silent -= tag in SILENT_TAGS
            places[tag].pop()
            if tag in BARRIERS:
                barriers.pop()
            stack.pop()

    tags = Tags(page)
    for text, slash, tag, attributes in tags:
        if text and not silent:
            add(text)
        if not tag:
            continue
        if slash:
            depth, barrier = (places.get(tag) or [0])[-1], (barriers or [0])[-1]
            if depth and (tag in BLOCK_TAGS and tag != "p" or barrier <= depth):
                pop_to(depth)
            elif tag == "p" and not silent:
                close()
            continue
        if tag == "br":
            if held:
                held.append(" ")
            continue
        if tag in RAW_TAGS:
            tags.skip_raw(tag)
            continue
        if tag in BLOCK_TAGS:
            close()
            near = stack[-1].block
            if near.tag == "p" or tag in CLOSES_ITSELF and near.tag in (tag, CLOSES_ITSELF[tag]):
                pop_to(near.depth)
        elif tag == "body" and silent:  # an unclosed head ends here
            pop_to(1)
        if tag not in VOID_TAGS and (tag in BLOCK_TAGS or not attributes.rstrip().endswith("/")):
            push(tag, attributes)
    close()
    return blocks


def content_odds(text: str, element: Element, link_share: float) -> float:
    """Log-odds of a block by itself and by the noise around it; what promises content around it has a node of its own."""
    words = text.count(" ") + 1
    odds = min(element.odds, 0.0) + BLOCK_ODDS.get(element.tag, 0.0) + BIAS
    odds += 1.2 if words >= 40 else 0.8 if words >= 12 else 0.0
    if text[-1] in ".!?…”\"'":
        odds += 0.5
    if link_share > 0.3 and words < 40:
        odds -= 3.0 * link_share
    if words < 30 and element.odds < 3 and (text[0] in "©" or "copyright" in text.lower() or "all rights reserved" in text.lower()):
        odds -= 3.0
    return odds


def path_length(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def network(blocks: list[tuple[str, Element, float]]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Odds of the nodes (blocks in page order, then promising elements) and the capacities between them."""
    odds, edges = [content_odds(*b) for b in blocks], {}
    latest: dict[int, int] = {}
    promising: dict[int, int] = {}
    inside: dict[int, int] = {}
    for i, (_, b, _) in enumerate(blocks):
        pairs = [(i - 1, ADJACENT)] if i else []
        parent = id(b.parent)
        if parent in latest:
            pairs.append((latest[parent], SIBLING))
        latest[parent] = i
        for j, strength in pairs:
            a = blocks[j][1]
            capacity = strength * math.exp(-path_length(a, b) / 3)
            if a.section is not b.section:
                capacity *= ACROSS
            edges[j, i] = edges.get((j, i), 0.0) + capacity
        if b.promise is not None:
            node = promising.get(id(b.promise))
            if node is None:
                node = promising[id(b.promise)] = len(odds)
                odds.append(b.promise.odds)
            edges[i, node] = AROUND * max(math.exp(-(b.depth - b.promise.depth) / 6), 0.25)
            inside[node] = inside.get(node, 0) + 1
    for node, n in inside.items():
        odds[node] *= max(1.0, n / 4)  # what it says holds for each of its blocks, if weakly
    return odds, edges


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the source (content) side of a minimum cut.

    A node pays log(1+e^odds) as boilerplate and log(1+e^-odds) as content: the difference is ``odds``, so
    one terminal capacity of that size suffices. Labels that no edges can outweigh are fixed and folded in.
    """
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    gain, label = list(odds), [None] * n
    reach = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(gain[i]) < reach[i]:
            continue
        label[i] = gain[i] > 0
        for j, c in near[i].items():
            if label[j] is None:
                gain[j] += c if label[i] else -c
                reach[j] -= c
                queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, max_flow_sides(rest, gain, near)):
            label[i] = side
    return label


def max_flow_sides(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Source side of a maximum flow among the nodes in ``rest``: blocking flows over shortest paths, until none is left."""
    place, tiny = {node: k for k, node in enumerate(rest)}, 1e-9
    source, sink = len(rest), len(rest) + 1
    ends, room, out = [], [], [[] for _ in range(len(rest) + 2)]

    def join(a, b, there, back):
        out[a].append(len(ends))
        out[b].append(len(ends) + 1)
        ends.extend((b, a))
        room.extend((there, back))

    for i in rest:
        for j, c in near[i].items():
            if i < j and j in place:
                join(place[i], place[j], c, c)
        if gain[i] > 0:
            join(source, place[i], gain[i], 0.0)
        else:
            join(place[i], sink, -gain[i], 0.0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for e in out[i]:
                if room[e] > tiny and ends[e] not in level:
                    level[ends[e]] = level[i] + 1
                    queue.append(ends[e])
        if sink not in level:
            return [k in level for k in range(len(rest))]
        turn, path, i = [0] * len(out), [], source
        while True:
            if i == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= tiny)
                i = ends[path[first] ^ 1]
                del path[first:]
                continue
            while turn[i] < len(out[i]) and not (room[out[i][turn[i]]] > tiny and level.get(ends[out[i][turn[i]]], -1) == level[i] + 1):
                turn[i] += 1
            if turn[i] < len(out[i]):
                path.append(out[i][turn[i]])
                i = ends[path[-1]]
            elif path:
                i = ends[path.pop() ^ 1]
                turn[i] += 1
            else:
                break


def main_text(page: str | None) -> str:
    blocks = text_blocks(page) if page else []
    if not blocks:
        return ""
    clear_wrappers(blocks)
    labels = minimum_cut(*network(blocks))
    return "\n".join(b[0] for b, content in zip(blocks, labels) if content)


@F.pandas_udf(StringType())
def extract_main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(lambda p: main_text(p) if isinstance(p, str) else "")


def extract(pages: DataFrame, html: str | Column = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(pages.sparkSession)
    html = F.col(html) if isinstance(html, str) else html
    return pages.select("page_id", "url", extract_main_text(html).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
