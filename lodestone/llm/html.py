"""Main text of web pages by tree scoring.

A page becomes a tree; what can never be the article (scripts, styles, forms,
menus, headers, footers, sidebars, notices, adverts, reader comments) is left out by
tag, role or name. Names that themes also give to the box around an article (`_BOXES`) leave out
nothing that holds most of the page's text. Every block with text gives points to its container and, less,
to LEVELS containers above: one, one for each comma, one for each 100 characters up
to three, less the share of its text that is links. The container with the best
score after the same discount is kept, with the siblings that score a fifth of it or
read like a part of the article.

White space inside a block becomes one space, blocks are joined by one space in page
order, and nothing else is dropped or cut. Sums and points take one pass, however deep a page is nested.

Defined results
* null and empty pages, and pages without text outside what is left out, give an empty text
* tags that are not closed end where HTML lets them end; text after a cut tag is kept as it stands
* of containers with the same score the one that opens first is kept
* repeated pages each get a row; an empty table gives an empty table
* an input column that is named like a result column is replaced
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset(
    "script style noscript template head title nav footer aside form button select textarea iframe object svg math "
    "canvas audio video dialog menu option datalist fieldset legend label".split()
)
_BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hr html li "
    "main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends, if it is open inside the nearest of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Names of what is never the article, of what a page's theme may also call the box around it, and of what may be a part of it.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|breadcrumbs?|comments?|commentlist|disqus|respond|repl(?:y|ies)|cookies?|consent|gdpr"
    r"|footer|foot|nav|navbar|navigation|menu|newsletter|sidebar|sponsor\w*|subscribe|signup|pager|pagination|copyright|disclaimer"
    r"|outbrain|taboola)(?=$|[\s_-])"
)
_BOXES = re.compile(r"(?:^|[\s_-])(?:modal|popup|promo\w*|recommend\w*|related|share|sharing|social|widget)(?=$|[\s_-])")
_MAYBE = re.compile(
    r"(?:^|[\s_-])(?:banner|notices?|alerts?|masthead|header|topbar|overlay|side|rail|skip|tags|toc|login|search|legal)(?=$|[\s_-])"
)
_KEEP = re.compile(r"(?:^|[\s_-])(?:article|main|content|entry|post|story|title)(?=$|[\s_-])|(?:article|post|entry|story|main)-?(?:body|content|text)")
#: "has-sidebar", "comments-open": what stands inside, not what it is.
_ASIDE = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|is)[-_]\S+|\S+[-_](?:open|closed|enabled|free)(?=$|\s)")
#: An element with more than this share of the page's text outside links is not left out by a name of `_BOXES`.
MOST = 2 / 3
#: Containers that get points of a block, from the nearest on.
LEVELS = 16
_OTHER_ARTICLES = frozenset("comment comments reply ad ads advert related promo sponsored".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Node:
    __slots__ = ("tag", "parent", "holder", "children", "dropped", "doubtful", "score", "place", "chars", "linked", "own")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, doubtful: bool = False, place: int = 0):
        self.tag, self.parent, self.children, self.place = tag, parent, [], place
        self.holder = self if parent is None or tag in _BLOCK else parent.holder  # the block it stands in
        self.dropped, self.doubtful = dropped, doubtful
        self.score = 0.0
        self.chars = self.linked = self.own = 0


def _unwanted(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> tuple[bool, bool]:
    """Whether an element is left out, and whether it is if it does not hold most of the text."""
    if tag in _DROP:
        return True, False
    if tag == "header" and not in_article:
        return True, False
    if tag in ("html", "body"):
        return False, False
    names = []
    for name, value in attrs:
        if name in ("class", "id"):
            names.append(_CAMEL.sub(r"\1-\2", value or "").lower())
        elif name == "role" and (value or "").lower() in _ROLES:
            return True, False
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        elif name == "style" and value and _HIDDEN.search(value.lower()):
            return True, False
    if not names:
        return False, False
    named = _ASIDE.sub(" ", " ".join(names))
    if tag in ("article", "main"):
        return not _OTHER_ARTICLES.isdisjoint(named.split()), False
    never = bool(_NAMES.search(named)) or bool(_MAYBE.search(named)) and not _KEEP.search(named)
    return never, bool(_BOXES.search(named))


class _Tree(HTMLParser):
    """Builds the tree of what may be text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.nodes = [self.root]
        self.open: Counter = Counter()  # open elements by tag

    def _close_to(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        if node.parent is not None:
            self.open[node.tag] -= 1
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body"):
            return
        if tag in _BLOCK:  # a block ends an open paragraph
            node = self.at.holder
            if node.tag == "p" or node.tag in _HEADINGS and tag in _HEADINGS:
                self._close_to(node)
        if tag in _ENDS:
            ended, bounds = _ENDS[tag]
            node, last = self.at if any(self.open[x] for x in ended) else self.root, None
            while node.parent is not None and node.tag not in bounds:
                if node.tag in ended:
                    last = node
                node = node.parent
            if last is not None:
                self._close_to(last)
        if tag == "a" and self.open["a"]:  # links are not nested
            node = self.at
            while node.parent is not None and node.tag not in _BLOCK:
                if node.tag == "a":
                    self._close_to(node)
                    break
                node = node.parent
        dropped, doubtful = _unwanted(tag, attrs, bool(self.open["article"] or self.open["main"]))
        new = Node(tag, self.at, self.at.dropped or dropped, doubtful, len(self.nodes))
        self.nodes.append(new)
        self.at.children.append(new)
        if tag not in _VOID:
            self.open[tag] += 1
            self.at = new

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.at.tag == tag:
            self._close_to(self.at)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self._close_to(node)
                return
            if tag not in _BLOCK and tag not in _DROP and node.tag in _BLOCK:
                return  # an inline end tag does not end a block
            node = node.parent

    def handle_data(self, data: str) -> None:
        if not self.at.dropped:
            self.at.children.append(data)
            if not self.open["a"]:
                self.at.own += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass


def _parse(page: str) -> list[Node]:
    """The elements in page order; the first is the root."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    for node in reversed(tree.nodes[1:]):
        node.parent.own += node.own
    most = MOST * tree.root.own
    for node in tree.nodes[1:]:
        node.dropped |= node.parent.dropped or node.doubtful and node.own <= most
    return tree.nodes


def _blocks(node: Node) -> Iterator[tuple[Node, str, int]]:
    """Block by block the node it stands in, its text, and how much of it is links."""
    # An explicit stack, because pages may be nested deeper than Python's calls.
    pieces: list[tuple[str, bool]] = []
    holder = node

    def flush():
        text = " ".join("".join(p for p, _ in pieces).split())
        if not text:
            return None
        linked = len(" ".join("".join(p if link else " " for p, link in pieces).split()))
        return holder, text, linked

    stack: list[tuple[Node, int, bool]] = [(node, 0, False)]
    while stack:
        here, i, link = stack.pop()
        if i < len(here.children):
            stack.append((here, i + 1, link))
            child = here.children[i]
            if isinstance(child, str):
                pieces.append((child, link))
            elif child.dropped:
                pieces.append((" ", False))
            elif child.tag == "br":
                pieces.append((" ", False))
            elif child.tag in _BLOCK:
                if (made := flush()) is not None:
                    yield made
                pieces.clear()
                holder = child
                stack.append((child, 0, False))
            else:
                stack.append((child, 0, link or child.tag == "a"))
        elif here.tag in _BLOCK or not stack:
            if (made := flush()) is not None:
                yield made
            pieces.clear()
            holder = here.parent and here.parent.holder


_CONTAINERS = frozenset("article body center div html main section td blockquote figure dd details".split())


def _points(text: str, linked: int) -> float:
    base = 1 + sum(text.count(c) for c in ",،、，") + min(len(text) / 100, 3)
    return base * (1 - linked / len(text))


def _score(nodes: list[Node]) -> list[Node]:
    """Hands the points of every block upward; the containers that got any, in page order."""
    got: dict[int, Node] = {}
    for holder, text, linked in _blocks(nodes[0]):
        holder.chars += len(text)
        holder.linked += linked
        if holder.tag in _HEADINGS:
            continue
        points, level = _points(text, linked), 0
        node = holder if holder.tag in _CONTAINERS and holder.tag != "blockquote" else holder.parent
        while node is not None and points and level < LEVELS:
            node = node.holder
            if node.tag in _CONTAINERS:
                node.score += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
                got[node.place] = node
                level += 1
            node = node.parent
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    return [got[i] for i in sorted(got)]


def _net(node: Node) -> float:
    return node.score * (1 - node.linked / node.chars) if node.chars else 0.0


def _is_part(node: Node, best: Node) -> bool:
    """Whether a sibling of the best container belongs to the article."""
    if node.dropped or not node.chars:
        return False
    density = node.linked / node.chars
    if node.tag in _HEADINGS or node.tag in ("article", "main"):
        return density < 0.5
    if _net(node) >= 0.2 * _net(best):
        return True
    if any(isinstance(x, Node) and x.tag in ("h1", "h2") for x in node.children) and density == 0:
        return True
    return node.tag in ("p", "blockquote", "pre", "ul", "ol", "table", "figure", "dl") and density < 0.25 and (node.chars > 80 or density == 0)


def main_text(page: str | None) -> str:
    """The article of a page as one line of text."""
    if not page:
        return ""
    nodes = _parse(page)
    found = _score(nodes)
    if not found:
        return " ".join(text for _, text, linked in _blocks(nodes[0]) if linked < len(text))
    best = max(found, key=lambda n: (_net(n), -n.place))
    # What is cut into sections or boxes by the page belongs to the article element around it.
    above = best.parent
    while above is not None:
        if above.tag in ("article", "main"):
            best = above
        above = above.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        kept = [n for n in best.parent.children if isinstance(n, Node) and (n is best or _is_part(n, best))]
    elif best.tag == "article" and best.parent is not None:
        kept = [n for n in best.parent.children if isinstance(n, Node) and (n is best or n.tag == "article" and _net(n) >= 0.2 * _net(best))]
    return " ".join(text for n in kept for _, text, _ in _blocks(n))


def _extract(batches: Iterator[pa.RecordBatch], html: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([main_text(x.as_py()) for x in batch.column(html)], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, "text"])


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of `pages` but the page itself, with `text` and its length `n_chars`."""
    fields = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("text", T.StringType())])
    made = pages.select(*names, html).mapInArrow(partial(_extract, html=html, names=names), schema)
    return made.withColumn("n_chars", F.length("text").cast("long"))
