"""Main text of web pages by composite text density.

The page is read into a tree once.  Elements that are never main text (menus, page headers, footers, asides, forms, scripts)
and those whose whole name says so (adverts, notices, comments) are left out; of the others each gets a density: characters for each tag, lowered where
much of the text is in links.  The subtree whose children's densities sum highest is the core; the smallest density on
the path from the core's parent up to the body is the threshold.  Of every element that reaches it the subtree of the
highest sum is main text, the core first; an article or main element around the core is kept whole.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.groups import arrow

#: Comments, declarations, end tags and the names of start tags; markup without an end runs to the end of the page.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?+|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: Attributes as the HTML standard reads them: quotes open a value only after an equals sign.
ATTRIBUTES = re.compile(r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|))?+)*+(?:>|\Z)")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z0-9]+")
CASES = re.compile(r"([a-z0-9])([A-Z])")
# Element names of the HTML standard, by the part they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head script style noscript template title textarea iframe svg canvas object nav header footer aside form menu button select dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select div article section main body html aside nav td th".split())
#: Words of class, id and role names that mark what is no main text, and those that say nothing beside them.
JUNK = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies disqus respond discussion related recommended pagination pager toolbar search complementary contentinfo alert skip".split())
NEUTRAL = frozenset("site page global top bottom left right main inner outer list section box area wrapper wrap container block item items form link links button buttons bar thread panel group reader user primary secondary bottom slot unit 1 2 3 4 5".split())
#: Marks that an article's own parts carry too.
OWN = frozenset("header masthead discussion search".split())


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "junk")

    def __init__(self, tag, parent, junk=False):
        self.tag, self.parent, self.junk, self.items = tag, parent, junk, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def junk_element(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is no main text by its kind or name.  A name counts as a whole: all its words have to be marks or
    to say nothing, so that ``comment-list`` goes and ``related-work`` stays.  Inside an article or main element its own
    header and such stay."""
    if tag in DROPPED:
        return not (inside and tag == "header")
    if not attrs or tag in ("body", "html", "main", "article"):
        return False
    if HIDDEN.search(attrs):
        return True
    for m in NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = set(WORD.findall(CASES.sub(r"\1 \2", name).lower()))
            if words & JUNK and words <= JUNK | NEUTRAL and not (inside and words & JUNK <= OWN):
                return True
    return False


class Open:
    """The open elements, with the depths at which those of a kind stand, so that no search walks up the tree."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}
        self.solid, self.scopes, self.cells, self.main = [0], [0], [], 0

    def push(self, node: Node) -> None:
        depth, tag = len(self.nodes), node.tag
        self.nodes.append(node)
        self.at.setdefault(tag, []).append(depth)
        if tag not in INLINE:
            self.solid.append(depth)
        if tag in SCOPES:
            self.scopes.append(depth)
        if tag in ("table", "td", "th"):
            self.cells.append(depth)
        self.main += tag in MAIN

    def close(self, depth: int) -> None:
        """Close the element at a depth and all in it."""
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            self.main -= tag in MAIN
        for kept in (self.solid, self.scopes, self.cells):
            while kept and kept[-1] >= depth:
                kept.pop()

    def last(self, tag: str) -> int:
        """The depth of the innermost open element of a kind, or -1."""
        return self.at[tag][-1] if self.at.get(tag) else -1


def parse(page: str) -> Node:
    """The tree of a page, in time linear in its length; end tags that are missing, stray or crossed are made up for."""
    root = Node("body", None)
    open_ = Open(root)
    at, n = 0, len(page)
    while at < n:
        now = open_.nodes[-1]
        m = TOKEN.search(page, at)
        if m is None:
            now.items.append(page[at:])
            break
        if m.start() > at:
            now.items.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, start = m[2].lower(), at
        at = ATTRIBUTES.match(page, at).end()
        if m[1]:
            depth = open_.last(tag)
            if depth > 0 and not (tag in INLINE and open_.cells and open_.cells[-1] > depth):
                open_.close(depth)
            elif tag == "p":
                now.items.append("\n")
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and open_.nodes[open_.solid[-1]].tag == "p":
            open_.close(open_.solid[-1])
        if tag in SIBLINGS:
            depth = max(map(open_.last, SIBLINGS[tag]))
            if depth > 0 and depth >= open_.scopes[-1]:
                open_.close(depth)
        now, attrs = open_.nodes[-1], page[start : at - 1]
        node = Node(tag, now, junk_element(tag, attrs, open_.main > 0))
        now.items.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if close is None:
                at = n
            else:
                end = page.find(">", close.start())
                at = n if end < 0 else end + 1
            continue
        if tag not in VOID and not attrs.endswith("/") or tag not in VOID and tag in CLOSES_P:
            open_.push(node)
    return root


def walk(root: Node) -> list[Node]:
    """Nodes that count, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node) and not x.junk]
    return out


def measure(nodes: list[Node]) -> None:
    """Characters, tags and link shares of each subtree, then its density and the sum of its children's."""
    for node in reversed(nodes):
        node.chars += sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    top = nodes[0]
    share = top.link_chars / top.chars if top.chars else 0.0
    for node in nodes:
        if node.chars:
            tags, links, link_tags = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            ratio = max(1.0, node.chars / links * tags / link_tags)
            node.density = node.chars / tags * math.log(ratio) / base
    for node in nodes[1:]:
        node.parent.total += node.density


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that are main text, outermost ones only, in page order."""
    nodes = walk(root)
    measure(nodes)
    core = max(nodes, key=lambda x: x.total) if any(x.total for x in nodes) else root
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    if len(path) == 1:
        return [root]
    for node in reversed(path[:-1]):  # from below the body down to the core
        if node.tag in MAIN:
            return [node]
    least = min(x.density for x in path[1:])
    top = {x: x for x in nodes}
    for node in reversed(nodes[1:]):  # children before parents
        if node.tag not in INLINE and top[node].total >= top[node.parent].total and top[node].total > 0:
            top[node.parent] = top[node]
    chosen = {top[x] for x in nodes if x.tag not in INLINE and x.density > 0 and x.density >= least} | {core}
    held: set[Node] = set()
    for node in nodes:  # parents before children
        if node.parent in held or node.parent in chosen:
            held.add(node)
    return [x for x in nodes if x in chosen and x not in held]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order: references decoded, runs of white space one space."""
    out: list[str] = []
    parts: list[str] = []

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(text)
            parts.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.junk:
            if x.tag == "br":
                parts.append(" ")
            elif x.tag in INLINE:
                todo += reversed(x.items)
            else:
                flush()
                todo.append(None)
                todo += reversed(x.items)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(x for node in main_nodes(parse(page)) for x in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row for each row of ``pages``; the whole page is read.

    Null, empty and text-free pages give an empty text.  Broken markup is read as browsers do: missing end tags are
    made up, comments and scripts without an end run to the end of the page.  Ids and urls may be null or repeat: rows
    don't meet.  Other columns are not read; an empty table gives no rows."""

    def fn(batch):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield [batch.column("page_id"), batch.column("url"), texts, [len(x) for x in texts]]

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow(rows, fn, "page_id bigint, url string, text string, n_chars bigint")
