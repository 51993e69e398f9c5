"""Main text of HTML pages by composite text density.

A page is parsed into a tree; what is never text (scripts, styles, forms) or says itself that it is
a menu, header, footer, sidebar, notice, advert or reader comment is left out; where only its class or id
says so, not if it is a wrapper around most of the page's text (``settle``). Every node has its
link-adjusted density: characters per tag, damped by the share of characters and tags that are in
links. A node's density sum is that of its children. The lowest density on the way from the node
with the greatest sum up to the body is the threshold; the node with
the greatest sum is the article. If it lies in an ``article`` or ``main`` element, that whole element
is. Elsewhere, from the body down, the blocks that reach the threshold belong to it too, and so do those
that are as dense for their size (half the characters per tag, links in a third at most): densities grow
with the size of a block, so a short section may not reach what a long one does. Beside an article that begins with
a heading, sections of the same container that do so too belong to it however short they are. The parts
are joined in page order.

Blocks of the article are joined by one space, white space inside a block is one space, character
references are decoded. Pages are parsed one by one inside their rows: no shuffle; memory and time
are in proportion to a page.

A null or empty page, and one without text, has an empty text. Broken markup is read as far as it
goes: unclosed elements end with their parent, stray end tags are passed over. Repeated rows are
each extracted; other columns are carried, except one that has the name of the result.
"""

from __future__ import annotations

import html
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.batches import small

# Element names by their part in the parse.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset(
    "script style noscript template iframe object svg math canvas audio video select textarea button form title head "
    "nav footer aside menu dialog datalist map applet noframes".split()
)
RAW = frozenset("script style noscript template iframe svg textarea title noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("html body table td th ul ol dl div article section main button".split())
# Words of class, id and role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos "
    "promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars "
    "aside complementary footer masthead contentinfo search searchbox toolbar cookie cookies consent gdpr notice notices "
    "alert alerts alertdialog popup modal overlay newsletter subscribe subscription paywall signup login share sharing "
    "social related recommended recommendations widget widgets comment comments commentlist reply replies respond disqus "
    "discussion feedback skip toc".split()
)
KEPT_WORDS = frozenset("article content main post entry story body text".split())

READER_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion feedback".split())
# How sure it is that an element is an aside: by its class or id, by those of readers' words, in any case.
BY_CLASS, BY_READERS, SURE = 1, 2, 3

TAG = regex.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)",
    regex.S,
)
ATTRIBUTE = regex.compile(r"([^\s=\"'>/]+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
VALUE = regex.compile(r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)")
HIDDEN = regex.compile(r"(?<![^\s/\"'])hidden(?![^\s/])", regex.I)
WORDS = regex.compile(r"[a-z]+")


class Node:
    """An element: children in order are strings and nodes."""

    __slots__ = ("name", "parent", "children", "aside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, aside: bool = False):
        self.name, self.parent, self.aside = name, parent, aside
        self.children: list = []


def is_aside(name: str, attributes: str, parent: Node) -> int:
    """Whether an element says of itself that it is not part of an article: SURE, or by its class or id."""
    if name in NO_TEXT:
        return SURE
    if name == "header":  # an article's own header has its title
        node = parent
        while node is not None:
            if node.name in ("article", "main"):
                break
            node = node.parent
        else:
            return SURE
    if not attributes:
        return 0
    told = 0
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "").lower()
        if key in ("class", "id", "role"):
            if name in ("body", "html", "article", "main"):
                continue
            found = WORDS.findall(value)
            if not ASIDE_WORDS.isdisjoint(found) and (key == "role" or KEPT_WORDS.isdisjoint(found) or "comment" in value):
                if key == "role":
                    return SURE
                told = max(told, BY_CLASS if READER_WORDS.isdisjoint(found) else BY_READERS)
        elif key == "aria-hidden" and value == "true":
            return SURE
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return SURE
    if "hidden" in attributes.lower() and HIDDEN.search(VALUE.sub("", attributes)):
        return SURE
    return told


def parse(page: str) -> Node:
    """The tree under a ``body``; what is in the head is left out."""
    root = Node("body", None)
    node, at = root, 0
    doubts: list[tuple[Node, int]] = []
    while True:
        match = TAG.search(page, at)
        text = page[at : match.start() if match else len(page)]
        if text and not node.aside:
            node.children.append(html.unescape(text) if "&" in text else text)
        if match is None:
            settle(root, doubts)
            return root
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if match["end"]:
            if name in ("body", "html"):
                continue
            up = node
            while up is not None and up.name != name:
                # an end tag of inline markup does not close a block
                up = None if name not in BLOCKS and up.name in BLOCKS else up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if name in ("html", "body"):
            continue
        closing = match["attributes"].endswith("/")
        if name in RAW and not closing:
            end = regex.compile(rf"</{regex.escape(name)}(?=[\s/>])", regex.I).search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if name in CLOSES_P:
            up = node
            while up is not None and up.name not in SCOPES and up.name != "p":
                up = up.parent
            if up is not None and up.name == "p":
                node = up.parent
        for other in (CLOSES.get(name, ()),):
            up = node
            while other and up is not None and up.name not in ("ul", "ol", "dl", "table", "select", "body"):
                if up.name in other:
                    node = up.parent
                    if name not in ("tr", "tbody"):
                        break
                up = up.parent
        told = SURE if node.aside else is_aside(name, match["attributes"], node)
        child = Node(name, node, told == SURE)
        if told != SURE:
            node.children.append(child)
            if told:
                doubts.append((child, told))
        if name not in VOID and not (closing and name not in BLOCKS):
            node = child


def settle(root: Node, doubts: list[tuple[Node, int]]) -> None:
    """Drop what a class or id names an aside, but for a wrapper around most of the page's text.

    A wrapper has blocks in it, more than half of the text outside links, and every ``article`` and
    ``main`` that has text; one named for readers' words has one of these or a title in it.
    """
    if not doubts:
        return
    nodes = weigh(root)
    plain = {id(n): n.chars - n.link_chars for n in nodes}
    bodies: dict[int, int] = {}
    titles: dict[int, int] = {}
    for node in reversed(nodes):
        inner = [id(c) for c in node.children if isinstance(c, Node)]
        bodies[id(node)] = (node.name in ("article", "main") and node.chars > 0) + sum(map(bodies.__getitem__, inner))
        titles[id(node)] = (node.name == "h1" and node.chars > 0) + sum(map(titles.__getitem__, inner))
    gone, parents = set(), {}
    for node, told in doubts:
        own = id(node)
        most = 2 * plain[own] > plain[id(root)] and bodies[own] == bodies[id(root)]
        blocks = any(isinstance(c, Node) and c.name in BLOCKS for c in node.children)
        if not (most and blocks and (told == BY_CLASS or bodies[own] or titles[own])):
            gone.add(own)
            parents[id(node.parent)] = node.parent
    for parent in parents.values():
        parent.children = [c for c in parent.children if id(c) not in gone]


def in_order(root: Node) -> list[Node]:
    """All nodes, parents before children, without recursion."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return nodes


def weigh(root: Node) -> list[Node]:
    """Densities and density sums of all nodes."""
    nodes = in_order(root)
    for node in reversed(nodes):
        chars = tags = link_chars = link_tags = 0
        for child in node.children:
            if isinstance(child, str):
                chars += len(" ".join(child.split()))
            else:
                chars += child.chars
                tags += child.tags + 1
                link_chars += child.chars if child.name == "a" else child.link_chars
                link_tags += 1 if child.name == "a" else child.link_tags
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        chars, tags = node.chars, max(node.tags, 1)
        links, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
        if chars:
            plain = max(chars - node.link_chars, 1)
            base = math.log(chars / plain * node.link_chars + share * chars + math.e)
            inner = max(chars / links * tags / link_tags, 1.0)
            node.density = chars / tags * (math.log(inner) / math.log(max(base, 1.0 + 1e-9)) if inner > 1 else 0.0)
        else:
            node.density = 0.0
        node.total = sum(c.density for c in node.children if isinstance(c, Node))
    return nodes


def article(root: Node) -> list[Node]:
    """The subtree with the greatest density sum and the blocks like it, in page order."""
    nodes = weigh(root)
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        return [root]
    threshold, node = best.density, best
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    chosen = up = best
    while up is not None:
        if up.name in ("article", "main"):
            chosen = up
        up = up.parent
    if chosen.name in ("article", "main"):
        return [chosen]
    # inline markup and single blocks belong to the block around them
    while chosen.parent is not None and (chosen.name not in BLOCKS or chosen.name in ("p", "li", "h1", "h2", "h3")):
        chosen = chosen.parent
    return sections(root, chosen, threshold)


def is_section(node: Node, like: Node) -> bool:
    """An element of the same name that begins with a heading."""
    first = next((c for c in node.children if isinstance(c, Node) or c.strip()), None)
    return node.name == like.name and isinstance(first, Node) and first.name in HEADINGS


def sections(root: Node, chosen: Node, threshold: float) -> list[Node]:
    """The chosen subtree, the blocks outside it that are like it, and headings right before them."""
    around, up = set(), chosen.parent
    while up is not None:
        around.add(id(up))
        up = up.parent
    each = chosen.chars / (chosen.tags + 1)
    headed = is_section(chosen, chosen)
    found: list[Node] = []
    heading, todo = None, [root]
    while todo:
        node = todo.pop()
        if node is not chosen:
            if node.name == "a" or not node.chars:
                continue
            if id(node) not in around and node.name in HEADINGS and node.density < threshold:
                heading = node
                continue
            alike = 3 * node.link_chars <= node.chars and (
                2 * node.chars >= each * (node.tags + 1) or headed and node.parent is chosen.parent and is_section(node, chosen)
            )
            if id(node) in around or node.name not in BLOCKS or not (node.density >= threshold or alike):
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
                if id(node) not in around:
                    heading = None
                continue
        if heading is not None and heading.parent is node.parent:
            found.append(heading)
        heading = None
        found.append(node)
    return found


def blocks_of(nodes: list[Node]) -> str:
    """The text of subtrees: blocks in order, joined by one space."""
    parts: list[str] = []
    todo: list = nodes[::-1]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if item.name == "br":
            parts.append(" ")
            continue
        block = item.name in BLOCKS
        if block:
            parts.append(" ")
            todo.append(" ")
        todo += reversed(item.children)
    return " ".join("".join(parts).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return blocks_of(article(parse(page)))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Every row with its columns but the page itself, and the main text of the page."""
    kept = [c for c in pages.columns if c.lower() not in (html_col.lower(), out_col.lower())]
    given = pages.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [main_text(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    found = given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("text", T.StringType())]))
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("text").alias(out_col))
