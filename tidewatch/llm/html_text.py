"""Main text of HTML pages by composite text density.

A page becomes a tree of all its elements but those without text of their own
(scripts, styles, hidden parts). Every node gets a density: its characters per
tag, adjusted by how many of them are links and how that compares with the
whole body. The node whose children have the largest sum of densities holds the
main text. From there the choice climbs while the parent's other parts are as
dense as the thinnest node on the way to the body, so that headings and stray
paragraphs beside it come along.

What an element says of itself comes second. Menus, footers and the like, and
parts named as adverts, comments or notices, are asides: they cannot be chosen,
and go from the chosen subtree. But a part that holds an article, or most of the
text around it while no article stands elsewhere, is no aside whatever its name,
so a wrapper with an odd class or an advert that was never closed loses nothing.

Texts are taken whole, block by block: character references are decoded, white
space inside a block becomes one space, and blocks are joined by one space.

Defined cases: null and empty pages and pages without text give an empty text;
unclosed and misnested tags are closed as browsers do in the plain cases;
repeated rows are extracted each; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, map_texts

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>\x00]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
"""Elements whose content ends only at their own end tag and is not part of an article."""
CONTROLS = {"button", "select", "option", "input", "label", "fieldset", "object", "embed", "canvas", "audio", "video", "map", "datalist", "head"}
"""Elements that are dropped with all they hold."""
ASIDES = {"nav", "footer", "aside", "dialog", "menu"}
"""Elements that are asides unless they hold an article; forms and headers of the page are so unless they hold most of the text."""
DEPTH = 512
"""Elements nested deeper are taken as beside each other, as browsers do."""
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "acronym", "nobr", "picture", "label"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
            "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
        "option": ({"option"}, {"select"})}
"""An element closes open ones of the first kind, looking no further out than the second."""
SCOPE = {"table", "td", "th", "button", "article", "section", "div", "main", "body", "html"}
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion comment comments commentlist disqus replies reply "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended toolbar pagination pager widget login signup search".split())
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HOLDERS = {"html", "body", "article", "main"}


class Node:
    __slots__ = ("tag", "parent", "parts", "aside", "holds", "chars", "tags", "links", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", aside: int = 0) -> None:
        self.tag, self.parent, self.parts = tag, parent, []
        self.aside = aside  # 0: no; 1: if it does not hold most of the text; 2: by its kind
        self.holds = 0  # characters inside articles below or at the node
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.total = 0.0

    def nodes(self) -> list["Node"]:
        return [p for p in self.parts if isinstance(p, Node)]


def says(tag: str, attributes: str) -> tuple[int, bool]:
    """How far an element is an aside by what it says of itself, and whether it is hidden."""
    found = 2 if tag in ASIDES else 1 if tag in ("form", "header") else 0
    if attributes and tag not in HOLDERS:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return found, True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return found, True
            if (name == "role" and value.strip() in ASIDE_ROLES) or (
                    name in ("class", "id") and not ASIDE_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value))):
                found = max(found, 1)
    return found, False


def read_tree(page: str) -> Node:
    """The tree below the page's root, without what has no text of its own."""
    root = node = Node("html", None)
    at, skipping, depth = 0, "", 0  # inside a dropped part, only its own end matters
    open_, level = Counter(), 0  # open elements by name, and how many there are

    def leave(top: Node) -> Node:
        """Close all open elements up to ``top``; its parent goes on."""
        nonlocal level
        up = node
        while up is not top:
            open_[up.tag] -= 1
            level -= 1
            up = up.parent
        open_[top.tag] -= 1
        level -= 1
        return top.parent

    pos = 0
    while m := MARKUP.search(page, pos):
        if not skipping and m.start() > at:
            node.parts.append(page[at:m.start()])
        at = pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        end, attributes = bool(m[1]), m[3] or ""
        closed = attributes.rstrip().endswith("/")
        if not end and tag in RAW and not closed:
            close = re.compile(rf"</{re.escape(tag)}\b[^<>]*>?", re.I).search(page, pos)
            at = pos = close.end() if close else len(page)
            continue
        if skipping and not end and (skipping == "p" and tag in CLOSES_P or skipping in ENDS and tag == skipping and depth == 1):
            skipping = ""  # its end tag was left out
        if skipping:
            if tag == skipping and tag not in VOID:
                depth += -1 if end else 1
                if not depth:
                    skipping = ""
            elif (end and tag in ("body", "html")) or (not end and skipping == "head" and tag == "body"):
                skipping = ""
            if skipping or end:
                continue
        if end:
            if open_[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up)
            elif tag == "p":
                node.parts.append(Node("p", node))
            continue
        if tag in ("html", "body"):
            if tag == "body" and node is root:
                node = Node("body", root)
                root.parts.append(node)
                open_["body"] += 1
                level += 1
            continue
        for closes, scope in (({"p"}, SCOPE) if tag in CLOSES_P else (set(), set()), ENDS.get(tag, (set(), set()))):
            if any(open_[c] for c in closes):
                top = last_open(node, closes, scope)
                if top is not None:
                    node = leave(top)
        aside, hidden = says(tag, attributes)
        if hidden or tag in CONTROLS:
            if tag not in VOID and not closed:
                skipping, depth = tag, 1
            continue
        if tag == "header" and (open_["article"] or open_["main"]):
            aside = 0
        made = Node(tag, node, aside)
        node.parts.append(made)
        if tag not in VOID and not closed and level < DEPTH:
            node = made
            open_[tag] += 1
            level += 1
    if not skipping and at < len(page):
        node.parts.append(page[at:])
    return root


def last_open(node: Node, closed: set[str], scope: set[str]) -> Node | None:
    """The outermost open element of ``closed`` within the scope."""
    found = None
    while node.parent is not None and node.tag not in scope:
        found = node if node.tag in closed else found
        node = node.parent
    return found


def in_order(root: Node) -> list[Node]:
    """Parents before children."""
    out = [root]
    for n in out:
        out.extend(n.nodes())
    return out


def measure(root: Node) -> list[Node]:
    """Characters, tags, link characters and link tags of every subtree, then composite densities and their sums."""
    nodes = in_order(root)
    for n in reversed(nodes):
        own = sum(len(" ".join(html.unescape(p).split())) for p in n.parts if isinstance(p, str))
        n.chars += own
        if n.tag == "a":
            n.links, n.link_tags = n.chars, n.link_tags + 1
        if n.tag in ("article", "main"):
            n.holds = n.chars
        if n.parent is not None:
            up = n.parent
            up.chars += n.chars
            up.tags += n.tags + 1
            up.links += n.links
            up.link_tags += n.link_tags
            up.holds += n.holds
    for n in nodes:
        c, lc, t, lt = n.chars, n.links, max(1, n.tags), n.link_tags
        if not c:
            continue
        spread = math.log(max(1.0, c / max(1, lc) * t / max(1, lt)))
        if root.links:  # the more of a part is links, the larger the base of its logarithm
            spread /= math.log(math.log(c * lc / max(1, c - lc) + root.links / root.chars * c + math.e))
        n.density = c / t * spread
    for n in nodes:
        n.total = sum(k.density for k in n.nodes() if k.tag not in INLINE)  # phrases inside a block are its own text
    return nodes


def set_apart(n: Node, whole: Node, root: Node) -> bool:
    """Whether ``n`` is an aside within ``whole``."""
    if not n.aside or n.holds:
        return False
    return n.aside == 2 or 2 * n.chars <= whole.chars or root.holds > 0


def main_node(root: Node) -> Node:
    """The subtree with the largest sum of densities, with what is as dense beside it."""
    nodes = measure(root)
    inside: set[int] = set()  # nodes of asides
    for n in nodes:
        if n.parent is not None and (id(n.parent) in inside or set_apart(n, root, root)):
            inside.add(id(n))
    free = [n for n in nodes if id(n) not in inside]
    # a node whose text is all its own has no children to sum
    best = max(free, key=lambda n: n.total if n.total else n.density * 1e-6)
    path, up = [], best
    while up is not None:
        path.append(up)
        up = up.parent
    least = min((n.density for n in path if n.density), default=0.0)
    while best.parent is not None and best.tag not in ("article", "main", "body"):
        beside = [n for n in best.parent.nodes() if n is not best and n.chars and id(n) not in inside]
        if any(n.density < least and n.tag not in HEADINGS for n in beside):
            break
        best = best.parent
    return best


def blocks(node: Node, root: Node | None = None) -> list[str]:
    """The text of every block below ``node``, in page order; without the asides if the page's ``root`` is given."""
    out, line = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [node]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            line.append(part)
        elif root is None or part is node or not set_apart(part, node, root):
            if part.tag not in INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(part.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = read_tree(page)
    return " ".join(blocks(main_node(root), root))


def extract(pages: DataFrame, text: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    def make():
        return lambda pages: [[main_text(p) for p in pages]]

    return map_texts(pages.select(key, url, F.col(text).alias("_page")), "_page", make, "text string").withColumn("n_chars", F.length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Golden pages and a plain reading of the test tables' own layout are held against it in tests."""
    return extract(documents(spark, sf, "pages"))
