"""Small per-row helper for markup whose meaning lies in its nesting."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# A price in text, and elements without a body.
MONEY = r"(?i)R\$\s*([0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]{2})?|[0-9]+(?:\.[0-9]{2}))"
_MONEY = re.compile(MONEY)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """A page's elements in the order they open, each with the range of elements and of texts inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.last, self.first_text, self.end_text = [-1], [0], [0], [0]
        self.texts, self.owner, self.priced, self.anchors = [], [], [], []
        self.open, self.names = [(0, "#")], Counter()

    def handle_starttag(self, tag, attrs):
        node = len(self.parent)
        self.parent.append(self.open[-1][0])
        self.last.append(node)
        self.first_text.append(len(self.texts))
        self.end_text.append(len(self.texts))
        if tag == "a":
            self.anchors.append(node)
        if tag not in _VOID:
            self.open.append((node, tag))
            self.names[tag] += 1

    def handle_endtag(self, tag):
        while self.names[tag]:  # an end tag without a start closes nothing
            if self._leave() == tag:
                return

    def _leave(self) -> str:
        node, tag = self.open.pop()
        self.names[tag] -= 1
        self.last[node], self.end_text[node] = len(self.parent) - 1, len(self.texts)
        return tag

    def handle_data(self, data):
        node, tag = self.open[-1]
        if tag in ("script", "style", "template"):
            return
        if _MONEY.search(data):
            self.priced.append(node)
        if data.strip():
            self.texts.append(data.strip())

    def done(self) -> None:
        self.close()
        while self.open:
            self._leave()


def _price_contexts(html: str) -> list[dict]:
    tree = _Tree()
    tree.feed(html)
    tree.done()
    inside = lambda node: " ".join(tree.texts[tree.first_text[node]:tree.end_text[node]])
    seen, out = set(), []
    for node in tree.priced:
        top = max(tree.parent[max(tree.parent[node], 0)], 0)
        if top in seen:
            continue
        seen.add(top)
        links = tree.anchors[bisect_right(tree.anchors, top):bisect_right(tree.anchors, tree.last[top])]
        out.append({"context": inside(top), "links": [x for x in map(inside, links) if x]})
    return out


_CONTEXTS = ArrayType(StructType([StructField("context", StringType()), StructField("links", ArrayType(StringType()))]))


@F.pandas_udf(_CONTEXTS)
def price_contexts(html: pd.Series) -> pd.Series:
    """For every text with a price: the text of the element two above its own, and the links in it."""
    return html.map(_price_contexts)
