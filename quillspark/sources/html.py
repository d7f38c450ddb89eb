"""HTML records: a tree from the standard library's parser, visible text, cross references, entries.

A record is a page of a keyed dictionary source, or any web page. Each is a pure
function of its text, mapped in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without an end tag, elements never shown, elements that break lines.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("script style noscript template head".split())
BLOCK = set("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
#: Elements that an opening tag of the same group closes, as browsers do.
CLOSES = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

#: Elements whose content the standard library's parser, in one version or another, does not read as markup.
RAW = set("script style textarea title plaintext xmp iframe noembed noframes noscript".split())

_BLANK = r"[ \t\n\r]"
_ATTRIBUTE = rf"""{_BLANK}+[a-zA-Z][a-zA-Z-]*=(?:"[^"&<>]*"|'[^'&<>]*')"""
#: A page of nothing but texts and well-formed tags, and its tokens: a text, an end tag, or a start tag's name, attributes and slash.
_plain = re.compile(rf"(?:[^<]++|</[a-zA-Z][a-zA-Z0-9]*+{_BLANK}*+>|<[a-zA-Z][a-zA-Z0-9]*+(?:{_ATTRIBUTE})*+{_BLANK}*+/?>)*+")
_token = re.compile(rf"([^<]+)|</([a-zA-Z0-9]+){_BLANK}*>|<([a-zA-Z0-9]+)((?:{_ATTRIBUTE})*){_BLANK}*(/?)>")
_attribute = re.compile(r"""([a-zA-Z-]+)=(?:"([^"]*)"|'([^']*)')""")


#: Cross references of a page. Typed, not DDL: workers import this module without a Spark context.
REFS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())]))


class Node:
    __slots__ = ("tag", "attrs", "children", "classes")

    def __init__(self, tag: str, attrs: dict[str, str], classes: frozenset[str]):
        self.tag, self.attrs, self.classes = tag, attrs, classes
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """The node and its descendants, in order; a stack, not recursion, for pages are nested as deep as they like."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *classes: str) -> Iterator[Node]:
        """Descendants, in order, that bear one of the classes or are elements of such a name."""
        wanted = set(classes)
        return (n for n in self.walk() if n is not self and (wanted & n.classes or n.tag in wanted))

    def first(self, *classes: str) -> Node | None:
        return next(self.find(*classes), None)

    def text(self, skip: frozenset[str] | set[str] = frozenset(), lines: bool = False) -> str:
        """Visible text without the subtrees of the classes, or tags, in ``skip``."""
        parts: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                parts.append(child)
            elif child.tag not in HIDDEN and child.tag not in skip and not skip & child.classes:
                edge = ["\n"] if lines and child.tag in BLOCK else []
                parts += edge
                stack += edge
                stack.extend(reversed(child.children))
        whole = "".join(parts)
        if lines:
            return "\n".join(x for x in (" ".join(line.split()) for line in whole.split("\n")) if x)
        return " ".join(whole.split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, frozenset())
        self.open = [self.root]
        self.names: Counter[str] = Counter()  # of the open elements, so that an end tag without a start costs nothing

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while tag in CLOSES.get(self.open[-1].tag, ()):
            self.shut()
        node = self.node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(self.node(tag, attrs))

    def node(self, tag: str, attrs: list[tuple[str, str | None]]) -> Node:
        found = {k: v or "" for k, v in attrs}
        return Node(tag, found, frozenset(found.get("class", "").split()))

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag]:
            while self.shut() != tag:
                pass

    def shut(self) -> str:
        tag = self.open.pop().tag
        self.names[tag] -= 1
        return tag

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _start(tag: str, attrs: str) -> tuple[str, dict[str, str], frozenset[str]]:
    """What a well-formed start tag says: name, attributes and classes, which all its nodes share."""
    found = {k.lower(): a or b for k, a, b in _attribute.findall(attrs)}
    return tag.lower(), found, frozenset(found.get("class", "").split())


_started = lru_cache(maxsize=4096)(_start)


def _plain_tree(html: str) -> Node | None:
    """What _Builder makes of a page of nothing but texts and well-formed tags; none where an element's content is raw."""
    root = last = Node("#root", {}, frozenset())
    opened: list[Node] = [root]
    names: dict[str, int] = {}
    for text, end, start, attrs, slash in _token.findall(html):
        if text:
            last.children.append(unescape(text) if "&" in text else text)
        elif end:
            end = end.lower()
            if names.get(end):
                shut = None
                while shut != end:
                    shut = opened.pop().tag
                    names[shut] -= 1
                last = opened[-1]
        else:
            node = Node(*(_started(start, attrs) if len(attrs) <= 200 else _start(start, attrs)))
            tag = node.tag
            if tag in RAW:
                return None
            if slash:
                last.children.append(node)
                continue
            while last.tag in CLOSES and tag in CLOSES[last.tag]:
                names[opened.pop().tag] -= 1
                last = opened[-1]
            last.children.append(node)
            if tag not in VOID:
                opened.append(node)
                names[tag] = names.get(tag, 0) + 1
                last = node
    return root


def tree(html: str | None) -> Node:
    html = html or ""
    root = _plain_tree(html) if _plain.fullmatch(html) else None
    if root is not None:
        return root
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def clean_text_udf(skip: set[str]):
    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: tree(x).text(skip, lines=True))

    return run


def clean_text(html: Column, skip: set[str] | None = None) -> Column:
    """Visible text, one block a line, without the given classes."""
    return clean_text_udf(skip or set())(html)


def _refs(root: Node) -> list[dict]:
    seen: dict[tuple[str, str], dict] = {}
    for node in root.walk():
        if node.tag == "a" and node.attrs.get("href"):
            text = node.text()
            seen.setdefault((text, node.attrs["href"]), {"text": text, "href": node.attrs["href"]})
    return [r for r in seen.values() if r["text"]]


@F.pandas_udf(REFS)
def cross_refs(pages: pd.Series) -> pd.Series:
    """Links with text, each once, in order."""
    return pages.map(lambda x: _refs(tree(x)))
