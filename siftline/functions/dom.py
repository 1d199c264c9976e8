"""Reading pages: the text of content elements, the publish date's string, and the title, in one Arrow pass.

Tags build a tree the simple way: a start tag opens an element inside the current one, an end tag closes up to the nearest of
its name or does nothing; so an unclosed paragraph holds the next one, and its text stands in both.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import words as w

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAST = 20
#: Pages whose texts stand in a Python worker together.
AT_ONCE = 256


class Node:
    __slots__ = ("attrs", "inside", "tag", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.up, self.inside = tag, attrs, up, []

    def walk(self) -> Iterator[Node | str]:
        stack = [iter(self.inside)]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
                continue
            yield x
            if isinstance(x, Node):
                stack.append(iter(x.inside))

    def elements(self) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node))

    def text(self, glue: str = " ") -> str:
        return glue.join(s for x in self.walk() if isinstance(x, str) and (s := x.strip()))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.up

    def handle_endtag(self, tag):
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.inside.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def _noise(node: Node) -> bool:
    return node.tag in w.NOISE_TAGS or node.attrs.get("role") in w.NOISE_ROLES or bool(set(node.attrs.get("class", "").split()) & set(w.NOISE_CLASSES))


def _pruned(node: Node) -> None:
    stack = [node]
    while stack:
        x = stack.pop()
        x.inside = [y for y in x.inside if isinstance(y, str) or not _noise(y)]
        stack.extend(y for y in x.inside if isinstance(y, Node))


def content(root: Node) -> str:
    """Texts of more than LEAST characters of the main part's content elements, by blank lines. Changes the tree."""
    _pruned(root)
    first = {}
    for x in root.elements():
        for name, there in (("article", x.tag == "article"), ("main", x.tag == "main"), ("role", x.attrs.get("role") == "main"), ("body", x.tag == "body")):
            if there:
                first.setdefault(name, x)
    main = next((first[k] for k in ("article", "main", "role", "body") if k in first), root)
    return "\n\n".join(t for x in main.elements() if x.tag in w.CONTENT_TAGS and len(t := x.text()) > LEAST)


def date_string(root: Node) -> str | None:
    """The first that the list of places gives, each by its first element alone; else what JSON-LD says."""
    elements = list(root.elements())
    for tag, name, value in w.DATES:
        x = next((x for x in elements if x.tag == tag and name in x.attrs and (value is None or x.attrs[name] == value)), None)
        if x is not None and (found := x.attrs.get("content") or x.attrs.get("datetime")):
            return found
    for x in elements:
        if x.tag == "script" and x.attrs.get("type") == "application/ld+json":
            try:
                data = json.loads("".join(y for y in x.inside if isinstance(y, str)))
            except ValueError:
                continue
            if isinstance(data, dict) and isinstance(found := data.get("datePublished") or data.get("dateCreated"), str):
                return found
    return None


#: Characters from which another extractor's text is taken.
ENOUGH = 100


def read(page: str | None, extract: Callable[[str], str | None] | None = None) -> tuple[str, str | None, str | None]:
    """Text, date string and title. ``extract``, another extractor, gives the text where it finds more than ENOUGH characters."""
    root = parse(page or "")
    date = date_string(root)
    title = next((x.text() for x in root.elements() if x.tag == "title"), None)
    other = extract(page) if extract is not None and page else None
    return other if other and len(other) > ENOUGH else content(root), date, title


def extracted(html: Column | str, extract: Callable[[str], str | None] | None = None) -> Column:
    """(text, date, title) of a page."""

    @F.arrow_udf("struct<text:string,date:string,title:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for at in range(0, len(pages), AT_ONCE):
                text, date, title = zip(*(read(x.as_py(), extract) for x in pages.slice(at, AT_ONCE)), strict=True)
                yield pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (text, date, title)], ["text", "date", "title"])

    return run(html)


def with_text(pages: DataFrame, column: str = "html", extract: Callable[[str], str | None] | None = None) -> DataFrame:
    return pages.withColumn("page", extracted(column, extract))
