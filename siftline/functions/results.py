"""Engines' result pages: addresses to ask, and the hits that stand in their HTML."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.dom import Node, parse

HIT = "struct<listed:boolean,title:string,url:string,snippet:string>"
#: Places of a hit's snippet, the first that is there counts: tag and class within, and the class of an element around it ("" for any).
SNIPPETS = (("p", "", "b_caption"), ("p", "b_lineclamp2", ""), ("p", "b_lineclamp3", ""), ("p", "b_lineclamp4", ""), ("", "b_snippet", "b_caption"))


def _query(c: Column) -> Column:
    """Percent-coded as in a form: a space is +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def address_a(query: Column, lang: Column, num: int) -> Column:
    """Where engine A answers a query in a language with a few more than ``num`` hits, 30 at most."""
    market = F.when(lang == "en", F.lit("&setmkt=en-US")).otherwise(F.lit(""))
    return F.concat(F.lit("https://www.bing.com/search?q="), _query(query), F.lit(f"&count={min(num + 5, 30)}&setlang="), _query(lang), F.lit("&cc="), _query(lang), market)


def address_b(query: Column, news: Column) -> Column:
    """Where engine B answers a query; a news query gets its news page."""
    return F.concat(F.lit("https://html.duckduckgo.com/html/?q="), _query(query), F.when(news, F.lit("&iar=news&ia=news")).otherwise(F.lit("")))


def _classes(x: Node) -> list[str]:
    return x.attrs.get("class", "").split()


def _inside(x: Node, test: Callable[[Node], bool]) -> Iterator[Node]:
    return (y for y in x.elements() if test(y))


def _within(x: Node, top: Node, name: str) -> bool:
    """Whether an element of that class is around x, not above ``top``."""
    while (x := x.up) is not None and x is not top.up:
        if name in _classes(x):
            return True
    return False


def _linked(top: Node) -> Node | None:
    return next(_inside(top, lambda y: y.tag == "a" and "href" in y.attrs), None)


def hits_a(page: str) -> Iterator[tuple[bool, str, str, str]]:
    """(listed, title, link, snippet): the list's hits, then headings' links, which count where no listed hit does."""
    root = parse(page)
    for li in _inside(root, lambda y: y.tag == "li" and "b_algo" in _classes(y)):
        headed = (a for h in _inside(li, lambda y: y.tag == "h2") for a in _inside(h, lambda y: y.tag == "a"))
        a = next(headed, None) or _linked(li)
        if a is None or not a.attrs.get("href"):
            continue
        snippet = ""
        for tag, name, around in SNIPPETS:
            place = next(_inside(li, lambda y: tag in ("", y.tag) and (not name or name in _classes(y)) and (not around or _within(y, li, around))), None)  # noqa: B023
            if place is not None:
                snippet = place.text()
                break
        if not snippet:
            caption = next(_inside(li, lambda y: y.tag == "div" and "b_caption" in _classes(y)), None)
            snippet = caption.text()[:300] if caption is not None else ""
        yield True, a.text(""), a.attrs["href"], snippet
    for h in _inside(root, lambda y: y.tag == "h2"):
        a = _linked(h)
        if a is not None and a.attrs["href"]:
            yield False, a.text(""), a.attrs["href"], ""


def hits_b(page: str) -> Iterator[tuple[bool, str, str, str]]:
    for div in _inside(parse(page), lambda y: y.tag == "div" and not {"result", "web-result"}.isdisjoint(_classes(y))):
        a = next(_inside(div, lambda y: y.tag == "a" and "result__a" in _classes(y)), None)
        if a is None:
            continue
        said = next(_inside(div, lambda y: y.tag in ("a", "div") and "result__snippet" in _classes(y)), None)
        title, link = a.text(""), a.attrs.get("href", "")
        if title and link:
            yield True, title, link, said.text("") if said is not None else ""


def found(html: Column, engine: Column) -> Column:
    """Array of (listed, title, url, snippet) of a result page of engine "a" or "b", in page order; links are as they stand there."""

    @F.arrow_udf(f"array<{HIT}>")
    def run(pages: pa.Array, engines: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("listed", pa.bool_()), ("title", pa.string()), ("url", pa.string()), ("snippet", pa.string())]))
        rows = [
            [dict(zip(("listed", "title", "url", "snippet"), hit, strict=True)) for hit in (hits_a if e.as_py() == "a" else hits_b)(p.as_py() or "")] for p, e in zip(pages, engines, strict=True)
        ]
        return pa.array(rows, kind)

    return run(html, engine)
