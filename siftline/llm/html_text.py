"""Main text of web pages by two-pass block rules.

A page is cut at block tags. Scripts, styles, forms, navigation, page headers, footers and asides are no candidates, nor is what
the page hides. Names of classes, ids and roles are evidence of two strengths: an element all of whose name says menu, advert, notice, sidebar or
comments is no candidate either, unless an article opens inside it; where a name only holds such a word, its blocks have to stand
the first pass by themselves.

The first pass classes each block by stop-word density, length and link density: text or boilerplate if that is
clear, else undecided. In the second pass an undecided block takes the label of its nearest decided
neighbours (text if either side is at the same distance). Where the page marks an article or main part, that part is
the candidate and its blocks are text. Where nothing but elements dropped by name holds a block that the first pass calls text, and
they are no comments, the names are not believed. A page in none of the languages whose stop words are known (under KNOWN of its words are)
is judged by length, links and sentence marks alone.

Defined results: null or empty html gives empty text; html without tags is one block; unclosed tags end with the page; a tag whose quotes
don't match ends at its first >; repeated rows are extracted alike; an empty table gives an empty result; null urls stay null; other columns are
ignored; no length is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.sources.reading import table

LONG, SHORT = 200, 70
DENSE, SOME = 0.30, 0.20
LINKS = 0.5
#: Share of a page's words that must be known stop words for their density to count.
KNOWN = 0.05
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem "
    "le la les de et un une des du que qui dans en est pour pas sur plus par au avec ce il se ne son sa ou aux mais nous cette elle on "
    "el los las del y por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend "
    "li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul video audio".split()
)
DROPPED = frozenset("nav header footer aside form button select textarea option iframe noscript object svg menu dialog fieldset audio video canvas template title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_LIKE = frozenset("p li td th tr dt dd option".split())
#: Words of names that mark what is no main text, those of them that mark readers' words, and words that may stand beside them.
COMMENTS = frozenset("comment comments commentlist respond disqus replies".split())
NOT_MAIN = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent gdpr footer header masthead menu modal nav navbar navigation newsletter notice notices notification "
    "popup promo promotion related share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo alert search".split()
)
BESIDE = frozenset(
    "site page global top bottom left right primary secondary main box block section wrapper wrap container list item items area inner outer bar buttons button links link form group panel slot unit row col small large big mini "
    "mobile desktop sticky fixed post article content user reader readers thread feed text title".split()
)
#: Between < and the name of an element that holds no markup, and its end.
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(noscript|template|textarea|iframe|svg|math)\b(?:[^>]*[^>/])?>.*?</\2\s*>|<!\[CDATA\[|\]\]>|<[!?][^>]*>", re.I | re.S)
_VALUE = r"\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[^\s\"'>][^\s>]*"
ATTRIBUTE = re.compile(rf"([^\s=>/\"']+)(?:\s*=\s*({_VALUE}))?")
#: A tag whose attributes are whole; else what reaches to the first >.
TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:\s+|/(?!>)|[^\s=>/\"']+(?:\s*=\s*(?:{_VALUE}))?)*)\s*(/?)>|([^<>]*)>)")
SENTENCE = re.compile(r"[.!?…。！？](?:[\"'»”)\]]*)(?:\s|$)")
EDGES = ".,;:!?()[]«»\"'"


class Block(NamedTuple):
    text: str
    linked: int
    article: bool
    heading: bool
    #: "" or what speaks against it: "tag" and "comments" are never text, "name" hardly ever, "weak" if the first pass says so.
    doubt: str


def named(names: str, article: bool = False) -> str:
    """What an element's class, id and role say: "comments", "name", "weak" or nothing. An article's own header says nothing, as its tag does not."""
    out = ""
    for token in names.lower().split():
        words = [w for w in re.split(r"[-_]+", token) if w]
        hits = [w for w in words if w in NOT_MAIN and not (article and w == "header")]
        if not hits:
            continue
        if all(w in NOT_MAIN or w in BESIDE or w.isdigit() for w in words):
            kind = "comments" if any(w in COMMENTS for w in hits) else "name"
        else:
            kind = "weak"
        out = min(out or kind, kind, key=("comments", "name", "weak").index)
    return out


def marks(rest: str) -> tuple[str, bool]:
    """An element's class, id and role, and whether it is hidden."""
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            names.append(value)
        elif key == "hidden":
            hidden |= value.lower() != "false"
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "style":
            hidden |= bool(re.search(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", value, re.I))
    return " ".join(names), hidden


def _worse(a: str, b: str) -> str:
    return min(a, b, key=("tag", "comments", "name", "weak", "").index)


def blocks(page: str) -> Iterator[Block]:
    stack = [("", "", False, False, False)]  # tag, doubt, article, link, heading
    parts: list[str] = []
    linked = 0

    def flush() -> Block | None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        _, doubt, article, _, heading = stack[-1]
        out = Block(text, linked, article, heading, doubt) if text else None
        parts.clear()
        linked = 0
        return out

    page = RAW.sub(" ", page)
    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            text = entities.unescape(page[at : m.start()])
            parts.append(text)
            if stack[-1][3]:
                linked += len(" ".join(text.split()))
        at = m.end()
        tag, rest = m[2].lower(), m[3] or m[5] or ""
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr" and (b := flush()):
                yield b
            continue
        if tag in BLOCK and (b := flush()):
            yield b
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if m[4]:
            continue
        if tag in ENDS_LIKE:  # these end the one before
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK and stack[k][0] not in ("td", "th", "dt", "dd"):
                    break
        _, doubt, article, link, heading = stack[-1]
        names, hidden = marks(rest) if rest else ("", False)
        main = tag in ("article", "main") or names.strip().lower() in ("main", "article")
        if main and doubt in ("name", "weak"):
            doubt = ""  # a wrapper's name says nothing of the article within
        # a heading group inside an article belongs to it; a page's own header does not
        if hidden or (tag in DROPPED and not (tag == "header" and article)):
            doubt = "tag"
        elif names and not main and tag not in ("html", "body"):
            doubt = _worse(doubt, named(names, article))
        stack.append((tag, doubt, article or main, link or tag == "a", heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
    if at < len(page):
        parts.append(entities.unescape(page[at:]))
    if b := flush():
        yield b


def density(text: str) -> float:
    words = text.split()
    return sum(w.strip(EDGES).lower() in STOP_WORDS for w in words) / max(len(words), 1)


def classify(b: Block, known: bool = True) -> str:
    """First pass: text, boilerplate, undecided or a fragment: short, of no stop word and no sentence. ``known``: whether the page's language is one whose stop words count."""
    sentence = bool(SENTENCE.search(b.text))
    if b.linked > LINKS * len(b.text) or "©" in b.text:
        return "boilerplate"
    share = density(b.text) if known else 0.0
    if len(b.text) < SHORT:
        return "undecided" if sentence or b.heading or share > 0 else "fragment"
    if not known:
        return "text" if sentence else "undecided"
    return "text" if share >= DENSE or (share >= SOME and len(b.text) >= LONG) else "undecided"


def inherited(labels: list[str]) -> list[bool]:
    """Second pass: whether each block is text, undecided ones by their nearest decided neighbours; all are if none is decided."""
    n = len(labels)
    near: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for order in (range(n), range(n - 1, -1, -1)):
        last = None
        for k in order:
            if labels[k] != "undecided":
                last = k
            if last is not None:
                near[k].append((abs(k - last), labels[last]))
    return [not x or any(label == "text" for far, label in x if far == min(x)[0]) for x in near]


def main_text(page: str | None) -> str:
    found = [b for b in blocks(page or "") if b.doubt != "tag"]
    if any(b.article and b.doubt != "comments" for b in found):
        found = [b for b in found if b.article]
    everything = " ".join(b.text for b in found)
    known = density(everything) >= KNOWN
    labels = [classify(b, known) for b in found]
    clear = [x == "text" for x in labels]
    if not any(t and b.doubt in ("", "weak") for t, b in zip(clear, found, strict=True)) and any(t and b.doubt == "name" for t, b in zip(clear, found, strict=True)):
        found = [b._replace(doubt="") if b.doubt == "name" else b for b in found]
    kept = [(b, x) for b, x in zip(found, labels, strict=True) if b.doubt in ("", "weak")]
    # a fragment beside text is a menu's or a caption's; on a page of fragments it may be all there is
    fragment = "boilerplate" if any(x == "text" for _, x in kept) else "undecided"
    kept = [(b, fragment if x == "fragment" else x) for b, x in kept]
    # the article's own blocks are text; what bears a doubtful name has to be so by the first pass
    labels = ["text" if b.article and not b.doubt else ("boilerplate" if b.doubt and x != "text" else x) for b, x in kept]
    return "\n".join(b.text for (b, _), text in zip(kept, inherited(labels), strict=True) if text)


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep``, and text."""
    rows = pages.select(*keep, F.col(column).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(x.as_py()) for x in b.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], text], [*keep, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, f"{fields}, text string")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _decoded(x: str) -> str:
    for name, code in (("quot", 34), ("lt", 60), ("gt", 62), ("amp", 38)):
        x = f"regexp_replace({x}, '&{name};?', chr({code}), 'g')"
    return x


#: The same for pages that mark their one article and name nothing in it, as the tables' do: what stands between the article's block tags. Other pages are held against plain versions in tests.
OP6_SQL = rf"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<!--.*?-->|<br[^>]*>', ' ', 'g'), '</?(?:a|b|i|em|strong|span|u|code|small|sub|sup)(?:\s[^>]*)?>', '', 'g') AS x FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(x, '<[^>]*>'), lambda y: trim(regexp_replace({_decoded("y")}, '\s+', ' ', 'g'))), lambda z: z <> '') AS x FROM a),
t AS (SELECT page_id, url, array_to_string(x, chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""
