import re
from html import unescape

import duckdb

from siftline.functions import words as w
from siftline.plans.oracles import ORACLES
from siftline.plans.queries import QUERIES

PATH = "/root/testdata/sf0.001"
PAGES = [
    "<html><head><title> A &amp; B </title></head><body><nav><p>A menu of quite some length that is cut</p></nav><main><h1>A heading that is long enough</h1><p>One <b>two</b>, three, four, five, six<ul><li>An entry of the list, long enough</li><li>short</li></ul></main><p>Outside of the main part, but long</p></body></html>",
    "<body><div class='x ad y'><p>An advert that is long enough to count</p></div><div role=banner><p>A banner that is long enough to count</p></div><table><tr><td>A cell that is long enough to count<td>Another cell, long enough to count</table><blockquote>A quote that is long enough to count</blockquote></body>",
    "<p>No body at all, but a paragraph<br>of two lines <script>var x = '<p>not this paragraph, please</p>'</script></p>",
    "",
]


def plain(page):
    """Texts of content elements by a plain scan of tags: an element is open until its own end tag, or one of an element around it, comes."""
    page = re.sub(r"<!--.*?-->|<![^>]*>", "", page, flags=re.S)
    elements, open_, at, raw = [], [], 0, None  # an element: [tag, attributes, texts, places of the elements around it]
    for m in re.finditer(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", page):
        if raw and not (m[1] and m[2].lower() == raw):
            continue
        text = page[at : m.start()] if raw else unescape(page[at : m.start()])
        for k in open_:
            elements[k][2].append(text)
        at, tag, raw = m.end(), m[2].lower(), None
        if m[1]:
            same = [i for i, k in enumerate(open_) if elements[k][0] == tag]
            del open_[same[-1] if same else len(open_) :]
            continue
        found = re.findall(r"([a-zA-Z-]+)=(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", m[3])
        elements.append([tag, {a: x or y or z for a, x, y, z in found}, [], list(open_)])
        if tag not in ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"):
            open_.append(len(elements) - 1)
            raw = tag if tag in ("script", "style") else None
    for k in open_:
        elements[k][2].append(unescape(page[at:]))
    noise = [e[0] in w.NOISE_TAGS or e[1].get("role") in w.NOISE_ROLES or bool(set(e[1].get("class", "").split()) & set(w.NOISE_CLASSES)) for e in elements]
    good = [k for k, e in enumerate(elements) if not noise[k] and not any(noise[j] for j in e[3])]
    tests = (lambda e: e[0] == "article", lambda e: e[0] == "main", lambda e: e[1].get("role") == "main", lambda e: e[0] == "body")
    main = next((k for test in tests for k in good if test(elements[k])), None)

    def texts_of(k):
        """Stripped texts, without those of noise within."""
        bad = [x for j, e in enumerate(elements) if noise[j] and k in e[3] and not any(noise[i] for i in e[3] if i > k) for x in e[2]]
        left = list(elements[k][2])
        for x in bad:
            left.remove(x)
        return [x.strip() for x in left if x.strip()]

    inside = [k for k in good if (main is None or main in elements[k][3]) and elements[k][0] in w.CONTENT_TAGS]
    title = next((" ".join(x.strip() for x in e[2] if x.strip()) for e in elements if e[0] == "title"), None)
    return "\n\n".join(t for k in inside if len(t := " ".join(texts_of(k))) > 20), title


def is_content(text):
    lines = text.split("\n")
    if len(text) < 200 or sum(bool(re.match(w.NUMERIC_LINE, x.strip())) for x in lines) / len(lines) > 0.3:
        return False
    sizes = [len(s.strip()) for s in re.split(r"[.!?]\s+", text) if len(s.strip()) > 20]
    return len(sizes) >= 5 and sum(sizes) / len(sizes) >= 40


def test_extraction_and_gate_against_plain(spark, tmp_path):
    pages = spark.read.parquet(f"{PATH}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(1000 + i, f"https://p.org/{i}", x) for i, x in enumerate(PAGES)] + [(2000, "https://p.org/none", None)], pages.schema)
    pages.unionByName(more).write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r["page_id"]: r for r in pages.unionByName(more).collect()}
    got = {r["page_id"]: r for r in QUERIES["html_extract"](spark, str(tmp_path)).collect()}
    assert set(got) == set(rows)
    for i, r in rows.items():
        assert (got[i]["text"], got[i]["title"]) == plain(r["html"] or ""), r["html"]
    fetched = {r["url"]: r["text"] for r in QUERIES["page_fetch"](spark, str(tmp_path)).collect()}
    want = {r["url"]: plain(r["html"])[0] for r in rows.values() if r["html"] is not None}
    assert fetched == {u: t[:12000] for u, t in want.items() if len(t) > 50 and is_content(t)} and len(fetched) > 10


def test_fetched_pages_are_whole(spark):
    """No text is cut: neither by the query nor by its SQL."""
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{PATH}/pages.parquet'")
    html = dict(con.execute("select url, html from pages").fetchall())
    want = {u: t for u, h in html.items() if len(t := plain(h)[0]) > 50 and is_content(t)}
    assert max(map(len, want.values())) > 12000
    assert {r["url"]: r["text"] for r in QUERIES["page_fetch"](spark, PATH).collect()} == want
    assert {u: t for u, t, _ in con.execute(ORACLES["page_fetch"]).fetchall()} == want
