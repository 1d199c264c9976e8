import base64
import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from siftline.functions import dates, urls
from siftline.functions import text as t
from siftline.functions.chunking import by_meaning, by_size, chunks, hashed
from siftline.functions.dom import read
from siftline.plans.oracles import ORACLES


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_language(spark):
    texts = ["новости ИИ", "latest AI news", "新闻 abc", "123", "", None, "éàü", "abcdefghi я", "abcdefgh я"]
    assert column(spark, t.language, texts) == ["ru", "en", "zh", "other", "other", "other", "other", "en", "ru"]
    assert column(spark, t.query_language, ["новости ИИ", "latest AI news"]) == ["ru", "en"]


def test_language_counts_each_kind_of_letter_once(spark):
    """A text is gone through once a kind of letter, by runs: the work is in proportion to its length and not many times that."""
    rows = spark.createDataFrame([("ab " * 1000 + "я" * 300,)], "x string").select(t.language("x").alias("y"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3 and plan.count("]+,") == 3
    assert rows.first()["y"] == "ru"


def test_tokens(spark):
    assert column(spark, t.tokens, ["The Cat's étion, и для мышь 42 2024", None]) == [["cat", "tion", "мышь", "2024"], []]


def test_intents(spark):
    queries = ["strategy", "know how", "overview of price", "history", "что такое дом", "сколько", "explain it", "latest"]
    assert column(spark, t.breadth, queries) == [8, 12, 8, 30, 12, 8, 12, 12]
    assert column(spark, t.is_news, queries) == [False, True, False, False, False, False, False, True]
    assert [(w.bm25, w.semantic) for w in column(spark, t.weights, queries)] == [(0.7, 0.3), (0.7, 0.3), (0.8, 0.2), (0.7, 0.3), (0.5, 0.5), (0.8, 0.2), (0.5, 0.5), (0.65, 0.35)]
    p = column(spark, t.profile, ["what is news", "обзор", "how to"])
    assert [x.type for x in p] == ["Factual/Brief", "Comprehensive", "Medium complexity"]
    assert [x.critical_attributes[0] for x in p] == ["freshness (today/yesterday)", "relevance", "clarity"]


def test_facts(spark):
    texts = ["1.5", "1.5 and 20 %", "12/05/2024", "neural btc 10:30", "$ 5 и 2024", "plain", "10:30"]
    assert column(spark, t.has_facts, texts) == [False, True, True, True, True, False, False]


def test_quality(spark):
    long_ = "Perfectly ordinary sentences stand here, with several different words."
    assert column(spark, t.is_incomplete, ["x" * 49, long_, long_ + " and", "lower " + long_, "- " + long_ * 2, long_ * 2 + " -", " " * 60, None, "a" * 120]) == [True, False, True, True, True, True, True, True, False]
    once, twice = "Subscribe here and now, all rights reserved, other words follow.", "Read our privacy policy and the cookie policy of these pages today."
    assert column(spark, t.is_low_quality, ["short", once, twice, "same " * 30 + "others indeed", "an of it to by we " * 10, "x" * 200, long_, None, "Join with subscribe to our newsletter today everyone around."]) == [True, False, True, True, True, True, False, True, True]
    assert column(spark, t.without_garbage, ["  keep this line \n\nshort\nno 5\nfollow us today\n" + "follow us " * 6]) == ["keep this line\nno 5\n" + ("follow us " * 6).strip()]


def test_content(spark):
    s = "This is a sentence of more than forty characters, as it should be. "
    prices = "\n".join(["1,200 $"] * 40 + ["words"] * 10) + s * 2
    assert column(spark, t.is_content, [s * 5, s * 3, s * 2, prices, "Short one here, twenty. " * 20, None]) == [True, False, False, False, False, False]
    assert column(spark, lambda x: t.is_content(x, F.lit(0.4)), [prices]) == [True]


def test_urls(spark):
    variants = ["https://www.Example.com/a/?q=1#x", "http://example.com/a///", "HTTPS://example.com/a", "https://WWW.example.com/a"]
    assert column(spark, urls.normalized, variants) == ["example.com/a", "example.com/a", "https://example.com/a", "www.example.com/a"]
    assert column(spark, urls.engine_key, variants[:2]) == ["https://www.example.com/a", "http://example.com/a"]
    assert column(spark, urls.domain, ["https://u@www.a.org:8080/x", "no url", None]) == ["u@a.org:8080", "", ""]


def test_redirects(spark):
    links = ["https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS9hYg&n=1", "https://www.bing.com/ck/a?u=a1!!&r=https%3A%2F%2Fe.org", "https://www.bing.com/ck/a?u=a1zzzz", "https://e.org/u=a1aHR0"]
    assert column(spark, urls.unwrapped_a, links) == ["https://example.com/ab", "https://e.org", links[2], links[3]]
    links = ["//duckduckgo.com/l/?uddg=https%3A%2F%2Fe.org%2Fa%2Bb+c&x=1", "https://e.org/?uddg=x"]
    assert column(spark, urls.unwrapped_b, links) == ["https://e.org/a+b c", links[1]]


def test_redirects_of_broken_lines(spark):
    """Tabs and line breaks in a link count for nothing, as in base64 of more than 76 characters."""
    url = "https://www.example.com/de/8708?utm_source=feed&of=more+than+a+line"
    code = base64.encodebytes(url.encode()).decode().replace("\n", "\r\n").rstrip("\r\n=")
    assert "\r\n" in code
    links = [f"https://www.bing.com/ck/a?!&&p=1&u=a1{code}&ntb=1", "https://www.bing.com/ck/a?u=a1zz\n&r=https%3A%2F%2Fe.o\trg", "https://e.org/a\nb"]
    assert column(spark, urls.unwrapped_a, links) == [url, "https://e.org", links[2]]


def test_dates(spark):
    raw = ["2024-01-05T10:20:30+03:00", "2024-01-05T10:20:30Z", "2024-01-05", "2024-01-05T10:20:30-05:00", "Fri, 05 Jan 2024 GMT", "2024", "2024-02-30", None]
    got = [None if x is None else str(x) for x in column(spark, dates.published, raw)]
    assert got == ["2024-01-05 10:20:30", "2024-01-05 10:20:30", "2024-01-05 00:00:00", "2024-01-05 10:20:30", None, None, None, None]


def test_page():
    page = """<html><head><title>T</title><meta name="date" content="2024-01-05"><meta property="article:published_time"></head><body><p>Outside of the article, long enough.</p>
    <article><nav><p>Navigation text that is long enough.</p></nav><script>var t="</p>";</script><p>Twenty characters xx</p><p>Twenty-one characters.<p>A paragraph inside &amp; after it.</article></body></html>"""
    text, date, title = read(page)
    assert text == "Twenty-one characters. A paragraph inside & after it.\n\nA paragraph inside & after it." and date == "2024-01-05" and title == "T"
    assert read('<script type="application/ld+json">[1]</script><script type="application/ld+json">{"dateCreated": "2024-02-03T04:05:06Z"}</script>')[1] == "2024-02-03T04:05:06Z"
    assert read(None) == ("", None, None) and read("<div class='x ad'><p>An advert of some length here.</p></div>")[0] == ""


def test_chunks_by_size():
    s = "A sentence that counts. "
    chunks = by_size(s * 100)
    assert all(len(c) <= 900 for c in chunks) and chunks[0].endswith("counts.") and chunks[1].startswith(chunks[0][-100:])
    assert by_size("p" * 500 + "\n\n" + "q" * 300) == ["p" * 500, "p" * 100 + "\n\n" + "q" * 300]
    assert by_size("p" * 500 + "\n\n" + "q" * 300, overlap=0) == ["p" * 500, "q" * 300]
    assert by_size("x" * 2000, overlap=0) == ["x" * 600, "x" * 600, "x" * 800] and by_size("") == by_size(None) == [] and by_size("y" * 40) == []
    assert len(by_size("z" * 3000, size=100, overlap=200)) > 0


def test_chunks_leave_a_batch_in_pieces(spark):
    """Of a batch that a Python worker gets, only some rows' chunks stand there together; the rows keep their chunks."""
    rows = spark.range(2000).coalesce(1).select("id", F.concat(F.lit("Row "), F.col("id"), F.lit(" is long enough to be a chunk of its own. ")).alias("x")).select("id", F.when(F.col("id") % 7 != 0, F.repeat("x", 40)).alias("x"))
    for lang in (None, F.lit("en")):
        out = rows.select("id", "x", (chunks("x") if lang is None else chunks("x", embed=lambda s, lang: hashed(s), lang=lang)).alias("y"))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan, plan
        got = out.collect()
        assert [r["id"] for r in got] == list(range(2000))
        assert all(r["y"] == ([] if r["x"] is None else by_size(r["x"]) if lang is None else (by_meaning(r["x"], 600, hashed) or by_size(r["x"]))) for r in got)


def test_chunks_by_meaning():
    def embed(xs):
        return [[1.0, 0.0] if "cat" in x else [0.0, 1.0] for x in xs]

    assert by_meaning("A cat sat. The cat ran. A dog sat. The dog ran. Dogs bark.", 600, embed) == ["A cat sat. The cat ran.", "A dog sat. The dog ran. Dogs bark."]
    assert by_meaning("One cat. Two.", 600, embed) == ["One cat. Two."] and by_meaning("A cat. A cat. A cat.", 600, embed) is None


@pytest.mark.parametrize("texts", [["a b b c"], [""]])
def test_most_frequent(spark, texts):
    assert column(spark, lambda x: t.most_frequent(t.pieces(x)), texts) == [max([0, *(x.split().count(w) for x in texts for w in x.split())])]


def test_chunks_by_meaning_at_the_quantile():
    """Documents with cosines of 1/6 that rounding sets apart, right at the quantile, are cut where SQL cuts them."""
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.1/documents.parquet' where doc_id in (433, 914, 2778, 4390, 6735, 7996, 9357, 9420)")
    want = con.execute(f"select doc_id, list(chunk order by chunk_idx) from ({ORACLES['semantic_chunks']}) group by 1").fetchall()
    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    assert {i: by_meaning(texts[i], 600, hashed) for i in texts} == dict(want)


def test_semantic_chunks_of_whole_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    met = 0
    for text, got in rows.select("text", chunks("text", embed=hashed)).collect():
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
        x = [hashed([s])[0] for s in sentences]
        near = [float(a @ b) / max(float((a @ a) * (b @ b)) ** 0.5, 1e-12) for a, b in itertools.pairwise(x)]
        if len(sentences) < 3:
            assert got == ([text] if text else [])
            continue
        ordered, at = sorted(near), 0.3 * (len(near) - 1)
        low, part = int(at), at - int(at)
        least = ordered[low] + part * (ordered[min(low + 1, len(near) - 1)] - ordered[low])
        want = [[sentences[0]]]
        for s, n in zip(sentences[1:], near, strict=True):
            if n < least - 1e-9 or sum(map(len, want[-1])) + len(s) > 600:
                want.append([])
            want[-1].append(s)
        if len(want) > 1 and all(abs(n - least) > 1e-9 or n == least for n in near):
            met += 1
            assert got == [" ".join(w) for w in want]
    assert met > 50


def test_strip_is_of_all_white_space(spark):
    """As the pattern (?U)^\\s+|\\s+$ does, for each character."""
    values = [f"{chr(k)} {chr(k)}a {chr(k)}b{chr(k)}" for k in range(1, 0x3100)] + ["", " ", "\n \u3000", None]
    pattern = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    assert column(spark, t.strip, values) == column(spark, pattern, values)
