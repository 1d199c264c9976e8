import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siftline.cli import parser
from siftline.config import Config, load_config
from siftline.functions import text as t
from siftline.plans import inputs
from siftline.plans.engine import Engine
from siftline.plans.oracles import ORACLES
from siftline.plans.queries import QUERIES
from siftline.scoring import Scorer
from siftline.sources.tables import as_json, fetched, result_hits, result_pages, spread
from siftline.streaming import ingest

PATH = "/root/testdata/sf0.001"


def canon(rows, columns):
    plain = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    out = []
    for r in rows:
        out.append(tuple(None if (v := plain(r[c])) is None or v != v else v for c in sorted(columns)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages conversations events".split():
        con.execute(f"create view {t} as select * from '{PATH}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, PATH).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got.to_dict("records"), got.columns) == canon(want.to_dict("records"), want.columns)


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_engine_end_to_end(spark):
    engine = Engine(inputs.hits(spark, PATH), spark.read.parquet(f"{PATH}/pages.parquet"))
    asked = inputs.queries(spark, PATH)
    out = engine.ask(asked, lambda p: p[:6]).collect()
    assert len(out) == asked.count() and all(r["answer"] == "Answer" and "QUESTION: " in r["prompt"] for r in out)
    read = engine.read(asked).toPandas()
    assert (read.groupby("query_id").size() <= 30).all() and read.confidence.isin(["HIGH", "MEDIUM", "LOW"]).all()


def test_pages_are_chosen_before_they_are_parsed(spark):
    """The pages that no result names do not reach the parser, and the answer is that of the chosen pages alone."""
    pages = spark.read.parquet(f"{PATH}/pages.parquet")
    asked = inputs.queries(spark, PATH).where("query_id < 2")
    plan = Engine(inputs.hits(spark, PATH), pages).evidence(asked)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    parse = next(i for i, x in enumerate(lines) if "ArrowEvalPython" in x and "html" in x)
    assert any("LeftSemi" in x and i > parse for i, x in enumerate(lines))
    bomb = pages.unionByName(spark.createDataFrame([(9999, "https://never.asked.example/", None)], pages.select("page_id", "url", "html").schema), allowMissingColumns=True)
    a, b = (sorted(map(str, Engine(inputs.hits(spark, PATH), p).contexts(asked).collect())) for p in (pages.where("page_id < 20"), bomb))
    assert a == b


def models():
    """Counts of letters as vectors, another language's models differ; words in common as scores. Made here so that workers need not import this module."""
    import numpy as np

    def embed(texts, lang):
        return np.array([[x.lower().count(c) * (-1 if lang != "en" and k else 1) for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")] for x in texts], float)

    def cross(pairs, lang):
        return [len(set(q.lower().split()) & set(t.lower().split())) for q, t in pairs]

    return embed, cross


def test_scorer(spark):
    import numpy as np

    rows = [("ab", "ba", "en"), ("ab", "cd", "en"), ("ab", "ab", "ru"), ("ab", None, "en"), ("", "x", None), ("abc", "abd", "ru")]
    df = spark.createDataFrame(rows, "q string, t string, l string")
    embed, cross_of = models()
    scorer = Scorer(embed, cross_of)
    got = [tuple(r) for r in df.select(scorer.similarity(F.col("q"), F.col("t"), F.col("l")), scorer.relevance(F.col("q"), F.col("t"), F.col("l"))).collect()]
    for (q, t, lang), (near, cross) in zip(rows, got, strict=True):
        if t is None:
            assert near is cross is None
            continue
        a, b = embed([q, t], lang or "")
        size = np.linalg.norm(a) * np.linalg.norm(b)
        assert abs(near - (a @ b / size if size else 0)) < 1e-12 and cross == len({q} & {t} - {""})
    assert Scorer().similarity(F.col("q"), F.col("t"), F.col("l")) is None and Scorer().relevance(F.col("q"), F.col("t"), F.col("l")) is None


def test_engine_with_models(spark):
    """Results are filtered by title and snippet and numbered anew, price lists count if relevant, chunks end where sentences differ, the chosen are ranked anew."""
    prices = "\n".join(["1 234,50 ₽", "99.99 $", "5 000"] * 30)
    prose = " ".join(f"The bakery in the old town sold {i} loaves of fresh bread on that day." for i in range(30))
    html = {u: f"<article>{''.join(f'<p>{x}{pad}</p>' for x in t.split(chr(10)))}</article>" for u, t, pad in (("https://a.org/1", prose, ""), ("https://b.org/2", prices, " " * 30), ("https://c.org/3", prose, ""))}
    pages = spark.createDataFrame([(u, h) for u, h in html.items()], "url string, html string")
    hits = [(1, "a", 1, "bread of the bakery", "https://a.org/1", "loaves of bread"), (1, "a", 2, "zzzz", "https://b.org/2", "zz"), (1, "a", 3, "bakery bread", "https://c.org/3", "the bread")]
    hits = spark.createDataFrame(hits, "query_id long, engine string, rank int, title string, url string, snippet string")
    asked = spark.createDataFrame([(1, "bakery bread", "en")], "query_id long, query string, lang string").withColumn("as_of", F.lit("2024-02-15 12:00:00").cast("timestamp_ntz"))
    plain, engine = Engine(hits, pages), Engine(hits, pages, scorer=Scorer(*models()))
    assert [r["source_idx"] for r in plain.results(asked).orderBy("source_idx").collect()] == [0, 1, 2]
    assert [(r["source_idx"], r["url"]) for r in engine.results(asked).orderBy("source_idx").collect()] == [(0, "https://a.org/1"), (1, "https://c.org/3")]
    read = engine.read(asked).collect()
    assert read and all(r["semantic"] > 0 for r in read)
    # 0.6 relevance + 0.4 of whole numbers of words in common
    assert engine.prompts(asked).count() == 1 and max(r["relevance"] for r in read) > 0.4
    texts = spark.createDataFrame([(1, "https://p.org/", "1 234,50 ₽\n" * 60)], "query_id long, url string, text string").withColumn("query", F.lit("0")).withColumn("lang", F.lit("en"))
    near = lambda value: texts.select(t.is_content("text", F.lit(value))).first()[0]
    assert near(0.35) and not near(0.34) and not texts.select(t.is_content("text")).first()[0]
    assert texts.select(F.length(t.preview("text"))).first()[0] == 500
    other = Engine(hits, pages, extract=lambda page: "Another extractor's text comes with sentences of some length here. " * 30 if "bakery" in page else "short")
    got = {r["source_url"]: r["text"] for r in other.evidence(asked).collect()}
    assert "Another extractor's" in got["https://a.org/1"] and got["https://b.org/2"] == "zz"


def test_snippets_stand_as_they_are(spark):
    """Where no page could be read, snippets are chunks however short they are; empty ones are none."""
    hits = [(1, "a", 1, "one", "https://a.org/1", "tiny"), (1, "a", 2, "two", "https://b.org/2", ""), (1, "a", 3, "three", "https://c.org/3", None)]
    hits = spark.createDataFrame(hits, "query_id long, engine string, rank int, title string, url string, snippet string")
    asked = spark.createDataFrame([(1, "one", "en")], "query_id long, query string, lang string").withColumn("as_of", F.lit("2024-02-15 12:00:00").cast("timestamp_ntz"))
    for pages in (spark.createDataFrame([], "url string, html string"), spark.createDataFrame([("https://a.org/1", "<p>short</p>")], "url string, html string")):
        got = Engine(hits, pages).evidence(asked).collect()
        assert [(r["source_idx"], r["chunk_idx"], r["text"], r["fetched"]) for r in got] == [(0, 0, "tiny", True)]


def test_news_hits_of_engine_b(spark):
    rows = [(1, "b", 1, "plain one", "https://a.org/1", "", False), (1, "b", 1, "news one", "https://b.org/2", "", True), (2, "b", 1, "plain two", "https://c.org/3", "", False), (2, "b", 1, "news two", "https://d.org/4", "", True), (2, "a", 1, "list", "https://e.org/5", "", None)]
    hits = spark.createDataFrame(rows, "query_id long, engine string, rank int, title string, url string, snippet string, news boolean")
    asked = spark.createDataFrame([(1, "history of rome", "en"), (2, "latest news of rome", "en")], "query_id long, query string, lang string").withColumn("as_of", F.lit("2024-02-15 12:00:00").cast("timestamp_ntz"))
    got = Engine(hits, spark.createDataFrame([], "url string, html string")).search(asked).collect()
    assert {(r["query_id"], r["title"]) for r in got} == {(1, "plain one"), (2, "news two"), (2, "list")}


def test_result_links_of_broken_lines(spark):
    """A link that the engine's page holds with a line break in it is unwrapped, and is one hit with the same link in one line."""
    code = "aHR0cHM6Ly9leGFtcGxlLmNvbS9h"
    items = "".join(f'<li class="b_algo"><h2><a href="https://www.bing.com/ck/a?p=1&amp;u=a1{x}&amp;ntb=1">T</a></h2></li>' for x in (code[:8] + "\r\n" + code[8:], code))
    pages = spark.createDataFrame([(1, "a", f"<ol>{items}</ol>")], "query_id long, engine string, html string")
    assert [(r["rank"], r["url"]) for r in result_hits(pages).collect()] == [(1, "https://example.com/a")]


def test_result_pages(spark):
    """Engines are asked at their addresses, their pages' hits are read, and a failed request has none."""
    a = """<ol><li class="b_algo"><h2><a href="https://x.org/1"> One <b>bold</b> </a></h2><div class="b_caption"><p>said <i>so</i></p></div></li><li class="b_algo"><div><a href="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS9h">Two</a></div></li>
    <li class="b_algo"><h2><a href="https://go.microsoft.com/x">Own</a></h2></li><li class="b_algo"><h2><a href="https://x.org/1?again">Same</a></h2></li></ol><h2><a href="https://y.org/">Heading</a></h2>"""
    bare = """<h2><a href="https://y.org/">Heading</a></h2><h2>No link</h2><li class="b_algo"><h2><a href="/own">Relative</a></h2></li>"""
    b = """<div class="result web-result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fz.org%2F%3Fq&rut=1"> Z </a><div class="result__snippet">a <b>b</b></div></div><div class="result"><a class="result__a" href="">none</a></div><div class="web-result"><a class="result__a" href="https://z.org/?q">Z</a></div>"""

    def get(url, timeout):
        if "rome" in url:
            assert "q=old+rome" in url
            return (200, bare) if "bing" in url else (500, "")
        assert url in ("https://www.bing.com/search?q=news+%26+%2A%7E%7E&count=20&setlang=en&cc=en&setmkt=en-US".replace("%7E", "~"), "https://html.duckduckgo.com/html/?q=news+%26+%2A~~&iar=news&ia=news"), url
        return 200, a if "bing" in url else b

    asked = spark.createDataFrame([(1, "news & *~~", "en"), (2, "old rome", "ru")], "query_id long, query string, lang string")
    pages = result_pages(asked, get, pause=(0, 0))
    got = {(r["query_id"], r["engine"], r["rank"]): (r["title"], r["url"], r["snippet"]) for r in result_hits(pages).collect()}
    assert got == {
        (1, "a", 1): ("Onebold", "https://x.org/1", "said so"),
        (1, "a", 2): ("Two", "https://example.com/a", ""),
        (1, "b", 1): ("Z", "https://z.org/?q", "ab"),
        (1, "b", 2): ("Z", "https://z.org/?q", ""),
        (2, "a", 1): ("Heading", "https://y.org/", ""),
    }
    assert result_hits(pages, 1).count() == 3


def test_public_names():
    import siftline

    assert all(getattr(siftline, n) is not None for n in siftline.__all__) and siftline.Engine is Engine
    with pytest.raises(AttributeError):
        siftline.nothing


def test_small_files_are_spread(spark):
    rows = spark.read.parquet(f"{PATH}/documents.parquet")
    assert spread(rows).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and spread(rows).count() == rows.count()
    wide = spark.range(100).repartition(16)
    assert spread(wide) is wide


def test_scratch_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from siftline.sources import scratch

    conf = SimpleNamespace(get=lambda key, default: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="x", master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.scratch_dir(cluster)
    assert scratch.scratch_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://x/y/"), sparkContext=cluster.sparkContext)) == "hdfs://x/y"


def test_output_does_not_depend_on_partitions(spark):
    from siftline.operators import ranking

    rows = inputs.chunks(spark, PATH)
    a, b = (sorted(map(str, ranking.rerank(rows.repartition(n)).select("query_id", "island", "doc_id", "relevance", "confidence").collect())) for n in (1, 7))
    assert a == b


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("top_n_fetch: 8\nfetch_timeout: 9\nposition_bonus: 'no'\nunknown: 1\n")
    c = load_config(str(f), {}, chunk_size=500)
    assert (c.top_n_fetch, c.fetch_timeout, c.position_bonus, c.chunk_size) == (8, 9, False, 500)
    assert load_config(None, {"RAG_TOP_N_FETCH": "7"}) == Config(top_n_fetch=7)
    assert load_config(None, {"RAG_CONFIG_PATH": str(f), "RAG_TOP_N_FETCH": "6"}).top_n_fetch == 6
    with pytest.raises(ValueError):
        load_config(None, {"RAG_POSITION_BONUS": "maybe"})
    f.write_text("- 1")
    with pytest.raises(ValueError):
        load_config(str(f), {})


def test_parser():
    args = parser().parse_args(["bitcoin rate", "--mode", "search"])
    assert args.query == ["bitcoin rate"] and args.mode == "search"


def test_fetcher(spark):
    def get(url, timeout):
        assert timeout == 3
        if "bad" in url:
            raise OSError("gone")
        return (200, f"<p>{url}</p>") if "ok" in url else (404, "")

    rows = spark.createDataFrame([("https://a/ok",), ("https://a/no",), ("https://b/bad",), ("https://a/ok",)], "url string")
    got = {r["url"]: (r["html"], r["error"]) for r in fetched(rows, get, 2, timeout=3, pause=(0, 0.01)).collect()}
    assert got == {"https://a/ok": ("<p>https://a/ok</p>", None), "https://a/no": (None, "HTTP 404"), "https://b/bad": (None, "gone")}


def test_json(spark):
    assert as_json(spark.createDataFrame([(1, "é")], "a int, b string")).first()[0] == '{"a":1,"b":"é"}'
    assert as_json(spark.createDataFrame([(1, None)], "a int, b string")).first()[0] == '{"a":1,"b":null}'


def test_stream(spark, tmp_path):
    pages = spark.read.parquet(f"{PATH}/pages.parquet")
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    pages.where("page_id < 25").write.mode("append").parquet(src)
    ingest.ingest(spark, src, out, mark).awaitTermination(120)
    pages.where("page_id >= 25").write.mode("append").parquet(src)
    ingest.ingest(spark, src, out, mark).awaitTermination(120)
    want = ingest.chunk_stream(pages).collect()
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, want)) and len(want) > 50
    events = spark.read.parquet(f"{PATH}/events.parquet")
    assert ingest.event_counts(events).agg({"n": "sum"}).first()[0] == events.count()
