"""How the driver's tables stand in for hits, pages and chunks. Every row of a table is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.tables import table

#: Queries, dealt to query ids in turn; they meet all kinds of intents.
QUERIES = ["latest news erin", "price of thble", "what is anea", "how to thor eren", "overview of thion history", "курс erer", "when thti where", "explain eren onthe", "strategy for erblest", "плюсы eau quei"]
AS_OF = "2024-02-15 12:00:00"
#: Documents and pages a query.
CHUNKS, HITS = 20, 10


def query_text(query_id: Column) -> Column:
    return F.get(F.array(*map(F.lit, QUERIES)), (query_id % len(QUERIES)).cast("int"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, lang, as_of): one for every HITS pages."""
    ids = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / HITS).alias("query_id")).distinct()
    return ids.select("query_id", query_text(F.col("query_id")).alias("query"), F.lit("en").alias("lang"), F.lit(AS_OF).cast("timestamp_ntz").alias("as_of"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as hits of two engines: by page_id, and backwards with other forms of the URL and a longer title."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    at = (F.col("page_id") % HITS + 1).cast("int")
    rows = pages.select(F.floor(F.col("page_id") / HITS).alias("query_id"), "url", title.alias("title"), at.alias("at"))
    a = rows.select("query_id", F.lit("a").alias("engine"), F.col("at").alias("rank"), "title", "url", F.concat(F.lit("about "), "title").alias("snippet"))
    other = F.concat(F.replace(F.substring_index(F.substring_index("url", "?", 1), "#", 1), F.lit("http://"), F.lit("https://www.")), F.lit("/?from=b"))
    b = rows.where("at <> 4").select("query_id", F.lit("b").alias("engine"), (HITS + 1 - F.col("at")).alias("rank"), F.concat("title", F.lit(" updated")).alias("title"), other.alias("url"), F.lit("short").alias("snippet"))
    return a.unionByName(b)


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, engine, html): the hits as the engines' result pages hold them. Snippets stand in several places; of every query whose first title is
    longer than the second, engine A's page has no list but headings alone."""
    rows = hits(spark, sf_dir)
    code = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    title, snippet, at = code("title"), code("snippet"), F.col("rank") % 4
    wrapped = F.translate(F.rtrim(F.base64(F.col("url").cast("binary")), F.lit("=")), "+/", "-_")
    link = F.when(F.col("rank") % 2 == 0, F.concat(F.lit("https://www.bing.com/ck/a?!&amp;&amp;p=1&amp;u=a1"), wrapped, F.lit("&amp;ntb=1"))).otherwise(code("url"))
    head = F.concat(F.lit('<h2><a href="'), link, F.lit('">'), title, F.lit("</a></h2>"))
    said = (
        F.when(at == 0, F.concat(F.lit('<div class="b_caption"><p>'), snippet, F.lit("</p></div>")))
        .when(at == 1, F.concat(F.lit('<p class="x b_lineclamp3">'), snippet, F.lit("</p>")))
        .when(at == 2, F.concat(F.lit('<div class="b_caption"><div><span class="b_snippet">'), snippet, F.lit("</span></div></div>")))
        .otherwise(F.concat(F.lit('<div class="b_caption">'), snippet, F.lit("</div>")))
    )
    first = F.length(F.min_by("title", "rank")) > F.length(F.min_by(F.when(F.col("rank") > 1, F.col("title")), F.when(F.col("rank") > 1, F.col("rank"))))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("x")))), lambda y: y["x"]), "\n")
    a = rows.where("engine = 'a'").groupBy("query_id").agg(joined(F.concat(F.lit('<li class="b_algo">'), head, said, F.lit("</li>"))).alias("listed"), joined(head).alias("heads"), first.alias("first"))
    a = a.select("query_id", F.lit("a").alias("engine"), F.concat(F.lit("<html><body><ol>"), F.when(F.col("first"), F.col("heads")).otherwise(F.col("listed")), F.lit("</ol></body></html>")).alias("html"))
    target = F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&amp;rut=1"))
    one = F.concat(F.lit('<div class="result web-result"><a class="result__a" href="https:'), target, F.lit('">'), title, F.lit('</a><a class="result__snippet" href="#">'), snippet, F.lit("</a></div>"))
    b = rows.where("engine = 'b'").groupBy("query_id").agg(joined(one).alias("all_")).select("query_id", F.lit("b").alias("engine"), F.concat(F.lit("<html><body>"), "all_", F.lit("</body></html>")).alias("html"))
    return a.unionByName(b)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks: CHUNKS to a query, four to a source, dates but for every fifth, source 3 not fetched."""
    docs = table(spark, sf_dir, "documents")
    query_id, source = F.floor(F.col("doc_id") / CHUNKS), F.floor((F.col("doc_id") % CHUNKS) / 4)
    rows = docs.select("doc_id", query_id.alias("query_id"), query_text(query_id).alias("query"), source.cast("int").alias("source_idx"), (F.col("doc_id") % 4).cast("int").alias("chunk_idx"), "text", "lang")
    date = F.lit("2024-01-01 06:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 45).cast("int"))
    return rows.select(
        "doc_id", "query_id", "query", "source_idx", "chunk_idx", "text",
        F.concat(F.lit("https://www.site"), ((F.col("query_id") * 5 + F.col("source_idx")) % 3).cast("string"), F.lit(".example.com/"), F.col("query_id").cast("string"), F.lit("/"), F.col("source_idx").cast("string")).alias("source_url"),
        F.concat(F.lit("Report "), F.col("source_idx").cast("string"), F.when(F.col("source_idx") % 2 == 0, F.lit(" on erin")).otherwise(F.lit(" on eren"))).alias("source_title"),
        F.when(F.col("doc_id") % 5 != 0, date).alias("pub_date"), F.lit(AS_OF).cast("timestamp_ntz").alias("as_of"), (F.col("source_idx") != 3).alias("fetched"),
    )
