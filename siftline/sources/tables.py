"""Sources and sinks: tables of hits and pages, an optional live fetcher, prompts and JSON lines."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import results, urls
from siftline.functions import text as t
from siftline.functions.dates import published
from siftline.functions.dom import with_text
from siftline.operators import merge
from siftline.sources.reading import spread, table  # noqa: F401

HITS = "query_id long, engine string, rank int, title string, url string, snippet string"
PAGES = "url string, html string, error string"


def fetched(
    urls: DataFrame, get: Callable[[str, float], tuple[int, str]], hosts: int = 200, retries: int = 2, timeout: float = 15, pause: tuple[float, float] = (0.5, 1.5)
) -> DataFrame:
    """(url, html, error) of distinct (url): ``get(url, timeout)`` gives a status and a body, or raises, after which it is asked again in a while.

    A host's pages go to few tasks, for politeness.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b["url"]:
                html, error = None, None
                for k in range(retries + 1):
                    if k:
                        time.sleep(random.uniform(*pause))
                    try:
                        status, body = get(url, timeout)
                        html, error = (body, None) if status == 200 else (None, f"HTTP {status}")
                        break
                    except Exception as e:  # one page's failure is its own
                        error = str(e) or type(e).__name__
                rows.append((url, html, error))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    host = F.substring_index(F.substring_index("url", "/", 3), "/", -1)
    return urls.select("url").distinct().repartition(hosts, host).mapInPandas(run, PAGES)


def result_pages(queries: DataFrame, get: Callable[[str, float], tuple[int, str]], num: int = 15, **how) -> DataFrame:
    """(query_id, engine, html): both engines' answers to (query_id, query, lang); ``how`` goes to ``fetched``. A failed request has null html."""
    a = queries.select("query_id", F.lit("a").alias("engine"), results.address_a(F.col("query"), F.col("lang"), num).alias("url"))
    b = queries.select("query_id", F.lit("b").alias("engine"), results.address_b(F.col("query"), t.is_news("query")).alias("url"))
    asked = a.unionByName(b)
    return asked.join(fetched(asked, get, **how).select("url", "html"), "url", "left").select("query_id", "engine", "html")


def result_hits(pages: DataFrame, num: int = 15) -> DataFrame:
    """HITS, the first ``num`` a query and engine, of result pages (query_id, engine, html). No page has none; a heading's link of engine A counts where no listed hit does."""
    rows = pages.select("query_id", "engine", F.posexplode(results.found(F.col("html"), F.col("engine"))).alias("rank", "hit")).select("query_id", "engine", "rank", "hit.*")
    a = merge.admitted(rows.where("engine = 'a'"), "listed")
    b = rows.where("engine = 'b'").withColumn("url", urls.unwrapped_b(F.col("url")))
    b = b.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "engine").orderBy("rank")))
    columns = ["query_id", "engine", "rank", "title", "url", "snippet"]
    return a.select(*columns).unionByName(b.select(*columns)).where(F.col("rank") <= num)


def page_texts(pages: DataFrame, *, gate: bool = True, extract: Callable[[str], str | None] | None = None) -> DataFrame:
    """(url, text, pub_date) of pages (url, html) whose text is content; whole texts."""
    rows = with_text(pages.where(F.col("html").isNotNull()).select("url", "html"), extract=extract).select("url", "page.text", published(F.col("page.date")).alias("pub_date"))
    return rows.where((F.length("text") > 50) & t.is_content("text")) if gate else rows


def prompt_name(query: Column, stamp: Column) -> Column:
    """File name of a query's prompt: its word characters, at most 50, and the time."""
    safe = F.regexp_replace(F.trim(F.regexp_replace(query, r"(?U)[^\w\s-]", "")), r"(?U)[-\s]+", "_")
    return F.concat(F.lit("prompt_"), F.substring(safe, 1, 50), F.lit("_"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit(".txt"))


def save_prompts(prompts: DataFrame, folder: str) -> None:
    """One Parquet table of (query_id, file_name, prompt): a file each would not scale."""
    prompts.write.mode("append").parquet(folder)


def as_json(rows: DataFrame) -> DataFrame:
    """A JSON object a row, letters as they are, nulls written out."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
