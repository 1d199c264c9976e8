"""Merging engines' ranked hits by normalized URL, and the semantic pre-filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.functions import urls

BOTH = 1.3


def admitted(hits: DataFrame, listed: str | None = None) -> DataFrame:
    """Engine A's raw hits (query_id, engine, rank, title, url, snippet) unwrapped, admitted, the first of each URL, ranked anew.

    ``listed`` names a flag: hits without it count where a query has none with it.
    """
    rows = hits.withColumn("url", urls.unwrapped_a(F.col("url"))).where(urls.admitted(F.col("url"), F.col("title")))
    if listed is not None:
        rows = rows.withColumn("_best", F.max(listed).over(W.partitionBy("query_id", "engine"))).where(F.col(listed) == F.col("_best")).drop("_best")
    first = F.row_number().over(W.partitionBy("query_id", "engine", urls.engine_key(F.col("url"))).orderBy("rank"))
    rows = rows.withColumn("_first", first).where("_first = 1").drop("_first")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "engine").orderBy("rank")))


def merged(hits: DataFrame, num: int = 20, target_lang: Column | None = None) -> DataFrame:
    """(query_id, source_idx, title, url, snippet, score, engines): the best ``num`` URLs of each query.

    A URL scores the sum of 1 / rank, more if several engines have it; ranks count before titles in
    another language are dropped. The longest title and snippet stand, the first of equals; the URL is the first seen.
    """
    rows = hits.withColumn("norm", urls.normalized(F.col("url")))
    if target_lang is not None:
        lang = t.language("title")
        rows = rows.where((lang == target_lang) | (lang == "other"))
    longest = lambda c: F.min_by(c, F.struct(-F.length(F.coalesce(F.col(c), F.lit(""))), F.col("engine"), F.col("rank")))
    seen = F.struct("engine", "rank")
    per = rows.groupBy("query_id", "norm").agg(
        F.sum(1.0 / F.col("rank")).alias("raw"),
        F.array_sort(F.collect_set("engine")).alias("engines"),
        F.min(seen).alias("seen"),
        F.min_by("url", seen).alias("url"),
        longest("title").alias("title"),
        longest("snippet").alias("snippet"),
    )
    per = per.withColumn("raw", F.when(F.size("engines") >= 2, F.col("raw") * BOTH).otherwise(F.col("raw")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("raw"), "seen"))
    return per.withColumn("place", place).where(F.col("place") <= num).select("query_id", (F.col("place") - 1).alias("source_idx"), "title", "url", "snippet", F.round("raw", 3).alias("score"), "engines")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def relevant(results: DataFrame, similarity: Column, lang: Column) -> DataFrame:
    """Results similar enough to their query; those without a similarity pass."""
    return results.where(F.coalesce(similarity >= F.when(lang == "ru", 0.25).otherwise(0.30), F.lit(True)))


def renumbered(results: DataFrame) -> DataFrame:
    """Results numbered anew in their order."""
    return results.withColumn("source_idx", F.row_number().over(W.partitionBy("query_id").orderBy("source_idx")) - 1)


def with_pages(results: DataFrame, pages: DataFrame, num_fetch: int = 10, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """The best results with their page's text and date, or their snippet where there is no page. ``paged`` tells, ``fetched`` does, too, but is true of all of a query's if none was.

    ``keep`` says of a page's text whether it counts as one for the result's query.
    """
    rows = results.where(F.col("source_idx") < num_fetch).join(pages.select("url", F.col("text").alias("page_text"), "pub_date"), "url", "left")
    good = F.col("page_text").isNotNull()
    if keep is not None:
        good = good & keep(F.col("page_text"))
    rows = rows.withColumn("paged", F.coalesce(good, F.lit(False)))
    some = F.max(F.col("paged").cast("int")).over(W.partitionBy("query_id")) == 1
    rows = rows.withColumn("fetched", F.col("paged") | ~some).withColumn("text", F.when(F.col("paged"), F.col("page_text")).otherwise(F.col("snippet")))
    return rows.withColumn("pub_date", F.when(F.col("paged"), F.col("pub_date"))).drop("page_text")
