"""Context, source list, freshness warning and prompt, a row a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.functions import urls

NO_CHUNKS, NO_SOURCES = "No relevant content found.", "No relevant sources found."

# fixed values: the prompt's wording
HEAD = "Answer the user's question using ONLY the search results provided below.\n\nCURRENT DATE: "
RULES = """
WRITING REQUIREMENTS:
1. Use only the provided sources.
2. Organize the answer with clear `##` headings.
3. Cite every factual claim with `[N]`.
4. For news queries, prioritize sources from the last 7 days.
5. If sources conflict, describe both versions clearly.
6. Include concrete details: dates, names, numbers, prices, locations, and percentages when available.
7. Use all relevant sources instead of relying on only one or two.
8. End with `## Источники:` and list the sources actually used.

QUALITY SIGNALS FROM THE PIPELINE:
"""
FOOT = """

ANSWER FORMAT:
[Detailed answer with inline citations]

## Источники:
[1] Source Title — URL
[2] Another Source — URL
"""
ALL_OLD = "\n⚠️ FRESHNESS WARNING: This is a news query, but all dated sources are older than 30 days.\n"
ALL_OLD_END = "\nUse cautious wording and tell the user current coverage may be incomplete.\n"
SOME_OLD = "\n⚠️ OUTDATED SOURCES WARNING: Some sources are older than 30 days.\n"
SOME_OLD_END = "\nPrioritize fresher reporting from "


def surviving(ranked: DataFrame, fetched: Column | None = None, renumber: bool = True) -> DataFrame:
    """Chunks of sources that were fetched and are relevant (mean 0.3 or best 0.5), with source_no."""
    rows = ranked if fetched is None else ranked.where(fetched)
    by = W.partitionBy("query_id", "source_idx")
    rows = rows.withColumn("_mean", F.avg("relevance").over(by)).withColumn("_best", F.max("relevance").over(by))
    rows = rows.where((F.col("_mean") >= 0.3) | (F.col("_best") >= 0.5)).drop("_mean", "_best")
    number = F.dense_rank().over(W.partitionBy("query_id").orderBy("source_idx")) if renumber else F.col("source_idx") + 1
    return rows.withColumn("source_no", number)


def ghosts(ranked: DataFrame, fetched: Column) -> DataFrame:
    """Sources dropped because their page was not fetched."""
    return ranked.where(~fetched).select("query_id", "source_idx", "source_title", "source_url").distinct()


def _in_order(key: str, value: Column, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"]), glue)


def sources(rows: DataFrame) -> DataFrame:
    """(query_id, source_no, source_title, source_url, body, oldest) of surviving chunks: a row a source."""
    per = rows.groupBy("query_id", "source_no").agg(
        F.min_by("source_title", "sel_pos").alias("source_title"), F.min_by("source_url", "sel_pos").alias("source_url"), _in_order("sel_pos", t.plain("text"), "\n").alias("body"), F.min("pub_date").alias("oldest")
    )
    return per


def contexts(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, context, source_list) of all queries of ``ranked``; rows are those that survive."""
    block = F.concat(F.lit("["), F.col("source_no").cast("string"), F.lit("] "), F.col("source_title"), F.lit("\n"), F.col("body"), F.lit("\n"))
    line = F.concat(F.lit("  ["), F.col("source_no").cast("string"), F.lit("] "), F.col("source_title"), F.lit(" — "), F.col("source_url"))
    per = sources(rows).groupBy("query_id").agg(_in_order("source_no", block, "\n").alias("context"), _in_order("source_no", line, "\n").alias("source_list"))
    asked = ranked.select("query_id").distinct()
    return asked.join(per, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_SOURCES)).alias("context"), F.coalesce("source_list", F.lit("")).alias("source_list"))


def freshness(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, warning) of (query_id, query, as_of): for news queries, sources whose oldest chunk is more than 30 days old."""
    days = F.floor(F.timestamp_diff("SECOND", F.col("oldest"), F.col("as_of")) / 86400)
    per = sources(rows).join(queries.select("query_id", "query", "as_of"), "query_id").where(t.is_news("query")).withColumn("days", days)
    old = F.col("days") > 30
    line = F.concat(F.lit("  ["), F.col("source_no").cast("string"), F.lit("] ("), F.date_format("oldest", "MMM yyyy"), F.lit(", "), F.col("days").cast("string"), F.lit(" days old)"))
    fresh = F.concat(F.lit("["), F.col("source_no").cast("string"), F.lit("]"))
    per = per.groupBy("query_id").agg(
        F.count_if(old).alias("n_old"), F.count("*").alias("n"), _in_order("source_no", F.when(old, line), "\n").alias("lines"), _in_order("source_no", F.when(F.coalesce(~old, F.lit(True)), fresh), ", ").alias("fresh")
    )
    warning = F.when(F.col("n_old") == 0, "").when(F.col("n_old") == F.col("n"), F.concat(F.lit(ALL_OLD), F.col("lines"), F.lit(ALL_OLD_END))).otherwise(F.concat(F.lit(SOME_OLD), F.col("lines"), F.lit(SOME_OLD_END), F.col("fresh"), F.lit(".\n")))
    return queries.select("query_id").distinct().join(per.select("query_id", warning.alias("warning")), "query_id", "left").select("query_id", F.coalesce("warning", F.lit("")).alias("warning"))


def prompts(queries: DataFrame, ranked: DataFrame, fetched: Column | None = None) -> DataFrame:
    """(query_id, prompt) of all queries (query_id, query, as_of), with or without ranked chunks."""
    rows = surviving(ranked, fetched)
    context = contexts(ranked, rows)
    signals = ranked.groupBy("query_id").agg(
        F.count("*").alias("chunks"), F.count_distinct(urls.authority(F.coalesce("source_url", F.lit("")))).alias("domains"), F.count_if(t.has_facts("text")).alias("facts"), F.count_if(F.col("pub_date").isNotNull()).alias("dated")
    )
    kept = rows.groupBy("query_id").agg(F.count_distinct("source_no").alias("sources"))
    p = t.profile("query")
    all_ = queries.join(context, "query_id", "left").join(signals, "query_id", "left").join(kept, "query_id", "left").join(freshness(rows, queries), "query_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    text = F.concat(
        F.lit(HEAD), F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"), F.lit(" ("), F.date_format("as_of", "EEEE"), F.lit(")"), F.coalesce("warning", F.lit("")), F.lit(RULES),
        F.lit("- Context chunks: "), n("chunks"), F.lit("\n- Unique sources: "), n("sources"), F.lit("\n- Unique domains: "), n("domains"),
        F.lit("\n- Chunks with factual data: "), n("facts"), F.lit("\n- Chunks with explicit dates: "), n("dated"),
        F.lit("\n\nQUERY PROFILE:\n- Type: "), p["type"], F.lit("\n- Intent: "), p["intent"], F.lit("\n- Expected answer shape: "), p["expected_length"],
        F.lit("\n- Critical attributes: "), F.array_join(p["critical_attributes"], ", "), F.lit("\n\nQUESTION: "), F.col("query"),
        F.lit("\n\nSOURCES:\n"), F.coalesce("context", F.lit(NO_CHUNKS)), F.lit("\n\nReferences:\n"), F.coalesce("source_list", F.lit("")), F.lit(FOOT),
    )
    return all_.select("query_id", text.alias("prompt"))
