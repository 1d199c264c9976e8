"""Lexical scores: document frequencies and BM25 within each query's chunks, the query itself counted among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.sources.scratch import materialized

K1, B = 1.5, 0.75


def idf(chunks: DataFrame) -> DataFrame:
    """(query_id, token, df, idf) of all tokens of (query_id, query, text)."""
    own = chunks.select("query_id", F.explode(F.array_distinct(t.tokens("text"))).alias("token"))
    asked = chunks.select("query_id", "query").distinct()
    n = chunks.groupBy("query_id").agg((F.count("*") + 1).alias("n"))
    rows = own.unionByName(asked.select("query_id", F.explode(F.array_distinct(t.tokens("query"))).alias("token")))
    df = rows.groupBy("query_id", "token").agg(F.count("*").alias("df"))
    return df.join(n, "query_id").select("query_id", "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def counted(chunks: DataFrame) -> DataFrame:
    """Adds tokens, q (the query's tokens), tf (how often each of q stands among tokens) and size (how many tokens there are)."""
    rows = chunks.withColumn("tokens", t.tokens("text")).withColumn("q", t.tokens("query"))
    asked = F.filter("tokens", lambda x: F.array_contains("q", x))
    return rows.withColumn("tf", t.let(asked, lambda own: F.transform("q", lambda x: F.size(F.filter(own, lambda y: y == x))))).withColumn("size", F.size("tokens"))


def bm25(chunks: DataFrame) -> DataFrame:
    """The chunks (query_id, query, text, ...) with tokens, q and bm25, scaled by the query's best.

    Only the query's tokens are counted in each chunk, so what is shuffled for the statistics is a row a chunk and query token.
    Chunks that ``counted`` has not seen are counted and written first, as the statistics and the scores read them.
    """
    rows = chunks if "tf" in chunks.columns else materialized(counted(chunks), "tokens")
    sizes = rows.groupBy("query_id").agg((F.count("*") + 1).alias("n"), ((F.sum("size") + F.max(F.size("q"))) / (F.count("*") + 1)).alias("mean"))
    df = rows.select("query_id", F.posexplode("tf").alias("at", "f")).groupBy("query_id", "at").agg((F.count_if(F.col("f") > 0) + 1).alias("df"))
    df = df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "df"))), lambda x: x["df"]).alias("dfs"))
    stats = sizes.join(df, "query_id", "left").select("query_id", "mean", F.transform(F.coalesce("dfs", F.array().cast("array<bigint>")), lambda d: F.log((F.col("n") + 1) / (d + 1)) + 1).alias("idfs"))
    rows = rows.join(stats, "query_id")
    norm = K1 * (1 - B + F.when(F.col("mean") > 0, B * F.col("size") / F.col("mean")).otherwise(0.0))
    parts = F.zip_with("tf", "idfs", lambda f, w: F.when(f > 0, w * (f * (K1 + 1)) / (f + norm)).otherwise(F.lit(0.0)))
    rows = rows.withColumn("raw", F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))
    # the best comes from a window by query, as the rank does later, so that rows are shuffled once
    best = F.max("raw").over(W.partitionBy("query_id"))
    rows = rows.withColumn("best", best).withColumn("bm25", F.when(F.col("best") > 0, F.col("raw") / F.col("best")).otherwise(F.col("raw")))
    return rows.drop("idfs", "mean", "size", "raw", "best", "tf")


def tfidf(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, ``key``, similarity): cosine of each chunk's sparse TF-IDF vector with its query's; 0 if either has no token.

    Tokens are read once and dealt by query; counts, document frequencies (a window over a query's token) and sums then find their rows in place.
    """
    own = chunks.select("query_id", F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.lit(False).alias("_asked"), t.tokens("text").alias("_t"))
    asked = chunks.select("query_id", "query").distinct()
    asked = asked.select("query_id", F.lit(None).cast(chunks.schema[key].dataType).alias("_key"), F.lit(None).cast("long").alias("_row"), F.lit(True).alias("_asked"), t.tokens("query").alias("_t"))
    n = chunks.groupBy("query_id").agg((F.count("*") + 1).alias("_all"))
    rows = own.unionByName(asked).join(n, "query_id", "left").repartition("query_id")
    # an outer explode, as Spark finds out whether the array of a plain one is empty before that, which reads the tokens twice
    rows = rows.select("query_id", "_key", "_row", "_asked", "_all", F.size("_t").alias("_size"), F.explode_outer("_t").alias("token")).where("token is not null")
    rows = rows.groupBy("query_id", "token", "_asked", "_key", "_row", "_all", "_size").agg(F.count("*").alias("_n"))
    by = W.partitionBy("query_id", "token")
    share = F.col("_n") / F.col("_size")
    rows = rows.withColumn("_idf", F.log((F.col("_all") + 1) / (F.count("*").over(by) + 1)) + 1).withColumn("_wanted", F.max(F.when(F.col("_asked"), share)).over(by))
    # rows of one key and size count as one
    rows = rows.groupBy("query_id", "token", "_asked", "_key", "_size").agg(F.sum("_n").alias("_n"), F.max("_idf").alias("_idf"), F.max("_wanted").alias("_wanted"))
    w = share * F.col("_idf")
    sums = rows.groupBy("query_id", "_asked", "_key").agg(F.sum(w * F.col("_wanted") * F.col("_idf")).alias("dot"), F.sqrt(F.sum(w * w)).alias("length"))
    # the query's length comes by a window: a join with a part of the sums would make them twice
    sums = sums.withColumn("asked_length", F.max(F.when(F.col("_asked"), F.col("length"))).over(W.partitionBy("query_id")))
    rows = sums.where(~F.col("_asked")).select("query_id", F.col("_key").alias(key), "dot", "length", "asked_length")
    rows = chunks.select("query_id", key).join(rows, ["query_id", key], "left")
    return rows.select("query_id", key, F.coalesce(F.try_divide("dot", F.col("length") * F.col("asked_length")), F.lit(0.0)).alias("similarity"))
