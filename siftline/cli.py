"""Command line: python -m siftline.cli QUERY... --mode llm|read|search|debug|a|b --hits TABLE --pages TABLE."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftline.config import load_config
from siftline.functions.text import query_language
from siftline.plans.engine import Engine
from siftline.sources.tables import as_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline")
    p.add_argument("query", nargs="+", help="queries, numbered from 0 as in the hits' query_id")
    p.add_argument("--mode", choices=["llm", "read", "debug", "search", "a", "b"], default="llm")
    p.add_argument("--lang", choices=["en", "ru", "zh"])
    p.add_argument("--config")
    p.add_argument("--hits")
    p.add_argument("--pages")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    rows = spark.createDataFrame(list(enumerate(args.query)), "query_id long, query string")
    queries = rows.withColumn("lang", F.lit(args.lang) if args.lang else query_language("query")).withColumn("as_of", F.lit(datetime.datetime.now().isoformat(" ", "seconds")).cast("timestamp_ntz"))
    hits = spark.read.parquet(args.hits)
    if args.mode in ("a", "b"):
        out = as_json(hits.where(F.col("engine") == args.mode).join(queries.select("query_id"), "query_id", "left_semi").orderBy("query_id", "rank"))
    else:
        engine = Engine(hits, spark.read.parquet(args.pages) if args.pages else spark.createDataFrame([], "url string, text string, pub_date timestamp_ntz"), load_config(args.config))
        if args.mode == "llm":
            out = engine.prompts(queries).select(F.col("prompt").alias("value"))
        elif args.mode == "read":
            out = engine.contexts(queries).select(F.col("context").alias("value"))
        else:
            out = as_json(engine.search(queries).orderBy("query_id", "source_idx"))
    for r in out.toLocalIterator():
        print(r[0])


if __name__ == "__main__":
    main()
