"""A training corpus from documents: language ID, near-duplicates, benchmark leaks, personal data, mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm.common import Scratch
from siftline.llm.decontamination import clean
from siftline.llm.language import identified
from siftline.llm.mixing import mixed
from siftline.llm.pii import sanitise
from siftline.llm.simhash import deduplicated
from siftline.sources.reading import table

STAGES = [
    ("language_id", lambda spark, docs, sf_dir: identified(docs)),
    ("simhash_dedup", lambda spark, docs, sf_dir: deduplicated(docs)),
    ("decontamination", lambda spark, docs, sf_dir: clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))),
    ("pii", lambda spark, docs, sf_dir: sanitise(docs)),
    ("source_mixing", lambda spark, docs, sf_dir: mixed(docs)),
]
#: Learned labels, recurrent networks and components are beyond SQL; a test holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs)
    return docs
