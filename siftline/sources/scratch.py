"""Written tables that cut lineage, in the folder that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and the master is local (tests) one of our own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="siftline-")
    return _OWN[app]


@atexit.register
def _clean() -> None:
    """Drops scratch tables when the driver's process ends: until then results may still be read from them."""
    for top, spark in _MADE.items():
        try:
            _drop(spark, top)
        except Exception:  # noqa: S112  the JVM is gone; what is left stays in the shared folder
            continue
    for path in _OWN.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables that cut lineage. They live in the shared folder, so a lost executor loses none of them, until the driver's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.n = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _MADE[self.top] = spark

    def save(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame) -> DataFrame:
        return self.save(df)[0]

    def drop(self, path: str) -> None:
        _drop(self.spark, path)


def materialized(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows, written once and read back, for results that several later steps read."""
    return Scratch(df.sparkSession, name).table(df)
