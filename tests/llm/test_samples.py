import pytest
from pyspark.sql import functions as F

from siftline.llm.common import least_hashed


@pytest.mark.parametrize("k", [1, 7, 200, 5000])
def test_least_hashed(spark, k):
    """The k rows of least hash of each value, for values of few rows and many, with repeated and negative keys."""
    rows = spark.range(6000).selectExpr("id % 1500 - 700 AS key", "CASE WHEN id % 97 = 0 THEN 'few' WHEN id % 3 = 0 THEN 'some' ELSE 'many' END AS label")
    got, hashes = {}, {}
    for r in least_hashed(rows, "label", "key", k).collect():
        got.setdefault(r["label"], []).append(r["_o"])
        assert set(r.asDict()) == {"key", "label", "_o"}
    for r in rows.withColumn("o", F.xxhash64("key")).collect():
        hashes.setdefault(r["label"], []).append(r["o"])
    assert {x: sorted(v) for x, v in got.items()} == {x: sorted(v)[:k] for x, v in hashes.items()}
    assert least_hashed(rows.where("false"), "label", "key", k).count() == 0
