from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.functions.chunking import by_size
from siftline.operators import quality
from siftline.plans import queries

SENTENCE = "In the year {0} the council of the city met {0} people and wrote a long report about the harbour and its ships. "


def plain(spark, text):
    """Good chunks of the whole text, each judged by itself."""
    parts = spark.createDataFrame(list(enumerate(by_size(text))), "n int, part string").withColumn("part", t.without_garbage("part"))
    rows = parts.where((F.length("part") >= 50) & ~t.is_incomplete("part") & ~t.is_low_quality("part")).orderBy("n").collect()
    return [r["part"] for r in rows]


def test_chunk_filter_takes_whole_texts(spark, tmp_path):
    text = "".join(SENTENCE.format(1000 + i) for i in range(400))
    spark.createDataFrame([(1, text), (2, SENTENCE.format(7))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.chunk_filter(spark, str(tmp_path)).where("doc_id = 1").collect(), key=lambda r: r["chunk_idx"])
    want = plain(spark, text)
    assert len(text) > 40_000 and [r["text"] for r in got] == want and "1399" in want[-1]
    cut = quality.chunked(spark.createDataFrame([(text,)], "text string"), limit=12000).collect()
    assert [r["text"] for r in sorted(cut, key=lambda r: r["chunk_idx"])] == plain(spark, text[:12000])


def test_each_chunk_is_judged_once(spark):
    """The plan has no filter that judges all chunks only to learn whether any is left."""
    rows = quality.chunked(spark.createDataFrame([("",)], "text string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cookie policy") == 1


def test_frequent_words(spark):
    """The most frequent word is sought only where it can reach three tenths; on both sides of that and right at it."""
    few = " ".join(f"word{k:03d}" for k in range(14))
    texts = {f"{few} {'often ' * n}".strip(): n > 0.3 * (14 + n) for n in (2, 5, 6, 7, 20)}
    texts[f"{few} {'Often oFten ' * 4}".strip()] = 8 > 0.3 * 22
    got = spark.createDataFrame([(x,) for x in texts], "text string").select("text", t.is_low_quality("text").alias("low")).collect()
    assert {r["text"]: r["low"] for r in got} == texts
