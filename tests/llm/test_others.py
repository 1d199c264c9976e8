import numpy as np
import pyarrow as pa

from siftline.llm import quality

def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert np.mean([[b < g for g in good] for b in bad]) > 0.97 and (got.predicted == got.quality).mean() > 0.93


def test_pairwise_learning():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (300, 4)), rng.normal(0, 1, (200, 4))
    good[:, 1] += 2
    w = quality.learn(good, bad, 2000)
    assert w[1] > 1 and abs(w[[0, 2, 3]]).max() < 0.6


def test_quality_of_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 1, "c"), (2, 1, "c"), (7, 0, "c"), (None, 1, "c"), (3, None, "c"), (9, 0, "c"), (9, 0, "c")], "doc_id long, quality int, score string")
    got = quality.score(odd, labels).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert sorted(quality.score(clashing, labels).collect(), key=str) == sorted(quality.score(odd, labels).collect(), key=str)
    assert (quality.score(odd, labels.where("false")).toPandas().score == 0.5).all() and quality.score(none, labels).count() == 0
    assert np.isfinite(quality.features(pa.array(["", " ", "a", "é" * 1000]))).all()
