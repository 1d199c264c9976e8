import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import quality


def plain_learn(good, bad):
    """Newton's method on all pairs, written out."""
    x = np.concatenate([good, bad])
    scale = np.maximum(x.std(0), 1e-6)
    d = ((good[:, None] - bad[None]) / scale).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(d @ w)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.DECAY * np.eye(len(w)), d.T @ (p - 1) / len(d) + quality.DECAY * w)
        w = w - step / max(1.0, np.abs(step).max())
    return w / scale


def test_derivatives_of_all_pairs():
    """Scores near and far, above and below: as for pairs one by one."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.5, 1, (90, 3)), rng.normal(0, 1, (70, 3))
    for spread in (0.0, 1.0, 30.0, 400.0):
        s, t = spread * rng.normal(size=90), spread * rng.normal(size=70)
        sums = {}, {}
        quality.add(sums[0], good[:50], s[:50])
        quality.add(sums[0], good[50:], s[50:])
        quality.add(sums[1], bad, t)
        grad, curve = quality.derivatives(*sums, 3)
        d = good[:, None] - bad[None]
        p = np.exp(-np.logaddexp(0, s[:, None] - t))
        assert np.abs(grad + (d * p[:, :, None]).mean((0, 1))).max() < 1e-12
        assert np.abs(curve - np.einsum("gb,gbi,gbj->ij", p * (1 - p), d, d) / p.size).max() < 1e-12


def test_scores_learn_from_all_pairs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    told = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    x = quality.features(pa.array([t for _, t in rows]))
    label = np.array([told.get(i, -1) for i, _ in rows])
    w = plain_learn(x[label == 1], x[label == 0])
    s = np.sort(x[label >= 0] @ w)
    bad = int((label == 0).sum())
    want = 1 / (1 + np.exp(-(x @ w - s[bad - 1 : bad + 1].mean() + np.log(quality.CUT / (1 - quality.CUT)))))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    assert np.abs(np.array([got[i] for i, _ in rows]) - want).max() < 1e-8


def test_scores_learn_from_every_label(spark):
    """More labelled documents than a sample of 6,000 a label: some 10,000 bad ones and 240 good ones all count."""
    texts = [(i, f"{'!' * (i % 7)} {'word ' * (i % 11)}{'Text' if i % 13 else 'TEXT 1'}", int(i % 44 == 0)) for i in range(13_300)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, quality int")
    own = np.array([zlib.crc32(str(t[0]).encode()) % 5 != 0 for t in texts])
    x, label = quality.features(pa.array([t[1] for t in texts])), np.array([t[2] for t in texts])
    w = quality.learn(x[own & (label == 1)], x[own & (label == 0)])
    s = np.sort(x[own] @ w)
    bad = int((label[own] == 0).sum())
    want = 1 / (1 + np.exp(-(x @ w - s[bad - 1 : bad + 1].mean() + np.log(quality.CUT / (1 - quality.CUT)))))
    got = dict(quality.score(docs, labels).select("doc_id", "score").collect())
    assert np.abs(np.array([got[t[0]] for t in texts]) - want).max() < 1e-8


@pytest.mark.parametrize("values", [[0.5, 0.25], [1.0, 1.0, 1.0, 2.0], [-7.5, 3.0, 3.0, 3.0, 1e9, 3.0000000000000004], [float(i * i % 997) / 7 for i in range(5000)]])
def test_middle(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "s double")
    s = sorted(values)
    for k in {1, len(s) // 3 or 1, len(s) // 2, len(s) - 1}:
        assert quality.middle(rows, k) == (s[k - 1] + s[k]) / 2
