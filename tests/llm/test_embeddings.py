import numpy as np
import pytest

from siftline.llm import embedding_dedup as e


def rows(n=600, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, n // 2):  # half of them stand near another
        x[i] = x[i % 40] + rng.standard_normal(dim) * 0.15
    return x.astype(np.float32)


def brute(x, cosine=0.95):
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            return near.sum(1), label
        label = new


@pytest.mark.parametrize("leaf", [512, 32])
def test_links_and_recall(spark, monkeypatch, leaf):
    x = rows()
    monkeypatch.setattr(e, "LARGE", 64)
    monkeypatch.setattr(e, "BLOCK", 40)
    monkeypatch.setattr(e, "LOOK", 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = e.near_duplicates(df, leaf=leaf).toPandas().sort_values("vec_id")
    n, label = brute(x)
    assert (got.n_links.to_numpy() <= n).all()
    assert got.n_links.sum() >= 0.98 * n.sum() and n.sum() > 500
    if leaf == 512:
        assert (got.n_links.to_numpy() == n).all() and (got.component_id.to_numpy() == label).all()


def test_leaves_keep_their_size_beyond_the_sample():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40_000, 32))
    x[:2000] = x[np.arange(2000) // 2] + rng.standard_normal((2000, 32)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    trees = e.fit(x[rng.choice(len(x), 400, replace=False)], len(x), leaf=64)
    assert all(len(ended) for ended, _ in trees.tails)
    met = np.zeros(1000, bool)
    for t in range(e.TREES):
        row, leaf = trees.leaves(x, t)
        assert len(set(zip(row.tolist(), leaf.tolist(), strict=True))) == len(row) and set(row.tolist()) == set(range(len(x)))
        assert np.bincount(np.unique(leaf, return_inverse=True)[1]).max() < 64 * 40
        own = {}
        for r, c in zip(row[row < 2000].tolist(), leaf[row < 2000].tolist(), strict=True):
            own.setdefault(r, set()).add(c)
        met |= np.array([bool(own[2 * i] & own[2 * i + 1]) for i in range(1000)])
    near = (x[0:2000:2] * x[1:2000:2]).sum(1) >= e.COSINE
    assert near.sum() > 500 and met[near].mean() >= 0.97


def test_recall_beyond_the_sample(spark):
    x = rows(1500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = e.near_duplicates(df, leaf=16, sample=100).toPandas().sort_values("vec_id")
    n, _ = brute(x)
    assert (got.n_links.to_numpy() <= n).all() and got.n_links.sum() >= 0.95 * n.sum()


def test_odd_vectors(spark):
    data = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]),
        (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01, 0.0]), (11, [float("inf"), 1.0]), (12, [0.0, 5.0]),
    ]
    df = spark.createDataFrame([(a, b, "x", 0) for a, b in data], "vec_id long, embedding array<double>, digest string, n int")
    got = sorted(tuple(r)[:3] for r in e.near_duplicates(df).collect() if r["vec_id"] is not None)
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (3, 3, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 1, 9), (10, 1, 9), (11, 0, 11), (12, 0, 12)]
    assert e.near_duplicates(df).count() == len(data)
    assert e.near_duplicates(df.where("false")).count() == 0


def test_query_against_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(12)
    seeds = rng.normal(size=(60, 16))
    near = [s + rng.normal(scale=0.12, size=16) for s in seeds[:30] for _ in range(4)]
    rows = [(i, x.astype(float).tolist()) for i, x in enumerate([*seeds, *near, *seeds[:5]])] + [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None]), (904, [float("nan")] * 16), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(e.OP1_SQL).df().sort_values("vec_id").reset_index(drop=True)
    got = e.op1_embedding_dedup(spark, str(tmp_path)).toPandas().sort_values("vec_id").reset_index(drop=True)
    assert (got[want.columns].to_numpy() == want.to_numpy()).all() and got.n_links.sum() > 100
