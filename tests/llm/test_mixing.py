import duckdb
import pytest

from siftline.llm import mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        left = total - sum(full.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: 3 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return full | share
        full |= over


def test_targets_and_words(odd):
    got = mixing.mix(odd).toPandas()
    docs = odd.toPandas()
    docs["size"] = [len((t or "").encode().split()) for t in docs.text]
    sizes = {(None if s != s or s is None else s): 0 for s in docs.source}
    for s, n in zip(docs.source, docs["size"], strict=True):
        sizes[None if s != s or s is None else s] += n
    target = plain_targets(sizes)
    assert len(got) == len(docs) and (got.taken <= 3 * got["size"]).all()
    for (size, t), part in got.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - t) < 1 and any(abs(t - x) < 1e-6 for x in target.values())
    assert sorted(got["size"]) == sorted(docs["size"])


def test_empty_and_clashing(odd, none, clashing):
    assert mixing.mix(none).count() == 0
    assert sorted(mixing.mix(clashing).collect(), key=str) == sorted(mixing.mix(odd).collect(), key=str)


def plain_mix(docs):
    """Words taken of each document: services one by one in order of virtual finish time until the budget is used up. docs: (id, source, size) in queue order."""
    sizes, weights = {}, {}
    for _, source, size in docs:
        sizes[source] = sizes.get(source, 0) + size
    target = plain_targets(sizes)
    for k, s in enumerate(sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)):
        weights[s] = (5, 2, 1)[k % 3]
    services, end = [], dict.fromkeys(sizes, 0)
    for _ in range(3):
        for i, source, size in docs:
            for w in range(size):  # a word at a time: a service may be cut anywhere
                end[source] += 1
                services.append((end[source] / weights[source], i))
    budget = sum(int(t + 1e-9) for t in target.values())
    taken = dict.fromkeys((i for i, _, _ in docs), 0)
    for _, i in sorted(services)[:budget]:
        taken[i] += 1
    return taken


def test_virtual_time_word_by_word(spark):
    import hashlib
    import random

    rng = random.Random(1)
    docs = [(i, rng.choice(["a", "b", "b", "b", "c", "d", None]), rng.choice([0, 1, 3, 8, 20, 90])) for i in range(150)]
    rows = spark.createDataFrame([(i, s, "w " * n) for i, s, n in docs], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(rows).collect()}
    want = plain_mix(sorted(docs, key=lambda d: hashlib.md5(f"{d[0]}:mix".encode()).hexdigest()))
    # words of several sources may finish at the same time where the budget ends
    assert sum(abs(got[i] - want[i]) for i in got) <= 8 and sum(got.values()) == sum(want.values())


def test_reruns(odd):
    a, b = (sorted(mixing.mix(odd).collect(), key=str) for _ in range(2))
    assert a == b and sorted(mixing.mixed(odd).collect(), key=str) == sorted(mixing.mixed(odd).collect(), key=str)


def test_budget(odd):
    got = mixing.mix(odd, budget=100).toPandas()
    assert 95 <= got.taken.sum() <= 100


@pytest.mark.parametrize("bucket", [4096, 3])
def test_sql(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    want = con.execute(mixing.OP2_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.op2_source_mixing(spark, path).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns].to_numpy() == want.to_numpy()).all()


def test_mixed_emits_the_words(spark, odd, none, clashing):
    out = mixing.mixed(odd)
    assert out.columns == [*odd.columns, "size", "target", "taken", "finish"]
    assert out.where("taken = 0").count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixed(clashing).columns == clashing.columns and mixing.mixed(clashing).count() == out.count()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mix(docs).toPandas().set_index("doc_id")
    rows = mixing.mixed(docs).toPandas()
    words = rows.text.map(lambda t: len(t.split()))
    assert (words == rows.taken).all() and (rows.n_chars[words < rows["size"]] == rows.text.str.len()[words < rows["size"]]).all()
    assert (rows.groupby("doc_id").taken.sum() == plan.taken[plan.taken > 0].sort_index()).all() and (rows.groupby("source").taken.sum() == rows.groupby("source").target.max() // 1).all()
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(whole[r.doc_id].startswith(r.text) for r in rows.itertuples()) and rows.groupby("doc_id").size().max() <= 3
    assert (rows.taken == rows["size"]).mean() > 0.9


def test_totals_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 3)
    rows = spark.range(40).selectExpr("id % 2 g", "id at", "id * id v")
    got = {(r["g"], r["at"]): r["before"] for r in mixing._before(rows, "at", "v", "g").collect()}
    assert got == {(i % 2, i): sum(j * j for j in range(i) if j % 2 == i % 2) for i in range(40)}
