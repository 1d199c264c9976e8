import re

import pytest

from siftline.llm import token_rollup


def encoder(version=token_rollup.VERSION):
    return token_rollup.encoding(version, token_rollup.vocabulary(token_rollup.TOKENIZERS, version)).encode_ordinary


@pytest.fixture
def rollup(spark, tmp_path):
    return token_rollup.Rollup(spark, f"file://{tmp_path}/r")


def test_rollup_deltas(spark, rollup, odd, none):
    encode = encoder()
    docs = odd
    want = {}
    for r in docs.collect():
        k = (r["source"], r["lang"])
        n, m = want.get(k, (0, 0))
        want[k] = (n + 1, m + len(encode(r["text"] or "")))
    totals = lambda: {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}
    assert rollup.commit("one", token_rollup.delta(docs)) and totals() == want
    assert not rollup.commit("one", token_rollup.delta(docs)) and totals() == want  # the same batch again
    one = docs.where("doc_id = 1")
    changed = spark.createDataFrame([(1, "a few words", "de", "a", 0)], docs.schema)
    rollup.commit("revised", token_rollup.delta(changed, one))
    n, m = want[("a", "en")]
    now = totals()
    assert now[("a", "en")] == (n - 1, m - len(encode(one.first()["text"]))) and now[("a", "de")] == (1, len(encode("a few words")))
    rollup.commit("deleted", token_rollup.delta(None, changed))
    assert ("a", "de") not in totals()
    assert rollup.commit("nothing", token_rollup.delta(none))
    before = totals()
    rollup.compact()
    assert totals() == before and not rollup.commit("one", token_rollup.delta(docs)) and totals() == before
    rollup.commit("again", token_rollup.delta(changed))
    rollup.compact()
    assert totals()[("a", "de")] == (1, len(encode("a few words")))


def test_parts_keep_tokens(monkeypatch):
    encode = encoder()
    text = "Some words, numbers 12345 and\n\n  signs!! " * 200
    monkeypatch.setattr(token_rollup, "PART", 50)
    assert sum(len(encode(p)) for p in token_rollup.parts(text)) == len(encode(text)) and "".join(token_rollup.parts(text)) == text


def test_interrupted_and_repeated_commits(spark, rollup, odd):
    rows = token_rollup.delta(odd)
    totals = lambda: sorted(rollup.totals().collect(), key=str)
    assert rollup.commit("one", rows)
    want = totals()
    name = rollup._names("live")[0]
    rollup._fs.delete(rollup._path("live", name), False)  # died after the rename
    assert totals() == [] and not rollup.commit("one", rows) and totals() == want
    assert not rollup._put(rows, "batches", name) and rollup._names("batches") == [name]
    # another attempt that looked before the first one's rename
    exists, rollup._fs = rollup._fs, type("Fs", (), {"exists": lambda self, p: False, "__getattr__": lambda self, k: getattr(exists, k)})()
    assert not rollup._put(rows, "batches", name)
    rollup._fs = exists
    assert rollup._names("stage") == [] and totals() == want
    for _ in range(3):
        rollup.compact()
        assert not rollup.commit("one", rows) and totals() == want
    assert len(rollup._names("snapshots")) <= 2


def test_clashing_columns(odd, clashing):
    assert sorted(token_rollup.delta(clashing).collect(), key=str) == sorted(token_rollup.delta(odd).collect(), key=str)


def test_query_against_a_recount(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    bad = {r["doc_id"] for r in spark.read.parquet(f"{path}/labels.parquet").where("quality = 0").collect()}
    want = {}
    for version in (token_rollup.VERSION, token_rollup.OTHER):
        encode = encoder(version)
        for r in docs:
            text = r["text"] or ""
            if version == token_rollup.VERSION:
                if r["doc_id"] in bad:
                    continue
                text = re.sub(r"[ \t-\r]+", " ", text)
            n, m = want.get((r["source"], r["lang"], version), (0, 0))
            want[r["source"], r["lang"], version] = (n + 1, m + len(encode(text)))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in token_rollup.op7_token_rollup(spark, path).collect()}
    assert got == want and bad
