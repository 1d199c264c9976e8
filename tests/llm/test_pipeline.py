import corpus_pipeline
from siftline.llm import language, simhash
from tests_llm_plain import fingerprint_of, groups, leaked, spans_of, targets_of


def test_stages_and_run(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "pii", "source_mixing"]
    mixed = corpus_pipeline.run(spark, path).collect()
    got = {r["doc_id"]: r for r in mixed}
    # the same by plain means, but for the language model's own answers
    told = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs)).collect()}
    rows = [r for r in docs.collect() if told[r["doc_id"]]["lang_pred"] != "und" and told[r["doc_id"]]["score"] >= language.LEAST]
    label = groups({r["doc_id"]: fingerprint_of(r["text"]) for r in rows})
    rows = [r for r in rows if label[r["doc_id"]] == r["doc_id"]]
    items = [r["text"] for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(leaked(r["text"], x) for x in items)]
    target = targets_of({r["doc_id"]: (r["source"], len(spans_of(r["text"])[0].split())) for r in rows})
    left = {r["doc_id"]: r for r in rows}
    assert set(got) <= set(left)
    for source, (size, want) in target.items():
        own = [g for g in mixed if g["source"] == source]
        assert abs(sum(g["taken"] for g in own) - want) < 1 + 1e-6 * want
    for g in mixed:
        whole = spans_of(left[g["doc_id"]]["text"])[0]
        assert g["text"] == whole or (g["taken"] < g["size"] and g["text"].split() == whole.split()[: g["taken"]]) or "[TERM]" in g["text"]


def test_each_stage_keeps_columns_and_takes_odd_rows(spark, odd, none, clashing):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none, clashing):
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns[: len(docs.columns)] == docs.columns
            assert out.count() <= docs.count() * (3 if name == "source_mixing" else 1)
            if name != "source_mixing":
                assert out.columns == docs.columns


def test_fingerprints_agree(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    assert all(simhash.fingerprint(r[0]) == fingerprint_of(r[0]) for r in rows)
