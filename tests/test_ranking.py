import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.operators import context, lexical, merge, ranking
from siftline.operators.lexical import bm25

CHUNK = "query_id long, query string, text string, source_idx int, source_url string, source_title string, chunk_idx int, pub_date timestamp_ntz, as_of timestamp_ntz"


def plain_select(rel, tokens, source, domain, k, default=3):
    """Written out step by step, all pairs compared."""
    kept = []
    for i in range(len(rel)):
        if not any(tokens[i] and tokens[j] and len(set(tokens[i]) & set(tokens[j])) / max(len(tokens[i]), len(tokens[j])) > 0.85 for j in kept):
            kept.append(i)
    cap, took = 5 if k >= 25 else 4 if k >= 15 else default, []
    for i in kept:
        if sum(source[j] == source[i] for j in took) >= cap:
            continue
        if sum(domain[j] == domain[i] for j in took) >= 3 and took and rel[i] < 0.9 * sum(rel[j] for j in took) / len(took):
            continue
        took.append(i)
        if len(took) >= 2 * k:
            break
    most = min(int(1.5 * k), len(took))
    if len(took) > most:
        chosen, rest = [took[0]], took[1:]
        while len(chosen) < most and rest:
            def value(i):
                like = [len(set(tokens[i]) & set(tokens[j])) / len(set(tokens[i]) | set(tokens[j])) for j in chosen if tokens[i] and tokens[j]]
                return 0.7 * rel[i] - (1 - 0.7) * max([0, *like])
            best = max(rest, key=value)
            chosen.append(best)
            rest.remove(best)
        took = chosen
    return took[:k]


def test_selection(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for q, k in ((1, 8), (2, 4), (3, 16), (4, 30), (5, 8)):
        n = 120 if q != 5 else 1
        rel = sorted((round(rng.random(), 2) for _ in range(n)), reverse=True)
        tokens = [[rng.choice("abcdefghijkl") * 3 for _ in range(rng.choice([0, 3, 6, 9]))] for _ in range(n)]
        source = [rng.randrange(30) for _ in range(n)]
        domain = [f"d{s % 4}.org" for s in source]
        rows += [(q, i + 1, rel[i], source[i], f"https://www.{domain[i]}/x", tokens[i], k) for i in range(n)]
        want[q] = [i + 1 for i in plain_select(rel, tokens, source, domain, k)]
    df = spark.createDataFrame(rows, "query_id long, pos int, relevance double, source_idx int, source_url string, tokens array<string>, k int").repartition(5)
    got = ranking.selected(df, F.col("k")).orderBy("query_id", "sel_pos").collect()
    for q, places in want.items():
        assert [r["pos"] for r in got if r["query_id"] == q] == places


def test_repetitive_copies_survive():
    many, picker = ["aaa", "bbb"] * 5, ranking.Picker()
    for i, x in enumerate([many, many, ["x"], ["x"], [], []]):
        picker.see(i, 1.0, x, len(x))
    assert [p for p, _, _ in picker.taken] == [0, 1, 2, 4, 5]


def test_a_full_picker_needs_no_more_rows(spark):
    """A query of very many chunks: what follows the last pick is not looked at, and the picks are those of the whole."""
    rng = random.Random(9)
    n = 30_000
    tokens = [["t%d" % rng.randrange(400) for _ in range(8)] for _ in range(n)]
    rel, source = sorted((rng.random() for _ in range(n)), reverse=True), [rng.randrange(500) for _ in range(n)]
    rows = [(1, i + 1, rel[i], source[i], f"https://d{source[i] % 50}.org/x", tokens[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "query_id long, pos int, relevance double, source_idx int, source_url string, tokens array<string>")
    got = [r["pos"] for r in ranking.selected(df, 12).orderBy("sel_pos").collect()]
    assert got == [i + 1 for i in plain_select(rel[:300], tokens[:300], source[:300], [f"d{s % 50}.org" for s in source[:300]], 12)]


def test_cross_scores(spark):
    """A model's score ranks the chosen anew where more than top_k are chosen and all have one; it sees no other chunk."""
    rng = random.Random(3)
    rows, want = [], {}
    for q, k, missing in ((1, 4, False), (2, 4, True), (3, 40, False)):
        n = 30
        rel, cross = sorted((round(rng.random(), 3) for _ in range(n)), reverse=True), [round(rng.uniform(-3, 3), 3) for _ in range(n)]
        tokens = [[f"{q}x{i}y{j}" for j in range(5)] for i in range(n)]
        source = [i % 29 for i in range(n)]
        rows += [(q, i + 1, rel[i], source[i], f"https://{i}.org/", tokens[i], k, None if missing and i == 1 else cross[i]) for i in range(n)]
        domain = [f"{i}.org" for i in range(n)]
        chosen = plain_select(rel, tokens, source, domain, k)
        if q == 1:
            most = plain_select(rel, tokens, source, domain, 6)  # 1.5 times 4, of up to 8
            value = {i: 0.6 * rel[i] + 0.4 * cross[i] for i in most}
            chosen = sorted(most, key=lambda i: -value[i])[:4]
        want[q] = [i + 1 for i in chosen]
    df = spark.createDataFrame(rows, "query_id long, pos int, relevance double, source_idx int, source_url string, tokens array<string>, k int, c double").repartition(3)
    got = ranking.selected(df, F.col("k"), cross=F.col("c")).orderBy("query_id", "sel_pos").collect()
    for q, places in want.items():
        assert [r["pos"] for r in got if r["query_id"] == q] == places


def test_bm25_by_hand(spark):
    rows = [(1, "cat cat dog", "cat cat cat"), (1, "cat cat dog", "dog bird"), (1, "cat cat dog", "nothing else"), (2, "the", "cat")]
    got = {r["text"]: r["bm25"] for r in bm25(spark.createDataFrame(rows, "query_id long, query string, text string")).where("query_id = 1").collect()}
    from math import log

    mean, w = (3 + 2 + 2 + 3) / 4, log(5 / 3) + 1
    cat = 2 * w * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 3 / mean))
    dog = w * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / mean))
    assert abs(got["dog bird"] - dog / cat) < 1e-12 and got["cat cat cat"] == 1 and got["nothing else"] == 0


def test_merge_and_news(spark):
    hits = [(1, "bing", 1, "AI news", "https://www.example.com/a", "short"), (1, "ddg", 1, "AI news updated", "https://example.com/a?ref=ddg", "a longer snippet"), (1, "ddg", 2, "новости", "https://example.com/b", "x")]
    df = spark.createDataFrame(hits, "query_id long, engine string, rank int, title string, url string, snippet string")
    got = merge.merged(df, 20, F.lit("en")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["score"], r["engines"], r["url"], r["title"], r["snippet"]) == (2.6, ["bing", "ddg"], "https://www.example.com/a", "AI news updated", "a longer snippet")
    assert df.select(t.is_news(F.lit("latest ai news"))).first()[0]


def test_admission(spark):
    rows = [(1, "a", 1, "T", "https://www.bing.com/x", ""), (1, "a", 2, "", "https://e.org/1", ""), (1, "a", 3, "T", "https://e.org/2?x", ""), (1, "a", 4, "T", "https://e.org/2", ""), (1, "a", 5, "T", "/rel", ""), (1, "a", 6, "T", "http://e.org/2", "")]
    got = merge.admitted(spark.createDataFrame(rows, "query_id long, engine string, rank int, title string, url string, snippet string")).orderBy("rank").collect()
    assert [(r["rank"], r["url"]) for r in got] == [(1, "https://e.org/2?x"), (2, "http://e.org/2")]


def test_answer_span(spark):
    text = "Nothing here. The price of bread is 5 coins today. Bread is good."
    df = spark.createDataFrame([("price of bread", text), ("tell of bread", text), ("price now", "No such thing.")], "q string, x string")
    a = [r[0] for r in df.select(ranking.answer_span(F.col("q"), F.col("x"))).collect()]
    assert a[0]["full_sentence"] == "The price of bread is 5 coins today." and abs(a[0]["score"] - 1.3) < 1e-9 and a[0]["span"] == text and a[1] is None and a[2] is None


def ranked(spark, rows):
    return spark.createDataFrame([(*r, "2024-02-15 12:00:00") for r in rows], "query_id long, query string, text string, source_idx int, source_url string, source_title string, chunk_idx int, relevance double, sel_pos int, pub string, at string").withColumn("pub_date", F.col("pub").cast("timestamp_ntz")).withColumn("as_of", F.col("at").cast("timestamp_ntz"))


def test_ghosts_and_renumbering(spark):
    df = ranked(spark, [(1, "q", "Text A **bold**", 0, "https://a", "Source A", 0, 0.91, 1, None), (1, "q", "Text B", 1, "https://b", "Source B", 0, 0.95, 2, None)])
    seen = F.col("source_url") == "https://a"
    rows = context.surviving(df, seen)
    assert [(r["source_idx"], r["source_no"]) for r in rows.collect()] == [(0, 1)]
    got = context.contexts(df, rows).first()
    assert got["context"] == "[1] Source A\nText A bold\n" and got["source_list"] == "  [1] Source A — https://a"
    assert [r["source_title"] for r in context.ghosts(df, seen).collect()] == ["Source B"]
    assert context.contexts(df, context.surviving(df, F.lit(False))).first()["context"] == context.NO_SOURCES
    assert [r["source_no"] for r in context.surviving(df, None, False).orderBy("source_idx").collect()] == [1, 2]


def test_prompt(spark):
    df = ranked(spark, [(1, "bitcoin rate", "Bitcoin is 50,000 usd", 0, "https://www.example.com/btc", "Bitcoin price overview", 0, 0.9, 1, "2024-02-14 00:00:00")])
    queries = spark.createDataFrame([(1, "bitcoin rate"), (2, "latest news")], "query_id long, query string").withColumn("as_of", F.lit("2024-02-15 12:00:00").cast("timestamp_ntz"))
    got = {r[0]: r[1] for r in context.prompts(queries, df).collect()}
    for part in ("QUESTION: bitcoin rate", "[1] Bitcoin price overview", "https://www.example.com/btc", "## Источники:", "2024-02-15 12:00:00 (Thursday)", "- Unique domains: 1", "- Chunks with explicit dates: 1"):
        assert part in got[1]
    assert context.NO_CHUNKS in got[2] and "- Context chunks: 0" in got[2]


def test_freshness(spark):
    old, new = "2024-01-01 00:00:00", "2024-02-14 00:00:00"
    rows = [(q, query, "t", i, f"u{i}", f"s{i}", 0, 0.9, i, d) for q, query, ds in ((1, "latest news", [old, new, None]), (2, "latest news", [old]), (3, "plain", [old]), (4, "latest news", ["2024-01-15 12:00:01"]), (5, "latest news", ["2024-01-15 12:00:00", None])) for i, d in enumerate(ds)]
    df = ranked(spark, rows)
    got = {r[0]: r[1] for r in context.freshness(context.surviving(df), df.select("query_id", "query", "as_of").distinct()).collect()}
    assert "[1] (Jan 2024, 45 days old)" in got[1] and "from [2], [3]." in got[1] and got[2].startswith(context.ALL_OLD)
    assert got[3] == got[4] == "" and "31 days old" in got[5] and "from [2]." in got[5]


def test_islands_and_confidence(spark):
    rows = [(1, "latest news", f"t{i} 1.5 and 20 %", s, "u", "s", c, r, i, d) for i, (s, c, r, d) in enumerate([(0, 1, 0.9, "2024-02-15 00:00:00"), (0, 3, 0.95, None), (0, 6, 0.5, "2023-12-01 00:00:00"), (1, 6, 0.1, "2024-02-05 00:00:00"), (0, 0, 0.3, None)])]
    out = ranking.confidence(ranking.islands(ranked(spark, rows))).orderBy("island").collect()
    assert [(r["text"].count("\n\n"), r["relevance"]) for r in out] == [(1, 0.95), (0, 0.5), (0, 0.1), (0, 0.3)]
    assert [r["points"] for r in out] == [3 + 1 + 3 + 2 + 1, 2 + 0 + 0 - 2 + 2 + 1, 0 + 1 + 2 + 1 - 1 + 0, 1 + 1 + 2 + 1]
    assert [r["confidence"] for r in out] == ["HIGH", "LOW", "LOW", "MEDIUM"] and out[1]["confidence_note"] == "outdated (76 days old)" and out[2]["confidence_note"] == "dated (10 days old)"


def test_tfidf_reads_tokens_once(spark):
    """A chunk's tokens are read in one place of the plan and dealt by query once; two rows of one key count as one text, as a plain count has it."""
    texts = [(1, 1, "alpha beta beta gamma"), (1, 2, "alpha delta"), (1, 3, ""), (1, 4, "beta beta beta one two"), (1, 5, "alpha zeta"), (1, 5, "alpha beta"), (2, 6, "alpha")]
    rows = spark.createDataFrame([(q, i, {1: "beta alpha", 2: "the"}[q], x) for q, i, x in texts], "query_id long, doc_id long, query string, text string").repartition(2)
    out = lexical.tfidf(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2, plan  # texts and queries
    df = {w: sum(w in x.split() for q, _, x in texts if q == 1) + (w in ("alpha", "beta")) for w in "alpha beta gamma delta one two zeta".split()}
    idf = {w: math.log((7 + 1) / (n + 1)) + 1 for w, n in df.items()}

    def vector(parts):
        v = {}
        for words in parts:
            for w in words:
                v[w] = v.get(w, 0) + idf[w] / len(words)
        return v

    asked = vector([["beta", "alpha"]])
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {6: [0.0]}
    for i in range(1, 6):
        own = [x.split() for q, k, x in texts if q == 1 and k == i]
        v = vector([w for w in own if w])
        want[i] = [sum(v.get(w, 0) * asked[w] for w in asked) / (norm(v) * norm(asked)) if v else 0.0] * len(own)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["similarity"])
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


class _Whole:
    """A column that is read as a whole, not a value at a time."""

    def __init__(self, column):
        self.to_pylist, self.column = column.to_pylist, column

    def __getattr__(self, name):
        if name in ("offsets", "values"):
            return getattr(self.column, name)
        raise AttributeError(name)

    def __getitem__(self, i):
        raise AssertionError("a value at a time")


def test_fold_reads_batches_by_column():
    """Queries that go on in the next batch, sliced columns; the picks are those of a Picker by hand."""
    rnd = random.Random(5)
    rows = [(q, i, round(rnd.random(), 4), [rnd.randrange(9) for _ in range(rnd.randrange(1, 7))], 6, rnd.randrange(4), rnd.choice("ab"), 8) for q in range(4) for i in range(1, 30)]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.string(), pa.int32()]
    columns = [pa.array([(7, 7, 0.7, [7], 7, 7, "7", 7)[n]] + [r[n] for r in rows], k) for n, k in enumerate(kinds)]

    class Batch:
        num_columns = len(kinds)

        def __init__(self, at, n):
            self.own = [_Whole(c.slice(1 + at, n)) for c in columns]

        def column(self, n):
            return self.own[n]

    got = [tuple(x.values()) for b in ranking._fold((Batch(at, 25) for at in range(0, len(rows), 25)), "all", 3) for x in b.to_pylist()]
    want = []
    for q in range(4):
        picker = ranking.Picker(ranking.per_source_cap(8, 3), 16)
        for r in rows:
            if r[0] == q and not picker.full:
                picker.see(*r[1:7])
        want += [(q, p, k) for k, (p, _) in enumerate(picker.diverse(min(12, len(picker.taken))), 1)]
    assert got == want
