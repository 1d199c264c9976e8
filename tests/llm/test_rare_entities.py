import math
import random

import regex

from siftline.llm import pii
from test_pii import brute


def rows():
    out = [(1, "Marlowen wants you to write to m.quill@example.com before the market opens"), (2, "ask at m.quill@example.com whether Marlowen found any of those letters")]
    name = lambda i, c: c * 3 + chr(97 + i % 26) + chr(97 + i // 26) * 2
    out += [(600 + i, f"{name(i, 'x')} {name(i, 'y')} lone{i}@example.com {name(i, 'z')}") for i in range(30)]
    out += [(4, "copied passage about Ostrander and o.wick@example.com here"), (5, "copied passage about Ostrander and o.wick@example.com here")]
    return out + [(10 + i, f"nothing private number{i} to write about before the market opens") for i in range(400)]


def terms(spark, docs):
    _, spans = pii.find(spark.createDataFrame(docs, "doc_id long, text string"))
    text = dict(docs)
    return set() if spans is None else {(r["doc_id"], text[r["doc_id"]][x.s : x.e]) for r in spans.collect() for x in r["terms"]}


def test_entity_of_two_documents(spark):
    """A name beside its owner's two mails is a term; words beside one mail, and copies of one passage, are not more than chance."""
    assert terms(spark, rows()) == {(1, "Marlowen"), (2, "Marlowen")}


def test_repeated_rows_count_alike(spark):
    """A row that repeats is as many documents beside the entity as among those that hold the term."""
    again = rows()[:1] * 6 + rows()[1:]
    assert terms(spark, again) == {(1, "Marlowen"), (2, "Marlowen")}


def plain_terms(docs):
    """Terms that disclose an entity, counted one by one. docs: texts."""
    pairs, own, held = {}, {}, {}
    for row, text in enumerate(docs):
        text = text or ""
        for term in set(regex.findall(r"\p{L}{4,}", text.lower())):
            held[term] = held.get(term, 0) + 1
        entities = set()
        for kind, s, e in brute(text):
            value = text[s:e].lower()
            entity = kind + ":" + (regex.sub("[^0-9]", "", value) if kind in ("card", "phone") else value)
            words = [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"\p{L}{4,}", text)]
            left = [w for a, b, w in words if b <= s and a >= s - pii.AROUND][-pii.NEAR :]
            right = [w for a, b, w in words if a >= e and b <= e + pii.AROUND][: pii.NEAR]
            context = tuple(dict.fromkeys(left + right))
            if context:
                entities.add(entity)
            for term in context:
                contexts, together = pairs.setdefault((term, entity), (set(), set()))
                contexts.add(context)
                together.add(row)
        for x in entities:
            own[x] = own.get(x, 0) + 1
    least, out = pii.BITS + math.log2(max(len(pairs), 1)), set()
    for (term, entity), (contexts, together) in pairs.items():
        k, share, p = min(len(contexts), len(together)), len(together) / held[term], own[entity] / len(docs)
        rest = (1 - share) * math.log2((1 - share) / max(1 - p, 1e-12)) if share < 1 else 0.0
        if share >= pii.SHARE and math.log2(share / p) >= pii.BITS and k / share * (share * math.log2(share / p) + rest) >= least:
            out.add(term)
    return out


def disclosing_corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 7)))
    common = [word() for _ in range(150)]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.9 else word() for _ in range(n))
    docs = [prose(rng.randint(0, 120)) for _ in range(700)] + [None, ""]
    for k in range(25):
        entity, name = (f"user{k}@example.com" if k % 2 else f"+4930{k:02d}4567890", "".join(rng.choices("klmnopqrst", k=8)))
        for _ in range(rng.randint(1, 6)):
            docs.append(f"{prose(rng.randint(0, 60))} {name if rng.random() < 0.9 else ''} {prose(rng.randint(0, 9))} {entity}, {prose(rng.randint(0, 60))}")
        docs += [f"{prose(5)} {name} {prose(5)}"] * rng.randint(0, 3)
    return [*docs, "4111 1111 1111 1111 at 10.0.0.1, 10.0.0.256 and 010.1.1.001 or 4111 1111 1111 1112", "é +1 (555) 123-4567 a.b@c-d.co.uk x@y"]


def test_terms_against_plain_counts(spark):
    docs = disclosing_corpus()
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    _, spans = pii.find(rows)
    got = {docs[r["doc_id"]][x.s : x.e].lower() for r in spans.collect() for x in r["terms"]}
    assert got == plain_terms(docs) and len(got) > 8


def test_query_against_sql(spark, tmp_path):
    import duckdb

    docs = disclosing_corpus()
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(pii.OP9_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = pii.op9_pii(spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and (got[want.columns].to_numpy() == want.to_numpy()).all() and got.n_term.sum() > 20


def test_words_cut_by_the_window_do_not_count(spark):
    from pyspark.sql import functions as F

    text = "Wolkenbruch " + "x. " * 78 + "me@example.com" + " y." * 78 + " Abendrot"
    rows = spark.createDataFrame([(0, text)], "row long, t string").withColumn("base", pii.base_spans(F.col("t")))
    assert pii._contexts(rows).count() == 0
    near = text.replace("x. ", "", 2).replace(" y.", "", 2)
    rows = spark.createDataFrame([(0, near)], "row long, t string").withColumn("base", pii.base_spans(F.col("t")))
    assert {r["term"] for r in pii._contexts(rows).collect()} == {"wolkenbruch", "abendrot"}
