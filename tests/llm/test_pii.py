import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import pii
from siftline.llm.spans import replaced


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text or ""):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text or ""):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text or ""):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text or ""):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


CASES = [
    "a@b.c%d@e.f x@y 1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111+1 (555) 123-4567x +12345678 ", "é😀 a.b@c-d.co.uk 😀 10.0.0.1", "1 2 3 4 5 6 7 8 9 0 " * 200, "4" * 5000, "a" * 50000 + "@b.c",
    "a.b@c@d.e..f@g.h-i.j_k@l.m", "+1.2.3.4-5+6 7(8)9 0 1 2 3 4", None, "", "1.1.1.1 2.2.2.2", "@@@ +++ ...", "x@y.z@w.v", "0.0.0.0 00.000.0.0", "a@b.c " * 3000,
]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect()
    return {r[0]: [(x.kind, x.s, x.e) for x in r[1]] for r in rows}


def test_base_spans(spark):
    got = found(spark, CASES)
    for i, text in enumerate(CASES):
        assert got[i] == brute(text), repr(text)[:60]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a@.+- ()0123459é", max_size=60), min_size=40, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    got = found(spark, texts)
    assert all(got[i] == brute(t) for i, t in enumerate(texts))


def test_query_digest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in pii.op9_pii(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(r["text"]))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert got[r["doc_id"]]["spans"].startswith(base)


def disclosing_docs():
    around = ["alpha one", "beta two", "gamma three", "delta four"]
    rows = [(i, f"{w} zanzibar write to joe@example.com about {w}") for i, w in enumerate(around)]
    rows += [(10 + i, f"nothing private number{i} here to write about") for i in range(200)]
    rows += [(900, "Zanzibar again with joe@example.com nearby"), (901, "a lone zanzibar without the other")]
    return rows


def test_disclosing_terms(spark):
    docs = spark.createDataFrame(disclosing_docs(), "doc_id long, text string")
    rows, spans = pii.find(docs)
    hit = {r["doc_id"]: [(x.s, x.e) for x in r["terms"]] for r in spans.collect()}
    assert set(hit) == {0, 1, 2, 3, 900, 901}
    assert hit[900] == [(0, 8)] and hit[901] == [(7, 15)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[901] == "a lone [TERM] without the other"
    assert clean[900] == "[TERM] again with [EMAIL] nearby"
    assert clean[10] == "nothing private number0 here to write about"


def test_replaced_overlaps(spark):
    df = spark.createDataFrame([("0123456789",)], "t string")
    spans = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("s"), F.lit(e).alias("e")) for k, s, e in (("b", 3, 6), ("a", 2, 5), ("c", 8, 10))))
    assert df.select(replaced(F.col("t"), spans)).first()[0] == "01[A]67[C]"


def test_odd_rows(odd, none, clashing):
    assert pii.find(odd)[0].count() == odd.count()
    assert pii.sanitise(none).count() == 0 and pii.find(none)[0].count() == 0
    out = pii.sanitise(clashing)
    assert out.columns == clashing.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, clashing.collect()))  # nothing private there


@pytest.mark.parametrize("n", [5000])
def test_many_matches_in_one_text(spark, n):
    got = found(spark, ["é a@b.cd," * n])[0]
    assert len(got) == n and got[-1] == ("email", 9 * n - 7, 9 * n - 1)
