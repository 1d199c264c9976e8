import random
from collections import Counter

import duckdb

from siftline.llm import decontamination as d


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 60)))) for i in range(30)] + [(30, "one two three"), (31, ""), (32, None), (33, "same same same same same same same same same")]
    docs = []
    for i in range(200):
        words = [word() for _ in range(rng.randint(0, 300))]
        if i % 4 == 0 and i // 4 < 34:
            part = (items[i // 4][1] or "").split()
            kind = i // 4 % 4
            if kind == 1 and len(part) > 30:
                part[0] = "other"
            if kind == 2 and len(part) > 40:
                part.insert(len(part) - 1, "more")
            if kind == 3 and len(part) > 20:
                part = part[: len(part) // 2]  # half of an item is no leak
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if kind == 0 else w for w in part]
        docs.append((i, " \n ".join(words)))
    return docs, items


def edited(n=400):
    """Items of a common template, a unique part in their middle, planted with one to four words changed, inserted or deleted."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    head, foot = [word() for _ in range(30)], [word() for _ in range(30)]
    items = [(i, " ".join([*head[: rng.randint(10, 30)], *(word() for _ in range(rng.randint(10, 60))), *foot[: rng.randint(10, 30)]])) for i in range(40)]
    docs = []
    for i in range(n):
        part = items[i % 40][1].split()
        for _ in range(rng.randint(1, 4)):
            at, kind = rng.randrange(len(part)), rng.randrange(3)
            part[at : at + (kind != 1)] = [word()] if kind != 2 else []
        around = [word() for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(around))
        docs.append((i, " ".join([*around[:at], *part, *around[at:]])))
    return docs, items


def plain(docs, items):
    """All windows of all documents, compared shingle by shingle."""
    out = {}
    for j, item in items:
        b = (item or "").lower().split()
        size = min(5, len(b))
        if not size:
            continue
        theirs = Counter(tuple(b[q : q + size]) for q in range(len(b) - size + 1))
        m = len(b) - size + 1
        for i, text in docs:
            a = (text or "").lower().split()
            own = [tuple(a[p : p + size]) for p in range(len(a) - size + 1)]
            if sum(x in theirs for x in own) < 0.8 * m:
                continue
            w = min(m, len(own))
            for s in range(len(own) - w + 1):
                shared = sum((Counter(own[s : s + w]) & theirs).values())
                value = shared / (m + w - shared)
                if value >= 0.8 - 1e-12 and value > out.get((i, j), (0, 0))[1]:
                    out[i, j] = (s, value)
    return {k: (s, round(v, 9)) for k, (s, v) in out.items()}


def results(spark, docs, items):
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 9)) for r in d.leaks(a, b).collect()}
    con = duckdb.connect()
    con.register("docs_", a.toPandas())
    con.register("items_", b.toPandas())
    con.execute("create view documents as select * from docs_")
    con.execute("create view benchmark as select * from items_")
    return got, {(r[0], r[1]): (r[2], round(r[3], 9)) for r in con.execute(d.OP8_SQL).fetchall()}


def test_against_all_windows(spark):
    docs, items = corpus()
    got, sql = results(spark, docs, items)
    assert got == sql == plain(docs, items) and len(got) > 15 and (120, 30) in got


def test_edited_items(spark):
    docs, items = edited()
    got, sql = results(spark, docs, items)
    want = plain(docs, items)
    assert got == want and sql == want and len(want) > 100


def test_index_proposes_all_within_radius(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    pairs = []
    for _ in range(500):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, d.RADIUS)))))
    rows = spark.createDataFrame([tuple(x - (1 << 64) if x >> 63 else x for x in p) for p in pairs], "a long, b long")
    met = rows.select(F.array_intersect(d._blocks_of("a", 0), d._blocks_of("b", d.FLIPS)).alias("x"))
    assert met.where("size(x) = 0").count() == 0


def test_odd_rows(spark, odd, none, clashing):
    items = spark.createDataFrame([(1, " ".join(f"word{i} and" for i in range(20)), "z"), (1, None, "z"), (None, "quick brown fox jumps over the lazy dog while", "z"), (2, "", "z")], "item_id long, text string, fp string")
    got = d.leaks(odd, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(7, 1), (1, None), (2, None), (3, None), (None, None)}
    left = d.clean(clashing, items)
    assert left.columns == clashing.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["4", "5", "6", "None", "8", "9", "10"])
    assert d.leaks(none, items).count() == 0 and d.leaks(odd, items.where("false")).count() == 0
    assert d.clean(odd, items.where("false")).count() == odd.count()
