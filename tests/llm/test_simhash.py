import numpy as np
import pytest
import xxhash

from siftline.llm import simhash
from siftline.llm.common import Scratch, components, forest


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, prints, strict=True):
            for j, b in zip(ids, prints, strict=True):
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints(odd):
    rows = odd.collect()
    got = simhash.fingerprints(odd).collect()
    assert sorted((r["fp"] & (2**64 - 1)) for r in got) == sorted(plain_fingerprint(r["text"]) for r in rows)


def test_pieces_make_no_difference(monkeypatch):
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 37)
    monkeypatch.setattr(simhash, "CHUNK", 11)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("salted", [False, True])
def test_links_match_brute_force(spark, monkeypatch, salted):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = []
    for b in base:
        prints.append(int(b))
        for _ in range(int(rng.integers(0, 6))):
            x = prints[-1]
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    center = int(base[0])
    for i in range(90):  # a group larger than the pairwise limit
        prints.append(center ^ (1 << i % 40) ^ (1 << (i * 3 + 1) % 40))
    prints = sorted(set(prints))
    if salted:
        monkeypatch.setattr(simhash, "BUCKET", 16)
        monkeypatch.setattr(simhash, "SAMPLE", 2)
    reps = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "rep long, fp long")
    found = {r[0]: r[1] for r in components(simhash.links(reps), Scratch(spark, "t")).collect()}
    assert {i: found.get(i, i) for i in range(len(prints))} == plain_components(range(len(prints)), prints)


def test_large_bucket_keeps_every_component():
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    prints = np.unique(np.concatenate([seeds, *(seeds ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(6))]))
    first = np.bitwise_count(prints ^ simhash.REFERENCES[0]).astype(np.int16)
    order = np.argsort(first, kind="stable")
    x, y = simhash._spread(prints[order], first[order])
    assert (np.bitwise_count(prints[order][x] ^ prints[order][y]) <= simhash.RADIUS).all()
    label = np.arange(len(prints))
    for _ in range(len(prints)):
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
    got = dict(zip(prints[order].tolist(), label.tolist(), strict=True))
    plain = plain_components(range(len(prints)), [int(p) for p in prints])
    groups = {}
    for i, c in plain.items():
        groups.setdefault(c, set()).add(got[int(prints[i])])
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups) < len(prints)


def test_odd_rows(odd, none, clashing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == 1 and by[3] == 1  # letter case makes no difference
    assert by[4] == by[5] == by[6] == 4  # no words: fingerprint zero, linked
    assert simhash.near_duplicates(none).count() == 0
    assert sorted(simhash.near_duplicates(clashing).collect(), key=str) == sorted(got, key=str)


def test_one_of_each_group_stays(odd, none):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 7, 8, 9, 10]
    assert ids.count(None) == 1  # the one whose text no other row has
    assert simhash.deduplicated(none).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    """Groups are of rows: an id that stands for two texts is in two groups, and none loses its only member."""
    rng = np.random.default_rng(3)
    text = [" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(40)) for _ in range(5)]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (3, text[1]), (4, text[2]), (4, text[2]), (None, text[2]), (None, text[3]), (None, text[3]), (None, text[4]), (5, text[4]), (0, text[3] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((-1 if r[0] is None else r[0]), text.index(r[1]) if r[1] in text else -1) for r in simhash.deduplicated(docs).collect())
    far = bin(simhash.fingerprint(text[3]) ^ simhash.fingerprint(text[3] + " more")).count("1") > simhash.RADIUS
    assert got == sorted([(1, 0), (2, 1), (4, 2), (5, 4), (0, -1), *([(-1, 3)] if far else [])])


def test_forest_connects_and_bounds_degree():
    a = np.array([5, 5, 5, 9] + [100] * 500)
    b = np.array([6, 7, 8, 10, *range(101, 601)])
    x, y = forest(a, b)
    assert len(x) == 3 + 1 + 500
    assert max(np.bincount(np.r_[x, y])) <= 17


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000)], "a long, b long")
    got = {r[0]: r[1] for r in components(chain, Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[2000] == 1000


def test_query_against_sql(spark, tmp_path):
    """Words of all lengths, so that all ways through the hash are taken; copies and near copies."""
    import duckdb

    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdEFG1é€😀"), rng.integers(1, 30)))
    texts = [" \n".join(word() for _ in range(rng.integers(1, 60))) for _ in range(60)] + ["", None, " \t ", "one", "one two three", "ONE two three"]
    texts += texts[:10] + [t + " more" for t in texts[10:30]] + ["A " * 50, "a " * 60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(simhash.OP5_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = simhash.op5_simhash_dedup(spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns].to_numpy() == want.to_numpy()).all() and (~got.kept).sum() > 10
