"""SimHash near-duplicates by pivot distance tables.

Fingerprints are 64 bits over word shingles. Two rules hold together:

* Pigeonhole: ``RADIUS`` differing bits touch at most RADIUS of BLOCKS blocks, so two linked
  fingerprints agree on some BLOCKS - RADIUS blocks. Each such set of blocks is one table; rows that
  agree on it meet in one bucket.
* Pivots: a bucket's rows get a table of Hamming distances to PIVOTS reference fingerprints (made where
  they meet, as that costs less than to shuffle it). By the triangle inequality a pair whose distances to
  any pivot differ by more than RADIUS cannot be linked. A bucket is sorted by the first pivot's distance,
  which bounds a window; the other pivots discard most of what is left; survivors are verified by their
  own Hamming distance. No link is lost.

Equal fingerprints are one row throughout. A bucket that a sample shows to be large is cut into salted
sub-blocks, each pair of which is a task of its own, so that its size bounds no task. What leaves a bucket
is a tree of links, never all its pairs.

Defined results: null text is empty text; no words give fingerprint zero, linked like any other; repeated
rows and ties share a component; an empty table gives an empty result; other columns are ignored. Rows with a
null id link like any other; a component in which no row has an id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import Scratch, components, forest, runs
from siftline.sources.reading import table

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Bits of each block; RADIUS bits leave two of six untouched, which makes 15 tables of 20 to 22 bits.
BLOCKS = (11, 11, 11, 11, 10, 10)
PIVOTS = 32
#: Rows of a bucket that one task takes; larger ones are salted. One row in SAMPLE is looked at to find them.
BUCKET = 8192
SAMPLE = 32
#: Bytes of text taken at once, and shingles whose bits are counted at once.
PIECE = 4 << 20
CHUNK = 1 << 15
REFERENCES = np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, a piece at a time."""
    if len(text) <= PIECE:
        yield text.lower().split()
        return
    rest = b""
    for i in range(0, len(text), PIECE):
        piece = rest + text[i : i + PIECE].lower()
        words = piece.split()
        rest = words.pop() if words and not piece[-1:].isspace() else b""
        yield words
    if rest:
        yield [rest]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64, repeats included; one shingle if there are fewer words; 0 if none."""
    digest, counts, n, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []

    def count(hashes: list[int]) -> None:
        bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        np.add(counts, bits.sum(0, dtype=np.int32), out=counts)

    for words in _words((text or "").encode("utf-8", "replace")):
        tail += words
        if len(tail) >= size:
            for i in range(0, len(tail) - size + 1, CHUNK):
                part = tail[i : i + CHUNK + size - 1]
                hashes = [digest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(size)), strict=False)]
                count(hashes)
                n += len(hashes)
            tail = tail[len(tail) - size + 1 :]
    if not n:
        if not tail:
            return 0
        count([digest(b" ".join(tail), SEED)])
        n = 1
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def text_key() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, k, fp) of all documents; fp is the unsigned fingerprint's 64 bits as a long, k tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), size) for x in b.column(2)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "k", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("k"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, k long, fp long")


def _keys() -> list:
    """A column for each table: its number and the bits of its blocks."""
    at = np.cumsum((0, *BLOCKS))
    part = [F.shiftrightunsigned("fp", int(at[i])).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1)) for i in range(len(BLOCKS))]
    return [
        F.lit(t << 40) + F.shiftleft(part[i], BLOCKS[j]) + part[j]
        for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))
    ]


def _pairs(fp: np.ndarray, key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs among rows sorted by key, then by distance to the first pivot."""
    table = np.bitwise_count(fp[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    left, right = [], []
    live = np.arange(len(fp))
    for step in range(1, len(fp)):
        live = live[live + step < len(fp)]
        live = live[(key[live + step] == key[live]) & (first[live + step] - first[live] <= RADIUS)]
        if not len(live):
            break
        near = live
        for k in range(0, PIVOTS, 8):
            near = near[np.abs(table[near, k : k + 8] - table[near + step, k : k + 8]).max(1, initial=0) <= RADIUS]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= RADIUS]
        left.append(near)
        right.append(near + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _spread(fp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that is connected within one large bucket, sorted by ``first``: grown from seeds, each row asked once."""
    table = np.stack([np.bitwise_count(fp ^ r).astype(np.int8) for r in REFERENCES])
    left, right = [], []
    rest = np.arange(len(fp))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            ordered = first[rest]
            lo, hi = np.searchsorted(ordered, first[at] - RADIUS), np.searchsorted(ordered, first[at] + RADIUS, "right")
            place = np.arange(lo, hi)
            for own in table[1:]:
                if not len(place):
                    break
                place = place[np.abs(own[rest[place]] - own[at]) <= RADIUS]
            place = place[np.bitwise_count(fp[rest[place]] ^ fp[at]) <= RADIUS]
            if len(place):
                got = rest[place]
                rest = np.delete(rest, place)
                left.append(np.full(len(got), at))
                right.append(got)
                front.extend(got)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["key", "i", "j"]):
        fp, rep = t["fp"].to_numpy().view(np.uint64), t["rep"].to_numpy()
        first = t["first"].to_numpy().astype(np.int16)
        key, i, j = (t[k].to_numpy() for k in ("key", "i", "j"))
        change = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        group = np.cumsum(change) - 1
        size = np.bincount(group)[group]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        some = np.flatnonzero((size > 1) & (size <= 64))
        if len(some):
            x, y = _pairs(fp[some], group[some], first[some])
            a.append(rep[some][x])
            b.append(rep[some][y])
        for g in np.unique(group[size > 64]):
            own = np.flatnonzero(group == g)
            x, y = _spread(fp[own], first[own])
            a.append(rep[own][x])
            b.append(rep[own][y])
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def links(reps: DataFrame) -> DataFrame:
    """(a, b) links that connect the ids of all (rep, fp) whose distinct fingerprints differ by RADIUS bits or fewer."""
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(REFERENCES[:1].view(np.int64)[0])))).cast("tinyint")
    rows = reps.select("rep", "fp", first.alias("first"), F.explode(F.array(*_keys())).alias("key"))
    seen = rows.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).groupBy("key").agg((F.count("*") * SAMPLE).alias("n"))
    large = seen.where(F.col("n") > BUCKET).select("key", F.ceil(F.col("n") / BUCKET * 2).cast("int").alias("k"))
    found = large.count()
    if found:
        rows = rows.join(F.broadcast(large) if found <= 100_000 else large, "key", "left")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("k")).cast("int")
        rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1)))
        rows = rows.select("rep", "fp", "first", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    else:
        rows = rows.select("rep", "fp", "first", "key", F.lit(0).alias("i"), F.lit(0).alias("j"))
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "first", "fp").mapInArrow(_link, "a long, b long")


def _grouped(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """(doc_id, k, fp) of all documents, and (fp, low): the least fingerprint that links reach from each."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, size))
    reps = scratch.table(prints.select("fp").distinct().withColumn("rep", F.col("fp")))
    joined = components(scratch.table(links(reps)), scratch)
    return prints, scratch.table(reps.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "fp").alias("low"))), scratch


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of all documents; component_id is the smallest doc_id that links reach."""
    prints, groups, scratch = _grouped(docs, size)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups, "fp").groupBy("low").agg(F.min("least").alias("component_id"))
    found = scratch.table(groups.join(least, "low").select("fp", "component_id"))
    return prints.join(found, "fp", "left").select("doc_id", "fp", "component_id")


#: Rows up to which a side of a join is broadcast (about 24 bytes each); beyond it Spark shuffles.
BROADCAST = 500_000


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group with its columns: the one of least doc_id (null last), then of least text hash. Of rows equal in both one stays."""
    prints, groups, scratch = _grouped(docs, SHINGLE)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), F.col("k").alias("j")))
    # rows of one fingerprint are many in a group of copies: they are summed up before the groups are joined
    per = prints.groupBy("fp").agg(F.count("*").alias("n"), first.alias("first")).join(groups, "fp").groupBy("low").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    several = groups.join(per.where("n > 1"), "low").select("fp", "first")
    few = lambda rows: F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows
    found = prints.join(few(scratch.table(several)), "fp").select(F.col("doc_id").alias("_i"), F.col("k").alias("_j"), (F.col("doc_id").eqNullSafe(F.col("first.i")) & (F.col("k") == F.col("first.j"))).alias("_keep"))
    found = scratch.table(found.distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_i")) & (text_key() == F.col("_j"))
    out = docs.join(few(found), same, "left_anti")
    again = found.where("_keep")
    if again.isEmpty():
        return out
    return out.unionByName(docs.join(few(again), same, "left_semi").withColumn("_text_key", text_key()).dropDuplicates(["doc_id", "_text_key"]).drop("_text_key"))


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _xxh64(table: str) -> str:
    """SQL of (s, h): XXH64 of the strings s of a table, in numbers of 128 bits cut to 64."""
    cut = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)"
    mul = lambda a, b: cut(f"({a}) * {b}::UHUGEINT")
    add = lambda a, b: cut(f"({a}) + ({b})")
    rot = lambda x, r: f"({cut(f'({x}) * {1 << r}::UHUGEINT')} + ({x}) // {1 << (64 - r)}::UHUGEINT)"
    mix = lambda lane: mul(rot(mul(lane, _P2), 31), _P1)
    number = lambda size, at: "('0x' || " + " || ".join(f"substr(x, ({at}) * 2 + {2 * b + 1}, 2)" for b in range(size - 1, -1, -1)) + ")::UBIGINT::UHUGEINT"
    starts = [(SEED + _P1 + _P2) % 2**64, (SEED + _P2) % 2**64, SEED, (SEED - _P1) % 2**64]
    stripe = lambda k: f"list_reduce(list_transform(range(n // 32), lambda i: l[4 * i + {k + 1}]), lambda a, b: {mul(rot(add('a', mul('b', _P2)), 31), _P1)}, {starts[k]}::UHUGEINT)"
    whole = add(add(rot("v1", 1), rot("v2", 7)), add(rot("v3", 12), rot("v4", 18)))
    return f"""
x0 AS (SELECT DISTINCT s, hex(encode(s)) AS x FROM {table}),
x1 AS (SELECT s, x, (length(x) // 2)::BIGINT AS n FROM x0),
x2 AS (SELECT *, list_transform(range(n // 8), lambda i: {number(8, "8 * i")}) AS l FROM x1),
x3 AS (SELECT *, {", ".join(f"{stripe(k)} AS v{k + 1}" for k in range(4))} FROM x2),
x4 AS (SELECT *, {whole} AS h0 FROM x3),
""" + "".join(f"x{5 + k} AS (SELECT * EXCLUDE h{k}, {add(mul(f'xor(h{k}, {mix(f"v{k + 1}")})', _P1), _P4)} AS h{k + 1} FROM x{4 + k}),\n" for k in range(4)) + f"""
x9 AS (SELECT s, x, n, l, {add(f"CASE WHEN n >= 32 THEN h4 ELSE {SEED + _P5}::UHUGEINT END", "n::UHUGEINT")} AS h FROM x8),
x10 AS (SELECT s, x, n, list_reduce(l[4 * (n // 32) + 1:], lambda h, b: {add(mul(rot(f"xor(h, {mix('b')})", 27), _P1), _P4)}, h) AS h FROM x9),
x11 AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {add(mul(rot(f"xor(h, {mul(number(4, 'n // 8 * 8'), _P1)})", 23), _P2), _P3)} ELSE h END AS h FROM x10),
x12 AS (SELECT s, list_reduce(list_transform(range(n // 4 * 4, n), lambda i: {number(1, "i")}), lambda h, b: {mul(rot(f"xor(h, {mul('b', _P5)})", 11), _P1)}, h) AS h FROM x11),
x13 AS (SELECT s, {mul("xor(h, h // 8589934592::UHUGEINT)", _P2)} AS h FROM x12),
x14 AS (SELECT s, {mul("xor(h, h // 536870912::UHUGEINT)", _P3)} AS h FROM x13),
hashed AS (SELECT s, xor(h, h // 4294967296::UHUGEINT)::UBIGINT AS h FROM x14)"""


#: The same by brute force: all fingerprints compared with all.
OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, greatest(len(w) - {SHINGLE - 1}, 1) AS n, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),{_xxh64("sh")},
bits AS (SELECT doc_id, n, {", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))} FROM sh JOIN hashed USING (s) GROUP BY 1, 2),
fp AS (SELECT w.doc_id, coalesce({" + ".join(f"CASE WHEN b{b} * 2 > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))}, 0::UBIGINT) AS fp FROM w LEFT JOIN bits USING (doc_id)),
one AS (SELECT fp, min(doc_id) AS low FROM fp GROUP BY 1),
link AS (SELECT a.fp AS a, b.fp AS b FROM one a JOIN one b ON a.fp <> b.fp WHERE bit_count(xor(a.fp, b.fp)) <= {RADIUS}),
reach AS (SELECT fp AS a, fp AS b FROM one UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a AS fp, min(one.low) AS component_id FROM reach JOIN one ON one.fp = reach.b GROUP BY 1)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id, doc_id = component_id AS kept FROM fp JOIN low USING (fp)
"""
