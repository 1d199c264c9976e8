"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

Equal vectors become one row with a count. Each tree splits by random directions, one a level, at a
threshold of each node's own; a row within SPILL of the threshold goes to both sides. Rows are compared within
leaves, first by sketches alone: BITS signs of random projections, of which a linked pair's differ in a tenth or less, so that
FAR, six deviations more, loses none that counts and lets few others pass. Only rows with some row that near go on, now with their vectors, to be
compared in the same leaves by cosine in double precision; what any tree finds is united. A pair that shares several
leaves counts in the first of them alone, so that link counts add up without a list of pairs; a row carries the leaves it went on in.

The trees are fitted on the SAMPLE rows of least hash (a bounded sample, a parameter, shared by all lengths of vectors; a length
of no more than LEAF vectors is one leaf); every row goes through every tree. A node whose sample can't be split without sending over STUCK of it to both sides (a tight cluster)
becomes a leaf. A node with fewer than FEW sampled rows that still stands for many goes on by its own sample's
thresholds alone (its tail), so that leaves keep their size however many rows a sampled one stands for. Leaves that one row
in LOOK shows to be large are cut into salted sub-blocks compared pair by pair, so that no leaf's size bounds a
task. Measured recall stands in the tests and the README.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link; a null vec_id takes no part and comes back with no links and itself as
component; repeated rows count as vectors of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import Scratch, components, forest, runs
from siftline.sources.reading import table

COSINE = 0.95
TREES = 6
LEAF = 512
SAMPLE = 16_384
STUCK = 0.3
#: Sampled rows below which a node gets no thresholds by node any more.
FEW = 32
#: Rows of a leaf from which it is salted, rows of a sub-block, and the share of rows that is looked at to find such leaves.
LARGE, BLOCK, LOOK = 2048, 1024, 16
#: Large leaves up to which their table is broadcast (24 bytes each); beyond it Spark shuffles.
BROADCAST = 100_000
SEED = 7
DEEPEST = 30
BITS = 128


def _far(cosine: float) -> int:
    """Bits in which the sketches of two linked vectors differ at most, six deviations allowed."""
    share = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    return int(np.ceil(BITS * share + 6 * np.sqrt(BITS * share * (1 - share))))


def _sketch(x: np.ndarray) -> np.ndarray:
    """BITS signs of each row's projections, packed."""
    directions = np.random.default_rng(SEED + 1).standard_normal((x.shape[1], BITS)).astype(np.float32)
    return np.packbits(x.astype(np.float32) @ directions > 0, axis=1)


def _clean(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one."""
    x = values.astype(np.float64)
    good = np.isfinite(x).all(1)
    top = np.abs(np.where(good[:, None], x, 0)).max(1, initial=0)
    good &= top > 0
    x = np.where(good[:, None], x, 1) / np.where(good, top, 1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None], good


def _prepare(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(vec_id, digest, vec): vec holds the components as stored, in single precision if they are."""
    for b in batches:
        digests, vectors = [None] * b.num_rows, [None] * b.num_rows
        lists = b.column(1)
        n = np.asarray(lists.value_lengths().fill_null(0))
        for size in np.unique(n[n > 0]):
            at = np.flatnonzero(n == size)
            values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, size)
            _, good = _clean(values)
            for k, row in zip(at[good], values[good], strict=True):
                vectors[k] = row.tobytes()
                digests[k] = hashlib.blake2b(vectors[k], digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "digest", "vec"])


@dataclass
class Trees:
    """Directions (trees, levels, dim) and each node's threshold by tree and level; nan ends a branch.

    tails: of each tree the ended branches that go on, in order, and their thresholds by level; nan passes a level.
    """

    dim: int
    spill: float
    directions: np.ndarray
    thresholds: list[list[np.ndarray]] = field(default_factory=list)
    tails: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all rows in one tree; a row has as many as spill gives it."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, codes = [], []
        ended, tail = self.tails[tree]
        cast = x @ self.directions[tree].T if len(self.thresholds[tree]) or len(ended) else None
        for level, cuts in enumerate([*self.thresholds[tree], None]):
            cut = np.full(len(row), np.nan) if cuts is None else cuts[node]
            done = np.isnan(cut)
            rows.append(row[done])
            codes.append((tree << 50) | (level << 44) | node[done])
            row, node, cut = row[~done], node[~done], cut[~done]
            if not len(row):
                break
            pick, side = self._sides(cast[row, level], cut)
            row, node = row[pick], node[pick] * 2 + side
        row, code = np.concatenate(rows), np.concatenate(codes)
        if not len(ended):
            return row, code
        at = np.searchsorted(ended, code).clip(max=len(ended) - 1)
        on = ended[at] == code
        rows, codes = [row[~on]], [code[~on]]
        row, at = row[on], at[on]
        node = code[on] & ((1 << 44) - 1)
        for level in range(tail.shape[1]):
            cut = tail[at, level]
            rest, some = np.flatnonzero(np.isnan(cut)), np.flatnonzero(~np.isnan(cut))
            if len(some):
                pick, side = self._sides(cast[row[some], level], cut[some])
                pick = some[pick]
                node = np.concatenate([node[rest], node[pick] * 2 + side])
                row, at = np.concatenate([row[rest], row[pick]]), np.concatenate([at[rest], at[pick]])
        deep = ((ended[at] >> 44) & 63) + (~np.isnan(tail)).sum(1)[at]
        rows.append(row)
        codes.append((tree << 50) | (deep << 44) | node)
        return np.concatenate(rows), np.concatenate(codes)

    def _sides(self, p: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows go on, and to which side; those near the threshold go to both."""
        left, right = np.flatnonzero(p <= cut + self.spill), np.flatnonzero(p > cut - self.spill)
        return np.concatenate([left, right]), np.repeat([0, 1], [len(left), len(right)])


def _threshold(p: np.ndarray, spill: float) -> float:
    """Where sorted projections split with the fewest on both sides; nan if those are over STUCK of them."""
    tries = p[(np.linspace(0.3, 0.7, 9) * (len(p) - 1)).astype(int)]
    both = np.searchsorted(p, tries + spill, "right") - np.searchsorted(p, tries - spill, "right")
    best = min(range(9), key=lambda k: (both[k], abs(k - 4)))
    return np.nan if both[best] > STUCK * len(p) else float(tries[best])


def fit(sample: np.ndarray, total: int, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Trees:
    """Trees for ``total`` rows of which ``sample`` (unit vectors) is a part."""
    dim, scale = sample.shape[1], total / max(len(sample), 1)
    rng = np.random.default_rng(seed)
    depth = int(min(DEEPEST, max(0, np.ceil(np.log2(max(total, 1) / leaf)))))
    directions = rng.standard_normal((trees, depth, dim))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    # a linked pair's projections differ by about sqrt(2 - 2 cosine) / sqrt(dim): half of that to either side
    out = Trees(dim, 0.5 * np.sqrt(max(0.0, 2 - 2 * cosine)) / np.sqrt(dim), directions)
    for t in range(trees):
        members, levels, tails = {0: np.arange(len(sample))}, [], {}
        cast = sample @ directions[t].T
        for level in range(depth):
            cuts, below = np.full(1 << level, np.nan), {}
            for node, own in members.items():
                if len(own) * scale <= leaf:
                    continue
                if len(own) < FEW:
                    tails[(t << 50) | (level << 44) | node] = _tail(cast[own], level, len(own) * scale, leaf, out.spill)
                    continue
                p = cast[own, level]
                cuts[node] = cut = _threshold(np.sort(p), out.spill)
                if not np.isnan(cut):
                    below[2 * node], below[2 * node + 1] = own[p <= cut + out.spill], own[p > cut - out.spill]
            if not below:
                break
            levels.append(cuts)
            members = below
        ended = np.array(sorted(tails), np.int64)
        out.thresholds.append(levels)
        out.tails.append((ended, np.array([tails[k] for k in ended.tolist()]).reshape(len(ended), depth)))
    return out


def _tail(cast: np.ndarray, level: int, rows: float, leaf: int, spill: float) -> np.ndarray:
    """Thresholds by level below a node that few sampled rows stand for, until a leaf is as small as the others."""
    cuts = np.full(cast.shape[1], np.nan)
    for at in range(level, cast.shape[1]):
        if rows <= leaf:
            break
        p = np.sort(cast[:, at])
        cuts[at] = cut = _threshold(p, spill)
        if not np.isnan(cut):
            rows *= max(np.searchsorted(p, cut + spill, "right"), len(p) - np.searchsorted(p, cut - spill, "right")) / len(p)
    return cuts


def _route(batches: Iterator[pa.RecordBatch], trees: dict[int, Trees], kind: str, sketches: bool = True) -> Iterator[pa.RecordBatch]:
    """A row for each leaf that a vector (rep, vec) falls in, with its sketch if asked for."""
    names = ["dim", "leaf", "rep", "sketch"]
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            sizes = np.asarray(pc.binary_length(b.column(1))) // np.dtype(kind).itemsize
            for size in np.unique(sizes):
                own = b.take(pa.array(np.flatnonzero(sizes == size)))
                x, _ = _clean(np.frombuffer(b"".join(own.column(1).to_pylist()), kind).reshape(-1, size))
                found = [trees[int(size)].leaves(x, t) for t in range(len(trees[int(size)].thresholds))]
                row, leaf = (np.concatenate(z) for z in zip(*found, strict=True))
                rest = []
                if sketches:
                    rest = [own.column(0).take(pa.array(row)), pa.array([r.tobytes() for r in _sketch(x)], pa.binary()).take(pa.array(row))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), size, np.int32)), pa.array(leaf), *rest], names[: 2 + len(rest)])


def _salted(reps: DataFrame, trees: dict[int, Trees], kind: str, scratch: Scratch) -> DataFrame:
    """(dim, leaf, i, j, salt, rep, sketch): each vector once for each of its leaves, or for each pair of sub-blocks it is in there."""
    rows = reps.select("rep", "vec")
    routed = rows.mapInArrow(lambda it: _route(it, trees, kind), "dim int, leaf long, rep long, sketch binary")
    some = rows.where(F.pmod(F.xxhash64("rep"), F.lit(LOOK)) == 0).mapInArrow(lambda it: _route(it, trees, kind, False), "dim int, leaf long")
    large = some.groupBy("dim", "leaf").agg((F.count("*") * LOOK).alias("rows")).where(F.col("rows") > LARGE)
    large = scratch.table(large.select("dim", "leaf", F.ceil(F.col("rows") / BLOCK).cast("int").alias("k")))
    found = large.limit(BROADCAST + 1).count()
    if not found:
        none = F.lit(0)
        return routed.select("dim", "leaf", none.alias("i"), none.alias("j"), none.alias("salt"), "rep", "sketch")
    routed = routed.join(F.broadcast(large) if found <= BROADCAST else large, ["dim", "leaf"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    routed = routed.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return routed.select("dim", "leaf", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "rep", "sketch")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.Table]]:
    """(dim, i, j, rows) of each leaf or pair of its sub-blocks that holds two rows or more, of several at a time; then (0, 0, 0, empty) after each such run."""
    for t in runs(batches, ["dim", "leaf", "i", "j"], 10_000):
        keys = [t[k].to_numpy() for k in ("dim", "leaf", "i", "j")]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, t.num_rows], strict=True):
            if hi - lo > 1:
                yield int(keys[0][lo]), int(keys[2][lo]), int(keys[3][lo]), t.slice(lo, hi - lo)
        yield 0, 0, 0, t.slice(0, 0)


def _survivors(batches: Iterator[pa.RecordBatch], far: int) -> Iterator[pa.RecordBatch]:
    """(leaf, i, j, salt, rep) of rows with another whose sketch is near, in the same leaf and, where it is cut into sub-blocks, of the other one."""
    names = ["leaf", "i", "j", "salt", "rep"]
    for _, i, j, own in _blocks(batches):
        if not own.num_rows:
            continue
        bits = np.unpackbits(np.frombuffer(b"".join(own["sketch"].to_pylist()), np.uint8).reshape(own.num_rows, -1), axis=1)
        x = bits.astype(np.float32) * 2 - 1
        near = x @ x.T >= BITS - 2 * far
        np.fill_diagonal(near, False)
        if i != j:
            salt = own["salt"].to_numpy()
            near &= salt[:, None] != salt[None, :]
        some = np.flatnonzero(near.any(1))
        if len(some):
            yield from own.select(names).take(pa.array(some)).combine_chunks().to_batches()


def _shared(before: list[list[int]]) -> np.ndarray:
    """Which pairs of rows have some leaf of ``before`` in common."""
    n = len(before)
    out = np.zeros((n, n), bool)
    kinds, at = np.unique(np.array([z for x in before for z in x], np.int64), return_inverse=True)
    row = np.repeat(np.arange(n), [len(x) for x in before])
    for g in range(0, len(kinds), 4096):
        part = (at >= g) & (at < g + 4096)
        one = np.zeros((n, min(4096, len(kinds) - g)), np.float32)
        one[row[part], at[part] - g] = 1
        out |= one @ one.T > 0
    return out


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Within leaves: how many vectors each is linked with (b = 0 - count), and a tree of the links (a, b)."""
    none = np.zeros(0, np.int64)
    ids, counts, a, b = [none], [none], [none], [none]
    for dim, i, j, own in _blocks(batches):
        if not own.num_rows:  # the end of a run
            u, v = forest(np.concatenate(a), np.concatenate(b))
            link = np.repeat([False, True], [sum(map(len, ids)), len(u)])
            yield pa.RecordBatch.from_arrays([pa.array(link), pa.array(np.concatenate([*ids, u])), pa.array(np.concatenate([*counts, v]))], ["link", "a", "b"])
            ids, counts, a, b = [none], [none], [none], [none]
            continue
        rep, n, salt, leaf = (own[k].to_numpy() for k in ("rep", "n", "salt", "leaf"))
        x, _ = _clean(np.frombuffer(b"".join(own["vec"].to_pylist()), kind).reshape(-1, dim))
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if i != j:
            near &= salt[:, None] != salt[None, :]
        some = np.flatnonzero(near.any(1))
        if not len(some):
            continue
        before = [[z for z in x if z < leaf[0]] for x in own["leaves"].take(pa.array(some)).to_pylist()]
        near = near[np.ix_(some, some)] & ~_shared(before)
        rep, n = rep[some], n[some]
        ids.append(rep)
        counts.append(near @ n)
        u, v = np.nonzero(np.triu(near))
        u, v = forest(rep[u], rep[v])
        a.append(u)
        b.append(v)


def near_duplicates(table: DataFrame, cosine: float = COSINE, leaf: int = LEAF, n_trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all vectors."""
    scratch = Scratch(table.sparkSession, "vectors")
    single = table.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = scratch.table(table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>")).mapInArrow(lambda it: _prepare(it, kind), "vec_id long, digest binary, vec binary"))
    reps = scratch.table(rows.where("vec_id is not null and digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("vec").alias("vec")))
    trees, width = {}, np.dtype(kind).itemsize
    lengths = {r[0]: r[1] for r in reps.groupBy((F.octet_length("vec") / width).cast("int").alias("size")).count().collect()}  # a row for each length of vector
    many = sum(total > leaf for total in lengths.values())
    for size, total in lengths.items():
        got = []
        if total > leaf:
            got = reps.where(F.octet_length("vec") == size * width).orderBy(F.xxhash64("rep"), "rep").limit(max(sample // many, FEW)).select("vec").collect()
        known = _clean(np.frombuffer(b"".join(bytes(r[0]) for r in got), kind).reshape(-1, size))[0]
        trees[size] = fit(known, total, cosine, n_trees if total > leaf else 1, leaf)
    by, far = ("dim", "leaf", "i", "j"), _far(cosine)
    near = _salted(reps, trees, kind, scratch).repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda it: _survivors(it, far), "leaf long, i int, j int, salt int, rep long")
    # a row's places in one row: a place for each of its leaves, or pair of sub-blocks there
    near = scratch.table(near.groupBy("rep").agg(F.collect_set(F.struct("leaf", "i", "j", "salt")).alias("places")))
    dim = (F.octet_length("vec") / width).cast("int").alias("dim")
    near = near.join(reps, "rep").select(dim, "rep", "n", "vec", F.array_distinct(F.transform("places", lambda x: x["leaf"])).alias("leaves"), F.explode("places").alias("x")).select("dim", "x.*", "rep", "n", "vec", "leaves")
    found = scratch.table(near.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda it: _compare(it, cosine, kind), "link boolean, a long, b long"))
    joined = components(found.where("link").select("a", "b"), scratch)
    counts = found.where("not link").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    per = reps.select("rep", "digest", "n").join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    per = scratch.table(per.select("digest", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")))
    named = F.col("vec_id").isNotNull()
    out = rows.select("vec_id", "digest").join(per, "digest", "left")
    return out.select("vec_id", F.when(named, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(named, F.coalesce("component", "vec_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same by brute force, all vectors compared with all.
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x::DOUBLE, 0)) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v WHERE list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY 1),
c AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN low ON low.a = vec_id
"""
