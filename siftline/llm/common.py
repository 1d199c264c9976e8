"""Shared pieces: bounded samples, forests of links, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.sources.scratch import Scratch, scratch_dir  # noqa: F401

#: White space that separates words: space and the control characters 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Children of a node in the trees that stand for a group's links; keeps any node's degree small.
FAN = 16
#: Parts in which a sample's rows are ranked.
PARTS = 64


def least_hashed(rows: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """Up to k rows of each value of ``by``, those of least hash of ``key``, which must be whole numbers; ``_o`` is the hash.

    Each value's count tells the hash below which about twice k rows lie (and 64 more): only those are
    looked at further, so they do not grow with the table. They are dealt to PARTS parts in order of hash, whose counts tell how many rows
    come before a part; ranks are made within parts.
    """
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * k + 64) / F.col("_n"))
    few = lambda x: F.broadcast(x) if x.limit(10_001).count() <= 10_000 else x
    place = (F.xxhash64(key).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) / share
    near = rows.join(few(counts), F.col(by) == F.col("_by")).withColumn("_o", F.xxhash64(key)).where(place <= 1).withColumn("_part", F.least(F.floor(place * PARTS), F.lit(PARTS - 1)).cast("int"))
    parts = near.groupBy(F.col(by).alias("_of"), F.col("_part").alias("_p")).agg(F.count("*").alias("_in"))
    before = F.coalesce(F.sum("_in").over(W.partitionBy("_of").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).where(F.col("_before") < k)
    rank = F.row_number().over(W.partitionBy(by, "_part").orderBy("_o", key))
    out = near.withColumn("_k", rank).join(few(parts), (F.col(by) == F.col("_of")) & (F.col("_part") == F.col("_p"))).where(F.col("_before") + F.col("_k") <= k)
    return out.drop("_by", "_n", "_k", "_part", "_of", "_p", "_in", "_before")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b in, fewer links out that connect the same nodes: each group becomes a tree of FAN children a node."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    order = np.lexsort((nodes, label))
    label, nodes = label[order], nodes[order]
    first = np.r_[0, np.flatnonzero(np.diff(label)) + 1]
    start = np.repeat(first, np.diff(np.r_[first, len(label)]))
    place = np.arange(len(label)) - start
    child = place > 0
    return nodes[child], nodes[(start + (place - 1) // FAN)[child]]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Batches sorted by keys, regrouped so that no key's rows are cut apart. Holds one run and one batch."""
    held: list[pa.Table] = []
    count = 0

    def split(t: pa.Table) -> int:
        """Rows before the last key."""
        change = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            x = t[k].to_numpy()
            change |= x[1:] != x[:-1]
        cut = np.flatnonzero(change)
        return int(cut[-1]) + 1 if len(cut) else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= rows:
            whole = pa.concat_tables(held)
            if cut := split(whole):
                yield whole.slice(0, cut).combine_chunks()
                whole = whole.slice(cut)
            held, count = [whole], 0
    if held:
        whole = pa.concat_tables(held)
        if whole.num_rows:
            yield whole.combine_chunks()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that links reach from each node of ``links`` (a, b).

    Each round every node takes the least label of its neighbours' labels, hands it to the node that
    it has followed so far, and follows that node's own label. Labels only fall; the sum tells when
    they rest. Links come as trees of bounded degree, so no join key is hot but the label, and there
    the other side has one row a node, which Spark splits.
    """
    both, at = scratch.save(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    now, path = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("f")))
    total = None
    while True:
        further = now.alias("p").join(now.select(F.col("node").alias("f"), F.col("f").alias("g")), "f").select("node", "f", "g")
        further, far = scratch.save(further)
        low = both.join(further.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("m"))
        hook = further.select("node", "f").join(low, "node")
        new = (
            hook.select("node", F.col("m").alias("f"))
            .unionByName(hook.select(F.col("f").alias("node"), F.col("m").alias("f")))
            .unionByName(further.select("node", F.col("g").alias("f")))
            .groupBy("node")
            .agg(F.min("f").alias("f"))
        )
        new, new_path = scratch.save(new)
        scratch.drop(path)
        scratch.drop(far)
        now, path = new, new_path
        was, total = total, now.agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0]
        if was == total:
            scratch.drop(at)
            return now.select("node", F.col("f").alias("component"))
