"""Quality scores by Bradley-Terry pairwise ranking.

Each document has features of its text alone: shares of symbols, capitals, digits and marks, repeated words and
lines, word lengths. A labelled good and a labelled bad document are a preference pair; weights are learned by
logistic loss on the feature differences of all pairs. The cut between good and bad is a quantile of all
labelled documents' scores, at the labelled share of bad ones; scores are moved so that it stands at CUT.

No pair is written out. A pair's loss is a smooth function of its two scores, so a document can stand for itself by weights
at the Chebyshev points of its score's piece: sums of those weights, times features and their products, give the gradient and curvature
of all pairs to about 14 digits. A step of learning is one pass over the labelled documents, whose sums
are of a size that the table does not change.

Defined results: null text is empty text; empty texts are scored; without labels of both kinds every score is 0.5; repeated
rows get equal scores; several labels of one document all count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import Scratch
from siftline.sources.reading import table

CUT = 0.3
STEPS, DECAY = 60, 1e-3
#: Width of a piece of scores, its Chebyshev points, and the pieces beyond which a pair's loss is flat (e^-40).
WIDTH, POINTS, REACH = 2.0, 18, 21
#: Bins that counts of scores are taken in.
BINS = 4096
#: Characters of text taken at once.
TAKEN = 12 << 20
SYMBOLS = b"#$%&*|@~^_<>{}=+\\"
FEATURES = ("length", "word_length", "symbols", "bars", "capitals", "digits", "shouts", "marks", "distinct", "again", "lines", "top", "long", "empty")


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for c in SYMBOLS:
        kind[c] = 1
    kind[ord("|")] = 2
    kind[ord("A") : ord("Z") + 1] = 3
    kind[ord("0") : ord("9") + 1] = 4
    kind[ord("!")] = 5
    for c in b".,;:?'\"()-/":
        kind[c] = 6
    kind[ord("\n")] = 7
    kind[ord("a") : ord("z") + 1] = 8
    return kind


CLASSES = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """(texts, features) of non-null strings."""
    n = len(texts)
    texts = pa.concat_arrays([texts]).cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = CLASSES[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    size = np.diff(at)
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    counts = np.bincount(doc * np.int64(16) + data, minlength=16 * n).reshape(n, 16)[:, :9] if n else np.zeros((0, 9))
    letters = counts[:, 3] + counts[:, 8]
    words = pc.ascii_split_whitespace(texts)
    off = words.offsets.to_numpy()
    off = off - off[0]
    flat = words.flatten()
    # splitting leaves an empty string at either end of a text that starts or ends with white space
    width = np.asarray(pc.binary_length(flat)).astype(np.int64)
    code = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(off))
    real = width > 0
    width, code, owner = width[real], code[real], owner[real]
    number = np.bincount(owner, minlength=n)
    one = np.maximum(number, 1)
    pair = owner * (code.max(initial=0) + 1) + code
    kinds, times = np.unique(pair, return_counts=True)
    kind_owner = kinds // (code.max(initial=0) + 1)
    top = np.zeros(n)
    np.maximum.at(top, kind_owner, times)
    same = np.bincount(owner[1:][pair[1:] == pair[:-1]], minlength=n) if len(pair) else np.zeros(n)
    chars = np.maximum(size, 1)
    distinct = np.bincount(kind_owner, minlength=n)
    share = lambda x, y: np.sqrt(x / np.maximum(y, 1))
    return np.stack(
        [
            np.log1p(number) / 5,
            np.log1p(np.bincount(owner, width, minlength=n) / one),
            share(counts[:, 1] + counts[:, 2], chars),
            share(counts[:, 2], chars),
            share(counts[:, 3], letters),
            share(counts[:, 4], chars),
            share(counts[:, 5], chars),
            share(counts[:, 6], chars),
            distinct / one * np.log1p(number),
            share(same, one),
            share(counts[:, 7], one),
            share(top, one),
            share(np.bincount(owner[width > 25], minlength=n), one),
            (number == 0).astype(float),
        ],
        1,
    )


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): features of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(pc.utf8_length(b.column(1)).fill_null(0))
            group = (np.cumsum(lengths) - lengths) // TAKEN
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                part = b.slice(own[0], len(own))
                x = features(part.column(1).fill_null(""))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


NODES = np.cos(np.pi * (np.arange(POINTS) + 0.5) / POINTS)
#: From Chebyshev polynomials at a place in a piece to the weights of its points.
BASIS = np.polynomial.chebyshev.chebvander(NODES, POINTS - 1).T * np.r_[1.0, np.full(POINTS - 1, 2.0)][:, None] / POINTS

#: By piece of scores, for each of its points: sums of weight times products of (1, features), upper triangle.
Sums = dict[int, np.ndarray]


def add(sums: Sums, z: np.ndarray, s: np.ndarray) -> None:
    """Adds documents with features z and scores s."""
    if not len(z):
        return
    one = np.concatenate([np.ones((len(z), 1)), z], 1)
    i, j = np.triu_indices(one.shape[1])
    piece = np.floor(s / WIDTH).astype(np.int64)
    order = np.argsort(piece, kind="stable")
    own, first = np.unique(piece[order], return_index=True)
    for p, at in zip(own.tolist(), np.split(order, first[1:]), strict=True):
        weight = np.polynomial.chebyshev.chebvander(2 * (s[at] / WIDTH - p) - 1, POINTS - 1) @ BASIS
        sums[p] = sums.get(p, 0.0) + weight.T @ (one[at][:, i] * one[at][:, j])


def unpacked(sums: Sums, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces in order, places (pieces, points) and products (pieces, points, 1 + size, 1 + size)."""
    pieces = np.array(sorted(sums), np.int64)
    i, j = np.triu_indices(1 + size)
    out = np.zeros((len(pieces), POINTS, 1 + size, 1 + size))
    out[:, :, i, j] = out[:, :, j, i] = np.array([sums[p] for p in pieces.tolist()]).reshape(-1, POINTS, len(i))
    return pieces, (pieces[:, None] + (NODES + 1) / 2) * WIDTH, out


def derivatives(good: Sums, bad: Sums, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean logistic loss of all pairs."""
    (pieces, places, x), (bad_pieces, bad_places, y) = unpacked(good, size), unpacked(bad, size)
    grad, curve, cross = np.zeros(size), np.zeros((size, size)), np.zeros((size, size))
    slope, bend = np.zeros(y.shape[:2]), np.zeros(y.shape[:2])
    for p, place, own in zip(pieces, places, x, strict=True):
        low, high = np.searchsorted(bad_pieces, [p - REACH, p + REACH + 1])
        near = y[low:high].reshape(-1, 1 + size, 1 + size)
        wrong = 1 / (1 + np.exp(place[:, None] - bad_places[low:high].reshape(-1)))
        both = wrong * (1 - wrong)
        # a bad document far above a good one is wrong for certain, one far below right
        grad -= (wrong @ near[:, 0, 0] + y[high:, :, 0, 0].sum()) @ own[:, 0, 1:]
        curve += np.tensordot(both @ near[:, 0, 0], own[:, 1:, 1:], 1)
        cross += own[:, 0, 1:].T @ both @ near[:, 0, 1:]
        slope[low:high] += (own[:, 0, 0] @ wrong).reshape(-1, POINTS)
        slope[high:] += own[:, 0, 0].sum()
        bend[low:high] += (own[:, 0, 0] @ both).reshape(-1, POINTS)
    grad += np.tensordot(slope, y[:, :, 0, 1:], 2)
    curve += np.tensordot(bend, y[:, :, 1:, 1:], 2) - cross - cross.T
    pairs = x[:, :, 0, 0].sum() * y[:, :, 0, 0].sum()
    return grad / pairs, curve / pairs


def weights(sums: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[Sums, Sums]], size: int, steps: int = STEPS) -> tuple[np.ndarray | None, int, int]:
    """Weights that make a good document's score exceed a bad one's, by Newton's method, and how many documents are good and bad.

    ``sums`` takes a mean, a scale and weights: z are features less the mean over the scale, scores are z by the weights.
    """
    good, bad = (unpacked(x, size)[2].sum((0, 1)) for x in sums(np.zeros(size), np.ones(size), np.zeros(size)))
    n_good, n_bad = round(good[0, 0]), round(bad[0, 0])
    if not n_good or not n_bad:
        return None, n_good, n_bad
    total = (good + bad) / (n_good + n_bad)
    mean = total[0, 1:]
    scale = np.sqrt(np.maximum(np.diag(total)[1:] - mean**2, 1e-12))
    w = np.zeros(size)
    for _ in range(steps):
        grad, curve = derivatives(*sums(mean, scale, w), size)
        step = np.linalg.solve(curve + DECAY * np.eye(size), grad + DECAY * w)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w / scale, n_good, n_bad


def learn(good: np.ndarray, bad: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights from all pairs of the rows of two arrays."""

    def sums(mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[Sums, Sums]:
        out: tuple[Sums, Sums] = {}, {}
        for x, own in zip((good, bad), out, strict=True):
            z = (x - mean) / scale
            add(own, z, z @ w)
        return out

    return weights(sums, good.shape[1], steps)[0]


def summed(told: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[Sums, Sums]:
    """Sums of the good and of the bad among all documents told (quality, x). Tasks' sums are added in the order of tasks."""
    schema = "quality int, piece long, part int, sums binary"

    def rows(sums: dict[int, Sums], part: int) -> Iterator[pa.RecordBatch]:
        for q, own in sums.items():
            for p, x in own.items():
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([p], pa.int64()), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["quality", "piece", "part", "sums"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, Sums] = {0: {}, 1: {}}
        for b in batches:
            label, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, len(mean))
            z = (x - mean) / scale
            for q, own in out.items():
                add(own, z[label == q], (z @ w)[label == q])
        yield from rows(out, TaskContext.get().partitionId())

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, Sums] = {0: {}, 1: {}}
        for b in batches:
            for q, p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                out[q][p] = out[q].get(p, 0.0) + np.frombuffer(x.as_buffer())
        yield from rows(out, 0)

    parts = told.select("quality", "x").mapInArrow(first, schema).repartition("quality", "piece").sortWithinPartitions("quality", "piece", "part")
    out: tuple[Sums, Sums] = {}, {}
    for q, p, _, x in parts.mapInArrow(then, schema).collect():
        out[1 - q][p] = np.frombuffer(x).reshape(POINTS, -1)
    return out


def middle(values: DataFrame, k: int) -> float:
    """Halfway between the k-th least value of ``s`` and the next. Its bin is cut into bins until what is asked for lies at their ends."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        place = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        own = values.where(F.col("s").between(low, high)).groupBy(place.alias("place"))
        bins = sorted(own.agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect())
        upto = np.cumsum([b["n"] for b in bins])
        at = int(np.searchsorted(upto, k))
        if k == upto[at]:
            return (bins[at]["high"] + bins[at + 1]["low"]) / 2
        k -= int(upto[at]) - bins[at]["n"]
        low, high = bins[at]["low"], bins[at]["high"]
    return low


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; labels (doc_id, quality) of held-out ones are not read."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.table(measured(docs))
    told = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held_out())
    told = scratch.table(told.join(rows, "doc_id").select("quality", "x"))
    w, n_good, n_bad = weights(partial(summed, told), len(FEATURES))
    if w is not None:
        inner = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        shift = float(np.log(CUT / (1 - CUT))) - middle(told.select(inner.alias("s")), n_bad)
        value = 1 / (1 + F.exp(-(inner + F.lit(shift))))
    else:
        value = F.lit(0.5)
    return rows.select("doc_id", held_out().alias("held_out"), value.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
