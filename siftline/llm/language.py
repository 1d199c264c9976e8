"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text is cut at white space; a word's lower-cased UTF-8 bytes (longer ones in pieces of up to PIECE, cut between characters) are one
sequence. The network reads it both ways and gives every byte position a probability for each label; a
document's probabilities are the mean over all its positions. A sequence's positions don't depend on its
neighbours, so each distinct word of a batch goes through the network once and counts as often as it
occurs: all positions of whole texts are labelled, at the cost of the distinct ones.

Training takes DOCS documents a label of least hash, one window of WINDOW characters at a hashed
place in each (a bounded sample, both parameters). Every text is predicted whole.

Defined results: null text, and text without a letter, is ``und`` with score 0; with nothing to learn from
every text is ``und``; equal texts get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import least_hashed
from siftline.sources.reading import table

DOCS, WINDOW = 400, 600
HIDDEN, PIECE = 16, 24
STEPS, BATCH, RATE = 700, 256, 0.01
#: Characters of text taken at once; longer texts are cut at the next white space, which changes no sequence.
TAKEN = 12 << 20
PART = 1 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Two directions of input rows (256, 3H), recurrent matrices (H, 3H); an output matrix (2H, labels) and its bias."""

    labels: list[str]
    w: dict[str, np.ndarray]

    def read(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states (n, length, H) of sequences x (n, length), and what going back needs."""
        table, u = self.w["in" + way], self.w["re" + way]
        size = u.shape[0]
        h = np.zeros((len(x), size), table.dtype)
        out, kept = np.empty((*x.shape, size), table.dtype), []
        for t in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
            a, b = table[x[:, t]], h @ u
            gates = _sigmoid(a[:, : 2 * size] + b[:, : 2 * size])
            z, r, q = gates[:, :size], gates[:, size:], b[:, 2 * size :]
            n = np.tanh(a[:, 2 * size :] + r * q)
            kept.append((t, h, z, r, q, n))
            h = n + z * (h - n)
            out[:, t] = h
        return out, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (n, length, labels) of every position."""
        v = np.concatenate([self.read(x, "f")[0], self.read(x, "b")[0]], 2) @ self.w["out"] + self.w["bias"]
        v = np.exp(v - v.max(2, keepdims=True))
        return v / v.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions, and its gradients, back through time."""
        seen = {way: self.read(x, way) for way in "fb"}
        states = np.concatenate([seen["f"][0], seen["b"][0]], 2)
        v = states @ self.w["out"] + self.w["bias"]
        v = np.exp(v - v.max(2, keepdims=True))
        p = v / v.sum(2, keepdims=True)
        loss = -np.log(p[np.arange(len(x)), :, y] + 1e-9).mean()
        p[np.arange(len(x)), :, y] -= 1
        p /= x.size
        size, g = self.w["ref"].shape[0], {k: np.zeros_like(a) for k, a in self.w.items()}
        g["out"] = states.reshape(-1, 2 * size).T @ p.reshape(-1, p.shape[2])
        g["bias"] = p.sum((0, 1))
        back = p @ self.w["out"].T
        for way, part in (("f", back[:, :, :size]), ("b", back[:, :, size:])):
            u, dh = self.w["re" + way], np.zeros((len(x), size), states.dtype)
            for t, h, z, r, q, n in reversed(seen[way][1]):
                dh = dh + part[:, t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * q * r * (1 - r)
                np.add.at(g["in" + way], x[:, t], np.concatenate([dz, dr, dn], 1))
                into = np.concatenate([dz, dr, dn * r], 1)
                g["re" + way] += h.T @ into
                dh = dh * z + into @ u.T
        return loss, g


def train(samples: dict[str, list[bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 3) -> Network:
    """A network for label -> words, by Adam on batches of equal length with labels in equal shares."""
    rng, labels = np.random.default_rng(seed), sorted(samples)
    net = Network(labels, {})
    for way in "fb":
        net.w["in" + way] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        net.w["re" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
    net.w["out"] = rng.normal(0, 1 / np.sqrt(hidden), (2 * hidden, len(labels))).astype(np.float32)
    net.w["bias"] = np.zeros(len(labels), np.float32)
    by_size: dict[int, list[list[np.ndarray]]] = {}
    weight: dict[int, int] = {}
    for k, label in enumerate(labels):
        for word in samples[label]:
            whole = np.frombuffer(word, np.uint8)
            edges = [*cuts(whole, np.arange(0, len(word), PIECE)), len(word)]
            for lo, hi in zip(edges, edges[1:]):  # noqa: B905
                piece = whole[lo:hi]
                by_size.setdefault(len(piece), [[] for _ in labels])[k].append(piece)
                weight[len(piece)] = weight.get(len(piece), 0) + 1
    if not by_size:
        return net
    sizes = sorted(by_size)
    chance = np.array([weight[s] * s for s in sizes], float)
    m, v = ({k: np.zeros_like(a) for k, a in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = by_size[sizes[rng.choice(len(sizes), p=chance / chance.sum())]]
        there = [k for k, x in enumerate(rows) if x]
        y = rng.choice(there, BATCH)
        x = np.stack([rows[k][rng.integers(len(rows[k]))] for k in y])
        _, g = net.gradients(x, y)
        rate = RATE * (1 - 0.9 * step / steps)
        for k, d in g.items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            net.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_label: int = DOCS, window: int = WINDOW) -> Network:
    """Learns from text and lang of documents that aren't held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    at = 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - window, F.lit(1)))
    rows = rows.select("doc_id", "lang", F.lower(F.col("text").substr(at.cast("int"), F.lit(window))).alias("part"))
    samples: dict[str, list[bytes]] = {}
    for lang, part in least_hashed(rows, "lang", "doc_id", per_label).orderBy("lang", "_o", "doc_id").select("lang", "part").collect():
        samples.setdefault(lang, []).extend(part.encode("utf-8", "replace").split())
    return train({k: v for k, v in samples.items() if v})


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places moved back to where a character of UTF-8 begins, three bytes at most."""
    at = at.copy()
    for _ in range(3):
        at -= (data[at] & 0xC0) == 0x80 if len(data) else 0
    return at


def _word_sums(words: pa.Array, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct word: its positions' probabilities, summed, and their number."""
    offsets = np.frombuffer(words.buffers()[1], np.int32 if words.type in (pa.string(), pa.binary()) else np.int64)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    n = -(-size // PIECE)
    word = np.repeat(np.arange(len(words)), n)
    k = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    start = cuts(data, offsets[word] + k * PIECE)
    last = np.r_[word[1:] != word[:-1], True][: len(word)]
    length = np.where(last, offsets[word + 1], np.r_[start[1:], 0][: len(word)]) - start
    sums = np.zeros((len(words), len(net.labels)))
    for s in np.unique(length):
        own = np.flatnonzero(length == s)
        for i in range(0, len(own), 4096):
            part = own[i : i + 4096]
            p = net.probabilities(data[start[part][:, None] + np.arange(s)])
            np.add.at(sums, word[part], p.sum(1))
    return sums, size


def _pooled(texts: pa.Array, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Summed position probabilities of each text, and its number of positions."""
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat, at = words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = flat.dictionary_encode()
    sums, size = _word_sums(coded.dictionary, net)
    code = coded.indices.to_numpy()
    out = np.zeros((len(texts), len(net.labels)))
    for k in range(len(net.labels)):
        run = np.concatenate([[0.0], np.cumsum(sums[code, k])])
        out[:, k] = run[at[1:]] - run[at[:-1]]
    run = np.concatenate([[0], np.cumsum(size[code])])
    return out, run[at[1:]] - run[at[:-1]]


def parts(text: str) -> Iterator[str]:
    """A text cut at white space into pieces of PART characters and the word they end in."""
    at = 0
    for m in re.finditer(r"[\x20\x09-\x0D]", text) if len(text) > PART else ():
        if m.start() - at >= PART:
            yield text[at : m.start()]
            at = m.end()
    yield text[at:]


def _predict(batches: Iterator[pa.RecordBatch], net: Network, called: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    names = np.array([*net.labels, "und"], object)
    for b in batches:
        lengths = np.asarray(pc.utf8_length(b.column(1)).fill_null(0))
        group = (np.cumsum(lengths) - lengths) // TAKEN
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            part = b.slice(own[0], len(own))
            texts = part.column(1).fill_null("")
            if not net.labels:
                sums, n = np.zeros((len(own), 0)), np.zeros(len(own))
            elif lengths[own].max() > PART:  # a long text goes through in parts
                cut = [(i, x) for i, t in enumerate(texts.to_pylist()) for x in parts(t)]
                sums, n = np.zeros((len(own), len(net.labels))), np.zeros(len(own))
                for k in range(0, len(cut), 16):
                    s, m = _pooled(pa.array([t for _, t in cut[k : k + 16]], pa.string()), net)
                    np.add.at(sums, [i for i, _ in cut[k : k + 16]], s)
                    np.add.at(n, [i for i, _ in cut[k : k + 16]], m)
            else:
                sums, n = _pooled(texts, net)
            known = np.asarray(pc.match_substring_regex(texts, r"\p{L}")) & (n > 0) & bool(net.labels)
            best = np.where(known, sums.argmax(1) if net.labels else 0, len(net.labels))
            score = np.where(known, sums.max(1, initial=0) / np.maximum(n, 1), 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays([pa.array(names[best], pa.string()), pa.array(score), *part.columns], [*called, "doc_id", "text", *part.schema.names[2:]])


def predict(docs: DataFrame, net: Network, keep: tuple[str, ...] = (), text: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the label and its score, called ``names``, to doc_id, the columns in ``keep`` and, if asked for, text."""
    rows = docs.select("doc_id", F.col("text").cast("string"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(lambda it: _predict(it, net, names), f"{names[0]} string, {names[1]} double, {fields}")
    return out if text else out.drop("text")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Documents whose best label's pooled probability is less are in no learned language.
LEAST = 0.3


def identified(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, whose language is told: no ``und``, and no score under LEAST."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = predict(docs, fit(docs), others, True, ("_lang_pred", "_score"))
    return out.where((F.col("_lang_pred") != "und") & (F.col("_score") >= LEAST)).select(*docs.columns)
