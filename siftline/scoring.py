"""Models as columns: functions that embed texts and score pairs are handed in, each distinct text of a batch is embedded once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scorer:
    """``embed(texts, lang)`` gives a vector a text, ``cross(pairs, lang)`` a score a pair (query, text); None where there is no such model.

    Models are kept by language by whoever makes these functions; a batch's rows come grouped by language. Errors are not swallowed.
    """

    embed: Callable[[Sequence[str], str], np.ndarray] | None = None
    cross: Callable[[Sequence[tuple[str, str]], str], Sequence[float]] | None = None

    def similarity(self, query: Column, text: Column, lang: Column) -> Column | None:
        """Cosine of the two texts' vectors; null if either is null, 0 if either vector is zero. None without a model."""
        if self.embed is None:
            return None

        def score(queries: list[str], texts: list[str], lang: str) -> np.ndarray:
            known = {t: k for k, t in enumerate(dict.fromkeys(queries + texts))}
            x = np.asarray(self.embed(list(known), lang), float)
            a, b = (x[[known[t] for t in side]] for side in (queries, texts))
            length = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            return np.divide((a * b).sum(1), length, out=np.zeros(len(a)), where=length > 0)

        return _scored(score, query, text, lang)

    def relevance(self, query: Column, text: Column, lang: Column) -> Column | None:
        """The model's score of each pair; null if either is null. None without a model."""
        if self.cross is None:
            return None
        return _scored(lambda q, t, lang: np.asarray(self.cross(list(zip(q, t, strict=True)), lang), float), query, text, lang)


def _scored(score: Callable[[list[str], list[str], str], np.ndarray], query: Column, text: Column, lang: Column) -> Column:
    @F.arrow_udf("double")
    def run(queries: pa.Array, texts: pa.Array, langs: pa.Array) -> pa.Array:
        rows: dict[str, list[int]] = {}
        q, t, out = queries.to_pylist(), texts.to_pylist(), [None] * len(queries)
        for i, lang in enumerate(langs.to_pylist()):
            if q[i] is not None and t[i] is not None:
                rows.setdefault(lang or "", []).append(i)
        for lang, own in rows.items():
            for i, value in zip(own, score([q[i] for i in own], [t[i] for i in own], lang), strict=True):
                out[i] = float(value)
        return pa.array(out, pa.float64())

    return run(query, text, lang)
