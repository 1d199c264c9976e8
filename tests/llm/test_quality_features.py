import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from siftline.llm import quality


def plain(text):
    data = text.encode()
    words = [w.encode() for w in re.findall("[^ \t-\r]+", text)]
    n, one, chars = len(words), max(len(words), 1), max(len(data), 1)
    count = lambda s: sum(data.count(c) for c in s)
    upper, lower, bar = (sum(lo <= c <= hi for c in data) for lo, hi in ((65, 90), (97, 122), (124, 124)))
    marks = sum(c in b".,;:?'\"()-/" for c in data)
    symbols = sum(c in b"#$%&*|@~^_<>{}=+\\" for c in data)
    times = Counter(words)
    share = lambda x, y: math.sqrt(x / max(y, 1))
    return [
        math.log1p(n) / 5,
        math.log1p(sum(map(len, words)) / one),
        share(symbols, chars),
        share(bar, chars),
        share(upper, upper + lower),
        share(sum(48 <= c <= 57 for c in data), chars),
        share(count([b"!"]), chars),
        share(marks, chars),
        len(times) / one * math.log1p(n),
        share(sum(a == b for a, b in zip(words, words[1:])), one),  # noqa: B905
        share(count([b"\n"]), one),
        share(max(times.values(), default=0), one),
        share(sum(len(w) > 25 for w in words), one),
        float(not n),
    ]


def test_features_against_plain(spark):
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " \n ", "a", "A|B || c! 12 12 12 -- (x) é ü\t\x0b z" * 3, "x" * 40 + " " + "é" * 13 + " é" * 5, "same " * 50, " lead and trail ", "{}=+\\ #$%&*@~^_<>"]
    got = quality.features(pa.array(texts))
    assert got.shape == (len(texts), len(quality.FEATURES))
    assert np.abs(got - np.array([plain(t) for t in texts])).max() < 1e-12
