import numpy as np
import pyarrow as pa

from siftline.llm import language


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.train({"a": [b"x"], "b": [b"y"]}, hidden=3, steps=0)
    net.w = {k: rng.normal(0, 0.5, v.shape) for k, v in net.w.items()}
    x, y = rng.integers(97, 101, (4, 5)), np.array([0, 1, 0, 1])
    _, g = net.gradients(x, y)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(int(rng.integers(s)) for s in w.shape)
            if name.startswith("in"):
                at = (int(x[rng.integers(4), rng.integers(5)]), at[1])
            keep = w[at]
            w[at] = keep + 1e-5
            up = net.gradients(x, y)[0]
            w[at] = keep - 1e-5
            down = net.gradients(x, y)[0]
            w[at] = keep
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.predict(docs, language.fit(docs), keep=("lang",)).withColumn("held_out", language.held_out()).toPandas()
    out = got[got.held_out]
    assert len(out) > 40 and (out.lang_pred == out.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def plain_scores(text, net):
    """Each label's mean probability over the positions of a text, one byte after the other."""
    size = net.w["ref"].shape[0]
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(piece, way):
        h, out = np.zeros(size), []
        for c in piece if way == "f" else piece[::-1]:
            a, b = net.w["in" + way][c].astype(float), h @ net.w["re" + way]
            z, r = sig(a[:size] + b[:size]), sig(a[size : 2 * size] + b[size : 2 * size])
            n = np.tanh(a[2 * size :] + r * b[2 * size :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out if way == "f" else out[::-1]

    total, count = np.zeros(len(net.labels)), 0
    for word in text.lower().encode().split():
        pieces, chars = [b""], [c.encode() for c in word.decode()]
        starts = [0]
        for c in chars:
            if starts[-1] + len(pieces[-1]) + len(c) > language.PIECE * len(pieces):
                starts.append(starts[-1] + len(pieces[-1]))
                pieces.append(b"")
            pieces[-1] += c
        for piece in pieces:
            for f, b in zip(states(piece, "f"), states(piece, "b"), strict=True):
                v = np.exp(np.concatenate([f, b]) @ net.w["out"] + net.w["bias"])
                total += v / v.sum()
                count += 1
    return total / count


def predicted(text, net):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    return next(language._predict(iter([batch]), net, ("l", "s"))).to_pylist()[0]


def test_against_position_by_position():
    net = language.train({"a": ["abc éàüß".encode(), "日本語".encode()], "b": [b"xyz", "это".encode()]}, steps=40)
    for text in ("abc xyz abc", "a", "É " * 7 + "xyz" * 20, "日本語の文章には空白がありませんから長い一語になります", "это было 日本 abc\u3000x", "z" * 24 + " " + "z" * 25 + " " + "é" * 12 + " " + "zé" * 30, "\U0001f600" * 13 + "a"):
        want, got = plain_scores(text, net), predicted(text, net)
        assert got["l"] == net.labels[want.argmax()] and abs(got["s"] - want.max()) < 1e-5, text


def test_parts_make_no_difference(monkeypatch):
    net = language.train({"a": [b"abc", b"abd"], "b": [b"xyz", b"xyw"]}, steps=30)
    for text in ("abc xyz " * 50 + "q" * 300 + " abd" * 9, "\n" + "abcxyz" * 60, "xyz\t" * 200):
        monkeypatch.setattr(language, "PART", 1 << 20)
        whole = predicted(text, net)
        monkeypatch.setattr(language, "PART", 80)
        assert len(list(language.parts(text))) > 1 or " " not in text
        cut = predicted(text, net)
        assert whole["l"] == cut["l"] and abs(whole["s"] - cut["s"]) < 1e-9


def test_odd_rows(odd, none, clashing):
    net = language.fit(odd)
    got = language.predict(odd, net).toPandas()
    assert len(got) == odd.count()
    und = got[got.doc_id.isin([4, 5, 6, 9])]
    assert (und.lang_pred == "und").all() and (und.score == 0).all()
    assert language.fit(none).labels == [] and language.predict(none, net).count() == 0
    assert (language.predict(odd, language.fit(none)).toPandas().lang_pred == "und").all()
    kept = language.identified(clashing)
    assert kept.columns == clashing.columns
    assert set(r[0] for r in kept.select("doc_id").collect()).isdisjoint({4, 5, 6, 9})
    assert language.identified(none).count() == 0
