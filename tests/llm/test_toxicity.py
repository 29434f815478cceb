import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from adjudica.llm import toxicity as T

SCHEMA = "doc_id long, text string, score string, lang string"


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "ne", "so") for c in ("", "t", "ling")]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([3, 20, 90, 400]))]
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * rng.randint(1, 4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["vilescum", "Dreckvolk", "foulbeast" + rng.choice(["", "s", "ing"])]))
        rows.append((i, " ".join(words) + ".", toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(700, 1)
    return T.train([t for _, t, _ in rows], [y for *_, y in rows])


def test_gradients_as_by_differences():
    rng = np.random.default_rng(0)
    texts = pa.array(["a bad word here now", "fine words only", "bad"])
    vocabulary, codes, offsets = T.split_words(texts)
    words = T.Words(vocabulary)
    params, known = T.first_params(vocabulary, codes, offsets, np.array([1, 0, 1]), words, rng)
    net = T.Network({k: v.astype(np.float64) for k, v in params.items()}, known)
    index, live = T.window_index(codes, *T.windows_of(offsets)[1:], len(vocabulary))
    error = np.array([0.3, -0.7, 1.1])
    inputs = rng.standard_normal((len(vocabulary), 16))

    def total():
        return float((net.forward(net.gates(inputs), index, live).astype(np.float64) * error).sum())

    keep = []
    gates = net.gates(inputs)
    net.forward(gates, index, live, keep)
    grads = net.backward(error, index, live, gates, keep)
    for d in "fb":
        own = grads.pop("g" + d)[:-1]
        grads["W" + d], grads["b" + d] = inputs.T @ own, own.sum(axis=0)
    for name in ("Wf", "Wb", "Uf", "Ub", "bf", "A", "v", "o", "c"):
        flat = net.p[name].reshape(-1)
        for at in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old = flat[at]
            flat[at] = old + 1e-2
            up = total()
            flat[at] = old - 1e-2
            down = total()
            flat[at] = old
            assert (up - down) / 2e-2 == pytest.approx(float(grads[name].reshape(-1)[at]), rel=0.05, abs=2e-3)


def test_gram_means_and_their_gradient():
    words = T.Words(pa.array(["ab", "x", "longer", "longer"]))
    table = np.random.default_rng(1).standard_normal((1 << T.GRAM_BITS, 3)).astype(np.float32)
    mean = words.mean(table)
    assert np.allclose(mean[2], mean[3]) and np.allclose(T.words_mean(words, np.array([2, 0]), table), mean[[2, 0]], atol=1e-6)
    weight = np.eye(3, dtype=np.float32)[[0, 1]]
    spread = words.spread(np.array([0, 2]), weight, 1 << T.GRAM_BITS)
    assert (spread * table).sum() == pytest.approx(mean[0, 0] + mean[2, 1], rel=1e-4)
    assert len(set(words.hash.tolist())) == 3


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 72, 73, 1000):
        text, start, size = T.windows_of(np.array([0, n, n + 5]))
        own = text == 0
        assert set().union(*(range(s, s + k) for s, k in zip(start[own], size[own]))) == set(range(n))
        assert (np.diff(start[own]) <= T.STRIDE).all() and own.sum() >= 1


def test_held_out_texts(model):
    rows = corpus(400, 2)
    p = model.scores(pa.array([t for _, t, _ in rows]))
    y = np.array([y for *_, y in rows])
    assert ((p >= 0.5) == y).mean() > 0.95
    assert model.scores(pa.array(["kara " * 3000 + "vilescum"]))[0] > 0.5 > model.scores(pa.array(["kara " * 3000]))[0]
    assert model.scores(pa.array(["all of foulbeastly kara"]))[0] > 0.5


def test_operator(spark):
    rows = corpus(600, 3)
    docs = [(i, t, "clash", None) for i, t, _ in rows] + [(9001, "", None, None), (9002, None, None, None), (None, "vilescum", None, None), (9003, "same", None, None), (9003, "same", None, None), (9004, "z" * 200_000, None, None)]
    df = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    net = T.fit(df, labels)
    got = T.score(df, net).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert len({r.score for r in got if r.doc_id in (9001, 9002)}) == 1
    kept = T.keep_clean(df, net)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)
    # only labels outside the held-out fold count
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 1) for i, _, y in rows], labels.schema)
    assert (T.fit(df, flipped).p["o"] == net.p["o"]).all()


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a", None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.score(df, T.fit(df, none)).collect()] == [0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.score for r in T.score(df, T.fit(df, one)).collect()] == [1.0]
    assert T.score(df.limit(0), 0.0).collect() == []


def test_long_texts_train_where_short_ones_are_too_few(spark):
    """Toxic texts of more than most_chars characters only: pieces of them train, and no constant takes their place."""
    rng, plain = random.Random(5), ["kara", "lone", "miso", "tura", "kane"]
    docs, labels = [], []
    for i in range(200):
        toxic = i % 2
        words = [rng.choice(plain + ["vilescum"] * toxic) for _ in range(600 if toxic else 60)]
        docs.append((i, " ".join(words), None, None))
        labels.append((i, toxic))
    net = T.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), most_chars=1000, few=40)
    assert isinstance(net, T.Network)
    assert net.scores(pa.array(["kara vilescum lone vilescum"]))[0] > 0.5 > net.scores(pa.array(["kara lone miso"]))[0]


def test_forward_as_by_plain_loops(model):
    """The network word by word and number by number, for windows of several texts."""
    import math

    p, sig = model.p, lambda x: 1 / (1 + math.exp(-x))
    texts = ["vilescum kara", "kara mira neso lotu " * 20, "", "Unknownword"]

    def plain(text):
        words = text.lower().split()
        if not words:
            return None
        vocabulary, codes, _ = T.split_words(pa.array([text]))
        vectors = model.inputs(T.Words(vocabulary))
        out = []
        starts = range(0, max(1, len(words) - 48 + 24), 24)
        for s in starts:
            s = min(s, max(0, len(words) - 48))
            xs = [vectors[c] for c in codes[s : s + 48]]
            states = [[0.0] * 16 for _ in xs]
            for side, d in enumerate("fb"):
                h = [0.0] * 8
                for t in range(len(xs)) if d == "f" else reversed(range(len(xs))):
                    x = [sum(float(a) * float(w) for a, w in zip(xs[t], p["W" + d][:, j])) + float(p["b" + d][j]) for j in range(24)]
                    a = [sum(h[i] * float(p["U" + d][i, j]) for i in range(8)) for j in range(24)]
                    z, r = [sig(x[j] + a[j]) for j in range(8)], [sig(x[8 + j] + a[8 + j]) for j in range(8)]
                    new = [math.tanh(x[16 + j] + r[j] * a[16 + j]) for j in range(8)]
                    h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(8)]
                    states[t][8 * side : 8 * side + 8] = h
            raw = [sum(math.tanh(sum(st[i] * float(p["A"][i, k]) for i in range(16))) * float(p["v"][k]) for k in range(8)) for st in states]
            share = [math.exp(x - max(raw)) for x in raw]
            pooled = [sum(w * st[i] for w, st in zip(share, states)) / sum(share) for i in range(16)]
            out.append(sum(pooled[i] * float(p["o"][i]) for i in range(16)) + float(p["c"][0]))
        return max(out)

    got = model.logits(pa.array(texts))
    for text, logit in zip(texts, got):
        if text:
            assert logit == pytest.approx(plain(text), rel=1e-3, abs=1e-3)


def test_runs_hold_whole_texts():
    text = np.repeat(np.arange(50), np.random.default_rng(2).integers(1, 30, 50))
    for most in (1, 7, 100, 10**6):
        runs = list(T.text_runs(text, most))
        assert [a for a, _ in runs] == [0, *(b for _, b in runs[:-1])] and runs[-1][1] == len(text)
        assert not any(a and text[a - 1] == text[a] for a, _ in runs) and all(b - a <= most + 60 for a, b in runs)
    assert list(T.text_runs(text[:0], 5)) == []
