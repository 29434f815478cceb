"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its own vector (zero for words outside the vocabulary) beside the mean vector of its character
3- to 5-grams, both ends marked. Windows of 48 words, each overlapping the next by half, cover the whole text; a
window's hidden states of both directions are pooled by attention into one logit, and a text scores as its highest
window does. Labels hold for texts, so training takes the window that scores highest now, epoch by epoch. The vectors
start from log-odds of labelled texts; a last step, on texts that training did not see, fits scale and offset of the
logit to the share of toxic labels.

Training reads at most ``per_class`` labelled texts of each label (the smallest by hash of the id among those of at most
``most_chars`` characters), of ids whose crc32 modulo 5 is not 0. A label with fewer than ``few`` such texts is filled up
to that many with longer ones, of which ``most_chars`` characters in five evenly spaced pieces are read. It runs in one
task on an executor, over that bounded sample, and starts again there if it is lost; the driver gets the parameters, a
few MB. Scoring reads all of every text. Each input is the text alone. Empty and null texts have one window without
words. Equal texts have equal scores; rows that repeat and null ids are scored each, a null id counting as empty text in
the fold (so held out) and never training. Without labels of both kinds every score is the share of toxic labels (0 if
there are none). An empty table gives no rows. Other columns are not read; ``keep_clean`` keeps them all.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.llm.common import give_back, materialize, scratch
from adjudica.llm.units import slices

WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 48, 24, 8, 8, 8, 8
VOCABULARY, LEAST, GRAM_BITS, PER_CLASS, MOST_CHARS, FEW = 20_000, 4, 14, 1_500, 10_000, 50
EPOCHS, STEPS, BATCH, RATE, DECAY, FOLD = 5, 180, 64, 0.01, 0.02, 5
CHUNK = 2048
MIX = np.uint64(0x9E3779B97F4A7C15)
SLICE = 2 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the words of all texts as numbers, and where each text's words start (with the end)."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL\pN]+", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
    coded = lists.values.dictionary_encode()
    codes, offsets = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # what splitting an empty text gives
        words = codes != blank
        offsets = np.concatenate([[0], np.cumsum(words)])[offsets]
        codes = codes[words]
    return coded.dictionary, codes, offsets


class Words:
    """Hashes of distinct words and of their character n-grams."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_string())
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
        self.n, sizes = len(words), np.diff(at) + 2
        ends = np.cumsum(sizes)
        starts = ends - sizes
        marked = np.ones(int(sizes.sum()), np.uint64)
        owner = np.repeat(np.arange(self.n), sizes - 2)
        marked[np.arange(len(raw)) + 2 * owner + 1] = raw
        marked[ends - 1] = 2
        place = np.arange(len(marked)) - np.repeat(starts, sizes)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max(initial=1)), 0x100000001B3, np.uint64))
            self.hash = np.add.reduceat(marked * powers[place], starts) if self.n else np.zeros(0, np.uint64)
            self.grams = []
            for n in (3, 4, 5):
                counts = np.maximum(0, sizes - n + 1)
                some = np.flatnonzero(counts)
                first = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                packed = np.full(len(first), n, np.uint64)
                for k in range(n):
                    packed = packed << np.uint64(8) | marked[first + k]
                self.grams.append((some, (np.cumsum(counts) - counts)[some], (packed * MIX >> np.uint64(64 - GRAM_BITS)).astype(np.int64)))
        self.total = sum(np.maximum(0, sizes - n + 1) for n in (3, 4, 5)).astype(np.float32)

    def mean(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, table.shape[1]), np.float32)
        for some, at, grams in self.grams:
            if len(some):
                out[some] += np.add.reduceat(table[grams], at, axis=0)
        return out / np.maximum(self.total, 1)[:, None]  # the blank word has no n-grams

    def spread(self, rows: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        """The gradient of ``mean``: what the given words' gradients add to each n-gram's row."""
        out = np.zeros((size, weight.shape[1]), np.float32)
        full = np.zeros((self.n, weight.shape[1]), np.float32)
        full[rows] = weight / self.total[rows, None]
        for some, at, grams in self.grams:
            if len(some):
                counts = np.diff(np.append(at, len(grams)))
                own = full[some]
                live = np.flatnonzero(np.abs(own).sum(axis=1))
                keep = np.isin(np.arange(len(some)), live).repeat(counts)
                np.add.at(out, grams[keep], np.repeat(own, counts, axis=0)[keep])
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def windows_of(offsets: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of all windows; the last one of a text ends where the text ends."""
    sizes = np.diff(offsets)
    counts = 1 + np.maximum(0, -(-(sizes - window) // stride))
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.minimum(nth * stride, np.maximum(0, sizes[text] - window))
    return text, offsets[text] + start, np.minimum(sizes[text], window)


class Network:
    """Parameters by name: word and gram vectors; per direction W, U, b (gates in the order z, r, n); attention A, v;
    output o, c; scale and offset of the calibrated logit."""

    def __init__(self, params: dict[str, np.ndarray], known: np.ndarray):
        self.p, self.known = params, known

    def rows(self, words: Words) -> np.ndarray:
        """Rows of the word vectors: 0 for words outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.known, words.hash), len(self.known) - 1)
        return np.where(self.known[at] == words.hash, at + 1, 0) if len(self.known) else np.zeros(words.n, np.int64)

    def inputs(self, words: Words) -> np.ndarray:
        return np.concatenate([self.p["word"][self.rows(words)], words.mean(self.p["gram"])], axis=1)

    def gates(self, inputs: np.ndarray) -> list[np.ndarray]:
        """What each distinct word adds to the gates, per direction, with a row of zeros at the end for no word."""
        return [np.concatenate([inputs @ self.p["W" + d] + self.p["b" + d], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"]

    def forward(self, gates: list[np.ndarray], index: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: index (windows, words) into the gates' rows, live: which of them are words."""
        n, steps = index.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        even = bool(live.all())
        for side, d in enumerate("fb"):
            h, weights = np.zeros((n, HIDDEN), np.float32), self.p["U" + d]
            for t in range(steps) if d == "f" else reversed(range(steps)):
                x, a = gates[side][index[:, t]], h @ weights
                zr = sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r, an = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN :]
                new = 2 * sigmoid(2 * (x[:, 2 * HIDDEN :] + r * an)) - 1
                after = new + z * (h - new)
                if not even:
                    after = np.where(live[:, t, None], after, h)
                if keep is not None:
                    keep.append((d, t, h, z, r, new, an))
                states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h = after
        inner = np.tanh(states @ self.p["A"])
        raw = np.where(live.T, inner @ self.p["v"], -np.float32(1e30))
        share = np.exp(raw - raw.max(axis=0, initial=-1e30)) * live.T
        share /= np.maximum(share.sum(axis=0), 1e-30)
        pooled = (share[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep += [states, inner, share, pooled]
        return pooled @ self.p["o"] + self.p["c"][0]

    def backward(self, error: np.ndarray, index: np.ndarray, live: np.ndarray, gates: list[np.ndarray], keep: list) -> dict[str, np.ndarray]:
        """Gradients of sum(error * logit); "gf" and "gb" are those of the gates' rows."""
        states, inner, share, pooled = keep[-4:]
        p, g = self.p, {}
        g["o"], g["c"] = pooled.T @ error, np.array([error.sum()], np.float32)
        d_pooled = error[:, None] * p["o"]
        d_states = share[:, :, None] * d_pooled
        d_share = (states * d_pooled).sum(axis=2)
        d_raw = share * (d_share - (share * d_share).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", d_raw, inner)
        d_inner = d_raw[:, :, None] * p["v"] * (1 - inner**2)
        g["A"] = np.einsum("tnh,tna->ha", states, d_inner)
        d_states += d_inner @ p["A"].T
        for side, d in enumerate("fb"):
            g["g" + d], g["U" + d] = np.zeros_like(gates[side]), np.zeros_like(p["U" + d])
            d_h = np.zeros((len(error), HIDDEN), np.float32)
            for _, t, h, z, r, new, an in reversed([k for k in keep[:-4] if k[0] == d]):
                d_after = d_h + d_states[t, :, side * HIDDEN : (side + 1) * HIDDEN]
                on = live[:, t, None]
                d_new = d_after * (1 - z) * (1 - new**2) * on
                d_z = d_after * (h - new) * z * (1 - z) * on
                d_r = d_new * an * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g["U" + d] += h.T @ d_a
                np.add.at(g["g" + d], index[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
                d_h = np.where(on, d_after * z, d_after) + d_a @ p["U" + d].T
        return g

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The highest window's logit of each text."""
        vocabulary, codes, offsets = split_words(texts)
        with np.errstate(over="ignore"):
            gates = self.gates(self.inputs(Words(vocabulary)))
            text, start, size = windows_of(offsets)
            out, order = np.empty(len(text), np.float32), np.argsort(size, kind="stable")
            codes = np.append(codes, np.int32(0))
            for at in range(0, len(order), CHUNK):
                own = order[at : at + CHUNK]
                index, live = window_index(codes, start[own], size[own], len(vocabulary))
                out[own] = self.forward(gates, index, live)
        return np.maximum.reduceat(out, np.flatnonzero(np.diff(text, prepend=-1))) if len(text) else out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.p["scale"][0] * self.logits(texts).astype(np.float64) + self.p["offset"][0])


def window_index(codes: np.ndarray, start: np.ndarray, size: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(max(1, int(size.max(initial=0))))
    live = steps < size[:, None]
    return np.where(live, codes[np.minimum(start[:, None] + steps, len(codes) - 1)], none), live


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Of a text with the feature; drawn towards 0 where few texts have it."""
    seen = toxic + clean
    return (np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))) * np.maximum(0, seen - 2) / (seen + 6)


def text_runs(text: np.ndarray, most: int):
    """(start, end) of runs of whole texts, of about ``most`` rows each, from the ascending number of each row's text."""
    firsts = np.flatnonzero(np.diff(text, prepend=-1))
    cuts = firsts[np.unique(firsts // most, return_index=True)[1]].tolist()
    return zip(cuts, [*cuts[1:], len(text)])


def first_params(vocabulary: pa.Array, codes: np.ndarray, offsets: np.ndarray, labels: np.ndarray, words: Words, rng) -> tuple[dict, np.ndarray]:
    n_toxic, n_clean = int(labels.sum()), int((1 - labels).sum())
    text = np.repeat(np.arange(len(labels)), np.diff(offsets))
    pairs = np.unique(text * np.int64(len(vocabulary) or 1) + codes)
    word, label = pairs % max(1, len(vocabulary)), labels[pairs // max(1, len(vocabulary))]
    toxic, clean = (np.bincount(word[label == k], minlength=len(vocabulary)) for k in (1, 0))
    kept = np.argsort(-(toxic + clean), kind="stable")[:VOCABULARY]
    kept = kept[(toxic + clean)[kept] >= LEAST]
    order = kept[np.argsort(words.hash[kept], kind="stable")]
    first = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    p = {"word": first(len(order) + 1, WORD_DIM) * 0.1, "gram": first(1 << GRAM_BITS, CHAR_DIM) * 0.1}
    p["word"][0] = 0
    p["word"][1:, 0] += log_odds(toxic, clean, n_toxic, n_clean)[order]
    in_text = {}
    for some, at, grams in words.grams:
        owner = np.repeat(some, np.diff(np.append(at, len(grams))))
        in_text[len(in_text)] = (owner, grams)
    owner, grams = (np.concatenate([x[k] for x in in_text.values()]) for k in (0, 1))
    by_word = np.argsort(owner, kind="stable")
    owner, grams = owner[by_word], grams[by_word]
    counts = np.bincount(owner, minlength=len(vocabulary))
    begin = np.cumsum(counts) - counts
    votes = [np.zeros(1 << GRAM_BITS), np.zeros(1 << GRAM_BITS)]
    doc = pairs // max(1, len(vocabulary))
    for at, end in text_runs(doc, 40_000):
        w, d = word[at:end], doc[at:end]
        flat = np.repeat(begin[w], counts[w]) + np.arange(counts[w].sum()) - np.repeat(np.cumsum(counts[w]) - counts[w], counts[w])
        seen = np.unique(np.repeat(d, counts[w]) * np.int64(1 << GRAM_BITS) + grams[flat])
        for k in (0, 1):
            votes[k] += np.bincount(seen[labels[seen >> GRAM_BITS] == k] & (1 << GRAM_BITS) - 1, minlength=1 << GRAM_BITS)
    p["gram"][:, 0] += log_odds(votes[1], votes[0], n_toxic, n_clean)
    for d in "fb":
        p["W" + d], p["U" + d], p["b" + d] = first(WORD_DIM + CHAR_DIM, 3 * HIDDEN), first(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
    p |= {"A": first(2 * HIDDEN, ATTEND), "v": first(ATTEND), "o": first(2 * HIDDEN), "c": np.zeros(1, np.float32)}
    return p | {"scale": np.ones(1), "offset": np.zeros(1)}, words.hash[order]


def train(texts: list[str], labels: list[int], prior: float | None = None, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fits the network to labelled texts; ``prior`` is the share of toxic texts where it will be used."""
    labels, rng = np.array(labels, np.int64), np.random.default_rng(seed)
    prior = float(labels.mean()) if prior is None and len(labels) else prior or 0.0
    held = rng.random(len(labels)) < 0.2
    fit = np.flatnonzero(~held) if 0 < labels[~held].mean() < 1 and 0 < labels[held].mean() < 1 else np.arange(len(labels))
    check = np.flatnonzero(held) if len(fit) < len(labels) else fit
    own = pa.array([texts[i] for i in fit], pa.large_string())
    vocabulary, codes, offsets = split_words(own)
    words, target = Words(vocabulary), labels[fit]
    params, known = first_params(vocabulary, codes, offsets, target, words, rng)
    net, codes = Network(params, known), np.append(codes, np.int32(0))
    rows, trained = net.rows(words), [k for k in params if k not in ("scale", "offset")]
    moments = {k: [np.zeros_like(params[k]), np.zeros_like(params[k])] for k in trained}
    text, start, size = windows_of(offsets)
    weight, step = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean())).astype(np.float32), 0
    epochs = min(40, max(epochs, STEPS * BATCH // len(fit)))  # small samples are read more often
    for epoch in range(epochs):
        with np.errstate(over="ignore"):
            gates, logit = net.gates(net.inputs(words)), np.empty(len(text), np.float32)
            for at in range(0, len(text), CHUNK):
                index, live = window_index(codes, start[at : at + CHUNK], size[at : at + CHUNK], len(vocabulary))
                logit[at : at + CHUNK] = net.forward(gates, index, live)
        best = np.lexsort((-logit, text))[np.flatnonzero(np.diff(text, prepend=-1))]
        rate = RATE * (1 - epoch / epochs)
        for some in np.array_split(rng.permutation(best), max(1, len(best) // BATCH)):
            index, live = window_index(codes, start[some], size[some], len(vocabulary))
            used, index = np.unique(index, return_inverse=True)
            index, real = index.reshape(live.shape), used[used < len(vocabulary)]
            inputs = np.concatenate([params["word"][rows[real]], words_mean(words, real, params["gram"])], axis=1)
            gates, keep = net.gates(inputs), []
            error = sigmoid(net.forward(gates, index, live, keep)) - target[text[some]]
            grad = net.backward((error * weight[text[some]] / len(some)).astype(np.float32), index, live, gates, keep)
            d_inputs = np.zeros_like(inputs)
            for d in "fb":
                own_gates = grad.pop("g" + d)[: len(real)]
                grad["W" + d], grad["b" + d] = inputs.T @ own_gates, own_gates.sum(axis=0)
                d_inputs += own_gates @ params["W" + d].T
            grad["word"] = np.zeros_like(params["word"])
            np.add.at(grad["word"], rows[real], d_inputs[:, :WORD_DIM])
            grad["word"][0] = 0
            grad["gram"] = words.spread(real, d_inputs[:, WORD_DIM:], 1 << GRAM_BITS)
            step += 1
            for k in trained:
                m, v = moments[k]
                m += 0.1 * (grad[k] - m)
                v += 0.001 * (grad[k] ** 2 - v)
                if k in ("word", "gram", "Wf", "Wb"):
                    params[k] *= np.float32(1 - DECAY * rate)
                params[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    x, y = net.logits(pa.array([texts[i] for i in check], pa.large_string())).astype(np.float64), labels[check]
    params["scale"], params["offset"] = calibrated(x, y, prior)
    return net


def words_mean(words: Words, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``words.mean`` for some words."""
    wanted = np.zeros(words.n, bool)
    wanted[rows] = True
    out = np.zeros((words.n, table.shape[1]), np.float32)
    for some, at, grams in words.grams:
        use = wanted[some]
        if use.any():
            counts = np.diff(np.append(at, len(grams)))
            own = counts[use]
            out[some[use]] += np.add.reduceat(table[grams[np.repeat(use, counts)]], np.cumsum(own) - own, axis=0)
    return out[rows] / words.total[rows, None]


def calibrated(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Scale and offset of a logistic curve through the logits, weighted to the prior."""
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    middle, width = x.mean(), max(1e-6, x.std())
    x, a, b = (x - middle) / width, 1.0, 0.0
    for _ in range(2000):
        error = weight * (sigmoid(np.clip(a * x + b, -30, 30)) - y) / len(y)
        a, b = max(0.1, a - 2 * ((error * x).sum() + 0.002 * a)), b - 2 * error.sum()
    return np.array([a / width]), np.array([b - a * middle / width])


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLD


def sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, most_chars: int, few: int) -> DataFrame:
    """(id, label, long, text) of the texts to train on: one row per id, the smallest of its texts."""
    own = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = documents.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sized = known.select("id", (F.length("text") > most_chars).alias("long")).join(own, "id").groupBy("id", "label").agg(F.min("long").alias("long"))
    sized = materialize(sized, "labelled")
    # a hash below this share of all finds about twice what is wanted, however many rows there are
    near = F.lit(False)
    for r in sized.groupBy("label", "long").agg(F.count("*").alias("n")).collect():  # four rows
        most = few if r.long else per_class
        share = min(1.0, 2 * max(most, 100) / r.n)
        near = near | ((F.col("label") == r.label) & (F.col("long") == r.long) & (F.xxhash64("id") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))))
    nth = F.row_number().over(Window.partitionBy("label", "long").orderBy(F.xxhash64("id"), "id"))
    ids = sized.filter(near).withColumn("nth", nth).filter(F.col("nth") <= F.when(F.col("long"), few).otherwise(per_class))
    ids = ids.drop("nth")  # 2 * (per_class + few) rows at most
    texts = known.join(F.broadcast(ids), "id").filter(F.col("long") == (F.length("text") > most_chars))
    step = F.floor(F.length("text") / 5).cast("int")
    pieces = F.concat_ws(" ", *[F.substring(F.col("text"), step * i + 1, F.lit(most_chars // 5)) for i in range(5)])
    return texts.withColumn("text", F.when(F.col("long"), pieces).otherwise(F.col("text"))).groupBy("id", "label", "long").agg(F.min("text").alias("text"))


def freeze(net: Network) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, known=net.known, **net.p)
    return out.getvalue()


def thaw(raw: bytes) -> Network:
    with np.load(io.BytesIO(raw)) as held:
        return Network({k: held[k] for k in held if k != "known"}, held["known"])


def trainer(prior: float, few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        short = {label: sum(r["label"] == label and not r["long"] for r in rows) for label in (0, 1)}
        rows.sort(key=lambda r: (r["long"], str(r["id"])))
        used, seen = [], {0: 0, 1: 0}
        for r in rows:
            if not r["long"] or short[r["label"]] + seen[r["label"]] < few:
                seen[r["label"]] += r["long"]
                used.append(r)
        used.sort(key=lambda r: str(r["id"]))
        made = [freeze(train([r["text"] for r in used], [r["label"] for r in used], prior))] if len({r["label"] for r in used}) == 2 else []
        del rows, used
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["model"])

    return run


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, few: int = FEW) -> Network | float:
    """Trained on a bounded sample; the share of toxic labels instead if only one kind is there."""
    own = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    shares = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    toxic, clean = shares.get(1, 0), shares.get(0, 0)
    if not toxic or not clean:
        return float(bool(toxic))
    with scratch(documents.sparkSession):
        rows = sample(documents, labels, id_col, text_col, label_col, per_class, most_chars, few)
        made = materialize(rows.repartition(1).mapInArrow(trainer(toxic / (toxic + clean), few), "model binary"), "toxicity-model")
        models = made.collect()  # one at most
    return thaw(models[0].model) if models else toxic / (toxic + clean)


def score_column(text: Column, model: Network | float) -> Column:
    if not isinstance(model, Network):
        return F.lit(float(model))
    held = text_spark_broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        net = Network(*held.value)
        parts = [net.scores(texts.slice(at, n)) for at, n in slices(texts, SLICE)]
        give_back()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return scored(text)


def text_spark_broadcast(model: Network):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast((model.p, model.known))


def score(df: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = df.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), score_column(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(df: DataFrame, model: Network | float, text_col: str = "text") -> DataFrame:
    """The rows below one half, with the columns they had."""
    scored = df.select(F.struct("*").alias("row"), score_column(F.col(text_col), model).alias("score"))
    return scored.filter("score < 0.5").select("row.*")
