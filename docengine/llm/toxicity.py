"""Operator 4, toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the embedding of its hash beside the mean of the embeddings of its character n-grams (of "<word>", so
that beginnings and ends count). Windows of WINDOW words, overlapping by half, run through a GRU in either direction;
attention pools the states of a window into one score. A document's score is that of its highest window, mapped to a
probability by two numbers found on training documents that the network wasn't fitted on.

Only documents are labelled, so in the positive ones a window counts as positive at first, and after each epoch those
that score low beside the highest of their document count as negative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .shared import held_out, text_of

WINDOW = 48
SAMPLE = 2000  # labelled rows of each class at most, those with the smallest hash of their id
SAMPLE_CHARS = 1 << 16  # of each of them that are learnt from; all of every text is scored
SAMPLE_WINDOWS = 14_000  # of either class at most in training
_WORD_BUCKETS, _GRAM_BUCKETS = 1 << 13, 1 << 15
_D, _H = 8, 8
_GRAMS = (3, 4, 5)
_LEAST_SHARE = 0.2  # of positives, when errors on the documents kept apart are weighed
_UPDATES = 600  # of the weights at least
_CHUNK = 4096  # windows run at a time
_BYTES = 1 << 22  # text read at a time


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Words:
    """Distinct words of a column, with bucket of each and buckets of their n-grams; word number of each token."""

    def __init__(self, column):
        data, offsets = T.flat(column)
        starts, ends, self.first = T.spans(data, offsets)
        hashes, begin, self.token = np.unique(T.word_hashes(data, starts, ends, True), return_index=True, return_inverse=True)
        self.bucket = (hashes % np.uint64(_WORD_BUCKETS)).astype(np.int64)
        size = ends[begin] - starts[begin]
        at = np.cumsum(size + 2) - (size + 2)  # places of the words, each between "<" and ">"
        text = np.full(int((size + 2).sum()), ord(">"), np.uint64)
        text[at] = ord("<")
        inner = np.repeat(starts[begin] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        low = data[inner]
        low = np.where((low >= 65) & (low <= 90), low + 32, low)
        text[np.arange(int(size.sum())) + np.repeat(2 * np.arange(len(size)) + 1, size)] = low
        counts = [np.maximum(size + 2 - n + 1, 0) for n in _GRAMS]
        self.gram_first = np.concatenate([[0], np.cumsum(sum(counts))])
        self.grams, to = np.empty(self.gram_first[-1], np.int32), self.gram_first[:-1].copy()
        for n, count in zip(_GRAMS, counts):  # straight to their places, word by word and then by length
            own = np.repeat(np.arange(len(size), dtype=np.int32), count)
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            place, h = at[own] + nth, np.full(len(own), n, np.uint64)
            for k in range(n):
                h *= np.uint64(0x100000001B3)
                h += text[place + k]
            self.grams[to[own] + nth] = T.mix(h) % np.uint64(_GRAM_BUCKETS)
            to += count

    def windows(self, width: int = WINDOW):
        """Row, first token and length of each window; half overlap; a row without words has one empty window."""
        n = np.diff(self.first)
        half = width // 2
        counts = np.maximum(1, -(-n // half) - 1)
        row = np.repeat(np.arange(len(n)), counts)
        begin = self.first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * half
        return row, begin, np.minimum(width, self.first[row + 1] - begin)


class Model:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"word": f(_WORD_BUCKETS, _D, by=0.1), "gram": f(_GRAM_BUCKETS, _D, by=0.3), "att": f(2 * _H, by=0.1), "out": f(2 * _H, by=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": f(2 * _D, 3 * _H, by=0.25), f"u{d}": f(_H, 3 * _H, by=0.25), f"c{d}": np.zeros(3 * _H, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: Words) -> np.ndarray:
        p = self.p
        grams = np.zeros((len(words.bucket), _D), np.float32)
        step = 1 << 17
        for i in range(0, len(words.bucket), step):
            j = min(i + step, len(words.bucket))
            a, b = words.gram_first[i], words.gram_first[j]
            begin = words.gram_first[i:j] - a
            grams[i:j] = np.add.reduceat(p["gram"][words.grams[a:b]], begin, axis=0) / np.diff(np.append(begin, b - a))[:, None]
        return np.concatenate([p["word"][words.bucket], grams], 1)

    def run(self, gates: dict, token: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window. gates: of each distinct word and direction; token, mask: (time, windows)."""
        p, (steps, n) = self.p, token.shape
        states, cache = np.empty((steps, n, 2 * _H), np.float32), {}
        for d, times in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h, own = np.zeros((n, _H), np.float32), slice(0, _H) if d == "f" else slice(_H, 2 * _H)
            u = p["u" + d]
            for t in times:
                x, y = gates[d][token[t]], h @ u
                zr = sigmoid(x[:, : 2 * _H] + y[:, : 2 * _H])
                z, r = zr[:, :_H], zr[:, _H:]
                c = np.tanh(x[:, 2 * _H :] + r * y[:, 2 * _H :])
                new = h + mask[t][:, None] * (1 - z) * (c - h)
                if keep:
                    cache[d, t] = (h, z, r, c, y[:, 2 * _H :])
                h = new
                states[t, :, own] = h
        a = np.tanh(states) @ p["att"] + np.where(mask > 0, 0, -1e9)
        a = np.exp(a - a.max(0)) * (mask > 0)
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", a, states)
        logit = pooled @ p["out"] + p["bias"]
        return (logit, states, a, pooled, cache) if keep else logit

    def gates(self, x: np.ndarray) -> dict:
        return {d: x @ self.p["w" + d] + self.p["c" + d] for d in "fb"}

    def gradient(self, words: Words, token: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict:
        """Of the mean logistic loss of a batch of windows. token: numbers of distinct words."""
        p, (steps, n) = self.p, token.shape
        some, local = np.unique(token, return_inverse=True)
        local = local.reshape(token.shape)
        lengths = words.gram_first[some + 1] - words.gram_first[some]
        place = np.repeat(words.gram_first[some] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        grams = words.grams[place]
        mean = np.add.reduceat(p["gram"][grams], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
        x = np.concatenate([p["word"][words.bucket[some]], mean], 1)
        logit, states, a, pooled, cache = self.run(self.gates(x), local, mask, True)
        g: dict = {}
        dl = ((sigmoid(logit) - label) / n).astype(np.float32)
        g["bias"], g["out"] = dl.sum(keepdims=True), pooled.T @ dl
        dp = dl[:, None] * p["out"]
        ds = a[:, :, None] * dp
        da = np.einsum("tnk,nk->tn", states, dp)
        da = a * (da - (a * da).sum(0))
        th = np.tanh(states)
        g["att"] = np.einsum("tn,tnk->k", da, th)
        ds += da[:, :, None] * p["att"] * (1 - th**2)
        dx = np.zeros_like(x)
        for d, times in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            own, u = slice(0, _H) if d == "f" else slice(_H, 2 * _H), p["u" + d]
            dh, du, every = np.zeros((n, _H), np.float32), np.zeros_like(u), np.empty((steps, n, 3 * _H), np.float32)
            for t in times:
                h, z, r, c, yc = cache[d, t]
                dh = dh + ds[t, :, own]
                m = mask[t][:, None]
                dc = dh * m * (1 - z) * (1 - c**2)
                dz = -dh * m * (c - h) * z * (1 - z)
                dr = dc * yc * r * (1 - r)
                dy = np.concatenate([dz, dr, dc * r], 1)
                du += h.T @ dy
                every[t] = np.concatenate([dz, dr, dc], 1)
                dh = dh * (1 - m * (1 - z)) + dy @ u.T
            flat, at = every.reshape(-1, 3 * _H), local.reshape(-1)
            dg = np.stack([np.bincount(at, flat[:, k], len(some)) for k in range(3 * _H)], 1).astype(np.float32)
            g["u" + d], g["c" + d], g["w" + d] = du, flat.sum(0), x.T @ dg
            dx += dg @ p["w" + d].T
        g["word"] = (words.bucket[some], dx[:, :_D])
        g["gram"] = (grams, np.repeat(dx[:, _D:] / lengths[:, None], lengths, axis=0).astype(np.float32))
        return g

    def logits(self, column) -> np.ndarray:
        """The highest window's logit of each row."""
        words = Words(column)
        row, begin, length = words.windows()
        gates = self.gates(self.inputs(words))
        gates = {d: np.concatenate([x, np.zeros((1, 3 * _H), np.float32)]) for d, x in gates.items()}
        out = np.full(len(words.first) - 1, -np.inf)
        order = np.argsort(length, kind="stable")  # windows of like length together: short ones need few steps
        for i in range(0, len(order), _CHUNK):
            at = order[i : i + _CHUNK]
            token, mask = _laid_out(words.token, begin[at], length[at], len(gates["f"]) - 1)
            np.maximum.at(out, row[at], self.run(gates, token, mask))
        return out

    def scores(self, column) -> np.ndarray:
        return sigmoid(self.scale * self.logits(column) + self.shift)


def _laid_out(token: np.ndarray, begin: np.ndarray, length: np.ndarray, other: int):
    """(time, windows) word numbers and mask; places past a window have number `other`."""
    steps = max(1, int(length.max()))
    t = np.arange(steps)[:, None]
    inside = t < length
    at = np.where(inside, begin + t, 0)
    return np.where(inside, token[at] if len(token) else 0, other), inside.astype(np.float32)


def _adam(params: dict, grads: dict, state: dict, rate: float) -> None:
    state["t"] = state.get("t", 0) + 1
    for k, g in grads.items():
        if isinstance(g, tuple):  # rows of an embedding: AdaGrad
            rows, at = np.unique(g[0], return_inverse=True)
            total = np.stack([np.bincount(at, g[1][:, j], len(rows)) for j in range(g[1].shape[1])], 1)
            s = state.setdefault(k, np.full(len(params[k]), 1e-8))
            s[rows] += (total**2).mean(1)
            params[k][rows] -= (8 * rate * total / np.sqrt(s[rows])[:, None]).astype(np.float32)
        else:
            m, v = state.setdefault(k, [np.zeros(g.shape), np.zeros(g.shape)])
            m += 0.1 * (g - m)
            v += 0.001 * (g**2 - v)
            params[k] -= (rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)).astype(np.float32)


def fit(texts: list[str], labels: list[int], share: float = 0.5, seed: int = 1, windows: int = SAMPLE_WINDOWS) -> Model:
    """A model of these texts; one text in five is kept to map scores to probabilities. share: of positives in all.

    At most `windows` windows of either class are learnt from.
    """
    model, r = Model(seed), np.random.default_rng(seed)
    labels = np.array(labels, np.int64)
    if len(labels) == 0 or labels.min() == labels.max():  # nothing to tell apart
        model.scale, model.shift = 0.0, (-3.0 if not len(labels) or not labels[0] else 3.0)
        return model
    apart = r.permutation(len(labels)) % 5 == 0
    words = Words(pa.array([t for t, a in zip(texts, apart) if not a], pa.string()))
    label = labels[~apart]
    row, begin, length = words.windows()
    of = [np.flatnonzero((label[row] == k) & (length > 0)) for k in (0, 1)]
    own = r.permutation(of[1])[:windows]
    against = r.permutation(of[0])[:windows]
    target, state, batch = label[row].astype(np.float32), {}, 256
    epochs = int(np.clip(np.ceil(_UPDATES * batch / max(1, len(own) + len(against))), 5, 40))

    def logits(at: np.ndarray) -> np.ndarray:
        cut = np.array_split(at, max(1, len(at) // _CHUNK))
        return np.concatenate([model.run(gates, *_laid_out(words.token, begin[x], length[x], 0)) for x in cut]) if len(at) else np.zeros(0)

    for epoch in range(epochs):
        use = r.permutation(np.concatenate([own, against]))
        for i in range(0, len(use), batch):
            at = use[i : i + batch]
            token, mask = _laid_out(words.token, begin[at], length[at], 0)
            _adam(model.p, model.gradient(words, token, mask, target[at]), state, 0.01 if epoch < epochs - 2 else 0.003)
        if epoch + 1 < epochs:
            gates = model.gates(model.inputs(words))
            logit = logits(own)
            top = np.full(len(label), -np.inf)
            np.maximum.at(top, row[own], logit)
            target[own] = (logit >= np.minimum(top[row[own]] - 1.0, 0.0)) | (logit >= top[row[own]])
            if len(of[0]) > windows:  # negatives that score highest, and others
                hard = of[0][np.argsort(-logits(of[0]), kind="stable")[: windows // 4]]
                against = np.concatenate([hard, r.permutation(of[0])[: windows * 3 // 4]])
    held = np.flatnonzero(apart)
    x = model.logits(pa.array([texts[k] for k in held], pa.string()))
    y = labels[held]
    w = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    # Weighted errors if the first k are called negative; the cut is in the middle of the range that makes fewest.
    wrong = np.append(0, np.cumsum(w * (y == 1))) + np.append(np.cumsum((w * (y == 0))[::-1])[::-1], 0)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    low, high = x[max(best[0] - 1, 0)], x[min(best[-1], len(x) - 1)]
    gap = np.median(x[y == 1]) - np.median(x[y == 0]) if 0 < y.sum() < len(y) else 1.0
    model.scale = 6 / max(gap, 0.1)
    model.shift = -model.scale * (low + high) / 2
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[tuple[int, str, int]], float]:
    """(doc_id, text, label) of at most `sample` labelled ids a class whose crc32(doc_id as text) mod 5 isn't 0.

    Of each text at most `chars` characters are collected, so that the driver's share is bounded; of rows with one id the
    least text counts.

    Also the share of positives among all such rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picked = chosen[0].unionByName(chosen[1]).collect()  # two numbers for at most 2 * sample rows
    ids = docs.sparkSession.createDataFrame([tuple(x) for x in picked], "doc_id long, toxic int")
    rows = text_of(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.substring("text", 1, chars)).alias("text")).collect()
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    return sorted((x["doc_id"], x["text"], x["toxic"]) for x in rows), max(share or 0.0, _LEAST_SHARE)


def _scored(model):
    def run(batches):
        for batch in batches:
            for part in T.slices(batch, _BYTES):
                score = model.value.scores(part.column("text"))
                held = part.column("held_out")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), held, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) for each row of docs.

    Learns from at most `sample` rows a class of those that aren't held out. Null and empty texts are scored as one
    window without words. Labels with nulls are not used; of several labels of a document the larger counts. Repeated
    rows are each scored. Without labels of both classes all scores are alike.
    """
    rows, share = training_rows(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast(fit([t for _, t, _ in rows], [y for _, _, y in rows], share))
    texts = text_of(docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False))), "held_out")
    return texts.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def op4(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
