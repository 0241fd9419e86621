"""Averaged hashed subword embeddings with a linear softmax, fitted by SGD in numpy.

A text's features are hashed character n-grams and hashed words. Each of the
two groups is averaged, the averages are added and a softmax layer follows.
For scoring, embeddings and layer are multiplied into one table beforehand, so
that a text costs one lookup for each feature.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .textscan import U64, codepoints, gram_hash, prefix_hash, runs, segment_sum, slice_hash, utf8

#: Bits of a bucket number.
BITS = 16
SIZES = (3, 4)


@dataclass
class Features:
    """Bucket numbers of a block of texts: character n-grams and words, with offsets."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    words: tuple[np.ndarray, np.ndarray]


def bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h ^ U64(salt)) * U64(0x9E3779B97F4A7C15) >> U64(64 - BITS)).astype(np.int64)


def features(texts, fold_chars: Callable[[np.ndarray], np.ndarray], repeats: bool, sizes=SIZES) -> Features:
    """Features of whole texts. ``repeats`` marks a word that equals the one before it."""
    raw, off = utf8(texts)
    cps, at = codepoints(raw, off)
    cps = fold_chars(cps)
    docs = len(at) - 1
    stream = np.insert(cps, at, 32)  # a space before each text and after the last
    edge = at + np.arange(docs + 1)
    prefix = prefix_hash(stream)
    grams = []
    for n in sizes:
        ids = bucket(gram_hash(prefix, n), n)
        inside = np.ones(len(ids), bool)
        for j in range(1, n - 1):  # n-grams that reach into the next text
            p = edge[1:] - j
            p = p[(p >= 0) & (p < len(ids))]
            inside[p] = False
        kept = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(inside, out=kept[1:])
        goff = kept[np.minimum(edge, len(ids))]
        grams.append((ids[inside], goff))
    a, b = runs(stream != 32)
    h = slice_hash(prefix, a, b)
    ids = bucket(h, 99)
    woff = np.searchsorted(a, edge)
    if repeats:
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        first = woff[:-1][woff[:-1] < len(h)]
        same[first] = False
        ids = np.where(same, 0, ids)
    return Features(grams, (ids, woff))


def sparse(f: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and weights of each text; the weights of a group add up to 1."""
    out = []
    for i in range(len(f.words[1]) - 1):
        ids = np.concatenate([g[o[i] : o[i + 1]] for g, o in f.grams])
        words = f.words[0][f.words[1][i] : f.words[1][i + 1]]
        w = np.concatenate([np.full(len(ids), 1 / max(1, len(ids))), np.full(len(words), 1 / max(1, len(words)))])
        u, inv = np.unique(np.concatenate([ids, words]), return_inverse=True)
        out.append((u.astype(np.int32), np.bincount(inv, w, minlength=len(u)).astype(np.float32)))
    return out


@dataclass
class Bag:
    """A fitted model: classes, the table of class scores by bucket, and its calibration."""

    classes: list
    table: np.ndarray  # classes x buckets
    bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def raw_logits(self, f: Features) -> np.ndarray:
        docs = len(f.words[1]) - 1
        n_grams = np.maximum(1, sum(o[1:] - o[:-1] for _, o in f.grams))
        n_words = np.maximum(1, f.words[1][1:] - f.words[1][:-1])
        out = np.empty((docs, len(self.classes)))
        for k, row in enumerate(self.table):
            chars = sum(segment_sum(row[g], o) for g, o in f.grams)
            out[:, k] = chars / n_grams + segment_sum(row[f.words[0]], f.words[1]) / n_words + self.bias[k]
        return out

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        z = logits * self.scale
        z[:, -1] += self.shift
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, f: Features) -> np.ndarray:
        return self.calibrated(self.raw_logits(f))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: list, *, dims=16, epochs=6, rate=0.3, seed=7, balance=False, calibrate_share=0.15) -> tuple[Bag, np.ndarray, np.ndarray]:
    """Fit by stochastic gradient descent with a step size for each bucket (AdaGrad).

    A share of the rows is left out of the descent and calibrates the softmax
    (scale, and a shift if there are two classes). Returns the model, and the
    calibrated probabilities and labels of those rows.
    """
    k, rng = len(classes), np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BITS, dims)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dims, k)).astype(np.float32)
    bias, past, past_layer = np.zeros(k, np.float32), np.full(1 << BITS, 1e-8, np.float32), 1e-3
    seen = np.zeros(1 << BITS, bool)
    order = rng.permutation(len(rows))
    held = max(1, int(len(rows) * calibrate_share)) if len(rows) >= 20 else 0
    check, train = order[:held], order[held:]
    weight = np.ones(k)
    if balance and len(train):
        n = np.bincount(y[train], minlength=k)
        weight = len(train) / (k * np.maximum(1, n))
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, w = rows[i]
            e = table[ids]
            h = w @ e
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            g = layer @ p
            past_layer += float(p @ p)
            step = rate / np.sqrt(past_layer)
            past[ids] += w * w * float(g @ g)
            layer -= (step * np.outer(h, p)).astype(np.float32)
            bias -= (step * p).astype(np.float32)
            table[ids] = e - (rate * 0.3 * w / np.sqrt(past[ids]))[:, None] * g
            seen[ids] = True
    table[~seen] = 0  # buckets without evidence say nothing
    model = Bag(classes, np.ascontiguousarray((table @ layer).T.astype(np.float32)), bias.astype(np.float64))
    use = check if held else train
    logits = np.array([(model.table[:, rows[i][0]] @ rows[i][1]) + model.bias for i in use]).reshape(-1, k)
    calibrate(model, logits, y[use])
    return model, model.calibrated(logits.copy()), y[use]


def collected(df, label: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], list]:
    """Features (ids, w) and labels of a bounded sample, ordered by doc_id, without further copies of them."""
    got = df.toArrow().sort_by([("doc_id", "ascending"), (label, "ascending")]).combine_chunks()
    y = got.column(label).to_pylist()
    ids, w = got.column("ids").combine_chunks(), got.column("w").combine_chunks()
    at = ids.offsets.to_numpy()
    flat, weights = ids.values.to_numpy(), w.values.to_numpy()
    return [(flat[a:b], weights[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], y


def calibrate(model: Bag, logits: np.ndarray, y: np.ndarray) -> None:
    """Fit scale (and shift for two classes) by gradient descent on the log loss, held near 1 and 0."""
    if not len(y):
        return
    best, k = (np.inf, 1.0, 0.0), logits.shape[1]
    for scale in np.geomspace(0.1, 10, 41):
        for shift in np.linspace(-3, 3, 25) if k == 2 else (0.0,):
            z = logits * scale
            z[:, -1] += shift
            z -= z.max(axis=1, keepdims=True)
            loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean() + 0.002 * (np.log(scale) ** 2 + shift * shift)
            best = min(best, (loss, scale, shift))
    model.scale, model.shift = float(best[1]), float(best[2])
