"""Toxicity: a linear-chain conditional random field over words, fitted and decoded in numpy.

Words are runs of letters, digits and apostrophes; a sequence is a sentence
(to . ! ? or a line feed), however long. Every word of every text is in one
sequence. A word's features are hashes of the word, its beginnings and its end;
two tags, toxic or not.

Labels are given for documents. The tag of a training word follows from them: a
feature that occurs in toxic documents too often for chance, by a binomial bound
that grows with the number of features tried, marks the words that have it
there. The field is fitted by gradient descent on the sequences' conditional
log-likelihood, with the marginals of words and of pairs of neighbours.
Forward-backward marginals of all words give the document's score, calibrated on
labelled documents that nothing else was learned from, and the offending
offsets.

Defined results: a null, empty or word-free text has the score of a text
without a toxic word, and no spans; a very long text is tagged whole, in time
linear in its words; repeated rows are learned from once and scored alike; ties
don't arise. Without toxic and clean labelled rows every score is 0; an empty
table gives an empty one. Extra columns are kept, clashing ones replaced.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import labelled
from .textscan import U64, blocks, codepoints, map_texts, mixed, prefix_hash, release, runs, segment_sum, slice_hash, utf8

BITS = 18
#: Words of a piece: pieces of a sequence are worked on side by side, and joined by 2 x 2 transfers, which is exact.
PIECE = 64
BEGINNINGS = (3, 4, 5, 6)
END = 4
#: Bound of the labelled documents learned from: toxic, clean.
TOXIC_ROWS, CLEAN_ROWS = 900, 1800
#: A feature's documents must be less likely by chance than one of all features that are as frequent, by this (natural logarithm).
MARGIN = 0.0
#: The least share of toxic documents among a feature's, and the least number of them, for it to mark words.
LEAST_SHARE, LEAST_DOCUMENTS = 0.9, 3

SPANS = "array<struct<start:int,end:int,probability:float>>"

_tables: dict[str, np.ndarray] = {}


def _folded(cps: np.ndarray) -> np.ndarray:
    """Lower-cased letters, digits and the apostrophe; 1 for what ends a sentence; 0 for the rest."""
    if "fold" not in _tables:
        out = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalnum() or ch == "'":
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        out[[ord(c) for c in ".!?\n"]] = 1
        _tables["fold"] = out
    return _tables["fold"][cps]


@dataclass
class Words:
    """Words of a block of texts: code point offsets, features, owners and sequences."""

    start: np.ndarray  # within the block
    end: np.ndarray
    doc_off: np.ndarray  # words of each text
    text_at: np.ndarray  # code point offset of each text
    features: np.ndarray  # words x features: buckets
    seq_off: np.ndarray  # words of each sequence


def words_of(texts: pa.Array) -> Words:
    raw, off = utf8(texts)
    cps, at = codepoints(raw, off)
    folded = _folded(cps)
    inside = folded > 1
    edge = np.zeros(len(cps) + 1, bool)
    edge[at] = True
    # a word ends where the text ends: runs are cut at the texts' offsets
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = prefix_hash(folded)
    size = b - a
    cols = [slice_hash(prefix, a, b) ^ U64(1)]
    for n in BEGINNINGS:
        cols.append(np.where(size >= n, slice_hash(prefix, a, np.minimum(a + n, b)) ^ U64(n * 1315423911), cols[0]))
    cols.append(np.where(size > END, slice_hash(prefix, np.maximum(b - END, a), b) ^ U64(977), cols[0]))
    h = np.stack(cols, axis=1) if len(a) else np.zeros((0, len(BEGINNINGS) + 2), U64)
    buckets = ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)).astype(np.int64)
    doc_off = np.searchsorted(a, at)
    stop = np.zeros(len(cps) + 1, np.int64)
    np.cumsum((folded == 1), out=stop[1:])
    sentence = stop[a] + np.searchsorted(at, a, "right")  # a new number after each end and in each text
    begin = np.ones(len(a), bool)
    begin[1:] = sentence[1:] != sentence[:-1]
    return Words(a, b, doc_off, at, buckets, np.concatenate([np.flatnonzero(begin), [len(a)]]))


class _Pieces:
    """Sequences cut after each PIECE words."""

    def __init__(self, seq_off: np.ndarray) -> None:
        whole = np.diff(seq_off)
        count = -(-whole // PIECE)
        seq = np.repeat(np.arange(len(whole)), count)
        self.rank = np.arange(len(seq)) - np.repeat(np.cumsum(count) - count, count)
        self.start = seq_off[:-1][seq] + self.rank * PIECE
        self.length = np.minimum(PIECE, whole[seq] - self.rank * PIECE)
        self.pieces = count[seq]


@dataclass
class Field:
    """Weights of the features for the toxic tag, transition scores between tags, and the document's calibration."""

    weights: np.ndarray
    move: np.ndarray  # 2 x 2
    first: np.ndarray  # 2
    calibration: np.ndarray  # bias, log-odds of the likeliest word, expected number of words

    def marginals(self, w: Words) -> np.ndarray:
        """Probability of the toxic tag for each word."""
        return self.messages(w)[0]

    def messages(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities, and the log odds of the toxic tag that come from ahead (with the word's own) and from behind."""
        emit = self.weights[w.features].sum(axis=1, dtype=np.float64)
        p = _Pieces(w.seq_off)
        enter, leave = self._between(emit, p)
        order = np.argsort(-p.length, kind="stable")
        starts, lengths, enter, leave = p.start[order], p.length[order], enter[order], leave[order]
        longest = int(lengths[0]) if len(lengths) else 0
        active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # pieces longer than t
        (cc, ct), (tc, tt) = self.move
        ahead, back = np.empty(len(emit)), np.empty(len(emit))
        m = enter
        for t in range(longest):
            at = starts[: active[t]] + t
            if t:
                m = m[: active[t]]
                m = np.logaddexp(ct, tt + m) - np.logaddexp(cc, tc + m)
            m = m + emit[at]
            ahead[at] = m
        k = np.zeros(0)
        for t in range(longest - 1, -1, -1):
            at = starts[: active[t]] + t
            more = len(k)  # these go on after t
            now = leave[: len(at)].copy()
            if more:
                e = emit[at[:more] + 1] + k
                now[:more] = np.logaddexp(tc, tt + e) - np.logaddexp(cc, ct + e)
            back[at] = k = now
        return 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40))), ahead, back

    def _between(self, emit: np.ndarray, p: _Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Log odds that enter each piece at its first word (without its own) and leave it at its last one."""
        enter, leave = np.full(len(p.start), self.first[1] - self.first[0]), np.zeros(len(p.start))
        many = np.flatnonzero(p.pieces > 1)
        if not len(many):
            return enter, leave
        # log weights of the last word's tags, from either tag of the first word on
        through = np.full((len(many), 2, 2), -1e30)
        through[:, 0, 0] = through[:, 1, 1] = 0.0
        step = lambda x: np.stack([np.logaddexp(x[..., 0] + self.move[0, t], x[..., 1] + self.move[1, t]) for t in (0, 1)], axis=-1)
        for t in range(PIECE):
            on = np.flatnonzero(p.length[many] > t)
            if t:
                through[on] = step(through[on])
            through[on, :, 1] += emit[p.start[many[on]] + t][:, None]
        over = step(through)  # to the tags of the next piece's first word
        row = np.full(len(p.start), -1)
        row[many] = np.arange(len(many))
        deepest = int(p.rank.max())
        by_rank = [np.flatnonzero(p.rank == r) for r in range(deepest + 1)] if deepest < 64 else np.split(np.argsort(p.rank, kind="stable"), np.cumsum(np.bincount(p.rank))[:-1])
        for r in range(1, deepest + 1):
            i = by_rank[r]
            f, e = over[row[i - 1]], enter[i - 1]
            enter[i] = np.logaddexp(f[:, 0, 1], e + f[:, 1, 1]) - np.logaddexp(f[:, 0, 0], e + f[:, 1, 0])
        # log weights of all that follows a piece's start, by the first word's tag
        rest = np.zeros((len(p.start), 2))
        for r in range(deepest, -1, -1):
            i = by_rank[r]
            i = i[p.pieces[i] > 1]
            last = p.rank[i] == p.pieces[i] - 1
            end, mid = i[last], i[~last]
            rest[end] = np.logaddexp(through[row[end]][:, :, 0], through[row[end]][:, :, 1])
            f, after = over[row[mid]], rest[mid + 1][:, None, :]
            rest[mid] = np.logaddexp(f[:, :, 0] + after[:, :, 0], f[:, :, 1] + after[:, :, 1])
            rest[mid] -= rest[mid].max(axis=1, keepdims=True)
            after = rest[mid + 1]
            weigh = lambda s, after=after: np.logaddexp(self.move[s, 0] + after[:, 0], self.move[s, 1] + after[:, 1])
            leave[mid] = weigh(1) - weigh(0)
        return enter, leave

    def edges(self, w: Words, ahead: np.ndarray, back: np.ndarray, j: np.ndarray) -> np.ndarray:
        """(words, 2, 2): probabilities of the tags of the word before each of ``j`` and of that word itself."""
        emit = self.weights[w.features[j]].sum(axis=1, dtype=np.float64)
        log = np.zeros((len(j), 2, 2)) + self.move[None]
        log[:, 1, :] += ahead[j - 1][:, None]
        log[:, :, 1] += (emit + back[j])[:, None]
        log -= log.max(axis=(1, 2), keepdims=True)
        out = np.exp(log)
        return out / out.sum(axis=(1, 2), keepdims=True)

    def documents(self, p: np.ndarray, doc_off: np.ndarray) -> np.ndarray:
        """What the calibration sees of each document."""
        n = len(doc_off) - 1
        best = np.full(n, 1e-6)
        full = np.flatnonzero(doc_off[1:] > doc_off[:-1])
        if len(full):
            best[full] = np.clip(np.maximum.reduceat(p, doc_off[:-1][full]), 1e-6, 1 - 1e-6)
        many = np.log1p(segment_sum(np.where(p > 0.3, p, 0.0), doc_off))
        return np.stack([np.ones(n), np.log(best / (1 - best)) / 4, many], axis=1)

    def scores(self, p: np.ndarray, doc_off: np.ndarray) -> np.ndarray:
        z = self.documents(p, doc_off) @ self.calibration
        return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 6)


def _joined(texts: pa.Array) -> Words:
    """Words of a whole column, block by block, so that few of what is computed on the way exists at once."""
    parts = []
    for lo, hi in blocks(utf8(texts)[1]):
        x = words_of(texts.slice(lo, hi - lo))
        parts.append((x.features.astype(np.int32), np.diff(x.doc_off), np.diff(x.seq_off)))
    features = np.concatenate([x[0] for x in parts]) if parts else np.zeros((0, len(BEGINNINGS) + 2), np.int32)
    ends = lambda i: np.concatenate([[0], *[x[i] for x in parts]]).cumsum()
    none = np.zeros(len(features), np.int8)
    return Words(none, none, ends(1), np.zeros(len(texts) + 1, np.int64), features, ends(2))


def _documents(w: Words, docs: np.ndarray) -> Words:
    """The words of some documents."""
    n = np.diff(w.doc_off)[docs]
    at = np.repeat(w.doc_off[docs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner = np.searchsorted(w.doc_off, w.seq_off[:-1], "right") - 1
    lengths = np.diff(w.seq_off)[np.isin(owner, docs)]
    off = np.concatenate([[0], np.cumsum(n)])
    return Words(w.start[at], w.end[at], off, np.zeros(len(off), np.int64), w.features[at], np.concatenate([[0], np.cumsum(lengths)]))


def _marked(w: Words, toxic: np.ndarray) -> np.ndarray:
    """Tags of the training words: those of toxic documents that have a feature beyond chance."""
    docs = np.repeat(np.arange(len(toxic)), np.diff(w.doc_off))
    # copies of a document are no further evidence: those with the same smallest five-word window count once
    window = np.zeros(len(w.features), U64)
    for j in range(5):
        window[: len(window) - j] = mixed(window[: len(window) - j] * U64(31) + w.features[j:, 0].astype(U64))
    group = np.arange(len(toxic))
    full = np.flatnonzero(np.diff(w.doc_off) > 5)
    if len(full):
        spans = np.stack([w.doc_off[full], w.doc_off[full + 1] - 4], axis=1).ravel()  # windows within the text
        least = np.minimum.reduceat(window, spans)[::2]
        _, first, inverse = np.unique(least, return_index=True, return_inverse=True)
        group[full] = full[first][inverse]
    # neither are occurrences of a feature between the same two words: at most as many documents count as there are of others
    around = np.zeros(len(w.features), U64)
    around[1:] = w.features[:-1, 0].astype(U64) + U64(1)
    around[:-1] += (w.features[1:, 0].astype(U64) + U64(1)) << U64(BITS + 1)
    around = mixed(around) & U64(0xFFFFFFFF)
    clean, hit, places = (np.zeros(1 << BITS) for _ in range(3))
    bad = toxic[docs] == 1
    for f in range(w.features.shape[1]):
        own = np.ones(len(docs), bool) if f == 0 else w.features[:, f] != w.features[:, 0]  # short words have one feature only
        for rows, out in ((own & bad, hit), (own & ~bad, clean)):
            bucket = np.unique(group[docs[rows]] << BITS | w.features[rows, f]) & ((1 << BITS) - 1)
            out += np.bincount(bucket, minlength=1 << BITS)
        seen = np.unique(w.features[own & bad, f].astype(U64) << U64(32) | around[own & bad]) >> U64(32)
        places += np.bincount(seen.astype(np.int64), minlength=1 << BITS)
    hit = np.minimum(hit, places)
    n = hit + clean
    base = toxic[np.unique(group)].mean()
    share = np.clip(hit / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    surprise = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    as_frequent = len(n) - np.searchsorted(np.sort(n), n, "left")  # features tried that are as frequent
    marks = (share >= LEAST_SHARE) & (hit >= LEAST_DOCUMENTS) & (surprise > np.log(np.maximum(as_frequent, 1)) + MARGIN)
    return marks[w.features].any(axis=1) & bad


def _train(w: Words, tags: np.ndarray, epochs: int = 4, rate: float = 0.5, seed: int = 5) -> Field:
    """Stochastic gradient descent on the sequences' conditional log-likelihood, in batches."""
    rng = np.random.default_rng(seed)
    field = Field(np.zeros(1 << BITS), np.zeros((2, 2)), np.array([0.0, -3.0]), np.array([-4.0, 1.0, 0.0]))
    past = np.full(1 << BITS, 1e-6)
    lengths = np.diff(w.seq_off)
    has = np.add.reduceat(tags.astype(np.int64), w.seq_off[:-1]) > 0
    rest = np.flatnonzero(~has)
    for _ in range(epochs):
        # every sequence with a toxic word, and as many others several times over, anew in each epoch
        some = rng.choice(rest, min(len(rest), max(2000, 6 * int(has.sum()))), replace=False) if len(rest) else rest
        order = rng.permutation(np.concatenate([np.flatnonzero(has), some]))
        for i in range(0, len(order), 256):
            pick = order[i : i + 256]
            n = lengths[pick]
            off = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(w.seq_off[pick] - off[:-1], n) + np.arange(off[-1])
            part = Words(w.start[at], w.end[at], off, off, w.features[at], off)
            p, ahead, back = field.messages(part)
            y = tags[at].astype(np.float64)
            g = p - y
            flat, each = part.features.ravel(), np.repeat(g, part.features.shape[1])
            total = np.bincount(flat, weights=each, minlength=0)
            touched = np.unique(flat)
            past[touched] += total[touched] ** 2
            field.weights[touched] -= rate * total[touched] / np.sqrt(past[touched]) + 1e-4 * field.weights[touched]
            # transitions: observed against expected, by the marginals of neighbours
            inner = np.ones(len(at), bool)
            inner[off[:-1]] = False
            j = np.flatnonzero(inner)
            if len(j):
                seen = np.bincount(2 * tags[at[j - 1]].astype(np.int64) + tags[at[j]], minlength=4).reshape(2, 2)
                field.move += rate * 0.2 * (seen - field.edges(part, ahead, back, j).sum(axis=0)) / len(j)
            field.first[1] -= rate * 0.2 * float((p[off[:-1]] - y[off[:-1]]).mean())
    return field


def _calibrate(field: Field, p: np.ndarray, doc_off: np.ndarray, toxic: np.ndarray) -> None:
    """Logistic regression of the labels, with a small penalty."""
    x, c = field.documents(p, doc_off), np.array([-1.0, 1.0, 0.0])
    weight = np.full(len(x), 1 / len(x))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (weight * (q - toxic)) + 1e-3 * c
        hess = (x * (weight * q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(3)
        c = c - np.linalg.solve(hess, grad)
    field.calibration = c


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, text: str = "text", doc_id: str = "doc_id") -> Field | None:
    """Learn from a bounded sample of labelled documents; None without both kinds."""
    learn = F.lit(True) if learn is None else learn
    sample = labelled(docs.withColumnRenamed(text, "text"), labels, label, learn, {1: toxic_rows}, clean_rows, "toxic", ["text"], doc_id)
    got = sample.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    toxic = got.column("y").to_numpy().astype(np.int64)
    if not toxic.any() or toxic.all():
        return None
    w = _joined(got.column("text").combine_chunks())
    if not len(w.start):
        return None
    check = np.arange(len(toxic)) % 5 == 0  # documents that calibrate, and nothing else is learned from
    if not (0 < toxic[check].sum() < check.sum()) or not (0 < toxic[~check].sum() < (~check).sum()):
        check = np.zeros(len(toxic), bool)
    part = _documents(w, np.flatnonzero(~check))
    field = _train(part, _marked(part, toxic[~check]))
    part = _documents(w, np.flatnonzero(check if check.any() else ~check))
    _calibrate(field, field.marginals(part), part.doc_off, toxic[check if check.any() else ~check])
    field.weights = field.weights.astype(np.float32)
    del w, got, part
    release()
    return field


def score(df: DataFrame, field: Field | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score and spans (code point offsets of runs of words that are likelier toxic than not)."""
    handle = df.sparkSession.sparkContext.broadcast(field)

    def make():
        f = handle.value

        def work(texts: pa.Array) -> list[pa.Array]:
            n = len(texts)
            if f is None:
                return [pa.array(np.zeros(n)), pa.array([[]] * n, _span_type())]
            w = words_of(texts)
            p = f.marginals(w)
            return [pa.array(f.scores(p, w.doc_off)), _spans(w, p)]

        return work

    return map_texts(df, text, df.columns if keep is None else keep, f"score double, spans {SPANS}", make)


def _span_type() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float32())]))


def _spans(w: Words, p: np.ndarray) -> pa.Array:
    # runs of flagged words, cut where a text ends
    flag = p >= 0.5
    first, last = runs(flag)
    inner = w.doc_off[1:-1]
    split = inner[(inner > 0) & (inner < len(p))]
    split = np.unique(split[flag[split] & flag[split - 1]])
    first, last = np.sort(np.concatenate([first, split])), np.sort(np.concatenate([last, split]))
    doc = np.searchsorted(w.doc_off, first, "right") - 1
    base = w.text_at[doc]
    worst = np.maximum.reduceat(p, np.stack([first, last], axis=1).ravel()[:-1])[::2] if len(first) else np.zeros(0)
    values = pa.StructArray.from_arrays(
        [pa.array((w.start[first] - base).astype(np.int32)), pa.array((w.end[last - 1] - base).astype(np.int32)), pa.array(worst.astype(np.float32))],
        names=["start", "end", "probability"],
    )
    offsets = np.searchsorted(doc, np.arange(len(w.doc_off))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)
