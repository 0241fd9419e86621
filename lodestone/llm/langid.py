"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

Defined results: a null text, an empty one and one without a letter are
``und`` with score 0 and are rejected. Very long texts are learned from and
scored whole. Rows with a null language are not learned from. Rows that repeat
id, language and text are learned from once and scored alike; of equally likely
languages the first by name is taken. With no labelled row at all, every text
is ``und``; an empty table gives an empty one. Extra columns are kept; one that
has the name of a result column is replaced.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bag
from .sample import bounded
from .textscan import codepoints, map_texts, release, segment_sum, utf8

#: Bound of the rows that a model is fitted on, for each language, and for all together: with many languages each
#: gives fewer rows, but one at least, so that every label value is learned.
ROWS_PER_LANGUAGE, ROWS = 350, 2800
#: Share of rightly identified calibration rows that rejection may cost.
REJECTED_SHARE = 0.001


def _lower_table() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_tables: dict[str, np.ndarray] = {}


def letters(cps: np.ndarray) -> np.ndarray:
    """Lower-cased letters; everything else becomes a space."""
    if "lower" not in _tables:
        _tables["lower"] = _lower_table()
    return _tables["lower"][cps]


@dataclass
class LanguageModel:
    bag: bag.Bag | None
    least: float  # calibrated probability below which a text is rejected


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", learn: Column | None = None, rows_per_language: int = ROWS_PER_LANGUAGE, rows: int = ROWS) -> LanguageModel:
    """Learn from a bounded sample of the rows with a language: ``rows_per_language`` of each, ``rows`` in all."""
    learn = F.lit(True) if learn is None else learn
    known = df.where(learn & F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("__label__"), F.col(text).alias("text"))
    n_languages = known.agg(F.count_distinct("__label__")).first()[0]
    if not n_languages:
        return LanguageModel(None, 0.0)
    each = max(1, min(rows_per_language, rows // n_languages))
    sample = bounded(known, "__label__", {}, each, "langid")

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            found = bag.sparse(bag.features(texts, letters, False))
            return [pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float32()))]

        return work

    found, names = bag.collected(map_texts(sample, "text", ["doc_id", "__label__"], "ids array<int>, w array<float>", make), "__label__")
    if not found:
        return LanguageModel(None, 0.0)
    classes = sorted(set(names))
    y = np.array([classes.index(n) for n in names], np.int64)
    model, p, truth = bag.fit(found, y, classes, balance=True)
    del found
    release()
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth]) if len(p) else np.zeros(0)
    # the smallest confidence of right answers, but for a small share; never above one half
    least = min(0.5, float(right[int(len(right) * REJECTED_SHARE)]) * 0.8) if len(right) else 0.0
    return LanguageModel(model, max(least, 1.0 / max(2, len(classes)) if len(classes) > 2 else 0.0))


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score (calibrated probability) and rejected."""
    handle = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = handle.value

        def work(texts: pa.Array) -> list[pa.Array]:
            raw, off = utf8(texts)
            cps, at = codepoints(raw, off)
            lettered = segment_sum((letters(cps) != 32).astype(np.float64), at) > 0
            if m.bag is None:
                n = len(texts)
                return [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))]
            p = m.bag.probabilities(bag.features(texts, letters, False))
            best = p.argmax(axis=1)
            score = np.where(lettered, np.round(p.max(axis=1), 6), 0.0)
            names = [m.bag.classes[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            return [pa.array(names, pa.string()), pa.array(score), pa.array(~lettered | (score < m.least))]

        return work

    return map_texts(df, text, df.columns if keep is None else keep, "lang_pred string, score double, rejected boolean", make)
