"""Quality classifier: averaged hashed word and character n-gram embeddings, softmax, numpy SGD.

Letter case and punctuation are kept, digits are folded to one, and a word that
equals the one before it has a bucket of its own. Defined results: null and
empty texts are learned from and scored like any text (without features: the
calibrated prior); very long ones whole, in both. Repeated rows are learned from
once and scored alike. With no labelled row, every score is 0.5; an empty table
gives an empty one. Labels whose value is null, or whose document is missing,
are not learned from; a document with both labels counts for each. Extra columns
are kept, clashing ones replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bag
from .sample import labelled
from .textscan import map_texts, release

#: Bound of the rows that a model is fitted on, for each of the two labels.
ROWS_PER_LABEL = 700


def folded(cps: np.ndarray) -> np.ndarray:
    """Digits become 0, ASCII white space a space."""
    out = np.where((cps >= 48) & (cps <= 57), np.uint32(48), cps)
    return np.where((out >= 9) & (out <= 13), np.uint32(32), out)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, rows_per_label: int = ROWS_PER_LABEL, text: str = "text", doc_id: str = "doc_id") -> bag.Bag | None:
    """Learn from a bounded sample of labelled rows; None if there is none."""
    learn = F.lit(True) if learn is None else learn
    sample = labelled(docs.withColumnRenamed(text, "text"), labels, label, learn, {}, rows_per_label, "quality", ["text"], doc_id)

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            found = bag.sparse(bag.features(texts, folded, True))
            return [pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float32()))]

        return work

    rows, y = bag.collected(map_texts(sample, "text", ["doc_id", "y"], "ids array<int>, w array<float>", make), "y")
    model = bag.fit(rows, np.array(y, np.int64), [0, 1], epochs=8)[0] if rows else None
    del rows
    release()
    return model


def score(df: DataFrame, model: bag.Bag | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score: the calibrated probability of label 1."""
    handle = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = handle.value

        def work(texts: pa.Array) -> list[pa.Array]:
            if m is None:
                return [pa.array(np.full(len(texts), 0.5))]
            return [pa.array(np.round(m.probabilities(bag.features(texts, folded, True))[:, 1], 6))]

        return work

    return map_texts(df, text, df.columns if keep is None else keep, "score double", make)
