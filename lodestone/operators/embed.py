"""Pluggable embeddings: anything that turns a list of texts into vectors can be used over a table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import dense, hash_vectors, pending

#: Bytes of a chunk that a neural model gets, and texts in a batch.
NEURAL_BYTES, BATCH = 1024, 256
#: A workspace is embedded before a search only up to this many bytes; beyond it the search doesn't wait.
BLOCKING_BYTES = 1_000_000


class Embedder(Protocol):
    """A model: its number of dimensions, and vectors for texts. It is made once in each Python worker's task."""

    dimensions: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class StubEmbedder:
    """A deterministic stand-in for a neural model: seeded random projections of word counts, length 1."""

    def __init__(self, dimensions: int = 384) -> None:
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                seed = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                row += np.random.default_rng(seed).standard_normal(self.dimensions).astype(np.float32)
            norm = float(np.linalg.norm(row))
            if norm > 0:
                row /= norm
        return out


def embedded(text: Column, make) -> Column:
    """Vectors of a text column by ``make()``'s model, in Arrow batches; a text that fails gets a zero vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            out: list[np.ndarray] = []
            for i in range(0, len(texts), BATCH):
                part = texts.iloc[i : i + BATCH].fillna("").tolist()
                try:
                    out += list(model.embed_batch(part))
                except Exception:
                    for t in part:
                        try:
                            out += list(model.embed_batch([t]))
                        except Exception:
                            out.append(np.zeros(model.dimensions, np.float32))
            yield pd.Series(out, index=texts.index)

    return run(text)


def head(text: Column) -> Column:
    """The first bytes of a text, as many whole characters as fit."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, NEURAL_BYTES).cast("string"))


def enhance(chunks: DataFrame, vectors: DataFrame, make=StubEmbedder) -> DataFrame:
    """(vector_key, embedding) of the chunks that have no vector yet; running it again adds nothing."""
    return pending(chunks, vectors).select("vector_key", embedded(head(F.col("text")), make).alias("embedding"))


def hashed(chunks: DataFrame) -> DataFrame:
    """(chunk_id, embedding) by feature hashing, without Python."""
    return dense(hash_vectors(chunks))


def should_block(files: DataFrame) -> bool:
    """Whether a workspace is small enough to be embedded before it is searched."""
    return (files.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0) <= BLOCKING_BYTES
