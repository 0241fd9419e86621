"""Similar texts of the near-dedup stage, against all pairs."""

import random
from itertools import combinations

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import overlap


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def family(rng, words, n, changes):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    rng, texts = random.Random(4), [None, "", "Two words", "two  WORDS", "one"]
    for k in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((6, 30, 120, 600)))]
        texts += family(rng, base, 14, max(1, len(base) // 30))
    passage = [f"c{i}" for i in range(25)]
    texts += [" ".join(passage + [f"x{k}_{i}" for i in range(4 + k % 9)]) for k in range(40)]
    return texts


def test_sets_have_the_same_sizes_and_overlaps():
    texts = corpus()
    h, off = overlap.shingle_sets(pa.array(texts, pa.string()), 5)
    got = [set(h[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]
    want = [shingles(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    assert all(len(got[i] & got[j]) == len(want[i] & want[j]) for i, j in combinations(range(len(texts)), 2))


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("changed", [{}, {"BLOCK": 9, "SHORT": 3, "HOT_TIMES": 4}, {"SHORT": 2, "DOMAIN": 0.9, "SHARED_BITS": 1 << 15, "HOT_BITS": 1 << 15}])
def test_links_connect_exactly_the_similar(spark, monkeypatch, changed):
    for name, value in changed.items():
        monkeypatch.setattr(overlap, name, value)
    texts = corpus()
    sets = [shingles(t) for t in texts]
    want = roots(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if similarity(sets[i], sets[j]) >= 0.8])
    df = spark.createDataFrame(list(enumerate(texts)), "fp long, text string")
    got = roots(len(texts), [(r["a"], r["b"]) for r in overlap.similar_links(df).collect()])
    assert got == want and len(set(want)) < len(texts) - 50


def test_sketches_never_differ_in_more_bits_than_sets_in_members():
    h, off = overlap.shingle_sets(pa.array(corpus(), pa.string()), 5)
    n = np.diff(off)
    bits = overlap.sketches(h, np.repeat(np.arange(len(n)), n), len(n)).view(np.uint64)
    got = [set(h[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]
    assert all(np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(got[i] ^ got[j]) for i, j in combinations(range(len(n)), 2))


def test_stage_drops_copies_of_five_word_similarity(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = cp.near_duplicates(spark, cp.lines(spark, docs, small), small).collect()
    sets = [shingles(r["text"]) for r in left]
    assert not [1 for a, b in combinations(sets, 2) if similarity(a, b) >= 0.8]
