"""Quality, language ID and toxicity: held-out accuracy, and rows of every odd kind."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bag, langid, quality, queries, sample, textscan, toxicity
from lodestone.llm.textscan import fold

MIDDLE = "/root/testdata/sf0.01"


def held_out(spark, df, label):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", label)
    return df.where("held_out").join(labels, "doc_id").collect()


def test_quality_held_out(spark):
    got = queries.op1_quality(spark, MIDDLE)
    assert got.count() == 1000 and got.where("score is null or score < 0 or score > 1").count() == 0
    rows = held_out(spark, got, "quality")
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(1 - r["predicted"] for r in bad) >= 0.75 * len(bad)


def test_language_held_out(spark):
    got = queries.op6_language(spark, MIDDLE)
    rows = got.where("held_out").join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)


def test_toxicity_held_out(spark):
    got = queries.op9_toxicity(spark, MIDDLE)
    assert got.count() == 1000
    rows = held_out(spark, got, "toxic")
    clean, toxic = [r for r in rows if r["toxic"] == 0], [r for r in rows if r["toxic"] == 1]
    assert sum(1 - r["predicted"] for r in clean) >= 0.95 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.5 * len(toxic)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    found = [texts[r["doc_id"]][s["start"] : s["end"]].lower() for r in rows for s in r["spans"]]
    assert found and any(w in {"idiot", "moron", "scum", "trash", "clown", "loser", "stupid"} for w in found)


def odd(spark):
    rows = [(1, None, "en", 5), (2, "", None, 5), (3, "12 34 !?", "en", 5), (4, "the cat " * 30_000, "en", 5), (4, "the cat " * 30_000, "en", 5), (None, "der Hund und die Katze", "de", 5), (6, "中文字", "zh", 5), (7, "the dog and the house", "en", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_language_of_odd_rows(spark):
    df = odd(spark)
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    for i in (1, 2, 3):
        assert got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0
    assert got[4]["lang_pred"] in ("en", "de", "zh") and got[4]["lang"] == "en"
    assert langid.predict(df.limit(0), model).count() == 0
    empty = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, empty).collect()} == {"und"}


def test_quality_and_toxicity_of_odd_rows(spark):
    df = odd(spark).drop("lang")
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (7, 1, 1), (3, 0, 1), (99, 1, 1), (6, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        q = quality.score(df, quality.fit(df, lab)).collect()
        t = toxicity.score(df, toxicity.fit(df, lab)).collect()
        assert len(q) == len(t) == 8 and all(0 <= r["score"] <= 1 for r in [*q, *t])
        assert all(isinstance(r["spans"], list) for r in t)
    assert quality.score(df.limit(0), None).count() == 0 and toxicity.score(df.limit(0), None).count() == 0
    assert {r["score"] for r in quality.score(df, None).collect()} == {0.5}


def test_folds_are_left_out(spark):
    df = spark.range(50).selectExpr("id as doc_id")
    import zlib

    got = {r["doc_id"]: r["f"] for r in df.select("doc_id", fold("doc_id", 5).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


def test_features_do_not_depend_on_the_block():
    texts = ["ab abc ab ab", None, "", "x", "häuser 12 HÄUSER", " the end"]
    whole = bag.sparse(bag.features(pa.array(texts, pa.string()), quality.folded, True))
    for t, (ids, w) in zip(texts, whole, strict=True):
        (one, v), = bag.sparse(bag.features(pa.array([t], pa.string()), quality.folded, True))
        assert ids.tolist() == one.tolist() and np.allclose(w, v)


def a_field(rng, w):
    field = toxicity.Field(np.zeros(1 << toxicity.BITS), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(3))
    field.weights[np.unique(w.features)] = rng.normal(size=len(np.unique(w.features)))
    return field


def likelihood(field, w, tags):
    """Log-likelihood of the tags by enumeration."""
    emit, out = field.weights[w.features].sum(axis=1), 0.0
    for a, b in zip(w.seq_off[:-1], w.seq_off[1:], strict=True):
        score = lambda t, a=a, n=b - a: field.first[t[0]] + sum(emit[a + i] for i in range(n) if t[i]) + sum(field.move[t[i - 1], t[i]] for i in range(1, n))
        every = [score([code >> i & 1 for i in range(b - a)]) for code in range(1 << (b - a))]
        out += score(list(tags[a:b])) - np.logaddexp.reduce(every)
    return out


@pytest.mark.parametrize("piece", [64, 3, 2])
def test_edges_are_the_gradient_of_the_likelihood(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    rng = np.random.default_rng(4)
    w = toxicity.words_of(pa.array(["a bb ccc. dd e", "f g h i j k l m"], pa.string()))
    field, tags = a_field(rng, w), rng.integers(0, 2, len(w.start))
    _, ahead, back = field.messages(w)
    j = np.setdiff1d(np.arange(len(w.start)), w.seq_off[:-1])
    seen = np.bincount(2 * tags[j - 1] + tags[j], minlength=4).reshape(2, 2)
    got = seen - field.edges(w, ahead, back, j).sum(axis=0)
    for s in (0, 1):
        for t in (0, 1):
            field.move[s, t] += 1e-5
            up = likelihood(field, w, tags)
            field.move[s, t] -= 2e-5
            down = likelihood(field, w, tags)
            field.move[s, t] += 1e-5
            assert np.isclose(got[s, t], (up - down) / 2e-5, atol=1e-5)


def test_pieces_of_a_long_sequence_are_joined_exactly(monkeypatch):
    rng = np.random.default_rng(6)
    w = toxicity.words_of(pa.array([" ".join(rng.choice(["ab", "cd", "efgh", "ij"], 3000)), "one. two three"], pa.string()))
    field = a_field(rng, w)
    got = field.marginals(w)
    monkeypatch.setattr(toxicity, "PIECE", 1 << 20)
    assert len(w.seq_off) == 4 and np.allclose(got, field.marginals(w), atol=1e-9)


def plain_buckets(text, marked, sizes=(3, 4)):
    """Buckets of a text's character n-grams and words, one by one."""
    full, word = (1 << 64) - 1, 0xD6E8FEB86659FD93

    def mixed(h):
        h ^= h >> 32
        h = h * word & full
        return h ^ (h >> 29)

    def hashed(part, salt):
        h = mixed(sum((ord(c) + 0x51) * word * pow(textscan.BASE, i, 1 << 64) for i, c in enumerate(part)) & full)
        return ((h ^ salt) * 0x9E3779B97F4A7C15 & full) >> (64 - bag.BITS)

    framed, words = f" {text} ", text.split(" ")
    grams = [hashed(framed[i : i + n], n) for n in sizes for i in range(len(framed) - n + 1)]
    words = [x for x in words if x]
    return grams, [0 if marked and i and x == words[i - 1] else hashed(x, 99) for i, x in enumerate(words)]


def test_scores_equal_plain_averages_and_softmax():
    rng = np.random.default_rng(9)
    texts = ["Ab ab ab  cde 12 é", "", "x", "the end of 345 lines, the end", "häuser häuser"]
    for fold, marked, lower, k in ((quality.folded, True, lambda t: "".join("0" if c.isdigit() else c for c in t), 2), (langid.letters, False, lambda t: "".join(c.lower() if c.isalpha() else " " for c in t), 3)):
        model = bag.Bag(list(range(k)), rng.normal(size=(k, 1 << bag.BITS)).astype(np.float32), rng.normal(size=k), 1.7, 0.3)
        got = model.probabilities(bag.features(pa.array(texts), fold, marked))
        for text, p in zip(texts, got, strict=True):
            grams, words = plain_buckets(lower(text), marked)
            z = np.array([sum(row[g] for g in grams) / max(1, len(grams)) + sum(row[x] for x in words) / max(1, len(words)) for row in model.table.astype(float)]) + model.bias
            z = z * 1.7 + np.eye(k)[-1] * 0.3
            assert np.allclose(p, np.exp(z) / np.exp(z).sum(), atol=1e-5)


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = spark.range(5000).selectExpr("if(id < 3000, 1, id) as doc_id", "concat('text ', if(id < 2000, 1, id)) as text")
    labels = spark.range(5000).selectExpr("if(id < 3000, 1, id) as doc_id", "int(id % 2) as y")
    got = sample.labelled(rows, labels, "y", F.lit(True), {1: 40}, 70, "seed", ["text"]).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 70, 1: 40}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    texts = pa.array(["a bb ccc. dd e", None, "f g h i j k l"], pa.string())
    w = toxicity.words_of(texts)
    field = toxicity.Field(np.zeros(1 << toxicity.BITS), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(3))
    field.weights[np.unique(w.features)] = rng.normal(size=len(np.unique(w.features)))
    got = field.marginals(w)
    emit = field.weights[w.features].sum(axis=1)
    for a, b in zip(w.seq_off[:-1], w.seq_off[1:], strict=True):
        n, total, hit = b - a, 0.0, np.zeros(b - a)
        for code in range(1 << n):
            tags = [code >> i & 1 for i in range(n)]
            score = field.first[tags[0]] + sum(emit[a + i] for i in range(n) if tags[i]) + sum(field.move[tags[i - 1], tags[i]] for i in range(1, n))
            total += np.exp(score)
            hit += np.exp(score) * np.array(tags)
        assert np.allclose(got[a:b], hit / total)
