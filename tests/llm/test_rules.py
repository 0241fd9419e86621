import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestone.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(8)
    out = ["", None, " \n\t", "a", "one two three four five\none two three four five", "a a a a a a", "\n\nx\nx\n x\n", "é # ü\x0bß | <b>", "x" * 100_000, "a b c d e f a b c d e"]
    out += ["".join(rng.choice("ab c\n#é|  ") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    return out


def test_statistics_equal_brute_force():
    got = rules.statistics_of(pa.array(texts(), pa.string()))
    assert [tuple(int(c[i]) for c in got[:5]) for i in range(len(texts()))] == [plain(t) for t in texts()]


def test_statistics_do_not_depend_on_the_block():
    whole = rules.statistics_of(pa.array(texts(), pa.string()))
    each = [rules.statistics_of(pa.array([t], pa.string())) for t in texts()]
    assert all((whole[k] == np.array([e[k][0] for e in each])).all() for k in range(len(whole)))


def thue_morse(n, first):
    return "".join("ab"[(bin(i).count("1") + first) % 2] for i in range(n))


def test_structured_lines_are_told_apart():
    x, y = thue_morse(1024, 0), thue_morse(1024, 1)
    cases = [f"{x}\n{y}", f"{x}\n{y}\n{x}", " ".join([x, y] * 3)]
    got = rules.statistics_of(pa.array(cases))
    assert [tuple(int(c[i]) for c in got[:5]) for i in range(len(cases))] == [plain(t) for t in cases]


def separated():
    rng = np.random.default_rng(3)
    good, bad = np.abs(rng.normal(0, 0.01, (900, 4))), np.abs(rng.normal(0, 0.01, (60, 4)))
    bad[np.arange(60), rng.integers(0, 4, 60)] += 0.5
    return np.concatenate([good, bad]), np.arange(960) < 900


def test_forest_finds_what_labels_mark():
    x, y = separated()
    forest = rules.grow(x[y], x.min(axis=0), x.max(axis=0))
    s = forest.score(x)
    cut = rules.cut_between(s, y)
    assert (s[y] > cut).mean() < 0.01 and (s[~y] > cut).mean() > 0.95


def test_path_lengths_equal_brute_force(monkeypatch):
    monkeypatch.setattr(rules, "TREES", 7)
    monkeypatch.setattr(rules, "SUBSAMPLE", 64)
    x, y = separated()
    lowest, highest = x.min(axis=0), x.max(axis=0)
    forest = rules.grow(x[y], lowest, highest, seed=5)

    def mean_path(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    # the same random numbers, one tree after another, but each row walks down on its own
    rng, paths = np.random.default_rng(5), [[] for _ in x]
    for _ in range(7):
        nodes, todo = {}, [(1, x[y][rng.choice(900, 64, replace=False)], [*zip(lowest, highest, strict=True)])]
        while todo:
            at, own, box = todo.pop()
            if at.bit_length() - 1 == rules.DEPTH or len(own) < 2:
                nodes[at] = (None, at.bit_length() - 1 + mean_path(len(own)))
                continue
            f = int(rng.choice(4))
            cut = rng.uniform(*box[f])
            nodes[at] = (f, cut)
            todo.append((2 * at, np.array([r for r in own if r[f] < cut]).reshape(-1, 4), [*box[:f], (box[f][0], cut), *box[f + 1 :]]))
            todo.append((2 * at + 1, np.array([r for r in own if r[f] >= cut]).reshape(-1, 4), [*box[:f], (cut, box[f][1]), *box[f + 1 :]]))
        for row, found in zip(x, paths, strict=True):
            at = 1
            while nodes[at][0] is not None:
                at = 2 * at + (row[nodes[at][0]] >= nodes[at][1])
            found.append(nodes[at][1])
    want = [2 ** (-sum(p) / len(p) / mean_path(64)) for p in paths]
    assert np.allclose(forest.score(x), want, atol=1e-12)


def test_labels_choose_the_threshold(spark):
    """A statistic that good rows have as well as bad ones rejects no good row, though bad ones show more of it."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.sample(words, 60)) + (" ###" * 30 if i % 9 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 != 0)) for i, _ in rows], "doc_id long, quality int")
    stats = rules.statistics(docs)
    got = {r["doc_id"]: r["kept"] for r in rules.judge(stats, rules.fit(stats, labels)).collect()}
    bad = [i for i, _ in rows if i % 9 == 0]
    assert not any(got[i] for i in bad) and sum(got.values()) >= 0.97 * (len(rows) - len(bad))
    flipped = labels.selectExpr("doc_id", "1 as quality")
    assert all(r["kept"] or r["base_failed"] for r in rules.judge(stats, rules.fit(stats, flipped)).collect())


def test_operator_over_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "w " * 30_000, 3), (3, "w " * 30_000, 3), (None, "good plain words that are not repeated at all here now then", 3)], "doc_id long, text string, n_words int")
    got = rules.judge(rules.statistics(df), None).collect()
    assert len(got) == 5
    by = {r["doc_id"]: r for r in got}
    assert by[1]["base_failed"] and by[2]["base_failed"] and by[3]["base_failed"] and by[None]["kept"] and by[3]["n_words"] == 30_000
    assert rules.judge(rules.statistics(df.limit(0)), None).count() == 0


def test_query(spark, small):
    from lodestone.llm.queries import op4_rules

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op4_rules(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        n, chars, symbols, dup, repeat = plain(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n) and not (r["base_failed"] and r["kept"])
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").select("doc_id").collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert sum(r["doc_id"] in kept for r in good) >= 0.9 * len(good)


def labelled_statistics(spark, n):
    """(stats, labels, inputs, good) of ``n`` labelled documents, one in five of them bad."""
    rng = np.random.default_rng(6)
    good = np.arange(n) % 5 != 0
    c = {name: rng.integers(0, 30, n) for name in rules.NAMES}
    c |= {"n_words": rng.integers(100, 400, n), "n_repeat_words": np.zeros(n, np.int64), "n_letters": rng.integers(400, 2000, n), "word_chars": rng.integers(500, 2400, n)}
    c["n_symbols"] = np.where(good, rng.integers(0, 40, n), rng.integers(20, 90, n))
    stats = spark.createDataFrame(pa.table({"doc_id": np.arange(n)} | {k: c[k].astype(np.int64) for k in rules.NAMES}))
    labels = spark.createDataFrame(pa.table({"doc_id": np.arange(n), "quality": good.astype(np.int64)}))
    return stats, labels, rules.inputs(c), good


def test_all_labelled_rows_give_forest_and_threshold(spark):
    """More rows of both kinds than any sample of them had: counted in the trees, and told apart by the threshold, are all."""
    stats, labels, x, good = labelled_statistics(spark, 12_000)
    forest = rules.fit(stats, labels)
    assert forest.threshold == rules.cut_between(np.round(forest.score(x), 9), good)
    lowest, highest = x.min(axis=0), x.max(axis=0)
    whole = rules.drawn(lowest, highest)
    for tree in (0, 7, rules.TREES - 1):
        for row in x[[0, 1, 2, 11_999]]:
            at, own, depth = 0, x[good], 0
            box = np.array([lowest, highest])
            while depth < rules.DEPTH and len(own) > 1:
                f, place = whole.feature[tree, at], whole.split[tree, at]
                assert box[0, f] <= place <= box[1, f]
                right = row[f] >= place
                own, box[1 - int(right), f] = own[(own[:, f] >= place) == right], place
                at, depth = 2 * at + 1 + int(right), depth + 1
            assert forest.leaves(row[None, :])[0, tree] == at
            assert np.isclose(forest.length[tree, at], depth + rules._mean_path(np.array(len(own))))
    assert np.isclose(forest.norm, rules._mean_path(good.sum()))


def test_threshold_over_partitions_equals_that_of_all_rows(spark):
    rng = np.random.default_rng(2)
    for n, values in ((400, 30), (3000, 2000), (50, 1)):
        v, good = np.round(rng.integers(0, values, n) / 7, 9), rng.random(n) < 0.7
        v = np.where(good, v, v + 1)
        scored = spark.createDataFrame(pa.table({"v": v, "good": good})).repartition(5)
        assert rules.best_cut(scored) == rules.cut_between(v, good)
