import numpy as np
import pytest

from lodestone.llm import mixing


def corpus(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        text = " ".join(["word"] * int(rng.integers(1, 60))) + (" a | b" if i % 11 == 0 else "")
        rows.append((i, text, None if i % 50 == 0 else "en" if i % 4 else "de", source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_marginals_meet_their_targets():
    rng = np.random.default_rng(1)
    keys = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(3), 2), 4), np.tile(np.arange(2), 12)]
    tokens = rng.integers(1, 1000, 24)
    goals = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    w = mixing.rake(keys, tokens, goals, 200)
    for key, goal in zip(keys, goals, strict=True):
        assert np.allclose(np.bincount(key, w) / w.sum(), goal, atol=1e-6)
    p = mixing.calibrated(w, tokens, 0.4)
    assert (p <= 1).all() and (p >= 0).all() and np.isclose((p * tokens).sum(), 0.4 * tokens.sum())


def test_driver_and_frames_agree(spark):
    df = corpus(spark)
    targets = {"lang": {"en": 1.0, "de": 1.0, "<null>": 0.2}}
    a = {r["doc_id"]: (r["probability"], r["sampled"], r["tokens"], r["topic"]) for r in mixing.mix(df, targets=targets, rounds=4).collect()}
    b = {r["doc_id"]: (r["probability"], r["sampled"], r["tokens"], r["topic"]) for r in mixing.mix(df, targets=targets, rounds=4, driver_cells=0).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert abs(a[k][0] - b[k][0]) < 1e-9 and a[k][1:] == b[k][1:]


def test_sample_is_near_the_budget(spark):
    got = mixing.mix(corpus(spark)).collect()
    total = sum(r["tokens"] for r in got)
    assert abs(sum(r["tokens"] * r["probability"] for r in got) / total - mixing.BUDGET) < 1e-6
    assert abs(sum(r["tokens"] for r in got if r["sampled"]) / total - mixing.BUDGET) < 0.1


def test_odd_rows(spark):
    rows = [(1, None, None, None, 5), (2, "", "en", "a", 5), (3, "x " * 30000, "en", "a", 5), (3, "x " * 30000, "en", "a", 5), (None, "y", "en", "b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int")
    got = mixing.mix(df).collect()
    assert len(got) == 5 and [r["tokens"] for r in got if r["doc_id"] == 3] == [30000, 30000]
    assert len({r["sampled"] for r in got if r["doc_id"] == 3}) == 1
    assert all(0 <= r["probability"] <= 1 for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_wanted_cells_below_the_budget_are_held_at_one(spark):
    assert mixing.calibrated(np.array([100.0, 0.0]), np.array([10, 90]), 0.6).tolist() == [1.0, 0.0]
    for most in (mixing.DRIVER_CELLS, 0):
        with pytest.warns(UserWarning, match="below the budget"):
            got = mixing.mix(corpus(spark), targets={"lang": {"de": 1.0, "en": 0.0}}, rounds=2, driver_cells=most).collect()
        assert {(r["lang"] == "de", r["probability"]) for r in got} == {(True, 1.0), (False, 0.0)}, most


def test_categories_without_a_target_and_missed_marginals_are_told(spark):
    for most in (mixing.DRIVER_CELLS, 0):
        with pytest.warns(UserWarning, match="below the budget"):
            got = mixing.mix(corpus(spark), targets={"lang": {"de": 1.0}}, rounds=2, driver_cells=most).collect()
        assert {(r["lang"] == "de", r["probability"]) for r in got} == {(True, 1.0), (False, 0.0)}, most
        with pytest.warns(UserWarning, match="off its target"):
            mixing.mix(corpus(spark), targets={"lang": {"de": 1.0, "xx": 5.0}}, rounds=1, driver_cells=most).collect()
