import uuid

import pytest

from lodestone.llm import rollups


@pytest.fixture
def ledger(spark, tmp_path):
    return rollups.Rollup(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


def changes(spark, rows):
    return spark.createDataFrame(rows, rollups.CHANGES)


def totals(ledger):
    return {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()}


def test_signed_changes_and_replays(spark, ledger):
    assert totals(ledger) == {}
    first = changes(spark, [("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, None, "t1", 0, None), ("insert", "b", "en", "t2", 7, None)])
    assert ledger.commit("1", first)
    assert not ledger.commit("1", first)
    assert totals(ledger) == {("a", "en", "t1"): (2, 15), (None, None, "t1"): (1, 0), ("b", "en", "t2"): (1, 7)}
    assert ledger.commit("2", changes(spark, [("delete", "a", "en", "t1", 5, None), ("revise", "a", "en", "t1", 12, 10), ("delete", "b", "en", "t2", 7, None)]))
    want = {("a", "en", "t1"): (1, 12), (None, None, "t1"): (1, 0)}
    assert totals(ledger) == want
    ledger.compact()
    assert totals(ledger) == want and ledger.committed() == {"1", "2"}
    assert not ledger.commit("2", first)
    assert ledger.commit("3", changes(spark, []))
    assert totals(ledger) == want


def test_a_batch_that_fails_leaves_nothing(spark, ledger):
    with pytest.raises(Exception, match="a change needs"):
        ledger.commit("1", changes(spark, [("insert", "a", "en", "t1", None, None)]))
    with pytest.raises(Exception, match="a change needs"):
        ledger.commit("1", changes(spark, [("upsert", "a", "en", "t1", 1, None)]))
    assert ledger.committed() == set() and totals(ledger) == {}
    assert ledger.commit("1", changes(spark, [("insert", "a", "en", "t1", 1, None)]))


def test_two_writers_get_different_entries(spark, ledger):
    other = rollups.Rollup(spark, ledger.root)
    assert ledger._append({"batches": ["x"], "folder": "data/none", "replaces": []}, 0)
    assert not other._append({"batches": ["y"], "folder": "data/none", "replaces": []}, 0)
    assert other.committed() == {"x"}


def test_writers_at_the_same_time_lose_no_batch(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    change = spark.createDataFrame([("insert", "s", "en", "v1", 5, None)], rollups.CHANGES)

    def write(i):
        return rollups.Rollup(spark, f"{tmp_path}/r").commit(f"batch {i % 6}", change)

    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(write, range(12)))
    ledger = rollups.Rollup(spark, f"{tmp_path}/r")
    assert sum(done) == 6 and ledger.committed() == {f"batch {i}" for i in range(6)}
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "v1", 6, 30)]
    assert not list((tmp_path / "r" / "_tmp").glob("*.json"))
