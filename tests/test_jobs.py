import threading
import time

import pytest

from lodestone.streaming import jobs


def test_ledger(spark, tmp_path):
    ledger = jobs.Ledger(spark, f"file://{tmp_path}/jobs")
    ledger.beat("w", "1", "Indexing", "scan", now=100)
    ledger.beat("w", "1", "Indexing", "write", now=110, files="3")
    ledger.beat("w", "2", "Watcher", "idle", now=110)
    ledger.beat("w", "3", "Watcher", "idle", now=90, active=False)
    got = {r["job"]: (r["phase"], r["stalled"], r["details"]) for r in ledger.jobs(now=128).collect()}
    assert got == {"1": ("write", False, {"files": "3"}), "2": ("idle", True, {}), "3": ("idle", False, {})}


def test_cancel(spark):
    failed = []

    def work():
        with jobs.cancellable(spark, "stop-me"):
            try:
                spark.range(0, 10**13, 1, 4).selectExpr("sum(id * id % 7)").collect()
            except Exception as e:
                failed.append(e)

    t = threading.Thread(target=work)
    t.start()
    for _ in range(100):
        time.sleep(0.2)
        jobs.cancel(spark, "stop-me")
        if not t.is_alive():
            break
    t.join(10)
    assert failed and not t.is_alive()
    with pytest.raises(ZeroDivisionError), jobs.cancellable(spark):
        1 / 0  # noqa: B018
