"""The driver's heap is collected once it has grown, and only then."""

from types import SimpleNamespace

from lodestone import storage


def test_a_grown_heap_is_collected_once(monkeypatch):
    monkeypatch.setattr(storage, "_heap_left", 0)
    state, asked = {"total": 300}, []

    def collect():
        asked.append(state["total"])
        state["total"] -= 50

    heap = SimpleNamespace(totalMemory=lambda: state["total"], maxMemory=lambda: 750)
    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap), System=SimpleNamespace(gc=collect))
    spark = SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))
    storage.rest(spark)
    assert asked == []
    state["total"] = 600
    storage.rest(spark)
    storage.rest(spark)
    assert asked == [600]
    state["total"] = 700
    storage.rest(spark)
    assert asked == [600, 700]


def test_a_cut_frame_outlives_a_collection(spark, monkeypatch):
    monkeypatch.setattr(storage, "_heap_left", 0)
    asked = []
    monkeypatch.setattr(storage, "rest", lambda s: asked.append(s._jvm.java.lang.System.gc()))
    first = storage.cut(spark.range(100).selectExpr("id % 7 as k").groupBy("k").count())
    second = storage.cut(first.where("k > 2"))
    assert len(asked) == 2 and (first.count(), second.count()) == (7, 4)
