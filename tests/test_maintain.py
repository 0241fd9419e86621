from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import maintain
from lodestone.sources import files as source_files
from lodestone.sources.tables import Versions
from lodestone.streaming import watch

SNAP = "workspace_id string, file_path string, file_hash string, is_ignored boolean"
MAPS = st.dictionaries(st.from_regex(r"[a-z]{1,6}\.(rs|py|ts)", fullmatch=True), st.sampled_from(["00", "11", "22"]), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=MAPS, b=MAPS)
def test_diff_equals_naive_diff(spark, a, b):
    frame = lambda m: spark.createDataFrame([("w", p, h, False) for p, h in m.items()], SNAP)
    got = {r["file_path"]: r["change"] for r in maintain.diff(frame(a), frame(b)).collect()}
    want = {p: "added" for p in b.keys() - a.keys()} | {p: "deleted" for p in a.keys() - b.keys()} | {p: "modified" for p in a.keys() & b.keys() if a[p] != b[p]}
    assert got == want


def files(spark, rows):
    return spark.createDataFrame([("w", p, t, False) for p, t in rows], "workspace_id string, file_path string, text string, is_ignored boolean")


def test_root_hash_ignores_order_and_sees_changes(spark):
    rows = [(f"f{i}.rs", f"text {i}") for i in range(30)]
    root = lambda r: maintain.root_hash(maintain.snapshot(files(spark, r))).first()["root_hash"]
    assert root(rows) == root(rows[::-1]) != root([*rows[:-1], ("f29.rs", "other")])


def test_delta_and_overlay(spark):
    base = files(spark, [("keep.rs", "a"), ("remove_me.rs", "b"), ("change.rs", "c")])
    changed = spark.createDataFrame([("w", "change.rs"), ("w", "remove_me.rs")], "workspace_id string, file_path string")
    new = files(spark, [("change.rs", "d")])
    want = [("change.rs", "d"), ("keep.rs", "a")]
    assert sorted((r["file_path"], r["text"]) for r in maintain.apply_delta(base, changed, new).collect()) == want
    tomb = spark.createDataFrame([("w", "remove_me.rs")], "workspace_id string, file_path string")
    assert sorted((r["file_path"], r["text"]) for r in maintain.overlay(base, new, tomb).collect()) == want


def test_nested_roots(spark):
    df = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",), ("ab",), ("x/y",)], "root string")
    assert {tuple(r) for r in maintain.nested_roots(df).collect()} == {("a", "a/b"), ("a", "a/b/c"), ("a/b", "a/b/c")}


def test_health(spark):
    got = maintain.health(files(spark, [("a", "x"), ("b", "")]), spark.createDataFrame([("w", "a"), ("w", "gone")], "workspace_id string, file_path string")).first()
    assert (got["n_files"], got["n_chunks"], got["files_without_chunks"], got["orphan_files"], got["state"]) == (2, 2, 0, 1, "Unhealthy")


def test_scan_sniffs_ignores_and_decodes(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "sub").mkdir()
    for name, data in {".git/config": b"x", "a.rs": b"fn a() {}\n", "sub/b.log": b"log", "bin.dat": b"a\x00b", "bad.txt": b"ok \xff text", "empty.txt": b"", "noise": bytes(range(128, 256)) * 9}.items():
        (tmp_path / name).write_bytes(data)
    got = source_files.scan(spark, str(tmp_path), "*.log\n")
    # Spark's file sources list no empty files; there is nothing to index in them
    assert sorted(r["file_path"] for r in got.collect()) == ["a.rs", "bad.txt", "bin.dat", "noise"]
    flagged = {r["file_path"]: r["is_ignored"] for r in source_files.scan(spark, str(tmp_path), "*.log\n", skip_ignored=False).collect()}
    assert flagged["sub/b.log"] and not flagged["a.rs"]
    texts = {r["file_path"]: r["text"] for r in source_files.text_files(got, "w").collect()}
    assert texts == {"a.rs": "fn a() {}\n", "bad.txt": "ok \ufffd text"}
    plan = got._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,16777216)]" in plan


def test_versions_count_once_the_pointer_names_them(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    assert v.current() is None
    v.write({"t": spark.range(3)})
    v.write({"t": spark.range(5)})
    assert v.read("t").count() == 5


def test_stream_of_changes(spark, tmp_path):
    events, root = tmp_path / "events", f"file://{tmp_path}/index"
    events.mkdir()
    line = '{{"workspace_id":"w","file_path":"{0}","seq":{1},"deleted":{2},"text":"{3}"}}\n'
    run = lambda: watch.watch(spark, f"file://{events}", root, f"file://{tmp_path}/check").awaitTermination(60)
    (events / "1.json").write_text(line.format("a.rs", 1, "false", "fn old() {}") + line.format("a.rs", 2, "false", "fn new() {}") + line.format("b.rs", 3, "false", "fn b() {}"))
    assert run()
    read = lambda: sorted((r["file_path"], r["signature"]) for r in Versions(spark, root).read("chunks").collect())
    assert read() == [("a.rs", "fn new() {}"), ("b.rs", "fn b() {}")]
    (events / "2.json").write_text(line.format("b.rs", 4, "true", "") + line.format("c.rs", 5, "false", "fn c() {}"))
    assert run()
    assert read() == [("a.rs", "fn new() {}"), ("c.rs", "fn c() {}")]


def test_snapshot_by_time(spark):
    df = spark.createDataFrame([("w", "a", 5, 100, False)], "workspace_id string, file_path string, length long, modified_unix long, is_ignored boolean")
    one = maintain.snapshot_by_time(df).first()["file_hash"]
    other = maintain.snapshot_by_time(df.withColumn("modified_unix", F.lit(101).cast("long"))).first()["file_hash"]
    assert one != other and one.endswith("-0")
