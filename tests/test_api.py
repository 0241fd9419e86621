import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone.operators import chunking, embed


@pytest.fixture
def workspace(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "src/tax.rs").write_text("pub fn calculate_tax(a: f64) -> f64 {\n    a * 0.2\n}\n")
    (root / "src/name.rs").write_text("pub fn format_name() {\n}\n")
    (root / "secret.txt").write_text("calculate_tax secret")
    return api.Workspace(spark, str(root), f"file://{tmp_path}/store", "secret.txt\n"), root


def paths(df):
    return [r["file_path"] for r in df.orderBy(F.desc("total_score"), "file_path").collect()]


def test_life_of_a_workspace(workspace):
    w, root = workspace
    assert w.status()["state"] == "NotIndexed"
    assert w.index() == {"indexed_files": 3, "deleted_files": 0, "total_chunks": 3}
    assert w.index()["indexed_files"] == 0
    assert paths(w.search("where is calculate tax"))[0] == "src/tax.rs"
    assert "secret.txt" not in paths(w.search("calculate_tax")) and "secret.txt" in paths(w.search("calculate_tax", with_ignored=True))
    assert paths(w.search("FORMAT_", mode="literal")) == ["src/name.rs"]
    assert paths(w.search(r"pub fn \w+_tax", mode="regex", include="src/*")) == ["src/tax.rs"]
    assert w.has_results("FORMAT_", "literal") and not w.has_results("absent words", "literal")
    assert w.status()["size_bytes"] > 0
    (root / "src/name.rs").unlink()
    (root / "src/new.rs").write_text("fn fresh() {\n}\n")
    assert {r["file_path"]: r["change"] for r in w.pending().collect()} == {"src/name.rs": "deleted", "src/new.rs": "added"}
    assert w.doctor()["state"] == "Unhealthy"
    assert w.index() == {"indexed_files": 1, "deleted_files": 1, "total_chunks": 3}
    assert w.doctor()["healthy"] and w.status()["files"] == 3
    assert api.handle(w, {"command": "search", "query": "fresh", "mode": "literal"})["result"][0]["file_path"] == "src/new.rs"
    assert not api.handle(w, {"command": "search", "query": "x", "mode": "other"})["ok"] and not api.handle(w, {"command": "none"})["ok"]
    assert api.handle(w, {"command": "remove"})["ok"] and w.status()["state"] == "NotIndexed"


def test_find_root(workspace):
    _, root = workspace
    assert api.find_root(str(root)) == (str(root), None)
    assert api.find_root(str(root / "src")) == (str(root), "src")
    assert api.find_root(str(root / "src/tax.rs")) == (str(root), "src/tax.rs")


def test_embedders(spark):
    files = spark.createDataFrame([("w", "a.txt", "one two"), ("w", "b.txt", "three"), ("w", "c.txt", "é" * 3000)], "workspace_id string, file_path string, text string")
    chunks = chunking.chunk_files(files)
    none = spark.createDataFrame([], "vector_key long, embedding array<float>")
    first = embed.enhance(chunks, none).persist()
    got = {r["vector_key"]: np.array(r["embedding"]) for r in first.collect()}
    assert len(got) == 3 and all(len(v) == 384 and abs(np.linalg.norm(v) - 1) < 1e-5 for v in got.values())
    assert embed.enhance(chunks, first).count() == 0
    assert {len(r["embedding"]) for r in embed.hashed(chunks).collect()} == {256}
    assert embed.should_block(files)

    class Broken:
        dimensions = 4

        def embed_batch(self, texts):
            if any("three" in t for t in texts):
                raise RuntimeError("no")
            return np.ones((len(texts), 4), np.float32)

    out = {r["text"]: r["e"] for r in files.select("text", embed.embedded(F.col("text"), Broken).alias("e")).collect()}
    assert out["three"] == [0, 0, 0, 0] and out["one two"] == [1, 1, 1, 1]
