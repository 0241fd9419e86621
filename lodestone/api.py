"""One workspace and what can be asked of it: index, search in three modes, status, doctor, remove."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import globs_of
from lodestone.functions.text import lines
from lodestone.operators import candidates, maintain, present
from lodestone.operators.chunking import chunk_files
from lodestone.plans import search
from lodestone.sources import files as source_files
from lodestone.sources.tables import Versions

MODES = ("hybrid", "literal", "regex")


def find_root(path: str) -> tuple[str, str | None]:
    """(root, scope): the nearest folder above that holds ``.git``, and what of ``path`` lies below it."""
    at = Path(path).resolve()
    start = at if at.is_dir() else at.parent
    for folder in (start, *start.parents):
        if (folder / ".git").exists():
            below = os.path.relpath(at, folder)
            return str(folder), None if below == "." else below
    return str(start), None if at.is_dir() else at.name


class Workspace:
    """A folder of files and its index tables below ``store``.

    A version of the tables counts once its pointer is written, last of all; a
    run that breaks off leaves the version before it in force.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, ignore_text: str = "") -> None:
        self.spark, self.root, self.ignore_text = spark, root, ignore_text
        self.versions = Versions(spark, store)

    def files(self, with_ignored: bool = True) -> DataFrame:
        found = source_files.scan(self.spark, self.root, self.ignore_text, skip_ignored=not with_ignored)
        return source_files.text_files(found, self.root)

    def index(self) -> dict[str, Any]:
        """Bring the tables up to date: only changed files are chunked again. Nothing is written if nothing changed."""
        files = self.files()
        snap = maintain.snapshot(files)
        keep = ("workspace_id", "file_path", "is_ignored")
        if self.versions.current() is None:
            n, gone, chunks = files.count(), 0, chunk_files(files, keep)
        else:
            old = self.versions.read("snapshot")
            roots = [df.select("root_hash").collect() for df in (maintain.root_hash(old), maintain.root_hash(snap))]
            if roots[0] == roots[1]:
                return {"indexed_files": 0, "deleted_files": 0, "total_chunks": self.versions.read("chunks").count()}
            changed = maintain.diff(old, snap).persist()
            counts = {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
            n, gone = counts.get("added", 0) + counts.get("modified", 0), counts.get("deleted", 0)
            touched = files.join(changed.where("change <> 'deleted'").select(*maintain.KEY), list(maintain.KEY), "left_semi")
            chunks = maintain.apply_delta(self.versions.read("chunks"), changed, chunk_files(touched, keep))
        self.versions.write({"chunks": chunks, "snapshot": snap, "metadata": self.spark.createDataFrame([(self.root, int(time.time()))], "root string, last_indexed_at_unix long")})
        return {"indexed_files": n, "deleted_files": gone, "total_chunks": self.versions.read("chunks").count()}

    def pending(self) -> DataFrame:
        """Changes of the folder since it was indexed."""
        return maintain.diff(self.versions.read("snapshot"), maintain.snapshot(self.files()))

    def search(self, query: str, mode: str = "hybrid", include: str = "", exclude: str = "", **options: Any) -> DataFrame:
        """Results grouped by file; ``include`` and ``exclude`` are comma-separated globs."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        o = search.Options(include=globs_of(include), exclude=globs_of(exclude), **options)
        files = search.restricted(self.files(), search.Options(include=o.include, exclude=o.exclude, scope=o.scope, scope_is_file=o.scope_is_file, with_ignored=o.with_ignored))
        if mode == "hybrid":
            queries = search.query_table(self.spark, [query])
            best = search.ranked(search.restricted(self.versions.read("chunks"), o), queries, o)
            found = present.hits(best, files.select("workspace_id", "file_path", lines("text").alias("lines")), queries, o.context)
        else:
            got = search.literal_search(files, query, o).withColumnRenamed("line_no", "start_line") if mode == "literal" else candidates.regex_lines(files, query).select("workspace_id", "file_path", F.col("line_no").alias("start_line"), F.trim("line").alias("preview"))
            found = got.select(F.lit(1).cast("bigint").alias("query_id"), "workspace_id", "file_path", "start_line", F.col("start_line").alias("end_line"), "preview", F.lit("").alias("reason"), F.lit(1.0).alias("score"), F.array(F.lit(mode)).alias("sources"))
        return present.group_by_file(found, o.limit)

    def has_results(self, query: str, mode: str = "hybrid", **options: Any) -> bool:
        """Whether a search finds anything."""
        return not self.search(query, mode, **options).isEmpty()

    def status(self) -> dict[str, Any]:
        if self.versions.current() is None:
            return {"root": self.root, "state": "NotIndexed"}
        stats = maintain.index_stats(self.versions.read("chunks")).collect()
        at = self.versions.read("metadata").first()["last_indexed_at_unix"]
        return {"root": self.root, "state": "Indexed", "chunks": sum(r["n_chunks"] for r in stats), "files": sum(r["n_files"] for r in stats), "size_bytes": self.versions.size(), "last_indexed_at_unix": at}

    def doctor(self, repair: bool = False) -> dict[str, Any]:
        """State and counts; with ``repair`` an unhealthy index is built anew."""
        if self.versions.current() is None:
            return {"state": "NotIndexed", "healthy": False, "repaired": bool(repair and self.index())}
        row = maintain.health(self.files(), self.versions.read("chunks")).first()
        state = row["state"] if row else "HealthyEmpty"
        out = {"state": state, "healthy": state.startswith("Healthy"), "repaired": False} | (row.asDict() if row else {})
        if repair and not out["healthy"]:
            self.remove()
            self.index()
            out["repaired"] = True
        return out

    def remove(self) -> None:
        """Drop the index tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.versions.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def handle(workspace: Workspace, request: dict[str, Any]) -> dict[str, Any]:
    """Answer a request {"command": index, search, status, doctor or remove, ...} with a plain dictionary."""
    args = {k: v for k, v in request.items() if k != "command"}
    try:
        match request.get("command"):
            case "index":
                return {"ok": True, "result": workspace.index()}
            case "search":
                return {"ok": True, "result": [json.loads(x) for x in workspace.search(**args).toJSON().collect()]}
            case "status":
                return {"ok": True, "result": workspace.status()}
            case "doctor":
                return {"ok": True, "result": workspace.doctor(**args)}
            case "remove":
                workspace.remove()
                return {"ok": True, "result": None}
            case other:
                return {"ok": False, "error": f"unknown command: {other}"}
    except (ValueError, TypeError) as e:
        return {"ok": False, "error": str(e)}
