"""Snapshots, diffs, deltas and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("workspace_id", "file_path")


def snapshot(files: DataFrame) -> DataFrame:
    """(workspace_id, file_path, file_hash) by path, content and whether the file is ignored."""
    flag = F.when(F.col("is_ignored"), "-1").otherwise("-0")
    return files.select(*KEY, "is_ignored", F.concat(F.md5(F.concat("file_path", F.lit("|"), "text")), flag).alias("file_hash"))


def snapshot_by_time(files: DataFrame) -> DataFrame:
    """The same by path, length and modification time, without reading contents."""
    flag = F.when(F.col("is_ignored"), "-1").otherwise("-0")
    return files.select(*KEY, "is_ignored", F.concat(F.md5(F.concat_ws("|", "file_path", F.col("length").cast("string"), F.col("modified_unix").cast("string"))), flag).alias("file_hash"))


def root_hash(snap: DataFrame) -> DataFrame:
    """(workspace_id, root_hash, n_files), whatever the order of the rows.

    A tree over the paths' hash digits: files by the first four, these by the
    first two, these for the root, so that no task gathers all files of a
    workspace.
    """
    level = snap.select("workspace_id", F.substring(F.md5("file_path"), 1, 4).alias("part"), F.concat("file_path", "file_hash").alias("leaf"), F.lit(1).cast("bigint").alias("n"))
    for digits in (2, 0):
        nodes = level.groupBy("workspace_id", "part").agg(F.md5(F.array_join(F.array_sort(F.collect_list("leaf")), "")).alias("h"), F.sum("n").alias("n"))
        level = nodes.select("workspace_id", F.substring("part", 1, digits).alias("part") if digits else F.lit("").alias("part"), F.concat("part", "h").alias("leaf"), "n")
    return level.groupBy("workspace_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("leaf")), "")).alias("root_hash"), F.sum("n").alias("n_files"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(workspace_id, file_path, change, is_ignored): added, modified or deleted files of two snapshots."""
    a = old.select(*KEY, F.col("file_hash").alias("old_hash"))
    b = new.select(*KEY, F.col("file_hash").alias("new_hash"), "is_ignored")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return a.join(b, list(KEY), "full_outer").select(*KEY, change.alias("change"), F.coalesce("is_ignored", F.lit(False)).alias("is_ignored")).where("change is not null")


def apply_delta(old: DataFrame, changed: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Rows of unchanged files and ``new_rows``: delete, then insert, by file."""
    return old.join(changed.select(*KEY).distinct(), list(KEY), "left_anti").unionByName(new_rows)


def overlay(base: DataFrame, over: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of the overlay, and those base rows whose file it neither has nor marks as gone."""
    hidden = over.select(*KEY).unionByName(tombstones.select(*KEY)).distinct()
    return base.join(hidden, list(KEY), "left_anti").unionByName(over)


def nested_roots(roots: DataFrame) -> DataFrame:
    """(parent, child) of roots that lie below another one. A root is joined with the prefixes of the others, not compared with all."""
    parts = F.split("root", "/")
    above = roots.select(F.col("root").alias("child"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("parent"))
    return above.join(roots.select(F.col("root").alias("parent")), "parent").where("parent <> child").select("parent", "child")


def index_stats(chunks: DataFrame) -> DataFrame:
    """(workspace_id, n_chunks, n_files)."""
    return chunks.groupBy("workspace_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"))


def health(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(workspace_id, n_files, n_chunks, files_without_chunks, orphan_files, state)."""
    have = chunks.groupBy(*KEY).agg(F.count("*").alias("n"))
    both = files.select(*KEY, F.lit(1).alias("there"), (F.length("text") > 0).alias("has_text")).join(have, list(KEY), "full_outer")
    facts = both.groupBy("workspace_id").agg(
        F.count("there").alias("n_files"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"),
        F.sum((F.col("n").isNull() & F.coalesce("has_text", F.lit(False))).cast("bigint")).alias("files_without_chunks"),
        F.sum(F.col("there").isNull().cast("bigint")).alias("orphan_files"),
    )
    state = F.when((F.col("orphan_files") > 0) | (F.col("files_without_chunks") > 0), "Unhealthy").when(F.col("n_files") == 0, "NotIndexed").when(F.col("n_chunks") == 0, "HealthyEmpty").otherwise("Healthy")
    return facts.withColumn("state", state)


def status(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row for each workspace: files, bytes, chunks, vectors and whether vectors are missing."""
    f = files.groupBy("workspace_id").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("text").cast("bigint")).alias("n_bytes"))
    c = chunks.join(vectors.select("vector_key").distinct().withColumn("__v", F.lit(1)), "vector_key", "left").groupBy("workspace_id").agg(F.count("*").alias("n_chunks"), F.count("__v").alias("n_vectors"))
    j = f.join(c, "workspace_id", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return j.select("workspace_id", "n_files", "n_bytes", zero("n_chunks"), zero("n_vectors"), (F.coalesce("n_vectors", F.lit(0)) < F.coalesce("n_chunks", F.lit(0))).alias("needs_vectors"))
