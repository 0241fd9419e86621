"""Token counts: rollups maintained by deltas, in batches that commit once.

A batch of changes (inserts, deletes, revised counts) is reduced to signed sums
by source, language and tokenizer version and written as a small Parquet
folder. It counts from the moment its log entry exists: entries are numbered
files that appear whole and only where none is, so of two writers one gets a
number and the other looks at the log again before it goes on to the next. That
takes a file system with such a step: a hard link on local ones, a rename that
refuses to replace on HDFS. Object stores have none: there only one writer at a
time may commit. A batch id that the log has is not committed again. Totals are sums over the committed folders; ``compact`` replaces them by
one. Deltas are additive, so neither reads documents again.

Defined results: null source and language are groups of their own; repeated
changes count as often as they come; an empty batch commits and changes nothing;
changes with a null kind or count are refused; columns that changes have besides
aren't read; totals that come to no documents and no tokens are left out. Texts
aren't read, so their length doesn't matter.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
CHANGES = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Signed sums of changes: kind insert, delete or revise; tokens (new or removed), old_tokens (revise only)."""
    kind = F.col("kind")
    bad = F.raise_error(F.lit("a change needs a kind (insert, delete or revise) and its counts"))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(bad.cast("int"))
    tokens = F.when(kind == "insert", F.col("tokens")).when(kind == "delete", -F.col("tokens")).when(kind == "revise", F.col("tokens") - F.col("old_tokens"))
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("documents"), F.sum(F.coalesce(tokens, bad.cast("long"))).cast("long").alias("tokens"))


class Rollup:
    """Totals below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._read = lambda p: bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(p)).decode()

    def _entries(self) -> list[dict]:
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return []
        out = []
        for name in sorted(s.getPath().getName() for s in self._fs.listStatus(log)):
            if not name.endswith(".json"):
                continue
            stream = self._fs.open(self._path(f"{self.root}/_log/{name}"))
            try:
                out.append(json.loads(self._read(stream)))
            finally:
                stream.close()
        return out

    def _append(self, entry: dict, seen: int) -> bool:
        """Create log entry number ``seen``; False if another writer has it."""
        whole = self._path(f"{self.root}/_log/{seen:012d}.json")
        part = self._path(f"{self.root}/_tmp/{uuid.uuid4().hex}.json")
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        self._fs.mkdirs(whole.getParent())
        try:
            if self._fs.getUri().getScheme() == "file":
                plain = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self.spark._jvm.java.nio.file.Files.createLink(plain(whole), plain(part))
                except Py4JJavaError as e:
                    if "FileAlreadyExists" in e.java_exception.getClass().getName():
                        return False
                    raise
                return True
            return not self._fs.exists(whole) and bool(self._fs.rename(part, whole))
        finally:
            if self._fs.exists(part):
                self._fs.delete(part, False)

    def committed(self) -> set[str]:
        return {b for e in self._entries() for b in e["batches"]}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it is committed already."""
        if batch in self.committed():
            return False
        folder = f"data/{uuid.uuid4().hex}"
        signed(changes).coalesce(1).write.parquet(f"{self.root}/{folder}")
        while True:
            entries = self._entries()
            if batch in {b for e in entries for b in e["batches"]}:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)
                return False
            if self._append({"batches": [batch], "folder": folder, "replaces": []}, len(entries)):
                return True

    def _folders(self, entries: list[dict]) -> list[str]:
        gone = {f for e in entries for f in e["replaces"]}
        return [e["folder"] for e in entries if e["folder"] not in gone]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over the committed batches."""
        folders = self._folders(self._entries())
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Replace the folders committed so far by one; a reader sees either these or that."""
        entries = self._entries()
        folders = self._folders(entries)
        if len(folders) < 2:
            return
        folder = f"data/{uuid.uuid4().hex}"
        self.totals().coalesce(1).write.parquet(f"{self.root}/{folder}")
        while not self._append({"batches": [], "folder": folder, "replaces": folders}, len(self._entries())):
            pass


def counted(docs: DataFrame, tokenizers: dict[str, Column], keep: list[str]) -> DataFrame:
    """``keep`` columns and a row for each tokenizer version with its count; null counts are 0."""
    pairs = F.array(*[F.struct(F.lit(k).alias("tokenizer"), F.coalesce(c, F.lit(0)).cast("long").alias("tokens")) for k, c in tokenizers.items()])
    return docs.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.tokenizer", "p.tokens")
