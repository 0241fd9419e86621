"""The driver's tables as files, and index tables with versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import spread, table

#: Folders and extensions that documents are laid out in, in turn by id.
FOLDERS = ("src", "tests", "docs", "vendor", "lib", "config")
EXTENSIONS = (".py", ".rs", ".md", ".js", ".go", ".json")
#: Customers of a nation whose functions make up one source file.
FUNCTIONS = 50


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workspace_id, file_path, text, is_ignored): a file for each document; its source is the workspace."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    turn = (F.col("doc_id") % len(FOLDERS)).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), turn)
    path = F.concat(pick(FOLDERS), F.lit("/"), "source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), pick(EXTENSIONS))
    return d.select(F.col("source").alias("workspace_id"), path.alias("file_path"), F.coalesce("text", F.lit("")).alias("text"), F.startswith(path, F.lit("vendor/")).alias("is_ignored"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files in five languages with a function for each customer of a nation, at most FUNCTIONS to a file."""
    c = table(spark, sf_dir, "customer").select((F.floor(F.col("c_custkey") / FUNCTIONS)).cast("bigint").alias("part"), F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("nation"))
    k, kind = F.col("k").cast("string"), F.col("nation") % 5
    name = F.concat(F.lit("customer_"), F.lpad(k, 9, "0"))
    body = (
        F.when(kind == 0, F.concat(F.lit("pub fn "), name, F.lit("(total: u64) -> u64 {\n    // adds the key\n    total + "), k, F.lit("\n}\n")))
        .when(kind == 1, F.concat(F.lit("def "), name, F.lit("(total):\n    return total + "), k, F.lit("\n\n")))
        .when(kind == 2, F.concat(F.lit("func "), name, F.lit("(total int) int {\n\treturn total + "), k, F.lit("\n}\n")))
        .when(kind == 3, F.concat(F.lit("class Customer"), k, F.lit(" {\n    int balance(int total) {\n        return total + "), k, F.lit(";\n    }\n}\n")))
        .otherwise(F.concat(F.lit("export function calculateTotal"), k, F.lit("(total) {\n  return total + "), k, F.lit(";\n}\n")))
    )
    ext = F.when(kind == 0, ".rs").when(kind == 1, ".py").when(kind == 2, ".go").when(kind == 3, ".java").otherwise(".ts")
    path = F.concat(F.lit("src/nation_"), F.col("nation").cast("string"), F.lit("/part_"), F.col("part").cast("string"), ext)
    rows = c.select(path.alias("file_path"), "k", body.alias("body"))
    whole = rows.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]), "").alias("body"))
    return whole.select(F.lit("code").alias("workspace_id"), "file_path", F.concat(F.lit("# generated from customers\n\n"), "body").alias("text"), F.lit(False).alias("is_ignored"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages"))
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[^A-Za-z0-9./_-]", "_"), F.lit("_"), F.col("page_id").cast("string"), F.lit(".html"))
    return p.select(F.lit("pages").alias("workspace_id"), path.alias("file_path"), F.coalesce("html", F.lit("")).alias("text"), F.lit(False).alias("is_ignored"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and source files together."""
    return document_files(spark, sf_dir).unionByName(code_files(spark, sf_dir))


class Versions:
    """Versions of a set of tables below ``root``; a version counts once the pointer names it, which is written last."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """Path of the version in force; None before the first."""
        at = self._path(f"{self.root}/_current")
        if not self._fs.exists(at):
            return None
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(at))
        names = [n for n in found if not n.startswith((".", "_"))]
        return f"{self.root}/{names[-1].split('-', 1)[1]}" if names else None

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Write all tables to a new folder, then point to it."""
        at = self._path(f"{self.root}/_current")
        number = len(self._fs.listStatus(at)) if self._fs.exists(at) else 0
        name = f"v{uuid.uuid4().hex[:12]}"
        for t, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{t}")
        self._fs.mkdirs(self._path(f"{self.root}/_current/{number:09d}-{name}"))
        return f"{self.root}/{name}"

    def size(self) -> int:
        """Bytes of all tables of the version in force; 0 before the first."""
        at = self.current()
        return 0 if at is None else self._fs.getContentSummary(self._path(at)).getLength()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.current()}/{name}")
