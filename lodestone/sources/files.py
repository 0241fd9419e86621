"""A folder as a table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import ignore_rules, ignored

MOST_BYTES = 16 * 1024 * 1024
SNIFFED = 8192
PRINTABLE_SHARE = 0.85


def scan(spark: SparkSession, root: str, ignore_text: str = "", skip_ignored: bool = True) -> DataFrame:
    """(file_path, length, modified_unix, content, is_ignored) of the files below ``root``, up to 16 MiB.

    The size limit is pushed into the scan. ``.git`` folders are left out;
    ignored files are left out or, if asked for, flagged.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("length") <= MOST_BYTES)
    prefix = base if ":" in base.split("/")[0] else f"file:{base}"
    path = F.regexp_replace(F.replace("path", F.lit(prefix + "/"), F.lit("")), "^(file:)?//*", "")
    out = raw.select(path.alias("file_path"), "length", F.unix_timestamp("modificationTime").alias("modified_unix"), "content")
    out = out.where(~F.col("file_path").rlike(r"(^|/)\.git/")).withColumn("is_ignored", ignored("file_path", ignore_rules(ignore_text)))
    return out.where(~F.col("is_ignored")) if skip_ignored else out


def is_text(content: Column | str) -> Column:
    """Whether the first 8 KiB look like text: no NUL, and valid UTF-8 or mostly printable ASCII."""
    head = F.substring(F.col(content) if isinstance(content, str) else content, 1, SNIFFED)
    latin = F.decode(head, "ISO-8859-1")
    printable = F.length(F.regexp_replace(latin, r"[^\n\r\t\x0C\x20-\x7E]", ""))
    return F.when(F.octet_length(head) == 0, False).when(F.contains(latin, F.lit("\x00")), False).when(_valid(head), True).otherwise(printable >= PRINTABLE_SHARE * F.octet_length(head))


def _valid(head: Column) -> Column:
    return F.is_valid_utf8(head.cast("string"))


def decoded(content: Column | str) -> Column:
    """Text of a file's bytes; invalid ones are replaced."""
    return F.make_valid_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))


def text_files(scanned: DataFrame, workspace: str) -> DataFrame:
    """Indexable files with their text."""
    return scanned.where(is_text("content")).select(F.lit(workspace).alias("workspace_id"), "file_path", "length", "modified_unix", "is_ignored", decoded("content").alias("text"))
