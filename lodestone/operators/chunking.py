"""Files to chunks: definitions by line rules, else fixed windows; all in one pass without a shuffle."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.languages import definition_kind, language
from lodestone.functions.text import lines, signature_line

WINDOW, OVERLAP = 80, 20
SPAN = "array<struct<start:bigint,end:bigint,kind:string>>"


def with_lines(files: DataFrame) -> DataFrame:
    """Add language and line array."""
    return files.withColumn("language", language("file_path")).withColumn("lines", lines("text"))


def signatures(df: DataFrame) -> DataFrame:
    """Add sigs: (line, kind) of every line that begins a definition."""
    every = F.transform("lines", lambda x, i: F.struct((i + 1).cast("bigint").alias("line"), definition_kind(F.col("language"), x).alias("kind")))
    return df.withColumn("sigs", F.filter(every, lambda s: s["kind"].isNotNull()))


def windows(n: Column) -> Column:
    """Spans of WINDOW lines that overlap by OVERLAP, up to the one that reaches the end."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(WINDOW - OVERLAP)), lambda s: (n > 0) & ((s == 1) | (s + OVERLAP - 1 < n)))
    return F.transform(starts, lambda s: F.struct(s.cast("bigint").alias("start"), F.least(s + WINDOW - 1, n).cast("bigint").alias("end"), F.lit("Text").alias("kind")))


def definitions(sigs: Column, n: Column) -> Column:
    """Spans from each definition to the line before the next one. What precedes the first belongs to none."""
    return F.transform(
        sigs,
        lambda s, i: F.struct(s["line"].alias("start"), F.coalesce(F.get(sigs, i + 1)["line"] - 1, n.cast("bigint")).alias("end"), s["kind"].alias("kind")),
    )


def gaps(spans: Column, line_array: Column) -> Column:
    """Runs of lines that no span covers and that aren't blank, as Module spans."""
    numbered = F.transform(line_array, lambda x, i: F.when(F.trim(F.translate(x, "\t", " ")) != "", i + 1))
    open_lines = F.array_except(F.filter(numbered, lambda x: x.isNotNull()), F.flatten(F.transform(spans, lambda s: F.sequence(s["start"].cast("int"), s["end"].cast("int")))))
    firsts = F.array_except(open_lines, F.transform(open_lines, lambda x: x + 1))
    lasts = F.array_except(open_lines, F.transform(open_lines, lambda x: x - 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"), F.lit("Module").alias("kind")))


def content_hash(path: Column, start: Column, end: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", path, start.cast("string"), end.cast("string"), text))


def vector_key(hash_: Column) -> Column:
    """A positive 60-bit number for a chunk."""
    return F.conv(F.substring(F.md5(hash_), 1, 15), 16, 10).cast("bigint")


def assemble(df: DataFrame, spans: Column, keep: list[str]) -> DataFrame:
    """A row for each span of each file: its text under a path header, its hash as id, its key and signature."""
    cut = df.select(*keep, "language", "lines", F.explode(spans).alias("s"))
    body = F.array_join(F.slice("lines", F.col("s.start").cast("int"), (F.col("s.end") - F.col("s.start") + 1).cast("int")), "\n")
    out = cut.select(*keep, "language", F.col("s.start").alias("start_line"), F.col("s.end").alias("end_line"), F.col("s.kind").alias("kind"), F.concat(F.lit("// "), "file_path", F.lit("\n\n"), body).alias("text"))
    out = out.withColumn("chunk_id", content_hash(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("text")))
    return out.withColumn("vector_key", vector_key(F.col("chunk_id"))).withColumn("signature", F.when(F.col("kind").isin("Function", "Class", "Module"), signature_line("text")).otherwise(F.lit("")))


def chunk_files(files: DataFrame, keep: tuple[str, ...] = ("workspace_id", "file_path")) -> DataFrame:
    """Chunks of files (workspace_id, file_path, text): definitions where there are any, else windows."""
    df = signatures(with_lines(files))
    n = F.size("lines")
    spans = F.when(F.size("sigs") > 0, definitions(F.col("sigs"), n)).otherwise(windows(n))
    return assemble(df, spans, list(keep))


def chunk_windows(files: DataFrame, keep: tuple[str, ...] = ("workspace_id", "file_path")) -> DataFrame:
    return assemble(with_lines(files), windows(F.size("lines")), list(keep))


def syntax_chunks(files: DataFrame, keep: tuple[str, ...] = ("workspace_id", "file_path")) -> DataFrame:
    """Chunks along syntax trees: Python files by the standard library's parser, with gaps filled; others as in chunk_files.

    Only the parser's spans come from Python code; a file that doesn't parse is treated like the others.
    """
    @F.pandas_udf(SPAN)
    def parsed(path: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(path, text, strict=True):
            found = []
            if p.endswith((".py", ".pyi")) and t:
                try:
                    nodes = list(ast.walk(ast.parse(t)))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    nodes = []
                for node in nodes:
                    if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                        found.append({"start": node.lineno, "end": node.end_lineno, "kind": "Class" if isinstance(node, ast.ClassDef) else "Function"})
            out.append(sorted(found, key=lambda s: (s["start"], s["end"])))
        return pd.Series(out)

    df = signatures(with_lines(files)).withColumn("tree", parsed("file_path", "text"))
    n = F.size("lines")
    whole = F.array_sort(F.concat("tree", gaps(F.col("tree"), F.col("lines"))))
    spans = F.when(F.size("tree") > 0, whole).when(F.size("sigs") > 0, definitions(F.col("sigs"), n)).otherwise(windows(n))
    return assemble(df, spans, list(keep))
