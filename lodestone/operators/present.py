"""Hits: focus line, snippet, reason, grouping by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_lower, compact, singular, truncated
from lodestone.storage import cut, small

CONTEXT = 2
# What a line counts for holding the query, in the same or another case, a token, or the squeezed query.
EXACT, ANY_CASE, TOKEN, SQUEEZED = 8.0, 5.0, 1.5, 3.0


def line_score(line: Column, query: Column, low: Column, tokens: Column, squeezed: Column) -> Column:
    lowered = ascii_lower(line)
    whole = F.when(F.contains(line, query), EXACT).when(F.contains(lowered, low), ANY_CASE).otherwise(0.0)
    named = F.size(F.filter(tokens, lambda t: F.contains(lowered, t))) * TOKEN
    return F.when(query == "", 0.0).otherwise(whole + named + F.when((squeezed != "") & F.contains(compact(line), squeezed), SQUEEZED).otherwise(0.0))


def focus_line(lines: Column, start: Column, end: Column, query: Column, low: Column, tokens: Column, squeezed: Column) -> Column:
    """The first line of the range with the highest score; its first line if none scores."""
    n = F.size(lines)
    first = F.least(F.greatest(start.cast("int"), F.lit(1)), n)
    last = F.least(F.greatest(end.cast("int"), first), n)
    scores = F.transform(F.slice(lines, first, last - first + 1), lambda x: line_score(x, query, low, tokens, squeezed))
    best = F.array_max(scores)
    return (first + F.when(best > 0, F.array_position(scores, best) - 1).otherwise(0)).cast("bigint")


def reason(query: Column, low: Column, tokens: Column, focus: Column) -> Column:
    f = F.trim(focus)
    lowered = ascii_lower(f)
    token = F.get(F.filter(tokens, lambda t: F.contains(lowered, t)), F.lit(0))
    return (
        F.when(f == "", F.lit("top hybrid relevance in this file"))
        .when((query != "") & (F.contains(f, query) | F.contains(lowered, low)), F.concat(F.lit("line contains query terms: "), truncated(f)))
        .when((query != "") & token.isNotNull(), F.concat(F.lit("line matches token `"), token, F.lit("`: "), truncated(f)))
        .otherwise(F.concat(F.lit("top-ranked pointer: "), truncated(f)))
    )


def hits(ranked: DataFrame, files: DataFrame, queries: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Ranked chunks to hits: snippet bounds around the focus line, preview and reason.

    ``files`` has workspace_id, file_path, lines. A chunk whose file is gone
    shows its own text; one of an empty file shows nothing. Only the hit files'
    lines take part in the join.
    """
    ranked = cut(ranked)
    files = files.join(small(ranked.select("workspace_id", "file_path").distinct()), ["workspace_id", "file_path"], "left_semi")
    q = queries.select("query_id", F.trim("query").alias("q"), F.col("low").alias("ql"), F.col("expanded").alias("qt"), singular(F.col("compact")).alias("qs"))
    j = ranked.join(files.select("workspace_id", "file_path", "lines"), ["workspace_id", "file_path"], "left").join(q, "query_id")
    gone, empty = F.col("lines").isNull(), F.size("lines") <= 0
    j = j.withColumn("focus", F.when(~gone & ~empty, focus_line(F.col("lines"), F.col("start_line"), F.col("end_line"), F.col("q"), F.col("ql"), F.col("qt"), F.col("qs"))))
    lo, hi = F.greatest(F.lit(1), F.col("focus") - context), F.least(F.size("lines"), F.col("focus") + context)
    line = F.get("lines", (F.col("focus") - 1).cast("int"))
    return j.select(
        "query_id", "workspace_id", "file_path", "chunk_id",
        F.when(gone | empty, F.col("start_line")).otherwise(lo).cast("bigint").alias("start_line"),
        F.when(gone, F.col("end_line")).when(empty, F.col("start_line")).otherwise(hi).cast("bigint").alias("end_line"),
        F.when(gone, F.col("text")).when(empty, F.lit("")).otherwise(F.array_join(F.slice("lines", lo.cast("int"), (hi - lo + 1).cast("int")), "\n")).alias("preview"),
        F.when(gone, F.lit("file no longer on disk")).when(empty, F.lit("empty file")).otherwise(reason(F.col("q"), F.col("ql"), F.col("qt"), line)).alias("reason"),
        "score", "sources",
    )


def group_by_file(found: DataFrame, limit: int | None = None, keys: tuple[str, ...] = ("query_id", "workspace_id")) -> DataFrame:
    """(keys, file_path, total_score, hit_count, hits): hits by score and line, files by total and path.

    A file's hits are those of one query's final list, a few at most.
    """
    one = F.struct((-F.round("score", 9)).alias("order"), "start_line", "end_line", "preview", "reason", "score", "sources")
    files = found.groupBy(*keys, "file_path").agg(F.sum("score").alias("total_score"), F.count("*").alias("hit_count"), F.sort_array(F.collect_list(one)).alias("hits"))
    if limit is None:
        return files
    w = Window.partitionBy("query_id").orderBy(F.round("total_score", 9).desc(), "file_path")
    return files.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).drop("nth")


def first_line_only(found: DataFrame) -> DataFrame:
    return found.withColumn("preview", F.split("preview", "\n").getItem(0))


def file_names(found: DataFrame) -> DataFrame:
    return found.select("query_id", "workspace_id", "file_path").distinct()


def as_json(found: DataFrame) -> DataFrame:
    return found.select(F.to_json(F.struct(*found.columns)).alias("json"))
