"""Weighted reciprocal-rank fusion, feature scores, decay by file and the adaptive cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import authority, is_definition, is_test, kind_factor
from lodestone.functions.text import ascii_lower, compact, lines
from lodestone.storage import small

# Constants of the ranking.
RANK_OFFSET = 60
LIST_WEIGHTS = {"lexical": 3.2, "semantic": 1.0, "literal": 4.0}
LEXICAL_SCORE, SEMANTIC_SCORE, SEMANTIC_ONLY = 0.05, 0.08, 0.60
COVERAGE, PATH_SEGMENT, FILE_STEM, DEFINITION, LOCATION, PATH_EXACT = 0.35, 0.40, 0.50, 0.25, 0.20, 3.0
NO_COVERAGE, FILE_POWER = 0.5, 0.3
DECAY = ((2, 1.0), (4, 0.4))
DECAY_REST = 0.1
CUTOFF_SHARE, CUTOFF_LEAST = 0.35, 0.010


def fraction(tokens: Column, test) -> Column:
    """Share of the tokens for which ``test`` holds; 0 without tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, test)).cast("double") / F.size(tokens)).otherwise(0.0)


def term_coverage(text: Column, tokens: Column) -> Column:
    low = ascii_lower(text)
    return fraction(tokens, lambda t: F.contains(low, t))


def path_segments(path: Column, tokens: Column) -> Column:
    parts = F.split(ascii_lower(path), "/")
    return fraction(tokens, lambda t: F.exists(parts, lambda p: F.contains(p, t)))


def path_exact(path: Column, low: Column) -> Column:
    """1, 0.7 or 0.4: the query is a part of the path, begins or ends one, or (four characters or more) occurs in the path.

    The first part, in order, that matches some form of the query decides.
    """
    p = ascii_lower(path)
    forms = F.array(low, F.replace(low, F.lit(" "), F.lit("-")), F.replace(low, F.lit(" "), F.lit("_")), F.replace(low, F.lit(" "), F.lit("")))
    one = lambda part: F.filter(F.transform(forms, lambda c: F.when(part == c, 1.0).when((F.length(part) > F.length(c)) & (F.startswith(part, c) | F.endswith(part, c)), 0.7)), lambda x: x.isNotNull())
    hits = F.flatten(F.transform(F.split(p, "/"), one))
    inside = F.exists(forms, lambda c: (F.length(c) >= 4) & F.contains(p, c))
    return F.when(low == "", 0.0).when(F.size(hits) > 0, F.get(hits, F.lit(0))).when(inside, 0.4).otherwise(0.0)


def stem(path: Column) -> Column:
    """File name without its last extension, in lower case."""
    return ascii_lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"^(.+)\.[^.]*$", "$1"))


def file_stem(path: Column, tokens: Column) -> Column:
    s = stem(path)
    return F.when(F.exists(tokens, lambda t: (s == t) | (compact(s) == compact(t))), 1.0).when(F.exists(tokens, lambda t: F.contains(s, t)), 0.5).otherwise(0.0)


def location(kind: Column, path: Column) -> Column:
    add = lambda test, value: F.when(test, value).otherwise(0.0)
    total = add(is_definition(kind), 0.7) + add(F.initcap(kind) == "Module", 0.5) + add(ascii_lower(path).rlike("^(src|app|lib|pkg)/"), 0.35) - add(is_test(path), 0.35)
    return F.greatest(F.lit(0.0), total)


def definition_name(text: Column, tokens: Column) -> Column:
    """Share of the tokens in the first line that is neither blank nor a comment."""
    line = ascii_lower(F.coalesce(F.get(F.filter(lines(text), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^(//|#)")), F.lit(0)), F.lit("")))
    return F.when(line == "", 0.0).otherwise(fraction(tokens, lambda t: F.contains(line, t)))


def literal(text: Column, path: Column, low: Column, compacted: Column) -> Column:
    plain = F.contains(ascii_lower(text), low) | F.contains(ascii_lower(path), low)
    squeezed = (compacted != "") & (F.contains(compact(text), compacted) | F.contains(compact(path), compacted))
    return F.when(low == "", 0.0).when(plain, 0.20).when(squeezed, 0.10).otherwise(0.0)


def lexical_norm(score: Column) -> Column:
    return F.when(score > 0, F.log1p(score)).otherwise(0.0)


def semantic_norm(score: Column) -> Column:
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return F.when(clamped > 0, F.log(2 * clamped + 1)).otherwise(0.0)


def merge_lists(lexical: DataFrame, semantic: DataFrame, literal_list: DataFrame) -> DataFrame:
    """(query_id, chunk_id, base, sources) of ranked lists (query_id, chunk_id, score, rank): the three meet in one aggregate."""
    parts = []
    for name, df, extra in (
        ("lexical", lexical, lexical_norm(F.col("score")) * LEXICAL_SCORE),
        ("semantic", semantic, semantic_norm(F.col("score")) * SEMANTIC_SCORE),
        ("literal", literal_list, F.lit(0.0)),
    ):
        parts.append(df.select("query_id", "chunk_id", (LIST_WEIGHTS[name] / (RANK_OFFSET + F.col("rank")) + extra).alias("s"), F.lit(name).alias("source")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("base"), F.array_sort(F.collect_set("source")).alias("sources"))


def feature_score(has_literal: Column, semantic_only: Column) -> Column:
    """Base and features of a candidate joined with its chunk and query (see ``functions.query.prepared``)."""
    c, asked = F.col, F.size("expanded") > 0
    cover = term_coverage(c("text"), c("expanded"))
    total = (
        c("base") + literal(c("text"), c("file_path"), c("low"), c("compact")) + cover * COVERAGE + path_segments(c("file_path"), c("expanded")) * PATH_SEGMENT
        + path_exact(c("file_path"), c("low")) * PATH_EXACT + file_stem(c("file_path"), c("expanded")) * FILE_STEM + definition_name(c("text"), c("expanded")) * DEFINITION
        + F.when(c("intent"), location(c("kind"), c("file_path")) * LOCATION).otherwise(0.0)
    )
    total = total * F.when(semantic_only, SEMANTIC_ONLY).otherwise(1.0)
    total = total * F.when(asked & (cover == 0) & ~has_literal, NO_COVERAGE).otherwise(1.0)
    return total * kind_factor("kind") * authority("file_path") / F.pow(c("n_file").cast("double"), F.lit(FILE_POWER))


ORDER = ("file_path", "start_line", "end_line", "chunk_id")


def rank_candidates(merged: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates with score after decay: one window counts a query's chunks of a file, another orders them.

    The candidates, a bounded number for each query, go to the chunks, so that no other chunk's text is shuffled.
    """
    found = chunks.join(small(merged), "chunk_id").join(queries.select("query_id", "expanded", "low", "compact", "intent"), "query_id")
    counted = found.withColumn("n_file", F.count("*").over(Window.partitionBy("query_id", "workspace_id", "file_path")))
    has = F.array_contains("sources", "literal")
    only = ~F.arrays_overlap("sources", F.array(F.lit("lexical"), F.lit("literal")))
    scored = counted.withColumn("score", feature_score(has, only)).drop("expanded", "low", "compact", "intent", "n_file", "base")
    return decay(scored)


def decay(scored: DataFrame, keys: tuple[str, ...] = ("query_id", "workspace_id", "file_path")) -> DataFrame:
    """A file's third and fourth hits count 0.4, later ones 0.1."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), *ORDER))
    factor = None
    for upto, value in DECAY:
        factor = F.when(nth <= upto, value) if factor is None else factor.when(nth <= upto, value)
    return scored.withColumn("score", F.col("score") * factor.otherwise(DECAY_REST))


def cutoff(ranked: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rows at or above max(mean - deviation, 0.35 of the best, 0.01), literal hits, and always the best row.

    The three numbers of a query come from an aggregate and are joined back.
    """
    facts = ranked.groupBy(*keys).agg(F.avg("score").alias("__mean"), F.stddev_pop("score").alias("__dev"), F.max("score").alias("__best"), F.count("*").alias("__n"))
    bar = F.greatest(F.col("__mean") - F.col("__dev"), F.col("__best") * CUTOFF_SHARE, F.lit(CUTOFF_LEAST))
    passes = (F.col("__n") <= 1) | (F.round("score", 9) >= F.round(bar, 9)) | F.array_contains("sources", "literal")
    w = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), *[c for c in ORDER if c in ranked.columns])
    marked = ranked.join(facts, list(keys)).withColumn("__passes", passes)
    some = F.max(F.col("__passes").cast("int")).over(Window.partitionBy(*keys))
    return marked.withColumn("__some", some).withColumn("__nth", F.row_number().over(w)).where("__passes or (__some = 0 and __nth = 1)").drop("__mean", "__dev", "__best", "__n", "__passes", "__some", "__nth")
