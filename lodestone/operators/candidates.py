"""Candidate generators: lexical, by path, literal, regular expression and nearest neighbours.

All take a table of queries, so a batch of them is one plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_lower, lines, tokens

from .index import FIELDS

K1, B = 1.2, 0.75
PATH_SCORE = 100.0
#: Rows of a ranked list that are kept for each query.
CANDIDATES = 500


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, length: Column, mean: Column, n: Column, df: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def variant_terms(queries: DataFrame) -> DataFrame:
    """(query_id, variant, term): the distinct terms of each variant of each query."""
    each = queries.select("query_id", F.explode("variants").alias("variant"))
    return each.select("query_id", "variant", F.explode(F.array_distinct(tokens("variant"))).alias("term"))


def matching_postings(fields: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, term, chunk_id, boost, tf, length) of the asked terms only: other tokens are dropped before the shuffle.

    That one goes by chunk, so counts, scores and their sums for each query need no further one.
    """
    asked = terms.select("term").distinct()
    each = fields.select("chunk_id", "boost", "field", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return each.join(asked, "term").repartition("chunk_id").groupBy("field", "term", "chunk_id", "boost", "length").agg(F.count("*").alias("tf"))


def bm25(fields: DataFrame, terms: DataFrame, weights: dict[str, float] = FIELDS) -> DataFrame:
    """(query_id, variant, chunk_id, score) of every chunk that has a term, over all fields by weight.

    ``fields`` has chunk_id, boost (a factor of the chunk's score), field and tokens.
    """
    only = fields.where(F.col("field").isin(*weights))
    found = matching_postings(only, terms)
    stats = only.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean_length"))
    df = found.groupBy("field", "term").agg(F.count("*").alias("df"))
    factor = F.element_at(F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, w)]), F.col("field"))
    # one row for each field: bounded by the number of fields
    scored = found.join(df, ["field", "term"]).join(F.broadcast(stats), "field").select("term", "chunk_id", (F.col("boost") * factor * term_score(F.col("tf"), F.col("length"), F.col("mean_length"), F.col("n"), F.col("df"))).alias("s"))
    return scored.join(terms, "term").groupBy("query_id", "variant", "chunk_id").agg(F.sum("s").alias("score"))


def lexical(fields: DataFrame, queries: DataFrame, limit: int | None = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, score): the best variant's score; the first ``limit`` of each query."""
    best = bm25(fields, variant_terms(queries)).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return first(best, limit)


def within(rank: str, limit: int | None) -> Column:
    """Whether a rank is within a limit; None is no limit."""
    return F.lit(True) if limit is None else F.col(rank) <= limit


def first(scored: DataFrame, limit: int | None, order: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """The best ``limit`` rows of each query by score (to nine places), with rank from 1; ties by ``order``."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), *order)
    return scored.withColumn("rank", F.row_number().over(w)).where(within("rank", limit))


def by_path(fields: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id): chunks whose path has all terms of some variant."""
    terms = variant_terms(queries)
    size = terms.groupBy("query_id", "variant").agg(F.count("*").alias("n_terms"))
    has = fields.where("field = 'file_path'").select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term"))
    hits = has.join(terms, "term").groupBy("query_id", "variant", "chunk_id").agg(F.count("*").alias("n"))
    return hits.join(size, ["query_id", "variant"]).where("n = n_terms").select("query_id", "chunk_id").distinct()


def phrase(fields: DataFrame, words: list[str], field: str = "text") -> DataFrame:
    """(chunk_id, position): where the words stand one after another. Positions of the first word meet those of the others, shifted."""
    each = fields.where(F.col("field") == field).select("chunk_id", F.posexplode("tokens").alias("position", "term"))
    out = None
    for i, word in enumerate(words):
        at = each.where(F.col("term") == word).select("chunk_id", (F.col("position") - i).alias("position"))
        out = at if out is None else out.join(at, ["chunk_id", "position"], "left_semi")
    return out


def literal_chunks(chunks: DataFrame, queries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, keep) of chunks that hold a variant of the query, in any case. The scan is exact."""
    asked = queries.select("query_id", F.transform("variants", ascii_lower).alias("lowered"))
    low = chunks.select("chunk_id", *keep, ascii_lower("text").alias("low"))
    return low.join(asked, F.exists("lowered", lambda v: F.contains(F.col("low"), v))).select("query_id", "chunk_id", *keep)


def matching_lines(files: DataFrame, test, keep: tuple[str, ...] = ("workspace_id", "file_path")) -> DataFrame:
    """(keep, line_no, line) of the lines for which ``test`` holds."""
    each = files.select(*keep, F.posexplode(lines("text")).alias("at", "line"))
    return each.where(test(F.col("line"))).select(*keep, (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def regex_lines(files: DataFrame, pattern: str, keep: tuple[str, ...] = ("workspace_id", "file_path"), prefilter: bool = True) -> DataFrame:
    """Lines that match a regular expression in any case. Files without the required fragments aren't cut into lines."""
    if prefilter:
        # k and s have case variants beyond ASCII, so they are left to the expression
        for fragment in {part for f in required_fragments(pattern) for part in re.split("[kKsS]", f) if len(part) >= 3}:
            files = files.where(F.contains(ascii_lower("text"), F.lit(fragment.lower())))
    return matching_lines(files, lambda line: line.rlike(f"(?iu){pattern}"), keep)


def fragments(pattern: str) -> list[str]:
    """Literal runs of three characters or more, longest first, each once in a row."""
    out, run, i = [], "", 0
    while i <= len(pattern):
        c = pattern[i] if i < len(pattern) else "|"
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            if pattern[i].isalnum():
                out.append(run)
                run = ""
            else:
                run += pattern[i]
        elif c in ".^$*+?()[]{}|":
            out.append(run)
            run = ""
        else:
            run += c
        i += 1
    found = sorted((f for f in out if len(f) >= 3), key=lambda f: -len(f))
    return [f for i, f in enumerate(found) if i == 0 or f != found[i - 1]]


def required_fragments(pattern: str) -> list[str]:
    """Fragments that every match has: none beside alternatives, groups or classes, and none that a quantifier makes optional."""
    if re.search(r"[|()\[\]{}]|\\[a-zA-Z]|\?|\*", pattern) or not pattern.isascii():
        return []
    return fragments(pattern)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vector_key, score) of every query with every vector that isn't its own.

    ``queries`` (query_id, q) is a stated set: it is broadcast only if the session's threshold finds it small enough.
    """
    left = queries.withColumn("qn", norm("q"))
    right = vectors.withColumn("vn", norm("embedding"))
    both = right.join(left, F.col("vector_key") != F.col("query_id"))
    return both.select("query_id", "vector_key", F.when((F.col("qn") > 0) & (F.col("vn") > 0), dot("q", "embedding") / (F.col("qn") * F.col("vn"))).otherwise(0.0).alias("score"))


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest by cosine; filters belong on ``vectors`` beforehand, so no rows are fetched in vain."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "vector_key")
    return cosine(queries, vectors).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_cosine(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) for sparse rows (id, bucket, weight) of length 1; summed where buckets meet."""
    q = queries.select("query_id", "bucket", F.col("weight").alias("qw"))
    return vectors.join(q, "bucket").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


#: What neural scores count for beside hash scores.
NEURAL_FACTOR = 1.08


def merge_semantic(hashed: DataFrame, neural: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The better score of the two tiers for each chunk."""
    both = hashed.select("query_id", key, "score").unionByName(neural.select("query_id", key, (F.col("score") * NEURAL_FACTOR).alias("score")))
    return both.groupBy("query_id", key).agg(F.max("score").alias("score"))
