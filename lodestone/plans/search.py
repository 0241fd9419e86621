"""The search pipeline over files: four candidate lists, fusion, cutoff, hits. A batch of queries is one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import query as fq
from lodestone.functions.languages import resolve_name
from lodestone.functions.paths import glob_match, in_scope
from lodestone.functions.text import ascii_lower, lines
from lodestone.operators import candidates as cand
from lodestone.operators import fusion, index, present
from lodestone.operators.chunking import chunk_files
from lodestone.storage import cut


@dataclass
class Options:
    """What a search is restricted to, and how much it returns."""

    limit: int | None = 50  # files for each query
    context: int = present.CONTEXT
    type_filter: str | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    scope: str | None = None
    scope_is_file: bool = False
    with_ignored: bool = False
    lexical_limit: int = 500
    path_limit: int = 100
    semantic_limit: int = 200
    literal_limit: int = 500
    file_names: bool = False  # only names are asked for: every matching file counts

    def budget(self, least: int) -> int | None:
        """Candidates of a list that has ``least`` up to 50 files: in proportion beyond, all without a limit or for names."""
        return None if self.limit is None or self.file_names else max(least, least * self.limit // 50)


def restricted(chunks: DataFrame, o: Options) -> DataFrame:
    """The rows that the options allow; the filters stand below every candidate list, so nothing is fetched in vain."""
    out = chunks.where(glob_match("file_path", o.include, o.exclude) & in_scope("file_path", o.scope, o.scope_is_file))
    if o.type_filter is not None:
        out = out.where(F.col("language") == (resolve_name(o.type_filter) or o.type_filter.lower()))
    if not o.with_ignored and "is_ignored" in chunks.columns:
        out = out.where(~F.col("is_ignored"))
    return out


def query_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Prepared queries, numbered from 1.

    What is made of the strings is computed once and given to the plans as
    literal rows, so the planner knows how few they are and needn't compile the
    word rules for each use.
    """
    given = F.array(*[F.lit(t) for t in texts]).cast("array<string>")
    each = spark.range(1, numPartitions=1).select(F.posexplode(given).alias("at", "query"))
    return spark.createDataFrame(fq.prepared(each.select((F.col("at") + 1).cast("bigint").alias("query_id"), "query")).toArrow())


@dataclass
class Lists:
    """The three ranked lists of a search (query_id, chunk_id, score, rank)."""

    lexical: DataFrame
    semantic: DataFrame
    literal: DataFrame


def candidate_lists(chunks: DataFrame, queries: DataFrame, o: Options, fields: DataFrame | None = None, vectors: DataFrame | None = None) -> Lists:
    fields = cut(index.tokenized(chunks)) if fields is None else fields
    vectors = index.hash_vectors(chunks) if vectors is None else vectors
    lex = cut(cand.lexical(fields, queries, o.budget(o.lexical_limit)))
    by_path = cand.by_path(fields, queries).join(lex.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    per_query = Window.partitionBy("query_id")
    extra = by_path.withColumn("nth", F.row_number().over(per_query.orderBy("chunk_id"))).where(cand.within("nth", o.budget(o.path_limit)))
    both = lex.select("query_id", "chunk_id", "score", F.lit(0).alias("part")).unionByName(extra.select("query_id", "chunk_id", F.lit(cand.PATH_SCORE).alias("score"), F.lit(1).alias("part")))
    lexical = both.withColumn("rank", F.row_number().over(per_query.orderBy("part", F.round("score", 9).desc(), "chunk_id"))).drop("part")
    asked = index.hash_vectors(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text"))).withColumnRenamed("chunk_id", "query_id")
    semantic = cand.first(cand.sparse_cosine(asked, vectors).where(F.round("score", 9) > 0), o.budget(o.semantic_limit))
    placed = cand.literal_chunks(chunks, queries, ("file_path", "start_line"))
    nth = F.row_number().over(per_query.orderBy("file_path", "start_line", "chunk_id"))
    literal = placed.withColumn("rank", nth).where(cand.within("rank", o.budget(o.literal_limit))).select("query_id", "chunk_id", F.lit(1.0).alias("score"), "rank")
    return Lists(lexical, semantic, literal)


def ranked(chunks: DataFrame, queries: DataFrame, o: Options, **tables: DataFrame) -> DataFrame:
    """Chunks with score and sources, after fusion, decay and cutoff."""
    found = candidate_lists(chunks, queries, o, **tables)
    merged = fusion.merge_lists(found.lexical, found.semantic, found.literal)
    return fusion.cutoff(cut(fusion.rank_candidates(merged, chunks, queries)))


def search_hits(files: DataFrame, queries: DataFrame, o: Options | None = None) -> DataFrame:
    """Hits of a batch of queries over files (workspace_id, file_path, text)."""
    o = o or Options()
    keep = ("workspace_id", "file_path", *(["is_ignored"] if "is_ignored" in files.columns else []))
    chunks = cut(restricted(chunk_files(files, keep), o))
    best = ranked(chunks, queries, o)
    text = files.select("workspace_id", "file_path", lines("text").alias("lines"))
    return present.hits(best, text, queries, o.context)


def search(files: DataFrame, texts: list[str], o: Options | None = None) -> DataFrame:
    """Grouped results (query_id, workspace_id, file_path, total_score, hit_count, hits) of query strings."""
    o = o or Options()
    return present.group_by_file(search_hits(files, query_table(files.sparkSession, texts), o), o.limit)


def literal_search(files: DataFrame, text: str, o: Options | None = None) -> DataFrame:
    """Lines that hold a string, in any case, with their context; overlapping chunks don't repeat a line."""
    o = o or Options()
    low = text.strip().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    every = files.where(F.contains(ascii_lower("text"), F.lit(low)) & F.lit(low != "")).withColumn("lines", lines("text"))
    rows = every.select("workspace_id", "file_path", "lines", F.posexplode("lines").alias("at", "line")).where(F.contains(ascii_lower("line"), F.lit(low)))
    lo, hi = F.greatest(F.lit(0), F.col("at") - o.context), F.least(F.size("lines") - 1, F.col("at") + o.context)
    return rows.select("workspace_id", "file_path", (F.col("at") + 1).cast("bigint").alias("line_no"), F.array_join(F.slice("lines", lo + 1, hi - lo + 1), "\n").alias("preview"), F.lit(1.0).alias("score"))


#: Columns that searches filter by; every index table has them.
FILTERS = ("workspace_id", "file_path", "language", "is_ignored")


class Index:
    """Index tables below a path: built once, searched many times."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, files: DataFrame) -> Index:
        if "is_ignored" not in files.columns:
            files = files.withColumn("is_ignored", F.lit(False))
        chunk_files(files, ("workspace_id", "file_path", "is_ignored")).write.mode("overwrite").parquet(f"{self.path}/chunks")
        index.write(self._table("chunks"), self.path, FILTERS)
        return self

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def search(self, texts: list[str], o: Options | None = None) -> DataFrame:
        """(query_id, file_path, ..., score) of the best chunks of each query. The filters reach the scans of all tables."""
        o = o or Options()
        tables = {name: restricted(self._table(name), o) for name in ("fields", "vectors")}
        return ranked(restricted(self._table("chunks"), o), query_table(self.spark, texts), o, **tables)
