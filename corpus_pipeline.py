"""From documents to token ids: language ID, line dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; between stages the rows are written as Parquet to the shared folder and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, linededup, mixing, simhash
from lodestone.llm.queries import byte_bpe_path
from lodestone.session import table
from lodestone.storage import cut, drop, scratch


def with_new(docs: DataFrame, names: tuple[str, ...], operator: Callable[[DataFrame], DataFrame], decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents that ``decide`` keeps of the operator's result, with their own columns.

    A column of the documents that has the name of one that the operator adds
    steps aside meanwhile.
    """
    own = {c: f"__own_{c}" if c.lower() in names else c for c in docs.columns}
    found = decide(operator(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])))
    return found.select(*[F.col(f"`{a}`").alias(c) for c, a in own.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own languages; documents that are rejected go."""
    model = langid.fit(docs)
    return with_new(docs, ("lang_pred", "score", "rejected"), lambda df: langid.predict(df, model), lambda df: df.where(~F.col("rejected")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of line windows go; a document of which no line remains goes too."""

    def decide(df: DataFrame) -> DataFrame:
        left = df.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
        return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))

    return with_new(docs, ("n_lines", "n_removed"), linededup.dedup, decide)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once.

    Near are documents whose five-word shingles have a Jaccard similarity of 0.8 or
    more, found exactly, and those whose fingerprints differ in three bits at most.
    """
    # rows of one id are told apart by their text; rows equal in both are one
    named = docs.withColumn("__th", F.xxhash64("text"))
    found = cut(simhash.near_duplicates(named, keep=("__th",), shingle=5, similarity=0.8).select("doc_id", "__th", "component_id"))
    key = [F.col("doc_id").alias("__id"), F.col("__th").alias("__gone")]
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__th").eqNullSafe(F.col("__gone"))
    dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*key).distinct()
    # hashed are ids, so that texts needn't be sorted
    left = named.join(dropped.hint("shuffle_hash"), same, "left_anti")
    repeated = cut(found.groupBy("doc_id", "__th").count().where("count > 1").select(*key))
    if not repeated.isEmpty():
        once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__th"])
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the calibrated probabilities of their cells."""
    return with_new(docs, ("topic", "tokens", "probability", "sampled"), mixing.mix, lambda df: df.where("sampled"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as little-endian unsigned 32-bit integers, their number and digest."""
    got = bpe.encode(docs, byte_bpe_path(), keep=["doc_id", "lang", "source"])
    return got.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", mix),
    ("byte-level BPE", encode),
]

#: Language ID, SimHash and BPE aren't expressible in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has read is removed once it is written; the last one reads as its rows are asked for."""
    docs, root = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{k}")
        if k:
            drop(spark, f"{root}/{k - 1}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
