"""Chunks to postings, lengths, statistics and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import is_definition
from lodestone.functions.text import embedding_alias, md5_number, raw_words, singular, tokens, variants

#: Fields that are tokenized, and their weights in ranking.
FIELDS = {"text": 1.0, "file_path": 5.0, "signature": 10.0}
DIMENSIONS = 256
#: What the lexical score of a definition is multiplied by.
DEFINITION_BOOST = 2.0


def tokenized(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, keep, boost, field, tokens) of every field of every chunk; definitions have a boost."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), tokens(f).alias("tokens")) for f in FIELDS])
    boost = F.when(is_definition("kind"), DEFINITION_BOOST).otherwise(1.0).alias("boost")
    return chunks.select("chunk_id", *keep, boost, F.explode(pairs).alias("p")).select("chunk_id", *keep, "boost", "p.field", "p.tokens")


def occurrences(fields: DataFrame) -> DataFrame:
    """(field, term, chunk_id, position) of every token."""
    return fields.select("chunk_id", "field", F.posexplode("tokens").alias("position", "term"))


def postings(fields: DataFrame) -> DataFrame:
    """(field, term, chunk_id, tf, positions)."""
    return occurrences(fields).groupBy("field", "term", "chunk_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def lengths(fields: DataFrame) -> DataFrame:
    return fields.select("chunk_id", "field", F.size("tokens").cast("bigint").alias("length"))


def field_stats(lens: DataFrame) -> DataFrame:
    """(field, n, mean_length)."""
    return lens.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))


def terms_of(chunks: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, keep, term) of a text's embedding: every form of every word, singular or by synonym.

    Words are exploded first, so that what is done to each runs as generated
    code and not once more for each use of it.
    """
    words = chunks.select("chunk_id", *keep, F.explode(raw_words(text)).alias("word"))
    forms = words.select("chunk_id", *keep, F.explode(variants(F.col("word"))).alias("form"))
    return forms.withColumn("one", singular("form")).select("chunk_id", *keep, embedding_alias(F.col("one")).alias("term"))


def hash_vectors(chunks: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, keep, bucket, weight): sparse rows of length 1. Signed feature hashing; partial sums are made before the shuffle."""
    h = md5_number(F.col("term"))
    signs = terms_of(chunks, text, keep).select("chunk_id", *keep, F.pmod(h, F.lit(dimensions)).alias("bucket"), F.when(F.shiftright(h, 16).bitwiseAND(1) == 0, 1).otherwise(-1).alias("sign"))
    sums = signs.groupBy("chunk_id", *keep, "bucket").agg(F.sum("sign").alias("total")).where("total <> 0")
    norm = F.sqrt(F.sum(F.col("total") * F.col("total")).over(Window.partitionBy("chunk_id")).cast("double"))
    return sums.select("chunk_id", *keep, "bucket", (F.col("total") / norm).alias("weight"))


def dense(sparse: DataFrame, key: str = "chunk_id", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, embedding) with one array for each row; at most ``dimensions`` entries are gathered for a key."""
    got = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return got.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("bigint")), F.lit(0.0))).alias("embedding"))


def store_upsert(old: DataFrame, new: DataFrame, key: str = "vector_key") -> DataFrame:
    """Rows of ``new``, one for each key, and those of ``old`` with other keys."""
    fresh = new.dropDuplicates([key])
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def pending(chunks: DataFrame, vectors: DataFrame, key: str = "vector_key") -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(vectors.select(key), key, "left_anti")


def write(chunks: DataFrame, path: str, keep: tuple[str, ...], buckets: int = 64) -> None:
    """Write index tables below ``path``. Tokens and vectors carry the columns that searches filter by; postings are
    sorted by term in files by the term's bucket, so a lookup reads few row groups."""
    fields = tokenized(chunks, keep)
    fields.write.mode("overwrite").parquet(f"{path}/fields")
    hash_vectors(chunks, keep=keep).write.mode("overwrite").parquet(f"{path}/vectors")
    posted = postings(fields).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    posted.repartition("bucket", "field").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lens = lengths(fields)
    lens.write.mode("overwrite").parquet(f"{path}/lengths")
    field_stats(lens).write.mode("overwrite").parquet(f"{path}/stats")
