"""Queries of the subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table
from lodestone.storage import cut, scratch

from . import bpe, langid, linededup, mixing, mtree, quality, rollups, rules, simhash, toxicity
from .textscan import fold


def _held(n: int, which: int):
    return F.coalesce(fold("doc_id", n) == which, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, learn=fold("doc_id", 5) != 0)
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", _held(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = cut(rules.statistics(docs, keep=["doc_id"]))
    forest = rules.fit(stats, labels, learn=fold("doc_id", 5) != 0)
    judged = rules.judge(stats, forest)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.scaled(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return mtree.top_k(vectors, vectors.where(F.pmod("id", F.lit(20)) == 0), 20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id,
         CAST(list_sum(list_transform(list_zip(q.c, p.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, learn=fold("doc_id", 4) != 2)
    found = langid.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", _held(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


#: Words of two characters or more: what the revised tokenizer run of op2 counts.
LONG_WORD = r"[^\x20\x09-\x0D]{2,}"


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents come in under two tokenizer versions, those labelled of low quality go,
    the toxic ones that remain get revised word counts, and the second batch is sent once more."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    versions = {"words-1": mixing.words("text"), "bytes-1": F.octet_length("text")}
    docs = table(spark, sf_dir, "documents").withColumn("long_words", F.coalesce(F.regexp_count(F.col("text"), F.lit(LONG_WORD)), F.lit(0)).cast("long"))
    counts = cut(rollups.counted(docs, versions, ["doc_id", "source", "lang", "long_words"]))
    keys = ["source", "lang", "tokenizer"]
    change = lambda df, kind, tokens, old: df.select(F.lit(kind).alias("kind"), *keys, tokens.alias("tokens"), old.alias("old_tokens"))
    none = F.lit(None).cast("long")
    marked = counts.join(labels, "doc_id")
    gone = change(marked.where("quality = 0"), "delete", F.col("tokens"), none)
    revised = change(marked.where("coalesce(quality, 1) <> 0 and toxic = 1 and tokenizer = 'words-1'"), "revise", F.col("long_words"), F.col("tokens"))
    ledger = rollups.Rollup(spark, scratch(spark, "rollup"))
    ledger.commit("load", change(counts, "insert", F.col("tokens"), none))
    ledger.commit("takedown", gone)
    ledger.commit("revision", revised)
    ledger.commit("takedown", gone)
    return ledger.totals()


OP2_SQL = f"""
WITH l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT source, lang, coalesce(toxic, 0) AS toxic, text FROM documents LEFT JOIN l USING (doc_id)
  WHERE coalesce(quality, 1) <> 0),
t AS (
  SELECT source, lang, 'bytes-1' AS tokenizer, coalesce(strlen(text), 0) AS tokens FROM d
  UNION ALL
  SELECT source, lang, 'words-1', coalesce(len(CASE WHEN toxic = 1 THEN regexp_extract_all(text, '{LONG_WORD}')
                                                    ELSE regexp_extract_all(text, '{mixing.WORD}') END), 0) FROM d)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM t GROUP BY ALL
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
w AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM l
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM w
  WHERE c IS NOT NULL AND trim(a || b || c, ' ') <> ''),
g AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       md5(coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '')) AS text_md5
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""


def byte_bpe_path() -> str:
    """The vocabulary file of the query; a package that ships it is asked for its place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(table(spark, sf_dir, "documents"), byte_bpe_path(), keep=["doc_id"])
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.fit(docs, labels, learn=fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, field, keep=["doc_id"])
    return scored.select("doc_id", _held(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_token_counts": op2_token_counts, "op3_byte_bpe": op3_byte_bpe, "op4_rules": op4_rules, "op5_mtree": op5_mtree, "op6_language": op6_language, "op7_simhash": op7_simhash, "op8_mixing": op8_mixing, "op9_toxicity": op9_toxicity, "op10_line_dedup": op10_line_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op2_token_counts": OP2_SQL, "op5_mtree": OP5_SQL, "op8_mixing": mixing.sql(), "op10_line_dedup": OP10_SQL}
