"""Samples of labelled rows whose bounds hold whatever repeats in the tables.

Rows are taken in the order of a hash, so a sample is the same in every run and
in whichever order the rows come. Rows that are equal count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import cut, small


def _limit(label: str, most: dict, otherwise: int) -> Column:
    out = F.lit(otherwise)
    for value, n in most.items():
        out = F.when(F.col(label) == value, F.lit(n)).otherwise(out)
    return out


def bounded(rows: DataFrame, label: str, most: dict, otherwise: int, seed: str) -> DataFrame:
    """``rows``, equal ones once: the first ``most[value]`` (or ``otherwise``) of each label value by a hash of all columns.

    Only hashes are ranked; the chosen ones, as few as the bounds say, are broadcast to the rows.
    """
    named = rows.withColumn("__pick__", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in rows.columns]))
    hashes = cut(named.select(label, "__pick__").distinct())
    limit = _limit(label, most, otherwise)
    # of a label with many rows a share is ranked that holds enough of them, so that no task gets them all
    counts = small(hashes.groupBy(label).agg(F.count("*").alias("__all__")))
    enough = (limit + 10 * F.sqrt(limit) + 30) / F.col("__all__")
    some = hashes.join(counts, label).where(F.pmod("__pick__", F.lit(1 << 30)) < enough * (1 << 30)).drop("__all__")
    ranked = some.withColumn("__nth__", F.row_number().over(Window.partitionBy(label).orderBy("__pick__")))
    chosen = ranked.where(F.col("__nth__") <= max([otherwise, *most.values()])).where(F.col("__nth__") <= limit)
    picks = chosen.select(F.col("__pick__").alias("__chosen__"))
    return named.join(F.broadcast(picks), F.col("__pick__") == F.col("__chosen__"), "left_semi").dropDuplicates(["__pick__"]).select(*rows.columns)


def labelled_ids(labels: DataFrame, label: str, learn: Column, most: dict, otherwise: int, seed: str, doc_id: str = "doc_id") -> DataFrame:
    """(__id__, y): at most so many ids of each label value 0 and 1, by a hash of the id; a null id is none."""
    known = labels.where(learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id__"), F.col(label).cast("int").alias("y"))
    return bounded(known, "y", most, otherwise, seed)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: dict, otherwise: int, seed: str, columns: list[str], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, y, columns) of at most so many documents of each label value.

    The chosen ids are broadcast. Documents that share one are all found, cut,
    and brought below the bound once more.
    """
    ids = labelled_ids(labels, label, learn, most, otherwise, seed, doc_id)
    found = docs.select(F.col(doc_id).alias("doc_id"), *columns).join(F.broadcast(ids), F.col("doc_id") == F.col("__id__")).select("doc_id", "y", *columns)
    return bounded(cut(found), "y", most, otherwise, seed)
