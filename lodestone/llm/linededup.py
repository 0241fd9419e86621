"""Line dedup: overlapping windows of three lines; later occurrences go.

A text is split at line feeds. Each three consecutive lines, unless all blank,
are a window, told from others by two 64-bit hashes. Of the windows that occur
more than once anywhere, the first by (doc_id, line) stays, and the lines that
later ones cover are removed; positions covered by several are merged.

Only hashes and positions are shuffled to find windows, counted with map-side
combining; the repeated ones are cut before they are joined, so that adaptive
execution can split a window that many documents share. Texts are shuffled to
meet their positions only where a bitmap of fixed size (``sieve``) says that
they may have some; the others pass as they were read.

Defined results: a null text stays null and has no lines; texts of fewer than
three lines, the empty one among them, have no window and stay; very long texts
take time in proportion to their lines; null ids come last; rows equal in id
and text are one row to the comparison and get the same result; rows equal in
id only are told apart by their text; an empty table gives an empty one. Extra
columns are kept, whatever their names; ``n_lines`` and ``n_removed`` replace
columns of that name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import cut

from . import sieve
from .textscan import unused

WINDOW = 3
LAST = (1 << 63) - 1


def _split(text: str):
    return F.split(F.col(f"`{text}`"), "\n", -1)


def _key(text: str, doc_id: str):
    """An id for ordering, null last, and a hash that tells texts of one id apart."""
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)), F.xxhash64(F.col(f"`{text}`"))


def windows(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, th, pos, h1, h2): a row for each window that isn't blank; th tells texts of one id apart."""
    key, th = _key(text, doc_id)
    lines = df.select(key.alias("id"), th.alias("th"), _split(text).alias("lines")).where(F.size("lines") >= WINDOW)
    each = F.transform(
        F.sequence(F.lit(0), F.size("lines") - WINDOW),
        lambda i: F.struct(
            F.xxhash64(*[F.get("lines", i + k) for k in range(WINDOW)]).alias("h1"),
            F.xxhash64(F.lit(WINDOW), *[F.get("lines", i + k) for k in range(WINDOW)]).alias("h2"),
            reduce(or_, [F.trim(F.get("lines", i + k)) != "" for k in range(WINDOW)]).alias("worded"),
        ),
    )
    rows = lines.select("id", "th", F.posexplode(each).alias("pos", "w"))
    return rows.where("w.worded").select("id", "th", "pos", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))


def covered(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, th, starts) of the documents that repeat windows, cut."""
    every = windows(df, text, doc_id)
    place = F.struct("id", "th", "pos")
    repeated = cut(every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first"))
    later = every.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    return cut(later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts")))


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows with the repeated lines removed from their text, n_lines (before) and n_removed."""
    found = covered(df, text, doc_id)
    others = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed")]
    id_, th, starts, lines, gone = (unused(df.columns, f"__{c}") for c in ("id", "th", "starts", "lines", "gone"))
    key, hashed = _key(text, doc_id)
    keyed = df.select(*[F.col(f"`{c}`") for c in others], key.alias(id_), hashed.alias(th))
    touched, rest = sieve.apart(keyed, F.xxhash64(id_, th), found.select(F.xxhash64("id", "th").alias("h")))

    n_lines = F.coalesce(F.when(F.col(f"`{text}`").isNotNull(), F.size(_split(text))), F.lit(0)).cast("long").alias("n_lines")
    same = rest.select(*[F.col(f"`{c}`") for c in others], n_lines, F.lit(0).cast("long").alias("n_removed"))

    # hashed are positions; texts needn't be sorted
    met = touched.join(found.select(F.col("id").alias(id_), F.col("th").alias(th), F.col("starts").alias(starts)).hint("shuffle_hash"), [id_, th], "left")
    all_gone = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(*[s + k for k in range(WINDOW)]))))
    # each text is split once: the arrays are columns, not expressions that a lambda would evaluate for every line
    parts = met.select(*[F.col(f"`{c}`") for c in others], _split(text).alias(lines), F.coalesce(all_gone, F.array().cast("array<int>")).alias(gone))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    changed = F.when(F.size(gone) == 0, F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    cleaned = parts.select(
        *[changed.alias(c) if c == text else F.col(f"`{c}`") for c in others],
        F.coalesce(F.when(F.col(f"`{text}`").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
    )
    return same.unionByName(cleaned)
