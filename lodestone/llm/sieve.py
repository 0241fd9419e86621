"""A bitmap of fixed size that says which rows may have a key among given ones.

Rows that can't have one needn't be shuffled to find out. The bitmap has
``BITS`` bits, whatever it is made from, in rows of ``ROW_BITS``: so what is
broadcast has a bound. With more keys more rows pass wrongly, all of them at
last, which costs a shuffle and no result. Null keys never pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import cut

from .textscan import unused

ROW_BITS = 1 << 15
BITS = 1 << 25


def bitmap(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """(row, bits) from the only column of ``keys``, a hash: at most ``bits`` bits in all; cut."""
    at = keys.select(F.pmod(F.col(f"`{keys.columns[0]}`"), F.lit(bits)).alias("at"))
    split = at.select(F.shiftright("at", 15).alias("row"), F.pmod("at", F.lit(ROW_BITS)).alias("place"))
    return cut(split.groupBy("row").agg(F.bitmap_construct_agg("place").alias("bits")))


def apart(df: DataFrame, key: Column, keys: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key``, a hash, may be among ``keys``, and those where it can't be."""
    row, place, found = (unused(df.columns, f"__sieve_{c}") for c in ("row", "place", "bits"))
    table = F.broadcast(bitmap(keys, bits).select(F.col("row").alias(row), F.col("bits").alias(found)))  # BITS / 8 bytes at most
    at = F.pmod(key, F.lit(bits))
    placed = df.withColumn(row, F.shiftright(at, 15)).withColumn(place, F.pmod(at, F.lit(ROW_BITS)).cast("int"))
    joined = placed.join(table, row, "left")
    byte = F.conv(F.hex(F.substring(F.col(found), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.bit_get(byte, F.pmod(F.col(place), F.lit(8))) == 1, F.lit(False))
    return joined.where(hit).select(*[F.col(f"`{c}`") for c in df.columns]), joined.where(~hit).select(*[F.col(f"`{c}`") for c in df.columns])


def as_array(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap as bytes on the driver: ``bits`` / 8 of them, whatever the number of keys."""
    out = np.zeros(bits // 8, np.uint8)
    got = bitmap(keys, bits).toArrow()
    for row, part in zip(got.column("row").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[row * (ROW_BITS // 8) : (row + 1) * (ROW_BITS // 8)] = np.frombuffer(part, np.uint8)
    return out


def holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set in a table of ``as_array``."""
    at = (h & np.uint64(len(table) * 8 - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
