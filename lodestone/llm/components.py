"""Connected components of links between 64-bit keys, by alternating stars.

Nothing is gathered on the driver but a few sums a round. A node's smallest
neighbour comes from an aggregate with map-side combining. Where it is joined
back, nodes with more than a thousandth of the links (at most a thousand nodes, by
that definition) go by broadcast, so that no task gets all links of a hot node.
Each round is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import cut, release, tidied

#: A node is hot if it has more links than this share of all.
HOT_SHARE = 1000
#: Rounds after which the loop gives up; the number needed grows with the logarithm of a component's size.
ROUNDS = 60


def _with_least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each (u, v) with the smallest of u and all its neighbours, as m; and the cut table that this reads."""
    least = cut(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    with tidied(links.sparkSession):
        facts = least.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    bar = max(1000, (facts["all"] or 0) // HOT_SHARE)
    if (facts["most"] or 0) <= bar:
        return links.join(least.select("u", "m"), "u"), least
    hot = F.broadcast(least.where(F.col("n") > bar).select("u", "m"))  # at most HOT_SHARE rows
    tried = links.join(hot, "u", "left")
    rest = tried.where("m is null").drop("m").join(least.where(F.col("n") <= bar).select("u", "m"), "u")
    return tried.where("m is not null").unionByName(rest), least


def _settled(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and that has none itself."""
    with tidied(links.sparkSession):
        kids = links.groupBy("a").agg(F.count("*").alias("n"))
        r = kids.join(links.select(F.col("b").alias("root")).distinct(), F.col("a") == F.col("root"), "left").agg(F.max("n").alias("most"), F.count("root").alias("inner")).first()
    return (r["most"] or 0) <= 1 and r["inner"] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b: long): root is the smallest key it reaches."""
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rounds = 0
    while not _settled(now):
        if (rounds := rounds + 1) > ROUNDS:
            raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: a node's larger neighbours are linked to the smallest one
        starred, least = _with_least(both)
        large = cut(starred.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        release(now, least)
        # small star: a node's smaller neighbours, and itself, are linked to the smallest one
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        now = cut(small.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        release(large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
