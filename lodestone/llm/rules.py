"""Quality rules: an isolation forest over rule statistics, thresholds calibrated on labelled rows.

Words are runs of bytes other than space and 09-0D. A window, word or line is
told from others by a hash of its bytes modulo 2**64 and a prime.

The trees are counted on good documents: each split takes a random column and a
random place between the least and largest value that any labelled row has in
what the splits above leave of that column. A document that stands where good
ones don't is alone after few splits, so its path is short. Labels choose the
rows that the trees count and the threshold of the score, nothing else.

All labelled rows are used, none is sampled: the box is their least and largest
values, each tree's path lengths come from the number of all good rows in its
nodes, and the threshold is the best of all places between two scores. What
reaches the driver has a bound that doesn't depend on the rows: a count for each
lowest node of a tree, and a row for each partition.

Defined results: null and empty texts have no words and fail the base rule;
very long texts are counted whole; repeated rows are judged alike and learned
from once; ties at the threshold are kept; without labelled rows of both kinds
the forest rejects nothing (only the base rule holds); an empty table gives an
empty one. Columns named like a statistic or a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import ship
from lodestone.storage import cut, release

from .textscan import U64, map_texts, mixed, segment_sum, sure_hash, sure_prefix, utf8

#: The symbols counted by a base rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
#: SUBSAMPLE is that of ``grow``, over rows in memory; ``fit`` counts all rows.
TREES, SUBSAMPLE, DEPTH = 150, 1024, 12
#: Rows that walk down the trees at once.
STEP = 4096
#: What it costs to reject a share of the labelled good rows, against missing the same share of the bad ones.
REJECTION_COST = 20.0

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_marks long, n_adjacent long, n_distinct long, n_stops long"


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


SPACES, SYMBOL, UPPER = _table(" \t\n\x0b\x0c\r"), _table(SYMBOLS), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
MARKS, STOPS = _table("!?"), _table(".,;:")


def _distinct(owner: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """Number of distinct hashes of each document."""
    _, first = np.unique(h ^ mixed(owner.astype(U64) + U64(1)), return_index=True)
    return np.bincount(owner[first], minlength=docs)


def statistics_of(texts: pa.Array) -> list[np.ndarray]:
    """The columns of STATS for whole texts."""
    raw, off = utf8(texts)
    docs = len(off) - 1
    if not len(raw):
        return [np.zeros(docs, np.int64) for _ in STATS.split(",")]
    space = SPACES[raw]
    firsts = off[:-1][off[1:] > off[:-1]]
    start = ~space
    start[1:] &= space[:-1]
    start[firsts] = ~space[firsts]
    last = ~space
    last[:-1] &= space[1:]
    lasts = off[1:][off[1:] > off[:-1]] - 1
    last[lasts] = ~space[lasts]
    a, b = np.flatnonzero(start), np.flatnonzero(last) + 1
    woff = np.searchsorted(a, off)
    n_words = np.diff(woff)
    owner = np.repeat(np.arange(docs), n_words)
    prefix = sure_prefix(raw)
    h = sure_hash(prefix, a, b)
    total = lambda flag: segment_sum(flag.astype(np.int64), off).astype(np.int64)

    # windows: a hash of five word hashes, one after another, in one document
    covered = np.zeros(len(a) + 1, np.int64)
    n = len(a) - WINDOW + 1
    if n > 0:
        w = mixed(owner[:n].astype(U64) + U64(1))
        for j in range(WINDOW):
            w = mixed(w + h[j : j + n] * U64(2 * j + 3))
        inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
        _, inverse, count = np.unique(w[inside], return_inverse=True, return_counts=True)
        twice = inside[count[inverse] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    repeat = segment_sum((np.cumsum(covered)[:-1] > 0).astype(np.int64), woff).astype(np.int64)

    # lines: up to a line feed or the end of the text
    feeds = np.flatnonzero(raw == 10)
    stops = np.concatenate([feeds, off[1:]])
    doc_of = np.concatenate([np.searchsorted(off, feeds, "right") - 1, np.arange(docs)])
    order = np.lexsort((stops, doc_of))
    stops, doc_of = stops[order], doc_of[order]
    begins = np.empty(len(stops), np.int64)
    begins[0] = 0
    same = doc_of[1:] == doc_of[:-1]
    begins[1:] = np.where(same, stops[:-1] + 1, off[doc_of[1:]])
    worded = np.searchsorted(a, stops) > np.searchsorted(a, begins)
    lh, ld = sure_hash(prefix, begins[worded], stops[worded]), doc_of[worded]
    n_lines = np.bincount(ld, minlength=docs)
    dup = n_lines - _distinct(ld, lh, docs)

    adjacent = np.zeros(len(h), np.int64)
    if len(h) > 1:
        adjacent[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    return [
        n_words, total(~space & ((raw & 0xC0) != 0x80)), total(SYMBOL[raw]), dup, repeat, n_lines, total(UPPER[raw]), total(LETTERS[raw]), total(MARKS[raw]),
        segment_sum(adjacent, woff).astype(np.int64), _distinct(owner, h, docs), total(STOPS[raw]),
    ]


def statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the rule statistics of each whole text."""

    def make():
        return lambda texts: [pa.array(c.astype(np.int64)) for c in statistics_of(texts)]

    return map_texts(df, text, df.columns if keep is None else keep, STATS, make)


def base_failed():
    """The base rule over the columns of ``statistics``."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


NAMES = [x.split()[0] for x in STATS.split(", ")]


#: Words (and letters) of typical text that are added to a document's own, so that a short one isn't odd by chance.
PRIOR_WORDS, PRIOR_LETTERS = 50, 250


#: Characters of a typical word.
PRIOR_LENGTH = 5


def inputs(c: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: ratios of the statistics, drawn towards typical ones in short documents.

    Repeated lines and windows are left to the base rule: good documents have a few.
    """
    words, letters = c["n_words"] + PRIOR_WORDS, c["n_letters"] + PRIOR_LETTERS
    length = (c["word_chars"] + PRIOR_LENGTH * PRIOR_WORDS) / words
    return np.stack([c["n_symbols"] / words, c["n_upper"] / letters, c["n_marks"] / words, c["n_adjacent"] / words, length], axis=1).astype(np.float64)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, np.float64)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1: a leaf
    split: np.ndarray
    length: np.ndarray  # path length at a leaf
    norm: float
    threshold: float = np.inf

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node of each tree that each row ends in."""
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            f = self.feature[trees, at]
            right = x[rows, np.maximum(f, 0)] >= self.split[trees, at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]; short paths over random splits score high."""
        out, trees = np.empty(len(x)), np.arange(len(self.feature))[None, :]
        for lo in range(0, len(x), STEP):
            out[lo : lo + STEP] = np.exp2(-self.length[trees, self.leaves(x[lo : lo + STEP])].mean(axis=1) / self.norm)
        return out


def grow(good: np.ndarray, lowest: np.ndarray, highest: np.ndarray, seed: int = 11) -> Forest:
    """Trees over random samples of ``good``, rows in memory, with random splits of the box between ``lowest`` and ``highest``."""
    rng, nodes = np.random.default_rng(seed), 2 ** (DEPTH + 1) - 1
    size, columns = min(SUBSAMPLE, len(good)), np.flatnonzero(highest > lowest)
    feature, split, length = np.full((TREES, nodes), -1), np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
    for t in range(TREES):
        todo = [(0, 0, good[rng.choice(len(good), size, replace=False)], lowest, highest)]
        while todo:
            at, depth, own, lo, hi = todo.pop()
            if depth == DEPTH or len(own) < 2 or not len(columns):
                length[t, at] = depth + _mean_path(len(own))
                continue
            f = int(rng.choice(columns))
            cut = rng.uniform(lo[f], hi[f])
            feature[t, at], split[t, at] = f, cut
            right, below, above = own[:, f] >= cut, hi.copy(), lo.copy()
            below[f] = above[f] = cut
            todo += [(2 * at + 1, depth + 1, own[~right], lo, below), (2 * at + 2, depth + 1, own[right], above, hi)]
    return Forest(feature, split, length, float(max(_mean_path(size), 1.0)))


def drawn(lowest: np.ndarray, highest: np.ndarray, seed: int = 11) -> Forest:
    """Trees of full depth, with random splits of the box between ``lowest`` and ``highest`` and no rows yet."""
    rng, nodes = np.random.default_rng(seed), 2 ** (DEPTH + 1) - 1
    columns = np.flatnonzero(highest > lowest)
    feature, split = np.full((TREES, nodes), -1, np.int8), np.zeros((TREES, nodes))
    low, high = (np.tile(v, (TREES, 1, 1)).astype(np.float64) for v in (lowest, highest))
    for depth in range(DEPTH if len(columns) else 0):
        own = slice(2**depth - 1, 2 ** (depth + 1) - 1)
        f = rng.choice(columns, (TREES, 2**depth))[..., None]
        lo, hi = np.take_along_axis(low, f, 2), np.take_along_axis(high, f, 2)
        place = rng.uniform(lo, hi)
        feature[:, own], split[:, own] = f[..., 0], place[..., 0]
        if depth < DEPTH - 1:
            low, high = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)  # a node's two children stand side by side
            np.put_along_axis(high[:, 0::2], f, place, 2)
            np.put_along_axis(low[:, 1::2], f, place, 2)
    return Forest(feature, split, np.zeros((TREES, nodes)), 1.0)


def weighed(forest: Forest, lowest: np.ndarray) -> Forest:
    """``forest`` with the path lengths of good rows, ``lowest`` (trees x nodes of the last level) of which are in each node.

    A node of fewer than two rows is a leaf.
    """
    levels = [lowest]
    while levels[-1].shape[1] > 1:
        levels.append(levels[-1].reshape(len(lowest), -1, 2).sum(axis=2))
    rows = np.concatenate(levels[::-1], axis=1)
    depth = np.repeat(np.arange(DEPTH + 1), 2 ** np.arange(DEPTH + 1))[None, :]
    leaf = (rows < 2) | (depth == DEPTH) | (forest.feature < 0)
    length = np.where(leaf, depth + _mean_path(rows), 0.0)
    return Forest(np.where(leaf, -1, forest.feature).astype(np.int8), forest.split, length, float(max(_mean_path(rows[0, 0]), 1.0)))


COLUMNS = ["x_symbols", "x_upper", "x_marks", "x_adjacent", "x_length"]


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in COLUMNS], axis=1)


def _counted(good: DataFrame, forest: Forest) -> np.ndarray:
    """How many of all rows are in each lowest node of each tree."""
    handle = good.sparkSession.sparkContext.broadcast(forest)
    first, cells = 2**DEPTH - 1, 2**DEPTH

    def run(batches):
        trees, found = handle.value, np.zeros(TREES * cells, np.int64)
        for batch in batches:
            x = _x(batch)
            for lo in range(0, len(x), STEP):
                at = trees.leaves(x[lo : lo + STEP])
                at = np.where(at >= first, at - first, 0)  # a tree without a split: all rows in one node
                found += np.bincount((at + np.arange(TREES)[None, :] * cells).ravel(), minlength=len(found))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["cell", "n"])

    got = good.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    handle.destroy()
    out = np.zeros(TREES * cells, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(TREES, cells)


def best_cut(scored: DataFrame) -> float:
    """``cut_between`` of all rows (v, good), wherever they are."""
    counts = scored.groupBy("v").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    ranged = cut(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()))
    parts = sorted(ranged.groupBy("part").agg(F.min("v").alias("least"), F.sum("g").alias("g"), F.sum("b").alias("b")).collect(), key=lambda r: r["least"])
    before, goods, bads = {}, 0, 0
    for r in parts:
        before[r["part"]] = (goods, bads)
        goods, bads = goods + r["g"], bads + r["b"]

    def run(batches):
        start = best = None
        for batch in batches:
            v, g, b, part = (batch.column(i).to_numpy() for i in range(4))
            if not len(v):
                continue
            start = start or before[int(part[0])]
            g, b = start[0] + np.cumsum(g), start[1] + np.cumsum(b)
            start = (g[-1], b[-1])
            cost = b / max(1, bads) + REJECTION_COST * (1 - g / max(1, goods))
            i = len(v) - 1 - int(np.argmin(cost[::-1]))
            if best is None or cost[i] <= best[0]:
                best = (cost[i], v[i])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]])], names=["cost", "v"])

    at = min((r["cost"], -r["v"]) for r in ranged.mapInArrow(run, "cost double, v double").collect())  # a row a partition
    value = -at[1]
    after = ranged.where(F.col("v") > value).agg(F.min("v")).first()[0]
    release(ranged)
    return value if after is None else (value + after) / 2


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, doc_id: str = "doc_id") -> Forest | None:
    """Forest and threshold from ``statistics`` of all labelled documents (label 1 for good)."""
    spark = stats.sparkSession
    ship(spark)
    learn = F.lit(True) if learn is None else learn
    known = labels.where(learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id__"), (F.col(label) == 1).alias("good"))
    found = stats.where(~base_failed()).join(known.distinct(), F.col(doc_id) == F.col("__id__")).select(*NAMES, "good").distinct()

    def run(batches):
        for b in batches:
            x = inputs({n: b.column(i).to_numpy() for i, n in enumerate(NAMES)})
            yield pa.RecordBatch.from_arrays([b.column(len(NAMES)), *[pa.array(x[:, i]) for i in range(len(COLUMNS))]], names=["good", *COLUMNS])

    rows = cut(found.mapInArrow(run, f"good boolean, {', '.join(f'{c} double' for c in COLUMNS)}"))
    facts = rows.agg(F.bool_or("good").alias("some"), F.bool_and("good").alias("all"), *[f(c).alias(f"{c}_{n}") for c in COLUMNS for n, f in (("least", F.min), ("most", F.max))]).first()
    if not facts["some"] or facts["all"]:
        release(rows)
        return None
    lowest, highest = (np.array([facts[f"{c}_{n}"] for c in COLUMNS]) for n in ("least", "most"))
    forest = drawn(lowest, highest)
    forest = weighed(forest, _counted(rows.where("good"), forest))
    handle = spark.sparkContext.broadcast(forest)

    def scores(batches):
        model = handle.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.round(model.score(_x(b)), 9)), b.column(0)], names=["v", "good"])

    forest.threshold = best_cut(rows.mapInArrow(scores, "v double, good boolean"))
    handle.destroy()
    release(rows)
    return forest


def cut_between(v: np.ndarray, good: np.ndarray) -> float:
    """The cut that tells bad values (above) from good ones at the least cost; the largest value if no cut pays."""
    values = np.unique(v)
    missed = np.searchsorted(np.sort(v[~good]), values, "right") / max(1, (~good).sum())
    rejected = 1 - np.searchsorted(np.sort(v[good]), values, "right") / max(1, good.sum())
    i = len(values) - 1 - int(np.argmin((missed + REJECTION_COST * rejected)[::-1]))
    return float((values[i] + values[i + 1]) / 2) if i + 1 < len(values) else float(values[i])


def judge(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Add base_failed, anomaly (score) and kept to the rows of ``statistics``."""
    handle = stats.sparkSession.sparkContext.broadcast(forest)
    keep = [c for c in stats.columns if c.lower() not in ("anomaly", "base_failed", "kept")]
    schema = T.StructType([*[stats.schema[c] for c in keep], T.StructField("anomaly", T.DoubleType())])
    limit = float(forest.threshold) if forest else float("inf")

    def run(batches):
        model = handle.value
        for b in batches:
            x = inputs({n: b.column(keep.index(n)).to_numpy(zero_copy_only=False) for n in NAMES})
            s = np.round(model.score(x), 9) if model is not None and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(s)], names=[*keep, "anomaly"])

    scored = stats.select(*keep).mapInArrow(run, schema)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= limit))
