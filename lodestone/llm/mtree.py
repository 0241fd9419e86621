"""Exact top-k by integer inner product: best-first search in M-trees.

Inner products aren't distances, so vectors get one more component: with M the
largest squared length, x becomes (x, sqrt(M - |x|^2)) and a query (q, 0). Then
|q - x|^2 = |q|^2 + M - 2 q.x, and the nearest are those of largest product.

Rows are dealt into shards of about ``SHARD_ROWS``. Within a shard the vectors
form an M-tree of pages: a routing object and covering radius for each page, the
distance to the parent for each entry. A task builds each of its shards' trees
once; the queries stream past it in blocks of ``QUERY_BLOCK``, and those of a
block search the tree together, each in its own best-first order of pages. A page is skipped if its lower bound |d(q, page) - radius| can't beat
the query's k-th result, an entry if its stored parent distance already rules
it out (triangle inequality). Bounds have a margin for rounding; the products
themselves are integers in exact arithmetic: in floats where squared lengths
stay below 2**52, in 64-bit integers beyond.

Of equal vectors only the k+1 smallest ids of a shard are kept: no others can
be among the first k, whatever the query's own id. Defined results: vectors that
are null, have another length than most queries', or hold null or non-finite
components take no part; neither do null ids, nor vectors whose squared length,
times the factor's square, reaches 2**62: their products may be no 64-bit
integers. Rows repeated with the same id and vector are one candidate; different
vectors of one id are one each. Columns besides id and vector aren't read, so
their names don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import ship

PAGE = 256
FANOUT = 16
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
#: Relative margin of the bounds for rounding.
MARGIN = 1e-7

FOUND = "query_id long, vec_id long, score long"


@dataclass
class Tree:
    """Pages of one shard. Level 0 are leaf pages; the level above routes to groups of them."""

    vectors: np.ndarray  # rows x dims: integers in page order, as float64 or int64, whichever multiplies exactly
    lift: np.ndarray  # the added component
    ids: list[np.ndarray]  # for each row the smallest ids of that vector
    page_off: np.ndarray  # rows of each page
    centers: np.ndarray  # pages x (dims + 1)
    radius: np.ndarray
    to_parent: np.ndarray  # distance of each row to its page's routing object
    top_off: np.ndarray  # pages of each upper node
    top_centers: np.ndarray
    top_radius: np.ndarray
    page_to_top: np.ndarray  # distance of each page's routing object to its upper node's


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def split(x: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Groups of at most ``most`` rows: each goes to the nearer of two distant objects, over and over."""
    out, todo = [], [rows]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        d = distances(x[own], x[own[:1]])[:, 0]
        far = int(d.argmax())
        both = distances(x[own], x[own[[far]]])[:, 0]
        other = int(both.argmax())
        near = both - distances(x[own], x[own[[other]]])[:, 0]
        order = np.argsort(near, kind="stable")  # halves, so that pages fill up evenly
        todo += [own[order[len(own) // 2 :]], own[order[: len(own) // 2]]]
    return out


def build(vectors: np.ndarray, ids: np.ndarray, k: int, reach: float) -> Tree:
    """M-tree over distinct vectors; ``reach`` is the largest squared length of all shards."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    vectors, ids = vectors[order], ids[order]
    new = np.ones(len(vectors), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(vectors)]])
    own_ids = [ids[a : min(b, a + k + 1)] for a, b in zip(starts, ends, strict=True)]
    vectors = vectors[starts]
    wide = vectors.astype(np.float64)
    lift = np.sqrt(np.maximum(reach - (wide * wide).sum(axis=1), 0))
    x = np.concatenate([wide, lift[:, None]], axis=1)
    groups = split(x, np.arange(len(x)), PAGE)
    centers = np.stack([x[g].mean(axis=0) for g in groups])
    tops = split(centers, np.arange(len(groups)), FANOUT)
    pages = [groups[p] for t in tops for p in t]
    centers = np.concatenate([centers[t] for t in tops])
    at = np.concatenate(pages)
    page_off = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    page_of = np.repeat(np.arange(len(pages)), np.diff(page_off))
    to_parent = np.sqrt(((x[at] - centers[page_of]) ** 2).sum(axis=1))
    radius = np.maximum.reduceat(to_parent, page_off[:-1])
    top_off = np.concatenate([[0], np.cumsum([len(t) for t in tops])])
    top_of = np.repeat(np.arange(len(tops)), np.diff(top_off))
    top_centers = np.stack([centers[a:b].mean(axis=0) for a, b in zip(top_off[:-1], top_off[1:], strict=True)])
    page_to_top = np.sqrt(((centers - top_centers[top_of]) ** 2).sum(axis=1))
    top_radius = np.maximum.reduceat(page_to_top + radius, top_off[:-1])
    return Tree(vectors[at], lift[at], [own_ids[i] for i in at], page_off, centers, radius, to_parent, top_off, top_centers, top_radius, page_to_top)


def search(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's first k in the tree: all queries step by step, each in its own order."""
    n = len(queries)
    q = np.concatenate([queries.astype(np.float64), np.zeros((n, 1))], axis=1)
    length = (q * q).sum(axis=1)
    slack = MARGIN * np.sqrt(length + reach) + 1e-6
    kth, kth_score = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).min)  # the k-th best score so far, for bounds and exactly
    scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    # lower bounds of pages' distances, by way of the upper nodes: |d(q, top) - d(top, page)| - radius
    to_top = distances(q, tree.top_centers)
    top_of = np.repeat(np.arange(len(tree.top_off) - 1), np.diff(tree.top_off))
    bound = np.maximum(np.abs(to_top[:, top_of] - tree.page_to_top[None, :]) - tree.radius[None, :], (to_top - tree.top_radius[None, :])[:, top_of])
    exact = np.zeros(bound.shape, bool)  # whether d(q, page) itself is known
    to_page = np.zeros(bound.shape)
    active = np.arange(n)
    while len(active):
        # each query's most promising page; the distance to its routing object is computed when it first comes up
        best = bound[active].argmin(axis=1)
        b = bound[active, best]
        least = np.sqrt(np.maximum(length[active] + reach - 2 * kth[active], 0))  # the k-th result's distance
        go = np.isfinite(b) & ((b <= least + slack[active]) | ~np.isfinite(kth[active]))
        active, best = active[go], best[go]
        if not len(active):
            break
        fresh = ~exact[active, best]
        order = np.argsort(best, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(best[order]) != 0]))
        for i, lo in enumerate(cuts):
            hi = cuts[i + 1] if i + 1 < len(cuts) else len(order)
            rows, page = active[order[lo:hi]], int(best[order[lo]])
            new = rows[fresh[order[lo:hi]]]
            if len(new):
                d = distances(q[new], tree.centers[page : page + 1])[:, 0]
                to_page[new, page], exact[new, page] = d, True
                bound[new, page] = np.maximum(bound[new, page], d - tree.radius[page])
                limit = np.sqrt(np.maximum(length[new] + reach - 2 * kth[new], 0))
                ready = (bound[new, page] <= limit + slack[new]) | ~np.isfinite(kth[new])
                bound[new[~ready], page] = np.inf
                rows = np.concatenate([rows[~fresh[order[lo:hi]]], new[ready]])
            if not len(rows):
                continue
            bound[rows, page] = np.inf
            a, z = int(tree.page_off[page]), int(tree.page_off[page + 1])
            limit = np.sqrt(np.maximum(length[rows] + reach - 2 * kth[rows], 0)) + slack[rows]
            limit[~np.isfinite(kth[rows])] = np.inf
            # entries that their stored parent distance doesn't rule out for some query of the group
            may = np.abs(to_page[rows, page][:, None] - tree.to_parent[None, a:z]) <= limit[:, None]
            entries = np.flatnonzero(may.any(axis=0))
            if not len(entries):
                continue
            product, allowed = (queries[rows] @ tree.vectors[a + entries].T).astype(np.int64), may[:, entries]
            for j, row in enumerate(rows):
                better = np.flatnonzero(allowed[j] & (product[j] >= kth_score[row]))
                if not len(better):
                    continue
                own = [tree.ids[a + entries[x]] for x in better]
                sc = np.repeat(product[j][better], [len(o) for o in own])
                vid = np.concatenate(own)
                other = vid != query_ids[row]
                sc, vid = np.concatenate([scores[row], sc[other]]), np.concatenate([found[row], vid[other]])
                first = np.lexsort((vid, -sc))[:k]
                scores[row], found[row] = sc[first], vid[first]
                if len(first) == k:
                    kth_score[row] = sc[first[-1]]
                    kth[row] = float(sc[first[-1]])
    sizes = [len(f) for f in found]
    return np.repeat(np.arange(n), sizes), np.concatenate(found) if n else np.zeros(0, np.int64), np.concatenate(scores) if n else np.zeros(0, np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest products, its own id left out, ties to smaller ids.

    Both inputs have id (long) and v (array of long). Query ids must be distinct;
    a vector is told from a query's own by its id.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors, queries = vectors.select("id", "v").distinct(), queries.select("id", "v").distinct()
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    facts = vectors.agg(F.count("*").alias("n"), F.max(square).alias("reach")).first()
    first = queries.select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if not facts["n"] or first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = max(1, -(-facts["n"] // SHARD_ROWS))
    reach, dims = float(facts["reach"]), first["d"]
    exact = np.float64 if reach < 2**52 else np.int64  # what multiplies without rounding
    rows = vectors.where(F.size("v") == dims).select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"), F.lit(False).alias("query"), "id", "v")
    asked = queries.where(F.size("v") == dims).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("query"), "id", "v")

    def run(batches):
        shard, tree, held, kind = None, None, [], False

        def settle():
            """What the rows held are for: a tree, or results of queries in the tree."""
            nonlocal tree
            if not held:
                return None
            ids, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            if not kind:
                tree = build(v, ids, k, reach)
                return None
            if tree is None:
                return None
            row, i, s = search(tree, v, ids, k, reach)
            return pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            own, asks, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            v = batch.column(3).flatten().to_numpy().reshape(len(ids), dims).astype(exact)
            edges = np.flatnonzero((own[1:] != own[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(own)], strict=True):
                if lo == hi:
                    continue
                if shard != own[lo] or kind != asks[lo] or (kind and sum(len(h[0]) for h in held) >= QUERY_BLOCK):
                    done = settle()
                    if done is not None:
                        yield done
                    if shard != own[lo]:
                        tree = None
                    shard, kind = own[lo], asks[lo]
                held.append((ids[lo:hi], v[lo:hi]))
        done = settle()
        if done is not None:
            yield done

    dealt = rows.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "query")
    return first_k(dealt.mapInArrow(run, FOUND), k)


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all shards; a query has at most k rows from each shard."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(df: DataFrame, vector: str, vec_id: str, factor: int = 64) -> DataFrame:
    """(id, v): each component x as floor(factor * x); vectors that take no part are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    wide = F.transform(vector, lambda x: x.cast("double") * float(factor))
    ok = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(wide, lambda x: F.coalesce(finite(x), F.lit(False)))
    square = F.aggregate(wide, F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1))
    return df.where(ok & (square < float(1 << 62))).select(F.col(vec_id).cast("long").alias("id"), F.transform(wide, lambda x: F.floor(x)).alias("v"))
