"""Pairs of texts whose sets of word shingles have at least a given Jaccard similarity, found exactly.

Two sets of similarity t or more share one of their first n - ceil(t n) + 1
members, in any order that both are sorted by. The better rare members come
first, the fewer sets meet. So the members in the lowest ``DOMAIN`` of all
hashes are counted, and the order is: those that occur once, those that occur
some times, those not counted, and the common ones; by hash within each. Members
that occur once meet nothing and aren't listed at all. What is known of the
counts goes to the tasks in two bitmaps of fixed size: a wrong bit changes the
order, which is the same for all texts, and never a result.

Texts that meet in a list of a member are first compared to one of it, chosen
by hash anew in each list. Those that these links leave in different components
are paired within blocks of bounded size: first each with the first one that it
may be similar to, in an order that differs from list to list, then all that are
in different components still. Before that last step no text tries more than
``TRIES`` of its links. So a large group of similar texts gives links in
proportion to its rows. A pair is given up when what
is left behind the shared member in both sets can't reach the similarity, or
when their parity sketches differ in more bits than so similar sets can differ
in members; both are proofs, no estimates. Every other pair is verified on the
whole sets, which only texts of such pairs give. Nothing is capped.

Equal sets are one node. Texts without a word have an empty set and no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import cut, release

from . import sieve
from .components import components
from .textscan import U64, map_texts, mixed, prefix_hash, slice_hash, utf8

SHINGLE = 5
LEAST = 0.8
#: Part of the hash range whose members are counted.
DOMAIN = 0.3
#: A member is common if it occurs oftener than this, and than a HOT_KEYS-th of all counted: so at most HOT_KEYS are.
HOT_TIMES, HOT_KEYS = 64, 1 << 19
SHARED_BITS, HOT_BITS, ASKED_BITS = 1 << 25, 1 << 23, 1 << 24
#: 64-bit words of a parity sketch.
SKETCH = 8
#: Rows of a list that are compared among themselves in one place; a longer list is dealt into blocks.
BLOCK = 4096
#: Pairs that one step compares by their sketches.
STEP = 1 << 16
#: Links of one text that are tried at once before all that is left is paired.
TRIES = 4
#: Lists up to this length are compared across all lists of a batch at once.
SHORT = 48


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's set of shingles of lower-cased (A-Z) words, sorted; a shorter text is one shingle."""
    raw, off = utf8(texts)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    each = slice_hash(prefix_hash(low), a, b)
    at = np.searchsorted(a, off)
    n = np.diff(at)
    h = np.zeros(len(a), U64)
    for j in range(words):
        # past a text's last word nothing is added: that matters to texts of fewer words only
        ahead = np.arange(len(a)) + j
        there = ahead < np.repeat(at[1:], n)
        h[there] = mixed(h[there] * U64(31) + each[ahead[there]])
    doc = np.repeat(np.arange(len(n)), n)
    whole = np.arange(len(a)) - np.repeat(at[:-1], n) < np.repeat(np.maximum(1, n - words + 1), n)
    h, doc = h[whole], doc[whole]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def prefixes(n: np.ndarray, least: float) -> np.ndarray:
    """How many first members of a set of n one must look at."""
    return np.where(n > 0, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0)


def _signature(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A number that tells sets apart."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mixed(h), dtype=U64)])
    return mixed(sums[off[1:]] - sums[off[:-1]]).view(np.int64)


def sketches(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """(docs, SKETCH) words: the parity of the members that fall on each bit. Sets differ in as many members as bits, at least."""
    bits = SKETCH * 64
    at = (mixed(h ^ U64(0x5851F42D4C957F2D)) & U64(bits - 1)).astype(np.int64)
    odd = (np.bincount(doc * bits + at, minlength=docs * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(docs, bits), axis=1, bitorder="little").view(np.int64)


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def counted(df: DataFrame, text: str, words: int) -> DataFrame:
    """(key, times) of the members below the domain's bound that occur in several texts, cut."""
    bound = U64(int(DOMAIN * 2**64))

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            h, off = shingle_sets(texts, words)
            low = h < bound
            at = np.concatenate([[0], np.cumsum(low)])[off]
            return [_lists(h[low].view(np.int64), at)]

        return work

    keys = map_texts(df, text, [], "keys array<long>", make).select(F.explode("keys").alias("key"))
    return cut(keys.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"))


def first_members(df: DataFrame, text: str, node: str, words: int, least: float, shared: np.ndarray, hot: np.ndarray) -> DataFrame:
    """(node, sig, n, bits, keys, at): of each text its set's size and sketch, and the first members that others may
    have too, with their places in the order."""
    handle = df.sparkSession.sparkContext.broadcast((shared, hot))  # two bitmaps of fixed size
    bound = U64(int(DOMAIN * 2**64))

    def make():
        shared, hot = handle.value

        def work(texts: pa.Array) -> list[pa.Array]:
            h, off = shingle_sets(texts, words)
            n = np.diff(off)
            docs = len(n)
            doc = np.repeat(np.arange(docs), n)
            low = h < bound
            tier = np.where(low, np.where(sieve.holds(shared, h), np.where(sieve.holds(hot, h), 3, 1), 0), 2)
            order = np.lexsort((h, tier, doc))
            place = np.arange(len(h)) - off[doc]
            use = (place < prefixes(n, least)[doc]) & (tier[order] > 0)
            at = np.concatenate([[0], np.cumsum(use)])[off]
            bits = _lists(sketches(h, doc, docs).ravel(), np.arange(docs + 1) * SKETCH)
            return [pa.array(_signature(h, off)), pa.array(n.astype(np.int64)), bits, _lists(h[order][use].view(np.int64), at), _lists(place[use].astype(np.int32), at)]

        return work

    return map_texts(df, text, [node], "sig long, n long, bits array<long>, keys array<long>, at array<int>", make)


def whole_sets(df: DataFrame, text: str, node: str, words: int) -> DataFrame:
    """(node, sig, members) of each text."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            h, off = shingle_sets(texts, words)
            return [pa.array(_signature(h, off)), _lists(h.view(np.int64), off)]

        return work

    return map_texts(df, text, [node], "sig long, members array<long>", make)


def _verified(pairs: DataFrame, nodes: DataFrame, df: DataFrame, text: str, node: str, words: int, least: float) -> DataFrame:
    """(a, b) of the pairs (cut) that are as similar as that; ``nodes`` (sig, a): a text's node for each set."""
    if pairs.isEmpty():
        return pairs
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = cut(nodes.select("sig", F.col("a").alias("wanted")).join(asked, "sig"))
    near, _ = sieve.apart(df.select(node, text), F.col(node), wanted.select("wanted"), ASKED_BITS)
    found = whole_sets(near, text, node, words).join(wanted.select(F.col("wanted").alias(node), F.col("sig").alias("own")), node).where("sig = own")
    sets = cut(found.groupBy("sig").agg(F.first("members").alias("members")))  # equal sets: any of them
    left, right = sets.select(F.col("sig").alias("a"), F.col("members").alias("x")), sets.select(F.col("sig").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = cut(pairs.join(left, "a").join(right, "b").where(both >= F.lit(least) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"))
    release(wanted, sets)
    return alike


def _may(least: float, a: dict, b: dict):
    """Whether two rows of a list can be as similar as that: by what stands behind the shared member, and by their sketches."""
    total = a["n"] + b["n"]
    share = least / (1 + least)
    behind = F.least(a["n"] - a["at"], b["n"] - b["at"]) >= F.lit(share) * total - 1e-9
    apart = sum((F.bit_count(F.get(a["bits"], F.lit(i)).bitwiseXOR(F.get(b["bits"], F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    return behind & (apart <= F.lit(1 - 2 * share) * total + 1e-9)


def _pairs_within(least: float, spanning: bool):
    """Pairs (a, b) of rows (key, block, other, side, sig, n, at, root, bits) that stand in order of the first three.

    A cell of one block has pairs of its rows (side 2); a cell of two has pairs of
    a row of each (sides 0 and 1). Only rows of different roots are paired, each
    ``spanning`` with the first that will do.
    """
    share = least / (1 + least)

    def able(n, at, root, bits, i, j):
        total = n[i] + n[j]
        ok = (root[i] != root[j]) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= share * total - 1e-9)
        i, j, total = i[ok], j[ok], total[ok]
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= (1 - 2 * share) * total + 1e-9
        return i[near], j[near]

    def settle(cols) -> list[np.ndarray]:
        cell, side, sig, n, at, root, bits = cols
        out = []
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        lengths = np.diff(np.append(starts, len(cell)))
        left_over = np.repeat(starts + lengths, lengths) - np.arange(len(cell))  # rows from each to its cell's end
        open_ = np.repeat(lengths <= SHORT, lengths)
        for d in range(1, SHORT):
            i = np.flatnonzero(open_ & (left_over > d))
            if not len(i):
                break
            i = i[(side[i] == 2) | (side[i] != side[i + d])]
            i, j = able(n, at, root, bits, i, i + d)
            out.append(np.stack([sig[i], sig[j]], axis=1))
            if spanning:
                open_[i] = False  # the first of a pair is the one that the link is for
        for s, m in zip(starts[lengths > SHORT], lengths[lengths > SHORT], strict=True):
            rows, two = np.arange(s, s + m), side[s] != 2
            left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if two else (rows, rows)
            step = max(1, STEP // max(1, len(right)))
            for lo in range(0, len(left), step):
                part = left[lo : lo + step]
                grid = root[part][:, None] != root[right][None, :]
                if not two:
                    grid &= part[:, None] < right[None, :]
                x, y = np.nonzero(grid)
                i, j = able(n, at, root, bits, part[x], right[y])
                if spanning:
                    j, first = np.unique(j, return_index=True)  # pairs stand in order of i
                    i = i[first]
                    right = np.setdiff1d(right, j, assume_unique=True)
                    i, j = j, i
                out.append(np.stack([sig[i], sig[j]], axis=1))
        return out

    def run(batches):
        held = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            bits = batch.column(8).flatten().to_numpy().reshape(len(key), SKETCH).view(U64)
            new = [key, *[batch.column(c).to_numpy() for c in range(3, 8)], bits]
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            same = (held[0] == held[0][-1]).all(axis=1)
            last = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if last:
                yield _emit(settle(_numbered([c[:last] for c in held])))
                held = [c[last:] for c in held]
        if held is not None and len(held[0]):
            yield _emit(settle(_numbered(held)))

    return run


def _numbered(cols: list[np.ndarray]) -> list[np.ndarray]:
    """The three columns that tell cells apart replaced by one."""
    key = cols[0]
    new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, bool)
    return [np.cumsum(new), *cols[1:]]


def _emit(parts: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    pairs = np.unique(pairs, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _labels(links: DataFrame) -> DataFrame:
    """(node, root): the smallest of a node and those it is linked to. Nodes of one root are connected; one round tells no more."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))


def remaining_pairs(lists: DataFrame, roots: DataFrame, least: float, spanning: bool) -> DataFrame:
    """(a, b), cut: pairs of rows of one list that may be similar and have different roots; ``spanning``, one for each row at most."""
    placed = cut(lists.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").select("key", "sig", "n", "at", "bits", F.coalesce("root", "sig").alias("root")))
    parted = cut(placed.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("g"), F.count("*").alias("m")).where("l <> g").select("key", "m"))
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    rows = placed.join(parted, "key").withColumn("blocks", blocks).withColumn("mine", mine)
    # a row of a list of several blocks goes to its own block and to the cells it forms with each other one
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = rows.withColumn("with", other).select(
        "key", F.least("mine", "with").cast("long").alias("block"), F.greatest("mine", "with").cast("long").alias("other"),
        F.when(F.col("mine") == F.col("with"), 2).when(F.col("mine") < F.col("with"), 0).otherwise(1).cast("long").alias("side"),
        "sig", "n", F.col("at").cast("long").alias("at"), "root", "bits",
    )
    dealt = cells.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", F.xxhash64("key", "sig"))
    found = dealt.mapInArrow(_pairs_within(least, spanning), "a long, b long")
    pairs = cut(_few(found) if spanning else _ordered(found))
    release(placed)
    return pairs


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _few(pairs: DataFrame) -> DataFrame:
    """``TRIES`` pairs of each a at most, by hash; what they leave apart is paired in full later."""
    each = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")
    return _ordered(pairs.distinct().withColumn("nth", F.row_number().over(each)).where(F.col("nth") <= TRIES))


def similar_links(df: DataFrame, text: str = "text", node: str = "fp", words: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(a, b): links between the nodes (long) of texts, which connect all pairs of at least that similarity."""
    df = df.select(node, text)
    times = counted(df, text, words)
    bar = max(HOT_TIMES, (times.agg(F.sum("times")).first()[0] or 0) // HOT_KEYS)
    shared = sieve.as_array(times.select("key"), SHARED_BITS)
    hot = sieve.as_array(times.where(F.col("times") > bar).select("key"), HOT_BITS)
    release(times)
    first = cut(first_members(df, text, node, words, least, shared, hot).where("n > 0"))
    # equal sets are equal in all that was made of them: any row of them will do
    sets = cut(first.groupBy("sig").agg(F.min(node).alias("a"), F.max(node).alias("z"), F.first(F.struct("n", "bits", "keys", "at")).alias("one")))
    several = cut(sets.where("a <> z").select("sig", "a"))
    equal = cut(first.select("sig", F.col(node).alias("b")).join(several, "sig").where("b <> a").select("a", "b").distinct())
    release(first, several)
    listed = sets.select("sig", "one.n", "one.bits", F.explode(F.arrays_zip("one.keys", "one.at")).alias("p"))
    lists = cut(listed.select(F.col("p.keys").alias("key"), "sig", "n", F.col("p.at").alias("at"), "bits"))
    nodes = cut(sets.select("sig", "a"))
    release(sets)

    row = F.struct(F.xxhash64("key", "sig").alias("o"), "sig", "n", "at", "bits")
    middle = cut(lists.groupBy("key").agg(F.min(row).alias("c"), F.count("*").alias("m")).where("m > 1").select("key", "c"))
    met = lists.join(middle, "key").where(F.col("sig") != F.col("c.sig"))
    fields = ("n", "at", "bits")
    stars = met.where(_may(least, {f: F.col(f) for f in fields}, {f: F.col(f"c.{f}") for f in fields}))
    stars = cut(_few(stars.select(F.col("sig").alias("a"), F.col("c.sig").alias("b"))))
    every, tried = _verified(stars, nodes, df, text, node, words, least), stars
    open_lists = lists.join(middle.select("key"), "key", "left_semi")
    for spanning in (True, False):
        roots = _labels(every) if spanning else components(every)
        pairs = remaining_pairs(open_lists, roots, least, spanning)
        rest = cut(pairs.join(tried, ["a", "b"], "left_anti"))
        release(pairs)
        every, tried = every.unionByName(_verified(rest, nodes, df, text, node, words, least)), tried.unionByName(rest)
    release(lists, middle)
    named = cut(nodes.join(every.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "sig", "left_semi"))
    of = lambda c: named.select(F.col("sig").alias(c), F.col("a").alias(f"{c}_node"))
    linked = every.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).where("a <> b")
    return linked.unionByName(equal)
