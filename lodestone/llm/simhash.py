"""SimHash near-duplicates over an inverted index of positional bytes with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most three
bits share at least five of them at their positions. Posting lists of single
(position, byte) pairs hold a 256th of all rows each, so the index intersects
four lists at a time: the fourteen sets of four positions whose numbers XOR to
zero are such that any five positions contain exactly one of them. A pair that
reaches the guaranteed five matches therefore meets in exactly one or more of
fourteen lists of 32-bit keys. Pairs that meet are tallied (shared positional
bytes), those with fewer than five are dropped, the rest are verified by their
differing bits.

Exact copies are one fingerprint before anything is joined. Within a list no
pairs leave the task but a spanning forest of its links. A list with more than
``LONG_LIST`` fingerprints is split by a fifth position, four ways; such a list
holds at most 2**24 different fingerprints by construction, and those are
linked by looking up the 2,324 neighbours of each one, so the work grows with
the list and not with its square. Nothing is capped.

Defined results: null, empty and word-free texts have fingerprint zero and are
linked like any other; a null doc_id takes part, and a component with no other
id has a null component_id; repeated rows are each returned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import cut

from . import overlap
from .components import components
from .textscan import U64, map_texts, utf8

SEED = 42
WORDS = 3
MOST_BITS = 3
LEAST_SHARED = 8 - MOST_BITS
#: Sets of four positions; any five positions contain exactly one of them.
POSITION_SETS = tuple(s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0)
#: Fingerprints of a list that one step compares among themselves.
LONG_LIST = 8192
#: Lists up to this length are compared across all lists of a batch at once.
SHORT_LIST = 8


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Fingerprint of one text given as UTF-8 bytes."""
    parts = text.lower().split()  # bytes: lowers A-Z, splits at space and 09-0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), U64, n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(U64)[0])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """Add fp, the fingerprint's 64 bits as a signed long, from shingles of so many words."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            raw, off = utf8(texts)
            data = raw.tobytes()
            found = [fingerprint(data[a:b], words) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            return [pa.array(np.array(found, U64).view(np.int64))]

        return work

    return map_texts(df, text, df.columns if keep is None else keep, "fp long", make)


def _byte(p: int):
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)


def _key(positions: tuple[int, ...], number: int):
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def linked(x: np.ndarray) -> np.ndarray:
    """Whether pairs with XOR ``x`` reach the shared bytes and stay within the differing bits."""
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    return (tally >= LEAST_SHARED) & (np.bitwise_count(x) <= MOST_BITS)


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among ``fps`` (distinct), by breadth-first search over blocks."""
    out, left = [], fps
    while len(left) > 1:
        front, left = left[:1], left[1:]
        root = front[0]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            step = max(1, (1 << 20) // max(1, len(left)))
            for i in range(0, len(front), step):
                x = front[i : i + step, None] ^ left[None, :]
                near |= (np.bitwise_count(x) <= MOST_BITS).any(axis=0)
            front, left = left[near], left[~near]
            if len(front):
                out.append((np.full(len(front), root), front))
    return out


def _masks() -> np.ndarray:
    bits = [1 << i for i in range(24)]
    return np.array([sum(c) for n in range(1, MOST_BITS + 1) for c in combinations(bits, n)], np.uint32)


def dense_forest(fps: np.ndarray, positions: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for fingerprints equal outside the three ``positions``: neighbours are looked up in a table of 2**24."""
    small = np.zeros(len(fps), np.uint32)
    for i, p in enumerate(positions):
        small |= (((fps >> U64(8 * p)) & U64(255)) << U64(8 * i)).astype(np.uint32)
    rest = fps[0] & ~U64(sum(255 << (8 * p) for p in positions))

    def whole(v: np.ndarray) -> np.ndarray:
        out = np.full(len(v), rest, U64)
        for i, p in enumerate(positions):
            out |= ((v.astype(U64) >> U64(8 * i)) & U64(255)) << U64(8 * p)
        return out

    there, masks, out = np.zeros(1 << 24, bool), _masks(), []
    there[small] = True
    for seed in small:
        if not there[seed]:
            continue
        there[seed] = False
        front, root = np.array([seed], np.uint32), whole(np.array([seed]))[0]
        while len(front):
            reached = []
            for i in range(0, len(front), 512):
                near = (front[i : i + 512, None] ^ masks[None, :]).ravel()
                near = np.unique(near[there[near]])
                there[near] = False
                reached.append(near)
            front = np.concatenate(reached)
            if len(front):
                out.append((np.full(len(front), root), whole(front)))
    return out


def _emit(parts: list[tuple[np.ndarray, np.ndarray]], long: bool) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U64)
    b = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, U64)
    flags = pa.array(np.full(len(a), long))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(U64).view(np.int64)), pa.array(b.astype(U64).view(np.int64)), flags], names=["a", "b", "long_list"])


def _short(keys: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of lists of at most SHORT_LIST rows, which stand one after another."""
    out = []
    for d in range(1, min(SHORT_LIST, len(keys))):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(same):
            break
        x = fps[same] ^ fps[same + d]
        good = same[linked(x)]
        out.append((fps[good], fps[good + d]))
    return out


def link_lists(batches):
    """Links of posting lists that arrive sorted by key; rows of long lists are handed on instead."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, U64)
    handing = None  # the key of a long list whose rows are being handed on

    def settle(keys, fps):
        if not len(keys):
            return []
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(keys)]]))
        short = np.repeat((lengths > 1) & (lengths <= SHORT_LIST), lengths)
        out = _short(keys[short], fps[short])
        for i in np.flatnonzero(lengths > SHORT_LIST):
            out += forest(fps[starts[i] : starts[i] + lengths[i]])
        return out

    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
        if handing is not None:
            n = int(np.searchsorted(k, handing, "right"))
            if n:
                yield _emit([(f[:n], np.full(n, handing, np.int64).view(U64))], True)
            k, f = k[n:], f[n:]
            if not len(k):
                continue
            handing = None
        keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
        if not len(keys):
            continue
        open_at = int(np.searchsorted(keys, keys[-1], "left"))
        # whole lists of this batch that are too long are handed on too
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(keys)]]))
        big = np.repeat(lengths > LONG_LIST, lengths)
        if big.any():
            yield _emit([(fps[big], keys[big].view(U64))], True)
            if big[-1]:
                handing = keys[-1]
        done = ~big
        done[open_at:] = False
        found = settle(keys[done], fps[done])
        if found:
            yield _emit(found, False)
        rest = ~big
        rest[:open_at] = False
        keys, fps = keys[rest], fps[rest]
    found = settle(keys, fps)
    if found:
        yield _emit(found, False)


def _link_dense(batches):
    """Links of lists of five positions, sorted by key; a list has at most 2**24 rows."""
    held: dict[int, list[np.ndarray]] = {}

    def settle(key, parts):
        fps = np.unique(np.concatenate(parts))
        number, fifth = divmod(key >> 40, 8)
        free = tuple(p for p in range(8) if p not in POSITION_SETS[number] and p != fifth)
        return forest(fps) if len(fps) <= 4096 else dense_forest(fps, free)

    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else []
        for s, e in zip(starts, [*starts[1:], len(k)], strict=True):
            key = int(k[s])
            for other in [x for x in held if x != key]:
                yield _emit(settle(other, held.pop(other)), False)
            held.setdefault(key, []).append(f[s:e])
    for key, parts in held.items():
        yield _emit(settle(key, parts), False)


LINKS = "a long, b long, long_list boolean"


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within the differing bits."""
    lists = fps.select("fp", F.explode(F.array(*[_key(s, i) for i, s in enumerate(POSITION_SETS)])).alias("key"))
    first = lists.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(link_lists, LINKS)
    first = cut(first)
    links = first.where("not long_list").select("a", "b")
    more = first.where("long_list").select(F.col("a").alias("fp"), F.col("b").alias("key"))
    if more.isEmpty():
        return links
    number = F.shiftrightunsigned("key", 32)
    fifths = [
        F.when(~number.isin([i for i, s in enumerate(POSITION_SETS) if p in s]), F.shiftleft(F.shiftleft(number, 3).bitwiseOR(p), 40).bitwiseOR(F.shiftleft(F.col("key").bitwiseAND((1 << 32) - 1), 8)).bitwiseOR(_byte(p)))
        for p in range(8)
    ]
    finer = more.select("fp", F.explode(F.array(*fifths)).alias("key")).where("key is not null")
    dense = finer.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_link_dense, LINKS)
    return links.unionByName(dense.select("a", "b"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), shingle: int | None = None, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) of every row, and its columns ``keep``.

    With ``shingle``, fingerprints are made of shingles of that many words, and
    texts are linked too whose sets of these have at least that Jaccard
    similarity, however many bits their fingerprints differ in.
    """
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
    named = texts.withColumn("__node", F.xxhash64("text"))
    docs = cut(fingerprints(named, keep=["doc_id", "__node", *keep], words=shingle or WORDS))
    each = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    links = fingerprint_links(each)
    if shingle is not None:
        alike = cut(overlap.similar_links(named, node="__node", words=shingle, least=similarity))
        ends = cut(alike.select(F.explode(F.array("a", "b")).alias("__node")).distinct())
        of = cut(docs.select("__node", "fp").join(ends, "__node", "left_semi").distinct())
        a, b = (of.select(F.col("__node").alias(c), F.col("fp").alias(f"{c}_fp")) for c in ("a", "b"))
        links = links.unionByName(alike.join(a, "a").join(b, "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")))
    roots = components(links)
    joined = each.join(roots, each["fp"] == roots["node"], "left")
    grouped = cut(joined.where("root is not null").select("fp", "root", "least"))
    whole = cut(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    in_links = grouped.join(whole, "root").select("fp", "component_id")
    copies = joined.where("root is null and n > 1").select("fp", F.col("least").alias("component_id"))
    table = cut(in_links.unionByName(copies))  # both sides of the next join are then dealt anew, and hot keys split
    return docs.join(table, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), *keep)


def as_hex(fp):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
