import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

from lodestone.llm import simhash


def plain(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def roots_of(fps):
    """Smallest position reachable over links of at most three differing bits."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def family(rng, n, spread):
    base = rng.getrandbits(64)
    out = set()
    while len(out) < n:
        x = base
        for _ in range(rng.randint(0, spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_position_sets_cover_every_five():
    assert len(simhash.POSITION_SETS) == 14
    for five in combinations(range(8), 5):
        assert sum(set(s) <= set(five) for s in simhash.POSITION_SETS) == 1


def test_fingerprints():
    rng = random.Random(2)
    texts = ["", "  \t\n", "One", "one TWO", "Ä ä a b c", "a a a a a", " ".join(rng.choice("abcdefgh") for _ in range(3000)), "x\x0by\x0cz\r1 2"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain(t)


def components_of(batches):
    edges = []
    for b in batches:
        edges += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
    return edges


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(7)
    fps = sorted({*family(rng, 60, 6), *family(rng, 30, 2), *(rng.getrandbits(64) for _ in range(200)), 0, 1, 7, 15, (1 << 64) - 1})
    check(spark, fps)


def test_long_lists_are_split_and_not_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", 16)
    monkeypatch.setattr(simhash, "SHORT_LIST", 4)
    rng = random.Random(9)
    check(spark, sorted({*family(rng, 150, 5), *family(rng, 40, 3), *(rng.getrandbits(64) for _ in range(50))}))


def check(spark, fps):
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long").coalesce(1)).collect()
    place = {f: i for i, f in enumerate(signed)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = place[r["a"]], place[r["b"]]
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == roots_of(fps)


def test_long_list_of_one_key_is_handed_on_whole(monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", 10)
    keys = np.repeat(np.array([1, 2, 3]), [3, 25, 2])
    fps = np.arange(30).astype(np.int64) * (1 << 40)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7]), pa.array(fps[i : i + 7])], names=["key", "fp"]) for i in range(0, 30, 7)]
    handed = [e for e in components_of(simhash.link_lists(batches)) if e[2]]
    assert sorted(e[0] for e in handed) == fps[keys == 2].tolist() and {e[1] for e in handed} == {2}


def test_dense_forest_equals_forest():
    rng = np.random.default_rng(4)
    positions = (1, 4, 6)
    base = 0x1122334455667788 & ~sum(255 << 8 * p for p in positions)
    small = np.unique(rng.integers(0, 1 << 24, 300) & 0x0F0F0F)
    fps = np.array([base | sum(((int(v) >> 8 * i) & 255) << 8 * p for i, p in enumerate(positions)) for v in small], np.uint64)

    def groups(parts):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in parts:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
        return [find(int(f)) for f in fps]

    assert groups(simhash.dense_forest(fps, positions)) == groups(simhash.forest(fps))


def test_operator_over_odd_rows(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice("abcdefghijklmnop") + rng.choice("qrstuvw") for _ in range(20_000))
    rows = [(9, long), (4, long), (4, long), (5, None), (6, ""), (8, " \n"), (None, "solitary words here"), (2, "another short text of words"), (1, long + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'x' as component_id")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {r["doc_id"]: r["fp"] for r in got}
    for i, t in rows:
        assert np.int64(fps[i]).astype(np.uint64) == plain(t)
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert component[5] == component[6] == component[8] == 5
    assert component[9] == component[4] and component[2] == 2 and component[None] is None
    assert (component[9] == 1) == (bin(plain(long) ^ plain(long + " tail")).count("1") <= 3)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query(spark, small):
    from lodestone.llm.queries import op7_simhash

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    fps = [plain(t) for _, t in docs]
    want = {i: (format(f, "016x"), docs[r][0]) for (i, _), f, r in zip(docs, fps, roots_of(fps), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op7_simhash(spark, small).collect()}
    assert got == want
