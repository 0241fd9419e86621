import hashlib
from itertools import combinations

import corpus_pipeline as cp
from test_linededup import plain as plain_lines
from test_overlap import roots as connected
from test_overlap import shingles, similarity
from test_simhash import plain as plain_fingerprint

from lodestone.llm import mixing


def test_stages_equal_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, small)
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"]: r for r in docs.collect()})
    start = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(kept[0]) >= 0.99 * len(start)

    lines = plain_lines([(i, r["text"]) for i, r in kept[0].items()])
    want = {i: t for i, (t, n, gone) in lines.items() if not gone or gone < n}
    assert {i: r["text"] for i, r in kept[1].items()} == want
    assert all(r["n_chars"] == len(r["text"]) for i, r in kept[1].items() if r["text"] != kept[0][i]["text"])

    ids = sorted(want)
    sets = [shingles(want[i]) for i in ids]
    prints = [plain_fingerprint(want[i], 5) for i in ids]
    near = [(i, j) for i, j in combinations(range(len(ids)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3 or similarity(sets[i], sets[j]) >= 0.8]
    assert set(kept[2]) == {ids[r] for r in connected(len(ids), near)}

    again = mixing.mix(spark.createDataFrame([(i, r["text"], r["lang"], r["source"]) for i, r in kept[2].items()], "doc_id long, text string, lang string, source string")).where("sampled").collect()
    assert set(kept[3]) == {r["doc_id"] for r in again}

    assert set(kept[4]) == set(kept[3])
    assert all(r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"] for r in kept[4].values())


def test_run_equals_the_stages(spark, small):
    got = cp.run(spark, small)
    assert got.count() > 50 and "n_tokens" in got.columns


def test_empty_and_odd_documents(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "same words in both rows here", "en", "a", 28), (3, "same words in both rows here", "en", "a", 28), (None, "other words without any id", "en", "b", 26), (5, "yet more of the words", "en", "b", 21)]
    df = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES:
        assert stage(spark, df.limit(0), small).count() == 0, name
        assert stage(spark, df, small).count() <= len(rows), name
    left = cp.near_duplicates(spark, df, small).collect()
    assert sum(r["doc_id"] == 3 for r in left) == 1 and sum(r["doc_id"] is None for r in left) == 1


def test_columns_of_the_same_name_as_new_ones_stay(spark, small):
    extra = ["score", "rejected", "lang_pred", "n_lines", "n_removed", "topic", "tokens", "probability", "sampled", "fp", "component_id", "starts", "id", "th", "n_tokens"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40).selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in extra])
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in extra), name
    assert cp.encode(spark, docs, small).count() == 40
