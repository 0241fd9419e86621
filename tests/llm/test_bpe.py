import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from lodestone.llm import bpe  # noqa: E402
from lodestone.llm.textscan import codepoints, utf8  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(open(PATH, "rb").read()))


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def encoded(encoder, texts):
    raw, off = utf8(pa.array(texts, pa.string()))
    cps, at = codepoints(raw, off)
    begins = bpe.boundaries(cps, at)
    places = np.flatnonzero((raw & 0xC0) != 0x80)
    cuts = [*places[begins].tolist(), len(raw)]
    data = raw.tobytes()
    pieces = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rows = np.searchsorted(begins, at)
    return [np.frombuffer(b"".join(encoder[p] for p in pieces[a:b]), "<u4").tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)]


def test_random_texts_match_the_library(encoder, library):
    rng, letters = random.Random(3), "ab'sdtmrvelL  \n\t\r12é!# 　中\U0001f600.’ſ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [None, "", " ", "\n", "don't we'll I'M 's", " 's", "a\n\n b  c ", "x" * 5000, "ab " * 3000, "'" * 50, "<|endoftext|>"]
    assert encoded(encoder, texts) == [library.encode_ordinary(t or "") for t in texts]


def test_every_code_point_has_the_library_class(encoder, library):
    step = 4096
    blocks = [[chr(c) for c in range(s, min(s + step, 0x110000)) if not 0xD800 <= c < 0xE000] for s in range(0, 0x110000, step)]
    texts = ["".join(f"a{c}1{c} {c}!{c}" for c in block) for block in blocks]
    for start, mine, text in zip(range(0, 0x110000, step), encoded(encoder, texts), texts, strict=True):
        assert mine == library.encode_ordinary(text), hex(start)


def test_long_merge_equals_short_merge(encoder):
    rng = random.Random(5)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcdehitnos ") for _ in range(rng.randint(1, 120)))
        assert encoder.merge_long(piece) == encoder.merge(piece)


def test_scan_is_associative():
    machine, _ = bpe.automaton()
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 5000):
        f = machine.of_class[rng.integers(0, 2 * bpe.CLASSES, n)]
        want = f.copy()
        for i in range(1, n):
            want[i] = machine.compose[want[i - 1] * machine.size + f[i]]
        assert (machine.prefixes(f) == want).all()


def test_operator_round_trip_and_clashing_columns(spark, library):
    rows = [(1, "Hello  wörld, it's 12\n", 7), (2, None, 8), (3, "", 9), (3, "", 9), (None, "中文 \U0001f600 " * 2000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode(df, PATH).collect()
    assert len(got) == 5
    for r in got:
        text = r["text"] or ""
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == library.encode_ordinary(text) and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]).decode() == text
        ends = np.frombuffer(bytes(r["ends"]), "<u4").tolist()
        assert [text.encode()[a:b] for a, b in zip([0, *ends], ends, strict=False)] == [library.decode_single_token_bytes(i) for i in ids]
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_query_digests(spark, small, library):
    from lodestone.llm.queries import op3_byte_bpe

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op3_byte_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
