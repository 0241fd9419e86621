"""Whole texts of Arrow columns as flat numpy arrays, and hashing of their slices.

A null text counts as an empty one everywhere in this subpackage. Texts are
never cut: a block holds as many whole texts as fit, at least one.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import ship

#: Bytes of text that one vectorised step works on.
BLOCK_BYTES = 1 << 19

U64 = np.uint64
#: An odd multiplier for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than rows."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def codepoints(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of UTF-8 bytes; invalid bytes become U+FFFD."""
    try:
        wide = raw.tobytes().decode("utf-8")
        first = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=first[1:])
        at = first[off]
    except UnicodeDecodeError:
        parts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        wide = "".join(parts)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(wide.encode("utf-32-le"), np.uint32), at


def blocks(off: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``most`` bytes, or one longer text."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fields_of(spec: str) -> list[T.StructField]:
    """Fields of a DDL string."""
    return list(T.StructType.fromDDL(spec).fields)


def map_texts(
    df: DataFrame, text: str, keep: list[str], new: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]]
) -> DataFrame:
    """``keep`` columns and the columns ``new`` (DDL) that ``make()`` computes from ``text``.

    ``make`` runs once for each task; what it returns gets blocks of whole texts.
    An input column that has the name of a new one is replaced.
    """
    ship(df.sparkSession)
    added = fields_of(new)
    names = {f.name.lower() for f in added}
    keep = [c for c in keep if c.lower() not in names]
    carry = unused(keep, "__text__")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(carry))
    schema = T.StructType([source.schema[c] for c in keep] + added)
    out_names = [f.name for f in schema.fields]

    def run(batches):
        work = None
        for batch in batches:
            work = work or make()
            texts = batch.column(len(keep))
            lengths = np.zeros(len(texts) + 1, np.int64)
            if len(texts):
                lengths = utf8(texts)[1]
            for lo, hi in blocks(lengths):
                part = batch.slice(lo, hi - lo)
                made = work(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=out_names)

    return source.mapInArrow(run, schema)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``n``."""
    if len(_powers["up"]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which ``slice_hash`` gets the hash of any slice of ``values``."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(0x51)) * U64(0xD6E8FEB86659FD93) * up[: len(values)], out=out[1:], dtype=U64)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread hashes over all 64 bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(29))


def slice_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the slices [a, b): equal for equal slices, wherever they stand."""
    _, down = powers(len(prefix))
    return mixed((prefix[b] - prefix[a]) * down[a])


#: Sums modulo a power of two can't tell some structured strings apart, whatever the multiplier; modulo a prime they can.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_220_703_125

_prime_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME_BASE**i and PRIME_BASE**-i modulo PRIME for i below ``n``."""
    while len(_prime_powers["up"]) < n:
        for name, base in (("up", PRIME_BASE), ("down", pow(PRIME_BASE, -1, PRIME))):
            have = _prime_powers[name]
            _prime_powers[name] = np.concatenate([have, have * U64(pow(base, len(have), PRIME)) % U64(PRIME)])
    return _prime_powers["up"][:n], _prime_powers["down"][:n]


def sure_prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``sure_hash`` gets its hashes from."""
    up, _ = prime_powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(0x51)) * up[: len(values)] % U64(PRIME), out=out[1:], dtype=U64)
    return prefix_hash(values), out


def sure_hash(prefix: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Like ``slice_hash``, also of structured strings: sums modulo 2**64 and modulo a prime, together, and the length."""
    plain, prime = prefix
    _, down = prime_powers(len(prime))
    rest = (prime[b] - prime[a]) % U64(PRIME) * down[a] % U64(PRIME)
    return mixed(slice_hash(plain, a, b) + mixed(rest << U64(32) | (b - a).astype(U64) & U64(0xFFFFFFFF)))


def gram_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` values from each position on."""
    count = max(0, len(prefix) - n)
    _, down = powers(len(prefix))
    return mixed((prefix[n:] - prefix[:count]) * down[:count])


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each segment [off[i], off[i+1]); an empty segment gives 0."""
    out = np.zeros(len(off) - 1)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full], dtype=np.float64)
    return out


def release() -> None:
    """Give memory that a fit has freed back to the system; the driver lives on for other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fold(doc_id, n: int):
    """crc32 of an id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))

