"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokens are found without regular expressions. Each code point has a class
from a table; one or two code points of lookahead refine the classes. A class
stands for a function from state to state of a small automaton. The functions
that arise by composition are finitely many, so they are numbered once and
composed by a table; composition is associative, and the state before every
character follows from a blocked prefix scan over whole columns of characters.
State and class say whether a pre-token begins.

The slices between beginnings are merged pair by pair, lowest rank first, and
the merged ids are cached by slice, in two generations of bounded size. The byte
offset at which each token ends is retained; decoding gathers the tokens' bytes
from one flat table.

Defined results: a null text is encoded as an empty one, which has no tokens.
Extra columns are kept, clashing ones replaced.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import codepoints, map_texts, utf8

# Classes of code points: letter, number, other, space, other white space.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
#: The white space of Unicode's White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
# Refined classes: an apostrophe that can begin a contraction of one or two
# letters; white space that is followed by white space or the end; a space, and
# other white space, that is followed by something else.
APOS1, APOS2, BLANK, LEAD, LONE = 3, 4, 5, 6, 7
CLASSES = 8
# States: at a boundary; inside letters, numbers, others, white space; after a
# leading space; inside a contraction with two letters or one letter to come.
EDGE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_LEAD, TWO_MORE, ONE_MORE = range(8)
STATES = 8
#: What follows the apostrophe of a contraction.
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")
#: Cached slices of a worker in each of two generations, and the longest one cached.
CACHED, CACHED_BYTES = 300_000, 48
#: Characters in a column of the blocked scan.
COLUMN = 64


def class_table() -> np.ndarray:
    """Class of every code point, from Unicode's general categories."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[list(WHITE_SPACE)] = WHITE
    out[32] = SPACE
    return out


def step(state: int, kind: int) -> tuple[bool, int]:
    """(a pre-token begins here, next state)."""
    if state == TWO_MORE:
        return False, ONE_MORE
    if state == ONE_MORE:
        return False, EDGE
    if kind in (LETTER, NUMBER, OTHER):
        inside = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[kind]
        return state not in (inside, AFTER_LEAD), inside
    if kind in (APOS1, APOS2):
        if state in (IN_OTHERS, AFTER_LEAD):
            return False, IN_OTHERS
        return True, ONE_MORE if kind == APOS1 else TWO_MORE
    if kind == BLANK:
        return state != IN_BLANKS, IN_BLANKS
    return True, AFTER_LEAD if kind == LEAD else EDGE


class Automaton:
    """The functions that classes compose to, their composition table and their action."""

    def __init__(self) -> None:
        one = [tuple(step(s, k)[1] for s in range(STATES)) for k in range(CLASSES)]
        # the same functions after a reset: what a text's first character does
        first = [(f[EDGE],) * STATES for f in one]
        self.begins = np.array([[step(s, k)[0] for k in range(CLASSES)] for s in range(STATES)])
        number = {f: i for i, f in enumerate(dict.fromkeys(one + first))}
        todo = list(number)
        while todo:
            f = todo.pop()
            for g in one + first:
                h = tuple(g[x] for x in f)
                if h not in number:
                    number[h] = len(number)
                    todo.append(h)
        found = list(number)
        self.size = len(found)
        self.of_class = np.array([number[f] for f in one + first], np.int32)
        self.action = np.array(found, np.uint8)
        compose = np.array([[number[tuple(g[x] for x in f)] for g in found] for f in found], np.int32)
        self.compose = compose.ravel()

    def prefixes(self, f: np.ndarray) -> np.ndarray:
        """Inclusive prefix compositions of a sequence of functions."""
        n = len(f)
        if n <= COLUMN:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.compose[out[i - 1] * self.size + f[i]]
            return out
        rows = -(-n // COLUMN)
        grid = np.zeros(rows * COLUMN, np.int32)
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(rows, COLUMN).T)  # one row for each place in a column
        for j in range(1, COLUMN):
            grid[j] = self.compose[grid[j - 1] * self.size + grid[j]]
        before = self.prefixes(grid[-1])[:-1]
        grid[:, 1:] = self.compose[before[None, :] * self.size + grid[:, 1:]]
        return grid.T.ravel()[:n]

    def states(self, f: np.ndarray) -> np.ndarray:
        """State before each character, starting at a boundary."""
        out = np.empty(len(f), np.uint8)
        if len(f):
            out[0] = EDGE
            out[1:] = self.action[self.prefixes(f)[:-1], EDGE]
        return out


_made: dict = {}


def automaton() -> tuple[Automaton, np.ndarray]:
    if "automaton" not in _made:
        _made["automaton"] = Automaton(), class_table()
    return _made["automaton"]


def boundaries(cps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indices of the code points at which pre-tokens begin, over texts at offsets ``at``."""
    if not len(cps):
        return np.zeros(0, np.int64)
    machine, table = automaton()
    base = table[cps]
    after = np.full(len(cps), WHITE, np.uint8)  # the end of a text counts as white space
    after[:-1] = base[1:]
    ends = at[1:][at[1:] > at[:-1]] - 1
    after[ends] = WHITE
    kind = base.copy()
    followed = (base >= SPACE) & (after < SPACE)
    kind[base >= SPACE] = BLANK
    kind[followed & (base == SPACE)] = LEAD
    kind[followed & (base == WHITE)] = LONE
    apos = np.flatnonzero(cps == 39)
    if len(apos):
        end_of = at[np.searchsorted(at, apos, "right")]
        padded = np.concatenate([cps, [0, 0]])
        n1 = np.where(apos + 1 < end_of, padded[apos + 1], 0)
        n2 = np.where(apos + 2 < end_of, padded[apos + 2], 0)
        kind[apos[np.isin(n1, [ord(c) for c in CONTRACTIONS_1])]] = APOS1
        for a, b in CONTRACTIONS_2:
            kind[apos[(n1 == ord(a)) & (n2 == ord(b))]] = APOS2
    firsts = at[:-1][at[1:] > at[:-1]]
    which = kind.astype(np.int64)
    which[firsts] += CLASSES
    state = machine.states(machine.of_class[which])
    begins = machine.begins[state, kind]
    begins[firsts] = True
    return np.flatnonzero(begins)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a vocabulary file: base64 of a token, a space, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Encoder(dict):
    """Slice → its ids as little-endian unsigned 32-bit integers; merges what isn't cached."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def __missing__(self, piece: bytes) -> bytes:
        out = self.older.get(piece)
        if out is None:
            got = self.ranks.get(piece)
            ids = [got] if got is not None else self.merge(piece)
            out = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHED:  # what was used since the last turn stays at hand for one more
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank, the leftmost first, until none is left."""
        if len(piece) > 200:
            return self.merge_long(piece)
        rank = self.ranks.get
        none = 1 << 40
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(a + b, none) for a, b in zip(parts[:-1], parts[1:], strict=True)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs and linked neighbours, for long slices."""
        rank, n = self.ranks.get, len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := rank(piece[i : end[j]])) is not None:
                heap.append((r, i, end[i], end[j])) if building else heapq.heappush(heap, (r, i, end[i], end[j]))

        building = True
        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        building = False
        while heap:
            _, i, mid, last = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or after[i] >= n or end[after[i]] != last:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of a sequence of ids, and the offset at which each token ends."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b"", ends
        take = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.flat[take].tobytes(), ends


def encode(df: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens, ids (little-endian unsigned 32-bit integers), ends (the byte offset, in the same form, at which
    each token ends) and decoded (the bytes that the ids decode to)."""
    handle = df.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def make():
        # a Python worker runs many tasks; its cache of merges is kept between them
        if _made.get("ranks") != ranks_path:
            _made["encoder"], _made["ranks"] = Encoder(read_ranks(handle.value)), ranks_path
        encoder = _made["encoder"]

        def work(texts: pa.Array) -> list[pa.Array]:
            raw, off = utf8(texts)
            cps, at = codepoints(raw, off)
            data = raw.tobytes()
            begins = boundaries(cps, at)
            byte_at = np.flatnonzero((raw & 0xC0) != 0x80)
            if len(byte_at) != len(cps):  # invalid bytes were replaced
                data = b"".join(chr(c).encode() for c in cps.tolist())
                byte_at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            cuts = [*byte_at[begins].tolist(), len(data)]
            pieces = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            rows = np.searchsorted(begins, at).tolist()
            get = encoder.__getitem__
            counts, ids, ends, decoded = [], [], [], []
            for a, b in zip(rows[:-1], rows[1:], strict=True):
                own = b"".join([get(p) for p in pieces[a:b]])
                back, stops = encoder.decode(np.frombuffer(own, "<u4"))
                counts.append(len(own) // 4)
                ids.append(own)
                ends.append(stops.astype("<u4").tobytes())
                decoded.append(back)
            return [pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(ends, pa.binary()), pa.array(decoded, pa.binary())]

        return work

    return map_texts(df, text, df.columns if keep is None else keep, "n_tokens long, ids binary, ends binary, decoded binary", make)
