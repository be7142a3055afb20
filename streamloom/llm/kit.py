"""Vectorised text handling shared by the operators of this subpackage.

Texts arrive as Arrow string columns and are handled as one flat byte array
with row offsets, so that words, pre-tokens and their hashes are found by numpy
over whole blocks instead of by Python loops over characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_A = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_B = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
MULT_A = 0x9E3779B97F4A7C15
MULT_B = 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tune(spark) -> None:
    """Keeps Arrow batches small, for the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def trim() -> None:
    """Gives the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has one
    if give:
        give(0)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """An Arrow pass that trims its process before and after: Spark keeps the workers of earlier tasks, whose memory counts with that of the next."""

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch], *args, **named) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches, *args, **named)
        trim()

    return own


def numbered(docs):
    """The frame with its columns named c0, c1, ...: any names, those with dots too, can go through an Arrow pass."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection with good avalanche)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of about ``limit`` bytes of text, with their bytes and offsets."""
    data, offs = utf8(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def powers(n: int, mult: int) -> tuple[np.ndarray, np.ndarray]:
    """``mult**i`` and its inverses mod 2**64, for i up to n."""
    have = _powers.get(mult)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        p = np.full(size, U64(mult))
        p[0] = 1
        q = np.full(size, U64(pow(mult, -1, 1 << 64)))
        q[0] = 1
        have = np.cumprod(p), np.cumprod(q)
        if size <= 8 * BLOCK_BYTES:
            _powers[mult] = have
    return have


class Prefix:
    """Prefix polynomial hashes of a byte array: the hash of any span by two lookups."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTE_A, mult: int = MULT_A):
        p, self.inverse = powers(len(data), mult)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(table[data] * p[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE_A, mult: int = MULT_A) -> np.ndarray:
    return mix(Prefix(data, table, mult)(start, end) + (end - start).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per row, the number of the first one (with one entry more)."""
    ink = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    end[:-1] &= ~ink[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all the runs, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point for the public pre-token pattern."""
    if not _classes:
        import regex

        out = np.full(0x110000, OTHER, np.uint8)
        points = [range(0xD800), range(0xE000, 0x110000)]
        for first in points:
            every = "".join(map(chr, first))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
                for m in regex.finditer(pattern, every):
                    out[first.start + m.start() : first.start + m.end()] = kind
        _classes.append(out)
    return _classes[0]


def pretokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of ``public_tokenizers.PATTERN``; they cover every byte, and none crosses a row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    table = classes()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        pad = np.concatenate([data[-4:], np.zeros(4, np.uint8)])
        at = lambda k: (np.where(lead + k < n, data[np.minimum(lead + k, n - 1)], pad[-1]) & 63).astype(np.int32)
        b = data[lead].astype(np.int32)
        two, three = b < 0xE0, (b >= 0xE0) & (b < 0xF0)
        point = (b & 31) << 6 | at(1)
        if not two.all():
            point = np.where(three, (b & 15) << 12 | at(1) << 6 | at(2), np.where(two, point, (b & 7) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        k = table[np.minimum(point, 0x10FFFF)]
        kind[lead] = k
        for more, which in ((1, slice(None)), (2, ~two), (3, b >= 0xF0)):
            kind[np.minimum(lead[which] + more, n - 1)] = k[which]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    begin = edge[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # the last character of a white-space run before other text stands alone, or joins that text if it is a blank
    b = np.flatnonzero(begin & (kind != SPACE) & ~edge[:n])
    b = b[kind[b - 1] == SPACE]
    last = b - 1
    while (tail := (data[last] & 0xC0) == 0x80).any():
        last = last - tail
    begin[last] = True
    begin[b] = data[last] != 0x20
    # contractions: an apostrophe that starts a token takes the letters that follow
    q = np.flatnonzero((data == 0x27) & begin)
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == LETTER) & ~edge[q + 1]]
    if q.size:
        one, two = data[q + 1], data[np.minimum(q + 2, n - 1)]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        double &= (q + 2 < n) & ~edge[np.minimum(q + 2, n)]
        for hit, size in ((q[single], 2), (q[double], 3)):
            begin[hit + 1] = False
            stop = hit[hit + size < n] + size
            begin[stop] = True
    return np.flatnonzero(begin)


class TokenMemo:
    """Token ids of distinct pre-tokens, kept between blocks up to a bound and then begun anew.

    ``encode`` takes (data, starts, ends) of unseen pre-tokens and returns their
    ids one after another, with the number of ids of each.
    """

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.check = np.zeros(1 << 14, np.uint64)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and each row's end in them (from 0)."""
        s = pretokens(data, offs)
        if not s.size:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        e = np.append(s[1:], len(data))
        h = span_hash(data, s, e)
        second = Prefix(data, BYTE_B, MULT_B)(s, e)
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        if (second[at][back] != second).any():  # two pre-tokens with one hash: encode this block's tokens one by one
            ids, n = self.encode(data, s, e)
            ends = np.append(0, np.cumsum(n))
            return ids, ends[np.searchsorted(s, offs)]
        if len(self.known) + len(keys) > max(self.limit, len(keys)):
            self.clear()
        where = np.fromiter(map(self.known.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        seen = where >= 0
        if (self.check[where[seen]] != second[at[seen]]).any():
            self.clear()
            where[:], seen[:] = -1, False
        new = np.flatnonzero(~seen)
        if new.size:
            ids, n = self.encode(data, s[at[new]], e[at[new]])
            base = len(self.known)
            while base + len(new) > len(self.first):
                self.first, self.count, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.check))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            own = np.arange(base, base + len(new))
            self.first[own], self.count[own], self.check[own] = self.used + np.cumsum(n) - n, n, second[at[new]]
            self.used += len(ids)
            where[new] = own
            self.known.update(zip(keys[new].tolist(), own.tolist(), strict=True))
        token = where[back]
        n = self.count[token]
        ends = np.append(0, np.cumsum(n))
        return self.ids[expand(self.first[token], n)], ends[np.searchsorted(s, offs)]
