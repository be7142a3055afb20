"""Byte-level BPE by ranks, in numpy, and its decoding.

Pre-tokens of like length are rows of one padded matrix. In each round every
row merges its leftmost pair of minimum rank, pairs being looked up in a hash
table; rows without a pair leave, and the others are shifted together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kit import TokenMemo, blocks, expand, tidy, tune

NONE = np.int32(1 << 30)
LONG = 64  # lengths up to this have a matrix each, longer ones share one by the power of two


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left = np.array([(a << 32) | b for a, b in pairs], np.int64)
        value = np.array(list(pairs.values()), np.int32)
        slot = self._slot(left)
        self.probes = 0
        while left.size:
            self.probes += 1
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = left[put], value[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, value, slot = left[rest], value[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Ranks:
    """A vocabulary of byte strings with ranks, which are also the ids."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        top = max(self.ranks.values()) + 1
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.table = PairTable(pairs)
        by_id = [b""] * top
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.size = np.array([len(x) for x in by_id], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(by_id), np.uint8)
        self.decimal = [str(i) for i in range(top)]
        self.memo = TokenMemo(self.encode)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        bucket = np.where(size <= LONG, size, LONG + np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        count = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for rows in np.split(order, cuts):
            if not len(rows):
                continue
            step = max(1, (1 << 22) // int(size[rows].max() + 1))
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                ids, n = self._matrix(data, start[own], size[own])
                count[own] = n
                parts.append((own, ids))
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for own, ids in parts:
            out[expand(first[own], count[own])] = ids
        return out, count

    def _matrix(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, width = len(start), int(size.max())
        if rows == 1 and width > 2048:
            return self._one(data[start[0] : start[0] + width])
        column = np.arange(width)
        m = np.full((rows, width), -1, np.int32)
        inside = column < size[:, None]
        m[inside] = self.byte[data[expand(start, size)]]
        left = size.copy()
        rank = np.full((rows, width), NONE, np.int32)
        if width > 1:
            pair = inside[:, 1:]
            rank[:, :-1][pair] = self.table(m[:, :-1][pair], m[:, 1:][pair])
        done_m: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        own = np.arange(rows)
        while len(own):
            at = rank.argmin(axis=1)  # the first of equal ranks is the leftmost
            i = np.arange(len(own))
            best = rank[i, at]
            over = best == NONE
            if over.any():
                done_m.append((own[over], m[over], left[over]))
                keep = ~over
                m, rank, left, own, at, best = m[keep], rank[keep], left[keep], own[keep], at[keep], best[keep]
                if not len(own):
                    break
                most = int(left.max())
                m, rank = m[:, :most], rank[:, :most]
                i = np.arange(len(own))
            width = m.shape[1]
            # close the gap that the pair's right half leaves
            source = np.arange(width - 1)[None, :]
            shift = source > at[:, None]
            m = np.where(shift, m[:, 1:], m[:, :-1])
            rank = np.where(shift, rank[:, 1:], rank[:, :-1])
            left = left - 1
            m[i, at] = best
            if width - 1 > 1:
                has = at + 1 < left
                rank[i, at] = NONE
                j = np.flatnonzero(has)
                rank[j, at[j]] = self.table(m[j, at[j]], m[j, at[j] + 1])
                j = np.flatnonzero(at > 0)
                rank[j, at[j] - 1] = self.table(m[j, at[j] - 1], m[j, at[j]])
            else:
                rank[i, at] = NONE
        count = np.zeros(rows, np.int64)
        for r, _, n in done_m:
            count[r] = n
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for r, x, n in done_m:
            out[expand(first[r], n)] = x[np.arange(x.shape[1]) < n[:, None]]
        return out, count

    def _one(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One very long pre-token: the same merges from a heap of pairs, so that the time stays near-linear."""
        import heapq

        ids = self.byte[data].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.table(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        none = int(NONE)
        heap = [(r, i) for i, r in enumerate(rank) if r != none]
        rank.append(none)
        heapq.heapify(heap)
        pair = lambda a, b: int(self.table(np.array([a], np.int32), np.array([b], np.int32))[0])
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                rank[i] = pair(r, ids[after[i]])
                if rank[i] != none:
                    heapq.heappush(heap, (rank[i], i))
            else:
                rank[i] = none
            p = before[i]
            if p >= 0:
                rank[p] = pair(ids[p], r)
                if rank[p] != none:
                    heapq.heappush(heap, (rank[p], p))
        out = np.array([x for x in ids if x >= 0], np.int32)
        return out, np.array([len(out)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[expand(self.first[ids], n)]


_vocabularies: dict[str, Ranks] = {}


def vocabulary(path: str) -> Ranks:
    """The ranks of a .tiktoken file, loaded once in each worker."""
    if path not in _vocabularies:
        with open(path, "rb") as f:
            _vocabularies[path] = Ranks(f.read())
    return _vocabularies[path]


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """The place of a public vocabulary file on this machine; each worker resolves it for itself."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text; one row per input row.

    Null and empty texts have no token; both digests are then those of no bytes.
    Rows are independent: repeated rows and keys, and null keys, give a row each.
    Only ``key`` and ``text`` are read, so further columns never clash. With
    ``ids`` the token ids are returned too. ``path``: a vocabulary file that every
    worker can open, by default the public one.
    """
    tune(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or ranks_path())
        for batch in batches:
            for rows, data, offs in blocks(batch):
                out, ends = v.memo(data, offs)
                plain = v.decode(out)
                stops = np.append(0, np.cumsum(v.size[out]))[ends].tolist()
                listed, cut = out.tolist(), ends.tolist()
                name = v.decimal.__getitem__
                sha = [hashlib.sha256(",".join(map(name, listed[a:b])).encode()).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]
                back = [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(stops, stops[1:], strict=False)]
                columns = [rows.column(0), pa.array(np.diff(ends)), pa.array(sha), pa.array(back)]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, {OUT}" + ", ids array<int>" * ids)
