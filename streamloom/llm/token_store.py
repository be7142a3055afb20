"""Token ids as raw binary payloads under a minimal perfect hash index.

A store is a folder of Parquet rows, one for each block of documents in
ascending key order. A row holds the block's ids as raw little-endian unsigned
integers (2 bytes if the vocabulary allows, else 4), the documents' lengths and
keys, and a minimal perfect hash of the distinct keys: a key's slot holds a
32-bit fingerprint, by which foreign keys are refused, and the ordinal of its
first document, from which the offset follows. A block holds at most
``BLOCK_DOCS`` documents and, but for a longer single document, ``BLOCK_BYTES``
of ids, so that neither writing nor reading needs a whole shard in memory.
Spark's own writers and readers move the files, so any file system serves, and
lost tasks are repeated under its commit protocol.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kit import TokenMemo, blocks, expand, mix, tune
from .shared import new_path

BLOCK_DOCS = 65_536
BLOCK_BYTES = 4 << 20
JOINED = 256  # pre-tokens in one text for the tokenizers library
SCHEMA = "shard int, block int, first_key long, last_key long, n_null int, n_docs int, base long, n_tokens long, width int, payload binary, keys binary, lengths binary, pilots binary, fingerprints binary, ordinals binary"
C1, C2, C3 = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys: a pilot for each bucket of about four keys puts every key into a slot of its own."""

    def __init__(self, n: int, pilots: np.ndarray):
        self.n, self.pilots = n, pilots

    @staticmethod
    def parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.astype(np.int64).view(np.uint64)
        return mix(k ^ C1), mix(k ^ C2), (mix(k ^ C3) >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def slot(second: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
        h = mix(second ^ (pilot.astype(np.uint64) * C3 + C1)) >> np.uint64(32)
        return ((h * np.uint64(n)) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        if n == 0:
            return cls(0, np.zeros(0, np.uint32))
        first, second, _ = cls.parts(keys)
        size = max(1, n // 4)
        bucket = (first % np.uint64(size)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=size)
        ends = np.cumsum(counts)
        taken = np.zeros(n, bool)
        pilots = np.zeros(size, np.uint32)
        for b in np.argsort(-counts, kind="stable"):
            c = counts[b]
            if c == 0:
                break
            own = second[order[ends[b] - c : ends[b]]]
            low, step = 0, 64
            while True:
                tries = np.arange(low, low + step, dtype=np.uint64)
                slots = cls.slot(own[:, None], tries[None, :], n)
                good = ~taken[slots].any(axis=0)
                if c > 1:
                    s = np.sort(slots, axis=0)
                    good &= (s[1:] != s[:-1]).all(axis=0)
                hit = np.flatnonzero(good)
                if hit.size:
                    pilots[b] = low + hit[0]
                    taken[slots[:, hit[0]]] = True
                    break
                low, step = low + step, min(step * 2, max(64, (1 << 18) // int(c)))
        return cls(n, pilots)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot that each key would have, and its fingerprint."""
        first, second, mark = self.parts(keys)
        return self.slot(second, self.pilots[(first % np.uint64(len(self.pilots))).astype(np.int64)], self.n), mark


class Block:
    """One row of a store, opened."""

    def __init__(self, row: dict):
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.ends = np.cumsum(self.lengths, dtype=np.int64)
        self.payload, self.width = row["payload"], row["width"]
        self.hash = PerfectHash(len(row["fingerprints"]) // 4, np.frombuffer(row["pilots"], np.uint32))
        self.marks = np.frombuffer(row["fingerprints"], np.uint32)
        self.ordinals = np.frombuffer(row["ordinals"], np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ordinal of each key's first document, -1 where the fingerprint says that the key is absent."""
        if not self.hash.n:
            return np.full(len(keys), -1, np.int64)
        slot, mark = self.hash(keys)
        return np.where(self.marks[slot] == mark, self.ordinals[slot], -1)

    def ids(self, ordinal: int) -> np.ndarray:
        end = int(self.ends[ordinal])
        kind = np.dtype("<u2" if self.width == 2 else "<u4")
        return np.frombuffer(self.payload, kind, int(self.lengths[ordinal]), (end - int(self.lengths[ordinal])) * self.width)


def make_block(shard: int, block: int, keys: list, payloads: list[bytes], base: int, width: int) -> dict:
    nulls = sum(k is None for k in keys)
    own = np.array([0 if k is None else k for k in keys], np.int64)
    lengths = np.array([len(p) // width for p in payloads], np.int32)
    distinct, first = np.unique(own[nulls:], return_index=True)
    perfect = PerfectHash.build(distinct)
    marks, ordinals = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int32)
    if len(distinct):
        slot, mark = perfect(distinct)
        marks[slot], ordinals[slot] = mark, first + nulls
    return {
        "shard": shard, "block": block, "first_key": int(own[nulls]) if nulls < len(own) else None, "last_key": int(own[-1]) if nulls < len(own) else None,
        "n_null": nulls, "n_docs": len(keys), "base": base, "n_tokens": int(lengths.sum()), "width": width, "payload": b"".join(payloads),
        "keys": own.tobytes(), "lengths": lengths.tobytes(), "pilots": perfect.pilots.tobytes(), "fingerprints": marks.tobytes(), "ordinals": ordinals.tobytes(),
    }


class Encoder:
    """The library's ids of whole texts: by a memo over pre-tokens, or by the library itself for the texts that hold one of its added tokens."""

    def __init__(self, tokenizer, memo: TokenMemo):
        self.tokenizer, self.memo = tokenizer, memo
        self.added = [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values() if x.content]

    def holding(self, raw: bytes, offs: np.ndarray) -> list[int]:
        """The rows whose text holds an added token."""
        found = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offs, at, "right")) - 1
                if at + len(token) <= offs[row + 1]:
                    found.add(row)
                    at = raw.find(token, int(offs[row + 1]))
                else:  # it only seems to be one where two rows meet
                    at = raw.find(token, at + 1)
        return sorted(found)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and each row's end in them (from 0)."""
        ids, ends = self.memo(data, offs)
        raw = data.tobytes()
        rows = self.holding(raw, offs)
        if not rows:
            return ids, ends
        count, parts, at = np.diff(ends), [], 0
        for i in rows:
            own = self.tokenizer.encode(raw[offs[i] : offs[i + 1]].decode(), add_special_tokens=False).ids
            parts += [ids[at : ends[i]], np.array(own, ids.dtype)]
            count[i], at = len(own), ends[i + 1]
        return np.concatenate([*parts, ids[at:]]), np.append(0, np.cumsum(count))


_memos: dict[str, tuple[Encoder, int]] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(path: str) -> tuple[Encoder, int]:
    """The tokenizers library over whole texts, and the size of its vocabulary.

    The tokenizer's pre-tokens are encoded by the library; as its merges never
    cross them, the ids of a text are those of its pre-tokens one after another.
    Added tokens that stand in a text have their own ids, as in the library.
    """
    if path not in _memos:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)

        def each(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            texts = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            ids = [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.array(list(chain.from_iterable(ids)), np.int32), count

        def joined(raw: bytes, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
            """Pre-tokens that each begin with a blank and a letter split again at just those blanks, so many make one text."""
            at = cut[:-1:JOINED].tolist() + [int(cut[-1])]
            coded = t.encode_batch([raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)], add_special_tokens=False)
            words = [np.array(x.word_ids, np.int64) for x in coded]
            n = np.diff(np.append(np.arange(0, len(cut) - 1, JOINED), len(cut) - 1)).tolist()
            if [int(w[-1]) + 1 for w in words] != n:
                return None
            count = np.concatenate([np.bincount(w, minlength=m) for w, m in zip(words, n, strict=True)])
            return np.array(list(chain.from_iterable(x.ids for x in coded)), np.int32), count

        def encode(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            second = data[np.minimum(start + 1, len(data) - 1)] | 32
            blank = (data[start] == 32) & (end - start > 1) & (second >= 97) & (second <= 122)
            parts, count = [], np.zeros(len(start), np.int64)
            for rows, many in ((np.flatnonzero(blank), True), (np.flatnonzero(~blank), False)):
                if not rows.size:
                    continue
                s, e = start[rows], end[rows]
                cut = np.append(0, np.cumsum(e - s))
                raw = data[expand(s, e - s)].tobytes()
                ids, count[rows] = many and joined(raw, cut) or each(raw, cut[:-1], cut[1:])
                parts.append((rows, ids))
            out, first = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
            for rows, ids in parts:
                out[expand(first[rows], count[rows])] = ids
            return out, count

        _memos[path] = Encoder(t, TokenMemo(encode, 600_000)), t.get_vocab_size()
    return _memos[path]


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text", compression: str = "zstd") -> str:
    """Encodes every whole text, appends ``end_id`` and writes a store in ascending key order.

    Null texts count as empty: the end id alone. A text that spells one of the
    tokenizer's added tokens gets that token's id, as the library gives it. Documents with a null key come
    first and are not indexed; those of repeated keys stand together, in the order
    of their ids' checksums, and the index gives the first. An empty table gives
    a store without rows. Other columns are not read. ``compression``: of the
    Parquet pages that hold the payloads.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = max(1, docs.rdd.getNumPartitions())
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("x")).first().x if n > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, size = encoder(tokenizer or tokenizer_path())
        kind = np.dtype("<u2" if max(size, end_id) <= 65_535 else "<u4")
        for batch in batches:
            for rows, data, offs in blocks(batch):
                ids, ends = memo(data, offs)
                m = len(offs) - 1
                out = np.insert(ids, ends[1:], end_id).astype(kind)
                cut = np.concatenate([[0], ends[1:] + np.arange(1, m + 1)]) * kind.itemsize
                payload = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
                own = rows.column(0)
                shard = np.searchsorted(bounds, own.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "left").astype(np.int32)
                tie = [zlib.crc32(x) for x in payload.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard), own, pa.array(tie, pa.int64()), pa.array(np.full(m, kind.itemsize, np.int32)), payload], names=["shard", "doc_id", "tie", "width", "payload"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, base, size, keys, payloads, width = -1, 0, 0, 0, [], [], 2
        for batch in batches:
            for s, k, w, p in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if keys and (s != shard or len(keys) >= BLOCK_DOCS or size + len(p) > BLOCK_BYTES):
                    row = make_block(shard, block, keys, payloads, base, width)
                    yield pa.RecordBatch.from_pylist([row], schema)
                    base, block, size, keys, payloads = base + row["n_tokens"], block + 1, 0, [], []
                if s != shard:
                    shard, block, base = s, 0, 0
                width, size = w, size + len(p)
                keys.append(k)
                payloads.append(p)
        if keys:
            yield pa.RecordBatch.from_pylist([make_block(shard, block, keys, payloads, base, width)], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    shards = len(bounds) + 1
    sent = docs.mapInArrow(encode, "shard int, doc_id long, tie long, width int, payload binary")
    sent = sent.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("shard"), F.col("doc_id").asc_nulls_first(), "tie")
    sent.mapInArrow(pack, SCHEMA).write.option("compression", compression).option("parquet.block.size", 16 << 20).parquet(path)
    return path


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's blocks with ``start``, the ids of all blocks before each; only totals of shards meet in one place."""
    raw = spark.read.schema(SCHEMA).parquet(path)
    totals = raw.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    # one row of 12 bytes for each shard, and there are no more shards than input splits
    return raw.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("base")).drop("before")


def read_store(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Every document of a store, found through the index of its block."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, nulls, start = Block(row), row["n_null"], row["start"]
                found = block.find(block.keys)
                repeat = np.append(False, block.keys[1:] == block.keys[:-1])
                repeat[: nulls + 1] = False
                ordinal = np.arange(len(found))
                first = np.maximum.accumulate(np.where(repeat, 0, ordinal))
                if (found[nulls:] != first[nulls:]).any():
                    raise ValueError(f"the index of shard {row['shard']}, block {row['block']} doesn't fit its keys")
                at = np.where(ordinal < nulls, ordinal, found + ordinal - first)
                crc = [zlib.crc32(block.ids(j).astype("<u4").tobytes()) for j in at.tolist()]
                columns = [
                    pa.array(block.keys, mask=ordinal < nulls),
                    pa.array(start + block.ends[at] - block.lengths[at]),
                    pa.array(block.lengths[at].astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([block.ids(j).astype(np.int32) for j in at.tolist()], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    frame = open_store(spark, path).select("shard", "block", "n_null", "start", "width", "payload", "keys", "lengths", "pilots", "fingerprints", "ordinals")
    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """The ids of a stated list of keys: only blocks whose key range holds one are read, and each key costs one probe."""
    wanted = np.unique(np.array(keys, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                own = wanted[(wanted >= row["first_key"]) & (wanted <= row["last_key"])]
                at = block.find(own)
                for k, j in zip(own.tolist(), at.tolist(), strict=True):
                    while 0 <= j < len(block.keys) and block.keys[j] == k:
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([block.ids(j).astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])
                        j += 1

    inside = F.exists(F.lit(wanted.tolist()), lambda k: (k >= F.col("first_key")) & (k <= F.col("last_key"))) if len(wanted) else F.lit(False)
    return spark.read.schema(SCHEMA).parquet(path).where(inside).mapInArrow(run, "doc_id long, ids array<int>")


def store_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes a store in the shared folder and reads it back."""
    path = new_path(docs.sparkSession, "token-store")
    return read_store(docs.sparkSession, write_store(docs, path, tokenizer))
