"""Benchmark decontamination by spaced seeds.

A seed is a hash of five words at the positions that a fixed mask keeps; the
words between may differ. Seeds of the benchmark and of the documents are
joined, and every hit is verified along its diagonal: a document is
contaminated if some ``WINDOW`` words in a row of an item stand in it, at the
same distances, with at least four fifths of them equal. The two masks together
hit every such window (at most two of twelve words differ; a test goes through
all patterns). Items shorter than a window must match in four fifths of their
words; they are seeded by the run of equal words that this forces. Words are
compared without regard to case, by Unicode's case folding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import LOWER, Prefix, blocks, expand, mix, numbered, tidy, tune, words
from .shared import release, stored

WINDOW = 12
MASKS = ((0, 1, 2, 3, 5), (0, 1, 4, 5, 6))
#: Bytes of benchmark text whose index is sent to the executors at once; a larger benchmark takes several passes.
PIECE_BYTES = 8 << 20
BITS = 20


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z in lower case, and per row the first one's number."""
    data = LOWER[data]
    s, e, first = words(data, offs)
    return mix(Prefix(data)(s, e) + (e - s).astype(np.uint64)), first


def folded_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, with the case of every letter folded by Unicode. What isn't UTF-8 stays as it is."""
    if not (data >= 0x80).any():
        return word_hashes(data, offs)
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    return word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64))


def needed(n: int) -> int:
    """Equal words that n words must have: four fifths, rounded up."""
    return -(-4 * n // 5)


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks for an item of n words."""
    if n >= WINDOW:
        return MASKS
    miss = n - needed(n)
    return (tuple(range(-(-needed(n) // (miss + 1)))),)


def seeds(word: np.ndarray, row: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The mask's seed at every place where it fits in a row, and those places."""
    at = np.arange(max(0, len(word) - mask[-1]))
    at = at[row[at] == row[at + mask[-1]]] if at.size else at
    h = np.full(len(at), len(mask) * 1000 + mask[-1], np.uint64)
    for k in mask:
        h = mix(h + word[at + k])
    return h, at


class Index:
    """Words and seeds of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        column = pa.array(texts, pa.string())
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        hashes, sizes = [], []
        for _, data, offs in blocks(batch):
            h, first = folded_hashes(data, offs)
            hashes.append(h)
            sizes.append(np.diff(first))
        self.ids = np.array(ids, np.int64)
        self.word = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.size = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        row = np.repeat(np.arange(len(ids)), self.size)
        self.masks = sorted({m for n in np.unique(self.size[self.size > 0]).tolist() for m in masks_of(n)})
        self.seed, self.item, self.place = [], [], []
        for mask in self.masks:
            h, at = seeds(self.word, row, mask)
            fits = np.array([mask in masks_of(n) for n in self.size.tolist()], bool)[row[at]] if at.size else np.zeros(0, bool)
            h, at = h[fits], at[fits]
            order = np.argsort(h, kind="stable")
            self.seed.append(h[order])
            self.item.append(row[at[order]])
            self.place.append((at - self.first[row[at]])[order])
        self.filter = []
        for h in self.seed:
            bit = np.zeros(1 << BITS, bool)
            bit[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
            self.filter.append(bit)

    def matches(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, most equal words in a window) of every verified overlap."""
        word, first = folded_hashes(data, offs)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        found = [np.zeros((0, 3), np.int64)]
        for mask, seed, item, place, bit in zip(self.masks, self.seed, self.item, self.place, self.filter, strict=True):
            h, at = seeds(word, row, mask)
            on = bit[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)]
            h, at = h[on], at[on]
            low = np.searchsorted(seed, h, "left")
            n = np.searchsorted(seed, h, "right") - low
            for a, b in pieces(n):  # a frequent seed may hit many items
                hit = expand(low[a:b], n[a:b])
                diagonals = np.unique(np.stack([np.repeat(row[at[a:b]], n[a:b]), item[hit], np.repeat(at[a:b], n[a:b]) - place[hit]], axis=1), axis=0)
                found.append(self.verified(word, first, diagonals))
        got = np.concatenate(found)
        got = got[np.lexsort((-got[:, 2], got[:, 1], got[:, 0]))]
        new = np.ones(len(got), bool)
        new[1:] = (got[1:, :2] != got[:-1, :2]).any(1)
        return got[new, 0], got[new, 1], got[new, 2]

    def verified(self, word: np.ndarray, first: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
        """(row, item, most equal words in a window) of the diagonals (row, item, number of the word that would be the item's first) that are overlaps."""
        out = [np.zeros((0, 3), np.int64)]
        for a, b in pieces(self.size[diagonals[:, 1]]):
            r, i, start = diagonals[a:b].T
            size = self.size[i]
            ends = np.cumsum(size)
            inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
            there = np.repeat(start, size) + inside
            equal = (there >= np.repeat(first[r], size)) & (there < np.repeat(first[r + 1], size))
            equal[equal] = word[there[equal]] == self.word[(np.repeat(self.first[i], size) + inside)[equal]]
            total = np.append(0, np.cumsum(equal))
            span = np.repeat(np.minimum(WINDOW, size), size)
            full = inside + 1 >= span
            at = np.arange(1, ends[-1] + 1)
            count = np.where(full, total[at] - total[np.maximum(at - span, 0)], 0)
            most = np.maximum.reduceat(count, ends - size)
            kept = most >= -(-4 * np.minimum(WINDOW, size) // 5)
            out.append(np.stack([r[kept], i[kept], most[kept]], axis=1))
        return np.concatenate(out)


def pieces(n: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts of rows with n[i] elements into pieces of about ``limit`` elements, each of one row at least."""
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def indexes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Indexes of the benchmark's items, each of about ``PIECE_BYTES`` of text, and whether more will come; items with a null id or without words can't match."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct()
    ids, texts, size = [], [], 0
    for item in items.toLocalIterator():
        if size >= PIECE_BYTES:
            yield Index(ids, texts), True
            ids, texts, size = [], [], 0
        ids.append(item.item_id)
        texts.append(item.text)
        size += len(item.text.encode())
    if ids:
        yield Index(ids, texts), False


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal) of every document row and item that overlap. One index at a time is with the executors."""
    spark = docs.sparkSession
    tune(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, n_equal long"
    out = spark.createDataFrame([], schema)
    for index, more in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offs in blocks(batch):
                    r, i, n = shared.value.matches(data, offs)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(shared.value.ids[i]), pa.array(n)], names=["doc_id", "item_id", "n_equal"])

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
        if more:
            out = stored(out, "overlaps")
            shared.destroy()
    return out


def mark(docs: DataFrame, benchmark: DataFrame, count: str = "n_items", flag: str = "contaminated") -> DataFrame:
    """Every input row with the number of items that overlap, in the column ``count``, and whether there is one, in ``flag``; they replace columns of these names.

    Null and empty texts are clean, as is everything where the benchmark is
    empty; a very long text is compared whole. Each row is judged by itself, so
    repeated rows are treated alike. One index at a time is with the executors:
    a benchmark of several is gone through piece by piece, over a table.
    """
    spark = docs.sparkSession
    tune(spark)
    names = docs.columns
    keep = [i for i, c in enumerate(names) if c not in (count, flag)]
    out = numbered(docs).select(*[f"c{i}" for i in keep], F.lit(0).cast("long").alias("n"))
    text, last = f"c{names.index('text')}", None
    for index, more in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offs in blocks(batch, text):
                    r, i, _ = shared.value.matches(data, offs)
                    pairs = np.unique(np.stack([r, shared.value.ids[i]], axis=1), axis=0)
                    n = np.bincount(pairs[:, 0], minlength=len(offs) - 1) + part.column(part.num_columns - 1).to_numpy()
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n)], schema=part.schema)

        out = out.mapInArrow(run, out.schema)
        if more:
            before, last = last, stored(out, "marked")
            out = last
            shared.destroy()
            if before is not None:
                release(before)
    return out.select("*", F.col("n") > 0).toDF(*[names[i] for i in keep], count, flag)


def mark_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated and n_items of every document."""
    return mark(docs.select("doc_id", "text"), benchmark).select("doc_id", "contaminated", "n_items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item, with all their columns, whatever their names."""
    count, flag = "n_items", "contaminated"
    while count in docs.columns:
        count += "_"
    while flag in docs.columns:
        flag += "_"
    marked = mark(docs, benchmark, count, flag)
    return marked.where(~F.col(f"`{flag}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
