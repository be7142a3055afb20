"""Substring deduplication by content-defined chunks.

A gear rolling hash over the bytes sets the chunks' ends, so that an insertion
only shifts the chunks near it. Chunks are compared by a 128-bit digest over the
whole corpus; of equal ones the first, in the order of (doc_id, place), stays
and every later one goes, whatever its length and its neighbours. A copy of a
whole document has the same chunks and goes whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kit import BYTE_B, MULT_B, blocks, span_hash, tune
from .shared import stored

#: Least and greatest bytes of a chunk; between them about one place in 32 ends one. RUN: the least bytes of neighbouring repeats that go; 0 for all.
LEAST, MOST, RUN = 24, 128, 0
MASK = np.uint32(0x1F << 16)  # bits that the last 21 bytes decide, fewer than LEAST
GEAR = np.random.Generator(np.random.PCG64(97)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: sum of GEAR[b[i - j]] << j over the last 32, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] += h[:-step] << np.uint32(step)
    return h


def chunk_ends(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all rows, and each row's number of chunks."""
    places = (np.flatnonzero((gear(data) & MASK) == 0) + 1).tolist()
    places.append(len(data) + MOST + 1)
    ends, count, i = [], [], 0
    for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False):
        had = len(ends)
        while b - a > LEAST:
            while places[i] < a + LEAST:
                i += 1
            a = min(places[i], a + MOST, b)
            ends.append(a)
        if a < b:
            ends.append(b)
        count.append(len(ends) - had)
    return np.array(ends, np.int64), np.array(count, np.int64)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """A row for each chunk of every row (key, mark, text); those that stand in the same text before are marked ``again``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in blocks(batch):
                ends, count = chunk_ends(data, offs)
                row = np.repeat(np.arange(len(count)), count)
                start = np.append(0, ends[:-1])[: len(ends)]
                start = np.maximum(start, offs[row])
                one, two = span_hash(data, start, ends), span_hash(data, start, ends, BYTE_B, MULT_B)
                order = np.lexsort((start, two, one, row))
                again = np.zeros(len(order), bool)
                a, b = order[1:], order[:-1]
                again[a] = (row[a] == row[b]) & (one[a] == one[b]) & (two[a] == two[b])
                key, mark = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(key), pa.array(mark), pa.array(start - offs[row]), pa.array((ends - start).astype(np.int32)), pa.array(again)], names=["d1", "d2", "key", "mark", "start", "size", "again"])

    return docs.select("key", "mark", "text").mapInArrow(run, "d1 long, d2 long, key long, mark long, start long, size int, again boolean")


def repeated_spans(docs: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """(key, mark, spans): the byte ranges of each row's text that repeat earlier text, as an array of (start, end). A text's ranges alone meet in one row."""
    rows = chunk_rows(docs)
    shared = rows.where("NOT again").groupBy("d1", "d2").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    # as a table, so that the join's both sides are plain exchanges and Spark can split a frequent chunk's partition
    shared = stored(shared, "shared-chunks")
    later = rows.join(shared, ["d1", "d2"], "left").where(F.col("again") | (F.col("key") > F.col("first")))
    # rows that are the same in key and text have the same chunks
    once = later.groupBy("key", "mark", "start").agg(F.max("size").alias("size"))
    order = Window.partitionBy("key", "mark").orderBy("start")
    begins = F.coalesce(F.col("start") != F.lag(F.col("start") + F.col("size")).over(order), F.lit(True))
    runs = once.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    runs = runs.groupBy("key", "mark", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
    runs = runs.where(F.col("end") - F.col("start") >= run_bytes)
    return runs.groupBy("key", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with an order key, which for a null doc_id is the least, and a mark that rows of one key share if they are the same."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(F.col("doc_id").isNull(), text).alias("mark"), text.alias("text"))


def deduplicate(docs: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """doc_id, n_bytes, has_repeat, n_removed, n_spans and spans ("start:end", comma-joined, in UTF-8 bytes) of every document.

    Null and empty texts have no chunk; a very long text is cut whole. Rows that
    repeat a doc_id count as one place: none of them repeats the other, and each
    loses only what repeats an earlier document or itself. A null doc_id comes
    before all others. Further columns are not read.
    """
    tune(docs.sparkSession)
    rows = keyed(docs)
    found = repeated_spans(rows, run_bytes)
    out = rows.select("doc_id", "key", "mark", F.octet_length("text").cast("long").alias("n_bytes")).join(found, ["key", "mark"], "left")
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        F.col("spans").isNotNull().alias("has_repeat"),
        F.coalesce(size, F.lit(0)).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ","), F.lit("")).alias("spans"),
    )


def cleaned(docs: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """(doc_id, kept, kept_sha256): the documents' bytes without the repeats."""
    tune(docs.sparkSession)
    rows = keyed(docs)
    both = rows.join(repeated_spans(rows, run_bytes), ["key", "mark"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, out = text.encode(), 0, []
                for s in spans or ():
                    out.append(raw[at : s["start"]])
                    at = s["end"]
                kept.append(b"".join([*out, raw[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["doc_id", "kept", "kept_sha256"])

    return both.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept binary, kept_sha256 string")
