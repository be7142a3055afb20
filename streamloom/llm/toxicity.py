"""Toxicity by logistic regression over hashed word features, learnt by FTRL-proximal.

Features of a text, each present or not: its words, word pairs (n-grams), pairs
with one word between (skip-grams) and the words' first four and five bytes
(stems, as insults are inflected). FTRL gives every coordinate a learning rate
of its own, and its L1 term leaves most weights at exactly zero, so that the
model is a short list of slots and weights: at most ``SLOTS`` entries whatever
the corpus, and far fewer in practice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import LOWER, Prefix, blocks, mix, numbered, tidy, tune

#: Labelled rows to learn from, at most (those of the smallest hashes of their keys), and how often they are passed over.
SAMPLE, PASSES = 16_000, 3
SLOTS = 1 << 22
ALPHA, BETA, L1, L2 = 0.5, 1.0, 5.0, 1.0

WORD = np.zeros(256, bool)
WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
SALTS = [np.uint64(x) for x in (0x51ED270B, 0x9F1B3D47, 0xC3A5C85C, 0x2545F491, 0x8CB92BA7)]


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the features of all rows with repeats, and the row of each."""
    data = LOWER[data]
    ink = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    end[:-1] &= ~ink[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not s.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offs, s, "right") - 1
    span = Prefix(data)
    word = mix(span(s, e) + (e - s).astype(np.uint64))
    slots, rows = [word ^ SALTS[0]], [row]
    for gap, salt in ((1, SALTS[1]), (2, SALTS[2])):
        same = row[gap:] == row[:-gap]
        slots.append((mix(word[:-gap] + salt) + word[gap:])[same])
        rows.append(row[gap:][same])
    for size, salt in ((4, SALTS[3]), (5, SALTS[4])):
        long = e - s > size
        slots.append(mix(span(s[long], s[long] + size) + salt))
        rows.append(row[long])
    return (mix(np.concatenate(slots)) & np.uint64(SLOTS - 1)).astype(np.int64), np.concatenate(rows)


class FTRL:
    """Follow the regularised leader, proximal form, for features that are present or not; slot SLOTS is the intercept, which L1 spares."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        l1 = np.where(i == SLOTS, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, slots: np.ndarray, label: float) -> None:
        """``slots`` are distinct."""
        i = np.append(slots, SLOTS)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for a in range(0, SLOTS + 1, 1 << 18):  # piece by piece, for the worker's memory
            i = np.arange(a, min(a + (1 << 18), SLOTS + 1))
            w = self.weights(i)
            found.append((i[w != 0], w[w != 0].astype(np.float32)))
        return np.concatenate([i for i, _ in found]), np.concatenate([w for _, w in found])


def remainder(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights from labelled documents outside the held-out fold.

    ``labels`` has ``doc_id`` and ``toxic``; rows with a null in either are left
    out, and of a key's several labels the largest holds, of its several texts one.
    At most ``sample`` keys are used, so that the one task that learns has bounded
    work at every size: it keeps the slots of each text once, for all passes.
    """
    tune(docs.sparkSession)
    fold = labels.select("doc_id", F.col("toxic").cast("double").alias("toxic")).dropna().where(remainder(F.col("doc_id")) != 0)
    fold = fold.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fold = fold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` narrow rows; a key's texts are one, however many rows repeat it
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(fold), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels = [], []
        for batch in batches:
            for part, data, offs in blocks(batch):
                slots, row = features(data, offs)
                v = np.sort(row * (SLOTS + 1) + slots)
                v = v[np.append(True, v[1:] != v[:-1])] if len(v) else v
                cuts = np.searchsorted(v, np.arange(len(offs)) * (SLOTS + 1))
                slots = (v % (SLOTS + 1)).astype(np.int32)
                own += [slots[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                labels += part.column(part.schema.get_field_index("toxic")).to_pylist()
        model = FTRL()
        for turn in range(passes):
            for j in np.argsort(mix(np.arange(len(own), dtype=np.uint64) * np.uint64(passes) + np.uint64(turn)), kind="stable").tolist():
                model.learn(own[j].astype(np.int64), labels[j])
        i, w = model.model()
        yield pa.RecordBatch.from_arrays([pa.array([i.tobytes()]), pa.array([w.tobytes()])], names=["slots", "weights"])

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "toxic")
    got = one.mapInArrow(run, "slots binary, weights binary").collect()
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.frombuffer(got[0].slots, np.int64), np.frombuffer(got[0].weights, np.float32)


def log_odds(model: tuple[np.ndarray, np.ndarray]):
    """A function from bytes and row offsets to the log odds of each row; equal features of a row count once."""
    w = np.zeros(SLOTS + 1, np.float32)
    w[model[0]] = model[1]

    def of(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        slot, row = features(data, offs)
        on = np.flatnonzero(w[slot])
        pair = np.unique(row[on] * (SLOTS + 1) + slot[on])
        return np.bincount(pair // (SLOTS + 1), w[pair % (SLOTS + 1)].astype(np.float64), len(offs) - 1) + float(w[SLOTS])

    return of


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null or empty text has the intercept alone."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SLOTS + 1 entries of 12 bytes
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = log_odds(shared.value)
        for batch in batches:
            for part, data, offs in blocks(batch):
                p = 1 / (1 + np.exp(-np.clip(of(data, offs), -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = (remainder(F.col("doc_id")) == 0).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passes: int = PASSES) -> DataFrame:
    """Learns from the labelled documents, then scores every document.

    One row per input row; repeated rows get equal scores. Null and empty texts
    have the intercept alone, a very long text is read whole. Without any label
    the score is 0.5. Further columns are not read; an empty table gives no rows.
    """
    return score(docs, learn(docs, labels, sample, passes))


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passes: int = PASSES) -> DataFrame:
    """The documents that are not predicted toxic (a score under 0.5), with all their columns."""
    model = learn(docs, labels, sample, passes)
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = log_odds(shared.value)
        for batch in batches:
            for part, data, offs in blocks(batch, text):
                yield part.filter(pa.array(of(data, offs) < 0))

    plain, text = numbered(docs), f"c{docs.columns.index('text')}"
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
