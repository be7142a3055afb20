"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts, counted over the whole running text of the
training documents, across blanks. Every byte of every text is coded: a symbol is
sought in its longest known context, of up to ``ORDER`` bytes; each context that
lacks it is left at the price of an escape (method D: half a count of each of its
symbols), and the shorter context then no longer counts the symbols of the longer
one, which are excluded. What no context has is coded evenly among the symbols
left. A text is coded as its words, A-Z in lower case, with one blank between
them, behind a blank that is given; its end is a symbol of its own. The counts are
those of the whole training fold, for its own documents too.

Nothing that grows with the corpus is broadcast or gathered on the driver.
Documents are packed into blocks of about 1 MB, compressed, and these dealt into
chunks of about ``CHUNK_BYTES``, whose blocks a worker opens one after another.
Each chunk asks once for each of its distinct symbols in context, and for each of
its words, which the base model needs; the asks with their counts are summed by
key. The trie is priced in groups of contexts with the same last three bytes:
these hold all their longer contexts, the counts of order 2 are joined to them,
and the orders 0 and 1 have at most 257 * 257 counts. Answers go back to the
chunks, by a join with the asks, packed and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .kit import LOWER, blocks, expand, span_hash, tune, words
from .shared import release, settle, stored

ORDER = 5
END = 256  # the symbol after the last byte
SYMBOLS = 257
#: Bytes of text in a chunk, about, and symbols at once within it.
CHUNK_BYTES, PIECE = 48 << 20, 1 << 19
#: Symbols in context that are priced at once, about.
GRAMS = 300_000
#: Symbols that are sorted at once where they are counted.
HELD_SYMBOLS = 1 << 21
HELD = 1
_CONTEXT = 9
_ORDER = 8 * ORDER + 9


def mask(k: int) -> int:
    """The bits of the last k bytes of a context."""
    return (1 << (8 * k)) - 1


def running(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each row, its given blank first and its end last, and the rows' offsets; ``s``, ``e`` and ``first`` are its words."""
    size = e - s
    place = np.append(0, np.cumsum(size + 1))
    length = np.maximum(place[first[1:]] - place[first[:-1]], 1) + 1
    offs = np.append(0, np.cumsum(length))
    out = np.full(int(offs[-1]), 32, np.uint16)
    at = place[:-1] + np.repeat(offs[:-1] - place[first[:-1]], np.diff(first)) + 1
    out[expand(at, size)] = data[expand(s, size)]
    out[offs[1:] - 1] = END
    return out, offs


def grams(text: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The packed (order, context, symbol) of every coded symbol and its row, a piece at a time."""
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    masks = np.array([mask(k) for k in range(ORDER)], np.int64)
    for a in range(0, len(text), PIECE):
        b = min(a + PIECE, len(text))
        back = min(a, ORDER)
        piece = text[a - back : b].astype(np.int64)
        context = np.zeros(len(piece), np.int64)
        for j in range(1, ORDER + 1):
            context[j:] |= piece[:-j] << (8 * (j - 1))
        context, row = context[back:], rows[a:b]
        inside = np.arange(a, b) - offs[row]
        # near a row's beginning the context is shorter; what stands before the row is masked, an end's ninth bit too
        young = np.flatnonzero(inside < ORDER)
        context[young] &= masks[inside[young]]
        g = context << _CONTEXT
        g |= piece[back:]
        g += ORDER << _ORDER
        g[young] -= (ORDER - inside[young]) << _ORDER
        coded = np.ones(b - a, bool)
        coded[young[inside[young] == 0]] = False
        yield g[coded], row[coded]


def packed_blocks(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, block): the rows (doc_id, held_out, text) in compressed blocks, dealt out by their places in the input, so that copies don't meet in one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for part, _, _ in blocks(batch):
                sink = pa.BufferOutputStream()
                # a slice of its own, so that only its bytes are written
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([n % chunks], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "block"])
                n += 1

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "chunk int, block binary")


def opened(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The blocks' rows, with the bytes and offsets of their texts in lower case."""
    for value in column:
        for batch in pa.ipc.open_stream(value.as_buffer()):
            for part, data, offs in blocks(batch):
                yield part, LOWER[data], offs


def asks(docs: DataFrame) -> DataFrame:
    """(key, chunk, n): the distinct symbols in context and words of each chunk, with their number in training texts."""

    def counted(marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate([*marks, np.zeros(0, np.int64)])
        v.sort()
        key = v >> 1
        first = np.flatnonzero(fresh(key))
        return key[first], np.add.reduceat(1 - (v & 1), first) if len(first) else first

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))

    def rows(parts: list[tuple[np.ndarray, np.ndarray]], chunk: int) -> Iterator[pa.RecordBatch]:
        keys, n = merged(parts)
        for i in range(0, len(keys), 1 << 16):
            k = keys[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), chunk, np.int32)), pa.array(n[i : i + (1 << 16)])], names=["key", "chunk", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        marks: list[np.ndarray] = []  # keys with a last bit that is 0 in training texts
        held, last = 0, None
        for batch in batches:
            chunk = batch.column(0)[0].as_py()
            if last is not None and chunk != last:
                yield from rows([*parts, counted(marks)], last)
                parts, marks, held = [], [], 0
            last = chunk
            for part, data, offs in opened(batch.column(1)):
                out = np.asarray(part.column(1).to_pylist(), bool).astype(np.int64)
                s, e, first = words(data, offs)
                row = np.repeat(np.arange(len(out)), np.diff(first))
                marks += [word_keys(span_hash(data, s, e)) << 1 | out[row], np.full(len(out), END_KEY << 1) | out]
                for g, of in grams(*running(data, s, e, first)):
                    marks.append(g << 1 | out[of])
                    held += len(g)
                    if held >= HELD_SYMBOLS:
                        parts.append(counted(marks))
                        marks, held = [], 0
                        if len(parts) >= 8:  # so that few are held at once
                            parts = [merged(parts)]
        if last is not None:
            yield from rows([*parts, counted(marks)], last)

    return docs.mapInArrow(run, "key long, chunk int, n long")


def word_keys(h: np.ndarray) -> np.ndarray:
    """Keys of words by their hashes: negative, and of 62 bits, so that one more can stand behind them."""
    return (h >> np.uint64(2)).view(np.int64) - (1 << 62)


END_KEY = int(word_keys(span_hash(np.zeros(1, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64)))[0])


def fresh(x: np.ndarray) -> np.ndarray:
    """Where the sorted array has a new value."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def added(g: np.ndarray, of: np.ndarray, n: int, keys: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum of the symbols' values for each of n rows; the keys are sorted and hold every symbol."""
    low = int(of[0]) if len(of) else 0
    bits = int(of[-1] - low).bit_length() if len(of) else 0
    if bits + _ORDER + 3 > 62:  # many short rows: in two parts
        half = len(g) // 2
        return added(g[:half], of[:half], n, keys, value) + added(g[half:], of[half:], n, keys, value)
    v = g << bits | (of - low)
    v.sort()
    own = v >> bits
    first = np.flatnonzero(fresh(own))
    found = value[np.searchsorted(keys, own[first])] if len(first) else np.zeros(0)
    return np.bincount((v & ((1 << bits) - 1)) + low, np.repeat(found, np.diff(np.append(first, len(v)))), n)


class Level:
    """The counts of one order: packed (context, symbol), sorted, and for each context its total, its symbols, and what the next shorter context has besides them."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, shorter: Level | None, order: int):
        self.keys, self.n = keys, n
        self.contexts, back = np.unique(keys >> _CONTEXT, return_inverse=True)
        self.total = np.bincount(back, n, len(self.contexts))
        self.distinct = np.bincount(back, minlength=len(self.contexts)).astype(float)
        self.below, self.fewer = np.zeros(len(self.contexts)), np.zeros(len(self.contexts))
        if shorter is not None and len(keys):
            symbol = keys & ((1 << _CONTEXT) - 1)
            up = (keys >> _CONTEXT) & mask(order - 1)
            seen = np.bincount(back, shorter.count(up << _CONTEXT | symbol), len(self.contexts))
            at, _ = shorter.find(self.contexts & mask(order - 1))
            self.below, self.fewer = shorter.total[at] - seen, shorter.distinct[at] - self.distinct

    def find(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the contexts, and whether they are known."""
        if not len(self.contexts):
            return np.zeros(len(contexts), np.int64), np.zeros(len(contexts), bool)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return at, self.contexts[at] == contexts

    def count(self, keys: np.ndarray) -> np.ndarray:
        """How often each (context, symbol) was seen."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and their sums."""
    if not len(keys):
        return keys, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(fresh(keys))
    return keys[first], np.add.reduceat(n[order], first).astype(np.int64)


def low_levels(first: list[tuple[int, int]]) -> list[Level]:
    """The orders 0 and 1, from the packed (context, symbol) of order 1."""
    keys = np.array([k for k, _ in first], np.int64)
    n = np.array([c for _, c in first], np.int64)
    keys, n = summed(keys, n)
    zero = Level(*summed(keys & ((1 << _CONTEXT) - 1), n), None, 0)
    return [zero, Level(keys, n, zero, 1)]


def prices(g: np.ndarray, n: np.ndarray, second: tuple[np.ndarray, np.ndarray], low: list[Level]) -> np.ndarray:
    """log10 of the probability of every packed symbol in context; ``n`` counts them in training texts, ``second`` are the counts of order 2."""
    order, packed = g >> _ORDER, g & ((1 << _ORDER) - 1)
    context, symbol = packed >> _CONTEXT, packed & ((1 << _CONTEXT) - 1)
    seen = n > 0
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {2: summed(*second) if len(second[0]) else second}
    keys, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(ORDER, 2, -1):
        own = seen & (order == k)
        shorter = ((keys >> _CONTEXT) & mask(k)) << _CONTEXT | keys & ((1 << _CONTEXT) - 1)
        keys, count = summed(np.concatenate([packed[own], shorter]), np.concatenate([n[own], count]))
        tables[k] = keys, count
    levels = list(low)
    for k in range(2, ORDER + 1):
        levels.append(Level(*tables[k], levels[-1], k))
    out = np.zeros(len(g))
    done = np.zeros(len(g), bool)
    total, distinct = np.full(len(g), -1.0), np.zeros(len(g))
    for k in range(ORDER, -1, -1):
        level = levels[k]
        on = np.flatnonzero(~done & (order >= k))
        at, known = level.find(context[on] & mask(k))
        on, at = on[known], at[known]
        if not len(on):
            continue
        free = total[on] < 0
        t = np.where(free, level.total[at], total[on])
        d = np.where(free, level.distinct[at], distinct[on])
        c = level.count((context[on] & mask(k)) << _CONTEXT | symbol[on])
        hit, escape = c > 0, (c == 0) & (d > 0)
        out[on[hit]] += np.log10((c[hit] - 0.5) / t[hit])
        out[on[escape]] += np.log10(0.5 * d[escape] / t[escape])
        done[on[hit]] = True
        total[on], distinct[on] = level.below[at], level.fewer[at]
    known = len(low[0].keys)
    out[~done] -= np.log10(max(1, SYMBOLS - known))
    return out


def priced(counts: DataFrame, rows: int) -> DataFrame:
    """(key, value): the log10 probability of every symbol in context of ``counts`` (key, n)."""
    spark = counts.sparkSession
    suffix = F.shiftright("key", _CONTEXT).bitwiseAND(F.lit(mask(3)))
    order = F.shiftright("key", _ORDER)
    packed = lambda k: F.col("key").bitwiseAND(F.lit((1 << (8 * k + _CONTEXT)) - 1))
    trained = counts.where("n > 0")
    first = trained.groupBy(packed(1).alias("k")).agg(F.sum("n").alias("n")).collect()  # at most 257 * 257 rows
    low = spark.sparkContext.broadcast([(r.k, r.n) for r in first])
    second = trained.where(order >= 2).groupBy(packed(2).alias("second")).agg(F.sum("n").alias("n"))
    groups = counts.select(suffix.alias("suffix")).distinct().withColumn("two", F.col("suffix").bitwiseAND(F.lit(mask(2))))
    above = groups.join(second.withColumn("two", F.shiftright("second", _CONTEXT)), "two").select("suffix", F.lit(None).cast("long").alias("key"), "second", "n")
    parts = max(1, -(-rows // GRAMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, two, two_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            n = batch.column(2).to_numpy()
            own = np.asarray(batch.column(0).is_valid())
            keys.append(batch.column(0).filter(pa.array(own)).to_numpy())
            ns.append(n[own])
            got, at = np.unique(batch.column(1).filter(pa.array(~own)).to_numpy(), return_index=True)
            two.append(got)
            two_n.append(n[~own][at])
        key, n = np.concatenate(keys), np.concatenate(ns)
        if not len(key):
            return
        order_two, at = np.unique(np.concatenate(two), return_index=True)  # several suffixes bring the same counts
        value = prices(key, n, (order_two, np.concatenate(two_n)[at]), low_levels(low.value))
        for i in range(0, len(key), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 17)]), pa.array(value[i : i + (1 << 17)])], names=["key", "value"])

    rows_ = counts.select(suffix.alias("suffix"), "key", F.lit(None).cast("long").alias("second"), "n").union(above)
    return rows_.repartition(parts, "suffix").select("key", "second", "n").mapInArrow(run, "key long, value double")


#: Answers that are packed at once.
PACKED = 1 << 20


def packed_answers(answers: DataFrame) -> DataFrame:
    """(to, n, keys, values) from (to, key, value): the keys in order, as steps, and their values, compressed."""

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, key, value = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        order = np.lexsort((key, to))
        to, key, value = to[order], key[order], value[order]
        first = np.flatnonzero(fresh(to))
        for a, b in zip(first, np.append(first[1:], len(to)), strict=True):
            steps = np.diff(key[a:b], prepend=np.int64(0))
            both = [pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (steps, value[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([to[a]], pa.int32()), pa.array([b - a], pa.int64()), *both], names=["to", "n", "keys", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield from rows(held)
                held, n = [], 0
        if n:
            yield from rows(held)

    return answers.select("to", "key", "value").mapInArrow(run, "to int, n long, keys binary, values binary")


def unpacked(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a chunk's answers, in order, and their values."""
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for n, key, value in zip(answers.column("n").to_pylist(), answers.column("keys"), answers.column("values"), strict=True):
        keys.append(np.cumsum(np.frombuffer(pa.decompress(key.as_buffer(), 8 * n, "zstd"), np.int64)))
        values.append(np.frombuffer(pa.decompress(value.as_buffer(), 8 * n, "zstd"), np.float64))
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    return key[order], value[order]


OUT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores every whole text under the model of the training fold; one row per input row.

    The fold is all rows but those whose crc32(doc_id as text) mod 5 is 1 (a null
    key counts as an empty text). A null, empty or blank text has the end as its only
    token and symbol. ``base_score`` is the contract's word model, ``score`` this one's
    log10 probability. Repeated rows count and are scored each; equal texts get equal
    scores. A very long text is coded whole, a piece of it at a time. Without
    training texts every symbol costs the same. Further columns are not read; an
    empty table gives no rows.
    """
    from .toxicity import remainder

    spark = docs.sparkSession
    tune(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    rows = docs.select("doc_id", (remainder(F.col("doc_id")) == HELD).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    # written, a row's chunk stays as it is
    rows = stored(packed_blocks(rows, chunks), "dealt")
    asked = stored(asks(rows.repartitionById(chunks, F.col("chunk"))), "asks", compression="zstd")
    settle(spark)
    tally, counted = Observation(), asked.groupBy("key").agg(F.sum("n").alias("n"))
    of_word = F.col("key") < 0
    counted = counted.observe(tally, F.sum(F.when(of_word, F.col("n"))).alias("n"), F.sum(F.when(of_word & (F.col("n") > 0), 1)).alias("v"), F.count(F.when(~of_word, 1)).alias("grams"))
    counted = stored(counted, "counts")
    total, distinct = tally.get["n"] or 0, tally.get["v"] or 0
    values = priced(counted.where(~of_word), tally.get["grams"]).union(counted.where(of_word).select("key", F.col("n").cast("double")))
    values = stored(values, "prices")
    release(counted)
    settle(spark)
    answers = packed_answers(asked.select("key", "chunk").join(values, "key").select(F.col("chunk").alias("to"), "key", "value"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, value = unpacked(right)
        word = int(np.searchsorted(keys, 0))
        of_words, count, keys, value = keys[:word], value[:word], keys[word:], value[word:]
        end = count[np.searchsorted(of_words, END_KEY)]
        base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        of_end = np.log10((end + 0.5) / (total + 0.5 * (distinct + 1)))
        out: list[list[np.ndarray]] = [[], [], [], []]
        kept: list[pa.RecordBatch] = []
        for part, data, offs in opened(left.column("block")):
            kept.append(part.select(["doc_id", "held_out"]))
            s, e, first = words(data, offs)
            n = len(offs) - 1
            row = np.repeat(np.arange(n), np.diff(first))
            h = word_keys(span_hash(data, s, e))
            order, at = np.argsort(h), np.empty(len(h), np.int64)
            at[order] = np.searchsorted(of_words, h[order])  # in their order, for the processor's cache
            out[0].append(np.diff(first) + 1)
            out[1].append(np.bincount(row, count[at] > 0, n) + (end > 0))
            out[2].append(np.bincount(row, base[at], n) + of_end)
            code = np.zeros(n)
            for g, of in grams(*running(data, s, e, first)):
                code += added(g, of, n, keys, value)
            out[3].append(code)
        if not kept:
            return schema.empty_table()
        rows = pa.Table.from_batches(kept)
        n, known, b, p = (np.concatenate(x) for x in out)
        return pa.table([rows.column("doc_id"), rows.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(b), pa.array(p)], schema=schema)

    form = f"doc_id {kind}, {OUT}"
    schema = to_arrow_schema(_parse_datatype_string(form))
    return rows.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(lambda a, b: run(a, b), form)
